"""Periodic runs against a scan of all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("turnwise.llm.entry")

from pyspark.sql import functions as F  # noqa: E402

from turnwise.llm import entry, periodic_runs  # noqa: E402


def all_runs(w, least=12, most=None):
    """Every stretch of each period that no neighbour extends, without those of a smaller period."""
    n, found = len(w), {}
    for q in range(1, (most or n // 2) + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)  # the smallest comes first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def digest(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(all_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_a_scan_of_all_periods():
    rng, seen = random.Random(11), 0
    for _ in range(800):
        texts = []
        for _ in range(rng.randint(1, 4)):
            letters, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.randint(0, 70)
            w = [b"%d" % rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randint(1, 20)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        for least in (12, 5):
            got = periodic_runs.word_runs(texts, least)
            assert got == [sorted(all_runs(w, least), key=lambda r: (r[0], r[2])) for w in texts]
            seen += sum(map(len, got))
    assert seen > 3000


def test_runs_of_very_long_texts():
    x, y = [b"a"], [b"a", b"b"]
    while len(y) < 3000:
        x, y = y, y + x
    (got,) = periodic_runs.word_runs([y])
    assert got == sorted(all_runs(y), key=lambda r: (r[0], r[2])) and len(got) > 500
    assert periodic_runs.word_runs([[b"same"] * 100_000, [b"w%d" % i for i in range(100_000)] * 2]) == [[(0, 100_000, 1)], [(0, 200_000, 100_000)]]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a " * 12), (5, "a " * 12), (None, "b c " * 6), (None, None), (6, "漢字 кот " * 9 + "\x1fx"), (7, "a b " * 12), (8, "x y z " * 4000), (9, "no repeats in these words")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("runs", "n_words", "collapsed", "start")})
    got = periodic_runs.run_digest(periodic_runs.periodic_runs(periodic_runs.with_planted_period(docs), keep=["doc_id"])).collect()
    want = [(i, *digest(i, t)) for i, t in rows if i != 8]
    assert sorted([tuple(r) for r in got if r.doc_id != 8], key=str) == sorted(want, key=str)
    (long,) = [r for r in got if r.doc_id == 8]
    assert (long.start, long.length, long.period) == (0, 12000, 3) and long.exponent_milli == 4_000_000
    assert periodic_runs.run_digest(periodic_runs.periodic_runs(periodic_runs.with_planted_period(docs.limit(0)), keep=["doc_id"])).count() == 0


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entry.queries()["op11_periodic_runs"](spark, sf).collect()
    assert len(got) == len(docs)
    few = [r for r in got if len((docs[r.doc_id] or "").split()) <= 1500]
    assert len(few) > 100 and sum(r.n_runs > 0 for r in few) > 10
    for r in few:
        assert tuple(r) == (r.doc_id, *digest(r.doc_id, docs[r.doc_id]))
