"""Fingerprints against a plain version of bins, densification and packing; id buckets of any spread."""

from __future__ import annotations

import re

import pytest

pytest.importorskip("turnwise.llm.entry")
xxhash = pytest.importorskip("xxhash")

from pyspark.sql import functions as F  # noqa: E402

from turnwise.llm import fingerprints  # noqa: E402

BINS, BITS = 256, 4


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*values):
    """The hash of several values: each is hashed with the one before as its seed, the first with 42. Ints are (value, bytes)."""
    h = 42
    for v in values:
        h = xxhash.xxh64(v if isinstance(v, bytes) else v[0].to_bytes(v[1], "little", signed=True), seed=h).intdigest()
    return signed(h)


def plain_fingerprint(text, width=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not words:
        return ""
    each = [chained(w.encode()) for w in words]
    hashes = [chained(*[(h, 8) for h in each[i : i + width]]) for i in range(len(words) - width + 1)]
    if len(words) < width:
        hashes = [chained(" ".join(words).encode(), (len(words), 4))]
    least: dict[int, int] = {}
    for h in hashes:
        b = h >> 56  # -128 .. 127
        least[b] = min(h, least.get(b, h))
    bins = [least.get(b) for b in range(-BINS // 2, BINS // 2)]
    values = []
    for b, x in enumerate(bins):
        probe = 0
        while x is None and probe < 24:
            x = bins[chained((b, 4), (probe, 4)) & (BINS - 1)]
            probe += 1
        if x is None:
            x = min((chained((b, 4), (y >> 56, 8)), y) for y in bins if y is not None)[1]
        values.append(x & ((1 << BITS) - 1))
    out = ""
    for k in range(0, BINS, 16):
        word = 0
        for v in values[k : k + 16]:
            word = word << BITS | v
        out += f"{word:016X}"
    return out


def test_fingerprint_equals_the_plain_one(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()] + ["one", "a b c d", "a b c d e", "", None, "x " * 3000, "漢字 кот x y z 😀"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", fingerprints.fingerprint_hex(fingerprints.fingerprint(F.col("text"))).alias("f")).collect()
    for r in rows:
        assert r.f == plain_fingerprint(texts[r.i]), r.i


@pytest.mark.parametrize("sampled", [200_000, 300])
@pytest.mark.parametrize("ids", [[*range(20_000), 10**15], [k**5 for k in range(-1500, 1500)], [7] * 500 + [8] * 500 + list(range(100)), [-(10**18), 0, 1, 2, 3, 10**18] * 30, [5] * 40])
def test_buckets_of_any_spread(spark, ids, sampled):
    d = spark.createDataFrame([(i, "t") for i in ids] + [(None, "u")] * 3, "doc_id long, text string")
    got = fingerprints.with_buckets(d, per_bucket=4, bins=16, sampled=sampled).groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("bucket").collect()
    assert sum(r.n for r in got) == len(ids) + 3
    own = [r for r in got if r.low is not None]
    assert all(a.high < b.low for a, b in zip(own, own[1:])) and len(own) < len(ids)
    assert all(r.n <= 8 or r.low == r.high for r in own), max(r.n for r in own)
