"""Ranked search against scores of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("turnwise.llm.entry")

from pyspark.sql import functions as F  # noqa: E402

from turnwise.llm import ranked_search as R  # noqa: E402


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=10):
    """docs: (doc_id, text); items: (item_id, text), each once."""
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            scores += [(-s, i is None, i or 0)] * (s > 0)
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "terms", "score", "rank", "item", "length")}), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["ÄÖ", "ключ", "Ab", "9x"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(words[min(int(rng.expovariate(0.08)), 63)] for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 20, 200]))) for i in range(600)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(2000, None), (2001, ""), (2002, " .,;"), (None, docs[3][1]), (3, docs[3][1]), (3000, "w1 ab " * 20_000)]
    items = [(k, text(rng.choice([1, 4, 30]))) for k in range(40)] + [(90, None), (91, "?!"), (92, "nowhere"), (5, docs[7][1]), (None, "w2 W3 ÄÖ"), (6, "w1 " * 3000)]
    return docs, items


def test_search_equals_scores_of_all(spark, corpus):
    docs, items = corpus
    d, q = frames(spark, docs, [*items, items[0]])
    want = brute(docs, items)
    got = R.ranked_search(d.repartition(5), q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sorted(map(tuple, R.ranked_search(d, q, block_items=20, longest_share=0.5).collect()), key=str) == want
    assert sorted(map(tuple, R.ranked_search(d, q, top=1000).filter("item_id = 5").collect()), key=str) == [r for r in brute(docs, items, 1000) if r[0] == 5]


def test_empty_tables(spark, corpus):
    d, q = frames(spark, *corpus)
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.filter("text is null"), q), (d, q.filter("item_id in (90, 91)"))):
        assert R.ranked_search(a, b).count() == 0


def test_bounds_lose_nothing():
    """Random sparse vectors, in buckets of falling length and in any order, with and without a least score."""
    rng = np.random.default_rng(3)
    for trial in range(60):
        n_terms, n = int(rng.integers(1, 40)), int(rng.integers(1, 400))
        weights = rng.integers(0, 9000, n_terms)
        x = rng.integers(1, 1_000_000, (n, n_terms)) * (rng.random((n, n_terms)) < rng.choice([0.1, 0.5]))
        items = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(n_terms, min(n_terms, int(rng.integers(1, 9))), replace=False)} for _ in range(6)]
        score = np.array([sum(c * weights[t] * x[:, t] for t, c in i.items()) for i in items])
        length = np.sqrt((x * (x * weights[None].astype(float))).sum(1))
        tenth = np.sort(score, 1)[:, ::-1][:, min(9, n - 1)] * int(rng.integers(0, 2))
        s = R.Searcher(items, weights, tenth, 10)
        order = np.argsort(-length) if trial % 2 else np.arange(n)
        for part in np.array_split(order, 5):
            if len(part):
                sub = x[part]
                s.search(part, (sub > 0).sum(1), np.nonzero(sub)[1], sub[sub > 0], length[part])
        for k in range(6):
            want = sorted(((-v, i) for i, v in enumerate(score[k].tolist()) if v > 0))[:10]
            assert [(-a, int(b)) for a, b in zip(*s.best[k])] == want
