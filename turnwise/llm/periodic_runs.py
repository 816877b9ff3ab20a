"""Periodic runs of words: descending-LCP Kruskal over suffix classes.

A run is a stretch of consecutive words with smallest period q and at least twice q words that no neighbouring word extends.
The suffixes of a text are sorted by prefix doubling, and neighbours in that order are the edges of a tree, weighted by their longest
common prefix (LCP). Edges are taken by decreasing LCP; a union-find unites the classes of suffixes at their ends, each with its
positions in order. Two positions i < j that become neighbours in such an order while classes unite at LCP l share exactly l words, so with
j - i <= l the words from i to j + l have the period j - i: the pair is a seed. The leftmost seed of each (end, period) is where a run begins.

Why all runs are found, once and with their smallest period: at a run's start s, the suffixes at s and s + q share length - q >= q words. A
position between them in the same class at that time would share as many, and give the run a smaller period. A pair further apart than the smallest
period q has a position i + q between it that shares more words with i, and so was united with it earlier.

Runs shorter than `least` words don't count, so LCPs below least / 2 never matter: such edges are left out, and texts in which no
least / 2 words occur twice are done after one pass of hashes (a collision only means that a text is sorted for nothing).
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blank_words, let, map_texts, mix64

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def doubling_levels(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(suffix array, [(k, rank by the first k keys)]) of int64 keys whose last one, and one between any two texts, occurs once.

    At each level only suffixes that still share their rank are sorted again.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    slots = np.arange(n)
    rank = np.empty(n, np.int32)

    def ranked(sorted_keys, places):
        first = np.ones(len(sorted_keys), bool)
        first[1:] = sorted_keys[1:] != sorted_keys[:-1]
        return first, places[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]

    first, rank[order] = ranked(keys[order], slots)
    levels, k, open_, at = [(1, rank.copy())], 1, order, slots
    suffixes = order.copy()
    while True:
        alone = first & np.append(first[1:], True)
        open_, at = open_[~alone], at[~alone]
        if not len(open_):
            return suffixes, levels
        pair = rank[open_].astype(np.int64) * n + rank[open_ + k]
        again = np.argsort(pair, kind="stable")
        open_ = open_[again]
        first, new = ranked(pair[again], at)
        rank[open_], suffixes[at] = new, open_
        k *= 2
        levels.append((k, rank.copy()))


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """LCP of the suffixes at a and b, from the ranks of all levels."""
    lcp = np.zeros(len(a), np.int64)
    for k, rank in reversed(levels):
        lcp += k * (rank[a + lcp] == rank[b + lcp])
    return lcp


def kruskal_seeds(left: np.ndarray, right: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, distance, LCP) of pairs that become neighbours at a distance of at most the LCP at which their classes unite.

    left, right: the suffixes at the ends of each edge.
    """
    places, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(places)))
    members: list[list[int] | None] = [[p] for p in places.tolist()]
    order = np.argsort(-lcp, kind="stable")
    seeds: list[tuple[int, int, int]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y, shared in zip(ends[: len(left)][order].tolist(), ends[len(left) :][order].tolist(), lcp[order].tolist()):
        x, y = find(x), find(y)
        if len(members[x]) < len(members[y]):
            x, y = y, x
        large, small = members[x], members[y]
        parent[y], members[y] = x, None
        spots = [bisect_left(large, p) for p in small]
        for i, (p, at) in enumerate(zip(small, spots)):
            if at and p - large[at - 1] <= shared and (i == 0 or small[i - 1] < large[at - 1]):
                seeds.append((large[at - 1], p - large[at - 1], shared))
            if at < len(large) and large[at] - p <= shared and (i + 1 == len(small) or small[i + 1] > large[at]):
                seeds.append((p, large[at] - p, shared))
        if len(small) <= 4:
            for p, at in zip(reversed(small), reversed(spots)):
                large.insert(at, p)
        else:
            large += small
            large.sort()
    found = np.array(seeds, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def repeats_within(ids: np.ndarray, text_of: np.ndarray, width: int) -> np.ndarray:
    """Texts (by number) in which the same width ids occur twice, and now and then one in which only their hashes do."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = mix64(text_of[:n].astype(np.uint64))
        for j in range(width):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + ids[j : n + j].astype(np.uint64))
    inside = np.flatnonzero(text_of[:n] == text_of[width - 1 :])
    h, owner = h[inside], text_of[inside]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    return np.unique(owner[order][1:][same])


def word_runs(texts: list[list[bytes]], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each word list, by start and period: at least least words and two periods long."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_of = np.repeat(np.arange(len(texts)), sizes)
    shared = max(1, -(-least // 2))
    some = repeats_within(ids, text_of, shared)
    if not len(some):
        return runs
    # The texts with repeats one after the other, each with a key of its own at its end; words of two texts are never equal.
    starts = np.cumsum(sizes) - sizes
    span = len(known) + 1
    parts, begins, at = [], [], 0
    for number, t in enumerate(some.tolist()):
        parts += [ids[starts[t] : starts[t] + sizes[t]] + number * span, [number * span + span - 1]]
        begins.append(at)
        at += int(sizes[t]) + 1
    suffixes, levels = doubling_levels(np.concatenate(parts).astype(np.int64))
    left, right = suffixes[:-1], suffixes[1:]
    for k, rank in levels:  # edges that may share enough words, before their LCPs are known
        if k <= shared:
            near = rank[left] == rank[right]
    left, right = left[near], right[near]
    lcp = common_prefixes(left, right, levels)
    wide = lcp >= shared
    at, period, lcp = kruskal_seeds(left[wide], right[wide], lcp[wide])
    end = at + period + lcp
    order = np.lexsort((at, period, end))
    at, period, end = at[order], period[order], end[order]
    first = np.ones(len(at), bool)
    first[1:] = (end[1:] != end[:-1]) | (period[1:] != period[:-1])
    ok = first & (end - at >= np.maximum(least, 2 * period))
    at, period, end = at[ok], period[ok], end[ok]
    order = np.lexsort((period, at))
    owner = np.searchsorted(begins, at[order], "right") - 1
    for number, s, e, q in zip(owner.tolist(), at[order].tolist(), end[order].tolist(), period[order].tolist()):
        runs[some[number]].append((s - begins[number], e - s, q))
    return runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(dropped).tolist()) if not d]


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 12, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every row with n_words, runs (array of start, length, period by start and period; words count from 0) and collapsed.

    collapsed: the words joined by blanks, without those that a run contains after its first period. Words are runs without ASCII white space. Null and empty texts have no words and
    no runs. Rows are read one by one: null ids stay, repeated rows get equal results, no rows give none. A text is held as a whole, with some 100 bytes a word.
    """

    def score(texts):
        words = [(t or "").encode().split() for t in texts]
        runs = word_runs(words, least)
        return {
            "n_words": list(map(len, words)),
            "runs": [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs],
            "collapsed": [b" ".join(collapsed(w, own)).decode() for w, own in zip(words, runs)],
        }

    made = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    return map_texts(docs, score, made, text_col, keep=keep)


def with_planted_period(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): texts as they are, but where h = crc32(doc_id as text) ends in 0, with a periodic tail.

    With n words, g = floor(h / 10), a = g mod n and p = 1 + floor((n - a) / (3 + g mod 8)), word i >= a becomes word a + (i - a) mod p. Null ids and texts stay.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = F.when(n > 0, g % n).otherwise(0).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(let(F.array(a, p), lambda s: F.transform(words, lambda w, i: F.when(i < s[0], w).otherwise(F.get(words, s[0] + (i - s[0]) % s[1])))), " ")

    edited = F.when((h % 10 == 0) & F.col(text_col).isNotNull(), let(blank_words(F.col(text_col)), tail)).otherwise(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), edited.alias("text"))


def run_digest(runs: DataFrame) -> DataFrame:
    """periodic_runs' rows as (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256); the four describe the longest run, the first of equals, or are null."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    d = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.p")
    return d.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * b.length div -b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
