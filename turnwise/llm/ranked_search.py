"""Ranked lexical search: impact vectors in buckets of decreasing length, pruned by two kinds of bounds, and exact integer scores.

A document's impact of a term is (10^9 tf) div (1000 tf + 8 m), a number below 10^6; an item's weight of a term is its repeats times w. The score is the inner
product of both. Both vectors are scaled by sqrt(w) here, which changes no product and brings the bounds closer to it.

Impact vectors are dealt to ranges by their length, and each task reads its rows in buckets of falling length. An item passes a bucket over if the product of
its length and the bucket's greatest is below its tenth best score so far (Cauchy-Schwarz). Inside a bucket an item's heaviest coordinates are looked at: a document
whose direction has one outside the range that the needed cosine allows can't reach the score, nor can one whose product over these coordinates, with the product of what is left of both
lengths, falls short. The survivors are scored in 64-bit integers. The longest vectors are searched first, and their tenth best scores are the
least that all other tasks start with; a task's own tenth best scores may rise from there. Bounds have a margin for rounding, so nothing is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, cut_lineage, map_texts

#: bytes.translate table: A-Z lower-cased, other ASCII but digits and a-z as blanks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_NO_ID = np.iinfo(np.int64).max
_MARGIN = 1e-9
_CELLS = 4_000_000
HIT = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with a term: all their terms counted, and the vocabulary's numbers with their occurrences."""

    def score(texts):
        out = {"n": [], "terms": [], "tfs": []}
        for text in texts:
            words = terms(text)
            found = Counter(map(vocabulary.get, words))
            found.pop(None, None)
            out["n"].append(len(words))
            out["terms"].append(list(found))
            out["tfs"].append(list(found.values()))
        return out

    numbers = T.ArrayType(T.IntegerType())
    made = [T.StructField("n", T.LongType()), T.StructField("terms", numbers), T.StructField("tfs", numbers)]
    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), score, made, keep=["doc_id"], where=lambda c: np.array(c["n"]) > 0)


def impacts(counted: DataFrame, documents: int, all_terms: int, weights: np.ndarray) -> DataFrame:
    """(doc_id, terms, x, length) of the documents with a term of the vocabulary; x are the terms' impacts, length is that of the scaled vector."""
    root = np.sqrt(weights.astype(float))
    schema = T.StructType([counted.schema["doc_id"], counted.schema["terms"], T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("length", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            m = np.array([25 + 75 * n * documents // all_terms for n in b.column(1).to_pylist()], np.int64)  # Python's integers don't overflow
            tf = b.column(3).flatten().to_numpy().astype(np.int64)
            x = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
            squares = np.zeros(len(tf) + 1)
            squares[1:] = np.cumsum((x * root[lists.flatten().to_numpy()]) ** 2)
            length = np.sqrt(np.maximum(0, np.add.reduceat(np.append(np.diff(squares), 0.0), np.append(0, np.cumsum(sizes))[:-1]) * (sizes > 0)))
            offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())), pa.array(length)], names=schema.names)

    return counted.select("doc_id", "n", "terms", "tfs").filter(F.size("terms") > 0).mapInArrow(run, schema)


class Searcher:
    """Items as sparse vectors, their best documents so far, and the search of one bucket of documents."""

    def __init__(self, items: list[dict[int, int]], weights: np.ndarray, least: np.ndarray, top: int, focus: int = 5):
        self.weights, self.least, self.top = weights, least.astype(np.int64), top
        root = np.sqrt(weights.astype(float))
        self.root = root
        self.items = []
        for counts in items:
            at = np.array(sorted(counts, key=lambda t: (-counts[t] * root[t], t)), np.int64)
            repeats = np.array([counts[t] for t in at.tolist()], np.int64)
            u = repeats * root[at]
            head = u[:focus]
            norm = float(np.sqrt((u * u).sum()))
            self.items.append((at, repeats * weights[at], u[:focus], at[:focus], float(np.sqrt((u[focus:] ** 2).sum())), np.arccos(np.minimum(1.0, head / norm)) if norm else head, norm))
        self.norms = np.array([i[-1] for i in self.items])
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        self.cells: np.ndarray | None = None

    def search(self, ids: np.ndarray, sizes: np.ndarray, term: np.ndarray, x: np.ndarray, length: np.ndarray) -> None:
        """Rows of documents: ids, lengths, and the terms and impacts of one after the other."""
        n = len(ids)
        if self.cells is None or self.cells.shape[1] < n:
            self.cells = np.zeros((len(self.weights), n), np.int64)
        cells, columns = self.cells, np.repeat(np.arange(n), sizes)
        cells[term, columns] = x
        # No document of the bucket can reach more than the longest one's length allows.
        for i in np.flatnonzero(self.norms * length.max() * (1 + _MARGIN) >= self.least):
            if self.norms[i] > 0:
                self._one(i, ids, cells[:, :n], length)
        cells[term, columns] = 0

    def _one(self, i: int, ids: np.ndarray, cells: np.ndarray, length: np.ndarray) -> None:
        at, y, u, heavy, rest, angle, norm = self.items[i]
        least = self.least[i]
        v = cells[heavy] * self.root[heavy, None]
        product = u @ v
        left = np.sqrt(np.maximum(0.0, length * length - (v * v).sum(0)))
        alive = (product + rest * left) * (1 + _MARGIN) >= max(least, 1)
        if least > 0:
            # The needed cosine bounds the angle to the item, and so the angle to each axis.
            needed = np.arccos(min(1.0, least / (norm * length.max() * (1 + _MARGIN))))
            low, high = np.cos(np.minimum(np.pi, angle + needed)), np.cos(np.maximum(0.0, angle - needed))
            direction = v / np.maximum(length, 1e-300)
            alive &= ((direction >= low[:, None] - _MARGIN) & (direction <= high[:, None] + _MARGIN)).all(0)
        alive = np.flatnonzero(alive)
        if not len(alive):
            return
        score = y @ cells[np.ix_(at, alive)]
        good = score >= max(least, 1)
        if not good.any():
            return
        old_score, old_id = self.best[i]
        score, found = np.concatenate([old_score, score[good]]), np.concatenate([old_id, ids[alive[good]]])
        order = np.lexsort((found, -score))[: self.top]
        self.best[i] = score[order], found[order]
        if len(order) == self.top:
            self.least[i] = max(least, score[order[-1]])


def bucket_hits(vectors: DataFrame, items: list[dict[int, int]], weights: np.ndarray, least: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item that reach its least score."""
    rows = max(32, min(1024, _CELLS // max(1, len(weights))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items, weights, least, top)
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                p = b.slice(lo, rows)
                ids = p.column(0).fill_null(_NO_ID).to_numpy()
                sizes = np.diff(p.column(1).offsets.to_numpy())
                searcher.search(ids, sizes, p.column(1).flatten().to_numpy(), p.column(2).flatten().to_numpy(), p.column(3).to_numpy())
        number = np.repeat(np.arange(len(items), dtype=np.int32), [len(s) for s, _ in searcher.best])
        score, found = (np.concatenate([b[k] for b in searcher.best]) if searcher.best else np.zeros(0, np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(found, mask=found == _NO_ID), pa.array(score)], names=HIT.names)

    return vectors.select("doc_id", "terms", "x", "length").mapInArrow(run, HIT)


def best_of(hits: DataFrame, top: int) -> DataFrame:
    """hits with rank, from 1, of each item's top rows: by score, then doc_id, null ids last."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def search_block(docs: DataFrame, items: list[str], top: int, id_col: str, text_col: str, longest_share: float) -> DataFrame:
    """(item, rank, doc_id, score) for the texts of a block of items, which fit in memory; a checkpoint."""
    wanted = [Counter(terms(t)) for t in items]
    vocabulary = {t: k for k, t in enumerate(sorted({t for c in wanted for t in c}))}
    scratch = Scratch(docs.sparkSession)
    counted = scratch.keep("postings", postings(docs, vocabulary, id_col, text_col))
    documents, all_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's vocabulary
        frequency[r["t"]] = r["count"]
    weights = np.array([floor(1000 * log((2 * documents + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)
    vectors = [{vocabulary[t]: n for t, n in c.items()} for c in wanted]
    by_length = impacts(counted, documents, max(1, all_terms), weights).repartitionByRange(F.desc("length"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("length"))
    ranges = scratch.keep("impacts", by_length)
    least = np.zeros(len(items), np.int64)
    cut = ranges.agg(F.percentile_approx("length", 1 - longest_share, 1000)).first()[0]
    found = []
    if cut is not None:
        first = cut_lineage(best_of(bucket_hits(ranges.filter(F.col("length") >= cut), vectors, weights, least, top), top))
        for r in first.filter(F.col("rank") == top).select("item", "score").collect():  # a number for each item of the block
            least[r["item"]] = r["score"]
        found = [first.drop("rank"), bucket_hits(ranges.filter(F.col("length") < cut), vectors, weights, least, top)]
    hits = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], HIT)
    out = cut_lineage(best_of(hits, top))
    scratch.drop()
    return out


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = 512, block_chars: int = 4 << 20, longest_share: float = 0.05
) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of each item with a score above 0, by score, then doc_id.

    Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Items are counted first and searched in blocks of about block_items items and
    block_chars characters, with one pass over the texts for each block. Null and empty texts have no terms: such documents don't count and such items have no rows. Ids of documents are
    cast to long; those with a null id come last among equal scores; repeated rows of documents are documents of their own. Items that repeat an id and text are one; an id with two texts is two items.
    No documents or no items: no rows.
    """
    own = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).filter("text <> ''").distinct()
    n, chars = own.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-chars // block_chars))
    dealt = own.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    if blocks > 1:
        dealt = cut_lineage(dealt)
    out = []
    for k in range(blocks):
        block = dealt.filter(F.col("_block") == k).orderBy("item_id", "text").collect()  # a block of bounded size
        hits = search_block(docs, [r["text"] for r in block], top, id_col, text_col, longest_share)
        names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), own.schema["item_id"]]))
        out.append(hits.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # as many names as a block has items
    return reduce(DataFrame.unionByName, out)


def op12_sql() -> str:
    split = lambda text: rf"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
with d as (select doc_id, w, len(w) n from (select doc_id, {split("text")} w from documents) where len(w) > 0),
tot as (select count(*) n_docs, sum(n)::bigint n_terms from d),
tf as (select doc_id, n, term, count(*) tf from (select doc_id, n, unnest(w) term from d) group by doc_id, n, term),
df as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint w from tf, tot group by term, n_docs),
q as (select item_id, term, count(*) c from (select item_id, unnest({split("text")}) term from benchmark) group by item_id, term),
s as (select item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint score from q join tf using (term) join df using (term), tot group by item_id, doc_id),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10"""
