"""Shared pieces of the training-data operators: tables, checkpoints, words and text mapping."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as a Java and DuckDB class.
BLANK = r"[\x20\x09-\x0D]"
#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share; a local session without one (tests) gets its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named
    own = sc._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.mkdtemp(prefix="turnwise-"), "checkpoints"))
        own = sc._jsc.sc().getCheckpointDir()
    return own.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Compressed Parquet tables in the shared folder, which go as soon as they are not needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/turnwise-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes the named tables; all of them, if none is named."""
        for path in [f"{self.folder}/{name}" for name in names] or [self.folder]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, marked for a broadcast if it has been counted to have at most so many rows; else joins shuffle. For tables of a few numbers a row."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def blank_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def positions(n: Column) -> Column:
    """array(0, ..., n - 1), empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; null ids are fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 one)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class BoundedCache(dict):
    """word -> make(word), emptied at limit entries, for words of up to 64 characters or bytes: memory stays bounded for any vocabulary."""

    def __init__(self, make: Callable, limit: int = 250_000):
        self.make, self.limit = make, limit

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows go to Python at once in this session from now on: a text or a set is some KB, and now and then a MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def map_texts(
    docs: DataFrame,
    score: Callable[[list[str | None]], dict[str, list | np.ndarray | pa.Array]],
    fields: list[T.StructField],
    text_col: str = "text",
    keep: list[str] | None = None,
    where: Callable[[dict], np.ndarray] | None = None,
    chars: int = 1 << 20,
) -> DataFrame:
    """Appends columns that score() computes from the texts, over Arrow batches and about chars characters at a time.

    keep: the input columns that stay (all, if None). An input column whose name an appended one has is replaced.
    where: rows to keep, from the appended columns. Sets small_batches for the session.
    """
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    names = {f.name for f in fields}
    kept = [f for f in docs.schema if f.name not in names and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *fields])
    arrow = to_arrow_schema(schema)
    columns = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi in spans(texts, chars):
                part = batch.slice(lo, hi - lo)
                made = score(texts.slice(lo, hi - lo).to_pylist())
                out = pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)).cast(arrow.field(c).type) for c in columns] + [pa.array(made[f.name], arrow.field(f.name).type) for f in fields], schema=arrow
                )
                yield out if where is None else out.filter(pa.array(where(made)))
        pa.default_memory_pool().release_unused()

    source = docs if text_col in columns or keep is None else docs.select(*columns, text_col)
    return source.mapInArrow(run, schema)


def spans(texts: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about chars bytes of text each; a longer text is a range of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > chars:
            yield lo, i
            lo, total = i, 0
        total += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)
