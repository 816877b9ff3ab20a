"""Ranks and adjusted p values of whole tables: rows are dealt to ranges of their values, and only one number a range, or a range and group, is carried to the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import _kept


def in_ranges(df: DataFrame, order: list[str], weight: str | None = None) -> DataFrame:
    """df with _part, its range by order, and _before, how many rows (or how much weight) the ranges below hold. Rows equal in order share a range; the ranges are a checkpoint."""
    d = _kept(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    size = F.sum(weight) if weight else F.count("*")
    below = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = d.groupBy("_part").agg(size.alias("_size")).select("_part", F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_before"))
    return d.join(F.broadcast(starts), "_part")


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"_{c}"]) for c in columns], F.lit(True))


def _with_group(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of groups, a row for each value of by (one row, if by is empty)."""
    if not by:
        return df.crossJoin(F.broadcast(groups))  # one row
    g = groups.withColumnsRenamed({c: f"_{c}" for c in by})
    return df.join(g, _same(df, g, by)).drop(*[f"_{c}" for c in by])


def tied_ranks(df: DataFrame, column: str, by: list[str] = (), out: str = "rank") -> DataFrame:
    """df with the column's ranks from 1, ties averaged, in the table or in each group; nulls have none and don't count.

    Values are counted where they are, so a value's repeats are one row: a rank is the number of rows below it plus half of its own, by sums inside a range and one number carried
    between ranges. The ranks go back by a join on the value.
    """
    by = list(by)
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    d = in_ranges(counts, [*by, column], "_n")
    inside = Window.partitionBy("_part").orderBy(*by, column).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_low", F.coalesce(F.sum("_n").over(inside), F.lit(0)) + F.col("_before"))
    d = _with_group(d, d.groupBy(*by).agg(F.min("_low").alias("_first")), by)
    ranks = d.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(column).alias("_value"), (F.col("_low") - F.col("_first") + (F.col("_n") + 1) / 2.0).alias("_rank"))
    return df.join(ranks, _same(df, ranks, by) & (df[column] == ranks["_value"]), "left").select(*[df[c] for c in df.columns if c != out], F.col("_rank").alias(out))


def bh_fdr(df: DataFrame, p: str, by: list[str] = (), out: str = "p_fdr") -> DataFrame:
    """Benjamini-Hochberg adjusted p values, over the table or in each group; null p values stay null and don't count.

    p n / rank is taken inside ranges of p; the least of a range's group and of those above it is what reaches down.
    """
    by = list(by)
    d = in_ranges(df.filter(F.col(p).isNotNull()), [*by, p])
    at = Window.partitionBy("_part").orderBy(*by, p)
    d = d.withColumn("_r", F.row_number().over(at) + F.col("_before"))
    d = _with_group(d, d.groupBy(*by).agg((F.min("_r") - 1).alias("_first"), F.count("*").alias("_n")), by)
    d = d.withColumn("_scaled", F.least(F.lit(1.0), F.col(p) * F.col("_n") / (F.col("_r") - F.col("_first"))))
    down = Window.partitionBy("_part", *by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    heads = d.groupBy(*by, "_part").agg(F.min("_scaled").alias("_least"))
    above = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a group has
    carried = heads.select(*by, "_part", F.min("_least").over(above).alias("_above")).withColumnsRenamed({c: f"_{c}" for c in [*by, "_part"]})
    d = d.withColumn("_own", F.min("_scaled").over(down))
    d = d.join(carried, _same(d, carried, [*by, "_part"]))
    done = d.select(*[F.col(c) for c in df.columns if c != out], F.least("_own", F.coalesce("_above", F.lit(1.0))).alias(out))
    return done.unionByName(df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))
