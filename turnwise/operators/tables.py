"""Checks and small table operators: required columns, missing and constant columns, reports, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import skewness


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or an error that names the missing columns; no job."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def numeric_columns(df: DataFrame, exclude: set[str] = frozenset()) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal") and f.name not in exclude]


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def long_form(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """keys, feature, value: a row for each column, nulls included. One pass over df."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]))
    return df.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, n_missing, missing_pct)."""
    return long_form(df, [], columns).groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), (F.avg(F.col("value").isNull().cast("double")) * 100).alias("missing_pct"))


def drop_missing_columns(df: DataFrame, columns: list[str], most: float = 50.0) -> DataFrame:
    """df without the columns of which more than most percent are null. One aggregation of one row."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c] is not None and row[c] * 100 > most])


def constant_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, is_constant): at most one distinct non-null value, found by minimum and maximum."""
    return long_form(df, [], columns).groupBy("feature").agg(F.coalesce(F.min("value") == F.max("value"), F.lit(True)).alias("is_constant"))


def drop_constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c]])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, mean, sd, min, max, missing_pct, skew): sample SD and bias-corrected skewness."""
    v = F.col("value")
    return long_form(df, [], columns).groupBy("feature").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), (F.avg(v.isNull().cast("double")) * 100).alias("missing_pct"), skewness(v).alias("skew")
    )


def monotonic_violations(turns: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(n_sessions, n_violating): sessions in which a value is below its predecessor's."""
    w = Window.partitionBy(*keys).orderBy(*order)
    bad = F.coalesce((F.lag(value).over(w) > F.col(value)).cast("int"), F.lit(0))
    return turns.withColumn("_b", bad).groupBy(*keys).agg(F.max("_b").alias("_b")).agg(F.count("*").alias("n_sessions"), F.sum("_b").alias("n_violating"))


def extremes(df: DataFrame, key: str, value: str, n: int = 3) -> DataFrame:
    """(key, value, end): the n lowest and highest entities, ties by key. Two top-n selections, no full sort."""
    d = df.filter(F.col(value).isNotNull()).select(key, value)
    low = d.orderBy(F.col(value), F.col(key)).limit(n).withColumn("end", F.lit("low"))
    return low.union(d.orderBy(F.col(value).desc(), F.col(key)).limit(n).withColumn("end", F.lit("high")))


def outliers(df: DataFrame, key: str, columns: list[str], limit: float = 2.5) -> DataFrame:
    """(key, feature, z) with |z| over limit, by the population SD of each column."""
    d = long_form(df, [key], columns)
    m = d.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = (F.col("value") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    return d.join(m, "feature").select(key, "feature", z.alias("z")).filter(F.abs("z") > limit)


def with_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with its rows' numbers from 1 by order (unique). Rows are dealt to ranges and numbered inside them; only the ranges' sizes are summed up in one task."""
    from .ranks import in_ranges

    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return in_ranges(df, order).withColumn(name, (inside + F.col("_before")).cast("long")).drop("_part", "_before")


def candidates(report: DataFrame, name: str, p: str, most: float = 0.10, fallback: int = 3, cap: int | None = None) -> DataFrame:
    """Rows with p under most; if there are none, the fallback best. At most cap of them, best first, with their rank."""
    d = report.filter(F.col(p).isNotNull())
    under = d.filter(F.col(p) < most)
    if not under.isEmpty():
        return with_rank(under if cap is None else under.orderBy(p, name).limit(cap), [p, name])
    return with_rank(d.orderBy(p, name).limit(fallback if cap is None else min(cap, fallback)), [p, name])


def pivot_report(report: DataFrame, rows: str, columns: str, value: str, names: list[str]) -> DataFrame:
    """A long report as a matrix; names are given, so no job looks for them."""
    return report.groupBy(rows).agg(*[F.max(F.when(F.col(columns) == n, F.col(value))).alias(n) for n in names])


def median_split(df: DataFrame, key: str, value: str, measures: list[str], inclusive: bool = False) -> DataFrame:
    """(group, measure, n, mean, sem) above and below the exact median; a value equal to it is high if inclusive."""
    m = F.broadcast(df.agg(F.median(value).alias("_median")))  # one row
    d = df.filter(F.col(value).isNotNull()).crossJoin(m)
    high = F.col(value) >= F.col("_median") if inclusive else F.col(value) > F.col("_median")
    d = long_form(d.withColumn("group", F.when(high, "high").otherwise("low")), ["group"], measures, "measure")
    return d.groupBy("group", "measure").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"))


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """(truth, guess, n, accuracy): counts of two flags and the share of equal ones."""
    d = df.select(truth.alias("truth"), guess.alias("guess")).filter("truth is not null and guess is not null")
    n = d.groupBy("truth", "guess").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0))
    return n.withColumn("accuracy", F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).over(whole) / F.sum("n").over(whole))


def cronbach_alpha(df: DataFrame, items: list[str]) -> DataFrame:
    """(k, n, alpha) of complete rows, from one pass of variances; null for fewer than two items or no spread."""
    k = len(items)
    total = reduce(lambda a, b: a + b, [F.col(c) for c in items])
    parts = reduce(lambda a, b: a + b, [F.var_samp(c) for c in items])
    d = df.na.drop(subset=items)
    alpha = (k / (k - 1)) * (1 - parts / F.nullif(F.var_samp(total), F.lit(0.0))) if k > 1 else F.lit(None).cast("double")
    return d.agg(F.lit(k).alias("k"), F.count("*").alias("n"), alpha.alias("alpha"))


def first_sessions(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of the first n sessions in key order."""
    return df.join(df.select(*keys).distinct().orderBy(*keys).limit(n), keys, "left_semi")


def new_sessions(found: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose whole session key isn't in done."""
    return found.join(done.select(*keys).distinct(), keys, "left_anti")


def with_cache(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    return cached.unionByName(fresh, allowMissingColumns=True)
