"""Column functions and aggregates on numbers and vectors that never divide by zero."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, with null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def finite_columns(df: DataFrame) -> DataFrame:
    """df with null for NaN in all floating columns: Spark's averages would return NaN, where missing values are meant."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def safe_corr(a: Column, b: Column, least: int = 0) -> Column:
    """Pearson correlation as an aggregate, over rows with both values; null where a side is constant or rows are fewer than least."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    # rounding leaves a tiny spread on constant columns
    level = F.greatest(F.max(F.abs(x)) * F.max(F.abs(y)), F.lit(1e-300))
    return F.when((F.count(x) >= least) & (spread > level * 1e-14), F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def skewness(x: Column) -> Column:
    """Bias-corrected skewness (G1) as an aggregate; null for fewer than three values or no spread."""
    n = F.count(x).cast("double")
    g1 = F.when(F.var_pop(x) > 0, F.skewness(x))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def gini(a: Column, b: Column) -> Column:
    """Gini index of two parties' amounts: |a - b| / (2 (a + b)), 0 if both are 0."""
    return F.coalesce(F.abs(a - b) / F.nullif(2.0 * (a + b), F.lit(0.0)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def unit(v: Column) -> Column:
    """v / |v|; the zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def rms_db(samples: Column) -> Column:
    """20 log10(rms + 1e-6) of an array of samples; null for none."""
    n = F.size(samples)
    mean = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.nullif(n.cast("double"), F.lit(0.0))
    return 20 * F.log10(F.sqrt(mean) + 1e-6)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / np.where(np.abs(c) < tiny, tiny, c)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    from math import lgamma

    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    log_gamma = np.vectorize(lgamma, otypes=[float])
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    out = np.where(low, front * _beta_fraction(a, b, inside) / a, 1 - front * _beta_fraction(b, a, 1 - inside) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def _tail(kind: str):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = t.notna() & df.notna() & (df > 0)
        x = np.where(ok, df / (df + t * t), np.nan)
        return pd.Series(np.where(ok, incomplete_beta(np.where(ok, df / 2, 1.0), 0.5, np.nan_to_num(x)), np.nan)).where(ok.reset_index(drop=True), None)

    @pandas_udf("double")
    def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        ok = f.notna() & d1.notna() & d2.notna() & (d1 > 0) & (d2 > 0)
        x = np.where(ok, d2 / (d2 + d1 * f.clip(lower=0)), 0.0)
        return pd.Series(np.where(ok, incomplete_beta(np.where(ok, d2 / 2, 1.0), np.where(ok, d1 / 2, 1.0), x), np.nan)).where(ok.reset_index(drop=True), None)

    return t_two_sided if kind == "t" else f_upper


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; null for null or no degrees of freedom. Runs in Arrow batches, on result rows only."""
    return _tail("t")(t.cast("double"), df.cast("double"))


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    return _tail("f")(f.cast("double"), d1.cast("double"), d2.cast("double"))
