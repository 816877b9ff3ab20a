"""Models and statistics for each of very many groups, from one aggregation.

A group is never gathered: its rows become sums (of products in the JVM, or of any state in Arrow batches), sums are merged by Spark's own partial and final
aggregation, and only the merged rows, one a group, are solved in stacks of small matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.numeric import finite, t_p_value


def _in_stacks(df: DataFrame, keys: list[str], fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], fields: list[T.StructField]) -> DataFrame:
    """keys and the columns that fn makes of the other ones, given as arrays: numbers as (rows,), arrays of equal length as (rows, length).

    A made column may have more rows, a whole number for each row; keys are repeated then.
    """
    others = [c for c in df.columns if c not in keys]
    schema = T.StructType([*[df.schema[k] for k in keys], *fields])
    arrow = to_arrow_schema(schema)

    def matrix(column: pa.Array) -> np.ndarray:
        if pa.types.is_list(column.type):
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return column.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            made = fn({c: matrix(b.column(b.schema.get_field_index(c))) for c in others})
            times = len(next(iter(made.values()))) // b.num_rows
            at = pa.array(np.repeat(np.arange(b.num_rows), times))
            columns = [b.column(b.schema.get_field_index(k)).take(at).cast(arrow.field(k).type) for k in keys]
            columns += [pa.array(made[f.name], arrow.field(f.name).type, from_pandas=True) for f in fields]  # NaN is null
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def grouped_aggregate(df: DataFrame, keys: list[str], columns: list[str], state: Callable[[np.ndarray], np.ndarray], finish: Callable[[np.ndarray], dict[str, np.ndarray]], fields: dict[str, str], centre: bool = True) -> DataFrame:
    """(keys, fields): an aggregate of a group's rows that is a function of summed states; no group is ever in one batch.

    state: (rows, columns) -> (rows, numbers), what each row adds. Each Arrow batch adds up its rows by group, so a group sends a row for each batch at most, and
    Spark adds these up. finish: (groups, numbers) -> columns. centre: the table's means are taken off first (one row, broadcast), for sums that don't cancel.
    Rows with a null or NaN in columns don't count; a null key is a group; groups without a complete row have no result.
    """
    d = df.select(*keys, *[finite(F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(columns)]).na.drop(subset=[f"_v{i}" for i in range(len(columns))])
    if centre:
        means = d.agg(*[F.avg(f"_v{i}").alias(f"_m{i}") for i in range(len(columns))])  # one row
        d = d.crossJoin(F.broadcast(means)).select(*keys, *[(F.col(f"_v{i}") - F.col(f"_m{i}")).alias(f"_v{i}") for i in range(len(columns))])
    size = state(np.ones((1, len(columns)))).shape[1]
    schema = T.StructType([*[d.schema[k] for k in keys], T.StructField("_state", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.zeros(b.num_rows, np.int64)
            for k in range(len(keys)):
                own = b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                codes = np.unique(codes * (int(own.max()) + 1) + own, return_inverse=True)[1]
            each = state(np.column_stack([b.column(len(keys) + i).to_numpy() for i in range(len(columns))]))
            order = np.argsort(codes, kind="stable")
            first = np.flatnonzero(np.diff(codes[order], prepend=-1))
            sums = np.add.reduceat(each[order], first, axis=0)
            heads = pa.array(order[first])
            offsets = pa.array(np.arange(len(first) + 1) * size, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(heads).cast(arrow.field(k).type) for k in range(len(keys))], pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], schema=arrow)

    merged = d.mapInArrow(partial, schema).groupBy(*keys).agg(F.array(*[F.sum(F.col("_state")[i]) for i in range(size)]).alias("_state"))
    return _in_stacks(merged, keys, lambda c: finish(c["_state"]), T.StructType.fromDDL(", ".join(f"{k} {t}" for k, t in fields.items())).fields)


def product_state(x: np.ndarray) -> np.ndarray:
    """1, the columns and the products of each two: their sums give all means and covariances."""
    k = x.shape[1]
    i, j = np.triu_indices(k)
    return np.column_stack([np.ones(len(x)), x, x[:, i] * x[:, j]])


def moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, means, covariance sums) of product_state's sums: shapes (g,), (g, k), (g, k, k)."""
    k = int((np.sqrt(8 * sums.shape[1] + 1) - 3) / 2)
    n, total = sums[:, 0], sums[:, 1 : k + 1]
    return n, total / n[:, None], _square(sums[:, k + 1 :], k) - total[:, :, None] * total[:, None, :] / n[:, None, None]


def _square(upper: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(upper), k, k))
    i, j = np.triu_indices(k)
    out[:, i, j] = out[:, j, i] = upper
    return out


def partial_correlation_by(df: DataFrame, keys: list[str], x: str, y: str, given: str, least: int = 4) -> DataFrame:
    """(keys, n, r): correlation of x and y in each group with given held fixed; null below least rows or without spread."""

    def finish(sums):
        n, _, c = moments(sums)
        with np.errstate(invalid="ignore", divide="ignore"):
            left = [c[:, a, b] - c[:, a, 2] * c[:, b, 2] / c[:, 2, 2] for a, b in ((0, 1), (0, 0), (1, 1))]
            r = left[0] / np.sqrt(left[1] * left[2])
        flat = (left[1] <= 1e-10 * c[:, 0, 0]) | (left[2] <= 1e-10 * c[:, 1, 1])
        return {"n": n.astype(np.int64), "r": np.where(np.isfinite(r) & ~flat & (n >= least), r, np.nan)}

    return grouped_aggregate(df, keys, [x, y, given], product_state, finish, {"n": "long", "r": "double"})


def grams(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, n, mean, cov) of each group's complete rows: means, and the upper triangle of the sums of centred products, row by row. One aggregation."""
    d = df.select(*by, *[finite(F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(columns)]).na.drop(subset=[f"_v{i}" for i in range(len(columns))])
    k = len(columns)
    cov = [F.covar_pop(f"_v{i}", f"_v{j}") * F.count("*") for i in range(k) for j in range(i, k)]
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(f"_v{i}") for i in range(k)]).alias("mean"), F.array(*cov).alias("cov"))


def solve_stack(n: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> dict[str, np.ndarray]:
    """Ordinary least squares of the last column on the others, a model for each matrix: beta, se and t with the intercept last, df, r2, sse, sst.

    Columns are scaled to correlations and solved by pseudo-inverses, so columns that depend on each other share their part; what can't be estimated is NaN.
    """
    k = cov.shape[1] - 1
    with np.errstate(invalid="ignore", divide="ignore"):
        sxx, sxy, syy = cov[:, :k, :k], cov[:, :k, k], cov[:, k, k]
        scale = np.sqrt(np.maximum(np.einsum("gii->gi", sxx), 0.0))
        unit = np.where(scale > 0, scale, 1.0)
        inv = np.linalg.pinv(sxx / unit[:, :, None] / unit[:, None, :], rcond=1e-10, hermitian=True) / unit[:, :, None] / unit[:, None, :]
        beta = np.einsum("gij,gj->gi", inv, sxy)
        sse = np.maximum(0.0, syy - np.einsum("gi,gi->g", beta, sxy))
        df = n - k - 1
        s2 = np.where(df > 0, sse / df, np.nan)
        at_mean = 1 / n + np.einsum("gi,gij,gj->g", mean[:, :k], inv, mean[:, :k])
        beta = np.column_stack([np.where(scale > 0, beta, np.nan), mean[:, k] - np.einsum("gi,gi->g", beta, mean[:, :k])])
        se = np.sqrt(np.column_stack([np.einsum("gii->gi", inv), at_mean]) * s2[:, None])
        t = np.where(se > 0, beta / se, np.nan)
        return {"beta": beta, "se": se, "t": t, "df": df, "r2": np.where(syy > 0, 1 - sse / syy, np.nan), "sse": sse, "sst": syy}


def ols_by(df: DataFrame, y: str, xs: list[str], by: list[str], least: int = 0) -> DataFrame:
    """(by, term, n, df, estimate, se, t, r2, p): the regression of y on xs in each group with at least least complete rows; a row for each term, 'const' too.

    A column without spread in a group has null estimates there; a group without degrees of freedom has no se, t and p.
    """
    names, k = [*xs, "const"], len(xs) + 1
    g = grams(df, [*xs, y], by).filter(F.col("n") >= least)

    def fit(c):
        m = solve_stack(c["n"].astype(float), c["mean"], _square(c["cov"], k))
        rows = len(c["n"])
        each = lambda v: np.repeat(v, k)
        return {"term": np.tile(np.array(names, object), rows), "n": each(c["n"]), "df": each(m["df"]), "estimate": m["beta"].ravel(), "se": m["se"].ravel(), "t": m["t"].ravel(), "r2": each(m["r2"])}

    kinds = {"term": T.StringType(), "n": T.LongType()}
    out = _in_stacks(g, by, fit, [T.StructField(c, kinds.get(c, T.DoubleType())) for c in ("term", "n", "df", "estimate", "se", "t", "r2")])
    return out.withColumn("p", t_p_value(F.col("t"), F.col("df")))


def sweep(cov: np.ndarray, pivots: list[int]) -> np.ndarray:
    """Stacked matrices with the pivots swept out: what is left of the other rows and columns are residual sums. A pivot without spread is left out."""
    m = cov.copy()
    whole = np.einsum("gii->gi", cov)
    for p in pivots:
        d = m[:, p, p]
        ok = d > 1e-10 * np.maximum(whole[:, p], 1e-300)
        with np.errstate(invalid="ignore", divide="ignore"):
            step = m[:, :, p, None] * m[:, None, p, :] / np.where(ok, d, 1.0)[:, None, None]
        m = m - np.where(ok[:, None, None], step, 0.0)
    return m


def controlled_slopes(long: DataFrame, y: str, x: str, controls: list[str], by: list[str], least: int = 8) -> DataFrame:
    """(by, n, beta, std_beta, r2, t, df, p) of y ~ x + controls in each group, over rows complete in all of them; fewer than least rows: left out.

    One aggregation by group, any number of controls: these are swept out of the group's sums, which leaves x and y residual sums, and the slope is their ratio.
    """
    g = grams(long, [x, y, *controls], by).filter(F.col("n") >= least)
    k = len(controls) + 2

    def fit(c):
        cov = _square(c["cov"], k)
        left = sweep(cov, list(range(2, k)))
        n, sxx, syy = c["n"].astype(float), cov[:, 0, 0], cov[:, 1, 1]
        xx, xy, yy = left[:, 0, 0], left[:, 0, 1], left[:, 1, 1]
        df = n - k
        with np.errstate(invalid="ignore", divide="ignore"):
            beta = np.where(xx > 1e-10 * sxx, xy / xx, np.nan)
            sse = np.maximum(0.0, yy - beta * xy)
            t = np.where((df > 0) & (sse > 0), beta / np.sqrt(sse / df / xx), np.nan)
            return {"n": c["n"], "beta": beta, "std_beta": beta * np.sqrt(sxx / syy), "r2": 1 - sse / syy, "t": t, "df": df}

    kinds = {"n": T.LongType()}
    out = _in_stacks(g, by, fit, [T.StructField(c, kinds.get(c, T.DoubleType())) for c in ("n", "beta", "std_beta", "r2", "t", "df")])
    return out.withColumn("p", t_p_value(F.col("t"), F.col("df")))
