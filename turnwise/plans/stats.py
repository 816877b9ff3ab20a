"""Statistics as Spark jobs: sums of products are aggregated in one pass, and only k x k algebra is left to the driver.

Screens of many features are one aggregation by feature with closed-form solutions in columns, not a model each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import f_p_value, finite_columns, incomplete_beta, ratio, safe_corr, t_p_value
from ..operators.ranges import _kept
from ..operators.ranks import bh_fdr, tied_ranks
from ..operators.sequence import zscore
from ..operators.tables import describe, long_form
from .grouped import controlled_slopes


@dataclass
class Gram:
    """n and the sums of products of complete rows, of [1, *columns], centred columns for stable algebra."""

    columns: list[str]
    n: int
    mean: np.ndarray
    cov: np.ndarray  # sums of centred products

    def pick(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        i = [self.columns.index(c) for c in names]
        return self.mean[i], self.cov[np.ix_(i, i)]


def gram(df: DataFrame, columns: list[str]) -> Gram:
    """One aggregation over rows with all columns: k (k + 3) / 2 + 1 sums come to the driver."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = d.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.covar_pop(a, b) for a, b in pairs]).first()
    n, k = row[0], len(columns)
    cov = np.zeros((k, k))
    for (a, b), v in zip(pairs, row[1 + k :]):
        i, j = columns.index(a), columns.index(b)
        cov[i, j] = cov[j, i] = (v or 0.0) * n
    return Gram(columns, n, np.array([x or 0.0 for x in row[1 : 1 + k]]), cov)


def gram_sets(df: DataFrame, sets: list[list[str]]) -> list[Gram]:
    """A Gram for each set of columns, over the rows complete in it; one aggregation for all."""
    cells, shapes = [], []
    for columns in sets:
        ok = F.lit(True)
        for c in columns:
            ok = ok & F.col(c).isNotNull()
        v = [F.when(ok, F.col(c).cast("double")) for c in columns]
        pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
        cells += [F.count_if(ok), *[F.avg(x) for x in v], *[F.covar_pop(v[i], v[j]) for i, j in pairs]]
        shapes.append((columns, pairs))
    row, out, at = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first(), [], 0
    for columns, pairs in shapes:
        n, k = row[at], len(columns)
        cov = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[at + 1 + k :]):
            cov[i, j] = cov[j, i] = (v or 0.0) * n
        out.append(Gram(columns, n, np.array([x or 0.0 for x in row[at + 1 : at + 1 + k]]), cov))
        at += 1 + k + len(pairs)
    return out


def _fit(g: Gram, y: str, xs: list[str]) -> dict:
    mean, c = g.pick([*xs, y])
    k, n = len(xs), g.n
    sxx, sxy, syy = c[:k, :k], c[:k, k], c[k, k]
    beta = np.linalg.lstsq(sxx, sxy, rcond=None)[0] if k else np.zeros(0)
    sse = max(0.0, float(syy - beta @ sxy))
    df = n - k - 1
    r2 = 1 - sse / syy if syy > 0 else float("nan")
    s2 = sse / df if df > 0 else float("nan")
    inv = np.linalg.pinv(sxx) if k else np.zeros((0, 0))
    se = np.sqrt(np.maximum(0, np.append(np.diag(inv), 1 / max(n, 1) + mean[:k] @ inv @ mean[:k])) * s2)
    return {"n": n, "k": k, "df": df, "beta": beta, "intercept": float(mean[k] - beta @ mean[:k]), "se": se, "sse": sse, "sst": float(syy), "r2": r2, "inv": inv, "mean": mean[:k]}


def _none(x):
    return None if x is None or not np.isfinite(x) else float(x)


def ols(df: DataFrame, y: str, xs: list[str], g: Gram | None = None) -> tuple[DataFrame, DataFrame]:
    """(coefficients, fit): estimate, se, t, p, 95 % interval of each term; n, R2, adjusted R2, F, its p, AIC, BIC."""
    spark = df.sparkSession
    m = _fit(g or gram(df, [*xs, y]), y, xs)
    crit = _t_quantile(spark, 0.975, m["df"])
    rows = []
    for i, (name, b) in enumerate([*zip(xs, m["beta"]), ("const", m["intercept"])]):
        se = _none(m["se"][i])
        t = None if not se else float(b) / se
        rows.append((name, float(b), se, t, None if se is None or crit is None else float(b) - crit * se, None if se is None or crit is None else float(b) + crit * se, float(m["df"])))
    coef = spark.createDataFrame(rows, "term string, estimate double, se double, t double, lower double, upper double, df double")
    n, k, df_ = m["n"], m["k"], m["df"]
    f = m["r2"] / k / ((1 - m["r2"]) / df_) if k and df_ > 0 and m["r2"] < 1 else None
    ll = -n / 2 * (np.log(2 * np.pi) + np.log(m["sse"] / n) + 1) if n and m["sse"] > 0 else None
    adj = 1 - (1 - m["r2"]) * (n - 1) / df_ if df_ > 0 else None
    fit = spark.createDataFrame([(n, k, _none(m["r2"]), _none(adj), _none(f), float(df_), _none(None if ll is None else 2 * (k + 1) - 2 * ll), _none(None if ll is None else np.log(n) * (k + 1) - 2 * ll))], "n long, k int, r2 double, adj_r2 double, f double, df double, aic double, bic double")
    return coef.withColumn("p", t_p_value(F.col("t"), F.col("df"))), fit.withColumn("f_p", f_p_value(F.col("f"), F.col("k"), F.col("df")))


def _t_quantile(spark: SparkSession, q: float, df: int) -> float | None:
    if df <= 0:
        return None
    return float(spark._jvm.org.apache.commons.math3.distribution.TDistribution(None, float(df)).inverseCumulativeProbability(q))


def slope_columns(y: Column, x: Column, control: Column | None = None) -> dict[str, Column]:
    """Aggregates n, beta, r2, t (and df) of y ~ x (+ control), over complete rows, in closed form."""
    every = [y, x] + ([control] if control is not None else [])
    ok = every[0].isNotNull()
    for c in every[1:]:
        ok = ok & c.isNotNull()
    v = [F.when(ok, c.cast("double")) for c in every]
    n = F.count(v[0]).cast("double")
    syy, sxx, sxy = F.var_pop(v[0]) * n, F.var_pop(v[1]) * n, F.covar_pop(v[0], v[1]) * n
    if control is None:
        beta, df = ratio(sxy, sxx), n - 2
        explained = beta * sxy
        left = sxx
    else:
        scc, sxc, syc = F.var_pop(v[2]) * n, F.covar_pop(v[1], v[2]) * n, F.covar_pop(v[0], v[2]) * n
        left = sxx - F.coalesce(ratio(sxc * sxc, scc), F.lit(0.0))
        beta = ratio(sxy - F.coalesce(ratio(sxc * syc, scc), F.lit(0.0)), F.when(left > sxx * 1e-10, left))
        gamma = F.coalesce(ratio(syc - beta * sxc, scc), F.lit(0.0))
        explained, df = beta * sxy + gamma * syc, n - 3
    sse = F.greatest(syy - explained, F.lit(0.0))
    se = F.sqrt(ratio(ratio(sse, F.when(df > 0, df)), left))
    return {"n": n.cast("long"), "beta": beta, "std_beta": beta * F.sqrt(ratio(sxx, syy)), "r2": 1 - ratio(sse, syy), "t": ratio(beta, se), "df": df}


def _named(controls: str | list[str] | None) -> list[str]:
    return [controls] if isinstance(controls, str) else list(controls or [])


def _slopes(long: DataFrame, y: str, controls: list[str], by: list[str], least: int) -> DataFrame:
    """(by, n, beta, std_beta, r2, t, df, p) of y ~ value + controls in each group: in columns with one control at most, else by sweeping the controls out of each group's sums."""
    if len(controls) > 1:
        return controlled_slopes(long, y, "value", controls, by, least)
    own = slope_columns(F.col(y), F.col("value"), F.col(controls[0]) if controls else None)
    out = long.groupBy(*by).agg(*[c.alias(k) for k, c in own.items()]).filter(F.col("n") >= least)
    return out.withColumn("p", t_p_value(F.col("t"), F.col("df")))


def screen(df: DataFrame, y: str, features: list[str], controls: str | list[str] | None = None, least: int = 8) -> DataFrame:
    """(feature, n, beta, std_beta, r2, t, df, p): one regression for each feature with any number of controls, from one aggregation. Fewer than least rows: left out."""
    names, df = _named(controls), finite_columns(df)
    return _slopes(long_form(df.filter(F.col(y).isNotNull()), [y, *names], features), y, names, ["feature"], least)


def feature_outcome_grid(df: DataFrame, features: list[str], outcomes: list[str], controls: str | list[str] | None = None, least: int = 8, standardise: bool = True, fdr: bool = True) -> DataFrame:
    """(feature, outcome, n, beta, r2, t, df, p, p_fdr): all features by all outcomes, z-scored (ddof 1), with any number of controls; one aggregation."""
    names, df = _named(controls), finite_columns(df)
    d = zscore(df, [*features, *outcomes], [], 1) if standardise else df
    long = long_form(long_form(d, [*features, *names], outcomes, "outcome", "y"), ["outcome", "y", *names], features)
    out = _slopes(long, "y", names, ["feature", "outcome"], least).drop("std_beta")
    return bh_fdr(out, "p") if fdr else out


def corr_grid(df: DataFrame, xs: list[str], ys: list[str], method: str = "pearson", least: int = 3) -> DataFrame:
    """(x, y, n, r, t, df): pairwise-complete correlations; ranks are taken over each pair's complete rows."""
    long = long_form(long_form(df, xs, ys, "y", "vy"), ["y", "vy"], xs, "x", "vx").filter("vx is not null and vy is not null")
    if method == "spearman":
        for v in ("vx", "vy"):
            long = tied_ranks(_kept(long), v, ["x", "y"], f"_{v}")
        long = long.select("x", "y", F.col("_vx").alias("vx"), F.col("_vy").alias("vy"))
    out = long.groupBy("x", "y").agg(F.count("*").alias("n"), safe_corr(F.col("vx"), F.col("vy"), least).alias("r"))
    return with_corr_t(out)


def with_corr_t(d: DataFrame) -> DataFrame:
    df = (F.col("n") - 2).cast("double")
    return d.withColumns({"df": df, "t": ratio(F.col("r") * F.sqrt(F.greatest(df, F.lit(0.0))), F.sqrt(F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0))))})


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    return corr_grid(df, columns, columns).select("x", "y", "n", "r")


def pearson_test(df: DataFrame, x: str, y: str) -> DataFrame:
    out = with_corr_t(df.agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), safe_corr(F.col(x), F.col(y), 3).alias("r")))
    return out.withColumn("p", t_p_value(F.col("t"), F.col("df")))


def group_compare(df: DataFrame, variables: list[str], group: str, pooled: bool = False) -> DataFrame:
    """(variable, n1, n0, mean1, mean0, diff, cohen_d, t, df): group is a flag. Welch's t, or Student's with pooled."""
    d = long_form(df.withColumn(group, F.col(group).cast("int")), [group], variables, "variable").filter(F.col("value").isNotNull() & F.col(group).isNotNull())
    v = {g: F.when(F.col(group) == g, F.col("value")) for g in (0, 1)}
    s = d.groupBy("variable").agg(*[x for g in (1, 0) for x in (F.count(v[g]).alias(f"n{g}"), F.avg(v[g]).alias(f"mean{g}"), F.var_samp(v[g]).alias(f"_v{g}"))])
    n1, n0, v1, v0 = (F.col(c).cast("double") for c in ("n1", "n0", "_v1", "_v0"))
    common = ratio((n1 - 1) * v1 + (n0 - 1) * v0, n1 + n0 - 2)
    diff = F.col("mean1") - F.col("mean0")
    if pooled:
        t, df_ = ratio(diff, F.sqrt(common * (1 / n1 + 1 / n0))), n1 + n0 - 2
    else:
        a, b = ratio(v1, n1), ratio(v0, n0)
        t, df_ = ratio(diff, F.sqrt(a + b)), ratio((a + b) * (a + b), ratio(a * a, n1 - 1) + ratio(b * b, n0 - 1))
    return s.select("variable", "n1", "n0", "mean1", "mean0", diff.alias("diff"), ratio(diff, F.sqrt(common)).alias("cohen_d"), t.alias("t"), df_.alias("df"))


def standardise(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Population z scores; a constant column is divided by 1."""
    one = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    d = df.crossJoin(F.broadcast(one))  # one row
    return d.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}).drop(*[x for c in columns for x in (f"_m_{c}", f"_s_{c}")])


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null values become the column's mean; columns without any value are dropped."""
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c] is None]).na.fill({c: float(row[c]) for c in columns if row[c] is not None})


def pca_composite(df: DataFrame, columns: list[str], out: str = "composite", sign: str = "largest", reference: str | None = None) -> tuple[DataFrame, dict]:
    """(df with the first principal component's scores of the standardised columns, info): null for incomplete rows.

    sign: 'largest' makes the largest loading positive, 'mean' the sum of loadings, 'reference' that of a named column, 'none' leaves it.
    """
    g = gram(df, columns)
    sd = np.sqrt(np.diag(g.cov) / max(g.n, 1))
    scale = np.where(sd > 0, sd, 1.0)
    corr = g.cov / max(g.n, 1) / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(corr)
    load = vectors[:, -1]
    flip = {"largest": load[np.argmax(np.abs(load))], "mean": load.sum(), "reference": load[columns.index(reference)] if reference else 1.0, "none": 1.0}[sign]
    load = load if flip >= 0 else -load
    score = sum(((F.col(c) - float(m)) / float(s) * float(w) for c, m, s, w in zip(columns, g.mean, scale, load)), F.lit(0.0))
    return df.withColumn(out, score), {"loadings": dict(zip(columns, map(float, load))), "explained": float(values[-1] / max(values.sum(), 1e-300)), "n": g.n}


def equal_weight(df: DataFrame, columns: list[str], out: str = "composite") -> DataFrame:
    z = standardise(df, columns, "_ew")
    return z.withColumn(out, sum((F.col(f"{c}_ew") for c in columns), F.lit(0.0)) / len(columns)).drop(*[f"{c}_ew" for c in columns])


def loo(df: DataFrame, y: str, xs: list[str], key: str, g: Gram | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with the leave-one-out prediction, metrics r2 and rmse): residual / (1 - leverage) equals a refit without the row."""
    d = df.na.drop(subset=[y, *xs])
    m = _fit(g or gram(df, [*xs, y]), y, xs)
    fitted = sum((F.col(c) * float(b) for c, b in zip(xs, m["beta"])), F.lit(float(m["intercept"])))
    centred = [F.col(c) - float(v) for c, v in zip(xs, m["mean"])]
    lever = F.lit(1.0 / max(m["n"], 1))
    for i in range(len(xs)):
        for j in range(len(xs)):
            lever = lever + centred[i] * centred[j] * float(m["inv"][i, j])
    pred = F.col(y) - (F.col(y) - fitted) / F.nullif(1 - lever, F.lit(0.0))
    rows = d.select(key, F.col(y).cast("double").alias("actual"), pred.alias("predicted"))
    err = F.pow(F.col("actual") - F.col("predicted"), 2)
    metrics = rows.agg(F.count("predicted").alias("n"), (1 - ratio(F.sum(err), F.var_pop("actual") * F.count("actual"))).alias("r2_loo"), F.sqrt(F.avg(err)).alias("rmse"))
    return rows, metrics


def hierarchical(df: DataFrame, y: str, base: list[str], added: list[str]) -> DataFrame:
    """(n, r2_base, r2_full, delta_r2, loo_r2_base, loo_r2_full, f_change, df1, df2, p): nested models on the same rows, from one set of sums."""
    d = df.na.drop(subset=[y, *base, *added])
    g = gram(d, [*base, *added, y])
    a, b = _fit(g, y, base), _fit(g, y, [*base, *added])
    q, df2 = len(added), b["df"]
    f = (a["sse"] - b["sse"]) / q / (b["sse"] / df2) if q and df2 > 0 and b["sse"] > 0 else None
    cv = [loo(d, y, xs, y, g)[1].first()["r2_loo"] for xs in (base, [*base, *added])]
    row = (g.n, _none(a["r2"]), _none(b["r2"]), _none(b["r2"] - a["r2"]), cv[0], cv[1], _none(f), float(q), float(df2))
    return df.sparkSession.createDataFrame([row], "n long, r2_base double, r2_full double, delta_r2 double, loo_r2_base double, loo_r2_full double, f_change double, df1 double, df2 double").withColumn("p", f_p_value(F.col("f_change"), F.col("df1"), F.col("df2")))


def residuals(df: DataFrame, column: str, covars: list[str], out: str, g: Gram | None = None) -> DataFrame:
    m = _fit(g or gram(df, [*covars, column]), column, covars)
    return df.withColumn(out, F.col(column) - sum((F.col(c) * float(b) for c, b in zip(covars, m["beta"])), F.lit(float(m["intercept"]))))


def partial_corr(df: DataFrame, x: str, y: str, covars: list[str], method: str = "pearson") -> DataFrame:
    """(n, r, t, df, p) of the residuals of x and y given covars; ranks first for 'spearman'."""
    d = df.na.drop(subset=[x, y, *covars])
    if method == "spearman":
        d = _kept(d.select(x, y, *covars))
        for c in (x, y, *covars):  # what is ranked is read twice, so it is made once
            d = _kept(tied_ranks(d, c, out=f"_rank_{c}"))
        d = d.select(*[F.col(f"_rank_{c}").alias(c) for c in (x, y, *covars)])
    g = gram(d, [x, y, *covars])
    d = residuals(residuals(d, x, covars, "_rx", g), y, covars, "_ry", g)
    out = d.agg(F.count("*").alias("n"), safe_corr(F.col("_rx"), F.col("_ry"), 3).alias("r"))
    df_ = (F.col("n") - 2 - len(covars)).cast("double")
    out = out.withColumns({"df": df_, "t": ratio(F.col("r") * F.sqrt(F.greatest(df_, F.lit(0.0))), F.sqrt(F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0))))})
    return out.withColumn("p", t_p_value(F.col("t"), F.col("df")))


def commonality(df: DataFrame, y: str, first: list[str], second: list[str], controls: list[str] = ()) -> DataFrame:
    """(n, unique_first, unique_second, shared, total) R2 over the controls."""
    every = [*controls, *first, *second]
    g = gram(df, [*every, y])
    c, a, b, full = (_fit(g, y, xs)["r2"] for xs in ([*controls], [*controls, *first], [*controls, *second], every))
    c = c if controls else 0.0
    return df.sparkSession.createDataFrame([(g.n, *map(float, (full - b, full - a, a + b - full - c, full - c)))], "n long, unique_first double, unique_second double, shared double, total double")


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, vif): the diagonal of the inverse correlation matrix; infinite where columns depend on each other."""
    g = gram(df, columns)
    sd = np.sqrt(np.diag(g.cov))
    corr = g.cov / np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), 1)
    singular = np.linalg.matrix_rank(corr, tol=1e-10) < len(columns)
    out = [float("inf")] * len(columns) if singular else np.diag(np.linalg.inv(corr)).tolist()
    return df.sparkSession.createDataFrame(list(zip(columns, map(float, out))), "feature string, vif double")


def select_features(df: DataFrame, report: DataFrame, p_max: float = 0.10, r_max: float = 0.70, cap: int = 4, manual: list[str] | None = None) -> list[str]:
    """Features of a screen report: those under p_max (or the best three), without the worse of pairs correlated above r_max, at most cap."""
    if manual is not None:
        return [c for c in manual if c in df.columns]
    ranked = [(r["feature"], r["p"]) for r in report.filter("p is not null").orderBy("p", "feature").collect()]  # a row a feature
    chosen = [f for f, p in ranked if p < p_max] or [f for f, _ in ranked[:3]]
    if len(chosen) > 1:
        r = {(x["x"], x["y"]): abs(x["r"] or 0.0) for x in corr_matrix(df, chosen).collect()}
        kept: list[str] = []
        for f in chosen:
            if all(r[(f, k)] <= r_max for k in kept):
                kept.append(f)
        chosen = kept
    return chosen[:cap]


def student_p(t: float, df: float) -> float:
    """Two-sided p value of Student's t, by the continued fraction of the incomplete beta function."""
    from math import exp, lgamma, log

    x, a, b = df / (df + t * t), df / 2, 0.5
    if not 0 < x < 1:
        return 1.0 if x >= 1 else 0.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d)
            c = 1 + top / c
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    value = front * total
    return 1 - value if flip else value


def nested_loo(df: DataFrame, y: str, features: list[str], key: str, p_max: float = 0.10, cap: int = 4, controls: list[str] = (), r_max: float = 0.70, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """(predictions, selection frequency): in each fold features are screened and chosen, and one model of them all is fitted, without the fold's row.

    A fold screens each feature (with the controls, over rows complete in them, at least least), takes those of p under p_max or else the best three, drops the
    worse of pairs correlated above r_max and keeps at most cap; the model holds the chosen features alone. Its sums are the totals
    less its row's part. Totals are kept by which columns a row lacks (one aggregation; as many as there are such patterns), so missing values
    count as in a refit. A fold whose row lacks a chosen feature has a null prediction; rows without y are no folds.
    """
    columns = [*features, *controls]
    d = df.filter(F.col(y).isNotNull()).select(key, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate([*columns, y])])
    names = [f"v{i}" for i in range(len(columns) + 1)]
    mean = [m or 0.0 for m in d.agg(*[F.avg(c) for c in names]).first()]  # centred values add up without cancelling
    mask = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(names[:-1])), F.lit(0)).cast("long")
    d = d.select(key, mask.alias("mask"), *[F.coalesce(F.col(c) - float(m), F.lit(0.0)).alias(c) for c, m in zip(names, mean)])
    z = [F.lit(1.0), *map(F.col, names)]
    cells = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    patterns = []
    for row in d.groupBy("mask").agg(*[F.sum(z[i] * z[j]) for i, j in cells]).collect():  # a row for each pattern of missing columns
        m = np.zeros((len(z), len(z)))
        for (i, j), v in zip(cells, row[1:]):
            m[i, j] = m[j, i] = v
        patterns.append((row[0], m))
    last, bits = len(z) - 1, {i: 1 << i for i in range(len(columns))}
    control = list(range(len(features), len(columns)))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        totals: dict[int, np.ndarray] = {}

        def sums(use: list[int], own: np.ndarray, v: np.ndarray) -> np.ndarray:
            """The sums of rows complete in these columns, without each fold's row: a matrix for each row of the batch."""
            need = sum(bits[i] for i in use)
            if need not in totals:
                totals[need] = sum((m for have, m in patterns if have & need == need), np.zeros((last + 1, last + 1)))
            at = [0, *[i + 1 for i in use], last]
            x = np.where((own & need == need)[:, None], v[:, at], 0.0)
            return totals[need][np.ix_(at, at)] - x[:, :, None] * x[:, None, :]

        def screened(own: np.ndarray, v: np.ndarray) -> np.ndarray:
            """(folds, features) p values, NaN where a feature can't be screened."""
            p = np.full((len(v), len(features)), np.nan)
            for f in range(len(features)):
                m = sums([f, *control], own, v)
                n, k = m[:, 0, 0], m.shape[1] - 1
                inverse = np.linalg.pinv(m[:, :k, :k], hermitian=True)
                beta = np.einsum("bij,bj->bi", inverse, m[:, :k, k])
                with np.errstate(invalid="ignore", divide="ignore"):
                    spread = np.maximum(0.0, m[:, k, k] - np.einsum("bi,bi->b", beta, m[:, :k, k])) / (n - k) * inverse[:, 1, 1]
                    t = beta[:, 1] / np.sqrt(spread)
                ok = (n >= least) & (n > k) & (spread > 0)
                df = np.where(ok, n - k, 1.0)
                p[ok, f] = incomplete_beta(df / 2, 0.5, df / (df + np.where(ok, t, 0.0) ** 2))[ok]
            return p

        def folds(own: np.ndarray, v: np.ndarray) -> tuple[list[float | None], list[tuple[int, ...]]]:
            p, close = screened(own, v), {}

            def correlated(row: int, f: int, g: int) -> bool:
                if (f, g) not in close:
                    m = sums([f, g], own, v)
                    c = m[:, 1:3, 1:3] - m[:, 0, 1:3, None] * m[:, 0, None, 1:3] / np.maximum(m[:, 0, 0], 1)[:, None, None]
                    both = (c[:, 0, 0] > 0) & (c[:, 1, 1] > 0)
                    close[f, g] = both & (np.abs(c[:, 0, 1]) > r_max * np.sqrt(np.where(both, c[:, 0, 0] * c[:, 1, 1], 1.0)))
                return bool(close[f, g][row])

            chosen: list[tuple[int, ...]] = []
            for row, q in enumerate(p):
                ranked = sorted((f for f in range(len(features)) if q[f] == q[f]), key=lambda f: (q[f], features[f]))
                best = [f for f in ranked if q[f] < p_max] or ranked[:3]
                dropped: set[int] = set()
                for i, f in enumerate(best):
                    for g in best[i + 1 :]:
                        if f not in dropped and g not in dropped and correlated(row, f, g):
                            dropped.add(g if q[g] > q[f] else f)
                chosen.append(tuple(f for f in best if f not in dropped)[:cap])
            predicted: list[float | None] = [None] * len(v)
            same: dict[tuple[int, ...], list[int]] = {}
            for row, c in enumerate(chosen):
                same.setdefault(c, []).append(row)
            for c, rows in same.items():  # folds with one choice are solved together
                m = sums(list(c), own[rows], v[rows])
                k = m.shape[1] - 1
                beta = np.einsum("bij,bj->bi", np.linalg.pinv(m[:, :k, :k], hermitian=True), m[:, :k, k])
                fitted = np.einsum("bi,bi->b", beta, v[rows][:, [0, *[f + 1 for f in c]]]) + mean[-1]
                need = sum(bits[f] for f in c)
                for row, y, n in zip(rows, fitted.tolist(), m[:, 0, 0].tolist()):
                    if n >= len(c) + 2 and own[row] & need == need:
                        predicted[row] = y
            return predicted, chosen

        for b in batches:
            if not len(b):
                continue
            values = np.column_stack([np.ones(len(b)), b[names].to_numpy(float)])
            predicted, chosen = folds(b["mask"].to_numpy(np.int64), values)
            out = pd.DataFrame({key: b[key], "actual": values[:, last] + mean[-1]})
            out["predicted"] = pd.Series(predicted, out.index, dtype=object)
            out["chosen"] = [[features[f] for f in c] for c in chosen]
            yield out

    schema = T.StructType([d.schema[key], T.StructField("actual", T.DoubleType()), T.StructField("predicted", T.DoubleType()), T.StructField("chosen", T.ArrayType(T.StringType()))])
    # Folds are dealt out evenly: the table is small, and left as it came one task would solve them all.
    folds = d.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key).mapInPandas(run, schema)
    predictions = folds.select(key, "actual", "predicted", F.size("chosen").alias("n_features"))
    return predictions, folds.select(F.explode("chosen").alias("feature")).groupBy("feature").agg(F.count("*").alias("n_folds"))


def sensitivity(df: DataFrame, features: list[str], outcome: str, alpha: float = 0.10) -> DataFrame:
    """(feature, r_pearson, r_spearman, p_pearson, p_spearman, consistent): same sign and same side of alpha."""
    p = F.when(F.abs("r") > 1 - 1e-12, F.when(F.col("df") > 0, 0.0)).otherwise(t_p_value(F.col("t"), F.col("df")))
    a = corr_grid(df, features, [outcome]).select(F.col("x").alias("feature"), F.col("r").alias("r_pearson"), p.alias("p_pearson"))
    b = corr_grid(df, features, [outcome], "spearman").select(F.col("x").alias("feature"), F.col("r").alias("r_spearman"), p.alias("p_spearman"))
    same = (F.signum("r_pearson") == F.signum("r_spearman")) & ((F.col("p_pearson") < alpha) == (F.col("p_spearman") < alpha))
    return a.join(b, "feature").withColumn("consistent", same)


def descriptive_table(df: DataFrame, features: list[str], outcome: str) -> DataFrame:
    r = corr_grid(df, features, [outcome]).select(F.col("x").alias("feature"), "r", "t", "df")
    return describe(df, features).join(r, "feature", "left")


def confound_checks(df: DataFrame, y: str, predictors: list[str], group: str, gap: str) -> DataFrame:
    """(predictor, model, beta, p): standardised, alone, with the group, and with the group and the gap."""
    from functools import reduce

    z = standardise(df, sorted({y, *predictors, gap, group}), "")
    parts = []
    for p in predictors:
        g = gram(z, [p, group, gap, y])  # one pass for the three models, over the same rows
        for name, xs in (("alone", [p]), ("group", [p, group]), ("group+gap", [p, group, gap])):
            parts.append(ols(z, y, xs, g)[0].filter(F.col("term") == p).select(F.lit(p).alias("predictor"), F.lit(name).alias("model"), F.col("estimate").alias("beta"), "p"))
    return reduce(DataFrame.union, parts)
