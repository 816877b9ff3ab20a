"""Resampling as Spark jobs: permutations, bootstraps, surrogate pairs, and the incremental-validity plan built on them.

Randomness is a hash of (seed, resample, row), never a generator's state, so results don't depend on partitions or retries.
Work grows as rows x resamples and is spread by resample id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import f_p_value, finite_columns, safe_corr, t_p_value
from ..operators.ranges import _kept
from ..operators.ranks import bh_fdr
from ..operators.sequence import switch_pairs
from ..operators.tables import with_rank
from .grouped import _in_stacks
from .stats import Gram, _fit, _none, equal_weight, gram_sets, pca_composite, standardise


def _resamples(df: DataFrame, n: int, name: str = "b") -> DataFrame:
    """Each row n times, with the resample's number; made where the rows are, without a shuffle."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _uniform(seed: int, *columns: str):
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


_PRIME = (1 << 31) - 1


def _lane(v, a, c, fold):
    """A multiplicative mixer below 2^62, the same on columns and on int64 arrays."""
    v = fold(v * a % _PRIME, 15)
    v = fold(v * c % _PRIME, 13)
    return v * a % _PRIME


def _row_lanes(seed: int, key: str):
    h = F.xxhash64(F.lit(seed), key)
    return F.pmod(h, F.lit(_PRIME)).alias("_x"), F.pmod(F.shiftright(h, 31), F.lit(_PRIME)).alias("_y")


def _resample_lanes(seed: int, b: str):
    return [(F.pmod(F.xxhash64(F.lit(seed), F.lit(lane), F.col(b).cast("long")), F.lit(_PRIME - 1)) + 1).alias(f"_{lane}") for lane in "ac"]


def _order_columns():
    """What a resample orders its rows by: columns of _x, _y and _a, _c."""
    fold = lambda v, k: v.bitwiseXOR(F.shiftright(v, k))
    x, y, a, c = (F.col(n) for n in ("_x", "_y", "_a", "_c"))
    return _lane(x, a, c, fold) * (1 << 31) + _lane(y, c, a, fold)


def _mixed(v: np.ndarray, a: int, c: int) -> np.ndarray:
    """_lane of a uint64 array, in place: what is left by 2^31 - 1 is the sum of both 31-bit digits, less 2^31 - 1 where that is not below 0 (it would wrap to a larger number)."""
    t = np.empty_like(v)
    for times, shift in ((a, 15), (c, 13), (a, 0)):
        v *= np.uint64(times)
        np.right_shift(v, 31, out=t)
        v &= _PRIME
        v += t
        np.subtract(v, _PRIME, out=t)
        np.minimum(v, t, out=v)
        if shift:
            np.right_shift(v, shift, out=t)
            v ^= t
    return v


def _shuffled_order(x: np.ndarray, y: np.ndarray, a: int, c: int, out: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """The rows in the order of _order_columns, in out (int64): a row's number stands below its first lane, so one sort of numbers does; only rows of equal first lanes need the second."""
    bits = max(1, (len(x) - 1).bit_length())
    numbers = np.arange(min(step, len(x)), dtype=np.uint64)
    for lo in range(0, len(x), step):
        v = _mixed(x[lo : lo + step].astype(np.uint64), a, c)
        v <<= bits
        v += numbers[: len(v)]
        np.add(v, lo, out=out.view(np.uint64)[lo : lo + step])
    out.sort()
    last = (1 << bits) - 1
    at, tied = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo in range(0, len(x), step):
        part, after = out[lo : lo + step], out[lo + 1 : lo + step + 1]
        equal = lo + np.flatnonzero((part[: len(after)] ^ after) <= last)
        at += [equal, equal + 1]
        tied += [out[equal], out[equal + 1]]
        part &= last
    at, first = np.unique(np.concatenate(at), return_index=True)
    if len(at):
        tied = np.concatenate(tied)[first]
        rows = tied & last
        out[at] = rows[np.lexsort((rows, _mixed(y[rows].astype(np.uint64), c, a), tied >> bits))]
    return out


def _shuffled_rows(d: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """d (with a column _i, the rows' numbers from 1 in key order), n times as b, and with _j: the number of the row whose values this one takes."""
    dealt = _resamples(d.select("*", *_row_lanes(seed, key)), n).select("*", *_resample_lanes(seed, "b"))
    order = Window.partitionBy("b").orderBy(_order_columns(), F.col(key))
    return dealt.withColumn("_j", F.row_number().over(order).cast("long")).drop("_x", "_y", "_a", "_c")


def permuted_labels(df: DataFrame, key: str, group: str, n: int, seed: int) -> DataFrame:
    """df, n times, with a shuffled copy of group: rows in the order of a hash of row and resample take the labels in key order.

    The rows' numbers come from ranges of keys; each resample is sorted by one window partition, which spills. For statistics that are sums of products, see permuted_products.
    """
    d = with_rank(df, [key], "_i")
    labels = d.select(F.col("_i").alias("_j"), F.col(group).alias("_shuffled"))
    return _shuffled_rows(d, key, n, seed).join(labels, "_j").select(*df.columns, "b", "_shuffled")


def permuted_products(df: DataFrame, key: str, blocks: list[tuple[list[str], list[str]]], n: int, seed: int, broadcast_bytes: int = 512 << 20) -> DataFrame:
    """(b, block, products): for each of n resamples and each block (xs, ys), the sums of shuffled x times y, for each x and in it each y, over the block's complete rows.

    One pass for all blocks: a resample orders the rows once, by a hash, and the complete rows of a block in that order take its x values in key order. Key values are unique. Tables of up to
    broadcast_bytes of numbers are broadcast and the resamples shared out among tasks, which hold each number once besides one order of the rows; larger ones are ranked by windows,
    with the same shuffles. x values that are all 0 or 1 mark rows, whose y values are added up where they stand. df is read several times.
    """
    columns = list(dict.fromkeys(c for xs, ys in blocks for c in [*xs, *ys]))
    d = finite_columns(df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]))
    schema = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("products", T.ArrayType(T.DoubleType()))])
    if d.count() * (len(columns) + 1) * 8 > broadcast_bytes:
        from functools import reduce

        parts = []
        for k, (xs, ys) in enumerate(blocks):
            own = with_rank(d.select(key, *dict.fromkeys([*xs, *ys])).na.drop(), [key], "_i")
            values = own.select(F.col("_i").alias("_j"), *[F.col(x).alias(f"_x{i}") for i, x in enumerate(xs)])
            each = _shuffled_rows(own, key, n, seed).join(values, "_j")
            sums = [F.sum(F.col(f"_x{i}") * F.col(y)) for i in range(len(xs)) for y in ys]
            parts.append(each.groupBy("b").agg(F.array(*sums).alias("products")).select("b", F.lit(k).alias("block"), "products"))
        return reduce(DataFrame.unionByName, parts)
    import pyarrow as pa

    spark = df.sparkSession
    lanes = [c.cast("int").alias(name) for c, name in zip(_row_lanes(seed, key), ("_x", "_y"))]
    t = d.select("*", *lanes).orderBy(key).drop(key).toArrow()
    table = spark.sparkContext.broadcast({c: t.column(c).to_numpy() for c in t.column_names})
    del t

    def shuffle(batches: Iterator, step: int = 1 << 16) -> Iterator:
        v = table.value
        groups: dict = {}  # blocks of the same complete rows share what is gathered
        where = []
        for xs, ys in blocks:
            keep = np.ones(len(v["_x"]), bool)
            for c in {*xs, *ys}:
                keep &= np.isfinite(v[c])
            rows = None if keep.all() else keep.tobytes()
            left, right, _ = groups.setdefault(rows, ({}, {}, None if rows is None else keep))
            where.append((rows, [left.setdefault(c, len(left)) for c in xs], [right.setdefault(c, len(right)) for c in ys]))
        values = {rows: [v[c] if keep is None else v[c][keep] for c in left] for rows, (left, _, keep) in groups.items()}
        # Where all rows count, an x of 0 and 1 is the places of its ones.
        ones = {i: np.flatnonzero(x).astype(np.int32) for i, x in enumerate(values.get(None, [])) if ((x == 0) | (x == 1)).all()}
        taken = np.empty(len(v["_x"]) if ones else 0, bool)
        order = np.empty(len(v["_x"]), np.int64)
        for batch in batches:
            for b, a, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                _shuffled_order(v["_x"], v["_y"], a, c, order)
                sums = {}
                for rows, (left, right, keep) in groups.items():
                    own = order if keep is None else order[keep[order]]
                    sums[rows] = total = np.zeros((len(left), len(right)))
                    marks = ones if rows is None else {}
                    for i, places in marks.items():
                        taken[:] = False
                        for lo in range(0, len(places), step):
                            taken[order.take(places[lo : lo + step])] = True
                        for lo in range(0, len(order), step):
                            part = taken[lo : lo + step].astype(float)
                            for k, c_y in enumerate(right):
                                total[i, k] += part @ v[c_y][lo : lo + step]
                    others = [i for i in range(len(left)) if i not in marks]
                    for lo in range(0, len(own) if others else 0, step):
                        part = own[lo : lo + step]
                        for k, c_y in enumerate(right):
                            y = v[c_y].take(part)
                            for i in others:
                                total[i, k] += values[rows][i][lo : lo + step] @ y
                made = [sums[rows][np.ix_(i, k)].ravel() for rows, i, k in where]
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(made), pa.int32()), pa.array(range(len(made)), pa.int32()), pa.array(made, pa.list_(pa.float64()))], names=schema.names)

    tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, tasks).select(F.col("id").cast("int").alias("b"), *_resample_lanes(seed, "id")).mapInArrow(shuffle, schema)


def _permutation_p(hits):
    """(hits + 1) / (n + 1) as an aggregate."""
    return (F.count_if(hits) + 1) / (F.count("*") + 1)


def perm_group(df: DataFrame, value: str, group: str, key: str, n: int = 10_000, seed: int = 42) -> DataFrame:
    """(observed, n_perm, p): two-sided p of a difference of means, (hits + 1) / (n + 1). group is a 0/1 flag.

    A shuffle's difference follows from one sum: the values in the shuffled group 1.
    """
    # The table is made once; the sums and the permutations read the checkpoint.
    d = _kept(finite_columns(df.select(key, F.col(value).cast("double").alias("v"), F.col(group).cast("double").alias("g"))).na.drop())
    one = F.col("g") == 1
    rows, ones, total, inside = d.agg(F.count("*"), F.count_if(one), F.sum("v"), F.sum(F.when(one, F.col("v")))).first()
    spark = df.sparkSession
    if not ones or ones == rows:
        return spark.range(1).select(F.lit(None).cast("double").alias("observed"), F.lit(0).cast("long").alias("n_perm"), F.lit(None).cast("double").alias("p"))
    centre = total / rows  # sums of centred values don't cancel
    observed = inside / ones - (total - inside) / (rows - ones)
    each = permuted_products(d.select(key, "g", (F.col("v") - centre).alias("v")), key, [(["g"], ["v"])], n, seed)
    # Centred values sum to 0, so the other group's sum is what is missing from it.
    diff = F.col("products")[0] * (1 / ones + 1 / (rows - ones))
    return each.agg(F.lit(float(observed)).alias("observed"), F.count("*").alias("n_perm"), _permutation_p(F.abs(diff) >= abs(observed) - 1e-12).alias("p"))


def _gains(products: DataFrame, tests: list[dict]) -> DataFrame:
    """(block, b, gain): the R2 that each shuffled predictor adds, from its products with the base columns and the residual of y, which come first and last."""

    def gain(c):
        p, block = c["products"], c["block"].astype(int)
        out = np.zeros(len(block))
        for k, t in enumerate(tests):
            mine = block == k
            if mine.any():
                q = p[mine][:, : len(t["inv"]) + 1]
                left = t["sxx"] - np.einsum("bi,ij,bj->b", q[:, :-1], t["inv"], q[:, :-1])
                ok = (left > t["sxx"] * 1e-12) & (t["sst"] > 0)
                out[mine] = np.where(ok, q[:, -1] ** 2 / np.where(ok, left * t["sst"], 1.0), 0.0)
        return {"gain": out}

    width = max(len(t["inv"]) + 1 for t in tests)
    padded = F.array(*[F.coalesce(F.get("products", F.lit(i)), F.lit(0.0)) for i in range(width)])
    return _in_stacks(products.select("b", "block", padded.alias("products")).withColumn("_k", F.col("block")), ["b", "_k"], gain, [T.StructField("gain", T.DoubleType())]).withColumnRenamed("_k", "block")


def permuted_gains(df: DataFrame, key: str, tests: list[tuple[str, str, list[str]]], n: int, seed: int) -> tuple[list[Gram], DataFrame]:
    """(Grams, p values (block, n_perm, p)) of tests (y, x, base): how often a shuffled x adds as much R2 to base as x does, one-sided with +1.

    One aggregation gives each test's sums and one pass of resamples serves all tests. The base's part is taken out of y once, so a shuffle changes only
    the products of x with the base columns and with that residual.
    """
    d = finite_columns(df.select(key, *dict.fromkeys(c for y, x, base in tests for c in (y, x, *base))))
    grams_, blocks, facts, made = gram_sets(d, [[*base, x, y] for y, x, base in tests]), [], [], {}
    for (y, x, base), g in zip(tests, grams_):
        my, both = _fit(g, y, base), _fit(g, y, [*base, x])
        mean, cov = g.pick([*base, x])
        fitted = sum((F.col(c) * float(v) for c, v in zip(base, my["beta"])), F.lit(my["intercept"]))
        # A row counts where all of its test's columns are there, so tests may share what is the same in them.
        xs = [made.setdefault((c, float(m)), (f"_c{len(made)}", F.col(c) - float(m)))[0] for c, m in zip([*base, x], mean)]
        left = made.setdefault((y, *base, my["intercept"], *map(float, my["beta"])), (f"_c{len(made)}", F.col(y) - fitted))[0]
        blocks.append(([xs[-1]], [*xs[:-1], left]))
        facts.append({"inv": my["inv"], "sxx": float(cov[-1, -1]), "sst": my["sst"], "seen": both["r2"] - (my["r2"] if base else 0.0)})
    d = d.select(key, *[c.alias(name) for name, c in made.values()])
    each = _gains(permuted_products(d, key, blocks, n, seed), facts)
    seen = F.element_at(F.array(*[F.lit(float(f["seen"])) for f in facts]), F.col("block") + 1)
    return grams_, each.groupBy("block").agg(F.count("*").alias("n_perm"), _permutation_p(F.col("gain") >= seen - 1e-12).alias("p"))


def perm_dr2(df: DataFrame, y: str, x: str, controls: list[str], key: str, n: int = 5_000, seed: int = 42) -> DataFrame:
    """(delta_r2, n_perm, p): one-sided p of the gain in R2 by x over controls, x shuffled."""
    # The table is made once; the sums and the permutations read the checkpoint.
    d = _kept(df.select(key, *dict.fromkeys([y, x, *controls])))
    (g,), p = permuted_gains(d, key, [(y, x, list(controls))], n, seed)
    seen = _fit(g, y, [*controls, x])["r2"] - (_fit(g, y, list(controls))["r2"] if controls else 0.0)
    return p.select(F.lit(float(seen)).alias("delta_r2"), "n_perm", "p")


def bootstrap_ols(df: DataFrame, y: str, xs: list[str], key: str, n: int = 2_000, seed: int = 42) -> DataFrame:
    """(term, median, lower, upper, crosses_zero): percentile intervals of coefficients under Poisson(1) resampling by hash.

    A resample is a weight for each row, so it is one weighted set of sums; each is solved where it was added up.
    """
    cols = [*xs, y]
    d = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    u = _uniform(seed, "b", key)
    weight, total, term = F.lit(0), 0.0, float(np.exp(-1))
    for i in range(8):
        total += term
        weight = weight + (u > total).cast("int")
        term /= i + 1
    r = _resamples(d, n).withColumn("_w", weight).filter("_w > 0")
    names = ["_one", *cols]
    v = {"_one": F.lit(1.0), **{c: F.col(c) for c in cols}}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = r.groupBy("b").agg(*[F.sum(F.col("_w") * v[a] * v[b]).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("estimate", T.DoubleType())])

    def solve(batches: Iterator) -> Iterator:
        import pandas as pd

        k = len(names)
        for d in batches:
            out = []
            for row in d[[f"s{i}" for i in range(len(pairs))]].to_numpy(float):
                m = np.zeros((k, k))
                for (a, b), s in zip(pairs, row):
                    i, j = names.index(a), names.index(b)
                    m[i, j] = m[j, i] = s
                beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
                out += zip(["const", *xs], beta.tolist())
            yield pd.DataFrame(out, columns=["term", "estimate"])

    each = sums.mapInPandas(solve, schema)
    q = each.groupBy("term").agg(F.percentile("estimate", 0.5).alias("median"), F.percentile("estimate", 0.025).alias("lower"), F.percentile("estimate", 0.975).alias("upper"), F.count("*").alias("n_resamples"))
    return q.withColumn("crosses_zero", (F.col("lower") <= 0) & (F.col("upper") >= 0))


def surrogate_pairs(turns: DataFrame, keys: list[str], order: list[str], speaker: str, value: str, n_pairs: int | None = None, seed: int = 42, draws: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(real, pseudo) synchronies: a session's own, and of the earlier-turn series of one session with the later-turn series of another, cut to the shorter.

    n_pairs: draws that many session pairs by hash; None takes all ordered pairs (for few sessions: their number is squared). draws:
    (id, x, y) are drawn instead, x of the sessions in order, from 0, and y of the others.
    """
    p = switch_pairs(turns, keys, order, speaker, [value]).filter(F.col(value).isNotNull() & F.col(f"prev_{value}").isNotNull())
    p = p.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    s = F.struct(*keys)
    real = p.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr(F.col(f"prev_{value}"), F.col(value), 4).alias("synchrony")).filter("synchrony is not null")
    a = p.select(s.alias("s"), "k", F.col(f"prev_{value}").alias("a"))
    b = p.select(s.alias("o"), "k", F.col(value).alias("b"))
    if n_pairs is None and draws is None:
        both = a.join(b, "k").filter("s <> o")
    else:
        ids = with_rank(p.select(s.alias("s")).distinct(), ["s"], "i")
        m = ids.count()
        drawn = draws if draws is not None else turns.sparkSession.range(n_pairs).select("id", F.xxhash64(F.lit(seed), "id").alias("x"), F.xxhash64(F.lit(seed + 1), "id").alias("y"))
        x, y = F.pmod("x", F.lit(max(m, 1))), F.pmod("y", F.lit(max(m - 1, 1)))
        drawn = drawn.select("id", x.alias("x"), y.alias("y")).select("id", (F.col("x") + 1).alias("i"), (F.when(F.col("y") >= F.col("x"), F.col("y") + 1).otherwise(F.col("y")) + 1).alias("j"))
        chosen = drawn.join(ids, "i").withColumnRenamed("s", "s1").drop("i").join(ids.withColumnRenamed("s", "s2"), F.col("j") == F.col("i"))
        chosen = chosen.select("id", F.col("s1").alias("s"), F.col("s2").alias("o"))
        both = chosen.join(a, "s").join(b, ["o", "k"])
    group = ["s", "o"] if n_pairs is None and draws is None else ["id", "s", "o"]
    pseudo = both.groupBy(*group).agg(F.count("*").alias("n"), safe_corr(F.col("a"), F.col("b"), 4).alias("synchrony")).filter("synchrony is not null")
    return real, pseudo


def surrogate_test(turns: DataFrame, keys: list[str], order: list[str], speaker: str, value: str, n_surrogates: int = 2_000, batch: int = 50, seed: int = 42) -> DataFrame:
    """(real_mean, pseudo_mean, n_batches, p): two-sided, with +1, over means of batches of surrogate pairs."""
    real, pseudo = surrogate_pairs(turns, keys, order, speaker, value, n_surrogates, seed)
    means = pseudo.withColumn("_b", F.floor(F.col("id") / batch)).groupBy("_b").agg(F.avg("synchrony").alias("m"))
    r = real.agg(F.avg("synchrony").alias("real_mean"))
    c = means.agg(F.avg("m").alias("pseudo_mean"))
    d = means.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(c))
    far = F.abs(F.col("m") - F.col("pseudo_mean")) >= F.abs(F.col("real_mean") - F.col("pseudo_mean"))
    return d.agg(F.first("real_mean").alias("real_mean"), F.first("pseudo_mean").alias("pseudo_mean"), F.count("*").alias("n_batches"), ((F.count_if(far) + 1) / (F.count("*") + 1)).alias("p"))


def incremental_validity(
    df: DataFrame, key: str, outcomes: list[str], turn_features: list[str], vocal_features: list[str], controls: list[str] = (), theory_features: list[str] = (), n_perm: int = 5_000, seed: int = 42
) -> tuple[DataFrame, dict]:
    """(results, metadata): what vocal alignment adds to turn features, in three tiers.

    primary: the first component of the vocal features, for the equal-weight mean of the standardised outcomes. secondary: the same for each outcome, with FDR over their p_perm.
    exploratory: an index named beforehand, the mean of the standardised theory_features, for the primary outcome. Missing features are imputed by means and missing controls are 0; an
    outcome's rows without it don't count. Each row: tier, outcome, predictor, n, r2_controls, r2_base, r2_full, delta_r2, f, p, p_perm, p_perm_fdr, partial_r, partial_p, unique_turn,
    unique_vocal, shared, beta (of the standardised predictor), delta_r2_equal_weight. All tests share one aggregation of sums each and one pass of permutations.
    """
    from ..operators.tables import cronbach_alpha

    # The table is made once; each statistic reads the checkpoint.
    wanted = list(dict.fromkeys([*outcomes, *turn_features, *vocal_features, *theory_features, *controls]))
    d = _kept(finite_columns(df.select(key, *[F.col(c).cast("double").alias(c) for c in wanted])))
    raw, features = d, list(dict.fromkeys([*turn_features, *vocal_features, *theory_features]))
    means = d.agg(*[F.avg(c).alias(c) for c in features]).first().asDict()
    has = lambda names: [c for c in names if means[c] is not None]
    d = d.withColumns({**{c: F.coalesce(c, F.lit(float(means[c]))) for c in has(features)}, **{c: F.coalesce(c, F.lit(0.0)) for c in controls}})
    d, turn_info = pca_composite(d, has(turn_features), "_turn")
    d, vocal_info = pca_composite(d, has(vocal_features), "_vocal")
    d = equal_weight(d, has(vocal_features), "_vocal_ew")
    d = equal_weight(d, has(theory_features), "_theory") if has(theory_features) else d.withColumn("_theory", F.lit(None).cast("double"))
    d = equal_weight(d, outcomes, "_outcome")
    d, outcome_info = pca_composite(d, outcomes, "_outcome_pca")
    d = _kept(standardise(d, ["_turn", "_vocal", "_vocal_ew", "_theory", *controls], ""))
    base = [*controls, "_turn"]
    named = [("primary", "composite", "vocal", "_outcome", "_vocal"), *(("secondary", o, "vocal", o, "_vocal") for o in outcomes)]
    named += [("exploratory", "composite", "theory", "_outcome", "_theory")] if has(theory_features) else []
    grams_, p = permuted_gains(d, key, [(y, x, base) for *_, y, x in named], n_perm, seed)
    p_perm = {r["block"]: r["p"] for r in p.collect()}  # a row for each test
    answers = list(dict.fromkeys(t[3] for t in named))
    weights = dict(zip(answers, gram_sets(d, [[*base, "_vocal_ew", y] for y in answers])))
    rows = []
    for k, ((tier, outcome, predictor, y, x), g) in enumerate(zip(named, grams_)):
        none, first, second, full = (_fit(g, y, xs) for xs in ([*controls], base, [*controls, x], [*base, x]))
        start = none["r2"] if controls else 0.0
        gain, df2 = full["r2"] - first["r2"], full["df"]
        f = gain / ((1 - full["r2"]) / df2) if df2 > 0 and full["r2"] < 1 else None
        pull = float(full["beta"][-1])
        # The partial correlation has the sign of the slope and explains the gain's share of what the base left.
        partial = float(np.sign(pull) * np.sqrt(max(0.0, gain) / (1 - first["r2"]))) if first["r2"] < 1 else None
        w = weights[y]
        equal = _fit(w, y, [*base, "_vocal_ew"])["r2"] - _fit(w, y, base)["r2"]
        numbers = (start, first["r2"], full["r2"], gain, f, p_perm.get(k), partial, full["r2"] - second["r2"], gain, first["r2"] + second["r2"] - full["r2"] - start, pull, equal, float(df2))
        rows.append((tier, outcome, predictor, g.n, *map(_none, numbers)))
    fields = ["r2_controls", "r2_base", "r2_full", "delta_r2", "f", "p_perm", "partial_r", "unique_turn", "unique_vocal", "shared", "beta", "delta_r2_equal_weight", "_df"]
    out = df.sparkSession.createDataFrame(rows, "tier string, outcome string, predictor string, n long, " + ", ".join(f"{c} double" for c in fields))
    out = out.withColumns({"p": f_p_value(F.col("f"), F.lit(1.0), F.col("_df")), "_t": F.col("partial_r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("partial_r") * F.col("partial_r"), F.lit(0.0)))})
    out = out.withColumn("partial_p", t_p_value(F.col("_t"), (F.col("n") - 2).cast("double"))).drop("_t", "_df")
    second = bh_fdr(out.filter("tier = 'secondary'"), "p_perm", out="p_perm_fdr")
    out = out.filter("tier <> 'secondary'").withColumn("p_perm_fdr", F.lit(None).cast("double")).unionByName(second)
    apart = d.agg(F.corr("_turn", "_vocal").alias("turn_vocal"), F.corr("_outcome", "_outcome_pca").alias("composites")).first()
    alpha = cronbach_alpha(raw, outcomes).first()["alpha"]
    return out, {"turn": turn_info, "vocal": vocal_info, "outcome": outcome_info, "r_turn_vocal": apart[0], "r_composite_pca": apart[1], "alpha": alpha, "theory": has(theory_features), "n_perm": n_perm, "seed": seed}


__all__ = ["Gram", "bootstrap_ols", "incremental_validity", "perm_dr2", "perm_group", "permuted_gains", "permuted_labels", "permuted_products", "surrogate_pairs", "surrogate_test"]
