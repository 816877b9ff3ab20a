"""Operators on ordered turns: speaker switches, backchannels, merged talk, entrainment, windows.

Every session is one window partition; a sort by (session, order) serves all of them. All-pairs baselines are running sums over
sorted values, O(n log n), never a join of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import ratio, safe_corr
from ..functions.text import norm_text
from .ranks import bh_fdr  # noqa: F401


def in_order(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def switch_pairs(turns: DataFrame, keys: list[str], order: list[str], speaker: str, values: list[str]) -> DataFrame:
    """keys, prev_speaker, speaker, prev_<v>, <v> and order of each turn whose predecessor has another speaker."""
    before = F.lag(F.struct(speaker, *values)).over(in_order(keys, order))
    pairs = turns.withColumn("_b", before).filter(F.col("_b").isNotNull() & (F.col(f"_b.{speaker}") != F.col(speaker)))
    return pairs.select(*keys, *order, F.col(f"_b.{speaker}").alias("prev_speaker"), F.col(speaker).alias("speaker"), *[F.col(f"_b.{v}").alias(f"prev_{v}") for v in values], *values)


def flag_backchannels(turns: DataFrame, keys: list[str], order: list[str], lexicon: list[str], speaker: str = "speaker", text: str = "text", max_words: int = 2) -> DataFrame:
    """turns with is_backchannel: at most max_words words, all in the lexicon, and no neighbour of the same speaker (one neighbour at least)."""
    w = in_order(keys, order)
    words = F.filter(F.split(norm_text(F.coalesce(F.col(text), F.lit(""))), " +"), lambda x: x != "")
    short = (F.size(words) > 0) & (F.size(words) <= max_words) & F.forall(words, lambda x: x.isin(*lexicon))
    before, after = F.lag(speaker).over(w), F.lead(speaker).over(w)
    alone = (before.isNotNull() | after.isNotNull()) & F.coalesce(before != F.col(speaker), F.lit(True)) & F.coalesce(after != F.col(speaker), F.lit(True))
    return turns.withColumn("is_backchannel", short & alone)


def zscore(df: DataFrame, columns: list[str], by: list[str], ddof: int = 0, suffix: str = "") -> DataFrame:
    """z scores within groups (over the table with an empty list, from one broadcast row); null where the spread is 0."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    if by:
        w = Window.partitionBy(*by)
        return df.withColumns({f"{c}{suffix}": ratio(F.col(c) - F.avg(c).over(w), sd(c).over(w)) for c in columns})
    one = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[sd(c).alias(f"_s_{c}") for c in columns])
    wide = df.crossJoin(F.broadcast(one))  # one row
    return wide.withColumns({f"{c}{suffix}": ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}).drop(*[x for c in columns for x in (f"_m_{c}", f"_s_{c}")])


def gap_merge(cues: DataFrame, keys: list[str], order: list[str], gap: float = 0.30, min_dur: float = 0.25, speaker: str = "speaker", start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """Cues of one speaker that follow within gap become a turn: (keys, turn_idx, speaker, t_start, t_end, dur, n_cues, text); the text is the first longest.

    A cue joins the run if it starts no later than the run's latest end so far plus gap.
    """
    w = in_order(keys, order)
    d = cues.withColumn("_new", F.coalesce((F.lag(speaker).over(w) != F.col(speaker)).cast("int"), F.lit(1)))
    d = d.withColumn("_island", F.sum("_new").over(w)).withColumn("_i", F.row_number().over(w))
    inside = Window.partitionBy(*keys, "_island").orderBy("_i")
    latest = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_gap", F.coalesce((F.col(start) > latest + gap).cast("int"), F.lit(0)))
    d = d.withColumn("_run", F.sum("_gap").over(inside))
    turns = d.groupBy(*keys, "_island", "_run").agg(
        F.first(speaker).alias("speaker"), F.min(start).alias("t_start"), F.max(end).alias("t_end"), F.count("*").alias("n_cues"), F.max_by(text, F.struct(F.length(text), -F.col("_i"))).alias("text")
    )
    turns = turns.withColumn("dur", F.col("t_end") - F.col("t_start")).filter(F.col("dur") >= min_dur)
    order_out = Window.partitionBy(*keys).orderBy("_island", "_run")
    return turns.withColumn("turn_idx", F.row_number().over(order_out) - 1).drop("_island", "_run")


def all_pairs_distance(values: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """(keys, n0, n1, mean_distance): mean |a - b| over all pairs of side 0 and side 1, from running sums over the sorted values."""
    whole = Window.partitionBy(*keys)
    run = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    one, zero = F.col(side) == 1, F.col(side) == 0
    b = F.when(one, F.col(value)).otherwise(0.0)
    d = values.filter(F.col(value).isNotNull()).withColumns({"_c": F.sum(one.cast("long")).over(run), "_s": F.sum(b).over(run), "_n1": F.sum(one.cast("long")).over(whole), "_s1": F.sum(b).over(whole)})
    a = F.col(value)
    each = a * F.col("_c") - F.col("_s") + (F.col("_s1") - F.col("_s")) - a * (F.col("_n1") - F.col("_c"))
    out = d.groupBy(*keys).agg(F.sum(zero.cast("long")).alias("n0"), F.sum(one.cast("long")).alias("n1"), F.sum(F.when(zero, each)).alias("_t"))
    return out.withColumn("mean_distance", ratio(F.col("_t"), F.col("n0") * F.col("n1"))).drop("_t")


_X1, _X2, _X3, _X4, _X5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(v: np.ndarray, k: int) -> np.ndarray:
    return v << np.uint64(k) | v >> np.uint64(64 - k)


def _finished(v: np.ndarray) -> np.ndarray:
    v = (v ^ v >> np.uint64(33)) * _X2
    v = (v ^ v >> np.uint64(29)) * _X3
    return v ^ v >> np.uint64(32)


def _hashed_long(v: np.ndarray, seed: int = 42) -> np.ndarray:
    """xxhash64 of longs, as the column function gives it, in unsigned numbers."""
    return _finished(_turned(_turned(v.astype(np.int64).view(np.uint64) * _X2, 31) * _X1 ^ (np.uint64(seed) + _X5 + np.uint64(8)), 27) * _X1 + _X4)


def _hashed_int(b: int, seed: np.ndarray) -> np.ndarray:
    """xxhash64 of an int, after what seed is the hash of."""
    return _finished(_turned(seed + (_X5 + np.uint64(4)) ^ np.uint64(b * int(_X1) % (1 << 64)), 23) * _X2 + _X3)


def _paired(first: np.ndarray, side: np.ndarray, value: np.ndarray, h: np.ndarray, n_shuffles: int) -> tuple[np.ndarray, ...]:
    """(rows where a session with pairs begins, n_pairs, mean, sum of squared deviations) of sampled_pairs_distance; rows in the order of session and side."""
    session = np.cumsum(first) - 1
    group = 2 * session + side
    sizes = np.bincount(group, minlength=2 * int(session[-1]) + 2)
    begins = np.cumsum(sizes) - sizes
    m = np.minimum(sizes[::2], sizes[1::2])
    at = np.repeat(np.arange(len(m)), m)
    k = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
    left, right = begins[::2][at] + k, begins[1::2][at] + k
    some = np.maximum(m, 1)
    bits = int(group[-1]).bit_length() or 1
    high, seed = group.astype(np.uint64) << np.uint64(64 - bits), _hashed_long(h)
    mean, squares = np.zeros(len(m)), np.zeros(len(m))
    for b in range(n_shuffles):
        u = _hashed_int(b, seed) ^ np.uint64(1 << 63)  # in the order of signed numbers
        short = high | u >> np.uint64(bits)
        order = np.argsort(short)
        short = short[order]
        if (short[1:] == short[:-1]).any():
            order = np.lexsort((h, u, group))
        d = np.abs(value[order[left]] - value[order[right]])
        own = np.bincount(at, d, len(m)) / some
        gap = own - mean
        squares += np.bincount(at, (d - own[at]) ** 2, len(m)) + gap**2 * m * b / (b + 1)
        mean += gap / (b + 1)
    on = m > 0
    return np.flatnonzero(first)[on], m[on] * n_shuffles, mean[on], squares[on]


def sampled_pairs_distance(values: DataFrame, keys: list[str], side: str, value: str, row_id: list[str], n_shuffles: int = 200, seed: int = 42, whole: int = 200_000, rows: int = 20_000) -> DataFrame:
    """(keys, n0, n1, n_pairs, mean_distance, sd): mean |a - b| over pairs of a side 0 and a side 1 value, drawn n_shuffles times without making all pairs.

    In each shuffle both sides are put in order by hashes of their own of the shuffle and the row (row_id), and rows of one rank are a pair, as many as the smaller side has. Rows are dealt once by
    session and shuffled where they are, about rows at a time. In sessions of more than whole rows a shuffle is a group of its own, with the same draws, so a session of any size is spread over n_shuffles of
    them. Draws don't depend on partitions. sd is that of the single distances.
    """
    d = values.filter(F.col(value).isNotNull() & F.col(side).isin(0, 1)).select(*keys, F.col(side).cast("int").alias("_side"), F.col(value).cast("double").alias("_v"), F.xxhash64(F.lit(seed), side, *row_id).alias("_h"))
    sides = d.groupBy(*keys).agg(F.count_if(F.col("_side") == 0).alias("n0"), F.count_if(F.col("_side") == 1).alias("n1"))
    fields = [*[d.schema[k] for k in keys], T.StructField("n_pairs", T.LongType()), T.StructField("mean_distance", T.DoubleType()), T.StructField("sd", T.DoubleType())]

    def shuffled(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def made(t):
            first, side_, v, h = (t.column(c).to_numpy() for c in ("_r", "_side", "_v", "_h"))
            at, n, mean, squares = _paired(first == 1, side_, v, h, n_shuffles)
            sd = pa.array(np.sqrt(squares / np.maximum(n - 1, 1)), pa.float64(), mask=n < 2)
            return pa.Table.from_arrays([*[t.column(k).take(pa.array(at)) for k in keys], pa.array(n), pa.array(mean), sd], names=[f.name for f in fields]).to_batches()

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < rows:
                continue
            t = pa.Table.from_batches(held)
            starts = np.flatnonzero(t.column("_r").to_numpy() == 1)
            if len(starts) and starts[-1]:  # the last session may go on
                yield from made(t.slice(0, starts[-1]))
                t = t.slice(starts[-1])
            held, n = t.to_batches(), len(t)
        if n:
            yield from made(pa.Table.from_batches(held))

    def in_tasks(d: DataFrame) -> DataFrame:
        return d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_side"))).mapInArrow(shuffled, T.StructType(fields))

    def by_shuffle(d: DataFrame) -> DataFrame:
        each = d.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1))))
        order = Window.partitionBy(*keys, "_b", "_side").orderBy(F.xxhash64("_h", "_b"), "_h")
        ranked = each.withColumn("_k", F.row_number().over(order))
        at = lambda k: F.max(F.when(F.col("_side") == k, F.col("_v")))
        pairs = ranked.groupBy(*keys, "_b", "_k").agg(F.abs(at(0) - at(1)).alias("_d")).filter("_d is not null")
        return pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.avg("_d").alias("mean_distance"), F.stddev_samp("_d").alias("sd"))

    long = sides.filter(F.col("n0") + F.col("n1") > whole).select(*keys)
    if long.isEmpty():
        means = in_tasks(d)
    else:
        means = in_tasks(d.join(long, keys, "left_anti")).unionByName(by_shuffle(d.join(long, keys, "left_semi")))
    return sides.join(means, keys, "left").select(*keys, "n0", "n1", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "mean_distance", "sd")


def pair_metrics(pairs: DataFrame, keys: list[str], order: list[str], a: str, b: str, least: int = 4) -> DataFrame:
    """(keys, n_pairs, adjacent, convergence, synchrony) of value pairs in order; rows with a null value don't count."""
    d = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_i", F.row_number().over(in_order(keys, order)) - 1)
    gap = F.abs(F.col(a) - F.col(b))
    slope = F.when(F.count("*") >= least, -F.regr_slope(gap, F.col("_i")))
    return d.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.avg(gap).alias("adjacent"), slope.alias("convergence"), safe_corr(F.col(a), F.col(b), least).alias("synchrony"))


def proximity(turns: DataFrame, keys: list[str], order: list[str], speaker: str, value: str, n_shuffles: int | None = None, seed: int = 42) -> DataFrame:
    """(keys, proximity): the exact all-pairs baseline (with n_shuffles, one of drawn pairs) less the mean distance at switches; null with fewer than two switches, other than two speakers, or fewer than two values a side."""
    who = Window.partitionBy(*keys)
    sided = turns.filter(F.col(value).isNotNull()).withColumns({"_lo": F.min(speaker).over(who), "_hi": F.max(speaker).over(who)}).withColumn("_side", (F.col(speaker) != F.col("_lo")).cast("int"))
    odd = sided.groupBy(*keys).agg(F.max(((F.col(speaker) != F.col("_lo")) & (F.col(speaker) != F.col("_hi"))).cast("int")).alias("_odd"))
    apart = all_pairs_distance(sided, keys, "_side", value) if n_shuffles is None else sampled_pairs_distance(sided, keys, "_side", value, order, n_shuffles, seed).drop("n_pairs")
    base = apart.join(odd, keys)
    pairs = switch_pairs(turns, keys, order, speaker, [value])
    near = pair_metrics(pairs, keys, order, f"prev_{value}", value)
    ok = (F.col("n_pairs") >= 2) & (F.col("n0") >= 2) & (F.col("n1") >= 2) & (F.col("_odd") == 0)
    return near.join(base, keys, "left").select(*keys, F.when(ok, F.col("mean_distance") - F.col("adjacent")).alias("proximity"))


def entrainment(turns: DataFrame, keys: list[str], order: list[str], speaker: str, features: list[tuple[str, str, bool]], edges: list[tuple[str, str, str, bool]] = (), min_switches: int = 5) -> DataFrame:
    """One row a session: n_turns, n_switch, va_<name>_{proximity, convergence, synchrony}, va_<name>_edge_{...}.

    features: (name, value column, z-score within speakers?). edges: (name, offset column, onset column, z-score?).
    Sessions with fewer switches keep their row with null metrics. The turns are dealt once by session; features are rows, not plans of their own.
    """
    # Counted first, as each row is sorted several times over: a task has about 100,000 rows, however small they are.
    parts = max(turns.sparkSession.sparkContext.defaultParallelism, -(-turns.count() // 100_000))
    base = turns.repartition(parts, *[F.col(k) for k in keys])
    z = sorted({c for _, c, s in features if s} | {c for _, a, b, s in edges if s for c in (a, b)})
    scored = zscore(base, z, [*keys, speaker]) if z else base
    values = sorted({c for _, c, _ in features} | {c for _, a, b, _ in edges for c in (a, b)})
    w = in_order(keys, order)
    linked = scored.withColumn("_b", F.lag(F.struct(speaker, *values)).over(w)).withColumn("_switch", F.coalesce(F.col(f"_b.{speaker}") != F.col(speaker), F.lit(False)))
    counts = linked.groupBy(*keys).agg(F.count("*").alias("n_turns"), F.sum(F.col("_switch").cast("long")).alias("n_switch"), F.min(speaker).alias("_lo"), F.max(speaker).alias("_hi"))
    long_pairs = F.explode(
        F.array(
            *[F.struct(F.lit(n).alias("metric"), F.col(f"_b.{c}").cast("double").alias("a"), F.col(c).cast("double").alias("b")) for n, c, _ in features],
            *[F.struct(F.lit(f"{n}_edge").alias("metric"), F.col(f"_b.{off}").cast("double").alias("a"), F.col(on).cast("double").alias("b")) for n, off, on, _ in edges],
        )
    )
    pairs = linked.filter("_switch").select(*keys, *order, long_pairs.alias("m")).select(*keys, *order, "m.*").filter("a is not null and b is not null")
    near = pair_metrics(pairs, [*keys, "metric"], order, "a", "b")
    # Baselines: all values of the first and second speaker, or all offsets and onsets of the pairs.
    sides = scored.join(counts.select(*keys, "_lo"), keys).select(*keys, (F.col(speaker) != F.col("_lo")).cast("int").alias("side"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("v")) for n, c, _ in features])).alias("m"))
    edge_sides = pairs.filter(F.endswith("metric", F.lit("_edge"))).select(*keys, "metric", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("v")), F.struct(F.lit(1).alias("side"), F.col("b").alias("v")))).alias("s")).select(*keys, "s.side", "metric", "s.v")
    apart = all_pairs_distance(sides.select(*keys, "side", "m.metric", "m.v").unionByName(edge_sides), [*keys, "metric"], "side", "v")
    both = near.join(apart, [*keys, "metric"], "left")
    is_edge = F.endswith("metric", F.lit("_edge"))
    enough = F.when(is_edge, F.col("n_pairs") >= 4).otherwise((F.col("n_pairs") >= 2) & (F.col("n0") >= 2) & (F.col("n1") >= 2))
    both = both.withColumn("proximity", F.when(enough, F.col("mean_distance") - F.col("adjacent")))
    names = [n for n, _, _ in features] + [f"{n}_edge" for n, *_ in edges]
    kinds = ("proximity", "convergence", "synchrony")
    wide = both.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == n, F.col(k))).alias(f"va_{n}_{k}") for n in names for k in kinds])
    out = counts.join(wide, keys, "left")
    return out.select(*keys, "n_turns", "n_switch", *[F.when(F.col("n_switch") >= min_switches, F.col(f"va_{n}_{k}")).alias(f"va_{n}_{k}") for n in names for k in kinds])


def best_window(turns: DataFrame, keys: list[str], length: int, step: int, start: str = "t_start", speaker: str = "speaker", order: list[str] | None = None) -> DataFrame:
    """(keys, window_start, n_switches): the grid window [g, g + length) with most switches between turns that start in it; the earliest of equals.

    A turn belongs to the length / step windows that hold its start, found by arithmetic, so no range join is needed.
    """
    order = order or [start]
    w = in_order(keys, order)
    whole = Window.partitionBy(*keys)
    d = turns.withColumns({"_t0": F.floor(F.min(start).over(whole)), "_prev": F.lag(F.struct(F.col(speaker).alias("s"), F.col(start).alias("t"))).over(w)})
    d = d.filter(F.col("_prev").isNotNull() & (F.col("_prev.s") != F.col(speaker)))
    first = F.greatest(F.floor((F.col(start) - F.col("_t0") - length) / step) + 1, F.lit(0))
    last = F.floor((F.col("_prev.t") - F.col("_t0")) / step)
    grid = d.filter(last >= first).select(*keys, "_t0", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("_g"))
    n = grid.groupBy(*keys, "_t0", "_g").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max_by((F.col("_t0") + F.col("_g") * step), F.struct("n", -F.col("_g"))).cast("long").alias("window_start"), F.max("n").alias("n_switches"))


def average_rank(value: Column, by: list[Column]) -> Column:
    """Ranks with ties averaged, inside groups that a task can sort; ranks.tied_ranks has those of whole tables."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def carry_forward(value: Column, keys: list[str], order: list[str]) -> Column:
    return F.last(value, ignorenulls=True).over(in_order(keys, order).rowsBetween(Window.unboundedPreceding, 0))
