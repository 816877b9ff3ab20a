"""Range joins by cells of time, frames, vectors and enrolment.

A join on inequalities alone is a nested loop. Cells of doubling lengths make it an equi-join: an interval is dealt to the cells as long as itself, and a point to
its cell of each length that intervals have. The inequality is left as a condition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cosine, rms_db, unit


def _level(start: Column, end: Column, unit: float) -> Column:
    """The lowest level whose cells, unit * 2^level long, are no shorter than the interval."""
    n = end - start
    return F.when(n > unit, F.ceil(F.log2(n / unit))).otherwise(0).cast("int")


def _cells(df: DataFrame, start: Column, end: Column, unit: float) -> DataFrame:
    """df with a row for each cell (_k) of its level (_l) that it touches: two at most, where its level is that of its length."""
    size = F.pow(F.lit(2.0), F.col("_l")) * unit
    first = F.floor(start / size)
    return df.withColumn("_k", F.explode(F.sequence(first, F.greatest(first, F.floor(end / size)))))


def _levelled(df: DataFrame, s: str, e: str, unit: float) -> DataFrame:
    """df with its level _own; rows with a bound that is null, NaN or infinite go, for they match nothing."""
    ok = F.lit(True)
    for c in (s, e):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf"))
    return df.filter(ok).withColumn("_own", _level(F.col(s), F.col(e), unit))


def _levels_of(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("_own").distinct().collect())  # a number for each power of 2 in the lengths


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_iv: tuple[str, str], b_iv: tuple[str, str], bucket: float) -> DataFrame:
    """Pairs of rows with equal keys whose half-open intervals overlap, each once.

    An interval stands in the two cells at most that it touches at the level of its own length, and in those of the other side's higher levels. The shorter of two that overlap touches
    a cell of the longer one at the longer one's level, so each pair meets there, in the later of both rows' first cells; no interval has more than two rows a level, however long it is.
    bucket: the length of the finest cells.
    """
    (s, e), (t, f) = a_iv, b_iv
    x, y = _levelled(a, s, e, bucket), _levelled(b, t, f, bucket)
    x_levels, y_levels = _levels_of(x), _levels_of(y)
    if not x_levels or not y_levels:
        return x.join(y, keys).drop("_own").limit(0)

    def own(d: DataFrame, lo: str, hi: str) -> DataFrame:
        return _cells(d.withColumn("_l", F.col("_own")).drop("_own"), F.col(lo), F.col(hi), bucket)

    def higher(d: DataFrame, lo: str, hi: str, levels: list[int], same: bool) -> DataFrame:
        up = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("_own") if same else v > F.col("_own"))
        return _cells(d.withColumn("_l", F.explode(up)).drop("_own"), F.col(lo), F.col(hi), bucket)

    on = [*keys, "_l", "_k"]
    parts = []
    if y_levels[0] <= x_levels[-1]:
        parts.append(own(x, s, e).join(higher(y, t, f, x_levels, True), on))
    if x_levels[0] < y_levels[-1]:
        both = higher(x, s, e, y_levels, False).join(own(y, t, f), on)
        parts.append(both)
    pairs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    size = F.pow(F.lit(2.0), F.col("_l")) * bucket
    met = F.col("_k") == F.greatest(F.floor(F.col(s) / size), F.floor(F.col(t) / size))
    return pairs.filter((F.col(e) > F.col(t)) & (F.col(s) < F.col(f)) & met).drop("_l", "_k")


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, iv: tuple[str, str], bucket: float, levels: list[int] | None = None) -> DataFrame:
    """Points with each interval start <= t < end that holds them. An interval has two rows at most, a point one for each level of the intervals' lengths.

    bucket: the length of the finest cells. levels: those of the intervals, where the caller knows them; else one job looks.
    """
    s, e = iv
    d = _levelled(intervals, s, e, bucket)
    wanted = levels if levels is not None else _levels_of(d)
    x = points.withColumn("_l", F.explode(F.array(*[F.lit(v) for v in wanted]).cast("array<int>")))
    x = x.withColumn("_k", F.floor(F.col(t) / (F.pow(F.lit(2.0), F.col("_l")) * bucket)))
    y = _cells(d.withColumn("_l", F.col("_own")).drop("_own"), F.col(s), F.col(e), bucket)
    return x.join(y, [*keys, "_l", "_k"]).filter((F.col(s) <= F.col(t)) & (F.col(t) < F.col(e))).drop("_l", "_k")


def first_interval(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, iv: tuple[str, str], point_id: list[str], value: str, bucket: float) -> DataFrame:
    """(keys, point_id, value) of the first interval that holds each point; null where none does."""
    hit = point_in_interval(points, intervals, keys, t, iv, bucket).groupBy(*keys, *point_id).agg(F.min_by(value, F.struct(*iv)).alias(value))
    return points.select(*keys, *point_id).join(hit, [*keys, *point_id], "left")


def edge_means(frames: DataFrame, switches: DataFrame, keys: list[str], t: str, boundary: str, value: str, width: float) -> DataFrame:
    """(keys, boundary, n_before, n_after, before, after): means of the frames in [boundary - width, boundary) and [boundary, boundary + width)."""
    around = switches.select(*keys, boundary, (F.col(boundary) - width).alias("_s"), (F.col(boundary) + width).alias("_e"))
    hit = point_in_interval(frames, around, keys, t, ("_s", "_e"), 4 * width, levels=[0])
    early = F.col(t) < F.col(boundary)
    return hit.groupBy(*keys, boundary).agg(F.count_if(early).alias("n_before"), F.count_if(~early).alias("n_after"), F.avg(F.when(early, F.col(value))).alias("before"), F.avg(F.when(~early, F.col(value))).alias("after"))


def rms_frames(chunks: DataFrame, samples: str, rate: float, win: float = 0.04, hop: float = 0.01) -> DataFrame:
    """chunks with a row for each frame of win seconds every hop seconds: t (its centre) and rms_db; shorter chunks have none."""
    n, step = round(win * rate), max(1, round(hop * rate))
    count = F.when(F.size(samples) >= n, F.floor((F.size(samples) - n) / step) + 1).otherwise(0)
    d = chunks.withColumn("_i", F.explode(F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
    return d.select(*[c for c in chunks.columns if c != samples], ((F.col("_i") * step + n / 2) / rate).alias("t"), rms_db(F.slice(samples, F.col("_i") * step + 1, F.lit(n))).alias("rms_db"))


def f0_frames(frames: DataFrame, samples: str, rate: float, low: float = 75.0, high: float = 400.0, silence: float = 0.01, voicing: float = 0.3) -> DataFrame:
    """frames with f0: the best lag of a windowed and then centred frame's autocorrelation in the pitch range; null for silence and unvoiced frames.

    An Arrow-batched function: the maximum over lags needs the whole frame.
    """
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in frames.schema if f.name != samples], T.StructField("f0", T.DoubleType())])

    def pitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for y in d[samples]:
                y = np.asarray(y, float) * np.hanning(len(y))
                y = y - y.mean() if len(y) else y
                if len(y) < 2 or np.sqrt(np.mean(y * y)) < silence:
                    out.append(None)
                    continue
                r = np.fft.irfft(np.abs(np.fft.rfft(y, 2 * len(y))) ** 2)[: len(y)]
                lo, hi = int(rate / high), min(int(rate / low), len(y))
                if hi <= lo or r[0] <= 0:
                    out.append(None)
                    continue
                lag = lo + int(np.argmax(r[lo:hi]))
                out.append(float(rate / lag) if r[lag] / r[0] > voicing else None)
            yield d.drop(columns=[samples]).assign(f0=pd.Series(out, index=d.index, dtype="float64"))[[f.name for f in schema]]

    return frames.mapInPandas(pitch, schema)


def turn_prosody(frames: DataFrame, turns: DataFrame, keys: list[str], turn: str, t: str = "t", f0: str = "f0", level: str = "rms_db", iv: tuple[str, str] = ("t_start", "t_end"), edge: float = 0.5, f0_min: float = 75.0, bucket: float = 5.0, min_edge: float = 0.05) -> DataFrame:
    """Per turn from its frames: f0 mean, population SD, 95-5 percentile range; level mean and SD; means of both in the first and last min(edge, dur / 2) seconds.

    Pitch is null for turns under 3 / f0_min seconds, edges for windows under min_edge seconds. Turns without frames keep null values.
    """
    s, e = iv
    hit = point_in_interval(frames, turns.select(*keys, turn, s, e), keys, t, iv, bucket)
    width = F.least(F.lit(edge), (F.col(e) - F.col(s)) / 2)
    begin, final = F.col(t) < F.col(s) + width, F.col(t) >= F.col(e) - width
    agg = hit.groupBy(*keys, turn).agg(
        F.avg(f0).alias("f0_mean"), F.stddev_pop(f0).alias("f0_sd"), (F.percentile(f0, 0.95) - F.percentile(f0, 0.05)).alias("f0_range"), F.avg(level).alias("int_mean"), F.stddev_pop(level).alias("int_sd"),
        F.avg(F.when(begin, F.col(f0))).alias("onset_f0"), F.avg(F.when(begin, F.col(level))).alias("onset_int"), F.avg(F.when(final, F.col(f0))).alias("offset_f0"), F.avg(F.when(final, F.col(level))).alias("offset_int"),
    )
    d = turns.select(*keys, turn, s, e).join(agg, [*keys, turn], "left")
    long, wide = (F.col(e) - F.col(s)) >= 3 / f0_min, width >= min_edge
    gate = {**{c: long for c in ("f0_mean", "f0_sd", "f0_range")}, **{c: wide for c in ("onset_f0", "onset_int", "offset_f0", "offset_int")}}
    return d.select(*keys, turn, *[F.when(gate[c], F.col(c)).alias(c) if c in gate else F.col(c) for c in ("f0_mean", "f0_sd", "f0_range", "int_mean", "int_sd", "onset_f0", "onset_int", "offset_f0", "offset_int")])


def syllable_rate(frames: DataFrame, turns: DataFrame, keys: list[str], turn: str, t: str = "t", level: str = "rms_db", f0: str = "f0", iv: tuple[str, str] = ("t_start", "t_end"), floor_db: float = 25.0, dip_db: float = 2.0, bucket: float = 5.0, min_dur: float = 0.10) -> DataFrame:
    """(keys, turn, n_syllables, rate_sylps): voiced level peaks inside a turn, over its maximum - floor_db, per second.

    A peak that is no louder than the last counted one needs a dip of dip_db below both between them. Turns under min_dur seconds or three frames have nulls.
    One fold over a turn's frames in order (bounded by the turn).
    """
    s, e = iv
    hit = point_in_interval(frames, turns.select(*keys, turn, s, e), keys, t, iv, bucket).filter(F.col(level).isNotNull())
    d = hit.groupBy(*keys, turn, s, e).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(level).cast("double").alias("v"), F.col(f0).isNotNull().alias("voiced")))).alias("_x"), (F.max(level) - floor_db).alias("_top"))

    def fold(x, top):
        def step(state, i):
            v = x[i]["v"]
            dip = F.least(state["dip"], v)
            peak = (v > x[i - 1]["v"]) & (v >= x[i + 1]["v"]) & (v > top) & x[i]["voiced"]
            shallow = ((v - dip < dip_db) | (state["last"] - dip < dip_db)) & (v <= state["last"])
            take = peak & (state["last"].isNull() | ~shallow)
            return F.struct(F.when(take, state["n"] + 1).otherwise(state["n"]).alias("n"), F.when(take, v).otherwise(state["last"]).alias("last"), F.when(take, v).otherwise(dip).alias("dip"))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("last"), F.lit(float("inf")).alias("dip"))
        return F.aggregate(F.sequence(F.lit(1), F.size(x) - 2), start, step)["n"]

    dur = F.col(e) - F.col(s)
    n = F.when((dur >= min_dur) & (F.size("_x") >= 3), fold(F.col("_x"), F.col("_top")))
    return d.select(*keys, turn, n.alias("n_syllables"), dur.alias("_dur")).select(*keys, turn, "n_syllables", (F.col("n_syllables") / F.greatest("_dur", F.lit(1e-6))).alias("rate_sylps"))


def centroids(df: DataFrame, keys: list[str], speaker: str, vector: str, least: int = 1) -> DataFrame:
    """(keys, speaker, n_enrolled, centroid): the unit-length mean vector of speakers with least vectors or more."""
    each = df.select(*keys, speaker, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, speaker, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("*").alias("_n"))
    whole = each.groupBy(*keys, speaker).agg(F.max("_n").alias("n_enrolled"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("_v"))
    return whole.filter(F.col("n_enrolled") >= least).select(*keys, speaker, "n_enrolled", unit(F.col("_v")).alias("centroid"))


def enroll_assign(df: DataFrame, keys: list[str], item: str, speaker: str, vector: str, pool: Column, least: int = 3, mode: str = "validate", low_margin: float = 0.05, min_dur: float | None = 1.0, dur: str = "dur") -> tuple[DataFrame, DataFrame]:
    """(scored, skipped): each turn's similarity to its session's two enrolled speakers, the nearest, the margin, agreement.

    pool marks enrolment rows; mode 'validate' scores the others, 'scale' all. Sessions without two speakers or two large enough pools are in
    skipped with a reason. Turns under min_dur are not scored.
    """
    speakers = df.groupBy(*keys).agg(F.countDistinct(speaker).alias("n_speakers"))
    made = centroids(df.filter(pool), keys, speaker, vector, least)
    enrolled = made.groupBy(*keys).agg(F.count("*").alias("n_ok"), F.min(speaker).alias("s0"), F.max(speaker).alias("s1"), F.min_by("centroid", speaker).alias("c0"), F.max_by("centroid", speaker).alias("c1"))
    state = speakers.join(enrolled, keys, "left")
    reason = F.when(F.col("n_speakers") != 2, "not two speakers").when(F.coalesce("n_ok", F.lit(0)) < 2, "enrolment pool too small")
    skipped = state.select(*keys, reason.alias("reason")).filter("reason is not null")
    good = state.filter(reason.isNull()).select(*keys, "s0", "s1", "c0", "c1")
    rows = df if mode == "scale" else df.filter(~F.coalesce(pool, F.lit(False)))
    if min_dur is not None:
        rows = rows.filter(F.col(dur) >= min_dur)
    d = rows.join(good, keys).withColumns({"sim_0": cosine(F.col(vector), F.col("c0")), "sim_1": cosine(F.col(vector), F.col("c1"))})
    predicted = F.when(F.col("sim_0") >= F.col("sim_1"), F.col("s0")).otherwise(F.col("s1"))
    margin = F.abs(F.col("sim_0") - F.col("sim_1"))
    scored = d.select(*keys, item, F.col(speaker).alias("speaker"), predicted.alias("predicted"), "sim_0", "sim_1", margin.alias("margin"), (predicted == F.col(speaker)).alias("agree"), (margin < low_margin).alias("low_margin"))
    return scored, skipped


def agreement(scored: DataFrame, by: str) -> DataFrame:
    """Agreement and low-margin shares by session and over all (null session), in one pass."""
    return scored.rollup(by).agg(F.count("*").alias("n_turns"), F.avg(F.col("agree").cast("double")).alias("agreement"), F.avg(F.col("low_margin").cast("double")).alias("low_margin_rate"), F.count_if(~F.col("agree") | F.col("low_margin")).alias("n_flagged"))


def _kept(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder that the cluster names; a local session without one gets its own."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", "") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="turnwise-"))
    return df.checkpoint()


def increasing_run(j: np.ndarray) -> list[int]:
    """The places of a longest strictly increasing subsequence of j."""
    from bisect import bisect_left

    ends, last, before = [], [], []
    for k, x in enumerate(j.tolist()):
        at = bisect_left(ends, x)
        before.append(last[at - 1] if at else -1)
        ends[at : at + 1], last[at : at + 1] = [x], [k]
    kept, k = [], last[-1] if last else -1
    while k >= 0:
        kept.append(k)
        k = before[k]
    return kept[::-1]


def matched_blocks(i: np.ndarray, j: np.ndarray, gram: int) -> list[list[int]]:
    """[i, j, size] of anchors of gram words (i rising), the most that keep one order, as blocks of matched words that don't overlap."""
    out: list[list[int]] = []
    ei = ej = -1
    for k in increasing_run(j):
        x, y = int(i[k]), int(j[k])
        skip = max(0, ei - x, ej - y) if out else 0
        if skip >= gram:
            continue
        if out and (x + skip, y + skip) == (ei, ej):
            out[-1][2] += gram - skip
        else:
            out.append([x + skip, y + skip, gram - skip])
        ei, ej = x + gram, y + gram
    return out


def _once(words: list, lo: int, hi: int, gram: int) -> dict:
    """The runs of gram words in words[lo:hi] that stand there once, with their places."""
    at: dict = {}
    for k in range(lo, hi - gram + 1):
        run = words[k] if gram == 1 else tuple(words[k : k + gram])
        at[run] = -1 if run in at else k
    return {run: k for run, k in at.items() if k >= 0}


def _occurrences(words: list, lo: int, hi: int) -> dict:
    """(word, how often it stood before) of words[lo:hi], with their places."""
    seen: dict = {}
    out = {}
    for k in range(lo, hi):
        n = seen[words[k]] = seen.get(words[k], 0) + 1
        out[words[k], n] = k
    return out


def match_words(a: list, b: list, gram: int = 5, small: int = 64) -> list[tuple[int, int, int]]:
    """(i, j, size) blocks of equal words in the order of both lists.

    Stretches with at most small * small pairs of words are aligned by longest matching blocks. Longer ones are cut at anchors: runs of gram words, or else of fewer, that stand once on each side of
    the stretch; where there are none, words and how often they stood before. What is between two anchors is a stretch again, so the work is about in proportion to the words.
    """
    from difflib import SequenceMatcher

    out: list[tuple[int, int, int]] = []
    stretches = [(0, len(a), 0, len(b))]
    while stretches:
        a0, a1, b0, b1 = stretches.pop()
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= small * small:
            out += [(a0 + m.a, b0 + m.b, m.size) for m in SequenceMatcher(None, a[a0:a1], b[b0:b1], autojunk=False).get_matching_blocks() if m.size]
            continue
        for size in (*[g for g in (gram, 3, 2, 1) if g <= gram], 0):
            left, right = (_once(a, a0, a1, size), _once(b, b0, b1, size)) if size else (_occurrences(a, a0, a1), _occurrences(b, b0, b1))
            both = sorted((k, right[run]) for run, k in left.items() if run in right)
            if both:
                blocks = matched_blocks(*np.array(both).T, max(size, 1))
                ei, ej = a0, b0
                for i, j, n in blocks:
                    out.append((i, j, n))
                    stretches.append((ei, i, ej, j))
                    ei, ej = i + n, j + n
                stretches.append((ei, a1, ej, b1))
                break
    return sorted(out)


def align_words(manual: DataFrame, timed: DataFrame, keys: list[str], gram: int = 5, whole: int = 20_000, span: int = 50_000) -> DataFrame:
    """manual words (keys, turn_idx, pos, word) with the start and end of the timed words (keys, word_idx, word, start, end) that match_words gives them; null where there is none.

    Sessions of up to whole words a side are aligned each in a task. Longer ones are first cut at anchors found by joins: runs of gram words that occur once on each side; where more than whole words
    are left between two anchors, words and how often they occurred before. Of the anchors the most that keep one order are matched: a task for each span of positions finds its own, and of the
    spans, one row each, the best that follow each other stay. What lies between is aligned as a session is, so no long session meets in one task.
    """
    import pandas as pd
    from pyspark.sql import Window
    from pyspark.sql import types as T

    s = F.struct(*keys).alias("_s")  # null keys are equal in a struct
    m = manual.select(s, F.col("turn_idx").cast("long").alias("turn_idx"), F.col("pos").cast("long").alias("pos"), "word")
    w = timed.select(s, F.col("word_idx").cast("long").alias("word_idx"), "word", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    kind = m.schema["_s"]
    names = ["_s", "turn_idx", "pos", "word", "start", "end"]
    schema = T.StructType([kind, *[T.StructField(n, t) for n, t in zip(names[1:], (T.LongType(), T.LongType(), T.StringType(), T.DoubleType(), T.DoubleType()))]])

    def align(batches: Iterator) -> Iterator:
        """Each gap on its own; rows come in the order of groups, gaps, sides and places, and are taken some thousand at a time."""
        import pyarrow as pa

        def made(t: pa.Table) -> list:
            first, gap, side = (t.column(c).to_numpy() for c in ("_first", "_gap", "_side"))
            words, times = t.column("word").to_pylist(), np.column_stack([t.column(c).to_numpy() for c in ("start", "end")])
            got = np.full((len(t), 2), np.nan)
            group = np.cumsum(first == 1)
            starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (gap[1:] != gap[:-1]) | (side[1:] != side[:-1])))
            ends = np.append(starts[1:], len(t))
            # A stretch of manual words and the timed ones of its gap, if there are any, right behind it.
            both = np.flatnonzero((side[starts[:-1]] == 0) & (side[starts[1:]] == 1) & (group[starts[:-1]] == group[starts[1:]]) & (gap[starts[:-1]] == gap[starts[1:]]))
            for a0, b0, b1 in zip(*(v.tolist() for v in (starts[both], ends[both], ends[both + 1] if len(both) else both))):
                for i, j, n in match_words(words[a0:b0], words[b0:b1], gram):
                    got[a0 + i : a0 + i + n] = times[b0 + j : b0 + j + n]
            own = pa.array(np.flatnonzero(side == 0))
            got = got[side == 0]
            cells = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in got.T]
            return pa.Table.from_arrays([*[t.column(c).take(own) for c in names[:4]], *cells], names=names).to_batches()

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < 10_000:
                continue
            t = pa.Table.from_batches(held)
            at = np.flatnonzero(t.column("_first").to_numpy() == 1)
            if len(at) and at[-1]:  # the last group may go on
                yield from made(t.slice(0, at[-1]))
                t = t.slice(at[-1])
            held, n = t.to_batches(), len(t)
        if n:
            yield from made(pa.Table.from_batches(held))

    def by_group(a: DataFrame, b: DataFrame) -> DataFrame:
        """Sides with _gap, dealt by session and by stretches of some thousand gaps, so that a long session's gaps are spread over tasks."""
        null = lambda kind_, *cs: [F.lit(None).cast(kind_).alias(c) for c in cs]
        left = a.select("_s", "_gap", F.lit(0).alias("_side"), "turn_idx", "pos", "word", *null("double", "start", "end"))
        right = b.select("_s", "_gap", F.lit(1).alias("_side"), F.col("word_idx").alias("turn_idx"), *null("long", "pos"), "word", "start", "end")
        order = [F.col(c).asc_nulls_last() for c in ("_gap", "_side", "turn_idx", "pos", "word", "start", "end")]
        w = Window.partitionBy("_s", F.floor(F.col("_gap") / 2000)).orderBy(*order)
        return left.unionByName(right).withColumn("_first", F.row_number().over(w)).mapInArrow(align, schema)

    out = lambda d: d.select(*[F.col("_s")[k].alias(k) for k in keys], *names[1:])
    at_once = lambda d: d.withColumn("_gap", F.lit(0).cast("long"))
    sizes = m.groupBy("_s").count().unionByName(w.groupBy("_s").count()).groupBy("_s").agg(F.max("count").alias("_n"))
    long = _kept(sizes.filter(F.col("_n") > whole).select("_s"))
    if long.isEmpty():
        return out(by_group(at_once(m), at_once(w)))
    short = by_group(at_once(m.join(long, "_s", "left_anti")), at_once(w.join(long, "_s", "left_anti")))

    numbered = lambda d, at, *order: _kept(d.join(long, "_s", "left_semi").withColumn(at, F.row_number().over(Window.partitionBy("_s").orderBy(*order)).cast("long")))
    a, b = numbered(m, "_i", "turn_idx", "pos", "word"), numbered(w, "_j", "word_idx", "word", "start", "end")
    blocks = T.StructType([kind, T.StructField("_span", T.LongType()), T.StructField("_i", T.LongType()), T.StructField("_j", T.LongType()), T.StructField("_size", T.LongType())])

    def in_one_order(anchors: DataFrame, size: int) -> DataFrame:
        """(_s, _i, _j) of the words matched by anchors (_s, _i, _j) of size words."""

        def chain(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
            d = d.sort_values("_i")
            made = pd.DataFrame(matched_blocks(d["_i"].to_numpy(), d["_j"].to_numpy(), size), columns=["_i", "_j", "_size"])
            made["_size"] = np.minimum(made["_size"], (key[1] + 1) * span - made["_i"])  # no block reaches into the next span
            made.insert(0, "_s", [key[0]] * len(made))
            made.insert(1, "_span", key[1])
            return made

        def best(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
            """Of a session's spans those that follow each other on both sides with the most words."""
            from bisect import bisect_left

            d = d.sort_values("_span").reset_index(drop=True)
            tops: list[tuple[int, int, int]] = []  # (where it ends, words, the last span's row) of chains, longer ones end later
            before = []
            for k, (lo, hi, n) in enumerate(zip(d["_lo"].tolist(), d["_hi"].tolist(), d["_n"].tolist())):
                at = bisect_left(tops, (lo + 1,))
                before.append(tops[at - 1][2] if at else -1)
                total = n + (tops[at - 1][1] if at else 0)
                at = bisect_left(tops, (hi,))
                if not at or tops[at - 1][1] < total:
                    tops[at:] = [(hi, total, k), *[t for t in tops[at:] if t[1] > total]]
            keep, k = [], tops[-1][2] if tops else -1
            while k >= 0:
                keep.append(k)
                k = before[k]
            return d.loc[keep, ["_s", "_span"]]

        found = _kept(anchors.groupBy("_s", F.floor(F.col("_i") / span).alias("_span")).applyInPandas(chain, blocks))
        ends = found.groupBy("_s", "_span").agg(F.min("_j").alias("_lo"), F.max(F.col("_j") + F.col("_size")).alias("_hi"), F.sum("_size").alias("_n"))
        kept = ends.groupBy("_s").applyInPandas(best, T.StructType([kind, T.StructField("_span", T.LongType())]))
        pairs = found.join(kept, ["_s", "_span"]).select("_s", "_i", "_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1)).alias("_k"))
        return pairs.select("_s", (F.col("_i") + F.col("_k")).alias("_i"), (F.col("_j") + F.col("_k")).alias("_j"))

    def once(d: DataFrame, at: str) -> DataFrame:
        parts = [F.col("word")]
        for k in range(1, gram):
            parts += [F.lit("\x1f"), F.lead("word", k).over(Window.partitionBy("_s").orderBy(at))]
        grams = d.select("_s", at, F.concat(*parts).alias("_gram")).filter("_gram is not null")
        return grams.groupBy("_s", "_gram").agg(F.count("*").alias("_n"), F.min(at).alias(at)).filter("_n = 1").drop("_n")

    def with_gaps(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        # Matched words are as many on both sides before a gap, so their number names the gap.
        gap = lambda other, at: F.count(other).over(Window.partitionBy("_s").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)).alias("_gap")
        return a.join(pairs, ["_s", "_i"], "left").select("*", gap("_j", "_i")), b.join(pairs, ["_s", "_j"], "left").select("*", gap("_i", "_j"))

    pairs = _kept(in_one_order(once(a, "_i").join(once(b, "_j"), ["_s", "_gram"]).select("_s", "_i", "_j"), gram))
    while True:
        x, y = with_gaps(pairs)
        # Words left between two anchors that stand in the same gap on the other side too; no others can be matched.
        on = ["_s", "_gap", "word"]
        open_ = x.filter("_j is null").drop("_j"), y.filter("_i is null").drop("_i")
        open_ = [d.join(other.select(*[F.col(c).alias(c) for c in on]).distinct(), on, "left_semi") for d, other in zip(open_, reversed(open_))]
        crowded = open_[0].groupBy("_s", "_gap").count().unionByName(open_[1].groupBy("_s", "_gap").count()).groupBy("_s", "_gap").agg(F.max("count").alias("_n"))
        crowded = _kept(crowded.filter(F.col("_n") > whole).select("_s", "_gap"))
        if crowded.isEmpty():
            break
        # The first anchor of a gap's words can always be kept, so each round leaves fewer.
        nth = lambda d, at: d.select(*on, at).join(crowded, ["_s", "_gap"], "left_semi").withColumn("_nth", F.row_number().over(Window.partitionBy(*on).orderBy(at)))
        anchors = nth(open_[0], "_i").join(nth(open_[1], "_j"), [*on, "_nth"]).select("_s", "_i", "_j")
        pairs = _kept(pairs.unionByName(in_one_order(anchors, 1)))
    sure = x.filter("_j is not null").join(y.filter("_i is not null").select("_s", "_gap", "start", "end"), ["_s", "_gap"]).select(*names)
    rest = by_group(open_[0].drop("_i"), open_[1].drop("_j"))
    none = x.filter("_j is null").join(open_[0].select("_s", F.col("_i")), ["_s", "_i"], "left_anti")
    none = none.select("_s", "turn_idx", "pos", "word", *[F.lit(None).cast("double").alias(c) for c in ("start", "end")])
    return out(short.unionByName(sure).unionByName(rest).unionByName(none))


def nearest(vectors: DataFrame, item: str, vector: str, targets: DataFrame, target: str, target_vector: str, block: int = 1024) -> DataFrame:
    """(item, best, best_sim, second_sim, margin) against a set of target vectors. Targets are counted first and go in blocks of about so many, each one row's array."""
    pairs = F.collect_list(F.struct(F.col(target).alias("t"), F.col(target_vector).alias("v"))).alias("_all")
    blocks = -(-targets.count() // block)
    by_sim = lambda d: F.array_sort(F.transform("_all", lambda x: F.struct((-cosine(F.col(vector), x["v"])).alias("d"), x["t"].alias("t"))))
    if blocks <= 1:
        d = vectors.crossJoin(targets.agg(pairs))  # one row
        d = d.select(item, by_sim(d).alias("_s"))
    else:
        parts = targets.groupBy(F.pmod(F.xxhash64(target), F.lit(blocks)).alias("_b")).agg(pairs)
        dealt = vectors.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        each = dealt.join(parts, "_b")
        best = each.select(item, F.explode(F.slice(by_sim(each), 1, 2)).alias("_s"))
        d = best.groupBy(item).agg(F.sort_array(F.collect_list("_s")).alias("_s"))  # two of each block
    s = F.col("_s")
    return d.select(item, s[0]["t"].alias("best"), (-s[0]["d"]).alias("best_sim"), (-F.get(s, 1)["d"]).alias("second_sim"), (F.get(s, 1)["d"] - s[0]["d"]).alias("margin"))
