"""Streaming twins: new transcripts once each, gap-merged talk, running switch counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.transcripts import session_of


def ingest_transcripts(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of (file, value, dyad_id, pair_id, condition): each new file once, as the query's checkpoint remembers."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").load(path)
    return files.select("value", F.col("_metadata.file_path").alias("file")).withColumns({k: c for k, c in session_of(F.col("file")).items() if k != "stem"})


def run_once(stream: DataFrame, out: str, checkpoint: str, format: str = "parquet", mode: str = "append"):
    """Processes what there is and stops; a later call goes on from the checkpoint."""
    return stream.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> tuple[DataFrame, int]:
    """Processes what there is in micro-batches, then gives (what they put out, with their number as batch; how many rows came too late for the watermark).

    State is kept by RocksDB, whose checkpoints hold changes and whose working set needn't fit in memory; the session's own setting is left as it was.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:  # a query takes its settings when it starts
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    finally:
        spark.conf.set(_STORE, before)
    query.awaitTermination()
    late = sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)
    return spark.read.parquet(out), late


def session_merge(cues: DataFrame, keys: list[str], ts: str, gap: str, speaker: str = "speaker", late: str = "1 hour") -> DataFrame:
    """(keys, speaker, t_start, t_end, n_cues): bursts of one speaker's cues no more than gap apart; t_end is the last cue's time and gap.

    In append mode a burst comes out once, when the watermark (late behind the newest cue) has passed its end, and its state goes; cues older than the watermark of the micro-batch before are
    dropped and counted by run_batches. Unlike the batch operator, another speaker's cue in between does not end a burst: only the gap does.
    """
    d = cues.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    merged = d.groupBy(*keys, speaker, F.session_window(ts, gap).alias("_w")).agg(F.count("*").alias("n_cues"))
    return merged.select(*keys, speaker, F.col("_w.start").alias("t_start"), F.col("_w.end").alias("t_end"), "n_cues")


_TOTALS = "n_turns long, n_switch long, n_late long, sum_gap double, n_pairs long, mean_a double, mean_b double, s_aa double, s_bb double, s_ab double, at long, tie long, speaker string, value double, timer long"


class SwitchTotals(StatefulProcessor):
    """Running totals of a session's turns: a row of typed state for each session, and one event-time timer that ends it.

    A call to the state is a round trip to Spark, so a micro-batch makes two for a session: the timer stays as it was first set and, when it fires, is set
    again if turns have come since.
    """

    def __init__(self, key: str, tie: str, speaker: str, value: str, expire_ms: int):
        self.key, self.columns, self.expire_ms = key, ("_at", tie, speaker, value), expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.totals = handle, handle.getValueState("totals", _TOTALS)

    def _row(self, key: tuple, t: list, ended: bool) -> Row:
        n_turns, n_switch, n_late, gap, n, _, _, aa, bb, ab = t[:10]
        r = ab / math.sqrt(aa * bb) if n >= 4 and aa > 0 and bb > 0 else None
        return Row(**{self.key: key[0]}, n_turns=n_turns, n_switch=n_switch, n_late=n_late, sum_gap=gap, n_pairs=n, synchrony=r, ended=ended)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        t = list(self.totals.get() or [0, 0, 0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None, None, None, None])
        for at, tie, speaker, value in sorted((tuple(r[c] for c in self.columns) for r in rows), key=lambda r: r[:2]):
            t[0] += 1
            if t[10] is not None and (at, tie) < (t[10], t[11]):
                t[2] += 1  # a turn whose place has passed counts, but makes no pair
                continue
            if t[12] is not None and speaker != t[12]:
                t[1] += 1
                a, b = t[13], value
                if a is not None and b is not None and a == a and b == b:
                    t[3] += abs(b - a)
                    t[4] += 1
                    da, db = a - t[5], b - t[6]
                    t[5] += da / t[4]
                    t[6] += db / t[4]
                    t[7] += da * (a - t[5])
                    t[8] += db * (b - t[6])
                    t[9] += da * (b - t[6])
            t[10:14] = at, tie, speaker, value
        if t[14] is None:
            t[14] = t[10] // 1000 + self.expire_ms
            self.handle.registerTimer(t[14])
        self.totals.update(tuple(t))
        yield self._row(key, t, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if not (t := list(self.totals.get() or [])):
            return
        due = t[10] // 1000 + self.expire_ms
        if due > t[14] and due >= timerValues.getCurrentWatermarkInMs():
            t[14] = due
            self.handle.registerTimer(due)
            self.totals.update(tuple(t))
        else:
            self.totals.clear()
            yield self._row(key, t, True)


def switch_state(turns: DataFrame, key: str, ts: str, tie: str, speaker: str, value: str, late: str = "1 hour", expire_ms: int = 86_400_000) -> DataFrame:
    """(key, n_turns, n_switch, n_late, sum_gap, n_pairs, synchrony, ended): running totals by session as turns arrive, from a few numbers of state a session.

    A pair is a turn and its predecessor of another speaker, both with a value; their co-moments are updated pair by pair, and synchrony is their correlation (null below four pairs or without
    spread). Turns of one micro-batch are put in order by (ts, tie). A turn older than the last one seen counts as a turn and as late, but makes no pair; one older than the watermark (late behind the
    newest turn of the micro-batch before) is dropped. When the watermark passes a session's last turn by expire_ms, its row comes out once more with ended, and its state goes. Turns without a time are left out.
    """
    d = turns.select(key, F.col(ts).cast("timestamp").alias(ts), F.col(tie).cast("long").alias(tie), F.col(speaker).cast("string").alias(speaker), F.col(value).cast("double").alias(value)).filter(F.col(ts).isNotNull()).withColumn("_at", F.unix_micros(ts))
    fields = [T.StructField(c, T.LongType()) for c in ("n_turns", "n_switch", "n_late")] + [T.StructField("sum_gap", T.DoubleType()), T.StructField("n_pairs", T.LongType()), T.StructField("synchrony", T.DoubleType()), T.StructField("ended", T.BooleanType())]
    out = T.StructType([d.schema[key], *fields])
    return d.withWatermark(ts, late).groupBy(key).transformWithState(SwitchTotals(key, tie, speaker, value, expire_ms), out, "Update", "EventTime")
