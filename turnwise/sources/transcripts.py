"""Transcript, subtitle, log and table sources, and sinks.

Files are read by Spark's own readers, so any file system works and large folders are spread over tasks. Lines of a file keep
their order by position; nothing depends on the order of tasks.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_quotes, clock_seconds, norm_word, tokens
from ..operators.tables import require_columns

#: Speaker-line patterns: any label, numbered speakers only, numbered speakers in optional brackets.
LOOSE = r"^(?i)([A-Z0-9_\s]+):\s*(.*)$"
STRICT = r"^(SPEAKER_\d+):\s*(.*)$"
MANUAL = r"^\[?(SPEAKER_\d+)\]?:\s*(.*)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, each read whole: a transcript is one session."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def parse_lines(lines: DataFrame, keys: list[str], line_no: str = "line_no", line: str = "line", speaker_re: str = STRICT, header: str = "strict", clean: bool = False, drop_empty: bool = False) -> DataFrame:
    """Turns (keys, turn_idx, question, speaker, text) of transcript lines.

    header 'strict' takes Question_<n> only (so a turn that says the word stays), 'spaced' also 'Question n', 'loose' any line with the word.
    question is the number of the last header before a turn, 0 before the first. Other lines are left out.
    """
    pattern = {"strict": r"Question_(\d+)", "spaced": r"Question[_\s]*(\d+)", "loose": r"Question\D*(\d+)"}[header]
    text = F.col(line)
    is_header = F.contains(text, F.lit("Question")) if header == "loose" else text.rlike(pattern)
    number = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    said = F.trim(F.regexp_extract(text, speaker_re, 2))
    run = Window.partitionBy(*keys).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("question", F.coalesce(F.last(F.when(is_header, number), ignorenulls=True).over(run), F.lit(0)))
    turns = d.filter(~is_header & text.rlike(speaker_re)).select(*keys, line_no, "question", F.trim(F.regexp_extract(text, speaker_re, 1)).alias("speaker"), (clean_quotes(said) if clean else said).alias("text"))
    if drop_empty:
        turns = turns.filter("text <> ''")
    return turns.withColumn("turn_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(line_no)) - 1).drop(line_no)


def session_of(path: Column) -> dict[str, Column]:
    """Columns read from a path: dyad_id (dyad<n>_<n>), pair_id, condition (the file's folder), stem."""
    name = F.element_at(F.split(path, "/"), -1)
    return {
        "dyad_id": F.nullif(F.regexp_extract(name, r"(dyad\d+_\d+)", 1), F.lit("")),
        "pair_id": F.nullif(F.regexp_extract(name, r"dyad(\d+)", 1), F.lit("")).cast("bigint"),
        "condition": F.lower(F.element_at(F.split(path, "/"), -2)),
        "stem": F.regexp_replace(name, r"\.[^.]*$", ""),
    }


def read_transcripts(spark: SparkSession, path: str, speaker_re: str = STRICT, header: str = "strict", **options) -> DataFrame:
    """Turns of all transcript files under path, with dyad_id, pair_id and condition."""
    turns = parse_lines(read_lines(spark, path), ["file"], speaker_re=speaker_re, header=header, **options)
    return turns.withColumns({k: c for k, c in session_of(F.col("file")).items() if k != "stem"})


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(file, dyad_id, pair_id, condition, stem) of files under path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    return files.withColumns(session_of(F.col("file")))


def match_files(transcripts: DataFrame, media: DataFrame, suffixes: tuple[str, ...] = ("", "_16k")) -> DataFrame:
    """transcripts (stem) with the best media file: an equal stem, then a stem with a suffix, then one that starts with it. None: null."""
    t = transcripts.select("stem").distinct()
    wanted = t.select("stem", F.explode(F.array(*[F.struct(F.concat("stem", F.lit(s)).alias("m"), F.lit(i).alias("rank")) for i, s in enumerate(suffixes)])).alias("_w")).select("stem", "_w.*")
    exact = media.select(F.col("stem").alias("m"), F.col("file").alias("media")).join(wanted, "m").select("stem", "media", "rank")
    # Each media stem under all its beginnings, the best file of each: an equi-join finds those that start with a stem of any length.
    starts = media.select(F.col("file").alias("media"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("stem"), F.lit(1))), lambda n: F.substring("stem", F.lit(1), n))).alias("stem"))
    loose = starts.groupBy("stem").agg(F.min("media").alias("media")).join(t, "stem").select("stem", "media", F.lit(len(suffixes)).alias("rank"))
    best = exact.union(loose).groupBy("stem").agg(F.min_by("media", F.struct("rank", "media")).alias("media"))
    return transcripts.join(best, "stem", "left")


def parse_cues(files: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """(keys, cue_idx, start, end, speaker, text) of subtitle texts: blank lines end cues, number lines and <u> tags go, [SPEAKER_nn]: is split off (null if absent)."""
    blocks = files.select(*keys, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), r"\n\s*\n")).alias("cue_idx", "_b"))
    time = r"(\d+:\d+:\d+[,.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+)[^\n]*"
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("_b"), time, ""), r"(?m)^\s*\d+\s*$", ""), r"</?u>", ""))
    body = F.trim(F.regexp_replace(body, r"\s*\n\s*", " "))
    d = blocks.filter(F.col("_b").rlike(time)).select(*keys, "cue_idx", clock_seconds(F.regexp_extract("_b", time, 1)).alias("start"), clock_seconds(F.regexp_extract("_b", time, 2)).alias("end"), body.alias("_t"))
    who = r"^\[?(SPEAKER_\d+)\]?:\s*"
    return d.select(*keys, "cue_idx", "start", "end", F.nullif(F.regexp_extract("_t", who, 1), F.lit("")).alias("speaker"), F.regexp_replace("_t", who, "").alias("text"))


def parse_word_cues(files: DataFrame, keys: list[str], text: str = "value", last_word: float = 0.30) -> DataFrame:
    """(keys, word_idx, word, start, end): the highlighted (<u>) word of each cue; a repeat within 1 ms is dropped, a word ends where the next begins if that is later."""
    blocks = files.select(*keys, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), r"\n\s*\n")).alias("_c", "_b"))
    words = blocks.select(*keys, "_c", clock_seconds(F.regexp_extract("_b", r"(\S+)\s*-->", 1)).alias("start"), clock_seconds(F.regexp_extract("_b", r"-->\s*(\S+)", 1)).alias("_e"), F.posexplode(F.regexp_extract_all("_b", F.lit("<u>(.*?)</u>"))).alias("_i", "_w"))
    words = words.withColumn("word", norm_word(F.col("_w"))).filter("word <> '' and start is not null")
    w = Window.partitionBy(*keys).orderBy("_c", "_i")
    before = F.lag(F.struct("word", "start")).over(w)
    words = words.withColumn("_p", before).filter(F.col("_p").isNull() | (F.col("_p.word") != F.col("word")) | (F.col("start") - F.col("_p.start") >= 0.001))
    after = F.lead("start").over(w)
    end = F.when(after.isNull(), F.greatest(F.col("_e"), F.col("start") + last_word)).when(after > F.col("start"), after).otherwise(F.col("_e"))
    return words.select(*keys, (F.row_number().over(w) - 1).alias("word_idx"), "word", "start", end.alias("end"))


def read_srt_cues(spark: SparkSession, path: str) -> DataFrame:
    return parse_cues(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")), ["file"])


def read_srt_words(spark: SparkSession, path: str) -> DataFrame:
    return parse_word_cues(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")), ["file"])


def manual_words(turns: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, turn_idx, pos, word): the normalised words of turns, for alignment."""
    return turns.select(*keys, F.col("turn_idx").cast("long").alias("turn_idx"), F.posexplode(tokens(F.col(text))).alias("pos", "_w")).select(*keys, "turn_idx", F.col("pos").cast("long").alias("pos"), norm_word(F.col("_w")).alias("word")).filter("word <> ''")


def read_log(spark: SparkSession, path: str, key: str = "Dyad ID") -> DataFrame:
    """An experiment's log (CSV with a header, all strings): rows without a key go, keys are trimmed."""
    log = require_columns(spark.read.csv(path, header=True), key)
    return log.na.drop(subset=[key]).withColumn(key, F.trim(key))


def read_table(spark: SparkSession, path: str, required: list[str], schema: str | None = None, format: str = "parquet") -> DataFrame:
    """A typed table; missing columns are an error before any job."""
    reader = spark.read.format(format)
    if schema:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.option("header", "true")
    return require_columns(reader.load(path), *required)


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] = (), mode: str = "overwrite") -> None:
    """A stage's table; partition_by gives a folder for each key, so later reads prune by it."""
    writer = df.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_metadata(spark: SparkSession, metadata: dict, path: str) -> None:
    """A run's settings and results as one JSON row."""
    spark.createDataFrame([(json.dumps(metadata, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
