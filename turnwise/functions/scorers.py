"""Hooks for outside models: functions on batches of texts, vectors or prompts, and native defaults.

A hook is called once for each Arrow batch, inside the tasks; what it loads it should keep in a module-level cache, so that a worker
loads it once. A batch that fails gets default values instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import clean_quotes, repair_json_array

#: Labels of a batch reply by short key: (column, default of the first profile, default of the second). Fixed values.
LABELS = {
    "d": ("depth", "surface", "surface"), "st": ("stance", "neutral", "neutral"), "y": ("verbal_agreement", "none", "none"), "ot": ("on_topic", "yes", "partial"), "q": ("is_question", "false", "false"),
    "sd": ("self_disclosure", "none", "none"), "ra": ("responsive", "true", "false"), "s": ("sentiment", "neutral", "neutral"), "ep": ("epistemic", "neutral", "neutral"), "cv": ("convergence", "neutral", "neutral"),
}
REPLY = "array<struct<i:int,d:string,st:string,y:string,ot:string,q:string,sd:string,ra:string,s:string,ep:string,cv:string>>"


def apply_batches(df: DataFrame, fn: Callable, inputs: list[str], out: str, kind: str, batch: int = 8, default=None, errors: str | None = None) -> DataFrame:
    """df with out = fn(list of input rows), batch rows a call. An input is a value, or a tuple with several columns.

    errors: a column for what went wrong with a row's batch; null where nothing did.
    """
    made = [T.StructField(out, T._parse_datatype_string(kind)), *([T.StructField(errors, T.StringType())] if errors else [])]
    schema = T.StructType([*[f for f in df.schema if f.name not in (out, errors)], *made])
    names = [f.name for f in schema if f.name not in (out, errors)]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for d in frames:
            values: list = []
            wrong: list = []
            for lo in range(0, len(d), batch):
                part = d.iloc[lo : lo + batch]
                rows = part[inputs[0]].tolist() if len(inputs) == 1 else list(part[inputs].itertuples(index=False, name=None))
                try:
                    got = list(fn(rows))
                    if len(got) != len(rows):
                        raise ValueError(f"{len(got)} results for {len(rows)} rows")
                    values += got
                    wrong += [None] * len(rows)
                except Exception as error:  # a hook's own; see errors
                    values += [default] * len(rows)
                    wrong += [f"{type(error).__name__}: {error}"] * len(rows)
            d = d[names].copy()
            d[out] = pd.Series(values, index=d.index, dtype=object)
            if errors:
                d[errors] = pd.Series(wrong, index=d.index, dtype=object)
            yield d

    return df.mapInPandas(run, schema)


def score_text(df: DataFrame, fn: Callable, text: str = "text", out: str = "sentiment", batch: int = 8) -> DataFrame:
    """A text classifier's signed scores."""
    return apply_batches(df, fn, [text], out, "double", batch)


def encode_text(df: DataFrame, fn: Callable, text: str = "text", out: str = "vector", batch: int = 8) -> DataFrame:
    """A sentence encoder's vectors."""
    return apply_batches(df, lambda rows: [[float(x) for x in v] for v in fn(rows)], [text], out, "array<double>", batch)


def embed_segments(df: DataFrame, fn: Callable, inputs: list[str], out: str = "vector", batch: int = 8) -> DataFrame:
    """A speaker model's vectors of (samples, start, end) rows."""
    return apply_batches(df, lambda rows: [[float(x) for x in v] for v in fn(rows)], inputs, out, "array<double>", batch)


def lexicon_sentiment(words: Column, positive: list[str], negative: list[str]) -> Column:
    """The default scorer: (positive - negative) / words, in the JVM; 0 without words."""
    score = F.size(F.filter(words, lambda w: w.isin(*positive))) - F.size(F.filter(words, lambda w: w.isin(*negative)))
    return F.coalesce(score / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


def annotation_batches(turns: DataFrame, keys: list[str], index: str = "turn_idx", speaker: str = "speaker", text: str = "text", size: int = 8, context: int = 2) -> DataFrame:
    """(keys, batch, first_idx, n, prior, numbered): batches of size turns; prior are the texts of the context turns before a batch.

    lag() looks back over the session's order, so no batch is joined with its predecessor.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    line = F.concat_ws(": ", F.col(speaker), clean_quotes(F.coalesce(F.col(text), F.lit(""))))
    d = turns.withColumns({"_n": F.row_number().over(w) - 1, "_line": line}).withColumn("batch", F.floor(F.col("_n") / size))
    prior = F.array_compact(F.array(*[F.lag("_line", k).over(w) for k in range(context, 0, -1)]))
    d = d.withColumn("_prior", prior)
    item = F.struct("_n", index, "_line", "_prior")
    b = d.groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(item)).alias("_rows"))  # size rows at most
    numbered = F.array_join(F.transform("_rows", lambda r, i: F.concat(i.cast("string"), F.lit(". "), r["_line"])), "\n")
    first = F.col("_rows")[0]
    return b.select(*keys, "batch", first[index].alias("first_idx"), F.size("_rows").alias("n"), F.array_join(first["_prior"], "\n").alias("prior"), numbered.alias("numbered"))


def prompts(batches: DataFrame, instruction: str, question: str | None = None) -> DataFrame:
    """batches with prompt: instruction, question context, prior turns and numbered turns, as far as there are any."""
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), c))
    pieces = [F.lit(instruction)] + ([part("Question", F.col(question).cast("string"))] if question else []) + [part("Before", F.col("prior")), part("Turns", F.col("numbered"))]
    return batches.withColumn("prompt", F.concat_ws("\n\n", *pieces))


def annotate(batches: DataFrame, fn: Callable[[list[str]], list[str]], batch: int = 1) -> DataFrame:
    """batches (prompt) with the annotator's reply text; null where it failed."""
    return apply_batches(batches, fn, ["prompt"], "reply", "string", batch)


def parse_replies(turns: DataFrame, replies: DataFrame, keys: list[str], size: int = 8, index: str = "turn_idx", reply: str = "reply", profile: int = 1) -> DataFrame:
    """turns with the labels of their batch's reply; a missing or broken reply, entry or field gives the profile's default."""
    w = Window.partitionBy(*keys).orderBy(index)
    t = turns.withColumn("_n", F.row_number().over(w) - 1).withColumns({"batch": F.floor(F.col("_n") / size), "_i": F.col("_n") % size})
    rows = replies.select(*keys, "batch", F.explode(F.from_json(repair_json_array(F.col(reply)), REPLY)).alias("r"))
    rows = rows.filter("r.i is not null").groupBy(*keys, "batch", F.col("r.i").alias("_i")).agg(F.first("r").alias("r"))
    d = t.join(rows, [*keys, "batch", "_i"], "left").drop("_n", "_i")
    labels = {name: F.coalesce(F.col(f"r.{k}"), F.lit(pair[profile - 1])) for k, (name, *pair) in LABELS.items()}
    return d.withColumns({**labels, "is_question": labels["is_question"] == "true"}).drop("r", "batch")


def rate_conversations(turns: DataFrame, keys: list[str], fn: Callable[[list[str]], list[str]], index: str = "turn_idx", speaker: str = "speaker", text: str = "text") -> DataFrame:
    """(keys, engagement, reason, dominant_speaker) of each whole conversation; a failed or broken reply gives 'medium', '', 'balanced'."""
    line = F.concat_ws(": ", F.col(speaker), clean_quotes(F.coalesce(F.col(text), F.lit(""))))
    whole = turns.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index, line.alias("_l")))), lambda r: r["_l"]), "\n").alias("prompt"))
    got = annotate(whole, fn)
    r = F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), "engagement string, reason string, dominant_speaker string")
    d = got.withColumn("_r", r)
    return d.select(*keys, F.coalesce("_r.engagement", F.lit("medium")).alias("engagement"), F.coalesce("_r.reason", F.lit("")).alias("reason"), F.coalesce("_r.dominant_speaker", F.lit("balanced")).alias("dominant_speaker"))
