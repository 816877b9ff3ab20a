"""Chat formatting: every assistant turn becomes an example of its own, with all preceding turns as context.

A turn is written <s>[INST] role [/INST]\\n text </s>. A control string inside a role or text gets a backslash after
its first character (one more if it has some), which reading back takes off again. Only the reply of an example is
under the loss mask, given as the character range [loss_start, loss_start + loss_length) of formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]\n", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2"), r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*)(/?s>)", "<$1$2"), r"\[\\(\\*)(/?INST\])", "[$1$2")


def chat_examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, n_examples, formatted, loss_start, loss_length): one row for each assistant turn.

    Turns that follow the last reply, or stand in a conversation without one, come in a last example without a loss (null
    loss_start), so no turn is lost. Null roles and texts are empty; turns of equal number are ordered by role and text; a
    null conversation id is a conversation. The size of a conversation's examples grows with the square of its turns, as
    the expansion is defined; they are made one row at a time from the conversation's own array.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    written = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body"))).alias("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: (F.get(F.col("turns"), k - 1)["role"] == "assistant") | (k == F.size("turns")))
    exploded = written.withColumn("ends", ends).select("conv_id", "turns", F.size("ends").alias("n_examples"), F.posexplode("ends").alias("example", "upto"))
    last = F.get(F.col("turns"), F.col("upto") - 1)
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("upto") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    made = exploded.select("conv_id", "example", "n_examples", before.alias("before"), last.alias("last"))
    reply = F.col("last.role") == "assistant"
    return made.select(
        "conv_id",
        "example",
        "n_examples",
        F.concat("before", "last.head", "last.body", F.lit(CLOSE)).alias("formatted"),
        F.when(reply, F.length("before") + F.length("last.head")).cast("long").alias("loss_start"),
        F.when(reply, F.length("last.body")).cast("long").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example: array of {role, text}, unescaped."""
    pieces = F.split(formatted, CLOSE)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"), unescape(F.substr(p, F.position(F.lit(MIDDLE), p) + len(MIDDLE))).alias("text")))


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    return F.when(start.isNotNull(), unescape(F.substr(formatted, (start + 1).cast("int"), length.cast("int"))))


def chat_digest(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the examples."""
    is_last = F.col("example") == F.col("n_examples") - 1
    turns = F.when(is_last, read_turns(F.col("formatted")))
    read = examples.select("conv_id", "example", F.length("formatted").cast("long").alias("chars"), read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"), turns.alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "example", "chars", "loss", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.col("turns").isNotNull().alias("whole"))
    one = read.groupBy("conv_id").agg(
        F.max(F.when(F.col("whole"), F.col("n_turns"))).alias("n_turns"),
        F.max(F.when(F.col("whole"), F.col("turns_sha256"))).alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("_loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return one.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op8_sql() -> str:
    esc = lambda c: rf"regexp_replace(regexp_replace({c}, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"
    frame = len(OPEN) + len(MIDDLE) + len(CLOSE)
    return f"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
k as (select *, row_number() over w i, count(*) over (partition by conv_id) n, length({esc("r")}) + length({esc("t")}) + {frame} chars from c window w as (partition by conv_id order by turn, r, t)),
s as (select *, sum(chars) over (partition by conv_id order by i) upto from k)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by i)) turns_sha256,
coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(t, '' order by i) filter (r = 'assistant'), '')) loss_sha256,
(sum(upto) filter (r = 'assistant' or i = n))::bigint formatted_chars from s group by conv_id"""
