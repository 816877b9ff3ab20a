"""The given tables in the shapes that the operators read, as DataFrames and as DuckDB views of equal content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def turns(self) -> DataFrame:
        c = self.table("conversations").filter(F.col("role").isin("user", "assistant"))
        return c.select(
            F.col("conv_id").alias("session"), F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.col("conv_id") % 2).alias("condition"), F.col("turn").alias("turn_idx"),
            (F.floor(F.col("turn") / 2) + 1).alias("question"), F.when(F.col("role") == "user", "A").otherwise("B").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"),
        )

    def lines(self) -> DataFrame:
        """Transcript lines: a header before each even turn, then 'SPEAKER_nn: text' without line breaks."""
        c = self.table("conversations")
        head = F.when(F.col("turn") % 2 == 0, F.struct((F.col("turn") * 2).alias("line_no"), F.concat(F.lit("Question_"), (F.floor(F.col("turn") / 2) + 1).cast("string")).alias("line")))
        who = F.when(F.col("role") == "user", "SPEAKER_00").when(F.col("role") == "assistant", "SPEAKER_01").otherwise("MODERATOR")
        said = F.struct((F.col("turn") * 2 + 1).alias("line_no"), F.concat(who, F.lit(": "), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ")).alias("line"))
        return c.select(F.col("conv_id").alias("session"), F.explode(F.array_compact(F.array(head, said))).alias("l")).select("session", "l.*")

    def log(self) -> DataFrame:
        """One row a pair: role columns c0_00, c0_01, c1_00, c1_01 and ord."""
        p = self.turns().select("pair_id").distinct()
        role = lambda k: F.when((F.col("pair_id") + k) % 2 == 0, "A").otherwise("B")
        return p.select("pair_id", (F.col("pair_id") % 2).alias("ord"), role(0).alias("c0_00"), role(1).alias("c0_01"), role(1).alias("c1_00"), role(0).alias("c1_01"))

    def prosody(self, *more: str) -> DataFrame:
        """more: columns of events that stay."""
        e = self.table("events")
        return e.select(
            "event_id", F.col("user_id").alias("session"), F.floor(F.col("user_id") / 2).alias("pair_id"), (F.col("user_id") % 2).alias("condition"),
            F.when(F.col("event_type").isin("click", "view"), "A").otherwise("B").alias("speaker"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t_start"),
            F.col("value").alias("f0"), F.log1p("value").alias("lev"), F.get_json_object("props", "$.k").cast("double").alias("rate"), "event_type", *more,
        )

    def cues(self) -> DataFrame:
        return self.prosody().select("session", "event_id", "speaker", F.col("t_start").alias("start"), (F.col("t_start") + F.col("f0") * 60).alias("end"), F.col("event_type").alias("text"), "f0", "lev", "rate")

    def floor(self) -> DataFrame:
        p = self.prosody()
        return p.select("session", "event_id", "t_start", F.when(F.col("rate") % 2 == 0, "A").otherwise("B").alias("speaker"), F.col("event_type").alias("text"), "f0", "lev", "rate")

    def voice(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select("vec_id", F.floor(F.col("label") / 2).alias("session"), F.col("label").cast("long").alias("speaker"), F.when(F.col("vec_id") % 5 == 0, 1).otherwise(2).alias("question"), (1.0 + F.col("vec_id") % 3).alias("dur"), F.col("embedding").alias("vec"))

    def annotated(self) -> DataFrame:
        n, t = F.length("text"), F.col("turn_idx")
        pick = lambda x, *names: F.element_at(F.array(*[F.lit(v) for v in names]), (x % len(names) + 1).cast("int"))
        return self.turns().withColumns({
            "depth": pick(n, "deep", "moderate", "surface"), "stance": pick(n, "agree", "neutral"), "on_topic": pick(n + t, "yes", "partial", "no"), "is_question": (n % 5 == 0),
            "self_disclosure": pick(n, "personal", "none", "none", "factual"), "responsive": pick(n + t, "true", "false"), "epistemic": pick(n, "hedge", "hedge", "certain", "neutral", "neutral", "neutral", "neutral"),
            "sentiment": ((n % 3) - 1).cast("double"),
        })

    def replies(self) -> DataFrame:
        """A JSON reply for each batch of eight turns; each fifth is cut short, each seventh fenced. Some entries lack on_topic, some responsive."""
        from pyspark.sql import Window

        a = self.annotated().withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("turn_idx")) - 1)
        one = F.concat(F.lit('{"i":'), (F.col("n") % 8).cast("string"), F.lit(',"d":"'), F.col("depth"), F.lit('","st":"'), F.col("stance"), F.lit('"'), F.when(F.col("n") % 3 == 0, F.lit(',"ot":"no"')).otherwise(""), F.when(F.col("n") % 4 == 1, F.lit(',"ra":"false"')).otherwise(""), F.lit("}"))
        b = a.groupBy("session", F.floor(F.col("n") / 8).alias("batch")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("o")))), lambda x: x["o"]), ",").alias("o"))
        whole = F.concat(F.lit("["), "o", F.lit("]"))
        key = F.col("session")
        return b.select("session", "batch", F.when(key % 5 == 0, F.concat(F.lit("["), "o", F.lit(',{"i":9,"d":"de'))).when(key % 7 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole).alias("reply"))

    def session_features(self) -> DataFrame:
        o, i = self.table("orders"), self.table("lineitem")
        d = i.join(o.select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
        return d.groupBy(F.col("o_custkey").alias("pair_id"), F.col("o_orderstatus").alias("condition")).agg(
            (F.avg("l_extendedprice") / 7.0).alias("va_price"), F.avg("l_quantity").alias("va_qty"), (F.avg("l_discount") / 7.0).alias("disc_mean"), F.max("l_tax").alias("tax_asym"), F.count("*").cast("double").alias("n_items")
        )

    def outcomes(self) -> DataFrame:
        o = self.table("orders").groupBy(F.col("o_custkey").alias("pair_id")).agg(F.avg("o_totalprice").alias("avg_total"), F.max("o_totalprice").alias("max_total"))
        c = self.table("customer")
        return c.select(F.col("c_custkey").alias("pair_id"), F.col("c_acctbal").alias("acct"), F.col("c_mktsegment").isin("BUILDING", "FURNITURE").cast("int").alias("grp"), (F.col("c_nationkey") % 2).cast("double").alias("ord")).join(o, "pair_id")

    def entities(self) -> DataFrame:
        from .operators.session import collapse

        return self.outcomes().join(collapse(self.session_features(), "pair_id"), "pair_id")

    def with_constants(self) -> DataFrame:
        return self.entities().withColumns({"fixed": F.lit(1.0), "sparse": F.when(F.col("pair_id") % 5 < 2, F.col("acct"))})

    def scales(self) -> DataFrame:
        """Participants (orders) with items item_1 .. item_7 of line numbers, code 3 as missing."""
        i = self.table("lineitem").groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_linenumber") == k, F.col("l_quantity").cast("int") % 4)).alias(f"item_{k}") for k in range(1, 8)])
        o = self.table("orders")
        return o.select("o_orderkey", F.col("o_custkey").alias("pair_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("grp")).join(i, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


#: DuckDB tokens of a text.
TOK = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"
SQL_VIEWS = {
    "v_turns": "select conv_id as session, conv_id // 2 pair_id, conv_id % 2 as condition, turn turn_idx, turn // 2 + 1 question, case role when 'user' then 'A' else 'B' end speaker, coalesce(text, '') text from conversations where role in ('user', 'assistant')",
    "v_lines": "select conv_id as session, turn * 2 line_no, 'Question_' || (turn // 2 + 1) line from conversations where turn % 2 = 0 union all select conv_id, turn * 2 + 1, case role when 'user' then 'SPEAKER_00' when 'assistant' then 'SPEAKER_01' else 'MODERATOR' end || ': ' || replace(coalesce(text, ''), chr(10), ' ') from conversations",
    "v_log": "select pair_id, pair_id % 2 ord, case when pair_id % 2 = 0 then 'A' else 'B' end c0_00, case when pair_id % 2 = 0 then 'B' else 'A' end c0_01, case when pair_id % 2 = 0 then 'B' else 'A' end c1_00, case when pair_id % 2 = 0 then 'A' else 'B' end c1_01 from (select distinct conv_id // 2 pair_id from conversations where role in ('user', 'assistant'))",
    "v_prosody": "select event_id, user_id as session, user_id // 2 pair_id, user_id % 2 as condition, case when event_type in ('click', 'view') then 'A' else 'B' end speaker, epoch(ts)::double t_start, value f0, ln(1 + value) lev, json_extract(props, '$.k')::double rate, event_type from events",
    "v_cues": "select user_id as session, event_id, case when event_type in ('click', 'view') then 'A' else 'B' end speaker, epoch(ts)::double as start, epoch(ts)::double + value * 60 as \"end\", event_type as text, value f0, ln(1 + value) lev, json_extract(props, '$.k')::double rate from events",
    "v_floor": "select user_id as session, event_id, epoch(ts)::double t_start, case when json_extract(props, '$.k')::bigint % 2 = 0 then 'A' else 'B' end speaker, event_type as text, value f0, ln(1 + value) lev, json_extract(props, '$.k')::double rate from events",
    "v_voice": "select vec_id, (label // 2)::bigint as session, label::bigint speaker, case when vec_id % 5 = 0 then 1 else 2 end question, 1.0 + vec_id % 3 dur, embedding vec from embeddings",
    "v_annot": "select *, ['deep', 'moderate', 'surface'][length(text) % 3 + 1] depth, ['agree', 'neutral'][length(text) % 2 + 1] stance, ['yes', 'partial', 'no'][(length(text) + turn_idx) % 3 + 1] on_topic, length(text) % 5 = 0 is_question, ['personal', 'none', 'none', 'factual'][length(text) % 4 + 1] self_disclosure, ['true', 'false'][(length(text) + turn_idx) % 2 + 1] responsive, ['hedge', 'hedge', 'certain', 'neutral', 'neutral', 'neutral', 'neutral'][length(text) % 7 + 1] epistemic, (length(text) % 3 - 1)::double sentiment from v_turns",
    "v_sess": "select o_custkey pair_id, o_orderstatus as condition, avg(l_extendedprice) / 7.0 va_price, avg(l_quantity) va_qty, avg(l_discount) / 7.0 disc_mean, max(l_tax) tax_asym, count(*)::double n_items from lineitem join orders on l_orderkey = o_orderkey group by 1, 2",
    "v_out": "select c_custkey pair_id, c_acctbal acct, (c_mktsegment in ('BUILDING', 'FURNITURE'))::int grp, (c_nationkey % 2)::double ord, avg_total, max_total from customer join (select o_custkey, avg(o_totalprice) avg_total, max(o_totalprice) max_total from orders group by 1) on o_custkey = c_custkey",
    "v_coll": "select pair_id, avg(va_price) va_price, avg(va_qty) va_qty, avg(disc_mean) disc_mean, avg(tax_asym) tax_asym, avg(n_items) n_items from v_sess group by 1",
    "v_ent": "select v_out.*, va_price, va_qty, disc_mean, tax_asym, n_items from v_out join v_coll using (pair_id)",
    "v_const": "select *, 1.0::double fixed, case when pair_id % 5 < 2 then acct end sparse from v_ent",
    "v_scales": "select o_orderkey, o_custkey pair_id, case when o_orderstatus = 'F' then 1 else 2 end grp, " + ", ".join(f"item_{k}" for k in range(1, 8)) + " from orders join (select l_orderkey, " + ", ".join(f"max(case when l_linenumber = {k} then l_quantity::int % 4 end) item_{k}" for k in range(1, 8)) + " from lineitem group by 1) on l_orderkey = o_orderkey",
}
_NEEDS = {"v_annot": ["v_turns"], "v_coll": ["v_sess"], "v_ent": ["v_sess", "v_coll", "v_out"], "v_const": ["v_sess", "v_coll", "v_out", "v_ent"]}


def with_views(names: str, *more: str) -> str:
    """'with v_a as (...), ...' of the named views and what they need, and further (name, sql) parts as written."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    return "with " + ", ".join([f"{n} as ({SQL_VIEWS[n]})" for n in order] + list(more)) + " "
