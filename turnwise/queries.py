"""One query for each operator over the given tables, with DuckDB SQL of equal meaning where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numeric as N
from .functions import scorers as H
from .functions import text as X
from .operators import ranges as R
from .operators import ranks as K
from .operators import sequence as Q
from .operators import session as S
from .operators import tables as B
from .plans import grouped as G
from .plans import resample as P
from .plans import stats as A
from .sources import transcripts as IO
from .views import TOK, Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDER = ["t_start", "event_id"]
FEATURES = ["va_price", "va_qty", "disc_mean", "tax_asym", "n_items"]
OUTCOMES = ["acct", "avg_total", "max_total"]
LEXICONS = {"i": ["the", "of", "and"], "we": ["to", "in", "a"]}
BACKCHANNELS = ["yes", "ok", "right", "mm"]


def query(name: str, sql: str | None = None, r: str = ""):
    """Registers a query; the columns named in r are rounded to 6 places on both sides."""
    columns = r.split()

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + 0.0 for c in columns}) if columns else df

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"select * replace ({', '.join(f'round({c}::double, 6) + 0.0 as {c}' for c in columns)}) from ({sql})" if columns else sql
        return fn

    return register


def t_p_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t with whole degrees of freedom, by its finite sums."""
    c, s = f"({df} / ({df} + {t} * {t}))", f"(abs({t}) / sqrt({df} + {t} * {t}))"
    even = f"{s} * list_sum(list_transform(range(({df} / 2)::bigint), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0)) * {c} ** j))"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {s} * sqrt({c}) * coalesce(list_sum(list_transform(range((({df} - 1) / 2)::bigint), lambda j: exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5)) * {c} ** j)), 0))"
    return f"(1 - case when {df} % 2 = 0 then {even} else {odd} end)"


def bh_sql(src: str, p: str = "p") -> str:
    """All of src with p_fdr, Benjamini and Hochberg's adjusted p."""
    return f"select * exclude (bh_r, bh_n), min(least(1, {p} * bh_n / bh_r)) over (order by bh_r desc) p_fdr from (select *, row_number() over (order by {p}) bh_r, count(*) over () bh_n from ({src}))"


def long(name: str):
    return F.col(name).cast("long").alias(name)


# --- sources and sinks -------------------------------------------------------------------------------------------------

_PARSED = """
l as (select *, regexp_extract(line, 'Question_(\\d+)', 1) qn from v_lines),
f as (select *, coalesce(last_value(nullif(qn, '')::int ignore nulls) over (partition by session order by line_no rows between unbounded preceding and current row), 0) question from l)"""
_TURNS_SQL = """select session, (row_number() over (partition by session order by line_no) - 1)::bigint turn_idx, question::int question, trim(regexp_extract(line, '{re}', 1)) speaker, trim(regexp_extract(line, '{re}', 2)) as text from f where {not_header} and regexp_matches(line, '{re}')"""


def _parsed(t: Tables, **o) -> DataFrame:
    return IO.parse_lines(t.lines(), ["session"], **o).select("session", long("turn_idx"), "question", "speaker", "text")


@query("src_transcript", with_views("v_lines", _PARSED.replace("Question_(", "Question\\D*(")) + _TURNS_SQL.format(re=r"^([A-Za-z0-9_\s]+):\s*(.*)$", not_header="not contains(line, 'Question')"))
def _(t):
    return _parsed(t, speaker_re=IO.LOOSE, header="loose")


@query("src_transcript_strict", with_views("v_lines", _PARSED) + _TURNS_SQL.format(re=r"^(SPEAKER_\d+):\s*(.*)$", not_header="not regexp_matches(line, 'Question_\\d+')").replace(" as text from f", " as text from f") .replace("trim(regexp_extract(line, '^(SPEAKER_\\d+):\\s*(.*)$', 2)) as text", "regexp_replace(trim(regexp_extract(line, '^(SPEAKER_\\d+):\\s*(.*)$', 2)), '[^\\x00-\\x7F]', '?', 'g') as text"))
def _(t):
    return _parsed(t, clean=True)


@query("src_transcript_manual", with_views("v_lines", _PARSED.replace("Question_(", "Question[_\\s]*(")) + _TURNS_SQL.format(re=r"^\[?(SPEAKER_\d+)\]?:\s*(.*)$", not_header="not regexp_matches(line, 'Question[_\\s]*\\d+')") + " and trim(regexp_extract(line, '^\\[?(SPEAKER_\\d+)\\]?:\\s*(.*)$', 2)) <> ''")
def _(t):
    return _parsed(t, speaker_re=IO.MANUAL, header="spaced", drop_empty=True)


def _cue_files(t: Tables) -> DataFrame:
    """Subtitle texts, one a user, made of the events: a cue for each event, its type the highlighted word."""
    clock = F.concat(F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss"), F.lit(","), F.date_format(F.col("ts").cast("timestamp"), "SSS"))
    e = t.table("events").withColumn("day", F.to_date(F.col("ts").cast("timestamp")))
    cue = F.concat(clock, F.lit(" --> "), clock, F.lit("\n["), F.when(F.col("event_type").isin("click", "view"), "SPEAKER_00").otherwise("SPEAKER_01"), F.lit("]: so <u>"), F.col("event_type"), F.lit("</u> then"))
    return e.groupBy("user_id", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", cue.alias("c")))), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["c"])), "\n\n").alias("value"))


_CLOCK = "extract(hour from ts) * 3600 + extract(minute from ts) * 60 + (extract(microseconds from ts) // 1000) / 1000.0"


@query("src_srt_cues", f"select user_id, ts::date as day, (row_number() over (partition by user_id, ts::date order by ts, event_id) - 1)::int cue_idx, ({_CLOCK})::double as start, ({_CLOCK})::double as \"end\", case when event_type in ('click', 'view') then 'SPEAKER_00' else 'SPEAKER_01' end speaker, 'so ' || event_type || ' then' as text from events", r='start "end"'.replace('"', ""))
def _(t):
    return IO.parse_cues(_cue_files(t), ["user_id", "day"])


ORACLES["src_srt_cues"] = ORACLES["src_srt_cues"].replace("round(end::double, 6) + 0.0 as end", 'round("end"::double, 6) + 0.0 as "end"')


@query(
    "src_srt_words",
    f"""with c as (select user_id, ts::date as day, ts, event_id, event_type word, ({_CLOCK})::double s from events),
    p as (select *, lag(word) over w pw, lag(s) over w ps from c window w as (partition by user_id, day order by ts, event_id)),
    k as (select *, lead(s) over w nx, row_number() over w - 1 i from p where pw is null or pw <> word or s - ps >= 0.001 window w as (partition by user_id, day order by ts, event_id))
    select user_id, day, i::int word_idx, word, round(s, 6) + 0.0 as start, round(case when nx is null then s + 0.3 when nx > s then nx else s end, 6) + 0.0 as "end" from k""",
)
def _(t):
    d = IO.parse_word_cues(_cue_files(t), ["user_id", "day"])
    return d.withColumns({c: F.round(c, 6) + 0.0 for c in ("start", "end")})


@query("src_log", with_views("v_log") + "select pair_id::bigint pair_id, ord::bigint ord, c0_00 from v_log where c0_00 is not null")
def _(t):
    return t.log().na.drop(subset=["c0_00"]).select(long("pair_id"), long("ord"), F.trim("c0_00").alias("c0_00"))


@query("src_csv_tables", "select c_custkey, c_acctbal from customer")
def _(t):
    return IO.read_table(t.spark, f"{t.sf_dir}/customer.parquet", ["c_custkey", "c_acctbal"]).select("c_custkey", "c_acctbal")


def _new_folder(t: Tables) -> str:
    """A folder in the shared checkpoint folder (a temporary one in local sessions)."""
    import os
    import tempfile
    import uuid

    sc = t.spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="turnwise-")
    return os.path.join(base, f"table-{uuid.uuid4().hex}")


def _round_trip(t: Tables, df: DataFrame, **o) -> DataFrame:
    """Written to the shared checkpoint folder and read again."""
    path = _new_folder(t)
    IO.write_table(df, path, **o)
    reader = t.spark.read.format(o.get("format", "parquet"))
    return reader.load(path)


@query("src_log_csv", "select c_custkey, o_custkey::varchar dyad_id, c_mktsegment as segment from customer join (select distinct o_custkey from orders) on o_custkey = c_custkey")
def _(t):
    # A log with a row for each customer; who never ordered has no dyad, and its row goes.
    seen = t.table("orders").select("o_custkey").distinct()
    log = t.table("customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit("  ")).alias("Dyad ID"), F.col("c_mktsegment").alias("segment"))
    path = _new_folder(t)
    log.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return IO.read_log(t.spark, path).select(long("c_custkey"), F.col("Dyad ID").alias("dyad_id"), "segment")


@query("src_csv_typed", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice::double o_totalprice, o_orderdate::date as o_orderdate from orders", r="o_totalprice")
def _(t):
    path = _new_folder(t)
    o = t.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.to_date("o_orderdate").alias("o_orderdate"))
    IO.write_table(o, path, format="csv")
    return IO.read_table(t.spark, path, o.columns, ", ".join(f"{c} {kind}" for c, kind in o.dtypes), "csv")


@query("src_discover", "select user_id, 'dyad' || user_id || '_' || (user_id % 9) dyad_id, user_id::bigint pair_id, case when user_id % 2 = 0 then 'piper' else 'cloudy' end as condition from (select distinct user_id from events)")
def _(t):
    path = F.concat(F.lit("/data/"), F.when(F.col("user_id") % 2 == 0, "Piper").otherwise("Cloudy"), F.lit("/dyad"), F.col("user_id").cast("string"), F.lit("_"), (F.col("user_id") % 9).cast("string"), F.lit("_x.txt"))
    d = t.table("events").select("user_id").distinct().withColumn("file", path)
    return d.withColumns(IO.session_of(F.col("file"))).select("user_id", "dyad_id", "pair_id", "condition")


@query("src_match_files", "select p_partkey, case when p_partkey % 3 = 0 then 'm' || p_partkey || '.wav' when p_partkey % 3 = 1 then 'm' || p_partkey || '_16k.wav' end media from part")
def _(t):
    p = t.table("part").select("p_partkey", F.concat(F.lit("m"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("stem"))
    k = F.col("p_partkey") % 3
    media = p.filter(k < 2).select(F.when(k == 0, F.col("stem")).otherwise(F.concat("stem", F.lit("_16k"))).alias("stem"), F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.when(k == 0, ".wav").otherwise("_16k.wav")).alias("file"))
    return IO.match_files(p, media).select("p_partkey", "media")


@query("src_incremental", with_views("v_turns") + "select session, turn_idx from v_turns where session % 2 = 1 union all select session, turn_idx from v_turns where session % 2 = 0")
def _(t):
    done = t.turns().filter("session % 2 = 0").select("session", "turn_idx")
    return B.with_cache(done, B.new_sessions(t.turns().select("session", "turn_idx"), done, ["session"]))


@query("src_limit", with_views("v_turns") + "select session, turn_idx from v_turns where session in (select distinct session from v_turns order by 1 limit 20)")
def _(t):
    return B.first_sessions(t.turns().select("session", "turn_idx"), ["session"], 20)


@query("sink_table", with_views("v_sess") + "select pair_id, condition, n_items from v_sess")
def _(t):
    return _round_trip(t, t.session_features().select("pair_id", "condition", "n_items"))


@query("sink_partitioned", with_views("v_sess") + "select pair_id, condition, n_items from v_sess")
def _(t):
    return _round_trip(t, t.session_features().select("pair_id", "condition", "n_items").repartition("condition"), partition_by=["condition"]).select("pair_id", "condition", "n_items")


@query("sink_json_meta", "select count(*) n_orders, min(o_custkey) first_key from orders")
def _(t):
    return _round_trip(t, t.table("orders").agg(F.count("*").alias("n_orders"), F.min("o_custkey").alias("first_key")), format="json")


@query("sink_json_metadata", "select count(*)::bigint n_orders, min(o_custkey)::bigint first_key, ['o_orderkey', 'o_custkey'] as columns from orders")
def _(t):
    row = t.table("orders").agg(F.count("*").alias("n_orders"), F.min("o_custkey").alias("first_key")).first()
    path = _new_folder(t)
    IO.write_metadata(t.spark, {**row.asDict(), "columns": ["o_orderkey", "o_custkey"]}, path)
    return t.spark.read.schema("n_orders long, first_key long, columns array<string>").json(path)


# --- projections, filters, checks --------------------------------------------------------------------------------------


@query("prj_pair_id", "select p_partkey, nullif(regexp_extract(case when p_partkey % 4 = 0 then p_name else 'dyad' || p_partkey || '_x' end, 'dyad(\\d+)', 1), '')::bigint pair_id from part")
def _(t):
    return t.table("part").select("p_partkey", X.pair_id(F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit("dyad"), F.col("p_partkey").cast("string"), F.lit("_x")))).alias("pair_id"))


@query("prj_dur_words", with_views("v_turns") + f"select session, turn_idx, len({TOK})::int n_words, round(length(text) / 15.0, 3)::double dur from v_turns", r="dur")
def _(t):
    return t.turns().select("session", "turn_idx", F.size(X.tokens(F.col("text"))).alias("n_words"), F.round(F.length("text") / 15.0, 3).alias("dur"))


@query("prj_order_flag", with_views("v_turns") + "select distinct session, (condition = 1)::int is_second from v_turns")
def _(t):
    return t.turns().select("session", (F.col("condition") == 1).cast("int").alias("is_second")).distinct()


@query("prj_prefix_columns", with_views("v_sess") + "select pair_id, condition, va_price, va_qty from v_sess", r="va_price va_qty")
def _(t):
    d = t.session_features()
    return d.select("pair_id", "condition", *B.prefixed(d, "va_"))


@query("prj_drop_columns", with_views("v_ent") + "select pair_id, acct, grp, ord from v_ent")
def _(t):
    return t.entities().drop(*FEATURES, "avg_total", "max_total", "no_such_column")


@query("prj_rename", with_views("v_sess") + "select pair_id, condition, va_price sem_price, n_items sem_n_items from v_sess", r="sem_price")
def _(t):
    return t.session_features().select("pair_id", "condition", "va_price", "n_items").withColumnsRenamed({"va_price": "sem_price", "n_items": "sem_n_items"})


def _z(c: str, fn: str = "stddev_samp") -> str:
    return f"(({c}) - avg({c}) over ()) / nullif({fn}({c}) over (), 0)"


@query("prj_composite_index", with_views("v_const", f"z as (select pair_id, {_z('tax_asym')} a, {_z('sparse')} b from v_const)") + "select pair_id, list_avg(list_filter([a, b], lambda x: x is not null)) idx from z", r="idx")
def _(t):
    return S.composite_index(t.with_constants(), ["tax_asym", "sparse", "not_there"], "idx").select("pair_id", "idx")


@query("prj_mean_asym", "select o_orderkey, (a + b) / 2.0 price_mean, abs(a - b) price_asym from (select o_orderkey, o_totalprice a, o_custkey * 10.0 b from orders)", r="price_mean price_asym")
def _(t):
    d = t.table("orders").select("o_orderkey", F.col("o_totalprice").alias("price_A"), (F.col("o_custkey") * 10.0).alias("price_B"))
    return S.mean_asym(d, ["price"]).select("o_orderkey", "price_mean", "price_asym")


@query("prj_label", "select distinct p_size, case when p_size % 3 = 0 then 'Asymmetry' when p_size % 3 = 1 then 'Mean Level' else 'Count/Rate' end kind, case when p_size / 500.0 < 0.001 then '***' when p_size / 500.0 < 0.01 then '**' when p_size / 500.0 < 0.05 then '*' when p_size / 500.0 < 0.1 then '†' else '' end star from part")
def _(t):
    name = F.concat(F.lit("f"), F.element_at(F.array(F.lit("_asym"), F.lit("_mean"), F.lit("_count")), (F.col("p_size") % 3 + 1).cast("int")))
    return t.table("part").select("p_size", X.feature_kind(name).alias("kind"), X.stars(F.col("p_size") / 500.0).alias("star")).distinct()


@query("flt_min_turn", with_views("v_cues") + "select session, event_id from v_cues where \"end\" - start >= 1800")
def _(t):
    return t.cues().filter(F.col("end") - F.col("start") >= 1800).select("session", "event_id")


@query("flt_valid_rows", with_views("v_const") + "select pair_id from v_const where sparse is not null and tax_asym is not null")
def _(t):
    return N.finite_columns(t.with_constants()).na.drop(subset=["sparse", "tax_asym"]).select("pair_id")


@query("flt_exclude_entity", with_views("v_ent") + "select pair_id from v_ent where pair_id not in (10, 11)")
def _(t):
    return t.entities().filter(~F.col("pair_id").isin(10, 11)).select("pair_id")


@query("flt_finite_pairs", "select event_id from events where value % 7 > 0 and isfinite(case when event_id % 5 = 0 then 'nan'::double else value end)")
def _(t):
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return t.table("events").filter((F.col("value") % 7 > 0) & N.finite(v).isNotNull()).select("event_id")


@query("flt_missing_columns", with_views("v_const") + "select pair_id, fixed, n_items from v_const", r="n_items")
def _(t):
    return B.drop_missing_columns(t.with_constants().select("pair_id", "fixed", "sparse", "n_items"), ["fixed", "sparse", "n_items"])


@query("flt_constant_columns", with_views("v_const") + "select pair_id, sparse, n_items from v_const", r="n_items")
def _(t):
    return B.drop_constant_columns(t.with_constants().select("pair_id", "fixed", "sparse", "n_items"), ["fixed", "sparse", "n_items"])


@query("flt_enroll_pool", with_views("v_voice") + "select vec_id from v_voice where question = 1 and dur >= 2")
def _(t):
    return t.voice().withColumn("coverage", F.lit(None).cast("double")).filter((F.col("question") == 1) & (F.col("dur") >= 2) & (F.coalesce("coverage", F.lit(1.0)) >= 0.5)).select("vec_id")


@query("flt_sparse_session", with_views("v_turns", "p as (select session, speaker, lag(speaker) over (partition by session order by turn_idx) prev from v_turns)", "c as (select session, count(*) n_turns, sum((prev <> speaker)::int) n from p group by 1)") + "select session, case when n >= 5 then n::double / n_turns end density from c", r="density")
def _(t):
    w = Q.in_order(["session"], ["turn_idx"])
    d = t.turns().withColumn("p", F.lag("speaker").over(w)).groupBy("session").agg(F.count("*").alias("n_turns"), F.sum((F.col("p") != F.col("speaker")).cast("int")).alias("n"))
    return d.select("session", F.when(F.col("n") >= 5, F.col("n") / F.col("n_turns")).alias("density"))


@query("flt_tests_min_n", with_views("v_sess") + "select pair_id, count(*) n, case when count(*) >= 3 then regr_slope(va_price, va_qty) end slope from v_sess group by 1", r="slope")
def _(t):
    return t.session_features().groupBy("pair_id").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.regr_slope("va_price", "va_qty")).alias("slope"))


@query("qc_required", "select l_orderkey, l_linenumber, l_quantity from lineitem")
def _(t):
    return B.require_columns(t.table("lineitem"), "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity")


@query("qc_monotonic", "with o as (select o_custkey, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) > o_totalprice bad from orders), s as (select o_custkey, coalesce(max(bad::int), 0) b from o group by 1) select count(*) n_sessions, sum(b)::bigint n_violating from s")
def _(t):
    return B.monotonic_violations(t.table("orders"), ["o_custkey"], ["o_orderkey"], "o_totalprice")


@query("qc_low_coverage", "select l_returnflag, avg((l_discount < 0.05)::int) low_rate from lineitem group by 1", r="low_rate")
def _(t):
    return t.table("lineitem").groupBy("l_returnflag").agg(F.avg((F.col("l_discount") < 0.05).cast("double")).alias("low_rate"))


@query("qc_unmapped_roles", "select count(distinct c_custkey) n_unmapped from customer left join (select distinct o_custkey from orders) on o_custkey = c_custkey where o_custkey is null")
def _(t):
    o = t.table("orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("A").alias("role")).distinct()
    return t.table("customer").join(o, "c_custkey", "left").filter("role is null").agg(F.countDistinct("c_custkey").alias("n_unmapped"))


@query("qc_fanout", "select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def _(t):
    return S.fan_out_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


# --- joins ---------------------------------------------------------------------------------------------------------------


@query("join_left_features", with_views("v_out v_coll") + "select v_out.pair_id, acct, va_price, n_items from v_out left join v_coll c using (pair_id)", r="va_price n_items")
def _(t):
    c = S.collapse(t.session_features(), "pair_id").withColumn("acct", F.lit(0.0))
    return S.merge_features(t.outcomes().select("pair_id", "acct"), c.select("pair_id", "acct", "va_price"), c.select("pair_id", "n_items"), key="pair_id")


_LONG_LOG = "ll as (select pair_id, 0 as condition, 'A' speaker, c0_00 as role from v_log union all select pair_id, 0, 'B', c0_01 from v_log union all select pair_id, 1, 'A', c1_00 from v_log union all select pair_id, 1, 'B', c1_01 from v_log)"


def _roles(t: Tables) -> DataFrame:
    return S.unpivot_log(t.log(), ["pair_id"], {"c0_00": (0, "A"), "c0_01": (0, "B"), "c1_00": (1, "A"), "c1_01": (1, "B")})


@query("join_roles", with_views("v_turns v_log", _LONG_LOG) + "select session, turn_idx, role from v_turns left join ll using (pair_id, condition, speaker)")
def _(t):
    return S.attach_roles(t.turns(), _roles(t), ["pair_id", "condition"]).select("session", "turn_idx", "role")


@query("join_log_left", with_views("v_turns v_log") + "select session, count(*) n_turns, any_value(v_log.ord)::bigint ord, any_value(c0_00) c0_00 from v_turns left join v_log using (pair_id) group by 1")
def _(t):
    n = t.turns().groupBy("session", "pair_id").agg(F.count("*").alias("n_turns"))
    return n.join(t.log(), "pair_id", "left").select("session", "n_turns", long("ord"), "c0_00")


@query("join_inner_outcomes", with_views("v_out v_coll") + "select pair_id, va_price, acct from v_coll join v_out using (pair_id)", r="va_price")
def _(t):
    return S.collapse(t.session_features(), "pair_id").select("pair_id", "va_price").join(t.outcomes().select("pair_id", "acct"), "pair_id")


@query("join_multi_inner", with_views("v_out v_coll") + "select c.pair_id, va_price, acct, n.n_orders from v_coll c join v_out using (pair_id) join (select o_custkey pair_id, count(*) n_orders from orders group by 1) n using (pair_id)", r="va_price")
def _(t):
    n = t.table("orders").groupBy(F.col("o_custkey").alias("pair_id")).agg(F.count("*").alias("n_orders"))
    return S.collapse(t.session_features(), "pair_id").select("pair_id", "va_price").join(t.outcomes().select("pair_id", "acct"), "pair_id").join(n, "pair_id")


@query("join_covariates", with_views("v_out v_scales", "p as (select pair_id, count(*) n_participants, avg(item_1) item_1_mean from v_scales where grp = 1 group by 1)") + "select v_out.pair_id, acct, n_participants, item_1_mean from v_out left join p using (pair_id)", r="item_1_mean")
def _(t):
    c = t.scales().filter("grp = 1").groupBy("pair_id").agg(F.count("*").alias("n_participants"), F.avg("item_1").alias("item_1_mean"))
    wanted = [x for x in ("n_participants", "item_1_mean", "not_there") if x in c.columns]
    return t.outcomes().select("pair_id", "acct").join(c.select("pair_id", *wanted), "pair_id", "left")


@query("join_vocal_dyad", with_views("v_out v_sess") + "select v_out.pair_id, v_sess.condition, va_price, (v_sess.condition = 'F')::int is_f from v_out join v_sess using (pair_id)", r="va_price")
def _(t):
    return t.outcomes().select("pair_id").join(t.session_features().select("pair_id", "condition", "va_price"), "pair_id").withColumn("is_f", (F.col("condition") == "F").cast("int"))


_WINDOWS = "w as (select session, min(start) + 86400 t0, min(start) + 172800 t1 from v_cues group by 1)"


@query("interval_overlap", with_views("v_cues", _WINDOWS) + "select c.session, event_id from v_cues c join w on c.session = w.session and c.\"end\" > t0 and c.start < t1")
def _(t):
    w = t.cues().groupBy("session").agg((F.min("start") + 86400).alias("t0"), (F.min("start") + 172800).alias("t1"))
    return R.overlap_join(t.cues(), w, ["session"], ("start", "end"), ("t0", "t1"), 21600.0).select("session", "event_id")


@query("point_in_interval", with_views("v_cues", "p as (select session, event_id pid, start + 900 t from v_cues)") + "select p.session, pid, arg_min(c.speaker, row(c.start, c.\"end\")) speaker from p left join v_cues c on p.session = c.session and c.start <= t and t < c.\"end\" group by 1, 2")
def _(t):
    p = t.cues().select("session", F.col("event_id").alias("pid"), (F.col("start") + 900).alias("t"))
    return R.first_interval(p, t.cues().select("session", "start", "end", "speaker"), ["session"], "t", ("start", "end"), ["pid"], "speaker", 7200.0)


_SWITCH = "sw as (select session, t_start boundary from (select *, lag(speaker) over (partition by session order by t_start, event_id) prev from v_prosody) where prev <> speaker)"


@query("edge_window", with_views("v_prosody", _SWITCH) + "select sw.session, boundary, count(*) filter (p.t_start < boundary) n_before, count(*) filter (p.t_start >= boundary) n_after, avg(lev) filter (p.t_start < boundary) before, avg(lev) filter (p.t_start >= boundary) after from sw join v_prosody p on p.session = sw.session and p.t_start >= boundary - 43200 and p.t_start < boundary + 43200 group by 1, 2", r="boundary before after")
def _(t):
    sw = Q.switch_pairs(t.prosody(), ["session"], ORDER, "speaker", []).select("session", F.col("t_start").alias("boundary"))
    return R.edge_means(t.prosody().select("session", F.col("t_start").alias("t"), "lev"), sw, ["session"], "t", "boundary", "lev", 43200.0)


@query("seq_align")
def _(t):
    words = IO.manual_words(t.turns(), ["session"])
    w = Window.partitionBy("session").orderBy("turn_idx", "pos")
    # The recogniser's words: all but the shortest, which it tends to miss.
    timed = words.withColumn("word_idx", F.row_number().over(w) - 1).filter(F.length("word") > 2).select("session", "word_idx", "word", (F.col("word_idx") * 0.4).alias("start"), (F.col("word_idx") * 0.4 + 0.3).alias("end"))
    return S.turn_spans(R.align_words(words, timed, ["session"]), ["session"], "turn_idx")


_SIDED = "x as (select session, speaker, f0 v from v_prosody where f0 is not null)"


@query("cross_pairs", with_views("v_prosody", _SIDED) + "select a.session, avg(abs(a.v - b.v)) mean_distance from x a join x b on a.session = b.session and a.speaker = 'A' and b.speaker = 'B' group by 1", r="mean_distance")
def _(t):
    d = t.prosody().withColumn("side", (F.col("speaker") == "B").cast("int"))
    return Q.all_pairs_distance(d, ["session"], "side", "f0").filter("n0 > 0 and n1 > 0").select("session", "mean_distance")


@query("cross_pairs_sampled", with_views("v_prosody", _SIDED) + "select a.session, count(distinct a.event_id) n0, count(distinct b.event_id) n1, 200 * least(count(distinct a.event_id), count(distinct b.event_id)) n_pairs, avg(abs(a.v - b.v)) expected, true near from (select session, event_id, v from x where speaker = 'A') a join (select session, event_id, v from x where speaker = 'B') b on a.session = b.session group by 1".replace("x where", "(select session, speaker, event_id, f0 v from v_prosody where f0 is not null) where"), r="expected")
def _(t):
    # The draws can't be followed by SQL; their mean must lie within five standard errors of the exact one.
    d = t.prosody().withColumn("side", (F.col("speaker") == "B").cast("int"))
    drawn = Q.sampled_pairs_distance(d, ["session"], "side", "f0", ["event_id"]).filter("n0 > 0 and n1 > 0")
    exact = Q.all_pairs_distance(d, ["session"], "side", "f0").select("session", F.col("mean_distance").alias("expected"))
    near = F.abs(F.col("mean_distance") - F.col("expected")) <= 5 * F.coalesce("sd", F.lit(0.0)) / F.sqrt("n_pairs") + 1e-9
    return drawn.join(exact, "session").select("session", "n0", "n1", long("n_pairs"), "expected", near.alias("near"))


_PAIRS = "p as (select session, t_start, event_id, lag(speaker) over w prev, speaker, lag(f0) over w a, f0 b from v_prosody window w as (partition by session order by t_start, event_id)), k as (select *, row_number() over (partition by session order by t_start, event_id) k from p where prev <> speaker and a is not null and b is not null)"
_DRAWN = "ids as (select session, row_number() over (order by session) - 1 i from k group by session), m as (select count(*) m from ids), dr as (select d.range id, (d.range * 104729) % m x, (d.range * 7919) % (m - 1) y from range(2000) d, m), pr as (select id, a.session s, b.session o from dr join ids a on a.i = x join ids b on b.i = y + (y >= x)::int)"
_PSEUDO = "ps as (select pr.id, s, o, count(*) n, corr(x.a, y.b) r from pr join k x on x.session = s join k y on y.session = o and y.k = x.k group by 1, 2, 3 having count(*) >= 4)"


def _pseudo_pairs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The operator's 2,000 pseudo pairs, drawn among all sessions by a rule that SQL can follow."""
    draws = t.spark.range(2000).select("id", (F.col("id") * 104729).alias("x"), (F.col("id") * 7919).alias("y"))
    return P.surrogate_pairs(t.prosody(), ["session"], ORDER, "speaker", "f0", draws=draws)


@query("pseudo_pairs", with_views("v_prosody", _PAIRS, _DRAWN, _PSEUDO) + "select id, s, o, n, r from ps where r is not null and not isnan(r)", r="r")
def _(t):
    return _pseudo_pairs(t)[1].select("id", F.col("s.session").alias("s"), F.col("o.session").alias("o"), "n", F.col("synchrony").alias("r"))


@query("semi_isin", "select event_id from events where event_type in ('error', 'signup')")
def _(t):
    return t.table("events").filter(F.col("event_type").isin("error", "signup")).select("event_id")


@query("anti_processed", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def _(t):
    return t.table("customer").select("c_custkey").join(t.table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


_LINE = "speaker || ': ' || regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')"
_BATCHES = f"n as (select *, row_number() over (partition by session order by turn_idx) - 1 n, {_LINE} l from v_turns), g as (select session, n // 4 batch, n % 4 i, turn_idx, l, lag(l, 2) over w l2, lag(l, 1) over w l1 from n window w as (partition by session order by turn_idx))"


@query("batch_context", with_views("v_turns", _BATCHES) + "select session, batch::bigint batch, min(turn_idx) first_idx, count(*)::int n, array_to_string(list_filter([any_value(l2) filter (i = 0), any_value(l1) filter (i = 0)], lambda x: x is not null), chr(10)) prior from g group by 1, 2")
def _(t):
    return H.annotation_batches(t.turns(), ["session"], size=4).select("session", "batch", "first_idx", "n", "prior")


# --- aggregations --------------------------------------------------------------------------------------------------------

_STRUCT = [
    f"t as (select *, {TOK} tok, lag(speaker) over (partition by session order by turn_idx) prev from v_turns)",
    "u as (select session, speaker, unnest(tok) w from t)",
    "d as (select session, speaker, count(distinct w)::double d, count(*)::double n, count(*) filter (w in ('the', 'of', 'and')) l1, count(*) filter (w in ('to', 'in', 'a')) l2 from u group by 1, 2)",
    "s as (select session, speaker, count(*) t, count(*) filter (contains(text, ',')) q, avg((trim(lower(trim(text)), '.,!?') in ('yes', 'ok', 'right', 'mm'))::int) bc from t group by 1, 2)",
    "x as (select session, count(*) total, sum((coalesce(prev, speaker) <> speaker)::int) sw from t group by 1)",
]
_STRUCT_SQL = """select x.session, total::bigint total_turns, coalesce(abs(a.n - b.n) / nullif(2 * (a.n + b.n), 0), 0) participation_gini, sw::double / total turn_taking_density,
coalesce(a.d / nullif(a.n, 0), 0) ttr_A, coalesce(b.d / nullif(b.n, 0), 0) ttr_B, a.l1 / greatest(1.0, a.n) i_rate_A, b.l1 / greatest(1.0, b.n) i_rate_B, a.l2 / greatest(1.0, a.n) we_rate_A, b.l2 / greatest(1.0, b.n) we_rate_B,
sa.q q_count_A, sb.q q_count_B, sa.bc bc_rate_A, sb.bc bc_rate_B from x join s sa on sa.session = x.session and sa.speaker = 'A' join s sb on sb.session = x.session and sb.speaker = 'B'
left join d a on a.session = x.session and a.speaker = 'A' left join d b on b.session = x.session and b.speaker = 'B'"""
_STRUCT_R = "participation_gini turn_taking_density ttr_A ttr_B i_rate_A i_rate_B we_rate_A we_rate_B bc_rate_A bc_rate_B"


def _structural(t: Tables) -> DataFrame:
    return S.structural_features(t.turns(), ["session"], LEXICONS, BACKCHANNELS, ["turn_idx"], role="speaker", question_mark=",")


query("agg_session_structural", with_views("v_turns", *_STRUCT) + _STRUCT_SQL, r=_STRUCT_R)(_structural)
for _name, _cols in {"agg_gini": "participation_gini", "agg_ttr": "ttr_A ttr_B", "agg_lexicon_rate": "i_rate_A i_rate_B we_rate_A we_rate_B", "agg_question_count": "q_count_A q_count_B", "agg_backchannel_rate": "bc_rate_A bc_rate_B", "agg_switch_density": "turn_taking_density"}.items():
    query(_name, f"select session, {', '.join(_cols.split())} from ({with_views('v_turns', *_STRUCT)}{_STRUCT_SQL})", r=_cols if "q_count" not in _cols else "")((lambda cols: lambda t: _structural(t).select("session", *cols.split()))(_cols))

_RATES = {"deep": ("depth", "deep"), "hedging": ("epistemic", "hedge"), "personal": ("self_disclosure", "personal"), "agree": ("stance", "agree"), "questions": ("is_question", "true"), "responsive": ("responsive", "true")}


@query("agg_label_rates", with_views("v_annot") + "select session, avg((depth = 'deep')::int) deep, avg((epistemic = 'hedge')::int) hedging, avg((self_disclosure = 'personal')::int) personal, avg((stance = 'agree')::int) agree, avg(is_question::int) questions, avg((responsive = 'true')::int) responsive, count(*) filter (on_topic = 'no') n_off from v_annot group by 1", r="deep hedging personal agree questions responsive")
def _(t):
    return S.label_rates(t.annotated(), ["session"], _RATES, {"n_off": ("on_topic", "no")})


@query("agg_rate_by_question", with_views("v_annot") + "select session, " + ", ".join(f"avg((on_topic = 'yes')::int) filter (question = {k}) on_topic_q{k}" for k in range(1, 6)) + " from v_annot group by 1", r=" ".join(f"on_topic_q{k}" for k in range(1, 6)))
def _(t):
    return S.rate_by_question(t.annotated(), ["session"], "on_topic", "yes", [1, 2, 3, 4, 5])


@query("agg_party_rates", with_views("v_annot", "e as (select session, speaker, avg((depth = 'deep')::int) deep, avg((epistemic = 'hedge')::int) hedging, count(*) n from v_annot group by 1, 2)") + "select session, avg(deep) deep_mean, max(deep) - min(deep) deep_asym, avg(hedging) hedging_mean, max(hedging) - min(hedging) hedging_asym, (max(n) - min(n)) / sum(n)::double turn_asym from e group by 1 having count(*) = 2", r="deep_mean deep_asym hedging_mean hedging_asym turn_asym")
def _(t):
    return S.party_rates(t.annotated(), ["session"], "speaker", {k: _RATES[k] for k in ("deep", "hedging")})


_SLOT = "('0x' || substr(md5(w), 1, 8))::ubigint % 64"


@query("agg_question_similarity", with_views("v_turns", f"w as (select session, question, speaker, unnest({TOK}) w from v_turns)", f"c as (select session, question, speaker, {_SLOT} k, count(*)::double n from w group by 1, 2, 3, 4)", "l as (select session, question, speaker, sqrt(sum(n * n)) len from c group by 1, 2, 3)", "d as (select a.session, a.question, sum(a.n * b.n) d from c a join c b on a.session = b.session and a.question = b.question and a.k = b.k and a.speaker = 'A' and b.speaker = 'B' group by 1, 2)", "q as (select a.session, a.question, coalesce(d, 0) / (a.len * b.len) s from l a join l b on a.session = b.session and a.question = b.question and a.speaker = 'A' and b.speaker = 'B' left join d on d.session = a.session and d.question = a.question)", "both_ as (select session, question from v_turns group by 1, 2 having count(distinct speaker) = 2)") + "select session, avg(s) semantic_similarity from both_ left join q using (session, question) group by 1", r="semantic_similarity")
def _(t):
    return S.question_similarity(t.turns(), ["session"], lambda c: S.hashed_counts(X.tokens(c)), ["turn_idx"])


@query("agg_sent_alignment", with_views("v_annot", "q as (select session, question, 1 - abs(avg(sentiment) filter (speaker = 'A') - avg(sentiment) filter (speaker = 'B')) / 2 a from v_annot group by 1, 2)") + "select session, avg(a) sent_alignment from q where a is not null group by 1", r="sent_alignment")
def _(t):
    return S.sentiment_alignment(t.annotated(), ["session"], "sentiment")


@query("agg_sent_synchrony", with_views("v_prosody", "k as (select session, speaker, lev, row_number() over (partition by session, speaker order by t_start, event_id) k from v_prosody)") + "select a.session, corr(a.lev, b.lev) sentiment_synchrony from k a join k b on a.session = b.session and a.k = b.k and a.speaker = 'A' and b.speaker = 'B' group by 1 having count(*) >= 4", r="sentiment_synchrony")
def _(t):
    return S.sentiment_synchrony(t.prosody(), ["session"], ORDER, "lev").filter("sentiment_synchrony is not null")


@query("agg_mean_sentiment", with_views("v_annot") + "select session, avg(sentiment) mean_sentiment from v_annot group by 1", r="mean_sentiment")
def _(t):
    return t.annotated().groupBy("session").agg(F.avg("sentiment").alias("mean_sentiment"))


@query("agg_turn_span", "with w as (select l_orderkey as session, l_linenumber turn, case when l_quantity > 25 then l_quantity end s, case when l_quantity > 25 then l_quantity + 1 end e from lineitem), t as (select session, turn, min(s) s, max(e) e, count(s)::double / count(*) coverage from w group by 1, 2), c as (select *, last_value(e ignore nulls) over (partition by session order by turn rows between unbounded preceding and current row) at_ from t) select session, turn, coalesce(s, at_, 0)::double t_start, coalesce(e, at_, 0)::double t_end, coverage from c", r="coverage")
def _(t):
    hit = F.col("l_quantity") > 25
    w = t.table("lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("turn"), F.when(hit, F.col("l_quantity")).alias("start"), F.when(hit, F.col("l_quantity") + 1).alias("end"))
    return S.turn_spans(w, ["session"], "turn")


@query("agg_collapse_mean", with_views("v_coll") + "select * from v_coll", r=" ".join(FEATURES))
def _(t):
    return S.collapse(t.session_features(), "pair_id")


@query("agg_first", "select o_custkey, arg_min(o_orderpriority, o_orderkey) first_priority from orders group by 1")
def _(t):
    return t.table("orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"))


_ITEM = {k: f"case when item_{k} <> 3 then {'3 - item_' + str(k) if k in (2, 4) else 'item_' + str(k)} end" for k in range(1, 6)}


@query("agg_scale_score", with_views("v_scales", f"i as (select o_orderkey, [{', '.join(_ITEM.values())}] v from v_scales)") + "select o_orderkey, case when len(list_filter(v, lambda x: x is not null)) >= 3 then list_sum(list_filter(v, lambda x: x is not null))::double end score from i")
def _(t):
    return t.scales().select("o_orderkey", S.scale_score([F.col(f"item_{k}").cast("string") for k in range(1, 6)], [2, 4], 0, 3, missing=3, min_present=3).alias("score"))


@query("agg_pair_covariates", with_views("v_scales") + "select pair_id, count(*) n_participants, (count(distinct grp) = 2)::int group_mixed, avg(item_1) item_1_mean, case when count(item_1) = 2 then (max(item_1) - min(item_1))::int end item_1_diff from v_scales group by 1", r="item_1_mean")
def _(t):
    return S.pair_covariates(t.scales(), "pair_id", ["item_1"], "grp")


@query("agg_speaker_gap", with_views("v_prosody", "e as (select session, pair_id, speaker, avg(f0) m from v_prosody group by 1, 2, 3)", "g as (select session, pair_id, max(m) - min(m) g from e group by 1, 2 having count(*) = 2)") + "select pair_id, avg(g) speaker_gap from g group by 1", r="speaker_gap")
def _(t):
    return S.speaker_gap(t.prosody(), ["session", "pair_id"], "pair_id", "speaker", "f0")


_CENT = "x as (select session, speaker, generate_subscripts(vec, 1) i, unnest(vec)::double v from v_voice {where}), m as (select session, speaker, i, avg(v) v, count(*) n from x group by 1, 2, 3), c as (select session, speaker, max(n) n, list(v order by i) v, sqrt(sum(v * v)) len from m group by 1, 2)"


@query("agg_centroid", with_views("v_voice", _CENT.format(where="where question = 1")) + "select session, speaker, n n_enrolled, generate_subscripts(v, 1)::bigint i, unnest(v) / len c from c where n >= 3", r="c")
def _(t):
    c = R.centroids(t.voice().filter("question = 1"), ["session"], "speaker", "vec", 3)
    return c.select("session", "speaker", "n_enrolled", F.posexplode("centroid").alias("i", "c")).withColumn("i", F.col("i").cast("long") + 1)


def _scored(t: Tables):
    return R.enroll_assign(t.voice(), ["session"], "vec_id", "speaker", "vec", F.col("question") == 1, least=3)


_ENROLL = [
    _CENT.format(where="where question = 1"),
    "u as (select session, speaker, list_transform(v, lambda z: z / len) v from c where n >= 3)",
    "g as (select session, min(speaker) s0, max(speaker) s1, arg_min(v, speaker) c0, arg_max(v, speaker) c1 from u group by 1 having count(*) = 2)",
    "sc as (select vv.session, vec_id, vv.speaker, s0, s1, list_cosine_similarity(vec::double[], c0) sim_0, list_cosine_similarity(vec::double[], c1) sim_1 from v_voice vv join g on g.session = vv.session where question <> 1 and dur >= 1)",
    "r as (select session, vec_id, speaker, case when sim_0 >= sim_1 then s0 else s1 end predicted, sim_0, sim_1, abs(sim_0 - sim_1) margin from sc)",
]


@query("st_enroll_assign", with_views("v_voice", *_ENROLL) + "select session, vec_id, speaker, predicted, sim_0, sim_1, margin, predicted = speaker agree, margin < 0.05 low_margin from r", r="sim_0 sim_1 margin")
def _(t):
    return _scored(t)[0]


@query("agg_agreement", with_views("v_voice", *_ENROLL) + "select session, count(*) n_turns, avg((predicted = speaker)::int) agreement, avg((margin < 0.05)::int) low_margin_rate, count(*) filter (predicted <> speaker or margin < 0.05) n_flagged from r group by rollup (session)", r="agreement low_margin_rate")
def _(t):
    return R.agreement(_scored(t)[0], "session")


_LONG_FEATURES = "lf as (" + " union all ".join(f"select '{c}' feature, {c}::double v, acct, ord, grp, pair_id from v_const" for c in [*FEATURES, "sparse"]) + ")"


@query("agg_describe", with_views("v_const", _LONG_FEATURES) + "select feature, count(v) n, avg(v) mean, stddev_samp(v) sd, min(v) min, max(v) max, avg((v is null)::int) * 100 missing_pct, skewness(v) skew from lf group by 1", r="mean sd min max missing_pct skew")
def _(t):
    return B.describe(t.with_constants(), [*FEATURES, "sparse"])


@query("agg_corr_matrix", with_views("v_const", "l as (" + " union all ".join(f"select pair_id, '{c}' f, {c} v from v_const" for c in ("va_price", "va_qty", "n_items", "sparse")) + ")") + "select a.f x, b.f y, count(*) n, corr(a.v, b.v) r from l a join l b using (pair_id) where a.v is not null and b.v is not null group by 1, 2", r="r")
def _(t):
    return A.corr_matrix(t.with_constants(), ["va_price", "va_qty", "n_items", "sparse"])


_GRID = "g as (" + " union all ".join(f"select '{x}' feature, '{y}' outcome, {x} v, {y} w, ord from v_ent" for x in FEATURES for y in OUTCOMES) + ")"


@query("agg_corr_grid", with_views("v_ent", _GRID) + "select feature x, outcome y, count(*) n, corr(v, w) r, count(*) - 2.0 df, corr(v, w) * sqrt(count(*) - 2.0) / sqrt(1 - corr(v, w) ** 2) t from g group by 1, 2", r="r df t")
def _(t):
    return A.corr_grid(t.entities(), FEATURES, OUTCOMES)


_GROUPS = "s as (select feature variable, count(v) filter (grp = 1) n1, count(v) filter (grp = 0) n0, avg(v) filter (grp = 1) mean1, avg(v) filter (grp = 0) mean0, var_samp(v) filter (grp = 1) v1, var_samp(v) filter (grp = 0) v0 from lf group by 1)"


@query("agg_group_compare", with_views("v_const", _LONG_FEATURES, _GROUPS) + "select variable, n1, n0, mean1, mean0, mean1 - mean0 diff, (mean1 - mean0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) cohen_d, (mean1 - mean0) / sqrt(v1 / n1 + v0 / n0) t, (v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)) df from s", r="mean1 mean0 diff cohen_d t df")
def _(t):
    return A.group_compare(t.with_constants(), [*FEATURES, "sparse"], "grp")


@query("agg_student_t", with_views("v_const", _LONG_FEATURES, _GROUPS) + "select variable, (mean1 - mean0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) t, n1 + n0 - 2.0 df from s", r="t df")
def _(t):
    return A.group_compare(t.with_constants(), [*FEATURES, "sparse"], "grp", pooled=True).select("variable", "t", "df")


@query("agg_median_split", with_views("v_ent", "h as (select *, case when acct > (select median(acct) from v_ent) then 'high' else 'low' end grp_ from v_ent)") + "select grp_ as \"group\", m measure, count(v) n, avg(v) mean, stddev_samp(v) / sqrt(count(v)) sem from (select grp_, 'va_price' m, va_price v from h union all select grp_, 'n_items', n_items from h) group by 1, 2", r="mean sem")
def _(t):
    return B.median_split(t.entities(), "pair_id", "acct", ["va_price", "n_items"])


@query("agg_confusion", with_views("v_ent", "f as (select acct > (select median(acct) from v_ent) truth, n_items > (select median(n_items) from v_ent) guess from v_ent)", "c as (select truth, guess, count(*) n from f group by 1, 2)") + "select truth, guess, n, (sum(case when truth = guess then n else 0 end) over ())::double / sum(n) over () accuracy from c", r="accuracy")
def _(t):
    e = t.entities()
    m = F.broadcast(e.agg(F.median("acct").alias("_a"), F.median("n_items").alias("_b")))
    return B.confusion(e.crossJoin(m), F.col("acct") > F.col("_a"), F.col("n_items") > F.col("_b"))


@query("agg_selection_freq")
def _(t):
    return A.nested_loo(t.entities(), "acct", FEATURES, "pair_id", controls=["ord"])[1]


@query("agg_pivot_report", with_views("v_ent", _GRID) + "select feature, " + ", ".join(f"max(r) filter (outcome = '{y}') {y}" for y in OUTCOMES) + " from (select feature, outcome, corr(v, w) r from g group by 1, 2) group by 1", r=" ".join(OUTCOMES))
def _(t):
    return B.pivot_report(A.corr_grid(t.entities(), FEATURES, OUTCOMES).select(F.col("x").alias("feature"), "y", "r"), "feature", "y", "r", OUTCOMES)


@query("agg_cronbach", with_views("v_scales", "d as (select * from v_scales where item_1 is not null and item_2 is not null and item_3 is not null)") + "select 3 k, count(*) n, 1.5 * (1 - (var_samp(item_1) + var_samp(item_2) + var_samp(item_3)) / var_samp(item_1 + item_2 + item_3)) alpha from d", r="alpha")
def _(t):
    return B.cronbach_alpha(t.scales(), ["item_1", "item_2", "item_3"])


# --- windows and sequences -------------------------------------------------------------------------------------------------


@query("win_switch_pairs", with_views("v_prosody", "p as (select session, t_start, event_id, speaker, f0, lag(speaker) over w prev_speaker, lag(f0) over w prev_f0 from v_prosody window w as (partition by session order by t_start, event_id))") + "select session, event_id, prev_speaker, speaker, prev_f0, f0 from p where prev_speaker <> speaker")
def _(t):
    return Q.switch_pairs(t.prosody(), ["session"], ORDER, "speaker", ["f0"]).drop("t_start")


_BACK = "b as (select *, lag(speaker) over w p, lead(speaker) over w n from v_floor window w as (partition by session order by t_start, event_id)), bc as (select *, text in ('error', 'signup') and (p is not null or n is not null) and coalesce(p <> speaker, true) and coalesce(n <> speaker, true) is_backchannel from b)"


@query("win_backchannel", with_views("v_floor", _BACK) + "select session, event_id, is_backchannel from bc")
def _(t):
    return Q.flag_backchannels(t.floor(), ["session"], ORDER, ["error", "signup"], max_words=1).select("session", "event_id", "is_backchannel")


@query("win_zscore", with_views("v_prosody") + "select event_id, (f0 - avg(f0) over w) / nullif(stddev_pop(f0) over w, 0) z from v_prosody window w as (partition by session, speaker)", r="z")
def _(t):
    return Q.zscore(t.prosody(), ["f0"], ["session", "speaker"], 0, "_z").select("event_id", F.col("f0_z").alias("z"))


@query("win_zscore_global", with_views("v_ent") + f"select pair_id, {_z('acct')} z1, {_z('acct', 'stddev_pop')} z0 from v_ent", r="z1 z0")
def _(t):
    d = Q.zscore(Q.zscore(t.entities().select("pair_id", "acct"), ["acct"], [], 1, "_1"), ["acct"], [], 0, "_0")
    return d.select("pair_id", F.col("acct_1").alias("z1"), F.col("acct_0").alias("z0"))


@query("win_question_ffill", with_views("v_lines", _PARSED) + "select session, line_no, question::int question from f")
def _(t):
    n = F.nullif(F.regexp_extract("line", r"Question_(\d+)", 1), F.lit("")).cast("int")
    return t.lines().withColumn("question", F.coalesce(Q.carry_forward(n, ["session"], ["line_no"]), F.lit(0))).select("session", "line_no", "question")


_MERGE = [
    "a as (select *, row_number() over w i, coalesce((lag(speaker) over w <> speaker)::int, 1) nw from v_cues window w as (partition by session order by start, event_id))",
    "b as (select *, sum(nw) over (partition by session order by i) island from a)",
    "c as (select *, coalesce((start > max(\"end\") over (partition by session, island order by i rows between unbounded preceding and 1 preceding) + 21600)::int, 0) gp from b)",
    "d as (select *, sum(gp) over (partition by session, island order by i) run from c)",
    "m as (select session, island, run, any_value(speaker) speaker, min(start) t_start, max(\"end\") t_end, count(*) n_cues, arg_max(text, row(length(text), -i)) as text from d group by 1, 2, 3)",
    "k as (select *, t_end - t_start dur from m where t_end - t_start >= 60)",
]


@query("win_gap_merge", with_views("v_cues", *_MERGE) + "select session, (row_number() over (partition by session order by island, run) - 1)::int turn_idx, speaker, t_start, t_end, n_cues, text, dur from k", r="t_start t_end dur")
def _(t):
    return Q.gap_merge(t.cues(), ["session"], ["start", "event_id"], gap=21600.0, min_dur=60.0)


@query("win_word_end", with_views("v_cues") + "select session, event_id, coalesce(lead(start) over (partition by session order by start, event_id), start + 0.3) word_end from v_cues", r="word_end")
def _(t):
    return t.cues().select("session", "event_id", F.coalesce(F.lead("start").over(Q.in_order(["session"], ["start", "event_id"])), F.col("start") + 0.3).alias("word_end"))


@query("win_dedup_consecutive", with_views("v_cues", "p as (select *, lag(text) over w pt, lag(start) over w ps from v_cues window w as (partition by session order by start, event_id))") + "select session, event_id from p where pt is null or pt <> text or start - ps >= 86400")
def _(t):
    w = Q.in_order(["session"], ["start", "event_id"])
    return t.cues().withColumns({"_t": F.lag("text").over(w), "_s": F.lag("start").over(w)}).filter(F.col("_t").isNull() | (F.col("_t") != F.col("text")) | (F.col("start") - F.col("_s") >= 86400)).select("session", "event_id")


@query("win_rank_in_speaker", with_views("v_turns") + "select session, turn_idx, row_number() over (partition by session, speaker order by turn_idx)::int k from v_turns")
def _(t):
    return t.turns().select("session", "turn_idx", F.row_number().over(Window.partitionBy("session", "speaker").orderBy("turn_idx")).alias("k"))


@query("win_cumcount_fallback", with_views("v_prosody") + "select event_id, row_number() over (partition by session order by t_start, event_id) <= 12 enroll from v_prosody")
def _(t):
    return t.prosody().select("event_id", (F.row_number().over(Q.in_order(["session"], ORDER)) <= 12).alias("enroll"))


def _metric_sql(name: str, a: str, b: str, edge: bool, source: str) -> str:
    """Parts n_<name> and b_<name>: adjacent metrics and the all-pairs baseline of one metric, by plain joins."""
    near = f"n_{name} as (select session, count(*) n, avg(abs(a - b)) adj, case when count(*) >= 4 then -regr_slope(abs(a - b), i) end convergence, case when count(*) >= 4 then corr(a, b) end synchrony from (select session, {a} a, {b} b, row_number() over (partition by session order by t_start, event_id) - 1 i from sp_{source} where {a} is not null and {b} is not null) group by 1)"
    if edge:
        base = f"b_{name} as (select x.session, avg(abs(x.v - y.v)) base, 9 c from (select session, {a} v from sp_{source} where {a} is not null and {b} is not null) x join (select session, {b} v from sp_{source} where {a} is not null and {b} is not null) y on x.session = y.session group by 1)"
    else:
        base = f"b_{name} as (select x.session, avg(abs(x.{b} - y.{b})) base, least(count(distinct x.event_id), count(distinct y.event_id)) c from z_{source} x join z_{source} y on x.session = y.session and x.speaker = 'A' and y.speaker = 'B' where x.{b} is not null and y.{b} is not null group by 1)"
    return near + ", " + base


def _entrain_sql(view: str, filtered: str = "", least: int = 5) -> str:
    z = "z_m as (select session, event_id, t_start, speaker, rate, (f0 - avg(f0) over w) / nullif(stddev_pop(f0) over w, 0) f0, (lev - avg(lev) over w) / nullif(stddev_pop(lev) over w, 0) lev from src window w as (partition by session, speaker))"
    sp = "sp_m as (select * from (select *, lag(speaker) over w prev, lag(f0) over w pf0, lag(lev) over w plev, lag(rate) over w prate from z_m window w as (partition by session order by t_start, event_id)) where prev <> speaker)"
    cnt = "cn as (select s.session, n_turns, coalesce(n_switch, 0) n_switch from (select session, count(*) n_turns from src group by 1) s left join (select session, count(*) n_switch from sp_m group by 1) k on k.session = s.session)"
    metrics = [("f0", "pf0", "f0", False), ("int", "plev", "lev", False), ("rate", "prate", "rate", False), ("f0_edge", "pf0", "f0", True), ("int_edge", "plev", "lev", True)]
    parts = [f"src as (select * from {view} {filtered})", z, sp, cnt, *[_metric_sql(n, a, b, e, "m") for n, a, b, e in metrics]]
    cols = ", ".join(f"case when n_switch >= {least} and n_{n}.n >= {4 if e else 2} and b_{n}.c >= 2 then b_{n}.base - n_{n}.adj end va_{n}_proximity, case when n_switch >= {least} then n_{n}.convergence end va_{n}_convergence, case when n_switch >= {least} then n_{n}.synchrony end va_{n}_synchrony" for n, _, _, e in metrics)
    joins = " ".join(f"left join n_{n} on n_{n}.session = cn.session left join b_{n} on b_{n}.session = cn.session" for n, *_ in metrics)
    return with_views("v_floor" if "bc" in filtered or view == "bc" else view, *([_BACK] if view == "bc" else []), *parts) + f"select cn.session, n_turns, n_switch, {cols} from cn {joins}"


_VA = " ".join(f"va_{n}_{k}" for n in ("f0", "int", "rate", "f0_edge", "int_edge") for k in ("proximity", "convergence", "synchrony"))
_SPEC = {"features": [("f0", "f0", True), ("int", "lev", True), ("rate", "rate", False)], "edges": [("f0", "f0", "f0", True), ("int", "lev", "lev", True)]}


@query("win_entrainment_session", _entrain_sql("v_prosody"), r=_VA)
def _(t):
    return Q.entrainment(t.prosody(), ["session"], ORDER, "speaker", **_SPEC)


@query("win_bc_sensitivity", _entrain_sql("bc", "where not is_backchannel"), r=_VA)
def _(t):
    d = Q.flag_backchannels(t.floor(), ["session"], ORDER, ["error", "signup"], max_words=1)
    return Q.entrainment(d.filter("not is_backchannel"), ["session"], ORDER, "speaker", **_SPEC)


@query("win_proximity", f"select session, proximity from ({with_views('v_prosody', _PAIRS, _SIDED, 'nr as (select session, count(*) n, avg(abs(a - b)) adj from k group by 1)', 'bs as (select a.session, avg(abs(a.v - b.v)) base from x a join x b on a.session = b.session and a.speaker = ' + chr(39) + 'A' + chr(39) + ' and b.speaker = ' + chr(39) + 'B' + chr(39) + ' group by 1)')}select nr.session, case when n >= 2 then base - adj end proximity from nr left join bs using (session))", r="proximity")
def _(t):
    return Q.proximity(t.prosody(), ["session"], ORDER, "speaker", "f0")


@query("win_convergence", with_views("v_prosody", _PAIRS) + "select session, case when count(*) >= 4 then -regr_slope(abs(a - b), k - 1) end convergence from k group by 1", r="convergence")
def _(t):
    return Q.pair_metrics(Q.switch_pairs(t.prosody(), ["session"], ORDER, "speaker", ["f0"]), ["session"], ORDER, "prev_f0", "f0").select("session", "convergence")


@query("win_synchrony", with_views("v_prosody", _PAIRS) + "select session, case when count(*) >= 4 then corr(a, b) end synchrony from k group by 1", r="synchrony")
def _(t):
    return Q.pair_metrics(Q.switch_pairs(t.prosody(), ["session"], ORDER, "speaker", ["f0"]), ["session"], ORDER, "prev_f0", "f0").select("session", "synchrony")


@query("win_edge_alignment", f"select session, va_f0_edge_proximity proximity, va_f0_edge_convergence convergence, va_f0_edge_synchrony synchrony from ({_entrain_sql('v_prosody')})", r="proximity convergence synchrony")
def _(t):
    return Q.entrainment(t.prosody(), ["session"], ORDER, "speaker", [("f0", "f0", True)], [("f0", "f0", "f0", True)]).select("session", *[F.col(f"va_f0_edge_{k}").alias(k) for k in ("proximity", "convergence", "synchrony")])


@query("win_offset_onset_scatter", with_views("v_prosody", _PAIRS) + "select count(*) n, corr(a, b) r, regr_slope(b, a) slope, regr_intercept(b, a) intercept from k", r="r slope intercept")
def _(t):
    p = Q.switch_pairs(t.prosody(), ["session"], ORDER, "speaker", ["f0"]).filter("f0 is not null and prev_f0 is not null")
    return p.agg(F.count("*").alias("n"), N.safe_corr(F.col("prev_f0"), F.col("f0")).alias("r"), F.regr_slope("f0", "prev_f0").alias("slope"), F.regr_intercept("f0", "prev_f0").alias("intercept"))


@query("win_handoff_gap", with_views("v_prosody", _PAIRS) + "select session, avg(abs(a - b)) gap, avg(abs(a - b)) filter (k <= 5) gap_first from k group by 1", r="gap gap_first")
def _(t):
    p = Q.switch_pairs(t.prosody(), ["session"], ORDER, "speaker", ["f0"]).withColumn("k", F.row_number().over(Q.in_order(["session"], ORDER)))
    gap = F.abs(F.col("prev_f0") - F.col("f0"))
    return p.groupBy("session").agg(F.avg(gap).alias("gap"), F.avg(F.when(F.col("k") <= 5, gap)).alias("gap_first"))


@query("win_best_window", with_views("v_prosody", "t0 as (select session, floor(min(t_start)) t0 from v_prosody group by 1)", "p as (select session, t_start, speaker, lag(t_start) over w pt, lag(speaker) over w ps from v_prosody window w as (partition by session order by t_start, event_id))", "g as (select session, t0, unnest(range(0, 30)) g from t0)", "c as (select g.session, t0 + g * 86400 w, count(*) n from g join p on p.session = g.session and ps <> speaker and pt >= t0 + g * 86400 and p.t_start < t0 + g * 86400 + 432000 group by 1, 2)") + "select session, arg_max(w, row(n, -w))::bigint window_start, max(n) n_switches from c group by 1")
def _(t):
    return Q.best_window(t.prosody(), ["session"], 432000, 86400, order=ORDER)


@query("win_rank_avg", "select o_orderkey, rank() over (order by o_orderdate::date) + (count(*) over (partition by o_orderdate::date) - 1) / 2.0 r from orders", r="r")
def _(t):
    o = t.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.month("o_orderdate").alias("m"), F.year("o_orderdate").alias("y"))
    return K.tied_ranks(o, "d", out="r").select("o_orderkey", "r")


@query("win_rank_avg_by", "select p_partkey, rank() over (partition by p_brand order by p_retailprice) + (count(*) over (partition by p_brand, p_retailprice) - 1) / 2.0 r from part", r="r")
def _(t):
    return K.tied_ranks(t.table("part").select("p_partkey", "p_brand", "p_retailprice"), "p_retailprice", ["p_brand"], "r").select("p_partkey", "r")


@query("win_bh_fdr_all", "with p as (select l_orderkey, l_linenumber, (l_partkey % 9973 + 1) / 10000.0 p from lineitem), r as (select *, count(*) over () n, row_number() over (order by p) r from p) select l_orderkey, l_linenumber, min(least(1.0, p * n / r)) over (order by r desc) p_fdr from r", r="p_fdr")
def _(t):
    p = t.table("lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_partkey") % 9973 + 1) / 10000.0).alias("p"))
    return Q.bh_fdr(p, "p").select("l_orderkey", "l_linenumber", "p_fdr")


@query("win_bh_fdr", "with p as (select p_partkey, p_brand, (p_partkey % 97 + 1) / 100.0 p from part), r as (select *, count(*) over (partition by p_brand) n, row_number() over (partition by p_brand order by p) r from p) select p_partkey, min(least(1.0, p * n / r)) over (partition by p_brand order by r desc) p_fdr from r", r="p_fdr")
def _(t):
    p = t.table("part").select("p_partkey", "p_brand", ((F.col("p_partkey") % 97 + 1) / 100.0).alias("p"))
    return Q.bh_fdr(p, "p", ["p_brand"]).select("p_partkey", "p_fdr")


# --- sorting, top k, sets ---------------------------------------------------------------------------------------------------


@query("srt_report", with_views("v_ent", _GRID) + "select feature x, outcome y, corr(v, w) r from g group by 1, 2 order by 3 desc", r="r")
def _(t):
    return A.corr_grid(t.entities(), FEATURES, OUTCOMES).select("x", "y", "r").orderBy(F.desc("r"))


@query("top_extremes", with_views("v_ent") + "(select pair_id, acct, 'low' as \"end\" from v_ent order by acct, pair_id limit 3) union all (select pair_id, acct, 'high' from v_ent order by acct desc, pair_id limit 3)")
def _(t):
    return B.extremes(t.entities(), "pair_id", "acct")


@query("top_outliers", with_views("v_const", _LONG_FEATURES) + "select pair_id, feature, z from (select pair_id, feature, (v - avg(v) over (partition by feature)) / nullif(stddev_pop(v) over (partition by feature), 0) z from lf) where abs(z) > 2.5", r="z")
def _(t):
    return B.outliers(t.with_constants(), "pair_id", [*FEATURES, "sparse"])


_NEAR = "x as (select label, generate_subscripts(embedding, 1) i, unnest(embedding)::double v from embeddings), c as (select label, i, avg(v) v from x group by 1, 2), cc as (select label, list(v order by i) v from c group by 1), s as (select vec_id, cc.label, list_cosine_similarity(embedding::double[], cc.v) s from embeddings, cc), r as (select *, row_number() over (partition by vec_id order by s desc, label) k from s)"


@query("top_nearest", f"with {_NEAR} select vec_id, max(label) filter (k = 1) best, max(s) filter (k = 1) best_sim, max(s) filter (k = 2) second_sim, max(s) filter (k = 1) - max(s) filter (k = 2) margin from r group by 1", r="best_sim second_sim margin")
def _(t):
    e = t.table("embeddings")
    return R.nearest(e, "vec_id", "embedding", R.centroids(e, [], "label", "embedding"), "label", "centroid")


@query("top_candidates", "with p as (select p_partkey, (p_partkey * 37 % 101 + 20) / 200.0 p from part) select p_partkey, p from p where case when (select min(p) from p) < 0.05 then p < 0.05 else p_partkey in (select p_partkey from p order by p, p_partkey limit 3) end")
def _(t):
    p = t.table("part").select("p_partkey", ((F.col("p_partkey") * 37 % 101 + 20) / 200.0).alias("p"))
    return B.candidates(p, "p_partkey", "p", 0.05).select("p_partkey", "p")


@query("top_cap", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) k from orders) where k <= 4")
def _(t):
    return t.table("orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).filter("k <= 4").select("o_custkey", "o_orderkey")


@query("set_union", "select o_orderkey, o_custkey, null::double extra from orders where o_orderkey % 2 = 0 union all select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey % 2 = 1")
def _(t):
    o = t.table("orders")
    return B.with_cache(o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey"), o.filter("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("extra")))


@query("set_difference", "select c_custkey k from customer except select o_custkey from orders")
def _(t):
    return t.table("customer").select(F.col("c_custkey").alias("k")).subtract(t.table("orders").select("o_custkey"))


@query("set_intersection", "select c_custkey k from customer intersect select o_custkey from orders where o_totalprice > 1000")
def _(t):
    return t.table("customer").select(F.col("c_custkey").alias("k")).intersect(t.table("orders").filter("o_totalprice > 1000").select("o_custkey"))


@query("set_distinct", "select distinct user_id, event_type from events")
def _(t):
    return t.table("events").select("user_id", "event_type").distinct()


# --- scalar functions --------------------------------------------------------------------------------------------------------


def _fn(name: str, column, sql: str, view: str = "v_turns", keys: str = "session, turn_idx", source: str = "turns", r: str = ""):
    out = name.removeprefix("fn_")
    query(name, with_views(view) + f"select {keys}, {sql} {out} from {view}", r=r)(lambda t: getattr(t, source)().select(*keys.split(", "), column().alias(out)))


_fn("fn_norm_word", lambda: X.norm_word(F.col("text")), "regexp_replace(lower(text), '[^a-z0-9'']', '', 'g')")
_fn("fn_norm_text", lambda: X.norm_text(F.col("text")), "trim(regexp_replace(lower(text), '[^a-z'' ]', '', 'g'))")
_fn("fn_tokens", lambda: F.array_join(X.tokens(F.col("text")), "|"), f"array_to_string({TOK}, '|')")
_fn("fn_strip_punct", lambda: X.strip_punct(F.col("text")), "trim(text, '.,!?')")
_fn("fn_clean_quotes", lambda: X.clean_quotes(F.concat(F.lit("‘"), F.col("text"), F.lit("”…"))), "'''' || regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') || '\"...'")
_fn("fn_signed_sentiment", lambda: X.signed_sentiment(F.element_at(F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), (F.col("sentiment") + 2).cast("int")), F.lit(0.75)), "sentiment * 0.75", "v_annot", source="annotated", r="signed_sentiment")
_fn("fn_wps", lambda: X.words_per_second(F.size(X.tokens(F.col("text"))), F.length("text") / 15.0), f"len({TOK}) / greatest(1e-6, length(text) / 15.0)", r="wps")


@query("fn_num", "select event_id, try_cast(json_extract_string(props, '$.k') as double) num, try_cast('-' || value::varchar as double) signed, try_cast(event_type as double) none from events", r="num signed none")
def _(t):
    e = t.table("events")
    return e.select("event_id", X.number(F.get_json_object("props", "$.k")).alias("num"), X.number(F.concat(F.lit("-"), F.col("value").cast("string"))).alias("signed"), X.number(F.col("event_type")).alias("none"))


@query("fn_ts_to_sec", "select event_id, extract(hour from ts) * 3600 + extract(minute from ts) * 60 + extract(second from ts) ts_to_sec from events".replace("extract(second from ts)", "(extract(microseconds from ts) // 1000) / 1000.0"), r="ts_to_sec")
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.table("events").select("event_id", X.clock_seconds(F.concat(F.date_format(ts, "HH:mm:ss"), F.lit(","), F.date_format(ts, "SSS"))).alias("ts_to_sec"))


@query("fn_stars", "select distinct p_size, case when p_size / 1000.0 < 0.001 then '***' when p_size / 1000.0 < 0.01 then '**' when p_size / 1000.0 < 0.05 then '*' when p_size / 1000.0 < 0.1 then '†' else '' end stars from part")
def _(t):
    return t.table("part").select("p_size", X.stars(F.col("p_size") / 1000.0).alias("stars")).distinct()


@query("fn_json_repair", with_views("v_annot", "n as (select *, row_number() over (partition by session order by turn_idx) - 1 n from v_annot)") + "select session, n // 8 batch, count(*)::int n_parsed, string_agg(depth, ',' order by n) depths from n group by 1, 2")
def _(t):
    d = t.replies().withColumn("_r", F.from_json(X.repair_json_array(F.col("reply")), H.REPLY))
    return d.select("session", "batch", F.size("_r").alias("n_parsed"), F.array_join(F.transform("_r", lambda x: x["d"]), ",").alias("depths"))


@query("fn_label_defaults", with_views("v_annot", "n as (select *, row_number() over (partition by session order by turn_idx) - 1 n from v_annot)") + "select session, turn_idx, depth, case when n % 3 = 0 then 'no' else 'yes' end on_topic, case when n % 4 = 1 then 'false' else 'true' end responsive from n")
def _(t):
    # replies hold depth and stance, some entries on_topic and responsive, and some are cut short: what is missing takes its default
    return H.parse_replies(t.turns(), t.replies(), ["session"]).select("session", "turn_idx", "depth", "on_topic", "responsive")


@query("fn_prompt", with_views("v_turns", _BATCHES) + "select session, batch::bigint batch, 'Label the turns.' || case when any_value(l1) filter (i = 0) is not null then chr(10) || chr(10) || 'Before:' || chr(10) || array_to_string(list_filter([any_value(l2) filter (i = 0), any_value(l1) filter (i = 0)], lambda x: x is not null), chr(10)) else '' end || chr(10) || chr(10) || 'Turns:' || chr(10) || string_agg(i || '. ' || l, chr(10) order by i) prompt from g group by 1, 2")
def _(t):
    return H.prompts(H.annotation_batches(t.turns(), ["session"], size=4), "Label the turns.").select("session", "batch", "prompt")


@query("fn_cosine", "select a.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1", r="c")
def _(t):
    e = t.table("embeddings")
    return e.alias("a").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", N.cosine(F.col("embedding"), F.col("other")).alias("c"))


@query("fn_unit_norm", "with n as (select vec_id, generate_subscripts(embedding, 1)::bigint i, unnest(embedding)::double * 3 x, sqrt(list_sum(list_transform(embedding, lambda z: (z::double * 3) ** 2))) len from embeddings) select vec_id, i, x / len u from n", r="u")
def _(t):
    unit = N.unit(F.transform("embedding", lambda z: z.cast("double") * 3))
    return t.table("embeddings").select("vec_id", F.posexplode(unit).alias("i", "u")).withColumn("i", F.col("i").cast("long") + 1)


@query("fn_rms_db", "select vec_id, 20 * log10(sqrt(list_avg(list_transform(embedding, lambda z: z::double * z::double))) + 1e-6) rms_db from embeddings", r="rms_db")
def _(t):
    return t.table("embeddings").select("vec_id", N.rms_db(F.col("embedding")).alias("rms_db"))


@query("fn_rms_frames", "with f as (select vec_id, embedding, unnest(range(0, 13)) i from embeddings) select vec_id, (i * 4 + 8) / 400.0 t, 20 * log10(sqrt(list_avg(list_transform(embedding[i * 4 + 1 : i * 4 + 16], lambda z: z::double * z::double))) + 1e-6) rms_db from f", r="t rms_db")
def _(t):
    return R.rms_frames(t.table("embeddings").select("vec_id", "embedding"), "embedding", 400.0)


@query("fn_f0_autocorr")
def _(t):
    return R.f0_frames(t.table("embeddings").select("vec_id", "embedding"), "embedding", 4000.0, voicing=0.1)


def _frames(t: Tables):
    p = t.prosody()
    return p.select("session", F.col("t_start").alias("t"), F.col("lev").alias("rms_db"), F.when(F.col("rate") > 10, F.col("rate")).alias("f0")), p.groupBy("session").agg(F.floor(F.min("t_start")).cast("double").alias("_t")).select("session", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.alias("turn_idx"), (F.col("_t") + i * 172800.0).alias("t_start"), (F.col("_t") + i * 172800.0 + 150000.0).alias("t_end")))).alias("w")).select("session", "w.*")


_PROS = [
    "fr as (select session, t_start t, lev rms_db, case when rate > 10 then rate end f0 from v_prosody)",
    "tn as (select session, i turn_idx, t0 + i * 172800.0 t_start, t0 + i * 172800.0 + 150000.0 t_end from (select session, floor(min(t_start))::double t0, unnest(range(0, 10))::int i from v_prosody group by 1))",
]


@query("fn_turn_prosody", with_views("v_prosody", *_PROS) + "select tn.session, tn.turn_idx, avg(f0) f0_mean, stddev_pop(f0) f0_sd, quantile_cont(f0, 0.95) - quantile_cont(f0, 0.05) f0_range, avg(rms_db) int_mean, stddev_pop(rms_db) int_sd, avg(f0) filter (t < t_start + 50000) onset_f0, avg(rms_db) filter (t < t_start + 50000) onset_int, avg(f0) filter (t >= t_end - 50000) offset_f0, avg(rms_db) filter (t >= t_end - 50000) offset_int from tn left join fr on fr.session = tn.session and t >= t_start and t < t_end group by 1, 2", r="f0_mean f0_sd f0_range int_mean int_sd onset_f0 onset_int offset_f0 offset_int")
def _(t):
    frames, turns = _frames(t)
    return R.turn_prosody(frames, turns, ["session"], "turn_idx", edge=50000.0, bucket=50000.0)


@query("fn_syllable_rate")
def _(t):
    frames, turns = _frames(t)
    return R.syllable_rate(frames, turns, ["session"], "turn_idx", floor_db=3.0, dip_db=0.5, bucket=50000.0)


# --- statistics ----------------------------------------------------------------------------------------------------------------


@query("st_standardize", with_views("v_const") + f"select pair_id, coalesce({_z('va_price', 'stddev_pop')}, 0) a, coalesce({_z('fixed', 'stddev_pop')}, 0) b from v_const", r="a b")
def _(t):
    return A.standardise(t.with_constants(), ["va_price", "fixed"]).select("pair_id", F.col("va_price_z").alias("a"), F.col("fixed_z").alias("b"))


@query("st_impute_mean", with_views("v_const") + "select pair_id, coalesce(sparse, avg(sparse) over ()) sparse from v_const", r="sparse")
def _(t):
    return A.impute_mean(t.with_constants().select("pair_id", "sparse", F.lit(None).cast("double").alias("nothing")), ["sparse", "nothing"])


_ZZ = f"zz as (select pair_id, ({_z('va_price', 'stddev_pop')}) za, ({_z('va_qty', 'stddev_pop')}) zb, corr(va_price, va_qty) over () r from v_ent)"


@query("st_pca_composite", with_views("v_ent", _ZZ) + "select pair_id, (za + case when r >= 0 then zb else -zb end) / sqrt(2.0) s from zz", r="s")
def _(t):
    # with two columns the component has a closed form, which the oracle uses; the first column's loading is made positive
    d, _info = A.pca_composite(t.entities(), ["va_price", "va_qty"], "s", sign="reference", reference="va_price")
    return d.select("pair_id", "s")


@query("st_equal_weight_composite", with_views("v_ent", _ZZ) + "select pair_id, (za + zb) / 2 s from zz", r="s")
def _(t):
    return A.equal_weight(t.entities(), ["va_price", "va_qty"], "s").select("pair_id", "s")


_SIMPLE = "b as (select count(*)::double n, regr_slope(acct, va_price) b, regr_intercept(acct, va_price) a, regr_sxx(acct, va_price) sxx, avg(va_price) mx, regr_r2(acct, va_price) r2, regr_syy(acct, va_price) * (1 - regr_r2(acct, va_price)) / (count(*) - 2) s2 from v_ent)"


@query("st_ols", with_views("v_ent", _SIMPLE, "o as (select 'va_price' term, b estimate, sqrt(s2 / sxx) se, b / sqrt(s2 / sxx) t, n - 2 df from b union all select 'const', a, sqrt(s2 * (1 / n + mx * mx / sxx)), a / sqrt(s2 * (1 / n + mx * mx / sxx)), n - 2 from b)") + f"select *, {t_p_sql('t', 'df')} p from o", r="estimate se t df p")
def _(t):
    return A.ols(t.entities(), "acct", ["va_price"])[0].select("term", "estimate", "se", "t", "df", "p")


@query("st_ols_fit", with_views("v_ent", _SIMPLE) + "select n::bigint n, r2, 1 - (1 - r2) * (n - 1) / (n - 2) adj_r2, r2 / ((1 - r2) / (n - 2)) f, n * ln(2 * pi() * s2 * (n - 2) / n) + n + 4 aic, n * ln(2 * pi() * s2 * (n - 2) / n) + n + 2 * ln(n) bic from b", r="r2 adj_r2 f aic bic")
def _(t):
    return A.ols(t.entities(), "acct", ["va_price"])[1].select("n", "r2", "adj_r2", "f", "aic", "bic")


_CTRL = "m as (select feature{by}, count(*)::double n, var_pop(y) * count(*) syy, var_pop(v) * count(*) sxx, covar_pop(v, y) * count(*) sxy, var_pop(ord) * count(*) scc, covar_pop(v, ord) * count(*) sxc, covar_pop(y, ord) * count(*) syc from {src} where v is not null and y is not null group by 1{g}), b as (select *, (sxy - sxc * syc / scc) / (sxx - sxc * sxc / scc) beta from m), e as (select *, beta * sxy + (syc - beta * sxc) / scc * syc ex from b)"
_CTRL_OUT = "n::bigint n, beta, ex / syy r2, beta / sqrt((syy - ex) / (n - 3) / (sxx - sxc * sxc / scc)) t, n - 3 df"


@query("st_univariate_screen", with_views("v_const", _LONG_FEATURES, "ly as (select feature, v, acct y, ord from lf)", _CTRL.format(by="", src="ly", g="")) + f"select *, {t_p_sql('t', 'df')} p from (select feature, {_CTRL_OUT}, beta * sqrt(sxx / syy) std_beta from e where feature <> 'sparse')", r="beta r2 t df p std_beta")
def _(t):
    return A.screen(t.with_constants(), "acct", FEATURES, "ord").select("feature", "n", "beta", "r2", "t", "df", "std_beta", "p")


_GRID_Z = "gz as (select feature, outcome, (v - avg(v) over w) / stddev_samp(v) over w v, (w - avg(w) over w) / stddev_samp(w) over w y, ord from g window w as (partition by feature, outcome))"


@query("st_feature_outcome_grid", with_views("v_ent", _GRID, _GRID_Z, _CTRL.format(by=", outcome", src="gz", g=", 2")) + bh_sql(f"select *, {t_p_sql('t', 'df')} p from (select feature, outcome, {_CTRL_OUT} from e)"), r="beta r2 t df p p_fdr")
def _(t):
    return A.feature_outcome_grid(t.entities(), FEATURES, OUTCOMES, "ord").select("feature", "outcome", "n", "beta", "r2", "t", "df", "p", "p_fdr")


# Two controls, swept out one after the other: residuals on n_items, then on what that leaves of ord.
_SWEPT = """
s0 as (select {by}, y, v, n_items::double a, ord::double b from {src} where v is not null and y is not null),
s1 as (select {by}, count(*) over w n, regr_syy(y, a) over w syy, regr_sxx(v, a) over w sxx0, y - avg(y) over w - regr_slope(y, a) over w * (a - avg(a) over w) y, v - avg(v) over w - regr_slope(v, a) over w * (a - avg(a) over w) v, b - avg(b) over w - regr_slope(b, a) over w * (a - avg(a) over w) b from s0 window w as (partition by {by})),
s2 as (select {by}, n, syy, y - regr_slope(y, b) over w * b y, v - regr_slope(v, b) over w * b v from s1 window w as (partition by {by})),
s3 as (select {by}, any_value(n)::double n, any_value(syy) syy, regr_slope(y, v) beta, regr_syy(y, v) - regr_slope(y, v) * regr_sxy(y, v) sse, regr_sxx(y, v) sxx from s2 group by {by}),
s4 as (select {by}, n::bigint n, beta, 1 - sse / syy r2, beta / sqrt(sse / (n - 4) / sxx) t, n - 4 df from s3)"""


@query("st_screen_controls", with_views("v_const", _LONG_FEATURES, "ly as (" + " union all ".join(f"select '{c}' feature, {c}::double v, avg_total y, ord, n_items from v_const" for c in [*FEATURES[:4], "sparse"]) + ")", _SWEPT.format(by="feature", src="ly")) + f"select *, {t_p_sql('t', 'df')} p from s4", r="beta r2 t df p")
def _(t):
    return A.screen(t.with_constants(), "avg_total", [*FEATURES[:4], "sparse"], ["n_items", "ord"]).select("feature", "n", "beta", "r2", "t", "df", "p")


@query("st_grid_controls", with_views("v_ent", _GRID.replace("ord", "ord, n_items"), "gn as (select feature, outcome, (v - avg(v) over w) / stddev_samp(v) over w v, (w - avg(w) over w) / stddev_samp(w) over w y, ord, n_items from g where feature <> 'n_items' window w as (partition by feature, outcome))", _SWEPT.format(by="feature, outcome", src="gn")) + bh_sql(f"select *, {t_p_sql('t', 'df')} p from s4"), r="beta r2 t df p p_fdr")
def _(t):
    return A.feature_outcome_grid(t.entities(), FEATURES[:4], OUTCOMES, ["n_items", "ord"]).select("feature", "outcome", "n", "beta", "r2", "t", "df", "p", "p_fdr")


# Two regressors in each session: f0 on rate and the log level's hour, by Cramer's rule.
_BY = """
m as (select session, count(*)::double n, avg(f0) my, avg(rate) m1, avg(h) m2, var_pop(f0) * count(*) syy, var_pop(rate) * count(*) s11, var_pop(h) * count(*) s22, covar_pop(rate, h) * count(*) s12, covar_pop(f0, rate) * count(*) s1y, covar_pop(f0, h) * count(*) s2y from (select *, t_start / 3600 h from v_prosody) where f0 is not null and rate is not null and h is not null group by 1 having count(*) >= 8),
d as (select *, s11 * s22 - s12 * s12 det from m), b as (select *, (s1y * s22 - s2y * s12) / det b1, (s2y * s11 - s1y * s12) / det b2 from d where det > 1e-8 * s11 * s22),
e as (select *, syy - b1 * s1y - b2 * s2y sse from b), v as (select *, sse / (n - 3) s2, my - b1 * m1 - b2 * m2 b0 from e),
o as (select session, 'rate' term, n, syy, sse, b1 estimate, sqrt(s2 * s22 / det) se from v union all select session, 'h', n, syy, sse, b2, sqrt(s2 * s11 / det) from v)"""


@query("st_ols_by", with_views("v_prosody", _BY) + f"select *, {t_p_sql('t', 'df')} p from (select session, term, n::bigint n, n - 3 df, estimate, se, estimate / se t, 1 - sse / syy r2 from o)", r="df estimate se t r2 p")
def _(t):
    d = t.prosody().withColumn("h", F.col("t_start") / 3600)
    return G.ols_by(d, "f0", ["rate", "h"], ["session"], least=8).filter("term <> 'const'").select("session", "term", "n", "df", "estimate", "se", "t", "r2", "p")


_CHOSEN = (
    "s0 as (" + " union all ".join(f"select '{f}' feature, count(*) - 2.0 df, corr(acct, {f}) r from v_ent" for f in FEATURES) + "), "
    + f"s1 as (select feature, {t_p_sql('t', 'df')} p from (select *, r * sqrt(df / (1 - r * r)) t from s0)), "
    + "s2 as (select *, row_number() over (order by p, feature) rk, count(*) filter (p < 0.1) over () few from s1), s3 as (select feature, row_number() over (order by rk) k from s2 where p < 0.1 or few = 0 and rk <= 3), "
    + "cm as (" + " union all ".join(f"select '{a}' x, '{b}' y, abs(corr({a}, {b})) r from v_ent" for a in FEATURES for b in FEATURES if a != b) + "), "
    + "st as (select s3.k, feature, list(cm.y) filter (r > 0.7) near from s3 left join cm on cm.x = feature group by 1, 2), "
    + "rc as (select 0 k, []::varchar[] kept union all select st.k, case when list_has_any(kept, coalesce(near, [])) then kept else list_append(kept, feature) end from rc join st on st.k = rc.k + 1)"
)


@query("st_select_features", with_views("v_ent", _CHOSEN).replace("with ", "with recursive ", 1) + "select (i - 1)::int as rank, kept[i] feature from (select kept, unnest(range(1, least(len(kept), 4) + 1)) i from (select kept from rc order by k desc limit 1))")
def _(t):
    e = t.entities()
    return t.spark.createDataFrame([(i, f) for i, f in enumerate(A.select_features(e, A.screen(e, "acct", FEATURES)))], "rank int, feature string")


_TWO = "c as (select count(*)::double n, corr(acct, va_price) ra, corr(acct, va_qty) rb, corr(va_price, va_qty) rx from v_ent where va_price is not null and va_qty is not null), f as (select *, (ra * ra + rb * rb - 2 * ra * rb * rx) / (1 - rx * rx) r2 from c)"


@query("st_hierarchical", with_views("v_ent", _TWO) + "select n::bigint n, ra * ra r2_base, r2 r2_full, r2 - ra * ra delta_r2, (r2 - ra * ra) / ((1 - r2) / (n - 3)) f_change, 1.0 df1, n - 3 df2 from f", r="r2_base r2_full delta_r2 f_change df1 df2")
def _(t):
    return A.hierarchical(t.entities(), "acct", ["va_price"], ["va_qty"]).select("n", "r2_base", "r2_full", "delta_r2", "f_change", "df1", "df2")


_LOO = """
l0 as (select acct - avg(acct) over () y, va_price - avg(va_price) over () a, va_qty - avg(va_qty) over () b, n_items - avg(n_items) over () c from v_ent),
l1 as (select y y0, a, y - regr_slope(y, a) over () * a y1, b - regr_slope(b, a) over () * a b, c - regr_slope(c, a) over () * a c from l0),
l2 as (select *, y1 - regr_slope(y1, b) over () * b y2, c - regr_slope(c, b) over () * b c2 from l1),
l3 as (select *, y2 - regr_slope(y2, c2) over () * c2 y3, 1.0 / count(*) over () + a * a / sum(a * a) over () h1, b * b / sum(b * b) over () + c2 * c2 / sum(c2 * c2) over () h2 from l2),
m as (select count(*) n, sum(y0 ** 2) t, sum(y1 ** 2) s1, sum(y3 ** 2) s3, sum((y1 / (1 - h1)) ** 2) e1, sum((y3 / (1 - h1 - h2)) ** 2) e3 from l3),
f as (select *, (s1 - s3) / 2 / (s3 / (n - 4)) f from m)"""


@query("st_hierarchical_full", with_views("v_ent", _LOO) + "select n, 1 - s1 / t r2_base, 1 - s3 / t r2_full, (s1 - s3) / t delta_r2, 1 - e1 / t loo_r2_base, 1 - e3 / t loo_r2_full, f f_change, 2.0 df1, n - 4.0 df2, (1 + 2 * f / (n - 4)) ** (-(n - 4) / 2.0) p from f", r="r2_base r2_full delta_r2 loo_r2_base loo_r2_full f_change df1 df2 p")
def _(t):
    return A.hierarchical(t.entities(), "acct", ["va_price"], ["va_qty", "n_items"])


@query("st_loo", with_views("v_ent", "m as (select count(*) n, avg(va_price) mx, regr_slope(acct, va_price) b, regr_intercept(acct, va_price) a, regr_sxx(acct, va_price) sxx from v_ent)") + "select pair_id, acct actual, acct - (acct - a - b * va_price) / (1 - 1.0 / n - (va_price - mx) ** 2 / sxx) predicted from v_ent, m", r="predicted")
def _(t):
    return A.loo(t.entities(), "acct", ["va_price"], "pair_id")[0]


@query("st_nested_loo")
def _(t):
    return A.nested_loo(t.entities(), "acct", FEATURES, "pair_id", controls=["ord"])[0]


@query("st_bootstrap")
def _(t):
    return P.bootstrap_ols(t.entities(), "acct", ["va_price", "va_qty"], "pair_id")


@query("st_perm_group")
def _(t):
    return P.perm_group(t.entities(), "va_price", "grp", "pair_id")


@query("st_perm_dr2")
def _(t):
    return P.perm_dr2(t.entities(), "acct", "va_price", ["n_items"], "pair_id")


_PARTIAL = "c as (select count(*) n, corr(acct, va_price) xy, corr(acct, n_items) xz, corr(va_price, n_items) yz from {src}), r as (select n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) r, n - 3 df from c), t as (select *, r * sqrt(df) / sqrt(1 - r * r) t from r)"


@query("st_partial_corr", with_views("v_ent", _PARTIAL.format(src="v_ent")) + f"select n, r, t, {t_p_sql('t', 'df')} p from t", r="r t p")
def _(t):
    return A.partial_corr(t.entities(), "acct", "va_price", ["n_items"]).select("n", "r", "t", "p")


@query("st_partial_corr_rank", with_views("v_ent", "e as (select acct, round(va_price, 6) va_price, round(n_items, 6) n_items from v_ent)", "rk as (select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 {c}" for c in ("acct", "va_price", "n_items")) + " from e)", _PARTIAL.format(src="rk")) + f"select n, r, t, {t_p_sql('t', 'df')} p from t", r="r t p")
def _(t):
    e = t.entities().withColumns({c: F.round(c, 6) for c in ("va_price", "n_items")})  # so that equal means are ties
    return A.partial_corr(e, "acct", "va_price", ["n_items"], "spearman").select("n", "r", "t", "p")


_SHARED = """
r as (select acct - regr_slope(acct, ord) over () * ord y, va_price - regr_slope(va_price, ord) over () * ord a, va_qty - regr_slope(va_qty, ord) over () * ord b, regr_r2(acct, ord) over () c from v_ent),
k as (select count(*) n, 1 - any_value(c) rest, corr(y, a) ra, corr(y, b) rb, corr(a, b) rx from r),
q as (select *, (ra * ra + rb * rb - 2 * ra * rb * rx) / (1 - rx * rx) r2 from k)"""


@query("st_commonality", with_views("v_ent", _SHARED) + "select n, rest * (r2 - rb * rb) unique_first, rest * (r2 - ra * ra) unique_second, rest * (ra * ra + rb * rb - r2) shared, rest * r2 total from q", r="unique_first unique_second shared total")
def _(t):
    return A.commonality(t.entities(), "acct", ["va_price"], ["va_qty"], ["ord"])


@query("st_vif", with_views("v_ent", "c as (select corr(va_price, va_qty) r from v_ent)") + "select unnest(['va_price', 'va_qty']) feature, 1 / (1 - r * r) vif from c", r="vif")
def _(t):
    return A.vif(t.entities(), ["va_price", "va_qty"])


@query("st_incremental")
def _(t):
    return P.incremental_validity(t.entities(), "pair_id", ["acct", "avg_total"], ["va_price", "va_qty"], ["disc_mean", "tax_asym"], ["ord"], ["n_items", "disc_mean"])[0]


_CONFOUND = """
z as (select """ + ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () {n}" for c, n in (("acct", "y"), ("va_price", "a"), ("va_qty", "b"), ("grp", "g"), ("tax_asym", "h"))) + """ from v_ent),
l as (select 'va_price' predictor, y, a p, g, h from z union all select 'va_qty', y, b, g, h from z),
l1 as (select *, y - regr_slope(y, g) over w * g y1, p - regr_slope(p, g) over w * g p1, h - regr_slope(h, g) over w * g h1 from l window w as (partition by predictor)),
l2 as (select *, y1 - regr_slope(y1, h1) over w * h1 y2, p1 - regr_slope(p1, h1) over w * h1 p2 from l1 window w as (partition by predictor)),
m as (""" + " union all ".join(f"select predictor, '{name}' model, count(*) - {k} df, regr_slope(y{i}, p{i}) beta, regr_syy(y{i}, p{i}) - regr_slope(y{i}, p{i}) * regr_sxy(y{i}, p{i}) sse, regr_sxx(y{i}, p{i}) sxx from l2 group by 1" for name, k, i in (("alone", 2, ""), ("group", 3, 1), ("group+gap", 4, 2))) + """),
n as (select *, beta / sqrt(sse / df / sxx) t from m)"""


@query("st_confound", with_views("v_ent", _CONFOUND) + f"select predictor, model, beta, {t_p_sql('t', 'df')} p from n", r="beta p")
def _(t):
    return A.confound_checks(t.entities(), "acct", ["va_price", "va_qty"], "grp", "tax_asym")


@query("st_surrogate", with_views("v_prosody", _PAIRS, _DRAWN, _PSEUDO) + "select * from (select count(*) n, avg(r) real_mean from (select corr(a, b) r from k group by session having count(*) >= 4)), (select count(r) n_pseudo, avg(r) pseudo_mean from ps where not isnan(r))", r="real_mean pseudo_mean")
def _(t):
    real, pseudo = _pseudo_pairs(t)
    return real.agg(F.count("*").alias("n"), F.avg("synchrony").alias("real_mean")).crossJoin(pseudo.agg(F.count("*").alias("n_pseudo"), F.avg("synchrony").alias("pseudo_mean")))  # one row each


@query("st_surrogate_test")
def _(t):
    return P.surrogate_test(t.prosody(), ["session"], ORDER, "speaker", "f0")


@query("st_sensitivity", with_views("v_const", _LONG_FEATURES, "kv as (select feature, acct, round(v, 6) v from lf where v is not null)", "k as (select feature, acct, v, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2.0 rv, rank() over (partition by feature order by acct) + (count(*) over (partition by feature, acct) - 1) / 2.0 ra from kv)") + "select feature, r_pearson, r_spearman, p_pearson, p_spearman, sign(r_pearson) = sign(r_spearman) and (p_pearson < 0.1) = (p_spearman < 0.1) consistent from (select *, case when abs(r_pearson) > 1 - 1e-12 then 0 else " + t_p_sql("tp", "df") + " end p_pearson, case when abs(r_spearman) > 1 - 1e-12 then 0 else " + t_p_sql("ts", "df") + " end p_spearman from (select *, r_pearson * sqrt(df / greatest(1 - r_pearson ** 2, 1e-15)) tp, r_spearman * sqrt(df / greatest(1 - r_spearman ** 2, 1e-15)) ts from (select feature, count(*) - 2.0 df, corr(v, acct) r_pearson, corr(rv, ra) r_spearman from k group by 1)))", r="r_pearson r_spearman p_pearson p_spearman")
def _(t):
    d = t.with_constants()  # rounded, so that equal means are ties
    return A.sensitivity(d.withColumns({c: F.round(c, 6) for c in [*FEATURES, "sparse"]}), [*FEATURES, "sparse"], "acct").select("feature", "r_pearson", "r_spearman", "p_pearson", "p_spearman", "consistent")


@query("st_descriptive", with_views("v_const", _LONG_FEATURES) + "select feature, count(v) n, avg(v) mean, stddev_samp(v) sd, min(v) \"min\", max(v) \"max\", avg((v is null)::int) * 100 missing_pct, case when stddev_pop(v) > 0 then skewness(v) end skew, corr(v, acct) r from lf group by 1", r="mean sd min max missing_pct skew r")
def _(t):
    return A.descriptive_table(t.with_constants(), [*FEATURES, "sparse"], "acct").select("feature", "n", "mean", "sd", "min", "max", "missing_pct", "skew", "r")


@query("st_pearson_test", with_views("v_ent", "c as (select count(*) n, corr(acct, va_price) r from v_ent)", "c2 as (select n, r, r * sqrt(n - 2.0) / sqrt(1 - r * r) t, n - 2.0 df from c)") + f"select n, r, t, {t_p_sql('t', 'df')} p from c2", r="r t p")
def _(t):
    return A.pearson_test(t.entities(), "acct", "va_price").select("n", "r", "t", "p")


@query("st_linefit", with_views("v_sess") + "select condition, regr_slope(va_price, va_qty) slope, regr_intercept(va_price, va_qty) intercept from v_sess group by 1", r="slope intercept")
def _(t):
    return t.session_features().groupBy("condition").agg(F.regr_slope("va_price", "va_qty").alias("slope"), F.regr_intercept("va_price", "va_qty").alias("intercept"))


# --- hooks and streams -----------------------------------------------------------------------------------------------------------


@query("udf_sentiment", with_views("v_turns") + f"select session, turn_idx, coalesce((len(list_filter({TOK}, lambda x: x in ('the', 'and'))) - len(list_filter({TOK}, lambda x: x = 'of')))::double / nullif(len({TOK}), 0), 0) sentiment from v_turns", r="sentiment")
def _(t):
    return t.turns().select("session", "turn_idx", H.lexicon_sentiment(X.tokens(F.col("text")), ["the", "and"], ["of"]).alias("sentiment"))


def _length_score(texts: list[str]) -> list[float]:
    return [float(len(x) % 3 - 1) for x in texts]


@query("udf_sentiment_hook", with_views("v_annot") + "select session, turn_idx, sentiment from v_annot")
def _(t):
    return H.score_text(t.turns().select("session", "turn_idx", "text"), _length_score).select("session", "turn_idx", "sentiment")


def _letter_vector(texts: list[str]) -> list[list[float]]:
    return [[float(x.count(c)) for c in "etao"] for x in texts]


@query("udf_encoder", with_views("v_turns") + "select session, turn_idx, " + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::double v_{c}" for c in "etao") + " from v_turns")
def _(t):
    d = H.encode_text(t.turns().select("session", "turn_idx", "text"), _letter_vector)
    return d.select("session", "turn_idx", *[F.col("vector")[i].alias(f"v_{c}") for i, c in enumerate("etao")])


def _segment_vector(rows: list[tuple]) -> list[list[float]]:
    return [[float(sum(map(float, s))), b - a] for s, a, b in rows]


@query("udf_embed", "select vec_id, list_sum(list_transform(embedding, lambda z: z::double)) total, 1.5 span from embeddings", r="total span")
def _(t):
    e = t.table("embeddings").select("vec_id", "embedding", F.lit(0.5).alias("t0"), F.lit(2.0).alias("t1"))
    return H.embed_segments(e, _segment_vector, ["embedding", "t0", "t1"]).select("vec_id", F.col("vector")[0].alias("total"), F.col("vector")[1].alias("span"))


def _echo_labels(prompts: list[str]) -> list[str]:
    return ["[" + ",".join(f'{{"i":{i},"d":"deep"}}' for i, _ in enumerate(p.split("Turns:\n")[-1].split("\n"))) + "]" for p in prompts]


@query("udf_annotate", with_views("v_turns") + "select session, count(*) n_turns, count(*) n_deep from v_turns group by 1")
def _(t):
    batches = H.prompts(H.annotation_batches(t.turns(), ["session"]), "Label the turns.")
    d = H.parse_replies(t.turns(), H.annotate(batches, _echo_labels), ["session"])
    return d.groupBy("session").agg(F.count("*").alias("n_turns"), F.count_if(F.col("depth") == "deep").alias("n_deep"))


def _rate(prompts: list[str]) -> list[str]:
    return ['{"engagement": "high", "dominant_speaker": "A"}' if len(p) % 2 else "no" for p in prompts]


@query("udf_rate_conversation", with_views("v_turns", "p as (select session, (sum(length(text) + 3) + count(*) - 1) % 2 = 1 odd from v_turns group by 1)") + "select session, case when odd then 'high' else 'medium' end engagement, '' reason, case when odd then 'A' else 'balanced' end dominant_speaker from p")
def _(t):
    return H.rate_conversations(t.turns(), ["session"], _rate)


@query("udaf_grouped", with_views("v_prosody") + "select session, count(*) n, avg(f0) f0_mean from v_prosody group by 1", r="f0_mean")
def _(t):
    mean = lambda s: {"n": s[:, 0].astype(int), "f0_mean": s[:, 1] / s[:, 0]}
    return G.grouped_aggregate(t.prosody(), ["session"], ["f0"], G.product_state, mean, {"n": "long", "f0_mean": "double"}, centre=False)


@query("udaf_partial_corr", with_views("v_prosody", "c as (select session, count(*) n, corr(f0, rate) xy, corr(f0, t_start) xz, corr(rate, t_start) yz from v_prosody where f0 is not null and rate is not null group by 1)") + "select session, n, case when n >= 4 and xz ** 2 < 1 - 1e-9 and yz ** 2 < 1 - 1e-9 then (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) end r from c", r="r")
def _(t):
    return G.partial_correlation_by(t.prosody(), ["session"], "f0", "rate", "t_start")


@query("udtf", with_views("v_turns") + f"select session, turn_idx, (generate_subscripts({TOK}, 1) - 1)::int pos, unnest({TOK}) word from v_turns")
def _(t):
    return t.turns().select("session", "turn_idx", F.posexplode(X.tokens(F.col("text"))).alias("pos", "word"))


def _cue_lines(t: Tables, at_once: int = 1000) -> DataFrame:
    """The files' lines, up to so many that follow one another in a row; line_no: the first one's."""
    lines = _cue_files(t).select("user_id", "day", F.split("value", "\n").alias("lines"))
    first = lines.select("*", F.explode(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(at_once))).alias("line_no"))
    return first.select("user_id", "day", "line_no", F.slice("lines", F.col("line_no") + 1, at_once).alias("line"))


@query("udtf_cue_lines", ORACLES["src_srt_cues"])
def _(t):
    from .functions.table_functions import register_table_functions

    register_table_functions(t.spark)
    rows = t.spark.sql("select * from srt_cues(table(select * from {lines}) partition by (user_id, day) order by (line_no), 'line', 'user_id, day')", lines=_cue_lines(t))
    return rows.withColumns({c: F.round(c, 6) + 0.0 for c in ("start", "end")})


@query("udtf_cue_texts", ORACLES["src_srt_cues"])
def _(t):
    from .functions.table_functions import register_table_functions

    register_table_functions(t.spark)
    rows = t.spark.sql("select f.user_id, f.day, c.* from {files} f, lateral srt_text_cues(f.value) c", files=_cue_files(t))
    return rows.withColumns({c: F.round(c, 6) + 0.0 for c in ("start", "end")})


@query("str_ingest", with_views("v_lines") + "select 'block=' || session // 8 as condition, count(*) n_lines from v_lines group by 1")
def _(t):
    from .streaming import jobs as J

    # A file for each eight sessions, streamed in once each.
    base = _new_folder(t)
    lines = t.lines().select(F.floor(F.col("session") / 8).alias("block"), F.col("line").alias("value"))
    lines.repartition("block").sortWithinPartitions("block").write.partitionBy("block").text(f"{base}/in")
    J.run_once(J.ingest_transcripts(t.spark, f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("condition", (F.size(F.split("value", "\n")) - 1).cast("long").alias("n_lines")).groupBy("condition").agg(F.sum("n_lines").alias("n_lines"))


def _streamed(t: Tables, df: DataFrame, base: str, ts: str, by: str, slices: int = 4) -> DataFrame:
    """df as a stream of files: slices of equal size by time, one after the other, each with all of a key's rows in one file."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    parts = t.spark.sparkContext.defaultParallelism
    micros = F.unix_micros(ts)
    cuts = [None, *df.agg(F.percentile_approx(micros, [k / slices for k in range(1, slices)], 10_000)).first()[0], None]
    for low, high in zip(cuts, cuts[1:]):
        own = df.filter((micros >= low if low is not None else F.lit(True)) & (micros < high if high is not None else F.lit(True)))
        own.repartition(parts, by).write.mode("append").parquet(f"{base}/in")
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", parts).parquet(f"{base}/in")


@query("str_switch_state", with_views("v_prosody", "p as (select session, speaker, f0, lag(speaker) over w prev, lag(f0) over w before from v_prosody window w as (partition by session order by t_start, event_id))", "s as (select session, count(*) n_turns, count(*) filter (prev <> speaker) n_switch, coalesce(sum(abs(f0 - before)) filter (prev <> speaker), 0) sum_gap, count(before) filter (prev <> speaker and f0 is not null) n_pairs, corr(before, f0) filter (prev <> speaker) r from p group by 1)") + "select session, n_turns, n_switch, 0 n_late, sum_gap, n_pairs, case when n_pairs >= 4 and not isnan(r) then r end synchrony from s", r="sum_gap synchrony")
def _(t):
    from .streaming import jobs as J

    base = _new_folder(t)
    turns = _streamed(t, t.prosody("ts").select("session", "event_id", "ts", "speaker", "f0"), base, "ts", "session")
    seen, _late = J.run_batches(J.switch_state(turns, "session", "ts", "event_id", "speaker", "f0", expire_ms=3_650 * 86_400_000), f"{base}/out", f"{base}/state")
    last = seen.groupBy("session").agg(F.max_by(F.struct("n_turns", "n_switch", "n_late", "sum_gap", "n_pairs", "synchrony"), "batch").alias("s"))
    return last.select("session", "s.*")


_BURSTS = "g as (select user_id, event_type, ts, coalesce((ts - lag(ts) over w >= interval 6 hour)::int, 1) nw from events window w as (partition by user_id, event_type order by ts)), r as (select *, sum(nw) over (partition by user_id, event_type order by ts) run from g)"


@query("str_session_merge", f"with {_BURSTS} select user_id, event_type, count(*) n_cues from r group by user_id, event_type, run")
def _(t):
    from .streaming import jobs as J

    base = _new_folder(t)
    merged = J.session_merge(_streamed(t, t.table("events").select("user_id", "event_type", "ts"), base, "ts", "user_id"), ["user_id"], "ts", "6 hours", "event_type")
    seen, _late = J.run_batches(merged, f"{base}/out", f"{base}/state", "complete")
    last = seen.agg(F.max("batch").alias("batch"))
    return seen.join(F.broadcast(last), "batch").select("user_id", "event_type", "n_cues")  # one row


@query("str_session_append", f"with {_BURSTS} select user_id, event_type, epoch(min(ts))::double t_start, count(*) n_cues from r group by user_id, event_type, run having max(ts) + interval 7 hour <= (select date_trunc('milliseconds', max(ts)) from events)", r="t_start")
def _(t):
    from .streaming import jobs as J

    # What the watermark has made final: bursts that ended an hour before the newest event.
    base = _new_folder(t)
    merged = J.session_merge(_streamed(t, t.table("events").select("user_id", "event_type", "ts"), base, "ts", "user_id"), ["user_id"], "ts", "6 hours", "event_type")
    seen, _late = J.run_batches(merged, f"{base}/out", f"{base}/state", "append")
    return seen.select("user_id", "event_type", (F.unix_micros("t_start") / 1e6).alias("t_start"), "n_cues")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
