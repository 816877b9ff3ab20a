"""Session and entity features from turns, labels and scales."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import cosine, gini, ratio, safe_corr
from ..functions.text import number, strip_punct, tokens


def attach_roles(turns: DataFrame, log: DataFrame, keys: list[str], speaker: str = "speaker") -> DataFrame:
    """turns with role (and the log's other columns) by session and speaker; log is long: keys, speaker, role.

    A left join on session keys; Spark broadcasts the log where its size allows.
    """
    return turns.join(log, [*keys, speaker], "left")


def unpivot_log(log: DataFrame, keys: list[str], columns: dict[str, tuple], out: tuple[str, ...] = ("condition", "speaker")) -> DataFrame:
    """A wide log's role columns as rows: columns maps a column to the values of out."""
    rows = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(out, values)], F.col(c).alias("role")) for c, values in columns.items()]))
    return log.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def structural_features(turns: DataFrame, keys: list[str], lexicons: dict[str, list[str]], backchannels: list[str], order: list[str], role: str = "role", text: str = "text", question_mark: str = "?", roles: tuple[str, str] = ("A", "B"), per_turn: bool = True) -> DataFrame:
    """One row for each session with both roles: total_turns, participation_gini, turn_taking_density, and for each role ttr, <lexicon>_rate, q_count, bc_rate.

    Density divides by the number of turns (by switch chances if not per_turn). Distinct words come from one (session, role, word) aggregation,
    so no session's words are gathered in a row.
    """
    a, b = roles
    w = Window.partitionBy(*keys).orderBy(*order)
    t = turns.filter(F.col(role).isin(a, b)).withColumns({"_tok": tokens(F.col(text)), "_prev": F.lag(role).over(w)})
    said = strip_punct(F.trim(F.lower(F.coalesce(F.col(text), F.lit("")))))
    one = t.withColumns({"_n": F.size("_tok").cast("double"), "_sw": F.coalesce((F.col("_prev") != F.col(role)).cast("long"), F.lit(0)), "_q": F.contains(F.col(text), F.lit(question_mark)), "_bc": said.isin(*backchannels).cast("double"), **{f"_l_{k}": F.size(F.filter("_tok", _in(v))) for k, v in lexicons.items()}})
    at = lambda r: F.col(role) == r
    sums = [F.count("*").alias("total_turns"), F.sum("_sw").alias("_switches")]
    for r in roles:
        sums += [F.sum(F.when(at(r), F.col("_n"))).alias(f"_n_{r}"), F.count_if(at(r)).alias(f"_t_{r}"), F.count_if(at(r) & F.col("_q")).alias(f"q_count_{r}"), F.avg(F.when(at(r), F.col("_bc"))).alias(f"bc_rate_{r}")]
        sums += [F.sum(F.when(at(r), F.col(f"_l_{k}"))).alias(f"_l_{k}_{r}") for k in lexicons]
    wide = one.groupBy(*keys).agg(*sums).filter((F.col(f"_t_{a}") > 0) & (F.col(f"_t_{b}") > 0))
    words = t.select(*keys, F.col(role).alias("_role"), F.explode("_tok").alias("_w")).groupBy(*keys, "_role", "_w").agg(F.count("*").alias("_c"))
    kinds = words.groupBy(*keys).agg(*[F.count_if(F.col("_role") == r).alias(f"_d_{r}") for r in roles])
    d = wide.join(kinds, keys, "left")
    chances = F.col("total_turns") if per_turn else F.nullif(F.col("total_turns") - 1, F.lit(0))
    return d.select(
        *keys,
        "total_turns",
        gini(F.col(f"_n_{a}"), F.col(f"_n_{b}")).alias("participation_gini"),
        (F.col("_switches") / chances).alias("turn_taking_density"),
        *[F.coalesce(ratio(F.col(f"_d_{r}"), F.col(f"_n_{r}")), F.lit(0.0)).alias(f"ttr_{r}") for r in roles],
        *[(F.col(f"_l_{k}_{r}") / F.greatest(F.lit(1.0), F.col(f"_n_{r}"))).alias(f"{k}_rate_{r}") for k in lexicons for r in roles],
        *[F.col(f"q_count_{r}") for r in roles],
        *[F.col(f"bc_rate_{r}") for r in roles],
    )


def _in(words: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(*words)


def label_rates(annotated: DataFrame, keys: list[str], rates: dict[str, tuple[str, str]], counts: dict[str, tuple[str, str]] = {}) -> DataFrame:
    """Shares (rates) and numbers (counts) of labels by session: name -> (column, label)."""
    hit = lambda c, v: F.coalesce(F.col(c).cast("string") == v, F.lit(False))
    return annotated.groupBy(*keys).agg(*[F.avg(hit(c, v).cast("double")).alias(n) for n, (c, v) in rates.items()], *[F.count_if(hit(c, v)).alias(n) for n, (c, v) in counts.items()])


def rate_by_question(annotated: DataFrame, keys: list[str], column: str, label: str, questions: list[int], question: str = "question", name: str = "on_topic") -> DataFrame:
    """The label's share for each question; null where a session has no turn of it."""
    return annotated.groupBy(*keys).agg(*[F.avg(F.when(F.col(question) == q, (F.col(column) == label).cast("double"))).alias(f"{name}_q{q}") for q in questions])


def party_rates(annotated: DataFrame, keys: list[str], speaker: str, rates: dict[str, tuple[str, str]]) -> DataFrame:
    """Mean and absolute difference of the two speakers' label shares, and of their turns' shares; only sessions with two speakers."""
    each = label_rates(annotated.withColumn("_one", F.lit("1")), [*keys, speaker], rates, {"_turns": ("_one", "1")})
    lo, hi = (lambda n: F.min_by(n, speaker)), (lambda n: F.max_by(n, speaker))
    aggs = [x for n in rates for x in (((lo(n) + hi(n)) / 2).alias(f"{n}_mean"), F.abs(lo(n) - hi(n)).alias(f"{n}_asym"))]
    turns = F.abs(lo("_turns") - hi("_turns")) / F.sum("_turns")
    return each.groupBy(*keys).agg(F.count("*").alias("_k"), *aggs, turns.alias("turn_asym")).filter("_k = 2").drop("_k")


def hashed_counts(words: Column, dims: int = 64) -> Column:
    """A term-count vector by hashed words: the default encoder of question_similarity()."""
    slots = F.transform(words, lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dims)))
    counted = lambda slots: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return F.transform(F.array(slots), counted)[0]  # bound once: each word is hashed once, not once a slot


def question_similarity(turns: DataFrame, keys: list[str], encode: Callable[[Column], Column], order: list[str], speaker: str = "speaker", question: str = "question", text: str = "text", speakers: tuple[str, str] = ("A", "B")) -> DataFrame:
    """(keys, semantic_similarity): the mean over questions of the cosine of the two speakers' encoded texts.

    encode takes the column of one speaker's text of a question (bounded by what one speaker says in one question).
    """
    whole = turns.filter(F.col(speaker).isin(*speakers)).groupBy(*keys, question, speaker).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_t")))), lambda x: x["_t"]), " ").alias("_text"))
    coded = whole.select(*keys, question, speaker, encode(F.col("_text")).alias("_v"))
    pair = coded.groupBy(*keys, question).agg(*[F.max_by("_v", F.when(F.col(speaker) == s, F.lit(1))).alias(f"_v{i}") for i, s in enumerate(speakers)], F.count("*").alias("_k")).filter("_k = 2")
    return pair.select(*keys, cosine(F.col("_v0"), F.col("_v1")).alias("_c")).groupBy(*keys).agg(F.avg("_c").alias("semantic_similarity"))


def sentiment_alignment(turns: DataFrame, keys: list[str], sentiment: str, speaker: str = "speaker", question: str = "question", speakers: tuple[str, str] = ("A", "B")) -> DataFrame:
    """(keys, sent_alignment): 1 - |difference of the speakers' mean sentiments| / 2, a question at a time, then averaged."""
    m = [F.avg(F.when(F.col(speaker) == s, F.col(sentiment))) for s in speakers]
    by_q = turns.groupBy(*keys, question).agg((1 - F.abs(m[0] - m[1]) / 2).alias("_a")).filter("_a is not null")
    return by_q.groupBy(*keys).agg(F.avg("_a").alias("sent_alignment"))


def sentiment_synchrony(turns: DataFrame, keys: list[str], order: list[str], sentiment: str, speaker: str = "speaker", speakers: tuple[str, str] = ("A", "B"), least: int = 4) -> DataFrame:
    """(keys, sentiment_synchrony): correlation of the k-th turns of both speakers, as far as both go."""
    k = turns.filter(F.col(speaker).isin(*speakers)).withColumn("_k", F.row_number().over(Window.partitionBy(*keys, speaker).orderBy(*order)))
    both = k.groupBy(*keys, "_k").agg(*[F.max(F.when(F.col(speaker) == s, F.col(sentiment))).alias(f"_s{i}") for i, s in enumerate(speakers)])
    return both.groupBy(*keys).agg(safe_corr(F.col("_s0"), F.col("_s1"), least).alias("sentiment_synchrony"))


def turn_spans(words: DataFrame, keys: list[str], turn: str) -> DataFrame:
    """(keys, turn, t_start, t_end, coverage): the matched words' span and share; a turn without matches stands at the previous turn's end."""
    t = words.groupBy(*keys, turn).agg(F.min("start").alias("_s"), F.max("end").alias("_e"), (F.count("start") / F.count("*")).alias("coverage"))
    w = Window.partitionBy(*keys).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    at = F.last("_e", ignorenulls=True).over(w)
    return t.select(*keys, turn, F.coalesce("_s", at, F.lit(0.0)).alias("t_start"), F.coalesce("_e", at, F.lit(0.0)).alias("t_end"), "coverage")


def collapse(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Means of numeric columns by entity; rows without a key are left out."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal") and f.name != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.avg(c).alias(c) for c in (columns or numeric)])


def mean_asym(df: DataFrame, names: list[str], a: str = "A", b: str = "B") -> DataFrame:
    """<name>_mean and <name>_asym of column pairs <name>_A, <name>_B."""
    x, y = (lambda n: F.col(f"{n}_{a}")), (lambda n: F.col(f"{n}_{b}"))
    return df.withColumns({k: v for n in names for k, v in ((f"{n}_mean", (x(n) + y(n)) / 2.0), (f"{n}_asym", F.abs(x(n) - y(n))))})


def composite_index(df: DataFrame, columns: list[str], out: str, ddof: int = 1) -> DataFrame:
    """The mean of a row's z scores over the columns that the table has; nulls are skipped, a row without values is null."""
    from .sequence import zscore

    own = [c for c in columns if c in df.columns]
    z = zscore(df, own, [], ddof, "_z_")
    values = F.array_compact(F.array(*[F.col(f"{c}_z_") for c in own]))
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(values), F.lit(0))
    return z.withColumn(out, mean).drop(*[f"{c}_z_" for c in own])


def scale_score(items: list[Column], reverse: list[int], lo: float, hi: float, missing: float | None = None, min_present: int | None = None) -> Column:
    """Sum of a scale's items (numbered from 1, so a missing item never shifts the keys): reversed ones are lo + hi - x, the missing code and non-numbers are null.

    Null with fewer than min_present items (all, if None).
    """
    values = []
    for i, item in enumerate(items, 1):
        x = number(item)
        if missing is not None:
            x = F.nullif(x, F.lit(float(missing)))
        values.append(lo + hi - x if i in reverse else x)
    present = F.array_compact(F.array(*values))
    return F.when(F.size(present) >= (min_present or len(items)), F.aggregate(present, F.lit(0.0), lambda s, x: s + x))


def pair_covariates(people: DataFrame, pair: str, scales: list[str], group: str) -> DataFrame:
    """(pair, n_participants, group_mixed, <scale>_mean, <scale>_diff): diff only with two values, group_mixed if the group has two."""
    def diff(c):
        return F.when(F.count(c) == 2, F.max(c) - F.min(c)).alias(f"{c}_diff")

    return people.filter(F.col(pair).isNotNull()).groupBy(pair).agg(F.count("*").alias("n_participants"), (F.countDistinct(group) == 2).cast("int").alias("group_mixed"), *[x for c in scales for x in (F.avg(c).alias(f"{c}_mean"), diff(c))])


def speaker_gap(turns: DataFrame, keys: list[str], pair: str, speaker: str, value: str) -> DataFrame:
    """(pair, speaker_gap): the mean over sessions of the absolute difference of two speakers' mean values."""
    each = turns.groupBy(*keys, speaker).agg(F.avg(value).alias("_m")).filter("_m is not null")
    gap = each.groupBy(*keys).agg((F.max("_m") - F.min("_m")).alias("_g"), F.count("*").alias("_k")).filter("_k = 2")
    return gap.groupBy(pair).agg(F.avg("_g").alias("speaker_gap"))


def merge_features(base: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """Left joins on key; of columns that both sides have, the left one wins (the other is never shuffled)."""
    for other in others:
        base = base.join(other.select(key, *[c for c in other.columns if c not in base.columns]), key, "left")
    return base


def fan_out_keys(right: DataFrame, key: list[str]) -> DataFrame:
    """Keys that a join with right would multiply, and how often."""
    return right.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
