"""The operators' queries over the given tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import chat_digest, chat_examples, op8_sql
from .common import table
from .fingerprints import fingerprint_pairs
from .jaccard_join import jaccard_components
from .language_id import language_predictions
from .license_scan import license_scan, op5_sql
from .packing import pack_documents
from .periodic_runs import periodic_runs, run_digest, with_planted_period
from .piece_encoding import encoding_digest
from .quality_classifier import quality_scores
from .quality_rules import op1_sql, quality_rules
from .ranked_search import op12_sql, ranked_search
from .token_counts import token_counts
from .web_archive import archive_digest, op13_sql


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select((-F.lit(1)).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_digest(chat_examples(turns))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(with_planted_period(table(spark, sf_dir, "documents")), keep=["doc_id"]))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digest(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_piece_encoding, op3_quality_classifier, op4_jaccard_join, op5_license_scan, op6_language_id, op7_token_counts, op8_chat_format, op9_fingerprints, op10_packing, op11_periodic_runs, op12_ranked_search, op13_web_archive, pipeline)
    return {f.__name__: f for f in own}


def op4_sql() -> str:
    return r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, k from (select doc_id, case when len(w) < 3 then array_to_string(w, ' ') else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end k from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) i from d where len(w) > 0))),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
e as (select x, y from l union select y, x from l),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x),
m as (select x, min(y) y from r group by x)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) component_id from d left join n using (doc_id) left join m on m.x = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": op1_sql(), "op4_jaccard_join": op4_sql(), "op5_license_scan": op5_sql(), "op8_chat_format": op8_sql(), "op12_ranked_search": op12_sql(), "op13_web_archive": op13_sql()}
