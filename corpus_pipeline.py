"""A corpus pipeline of four stages: language, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet before the next one
reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm.common import Scratch, cut_lineage, table
from turnwise.llm.entry import tokenizer_path
from turnwise.llm.jaccard_join import one_of_each
from turnwise.llm.language_id import fit_language, label_languages, training_texts
from turnwise.llm.packing import pack_documents
from turnwise.llm.quality_classifier import fit_quality, score_quality, training_labels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if one language has this share of its letters.
LEAST_LANGUAGE_SHARE = 0.5
#: Words that a packing task keeps: fewer than by default, as executors still hold what the stages before took.
CACHED_WORDS = 200_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and texts of which no language has half of the letters. Rows are judged one by one: repeated rows alike, a null id like any other."""
    model = fit_language(training_texts(docs))
    return label_languages(docs, model, keep=COLUMNS, least_share=LEAST_LANGUAGE_SHARE).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier predicts to be of low quality (score below 0.5). Without any label all scores are 0.5, so all stay; null and empty texts are scored as texts without words."""
    model = fit_quality(docs, training_labels(table(spark, sf_dir, "labels")))
    return score_quality(docs, model, keep=COLUMNS, only_good=True).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles; see one_of_each for repeated and null ids. Texts without words stay."""
    return one_of_each(docs, width=5, threshold=(4, 5)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, one row a piece; a null text is packed as its end token alone."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), cached=CACHED_WORDS)


STAGES = [("language", language_stage), ("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: SQL can't express the language and quality models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared checkpoint folder, read again and removed; the result is a checkpoint."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(name, stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    packed = cut_lineage(STAGES[-1][1](spark, docs, sf_dir))
    scratch.drop()
    return packed
