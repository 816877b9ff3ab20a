"""License scans: phrases at fixed places, and an exact containment join of text blocks with notice templates.

The join orders the templates' words by their frequency in the whole corpus, rarest first. A block can contain a
share t of a template only if it has one of the template's first |T| - ceil(t |T|) + 1 words (prefix filter), is long
enough (length filter), and has enough words left after the first common one (positional filter). Only template words
matter for the overlap, so a block is cut down to them before it is exploded.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut_lineage, let

# Fixed values of the contract: phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices by label; a parameter of license_scan().
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "proprietary": "This document is confidential and proprietary; no part may be reproduced without prior written permission.",
}
#: Between paragraphs.
BLANK_LINES = r"\n[\x20\x09-\x0D]*\n"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), NOT_WORD), "")


def template_tokens(templates: dict[str, str]) -> dict[str, list[str]]:
    import re

    return {k: sorted(set(re.findall(r"[0-9a-z\u0080-\U0010FFFF]+", v.lower()))) for k, v in templates.items()}


def matching_blocks(docs: DataFrame, templates: dict[str, str], share: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block, label, containment) for each text block that has at least share of a template's words.

    A block is a paragraph, the lines between blank lines: it has the words of each of its lines, so a notice is found in one line or wrapped.
    """
    spark = docs.sparkSession
    tokens = template_tokens(templates)
    vocabulary = sorted({w for t in tokens.values() for w in t})
    need = {k: ceil(share * len(t) - 1e-9) for k, t in tokens.items()}
    known = F.array(*[F.lit(w) for w in vocabulary])
    paragraphs = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), BLANK_LINES)).alias("block", "_text"))
    blocks = paragraphs.select("doc_id", "block", F.array_intersect(license_words(F.col("_text")), known).alias("words")).filter(F.size("words") > 0)
    counted = blocks.select(F.explode("words").alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counted.collect()}  # at most the words of the templates
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    index = []
    for label, own in tokens.items():
        ordered = sorted(own, key=rank.__getitem__)
        index += [(w, label, i, ordered, need[label]) for i, w in enumerate(ordered[: len(ordered) - need[label] + 1])]
    # Broadcast: the prefixes of the templates given by the caller, never data.
    prefixes = F.broadcast(spark.createDataFrame(index, "word string, label string, i int, template array<string>, need int"))
    ranks = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    long_enough = blocks.filter(F.size("words") >= min(need.values()))
    ordered = long_enough.select("doc_id", "block", F.transform(F.array_sort(F.transform("words", lambda w: F.struct(ranks[w].alias("r"), w.alias("w")))), lambda x: x["w"]).alias("words"))
    hits = ordered.select("doc_id", "block", "words", F.posexplode("words").alias("j", "word")).join(prefixes, "word")
    hits = hits.filter((F.size("words") >= F.col("need")) & (1 + F.least(F.size("template") - F.col("i") - 1, F.size("words") - F.col("j") - 1) >= F.col("need")))
    # The first common word decides; later ones would repeat the pair.
    hits = hits.filter(F.array_intersect("template", "words")[0] == F.col("word"))
    overlap = F.size(F.array_intersect("template", "words"))
    return hits.filter(overlap >= F.col("need")).select("doc_id", "block", "label", (overlap / F.size("template")).alias("containment"))


def phrase_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, doc_hash, n_words, n_base, first_word, last_word, base): places where a phrase's words stand one after the other."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    staged = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("doc_hash"), license_words(text).alias("_w"))
    staged = staged.select("doc_id", "doc_hash", F.size("_w").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias("_s"))
    s = F.col("_s")
    long = lambda x: F.lit(x).cast("long")

    def starts(part):  # words before the end of part, which ends before a phrase's own blank
        return F.when(part == "", long(0)).otherwise((F.size(F.split(part, " ")) - 1).cast("long"))

    count, first, last, labels = long(0), [], [], []
    for phrase, label in phrases.items():
        found = F.contains(s, F.lit(f" {phrase} "))
        pieces = F.split(s, rf" \Q{phrase}\E(?= )")
        count = count + F.when(found, (F.size(pieces) - 1).cast("long")).otherwise(0)
        first.append(F.when(found, let(pieces, lambda p: starts(p[0]))))
        tail = len(phrase.split(" "))
        after = let(pieces, lambda p: F.size(F.array_remove(F.split(F.element_at(p, -1), " "), "")).cast("long"))
        last.append(F.when(found, F.col("n_words") - tail - after))
        labels.append(F.when(found, F.lit(label)))
    return staged.select("doc_id", "doc_hash", "n_words", count.alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, share: float = 0.9) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    labels are the phrases' and those of templates of which a paragraph has at least share of the distinct words; score is 1
    with a phrase, else the best containment, else 0. A-Z is lower-cased; null and empty texts have no words, no labels
    ('') and null places. Rows that repeat an id and text get equal results; a null id is a key like any other.
    """
    base = phrase_counts(docs, id_col, text_col)
    keyed = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("doc_hash")).alias("_k"), F.col(text_col).alias("text"))
    found = matching_blocks(keyed, templates, share, "_k", "text").select("doc_id.*", "label", "containment")
    found = cut_lineage(found.groupBy("doc_id", "doc_hash").agg(F.collect_set("label").alias("extra"), F.max("containment").alias("best")))  # one set of at most all templates
    found = broadcast_if_small(found.withColumnsRenamed({"doc_id": "_id", "doc_hash": "_hash"}))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_hash") == F.col("_hash")), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("extra", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))


def op5_sql(templates: dict[str, str] = TEMPLATES, share: float = 0.9) -> str:
    tokens = template_tokens(templates)
    values = ", ".join(f"('{k}', [{', '.join(repr(w) for w in t)}], {ceil(share * len(t) - 1e-9)})" for k, t in tokens.items())
    hits = " union all ".join(
        f"select doc_id, i - 1 p, '{label}' label from (select doc_id, w, unnest(range(1, len(w) - {n} + 2)) i from d where len(w) >= {n}) where " + " and ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(phrase.split(" ")))
        for phrase, label in PHRASES.items()
        for n in [len(phrase.split(" "))]
    )
    return rf"""
with d as (select doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}'), lambda x: x <> '') w from documents),
h as ({hits}),
b as (select doc_id, count(*) n_base, min(p) first_word, max(p) last_word, list(distinct label) base from h group by doc_id),
tpl as (select * from (values {values}) v(label, words, need)),
ln as (select doc_id, list_distinct(list_filter(regexp_split_to_array(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}'), lambda x: x <> '')) lw from (select doc_id, unnest(regexp_split_to_array(t, '{BLANK_LINES}')) l from d) where length(l) > 0),
m as (select doc_id, label, len(list_intersect(words, lw)) / len(words)::double c from ln join tpl on len(list_intersect(words, lw)) >= need),
x as (select doc_id, list(distinct label) extra, max(c) best from m group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word, coalesce(array_to_string(list_sort(base), ','), '') base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(extra, [])))), ','), '') labels, case when n_base > 0 then 1.0::double else coalesce(best, 0.0)::double end score
from d left join b using (doc_id) left join x using (doc_id)"""
