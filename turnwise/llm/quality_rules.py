"""Quality rules: per-document counts, and lines that too many documents of a host share.

All steps are DataFrame expressions. Counting is map-side combined; the join with frequent lines has a checkpointed
side, so AQE can split a line that a third of all documents share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, blank_words, cut_lineage, let, positions


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words of a document that stand in a window of width words found twice or more in it (first one included).

    Windows are hashed; a hash's high bits and the window's position are packed in one long, so sorting longs brings
    equal windows together, and the flagged positions, sorted again, give the length of their union.
    """
    n = F.size(words)
    bits = F.length(F.bin(n.cast("long")))

    hashes = F.transform(positions(n - (width - 1)), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))

    def pack(h, shift):
        return F.transform(h, lambda x, i: F.call_function("shiftleft", x, shift).bitwiseOR(i.cast("long")))

    def union_length(at):
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-width).cast("long").alias("last")), lambda s, p: F.struct((s["sum"] + F.least(F.lit(width).cast("long"), p - s["last"])).alias("sum"), p.alias("last")))["sum"]

    def count(packed, shift):
        high = lambda x: F.call_function("shiftright", x, shift)
        twice = F.filter(packed, lambda x, i: high(x).eqNullSafe(high(F.get(packed, i - 1))) | high(x).eqNullSafe(high(F.get(packed, i + 1))))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1
        return let(twice, lambda t: F.when(F.size(t) == 0, F.lit(0).cast("long")).otherwise(union_length(F.sort_array(F.transform(t, lambda x: x.bitwiseAND(low))))))

    return F.when(n < width, F.lit(0).cast("long")).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(pack(h, bits)), lambda packed: count(packed, bits))))
    )


def base_rules(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed; clashing columns are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    staged = docs.withColumns({"_words": blank_words(F.col(text_col)), "_lines": lines})
    w = F.col("_words")
    counted = staged.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_window_words(w),
        }
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    return counted.withColumn("base_failed", failed).drop("_words", "_lines")


def document_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host, doc_hash, line, words): all normalised lines of each document, those that it repeats too.

    A line is lower-cased and its white space does not count; lines without a word are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), host_of(host_col).alias("host"), F.xxhash64(text).alias("doc_hash"), F.explode(F.split(F.lower(text), "\n")).alias("_line"))
    rows = rows.select("doc_id", "host", "doc_hash", blank_words(F.col("_line")).alias("_words"))
    return rows.select("doc_id", "host", "doc_hash", F.xxhash64("_words").alias("line"), F.size("_words").alias("words")).filter("words > 0")


def host_of(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_documents: int = 5, max_percent: int = 1, max_removed_percent: int = 25, copies_are_one: bool = False, min_words: int = 50, **rules
) -> DataFrame:
    """(doc_id, counts, base_failed, n_removed_words, n_line_words, kept) of every row.

    A line is removed where more than min_documents different documents of its host have it, and more than max_percent of the host's
    documents; documents are told apart by their ids (copies_are_one: by their texts). A document is depleted if more than
    max_removed_percent of its words are in removed lines (a quarter), or fewer than min_words words are left; it is kept if neither that nor a base rule
    rejects it. Null and empty texts
    have no words and fail the base rules; a null host is host ''. Rows with a null id are judged by the base rules alone. Repeated
    rows get equal verdicts and count once; each row is judged by its own host, so one id and text in two hosts may get two verdicts.
    """
    key = "doc_hash" if copies_are_one else "doc_id"
    kept = [F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("doc_hash"), F.col(text_col).alias("text"), host_of(host_col).alias("host")]
    # Numbers only; a checkpoint, so that a caller's filter on the result doesn't repeat the counting expressions.
    base = cut_lineage(base_rules(docs.select(*kept), "text", min_words=min_words, **rules).drop("text"))
    lines = cut_lineage(document_lines(docs, id_col, text_col, host_col))
    hosts = docs.select(*kept).groupBy("host").agg(F.countDistinct(key).alias("documents"))
    often = lines.groupBy("host", "line").agg(F.countDistinct(key).alias("n")).filter(F.col("n") > min_documents)
    frequent = cut_lineage(often.join(hosts, "host").filter(F.col("n") * 100 > F.col("documents") * max_percent).select("host", "line", F.lit(True).alias("removed")))
    removed = lines.join(frequent, ["host", "line"], "left").groupBy("doc_id", "doc_hash", "host").agg(F.sum("words").alias("all_words"), F.sum(F.when(F.col("removed"), F.col("words")).otherwise(0)).alias("removed_words"))
    out = base.join(removed.filter("removed_words > 0"), ["doc_id", "doc_hash", "host"], "left").drop("doc_hash", "host")
    # All words of a text stand in its lines; where rows repeat, all_words has them as often.
    out = out.withColumns({"n_line_words": F.col("n_words"), "n_removed_words": F.coalesce(F.expr("removed_words * n_words div all_words"), F.lit(0).cast("long"))}).drop("all_words", "removed_words")
    left = F.col("n_line_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") * 100 > F.col("n_line_words") * max_removed_percent) | (left < min_words)
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def op1_sql(min_documents: int = 5, max_percent: int = 1, max_removed_percent: int = 25) -> str:
    """DuckDB SQL for quality_rules over documents by (doc_id, source)."""
    return rf"""
with d as (select doc_id, coalesce(source, '') host, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}+'), lambda x: x <> '') w from documents),
win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] k from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d where len(w) >= 3)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) c from win) where c > 1),
cov as (select doc_id, count(distinct j) n from (select doc_id, unnest([i, i + 1, i + 2]) j from rep) group by doc_id),
ln as (select doc_id, unnest(string_split(t, chr(10))) l from d),
dup as (select doc_id, count(*) - count(distinct l) n from ln where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
nl as (select doc_id, host, t, trim(unnest(string_split(regexp_replace(lower(t), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)))) l from d),
hs as (select host, count(distinct doc_id) c from d group by host),
fq as (select nl.host, l from nl join hs using (host) where l <> '' group by nl.host, l, c having count(distinct doc_id) > {min_documents} and count(distinct doc_id) * 100 > c * {max_percent}),
rm as (select nl.doc_id, sum(len(string_split(nl.l, ' '))) lw, sum(case when fq.l is not null then len(string_split(nl.l, ' ')) else 0 end) rw from nl left join fq on nl.host = fq.host and nl.l = fq.l where nl.l <> '' group by nl.doc_id),
b as (select d.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, coalesce(dup.n, 0)::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words, coalesce(rw, 0)::bigint rw, len(w)::bigint lw from d left join cov using (doc_id) left join dup using (doc_id) left join rm using (doc_id)),
f as (select *, n_words < 50 or n_repeat_words * 100 > n_words * 50 base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rw n_removed_words, lw n_line_words, not base_failed and rw * 100 <= lw * {max_removed_percent} and lw - rw >= 50 kept from f"""
