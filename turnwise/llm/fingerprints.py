"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits with bias correction.

Word shingles (five words) are hashed once. The hash's first bits name its bin, so in the sorted hashes the first of each
bin is that bin's minimum. An empty bin takes the value of the first filled bin in its own random sequence of bins
(optimal densification: independent draws, not a neighbour's value). The low four bits of each bin are packed,
sixteen bins to a long. All steps are expressions on one row: no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank_words, cut_lineage, let, positions

BINS, LOW_BITS = 256, 4
_BIN_BITS = BINS.bit_length() - 1


def shingle_hashes(words: Column, width: int = 5) -> Column:
    """The hash of each run of width words; fewer words are one shingle; no words, none."""
    n = F.size(words)
    each = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(positions(n - (width - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])))
    return F.when(n >= width, each).when(n > 0, F.array(F.xxhash64(F.array_join(words, " "), n))).otherwise(F.array().cast("array<bigint>"))


_LOW = (1 << (64 - _BIN_BITS)) - 1
_PROBES = 24


def _bin(h: Column) -> Column:
    return F.call_function("shiftright", h, F.lit(64 - _BIN_BITS))


def packed_minima(hashes: Column) -> Column:
    """array of BINS / 16 longs, or null for no hashes.

    Each bin also gets the largest value it can hold, so the first values of the sorted bins are one for each bin, and an
    empty bin is one whose first value is that.
    """
    fences = F.array(*[F.lit((b << (64 - _BIN_BITS)) | _LOW).cast("long") for b in range(-BINS // 2, BINS // 2)])
    firsts = let(F.sort_array(F.concat(hashes, fences)), lambda s: F.filter(s, lambda x, i: ~_bin(x).eqNullSafe(_bin(F.get(s, i - 1)))))
    filled = F.transform(firsts, lambda x: F.when(x.bitwiseAND(_LOW) != _LOW, x))

    def densified(g):
        def value(x, b):
            # An empty bin looks at bins drawn by its own hashes until one is filled; then at all filled ones, in the order of a hash.
            draw = [F.get(g, F.xxhash64(b, F.lit(t)).bitwiseAND(BINS - 1).cast("int")) for t in range(_PROBES)]
            last = F.array_min(F.transform(F.array_compact(g), lambda y: F.struct(F.xxhash64(b, _bin(y)).alias("o"), y.alias("y"))))["y"]
            return F.coalesce(x, *draw, last).bitwiseAND((1 << LOW_BITS) - 1)

        return F.transform(g, value)

    def pack(v):
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // 16 - 1)), lambda k: F.aggregate(F.slice(v, k * 16 + 1, 16), F.lit(0).cast("long"), lambda acc, x: F.call_function("shiftleft", acc, F.lit(LOW_BITS)).bitwiseOR(x)))

    return F.when(F.size(hashes) > 0, let(filled, lambda g: let(densified(g), pack)))


def fingerprint(text: Column, width: int = 5) -> Column:
    return let(blank_words(text), lambda w: let(shingle_hashes(w, width), packed_minima))


def fingerprint_hex(packed: Column) -> Column:
    """64-hex-digit words of the packed longs, one after the other; '' without shingles."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity (0 to 1): the share of equal bins m, corrected for chance equality, (m - c) / (1 - c) with c = 2^-4.

    Two documents without shingles are alike (1); one without and one with are not (0).
    """

    def same(x, y):  # 4-bit groups in which two longs agree
        d = x.bitwiseXOR(y)
        right = lambda k: F.call_function("shiftrightunsigned", d, F.lit(k))
        return F.lit(16) - F.bit_count(d.bitwiseOR(right(1)).bitwiseOR(right(2)).bitwiseOR(right(3)).bitwiseAND(F.lit(0x1111111111111111).cast("long")))

    m = F.aggregate(F.zip_with(a, b, same), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    c = 2.0**-LOW_BITS
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (m - c) / (1 - c)))


def next_bucket(level: DataFrame, fan: int = 1024) -> DataFrame:
    """(bucket, next) of a table of distinct buckets: the next lower one; the lowest goes on with the highest.

    Sorted in runs of neighbouring buckets; only the runs' first buckets go to the next level, fan times fewer.
    """
    if level.count() <= 4 * fan:
        w = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))
        return level.select("bucket", F.coalesce(F.lead("bucket").over(w), F.max("bucket").over(Window.partitionBy(F.lit(0)))).alias("next"))
    runs = level.withColumn("run", F.floor((F.col("bucket") + 1) / fan))
    inside = runs.select("bucket", "run", F.lead("bucket").over(Window.partitionBy("run").orderBy(F.desc("bucket"))).alias("next"))
    heads = cut_lineage(runs.groupBy("run").agg(F.max("bucket").alias("head")))
    follow = next_bucket(heads.select(F.col("run").alias("bucket")), fan).select(F.col("bucket").alias("run"), F.col("next").alias("next_run"))
    return inside.join(follow, "run").join(heads.select(F.col("run").alias("next_run"), "head"), "next_run").select("bucket", F.coalesce("next", "head").alias("next"))


def with_buckets(docs: DataFrame, per_bucket: int = 1024, bins: int = 1024, sampled: int = 200_000) -> DataFrame:
    """docs (doc_id, text) with bucket, a long that grows with doc_id, of about per_bucket rows however the ids are spread.

    Buckets of more than twice that are cut at their own quantiles (at most bins parts), until none is left but those whose rows share one id. The quantiles are those of a sample of about
    sampled rows of the largest bucket, so what meets in one task doesn't grow with the table; they only say where to cut. Each level cuts by bins, whatever the ids are, so a billion rows take
    two. Null ids have the lowest buckets, by a hash of their texts.
    """
    rows, ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    lost = max(1, -(-(rows - ids) // per_bucket))
    null_bucket = -1 - F.pmod(F.shiftrightunsigned(F.xxhash64("text"), 1), F.lit(lost))
    d = docs.withColumn("bucket", F.lit(0).cast("long"))
    shares, step, most = F.lit([i / bins for i in range(1, bins)]), 32, ids
    while ids > 2 * per_bucket:
        drawn = d.filter("doc_id is not null").select("bucket", "doc_id", F.when(F.rand(7) < sampled / most, F.col("doc_id")).alias("_drawn"))
        held = drawn.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.percentile_approx("_drawn", shares, 10_000).alias("cuts"))
        held = held.filter((F.col("n") > 2 * per_bucket) & (F.col("low") < F.col("high")))
        every = F.greatest(F.lit(1), F.ceil(F.lit(bins * per_bucket) / F.col("n"))).cast("int")
        # The beginnings of all parts but the first. Where the least id fills whole parts, it becomes one of its own, and a bucket of which too few rows were drawn is halved, so each level parts something.
        none = F.array().cast("array<bigint>")
        cuts = F.filter(F.coalesce("cuts", none), lambda c, i: (i + 1) % every == 0)
        middle = F.floor(F.col("low") / 2) + F.floor(F.col("high") / 2)
        apart = F.when(F.size(cuts) == 0, F.array(F.col("low") + 1, F.greatest(middle, F.col("low") + 1))).when(cuts[0] <= F.col("low"), F.array(F.col("low") + 1)).otherwise(none)
        edges = F.array_sort(F.array_distinct(F.concat(F.filter(cuts, lambda c: c > F.col("low")), apart)))
        crowded = cut_lineage(held.select(F.col("bucket").alias("_b"), "n", edges.alias("_edges")).withColumn("_coarse", F.filter("_edges", lambda e, i: i % step == 0)))
        found, most = crowded.agg(F.count("*"), F.max("n")).first()
        if not found:
            break
        # How many edges are at or below an id: first among each 32nd, then among the 32 that follow that one.
        upto = lambda array: F.size(F.filter(array, lambda e: e <= F.col("doc_id")))
        crowded = crowded.drop("n")
        d = d.join(F.broadcast(crowded) if found <= 1024 else crowded, F.col("bucket") == F.col("_b"), "left")  # 1024 longs each
        at = F.when(F.col("_b").isNull() | F.col("doc_id").isNull(), F.lit(0)).otherwise(let(upto(F.col("_coarse")), lambda c: F.when(c == 0, F.lit(0)).otherwise((c - 1) * step + upto(F.slice("_edges", (c - 1) * step + 1, F.lit(step))))))
        d = d.withColumn("bucket", F.col("bucket") * (bins + 1) + at).drop("_b", "_edges", "_coarse")
    return d.withColumn("bucket", F.when(F.col("doc_id").isNull(), null_bucket).otherwise(F.col("bucket")))


def with_next(docs: DataFrame, width: int = 5, per_bucket: int = 1024) -> DataFrame:
    """docs (doc_id, text) with own (its packed fingerprint) and after {text, own}, the row that follows by descending id; after the last comes the first.

    Rows are dealt to id buckets of about per_bucket rows (one exchange of the texts), and lead() runs inside a bucket. Only a bucket's
    last row needs the first row of another bucket. Equal ids are ordered by text; null ids come last, ordered by hash and text.
    """
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    d = with_buckets(docs, per_bucket).withColumn("tie", tie)
    best = cut_lineage(d.groupBy("bucket").agg(F.max("doc_id").alias("top")))
    links = next_bucket(best.select("bucket"))
    wanted = best if best.count() > 100_000 else F.broadcast(best)
    first = d.join(wanted.select(F.col("bucket").alias("next"), "top"), (d["bucket"] == F.col("next")) & d["doc_id"].eqNullSafe(F.col("top")))
    first = first.groupBy("next").agg(F.min(F.struct("tie", "text")).alias("first")).select("next", F.struct("first.text", fingerprint(F.col("first.text"), width).alias("own")).alias("head"))
    heads = cut_lineage(links.join(first, "next").select(F.col("bucket").alias("of"), "head"))
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "tie", "text")
    run = d.withColumn("own", fingerprint(F.col("text"), width))
    run = run.select("*", F.lead(F.struct("text", "own")).over(w).alias("inside"))
    out = run.join(heads, (run["bucket"] == heads["of"]) & run["inside"].isNull(), "left")
    return out.select("doc_id", "text", "own", F.coalesce("inside", "head").alias("after"))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next document. Empty and null texts have
    the fingerprint ''. Equal texts have equal fingerprints. Ids are cast to long (others than numbers are an error). Rows that repeat an id follow each other by text, rows with a null id come after all others.
    """
    d = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), width)
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - cut), F.substr("after.text", F.lit(1), cut))
    d = d.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", F.col("after.own").alias("next_own"), edited.alias("edited"))
    made = d.select("doc_id", "n_chars", "own", "next_own", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited"), width).alias("changed"))
    return made.select("doc_id", "n_chars", "edited_sha256", fingerprint_hex(F.col("own")).alias("fingerprint"), fingerprint_hex(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
