"""The training-data operators against brute force, round trips and odd inputs, on small tables."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("turnwise.llm.entry")

from pyspark.sql import functions as F  # noqa: E402

from turnwise.llm import chat_format, entry, fingerprints, jaccard_join, language_id, license_scan, packing, piece_encoding, quality_classifier, quality_rules, token_counts  # noqa: E402

LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b"), (6, "Same text, twice over."), (7, "Same text, twice over."), (8, LONG), (9, "漢字 кот́ é  x 😀."), (10, "all rights reserved all rights reserved\ncc by")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i == 4 else "s", 0) for i, t in ODD] + [(None, "no id here", "en", "s", 1), (6, "Same text, twice over.", "en", "s", 1)]
    extra = ["n_words", "score", "labels", "tiles", "bucket", "own", "component_id", "words", "kept"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracles(spark, sf, duck, name):
    for sql in [entry.oracle_sql()[name]]:
        got = entry.queries()[name](spark, sf)
        want = duck.sql(sql)
        columns = [c.lower() for c in want.columns]
        assert sorted(columns) == sorted(c.lower() for c in got.columns), name
        mine = sorted([tuple(r[c] for c in columns) for r in got.collect()], key=str)
        assert mine == sorted(want.fetchall(), key=str), name


def base_counts(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_counts(odd):
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got}
    for i, t in ODD:
        assert (by[i].n_words, by[i].word_chars, by[i].n_symbols, by[i].n_dup_lines, by[i].n_repeat_words) == base_counts(t), i
    assert not any(r.kept for r in got if r.n_words < 50)


def test_quality_rules_removes_shared_lines(spark, empty):
    shared = " ".join(f"shared{j}" for j in range(51)) + " "
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, f"{shared}\n{own(i, 20)}", "en", "h", 0) for i in range(30)] + [(100 + i, f"{shared}\n{own(i, 200)}", "en", "h", 0) for i in range(5)] + [(200 + i, f"{shared}\n{own(i, 20)}", "en", "other", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    assert not any(got[i] for i in range(30)) and all(got[i] for i in got if i >= 100)
    assert all(r.kept for r in quality_rules.quality_rules(docs, max_percent=90).filter("doc_id >= 200").collect())
    assert quality_rules.quality_rules(empty).count() == 0
    copies = spark.createDataFrame([(i, own(3, 80), "en", "c", 0) for i in range(40)], SCHEMA)
    assert not any(r.kept for r in quality_rules.quality_rules(copies).collect())
    assert all(r.kept for r in quality_rules.quality_rules(copies, copies_are_one=True).collect())
    twice = quality_rules.quality_rules(docs.union(docs.filter("doc_id < 20"))).filter("doc_id < 30").collect()
    assert len(twice) == 50 and {(r.n_line_words, r.n_removed_words) for r in twice} == {(71, 51)}


def test_quality_rules_bite_where_sql_checks_them(spark):
    got = quality_rules.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert got.filter("n_removed_words > 0").count() > 50
    assert got.filter("not base_failed and not kept").count() > 0


def test_quality_rules_judge_a_row_by_its_own_host(spark):
    text = " ".join(f"own{j}" for j in range(60)) + "\nfour words stand here"
    rows = [(i, f"{' '.join(f'w{i}x{j}' for j in range(60))}\nfour words stand here", "en", "A", 0) for i in range(10)]
    docs = spark.createDataFrame([*rows, (99, text, "en", "A", 0), (99, text, "en", "B", 0)], SCHEMA)
    got = sorted(r.n_removed_words for r in quality_rules.quality_rules(docs).filter("doc_id = 99").collect())
    assert got == [0, 4]
    short = " ".join(f"w{j}" for j in range(46)) + "\nfour words stand here"
    left = quality_rules.quality_rules(docs.union(spark.createDataFrame([(100, short, "en", "A", 0), (101, short, "en", "B", 0)], SCHEMA)))
    assert {r.doc_id: (r.base_failed, r.kept) for r in left.filter("doc_id >= 100").collect()} == {100: (False, False), 101: (False, True)}


def test_piece_encoding_matches_library(spark, docs, odd, empty):
    path = entry.tokenizer_path("piece_bpe_32k.model")
    library = piece_encoding.library_model(path)
    model = piece_encoding.PieceModel(open(path, "rb").read())
    samples = [t or "" for _, t in ODD] + [t for _, t in texts_of(docs)][:60] + ["  two  blanks ", "▁x ▁", "<s> </s> <0x0A>", "\x00\x01", "a" * 3000, "\n\n\t"]
    for text in samples:
        ids, begins, ends = model.encode(text)
        assert ids.tolist() == library.encode(text), text[:40]
        if len(ids):
            assert begins[0] == 0 and ends[-1] == len(text.encode()) and (begins[1:] == ends[:-1]).all()
    got = {r.doc_id: r for r in piece_encoding.encoding_digest(odd, path).collect()}
    for i, t in ODD:
        ids = [1, *library.encode(t or ""), 2]
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    whole = piece_encoding.decode_pieces(piece_encoding.encode_pieces(docs, path, keep=["doc_id"]), path).join(docs.select("doc_id", "text"), "doc_id")
    assert whole.filter("decoded <> text").count() == 0
    assert piece_encoding.encoding_digest(empty, path).count() == 0


def darts(pairs: dict[bytes, int]) -> bytes:
    """A double-array trie of byte strings to values, placed one node after the other."""
    trie: dict = {}
    for key, value in pairs.items():
        node = trie
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = value
    units, taken = {0: 0}, {0}
    queue = [(0, trie)]
    while queue:
        at, node = queue.pop()
        labels = [0 if c == -1 else c for c in node]
        base = next(b for b in range(1, 1 << 20) if all(b ^ c not in taken for c in labels) and (at ^ b) < 1 << 21)
        units[at] = (units[at] & ~(0x1FFFFF << 10)) | ((at ^ base) << 10) | ((-1 in node) << 8)
        for c, child in node.items():
            if c == -1:
                taken.add(base)
                units[base] = child | 1 << 31
            else:
                taken.add(base ^ c)
                units[base ^ c] = c
                queue.append((base ^ c, child))
    size = (max(units) | 255) + 1
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *[units.get(i, 0) for i in range(size)])


def test_character_map_matches_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(entry.tokenizer_path("piece_bpe_32k.model"), "rb").read())
    rules = {"ﬁ": "fi", "①": "1", "Ａ": "A", "ab": "xyz", "abc": "q", "　": " ", "é": "é"}
    targets, at = b"", {}
    for k, v in rules.items():
        at[k.encode()] = len(targets)
        targets += v.encode() + b"\0"
    proto.normalizer_spec.precompiled_charsmap = darts(at) + targets
    blob = proto.SerializeToString()
    model, library = piece_encoding.PieceModel(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    for text in ["ofﬁce ① ＡＢ", "ab abc abcd aab", "café x　y", "plain text", "ﬁ", "ab"]:
        ids, begins, ends = model.encode(text)
        assert ids.tolist() == library.encode(text), text
        assert (begins[1:] == ends[:-1]).all() and ends[-1] == len(text.encode())
    normal, source = model.map.normalise("xﬁy")
    assert normal == "xfiy" and source.tolist() == [0, 1, 1, 4, 5]


def test_random_character_maps_match_library():
    """300 random rules: keys that are prefixes of others, several bytes long, next to characters without a rule."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng = np.random.default_rng(12)
    proto = pb.ModelProto()
    proto.ParseFromString(open(entry.tokenizer_path("piece_bpe_32k.model"), "rb").read())
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    for _ in range(30):
        rules = {draw("abcéﬁ漢", rng.integers(1, 4)): draw("xyz é2th", rng.integers(1, 4)).strip() or "q" for _ in range(10)}
        targets, at = b"", {}
        for k, v in rules.items():
            at[k.encode()] = len(targets)
            targets += v.encode() + b"\0"
        proto.normalizer_spec.precompiled_charsmap = darts(at) + targets
        blob = proto.SerializeToString()
        model, library = piece_encoding.PieceModel(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
        for _ in range(30):
            text = draw("abcéﬁ漢d .", rng.integers(1, 30))
            ids, begins, ends = model.encode(text)
            assert ids.tolist() == library.encode(text), (rules, text)
            assert (begins[1:] == ends[:-1]).all() and ends[-1] == len(text.encode())


def plain_statistics(text):
    w, raw = words(text), (text or "").encode()
    if not w:
        return [0.0] * 12
    count = lambda pattern: len(re.findall(pattern, raw))
    b, upper, lower = [x.encode() for x in w], count(rb"[A-Z]"), count(rb"[a-z]")
    same, seen = sum(x == y for x, y in zip(b, b[1:])), len({tuple(b[i : i + 3]) for i in range(len(b) - 2)})
    return [count(rb"[#*$%&<>]") / len(b), count(rb"\|") / len(b), count(rb"!") / len(b), upper / max(1, upper + lower), count(rb"[0-9]") / len(raw), count(rb"[.,]") / len(b), count(rb"\n") / len(b), np.log(len(raw) / len(b)), same / len(b), len(set(b)) / len(b) ** 0.9, 1 - seen / (len(b) - 2) if len(b) > 2 else 0.0, (upper + lower + count(rb"[\x80-\xff]")) / len(raw)]


def test_quality_classifier_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = quality_classifier.training_labels(labels).filter("doc_id is not null and label in (0, 1)")
    rows = docs.join(train.withColumn("h", F.xxhash64("doc_id", F.lit(7))), "doc_id").select("text", "label", "h").collect()
    x, y = np.array([plain_statistics(r.text) for r in rows]), np.array([float(r.label) for r in rows])
    fit = np.array([r.h & 1 == 0 for r in rows])
    rng = np.random.default_rng(7)
    weights, phase = rng.normal(0, np.sqrt(0.1), (12, 256)), rng.uniform(0, 2 * np.pi, 256)
    scale = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    feature = lambda s: np.column_stack([np.cos(np.clip((s - x.mean(0)) / scale, -6, 6) @ weights + phase) * np.sqrt(2 / 256), np.ones(len(s))])
    # Ridge as least squares over rows of the penalty's root.
    penalty = np.sqrt(np.append(np.full(256, 1e-3 * fit.sum() / 256), 0) + 1e-9)
    beta = np.linalg.lstsq(np.vstack([feature(x[fit]), np.diag(penalty)]), np.append(y[fit], np.zeros(257)), rcond=None)[0]
    raw = feature(x[~fit]) @ beta
    order = np.argsort(raw, kind="stable")
    r, z = raw[order], y[~fit][order]
    sums = np.concatenate(([0], np.cumsum(z)))
    # The isotonic value of a row: over all begins up to it the largest, over all ends from it the least mean.
    mean = lambda i, j: (sums[j] - sums[i]) / (j - i)
    value = np.array([max(min(mean(i, j) for j in range(k + 1, len(z) + 1)) for i in range(k + 1)) for k in range(len(z))]).round(12)
    blocks = [np.flatnonzero(value == v) for v in np.unique(value)]
    knots = [r[b].mean() for b in blocks], np.maximum.accumulate([(z[b].sum() + 0.5) / (len(b) + 1) for b in blocks])
    every = docs.select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in every], np.interp(feature(np.array([plain_statistics(d.text) for d in every])) @ beta, *knots)))
    got = {d.doc_id: d.score for d in quality_classifier.quality_scores(docs, labels).collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-4


def test_quality_classifier(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out and quality is not null").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    # held-out labels have no influence
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_classifier.quality_scores(docs, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert np.allclose(a.score, b.score)
    none = quality_classifier.quality_scores(odd, labels.limit(0)).collect()
    assert len(none) == 12 and {r.score for r in none} == {0.5}
    assert all(0 <= r.score <= 1 for r in quality_classifier.quality_scores(odd, labels.withColumn("doc_id", F.col("doc_id") % 11)).collect())
    assert quality_classifier.quality_scores(empty, labels).count() == 0


def test_pooled_violators():
    x, y = quality_classifier.pooled_violators(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and len(x) == 3


def components(rows, width, p, q):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and q * len(a & b) >= p * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width,threshold", [(3, (9, 10)), (5, (4, 5))])
def test_jaccard_join(spark, docs, odd, empty, width, threshold):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, width=width, threshold=threshold).collect()}
    assert got == components(texts_of(docs), width, *threshold)
    rows = jaccard_join.jaccard_components(odd, width=width, threshold=threshold).collect()
    assert len(rows) == 12 and {(r.doc_id, r.component_id) for r in rows} == {(i, 6 if i == 7 else i) for i, _ in ODD} | {(None, None)}
    assert jaccard_join.jaccard_components(empty, width=width, threshold=threshold).count() == 0


def test_jaccard_join_of_late_levels(spark, monkeypatch):
    """Groups of one hub stay apart from the first level on, as they do from the thirteenth in earnest."""
    monkeypatch.setattr(jaccard_join._rows_with_components, "__defaults__", (0,))
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        own = list(base)
        for k in rng.choice(150, rng.integers(1, 6), replace=False):
            own[k] = f"x{i % 7}y{k}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, threshold in ((3, (9, 10)), (5, (4, 5))):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, width=width, threshold=threshold).collect()}
        assert got == components(rows, width, *threshold)


def test_jaccard_join_family(spark):
    """A family of near copies around the threshold, where few pairs link: no link may be lost."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in rng.choice(160, rng.integers(1, 5), replace=False):
            own[k] = f"x{i}y{k}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == components(rows, 3, 9, 10)
    assert jaccard_join.one_of_each(docs).count() == len({c for _, c in got.values()})


def test_jaccard_join_family_meets_in_blocks(spark, monkeypatch):
    """Mates of one hub, a third of them no links of it, are compared in blocks: no edit of theirs becomes a row."""
    monkeypatch.setattr(jaccard_join, "_smaller_groups", lambda mates: pytest.fail("edits of mates are exploded"))
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(240):
        own = list(base)
        for k in rng.choice(150, rng.integers(1, 9), replace=False):
            own[k] = f"x{i if i % 3 else i // 6}y{k}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, width=5, threshold=(4, 5)).collect()}
    assert got == components(rows, 5, 4, 5) and 20 < len({c for _, c in got.values()}) < 220


@pytest.mark.parametrize("block", [0, 15])
def test_jaccard_join_in_smaller_groups(spark, monkeypatch, block):
    """More mates outside the largest component than a block has, so that mates go on under their edits; or blocks and edits in turn."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    test_jaccard_join_family(spark)
    test_jaccard_join_loses_no_link(spark, 5, (4, 5))
    with monkeypatch.context() as late:
        test_jaccard_join_of_late_levels(spark, late)


def test_uniting_links_of_unlike_bitmaps():
    rng = np.random.default_rng(9)
    base = np.arange(60, 130, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.sort(np.delete(base, rng.choice(70, k, replace=False))) for k in (0, 2, 3, 9, 20, 30, 8, 5)]
    bits = [jaccard_join.bitmap(x) for x in sets]
    assert len({len(b) for b in bits}) > 1
    labels, outside = np.array([5, 5, 3, 3, 9, 7, 1, 2]), np.array([False, False, True, True, True, True, True, True])
    found = jaccard_join.uniting_links(sets, bits, labels.copy(), np.ones(8, bool), outside, 4, 5)
    link = lambda i, j: 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
    assert all(link(i, j) for i, j in found)
    root = labels.copy()
    for i, j in found:
        assert root[i] != root[j]
        root[root == root[i]] = root[j]
    assert all(root[i] == root[j] for i in range(8) for j in range(8) if link(i, j))


@pytest.mark.parametrize("width,threshold", [(3, (9, 10)), (5, (4, 5))])
def test_jaccard_join_loses_no_link(spark, width, threshold):
    """Groups around the threshold whose edits are shared in many ways, with all of them in the same tiles."""
    rng = np.random.default_rng(width)
    rows = []
    for g, kind in enumerate(["replaced", "deleted", "families", "shared words"]):
        base = [f"g{g}w{i}" for i in range(120)]
        made = [base]
        for i in range(90):
            own = list(made[rng.integers(len(made))] if kind == "families" else base)
            for k in sorted(rng.choice(len(own), rng.integers(1, 6), replace=False), reverse=True):
                if kind == "deleted":
                    del own[k]
                else:
                    own[k] = f"x{rng.integers(3)}" if kind == "shared words" else f"x{i}y{k}"
            made.append(own)
        rows += [(1000 * g + i, " ".join(x)) for i, x in enumerate(made) if i]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=width, threshold=threshold).collect()}
    want = components(rows, width, *threshold)
    assert got == want and 20 < len({c for _, c in want.values()}) < len(rows) - 20


def test_shared_edits_are_in_their_places():
    """Two sets that link, of which one is no link of the hub, share an edit within the limits of both, in any order, and far keys that count."""
    rng = np.random.default_rng(8)
    tried = 0
    for p, q in ((9, 10), (4, 5)):
        for _ in range(3000):
            hub = np.unique(rng.integers(0, 1 << 60, rng.integers(20, 60), dtype=np.uint64))
            pool = np.unique(rng.integers(0, 1 << 60, 8, dtype=np.uint64))
            sets = [np.union1d(rng.choice(hub, len(hub) - rng.integers(0, 6), replace=False), rng.choice(pool, rng.integers(0, 8), replace=False)) for _ in range(2)]
            links = lambda x, y: q * len(np.intersect1d(x, y)) >= p * len(np.union1d(x, y))
            near = [links(x, hub) for x in sets]
            if links(*sets) and not all(near) and not np.array_equal(*sets):
                tried += 1
                edits = [jaccard_join.by_sketch(*jaccard_join.edits_of(x, hub), np.arange(256) % 7) for x in sets]
                bounds = [jaccard_join.limits(len(e), len(x), len(hub), p, q) for e, x in zip(edits, sets)]
                order = rng.permutation(np.union1d(*edits)).tolist()
                placed = [sorted(e.tolist(), key=order.index) for e in edits]
                first = next(e for e in order if e in placed[0] and e in placed[1])
                at = [x.index(first) + 1 for x in placed]
                assert all(k <= (z if near[1 - i] is False and near[i] else most) for i, (k, (z, _, most)) in enumerate(zip(at, bounds)))
                if not any(near):
                    assert all(k <= z for k, (z, _, _) in zip(at, bounds)) and any(k <= few for k, (_, few, _) in zip(at, bounds))
                (k1, c1), (k2, c2) = (jaccard_join.far_keys(e, n, *b, jaccard_join.meets_links(len(e), len(x), len(hub), p, q)) for e, n, b, x in zip(edits, near, bounds, sets))
                assert any(c1[k1 == k].any() or c2[k2 == k].any() for k in np.intersect1d(k1, k2))
    assert tried > 100


def test_one_of_each_keeps_every_text(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abc"}
    rows = [(3, "a"), (6, "a"), (6, "b"), (7, "b"), (8, "c"), (8, "c"), (None, "c")]
    docs = spark.createDataFrame([(i, text[k], "x", i) for i, k in rows] + [(9, None, "x", 9), (9, "", "x", 9)], "doc_id long, text string, _id string, mark long")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "")[:1]) for r in kept.collect()) == [("3", "a"), ("6", "b"), ("8", "c"), ("9", ""), ("9", ""), ("None", "c")]


def test_overlap_bound_is_a_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 3000, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(rng.integers(0, 3000, rng.integers(1, 2000), dtype=np.uint64))
        assert jaccard_join.overlap_bound(jaccard_join.bitmap(a), len(a), jaccard_join.bitmap(b), len(b)) >= len(np.intersect1d(a, b))


def test_license_scan(spark, odd, empty):
    got = {r.doc_id: r for r in license_scan.license_scan(odd).collect()}
    assert (got[10].n_base, got[10].first_word, got[10].last_word, got[10].base_labels, got[10].score) == (3, 0, 6, "cc-by,reserved", 1.0)
    assert got[1].n_words == 0 and got[1].first_word is None and got[1].labels == "" and got[1].score == 0.0
    text = "x\nPermission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the Software without\nMIT license released under the\n"
    found = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert found.labels == "mit,mit-grant" and found.base_labels == ""
    wrapped = "x\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction.\n \nÀ CC BY"
    found = license_scan.license_scan(spark.createDataFrame([(1, wrapped)], "doc_id long, text string")).first()
    assert found.labels == "cc-by,mit-grant" and found.base_labels == "cc-by" and found.first_word == found.n_words - 2
    assert license_scan.license_words(F.lit("x")) is not None and spark.range(1).select(license_scan.license_words(F.lit("ÀB c"))).first()[0] == ["Àb", "c"]
    assert license_scan.license_scan(empty).count() == 0
    lost = license_scan.license_scan(spark.createDataFrame([(None, text), (None, "no notice"), (None, text)], "doc_id long, text string")).collect()
    assert sorted(r.labels for r in lost) == ["", "mit,mit-grant", "mit,mit-grant"]


def test_license_join_equals_brute_force(docs):
    rng = ["the of and a", "thand oner with", "la le de en et"]
    templates = {f"t{i}": t for i, t in enumerate(rng)}
    got = {(r.doc_id, r.block, r.label) for r in license_scan.matching_blocks(docs, templates, 0.6).collect()}
    tokens = license_scan.template_tokens(templates)
    want = set()
    for i, t in texts_of(docs):
        for b, part in enumerate(re.split(r"\n[\x20\x09-\x0D]*\n", t)):
            own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), part)))
            want |= {(i, b, k) for k, v in tokens.items() if len(own & set(v)) >= -(-len(v) * 6 // 10)}
    assert got == want and got


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    model = language_id.fit_language(language_id.training_texts(docs))
    by = {}
    for r in docs.filter("length(text) > 800").select("lang", "text").collect():
        by.setdefault(r.lang, " ".join(words(r.text)[:60]))
    (lang, share, spans), *_ = model.label([by["en"] + " " + by["fr"] + " " + by["en"]])
    assert lang == "en" and [s[2] for s in spans] == ["en", "fr", "en"] and 0.5 < share < 0.9
    rows = {r.doc_id: r for r in language_id.language_predictions(odd).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0.0 for i in (1, 2, 3))
    assert language_id.language_predictions(empty).count() == 0
    assert language_id.label_languages(odd, model, least_share=0.5).filter("doc_id in (1, 2, 3)").count() == 0


def test_viterbi_equals_brute_force():
    import itertools

    rng = np.random.default_rng(3)
    model = language_id.LanguageModel(["a", "b", "c"], np.zeros((1, 3)), np.zeros((1, 3), bool), 0, 1.5)
    value = lambda s, p: sum(s[i, j] for i, j in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))
    for _ in range(60):
        s = -rng.random((6, 3)) * 3
        assert np.isclose(value(s, model.path(s)), max(value(s, p) for p in itertools.product(range(3), repeat=6)))


def test_viterbi_leaves_a_language_between_two_others():
    import itertools

    model = language_id.LanguageModel(["a", "b", "c"], np.zeros((1, 3)), np.zeros((1, 3), bool), 0, 25.0)
    s = np.array([[-4.0, 0.0, -12.0]] * 6 + [[-4.0, -12.0, 0.0]] * 6)
    assert model.path(s).tolist() == [1] * 6 + [2] * 6
    value = lambda s, p: sum(s[i, j] for i, j in enumerate(p)) - 25.0 * sum(x != y for x, y in zip(p, p[1:]))
    rng = np.random.default_rng(4)
    for _ in range(60):
        s = -rng.random((6, 3)) * 30
        assert np.isclose(value(s, model.path(s)), max(value(s, p) for p in itertools.product(range(3), repeat=6)))


def greedy(word, heads, tails):
    n, at = 0, 0
    while at < len(word):
        own = tails if at else heads
        end = next((e for e in range(len(word), at, -1) if word[at:e] in own), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_token_counts(spark, docs, odd, empty):
    rng = np.random.default_rng(2)
    make = lambda n: {"".join(rng.choice(list("ab"), rng.integers(1, 6))) for _ in range(n)}
    for _ in range(30):
        heads, tails = make(6), make(6)
        automaton = token_counts.LongestMatch(heads, tails)
        for _ in range(50):
            w = "".join(rng.choice(list("abc"), rng.integers(1, 14), p=[0.48, 0.48, 0.04]))
            assert automaton.count(w) == greedy(w, heads, tails), (w, heads, tails)
    path = entry.tokenizer_path("piece_bpe_32k.model")
    assert token_counts.token_counts(odd, path).count() == 12 and token_counts.token_counts(empty, path).count() == 0


def test_token_counts_take_the_uncut_vocabulary(spark, docs, odd):
    from sentencepiece import sentencepiece_model_pb2 as pb

    path, proto = entry.tokenizer_path("piece_bpe_32k.model"), pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    every = {p.piece for p in proto.pieces if p.type == 1}
    plain = spark.createDataFrame([(1, "2024"), (2, "ñ ça 5% a▁b ▁▁▁x"), (3, "a\U000f1234b \U000f1234")], "doc_id long, text string")
    got = {r.doc_id: r.asDict() for r in token_counts.token_counts(plain, path).collect()}
    assert got[1] == {"doc_id": 1, "n_words": 1, "n_tokens": 5, "n_unknown": 0}
    assert got[3] == {"doc_id": 3, "n_words": 2, "n_tokens": 2, "n_unknown": 2}
    for frame in (plain, docs, odd):
        for r in token_counts.token_counts(frame, path).join(frame.select("doc_id", "text").distinct(), "doc_id").collect():
            each = [greedy("▁" + w, every, every) for w in words(r.text)]
            assert (r.n_words, r.n_tokens, r.n_unknown) == (len(each), sum(map(abs, each)), each.count(-1))


def test_chat_format(spark):
    rows = [(1, 0, "system", "be </s> good"), (1, 1, "user", None), (1, 2, "assistant", "a\\[INST] <\\s> <<s>"), (1, 3, "user", "[/INST]\n<"), (1, 4, "assistant", "</s"), (1, 5, "user", "tail"), (2, 0, "user", "only"), (None, 0, None, "x"), (None, 0, None, "x"), (3, 0, "assistant", ""), (3, 1, "assistant", "[INST][INST] <\\\\/s>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    examples = chat_format.chat_examples(turns)
    by = {}
    for r in examples.collect():
        by.setdefault(r.conv_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 3, 2: 1, None: 1, 3: 2}
    got = {r.conv_id: r for r in chat_format.chat_digest(examples).collect()}
    for key in (1, 2, 3, None):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == key]
        said, loss = "".join(f"{r}\n{t}\n" for r, t in own), "".join(t for r, t in own if r == "assistant")
        g = got[key]
        assert (g.n_turns, g.loss_chars) == (len(own), len(loss)), key
        assert g.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert g.formatted_chars == sum(len(r.formatted) for r in by[key])
    for r in by[1]:
        assert r.formatted.count("</s>") == r.formatted.count("<s>") == r.formatted.count("[INST] ")
    assert chat_format.chat_digest(chat_format.chat_examples(turns.limit(0))).count() == 0


def test_very_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k} </s> [INST] " + "x" * (k % 50)) for k in range(240)] + [(2, 0, "assistant", "words " * 50_000)]
    got = {r.conv_id: r for r in chat_format.chat_digest(chat_format.chat_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))).collect()}
    for key in (1, 2):
        own = [(r[2], r[3]) for r in rows if r[0] == key]
        said, loss = "".join(f"{r}\n{t}\n" for r, t in own), "".join(t for r, t in own if r == "assistant")
        assert (got[key].n_turns, got[key].loss_chars) == (len(own), len(loss))
        assert got[key].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[key].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_fingerprints(spark, docs, odd, empty):
    rows = sorted(texts_of(docs), reverse=True)
    follow = {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
    got = {r.doc_id: r for r in fingerprints.fingerprint_pairs(docs).collect()}
    error = []
    for i, t in rows:
        cut = len(t) // 3
        edited = t[: len(t) - cut] + follow[i][:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        a, b = (set(zip(*[words(x)[k:] for k in range(5)])) for x in (t, edited))
        if len(a) > 50:
            error.append(got[i].near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.08
    texts = {}
    for i, t in rows:
        texts.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in texts.values())
    rows = fingerprints.fingerprint_pairs(odd).collect()
    assert len(rows) == 12 and {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {""}
    assert len({r.fingerprint for r in rows if r.doc_id in (6, 7)}) == 1
    assert fingerprints.fingerprint_pairs(empty).count() == 0


def test_next_row_over_buckets(spark):
    ids = [0, 1, 2, 3, 500, 501, 10_000, 99_999, 100_000, 7_000_000]
    d = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r["after"]["text"] for r in fingerprints.with_next(d, per_bucket=2).collect()}
    far = [-9_000_000_000_000_000_000, *range(1, 4000), 1_000_000_000_000_000, 9_000_000_000_000_000_000]
    table = spark.createDataFrame([(i, f"t{i}") for i in far] + [(None, f"n{i}") for i in range(3000)], "doc_id long, text string")
    sizes = {r.bucket: r["count"] for r in fingerprints.with_buckets(table, per_bucket=100).groupBy("bucket").count().collect()}
    assert len(sizes) > 50 and max(sizes.values()) < 400
    after = {r.doc_id: r["after"]["text"] for r in fingerprints.with_next(table.filter("doc_id is not null"), per_bucket=100).collect()}
    down = sorted(far, reverse=True)
    assert after == {i: f"t{down[(k + 1) % len(down)]}" for k, i in enumerate(down)}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    buckets = spark.createDataFrame([(i * 3,) for i in range(100)], "bucket long")
    follow = {r.bucket: r.next for r in fingerprints.next_bucket(buckets, fan=4).collect()}
    assert follow == {i * 3: (i - 1) * 3 if i else 297 for i in range(100)}


def check_packing(rows, texts, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(entry.tokenizer_path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i]), i
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing(spark, docs, odd, empty):
    path = entry.tokenizer_path("word_bpe_49k.json")
    assert check_packing(packing.pack_documents(docs, path).collect(), texts_of(docs)) == 0
    assert check_packing(packing.pack_documents(docs.repartition(5), path, window=40).collect(), texts_of(docs)) == 0
    plain = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack_documents(plain, path).collect(), texts_of(plain))
    assert packing.pack_documents(odd, path).agg(F.sum("length")).first()[0] > 0
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_keeps_fewer_words_in_the_pipeline(spark, docs):
    import corpus_pipeline

    path = entry.tokenizer_path("word_bpe_49k.json")
    assert packing.word_ids(path, corpus_pipeline.CACHED_WORDS).limit * 4 <= packing.word_ids(path).limit
    few, many = (sorted(map(tuple, packing.pack_documents(docs.coalesce(1), path, **o).collect())) for o in ({"cached": 50}, {}))
    assert few == many


def test_word_ids_equal_whole_text(docs):
    from tokenizers import Tokenizer

    path = entry.tokenizer_path("word_bpe_49k.json")
    tokenizer, cache = Tokenizer.from_file(path), packing.word_ids(path)
    odd_texts = ["Don't I'LL we've 12ab3. É́x, Σας ΣΑΣ İstanbul", "a b   c", "<|endoftext|> x <|startoftext|>y", "日本語。テスト ١٢٣ ²³ ½", "x́ ́y ...,, .", "lİ, İ. İİ., aİ", "A.B,C 3.14, 1,000."]
    rng = np.random.default_rng(6)
    fuzz = ["".join(rng.choice(list("aBzİıΣσςéÉß.,'1 -ñ\u0301\u4e2d"), 12)) for _ in range(3000)]
    for text in odd_texts + fuzz + [t for _, t in texts_of(docs)][:80]:
        got = np.frombuffer(packing.token_bytes(text, cache, 1), "<u4").tolist()
        assert got == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text[:50]


def test_fill_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(100):
        p = packing.Packer(0, 64)
        sizes = rng.integers(1, 60, rng.integers(1, 12)).tolist()
        for k, n in enumerate(sizes):
            list(p.add(k, b"\0\0\0\0" * n))
        chosen, slack = p.fill(64)
        longest = max(sizes)
        rest = sorted(sizes)[:-1]
        sums = {0}
        for n in rest:
            sums |= {s + n for s in sums if s + n <= 64 - longest}
        assert slack == 64 - longest - max(sums) and sum(n * k for n, k in chosen.items()) == 64 - slack
        assert all(Counter(sizes)[n] >= k for n, k in chosen.items())


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = entry.table(spark, sf, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == corpus_pipeline.COLUMNS, name
        rows = out.collect()
        if name == "near_duplicates":
            want = components(texts_of(kept), 5, 4, 5)
            assert {r.doc_id for r in rows} == {i for i, (_, c) in want.items() if i == c}
        kept = spark.createDataFrame(rows, docs.schema)
    assert kept.count() < docs.count()
    assert check_packing(corpus_pipeline.run(spark, sf).collect(), texts_of(kept)) < 2048


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == corpus_pipeline.COLUMNS, name
        kept[name] = sorted(str(r.doc_id) for r in out.collect())
        assert stage(spark, empty, sf).count() == 0, name
    assert not set(kept["language"]) & {"1", "2", "3"} and set(kept["quality"]) <= {str(i) for i, _ in ODD} | {"None"}
    assert kept["near_duplicates"] == sorted(["1", "10", "2", "3", "4", "5", "6", "8", "9", "None"])
    name, pack = corpus_pipeline.STAGES[-1]
    packed = pack(spark, odd, sf)
    assert packed.groupBy("doc_id").agg(F.sum("length")).count() == 11 and pack(spark, empty, sf).count() == 0
