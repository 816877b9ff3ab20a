"""N-gram Jaccard join: size-banded tiles, hashed bitmaps that bound the overlap, exact intersection of sorted arrays.

A document is its set of distinct word shingles. Equal sets are one class (a 64-bit content hash), so copies never
meet as pairs. Classes meet in tiles. A tile is a size band and either

* a slice: the shingles of a band are dealt by hash to more slices than two linked sets can differ in, so by the
  pigeonhole principle two linked sets have an equal slice (thresholds of 0.85 and more), or
* a prefix shingle: one of a set's first n - ceil(t n) + 1 shingles in a global order from rare to frequent, of
  which two linked sets share one at least (lower thresholds). The order comes from a count sketch over all rows; any
  order is exact, a good one keeps common passages out of the prefixes.

No group is expanded into pairs. Each tile has a hub, and its mates are compared with the hub only (where few are outside its largest component, with these): a bound from bit counts first (bits
that only one bitmap has are shingles that only that set has), then the sorted arrays exactly. Where mates of a hub are left in different
components, those outside the largest one, if there are up to BLOCK of them, are compared with all of its mates: a task holds them and a block of as many
mates, takes bit counts of one mate and all of them at once, and gives only links that unite two components, so a mate costs no more in a
larger family. Where there are more, the mates go on to smaller groups, again with a hub each, until no group has two components:

Let E be the edits of a mate against its hub, the k shingles that only one of both has. Sets x and y that link differ in
c (n_x + n_y) shingles at most, where c = (1 - t) / (1 + t), so they share o >= (k_x + k_y - c (n_x + n_y)) / 2 edits, and in any
order of the edits the first shared one is among the first k - o + 1 of each. x or y is no link of the hub (else both are in its component),
say k_y > c (n_y + n_hub). So

* x has the shared edit in a place before (k_x + c (n_x - n_hub)) / 2 + 1;
* the one with fewer edits has it among its first d / 2 + 1 and the other among its first d + 1, where d = n (1 - t) / t is the most
  that a set can differ from a link.

A group is a hub and such an edit. Links of the hub meet those that are none in one kind of group, and those meet each other in another kind.
Edits of mates near the hub stand in order from rare to frequent among the hub's mates, so the hub's own oddities, which all others lack,
come last; those of mates far from it (over FAR times d edits, where linked mates are both near or both far, and those between are taken
as both) are many and stand by a count sketch: new ones from rare to frequent, then missing ones from frequent to rare. A hub is no member of its own groups, so groups shrink from level to level.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import count
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, BoundedCache, Scratch, broadcast_if_small, cut_lineage, map_texts, mix64, small_batches
from .components import connected_components

U64 = np.uint64
NONE = np.zeros(0, U64)
#: Tells keys among those that are no links of a hub from keys shared with its links.
OTHER_KIND = np.uint64(0xA5A5A5A55A5A5A5A)
#: A mate with more than so many times the edits that a link of its hub can have at most is far from it.
FAR = 4
#: Below so many rows outside a group's largest component so far, each of them is a hub.
SMALL = 24
#: Up to so many mates of a hub outside their largest component so far, of so many shingles in all, are compared with all its mates, a block of mates in a task.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
_word_hash = BoundedCache(xxhash.xxh3_64_intdigest, 60_000)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one after the other; and where each text's begin (and the end)."""
    words: list[bytes] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            own = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
            sizes[i] = len(own)
            words += own
    w = np.fromiter(map(_word_hash.__getitem__, words), U64, len(words))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    parts, counts = [], np.zeros(len(texts), np.int64)
    if len(w) >= width:
        h = np.zeros(len(w) - width + 1, U64)
        for j in range(width):
            h = mix64(h + w[j : j + len(h)] * _ODD[j % len(_ODD)])
    for i, n in enumerate(sizes):
        if n >= width:
            own = np.sort(h[begins[i] : begins[i] + n - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            own = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[begins[i] : begins[i + 1]]), seed=int(n))], U64)
        else:
            continue
        parts.append(own)
        counts[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, U64), np.concatenate(([0], np.cumsum(counts)))


def content_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set, from the sum of its shingles' mixed hashes and its size."""
    n = np.diff(at)
    total = np.zeros(len(n), U64)
    np.add.at(total, np.repeat(np.arange(len(n)), n), mix64(h ^ U64(0x5851F42D4C957F2D)))
    return mix64(total + n.astype(U64)).view(np.int64)


class Bands:
    """Size bands of sliced tiles: their bounds, slices and how many light slices a set may leave out."""

    def __init__(self, threshold: Fraction, ratio: float = 1.4, top: int = 1 << 31):
        self.t, self.low = threshold, [max(2, ceil(threshold / (1 - threshold)))]
        while self.low[-1] < top:
            self.low.append(max(self.low[-1] + 1, ceil(self.low[-1] * ratio)))
        self.slices, self.spare = [], []
        for a, b in zip(self.low, self.low[1:]):
            apart = int((b - 1) * (1 - threshold) / threshold)  # the most that linked sets can differ in
            spare = 1
            for _ in range(30):
                m = apart + 1 + spare
                light = m * exp(-a / m) * (1 + a / m)
                if spare >= (wanted := ceil(light + 2 * sqrt(light))) or spare > apart:
                    break
                spare = wanted
            self.slices.append(apart + 1 + spare)
            self.spare.append(spare)
        self.low, self.slices, self.spare = np.array(self.low), np.array(self.slices), np.array(self.spare)

    def of(self, n: np.ndarray) -> np.ndarray:
        """The band of a size; -1 below the first, where linked sets are equal sets."""
        return np.searchsorted(self.low, n, side="right") - 1


def sliced_tiles(h: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, tile) of each row's tiles. A set joins its own band and those below where a smaller mate can stand."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    top = bands.of(n)
    p, q = bands.t.numerator, bands.t.denominator
    bottom = np.maximum(bands.of(-(-n * p // q)), 0)
    rows, tiles = [], []
    for step in range(int((top - bottom).max(initial=-1)) + 1):
        band = top - step
        live = (band >= bottom) & (top >= 0)
        if not live.any():
            break
        use = live[row]
        b = np.where(live, band, 0)
        m = np.where(live, bands.slices[b], 0)
        first = np.concatenate(([0], np.cumsum(m)))
        slot = first[row[use]] + (h[use] % m[row[use]].astype(U64)).astype(np.int64)
        total = np.zeros(first[-1], U64)
        np.add.at(total, slot, mix64(h[use] + U64(1)))
        light = np.bincount(slot, minlength=first[-1]) < 2
        owner = np.repeat(np.arange(len(n)), m)
        n_light = np.bincount(owner, light, minlength=len(n))
        keep = ~light | (n_light > bands.spare[b])[owner]
        index = np.arange(first[-1]) - first[owner]
        rows.append(owner[keep])
        tiles.append(mix64(total[keep] + mix64((b[owner[keep]] * (1 << 32) + index[keep]).astype(U64))))
    return (np.concatenate(rows), np.concatenate(tiles)) if rows else (np.zeros(0, np.int64), np.zeros(0, U64))


def prefix_tiles(h: np.ndarray, at: np.ndarray, threshold: Fraction, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, sketch[_slots(h, len(sketch).bit_length() - 1)], row))
    p, q = threshold.numerator, threshold.denominator
    length = np.where(n > 0, n + (-n * p) // q + 1, 0)
    keep = np.arange(len(h)) - at[:-1][row] < length[row]
    return row[keep], mix64(h[order][keep])


def bitmap_bits(n: int) -> int:
    """Bits of a set's bitmap: a power of two from 256 to 16384, four for each shingle where that is less."""
    return min(16384, max(256, 1 << max(0, (4 * n - 1)).bit_length()))


def bitmap(own: np.ndarray) -> bytes:
    bits = np.zeros(bitmap_bits(len(own)), np.uint8)
    bits[(own & U64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """The most shingles that sets with these bitmaps can share. The larger bitmap is folded to the smaller's size."""
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    if len(x) > len(y):
        x = np.bitwise_or.reduce(x.reshape(-1, len(y)), axis=0)
    elif len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted arrays without repeats share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _summed_sketch(tallies: DataFrame, bits: int) -> np.ndarray:
    got = tallies.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def _tally(parts, bits: int):
    """One batch (slot, n) of how many of the hashes in all parts have each first bits."""
    total = np.zeros(1 << bits, np.int64)
    for h in parts:
        total += np.bincount(_slots(h, bits), minlength=1 << bits)
    used = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["slot", "n"])


def text_sketch(docs: DataFrame, text_col: str, width: int, bits: int) -> np.ndarray:
    """Shingle counts of all rows by the first bits of their hashes; a table of fixed size."""

    def run(batches):
        texts = (batch.column(0).slice(lo, 500).to_pylist() for batch in batches for lo in range(0, batch.num_rows, 500))
        yield _tally((shingle_sets(t, width)[0] for t in texts), bits)

    return _summed_sketch(docs.select(text_col).mapInArrow(run, "slot long, n long"), bits)


def set_sketch(nodes: DataFrame, bits: int) -> np.ndarray:
    """The same of sorted arrays."""

    def run(batches):
        yield _tally((np.frombuffer(x, U64) for batch in batches for x in batch.column(0).to_pylist()), bits)

    return _summed_sketch(nodes.select("set").mapInArrow(run, "slot long, n long"), bits)


def places(k: int, n: int, n_hub: int, p: int, q: int) -> int:
    """Edits of a mate (k of them, n shingles) among which the first one shared with a link that is no link of the hub must be."""
    whole = 2 * (p + q)
    return max(0, min(k, (k * (p + q) + (q - p) * (n - n_hub) + whole - 1) // whole))


def edits_of(own: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that only the first and that only the second of two sorted arrays has."""
    at = np.searchsorted(hub, own)
    shared = hub[np.minimum(at, len(hub) - 1)] == own
    missing = np.ones(len(hub), bool)
    missing[at[shared]] = False
    return own[~shared], hub[missing]


def by_sketch(new: np.ndarray, missing: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    count = lambda h: sketch[_slots(h, len(sketch).bit_length() - 1)]
    return np.concatenate((new[np.lexsort((new, count(new)))], missing[np.lexsort((missing, -count(missing)))]))


def limits(k: int, n: int, n_hub: int, p: int, q: int) -> tuple[int, int, int]:
    """Places (from 1) up to which the first edit shared with a link can be: with one that is no link of the hub; for the one with fewer edits; for any."""
    most = n * (q - p) // p + 1
    return min(places(k, n, n_hub, p, q), most), n * (q - p) // (2 * p) + 1, most


def meets_links(k: int, n: int, n_hub: int, p: int, q: int) -> bool:
    """Whether a mate with k edits can link with a link of the hub: both differ by c (n + n_hub) at most, where their sizes are n q / p at most."""
    return k * p * (p + q) <= (q - p) * (2 * q * min(n, n_hub) + p * (n + n_hub))


def far_keys(edits: np.ndarray, linked: bool, z: int, few: int, most: int, meets: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The edits under which a mate far from its hub goes on, as 64-bit keys, and which of them make a group count."""
    if linked:
        return mix64(edits[:z]), np.ones(len(edits[:z]), bool)
    met, own = edits[: most * meets], edits[:z]
    return np.concatenate((mix64(met), mix64(own ^ OTHER_KIND))), np.concatenate((np.zeros(len(met), bool), np.arange(len(own)) < few))


def _with_both(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    for side in ("cls", "hub"):
        pairs = pairs.join(nodes.select(F.col("cls").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _may_link(pairs: DataFrame, nodes: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (path, hub, cls, main) without those that are not main and that bit counts show to be no links."""

    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            keep = [main or (p + q) * overlap_bound(a, n, b, m) >= p * (n + m) for a, n, b, m, main in zip(t["bits_cls"], t["n_cls"], t["bits_hub"], t["n_hub"], t["main"])]
            yield batch.select(["path", "hub", "cls", "main"]).filter(pa.array(keep, pa.bool_()))

    return _with_both(pairs, nodes, "n", "bits").mapInArrow(run, "path long, hub long, cls long, main boolean")


def _compared(pairs: DataFrame, nodes: DataFrame, sketch: np.ndarray, p: int, q: int) -> DataFrame:
    """Pairs (path, hub, cls, main) with whether they link and, of main ones, the mate's limits, its edits if it is near its hub, and keys if it is far."""

    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            rows, edits, keys, counts = [], [], [], []
            for x, y, a, b, main in zip(t["set_cls"], t["set_hub"], t["bits_cls"], t["bits_hub"], t["main"]):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                need = -(-p * (len(x) + len(y)) // (p + q))
                link = overlap_bound(a, len(x), b, len(y)) >= need and common(x, y) >= need
                new, missing = edits_of(x, y) if main else (NONE, NONE)
                own = np.concatenate((new, missing))
                z, few, most = limits(len(own), len(x), len(y), p, q)
                bound = FAR * (len(y) * (q - p) // p + 1)
                rows.append((link, len(x), len(own), z, few, most))
                edits.append(own if len(own) <= bound else NONE)
                key, count = far_keys(by_sketch(new, missing, sketch), link, z, few, most, meets_links(len(own), len(x), len(y), p, q)) if len(own) > bound - most else (NONE, np.zeros(0, bool))
                keys.append(key)
                counts.append(count)
            link, n, k, z, few, most = zip(*rows)
            ends = lambda parts: pa.array(np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(counts))], names=["key", "counts"])
            made = {"path": batch.column("path"), "hub": batch.column("hub"), "cls": batch.column("cls"), "main": batch.column("main"), "linked": pa.array(link, pa.bool_()), "n": pa.array(n, pa.int32()), "k": pa.array(k, pa.int32()), "z": pa.array(z, pa.int32()), "few": pa.array(few, pa.int32()), "most": pa.array(most, pa.int32())}
            made |= {"edits": pa.ListArray.from_arrays(ends(edits), pa.array(np.concatenate(edits).view(np.int64))), "keys": pa.ListArray.from_arrays(ends(keys), flat)}
            yield pa.RecordBatch.from_pydict(made)

    return _with_both(pairs, nodes, "bits", "set").mapInArrow(run, "path long, hub long, cls long, main boolean, linked boolean, n int, k int, z int, few int, most int, edits array<long>, keys array<struct<key: long, counts: boolean>>")


def _smaller_groups(open_mates: DataFrame) -> DataFrame:
    """(g, cls, label, counts): mates (columns of _compared, and label) under the edits by which they can meet links."""
    open_mates = open_mates.withColumn("at", F.xxhash64("path", "hub"))
    edits = open_mates.select("at", "cls", "label", "linked", "k", "z", "few", "most", F.explode("edits").alias("edit"))
    # An edit of one mate alone only takes a place, one of the first.
    often = edits.groupBy("at", "edit").agg(F.count("*").alias("f")).filter("f > 1")
    of_mate = Window.partitionBy("at", "cls")
    placed = edits.join(often, ["at", "edit"]).withColumn("place", F.row_number().over(of_mate.orderBy("f", "edit"))).withColumn("place", F.col("place") + F.col("k") - F.count("*").over(of_mate))
    met = F.when(F.col("place") <= F.when(F.col("linked"), F.col("z")).otherwise(F.col("most")), F.struct(F.lit(0).alias("kind"), F.col("linked").alias("counts")))
    own = F.when(~F.col("linked") & (F.col("place") <= F.col("z")), F.struct(F.lit(1).alias("kind"), (F.col("place") <= F.col("few")).alias("counts")))
    near = placed.select("at", "cls", "label", "edit", F.explode(F.array_compact(F.array(met, own))).alias("as")).select(F.xxhash64("at", "edit", "as.kind").alias("g"), "cls", "label", "as.counts")
    far = open_mates.select("at", "cls", "label", F.explode("keys").alias("edit")).select(F.xxhash64("at", "edit.key", F.lit(2)).alias("g"), "cls", "label", "edit.counts")
    return near.union(far)


def _torn(mates: DataFrame) -> DataFrame:
    """(path, hub, largest, blocks) of the hubs whose mates (path, hub, cls, n, label) have several labels; blocks: for _met_in_blocks, null if too many mates are outside the largest label."""
    of_label = mates.groupBy("path", "hub", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    torn = of_label.groupBy("path", "hub").agg(F.max(F.struct("rows", "label", "n")).alias("most"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.count("*").alias("labels")).filter("labels > 1")
    outside = (F.col("rows") - F.col("most.rows") <= BLOCK) & (F.col("n") - F.col("most.n") <= BLOCK_SHINGLES)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / max(1, BLOCK)), F.ceil(F.col("n") / max(1, BLOCK_SHINGLES)))
    return torn.select("path", "hub", F.col("most.label").alias("largest"), F.when(outside, blocks.cast("int")).alias("blocks"))


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps, one a row, folded to so many 64-bit words."""
    return bits if bits.shape[1] == words else np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def uniting_links(sets: list[np.ndarray], bits: list[bytes], labels: np.ndarray, own: np.ndarray, outside: np.ndarray, p: int, q: int) -> list[tuple[int, int]]:
    """Links (row, row) of own rows with outside ones, as many as it takes to unite the labels that any link unites."""
    label = np.unique(labels, return_inverse=True)[1]
    n = np.array([len(x) for x in sets], np.int64)
    words = np.array([len(b) // 8 for b in bits])
    against = {}  # by its words: the outside rows of each bitmap size, and these bitmaps folded to smaller sizes
    for w in np.unique(words[outside]):
        rows = np.flatnonzero(outside & (words == w))
        made = np.frombuffer(b"".join(bits[i] for i in rows), U64).reshape(len(rows), w)
        against[w] = rows, {v: folded(made, v) for v in np.unique(np.minimum(words[own], w))}
    found = []
    for i in np.flatnonzero(own):
        x = np.frombuffer(bits[i], U64).reshape(1, -1)
        for w, (rows, made) in against.items():
            use = np.flatnonzero(label[rows] != label[i])
            if not len(use):
                continue
            v = min(w, words[i])
            a, b = folded(x, v), made[v][use]
            rest = rows[use]
            most = np.minimum(n[i] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), n[rest] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
            for j in rest[(p + q) * most >= p * (n[i] + n[rest])]:
                if label[i] != label[j] and (p + q) * common(sets[i], sets[j]) >= p * (n[i] + n[j]):
                    label[label == label[j]] = label[i]
                    found.append((i, j))
    return found


def _met_in_blocks(mates: DataFrame, nodes: DataFrame, p: int, q: int) -> DataFrame:
    """Links (hub, cls) that unite labels of the mates (path, hub, cls, label, largest, blocks) of a hub: a task has a block of mates and all that are outside the largest label."""
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    outside = F.col("label") != F.col("largest")
    dealt = mates.select("path", "hub", "cls", "label", outside.alias("outside"), own.alias("own"), F.explode(F.when(outside, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("block"))
    dealt = dealt.select("path", "hub", "block", "cls", "label", "outside", (F.col("own") == F.col("block")).alias("own")).join(nodes.select("cls", "bits", "set"), "cls")

    def run(t: pa.Table) -> pa.Table:
        cls, flags = t.column("cls").to_numpy(), [t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("own", "outside")]
        sets = [np.frombuffer(x, U64) for x in t.column("set").to_pylist()]
        found = np.array(uniting_links(sets, t.column("bits").to_pylist(), t.column("label").to_numpy(), *flags, p, q), np.int64).reshape(-1, 2)
        return pa.table({"hub": cls[found[:, 0]], "cls": cls[found[:, 1]]})

    return dealt.groupBy("path", "hub", "block").applyInArrow(run, "hub long, cls long")


def _near_labels(links: DataFrame) -> DataFrame:
    """(cls, label) of the classes in links (hub, cls). Equal labels mean one component; a hub and its links get the same."""
    both = links.select(F.col("hub").alias("u"), F.col("cls").alias("v"))
    both = both.union(both.select("v", "u"))
    first = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label"))
    second = both.join(first.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("label"))
    third = second.select(F.col("u").alias("label"), F.col("label").alias("least"))
    return second.select(F.col("u").alias("cls"), "label").join(third, "label").select("cls", F.col("least").alias("label"))


def _hub_pairs(mates: DataFrame, path: Column) -> DataFrame:
    """(path, hub, cls, main) for the mates (g, cls, label, pop) of each group g of two labels or more.

    A group's hub is the class that is in most groups; main: mates of this hub may still have to meet. Where fewer than SMALL rows are
    outside a group's largest label, each of these is a hub for the mates of other labels instead, and the group is done with that.
    """
    of_label = mates.groupBy("g", "label").agg(F.count("*").alias("n"), F.max(F.struct("pop", "cls")).alias("top"))
    sized = of_label.groupBy("g").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.max("top").alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    sized = sized.select("g", (F.col("n") - F.col("most.n") < SMALL).alias("done"), F.col("most.label").alias("largest"), F.col("top.cls").alias("top"))
    placed = mates.join(sized, "g")
    stars = placed.filter("not done and cls <> top").select(path.alias("path"), F.col("top").alias("hub"), "cls", F.lit(True).alias("main"))
    hubs = placed.filter("done and label <> largest").select("g", F.col("cls").alias("hub"), F.col("label").alias("hub_label"))
    rest = placed.filter("done").join(hubs, "g").filter("label <> hub_label and (label = largest or cls < hub)").select(path.alias("path"), "hub", "cls", F.lit(False).alias("main"))
    return stars.union(rest).groupBy("path", "hub", "cls").agg(F.max("main").alias("main"))


def _rows_with_components(docs: DataFrame, width: int, threshold: tuple[int, int], sketch_bits: int, merged_levels: int = 12) -> DataFrame:
    """(doc_id, n_shingles, mark, component_id, component) of docs (doc_id, text, mark), see jaccard_components; component: a key of the component."""
    t = Fraction(*threshold)
    p, q = t.numerator, t.denominator
    scratch = Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    sliced = t >= Fraction(85, 100)
    bands = Bands(t) if sliced else None
    sketch = None if sliced else text_sketch(docs, "text", width, sketch_bits)

    def describe(texts: list[str | None]) -> dict:
        h, at = shingle_sets(texts, width)
        n = np.diff(at)
        owner, tiles = sliced_tiles(h, at, bands) if sliced else prefix_tiles(h, at, t, sketch)
        order = np.argsort(owner, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(n))))).astype(np.int32)
        return {
            "n": n,
            "cls": pa.array(content_hash(h, at), mask=n == 0),
            "tiles": pa.ListArray.from_arrays(pa.array(ends), pa.array(tiles[order].view(np.int64))),
        }

    made = [T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("tiles", T.ArrayType(T.LongType()))]
    sets = scratch.keep("sets", map_texts(docs, describe, made, keep=["doc_id", "mark"]))
    live = sets.filter("doc_id is not null and cls is not null")
    classes = scratch.keep("classes", live.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    # One row of each class goes to its tiles; only tiles of two or more classes go on.
    copied = broadcast_if_small(classes.filter("copies > 1").select("cls", "least"))
    one = live.join(copied, "cls", "left").filter("least is null or doc_id = least").select("cls", "n", F.explode("tiles").alias("tile"))
    shared = scratch.keep("shared", one.groupBy("tile").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count("*").alias("c")).filter("a <> b"))
    mates = one.join(broadcast_if_small(shared.filter("c > 2").select("tile"), 2_000_000), "tile")
    if sliced:
        mates = mates.select("cls", F.col("tile").alias("g"))
    else:  # each set in its own band and the one where its smallest link can be
        band = lambda n: F.floor(F.log(n.cast("double")) / float(3 * np.log(1 / float(t))))
        size_bands = F.array_distinct(F.array(band(F.ceil(F.col("n") * p / q)), band(F.col("n"))))
        mates = mates.select("cls", "tile", F.explode(size_bands).alias("band")).select("cls", F.xxhash64("tile", "band").alias("g"))
    mates = scratch.keep("mates0", mates.withColumn("label", F.col("cls")).withColumn("pop", F.count("*").over(Window.partitionBy("cls"))))
    twos = shared.filter("c = 2").select(F.lit(0).cast("long").alias("path"), F.col("a").alias("hub"), F.col("b").alias("cls"), F.lit(False).alias("main"))
    pairs = scratch.keep("pairs0", twos.distinct().union(_hub_pairs(mates, F.lit(0).cast("long"))))
    scratch.drop("shared", "mates0")

    def of_classes(pairs: DataFrame, name: str, made: list[T.StructField], make) -> DataFrame:
        """cls and what make(hashes, begins) gives, for the classes of pairs, from one row of each."""
        active = pairs.select(F.explode(F.array("hub", "cls")).alias("cls")).distinct()
        chosen = scratch.keep(f"chosen_{name}", classes.join(active, "cls", "left_semi").select("cls", F.col("least").alias("doc_id")))
        rows = docs.select("doc_id", "text").join(broadcast_if_small(chosen), "doc_id")

        def unfold(texts: list[str | None]) -> dict:
            h, at = shingle_sets(texts, width)
            return {"own": content_hash(h, at), **make(h, at)}

        out = map_texts(rows, unfold, [T.StructField("own", T.LongType()), *made], keep=["cls"]).filter("own = cls").drop("own").dropDuplicates(["cls"])
        return scratch.keep(name, out)

    each = lambda h, at: [h[i:j] for i, j in zip(at, at[1:])]
    bits = [T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())]
    bitmaps = of_classes(pairs, "bitmaps", bits, lambda h, at: {"n": np.diff(at), "bits": [bitmap(x) for x in each(h, at)]})
    pairs = scratch.keep("likely", _may_link(pairs, bitmaps, p, q))  # only these fetch their sorted arrays; later levels have few pairs
    scratch.drop("pairs0", "bitmaps")
    sets_of = [*bits, T.StructField("set", T.BinaryType())]
    nodes = of_classes(pairs, "nodes", sets_of, lambda h, at: {"n": np.diff(at), "bits": [bitmap(x) for x in each(h, at)], "set": [x.tobytes() for x in each(h, at)]})
    often = set_sketch(nodes, sketch_bits)
    links = labels = None
    fresh = False  # links that the labels don't have yet
    for level in count():
        compared = scratch.keep(f"compared{level}", _compared(pairs, nodes, often, p, q))
        scratch.drop(f"pairs{level}" if level else "likely")
        found = compared.filter("linked").select("hub", "cls")
        if labels is None or fresh or not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = scratch.keep(f"labels{level}", _near_labels(links))
            at_hand = broadcast_if_small(labels)
            fresh = False
        # Mates of one hub in different components meet in blocks or go on, each under some of its edits.
        named = compared.filter("main").join(at_hand, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        torn = scratch.keep(f"torn{level}", _torn(named))
        if torn.isEmpty():
            break
        opened = scratch.keep(f"open{level}", named.join(broadcast_if_small(torn), ["path", "hub"]))
        if not torn.filter("blocks is not null").isEmpty():
            met = scratch.keep(f"met{level}", _met_in_blocks(opened.filter("blocks is not null"), nodes, p, q))
            if fresh := not met.isEmpty():
                links = links.union(met)
        if torn.filter("blocks is null").isEmpty():
            break
        opened = scratch.keep(f"opened{level}", _smaller_groups(opened.filter("blocks is null")))
        open_groups = opened.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("counts").alias("counts")).filter("lo <> hi and counts").select("g")
        mates = opened.join(broadcast_if_small(open_groups), "g", "left_semi").select("g", "cls", "label")
        mates = scratch.keep(f"mates{level + 1}", mates.withColumn("pop", F.count("*").over(Window.partitionBy("cls"))))
        # Groups with the same hub are one, but for late levels, so that groups surely shrink.
        pairs = scratch.keep(f"pairs{level + 1}", _hub_pairs(mates, F.lit(0).cast("long") if level < merged_levels else F.col("g")))
        scratch.drop(f"torn{level}", f"open{level}", f"opened{level}", f"mates{level + 1}")
        if pairs.isEmpty():
            break
    if fresh:
        labels = scratch.keep("labels", _near_labels(links))

    # What the labels leave apart is joined by components of the few labels that links cross.
    crossing = links.join(labels, "cls").withColumnRenamed("label", "a").join(labels.select(F.col("cls").alias("hub"), F.col("label").alias("b")), "hub").filter("a <> b").select("a", "b").distinct()
    crossing = scratch.keep("crossing", crossing)
    if not crossing.isEmpty():
        components = connected_components(crossing)
        labels = labels.join(components, labels["label"] == components["node"], "left").select("cls", F.coalesce("component", "label").alias("label"))
    named = classes.select("cls", "least").join(labels, "cls")
    named = named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label")
    names = classes.select("cls", "least").join(named.select("cls", "label", "component_id"), "cls", "left")
    names = names.select("cls", F.coalesce("label", "cls").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "mark", "cls").join(names, "cls", "left")
    out = out.select("doc_id", "n_shingles", "mark", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))
    out = cut_lineage(out)
    scratch.drop()
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: tuple[int, int] = (9, 10), sketch_bits: int = 16) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: component_id is the smallest id that links reach, or its own.

    Two rows link when q * |A and B| >= p * |A or B| for threshold (p, q). A-Z is lower-cased; words are runs without
    ASCII white space; fewer words than width are one shingle. Texts without words (null, empty, blank) have no
    shingles and link with nothing. Rows with equal sets link (similarity 1). Rows with a null id take part in
    nothing and keep a null component. Rows that repeat an id get the component of their own text. Sets are compared
    by 64-bit shingle hashes, and equal sets found by a 64-bit content hash. No rows: no rows. The work is done when
    this returns; the result is a checkpoint of three numbers a row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("mark"))
    return _rows_with_components(rows, width, threshold, sketch_bits).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: tuple[int, int] = (9, 10), sketch_bits: int = 16) -> DataFrame:
    """One row of each component of docs, that of the smallest id (of equal ids, of one of the texts). Columns stay as they are.

    Decided row by row: where an id is repeated with another text, that row belongs to its own text's component, so no text goes that is
    not linked with one that stays. Of rows equal in id and text one stays. Rows with a null id and texts without words stay.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    found = _rows_with_components(rows, width, threshold, sketch_bits).filter("component is not null").select("component", F.struct("doc_id", "mark").alias("row"))
    first = found.groupBy("component").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").select("component", "first")
    several = cut_lineage(found.join(first, "component").groupBy("row").agg(F.first("first").alias("first"), F.count("*").alias("n")))
    gone = several.filter("row <> first").select(F.col("row.doc_id").alias("_id"), F.col("row.mark").alias("_mark"))
    again = several.filter("row = first and n > 1").select(F.col("row.doc_id").alias("_id"), F.col("row.mark").alias("_mark"))
    same = lambda df, keys: (df[id_col].cast("long") == keys["_id"]) & (F.xxhash64(df[text_col]) == keys["_mark"])
    kept = docs.join(broadcast_if_small(gone), same(docs, gone), "left_anti")
    if again.isEmpty():
        return kept
    return kept.join(again, same(kept, again), "left_anti").unionByName(kept.join(again, same(kept, again), "left_semi").dropDuplicates([id_col, text_col]))
