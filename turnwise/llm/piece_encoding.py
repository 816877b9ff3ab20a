"""SentencePiece encoding that keeps offsets, and decoding.

The text is normalised by longest prefixes of the model's compiled character map (a double-array trie), which records for
each normalised byte the original byte it comes from. White space becomes U+2581 and the dummy prefix is put in front.
Pieces are merged best score first, and each piece is projected through the record to a span of original bytes.

In a vocabulary where U+2581 stands only at the start of pieces (or in runs of it), no merge crosses the start of a
word, so a batch's different words are merged once each and kept in a bounded cache; else a text is one run. A model
whose map is empty leaves texts as they are. All ids come from the merges here; the library only decodes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

SPACE = "▁"
NEVER = float("inf")


class CharacterMap:
    """Longest-prefix replacement by a compiled map: 4 bytes of trie size, the trie's units, the replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.targets = blob[4 + size :] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[int, int]:
        """(bytes matched, place of the replacement) of the longest key that starts at a position; (0, 0) if none."""
        units, found = self.units, (0, 0)
        node = self._down(0)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _down(self, node: int) -> int:
        return node ^ self._offset(self.units[node])

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters (and its end) the original byte that it comes from."""
        raw = text.encode()
        out: list[str] = []
        source: list[int] = []
        at = 0
        while at < len(raw):
            n, target = self.longest(raw, at) if self.units else (0, 0)
            if n:
                new = self.targets[target : self.targets.index(b"\0", target)].decode()
            else:
                lead = raw[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = raw[at : at + n].decode()
            out.append(new)
            source += [at] * len(new)
            at += n
        return "".join(out), np.array([*source, len(raw)], np.int64)


class PieceModel:
    """A BPE piece model read from its file: scores, byte fallback, normaliser options."""

    def __init__(self, model: bytes, cache_limit: int = 500_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library, self.cache_limit = sentencepiece.SentencePieceProcessor(model_proto=model), cache_limit

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("only BPE models without user-defined symbols and white-space removal are covered")
        self.pieces = {p.piece: (p.score, i) for i, p in enumerate(proto.pieces) if p.type == 1}
        self.rank = {p: -score for p, (score, _) in self.pieces.items()}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.begin, self.end = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.dummy = proto.normalizer_spec.add_dummy_prefix
        self.map = CharacterMap(proto.normalizer_spec.precompiled_charsmap)
        whole = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.runs = None if whole else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0  # characters of long runs in the cache

    def merge(self, run: str) -> list[str]:
        """Best-scored neighbours first, the left one of equals, as long as a merged piece is in the vocabulary."""
        return self._merge_short(run) if len(run) <= 64 else self._merge_long(run)

    def _merge_short(self, run: str) -> list[str]:
        part = list(run)
        rank = self.rank.get
        ranks = [rank(x + y, NEVER) for x, y in zip(part, part[1:])]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            part[i] += part.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(part[i] + part[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank(part[i - 1] + part[i], NEVER)
        return part

    def _merge_long(self, run: str) -> list[str]:
        part: list[str | None] = list(run)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i, j):
            if i >= 0 and j < len(part) and (new := part[i] + part[j]) in self.pieces:
                heapq.heappush(heap, (-self.pieces[new][0], i, j, new))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, new = heapq.heappop(heap)
            if part[i] is None or part[j] is None or part[i] + part[j] != new or right[i] != j:
                continue
            part[i], part[j] = new, None
            right[i] = right[j]
            if right[i] < len(part):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p is not None]

    def _own(self, run: str) -> tuple[list[int], list[int]]:
        """(ids, normalised characters of each). All bytes of a character but the last have an empty span."""
        ids: list[int] = []
        chars: list[int] = []
        for piece in self.merge(run):
            if (known := self.pieces.get(piece)) is not None:
                ids.append(known[1])
                chars.append(len(piece))
            elif self.bytes:
                raw = piece.encode()
                ids += [self.bytes[b] for b in raw]
                chars += [0] * (len(raw) - 1) + [1]
            else:
                ids.append(self.unknown)
                chars.append(len(piece))
        return ids, chars

    def _learn(self, runs: set[str]) -> None:
        """Puts the runs that aren't in the cache there."""
        new = [r for r in runs if r not in self.cache]
        self.held += sum(len(r) for r in new if len(r) > 64)
        for run in new:
            ids, chars = self._own(run)
            self.cache[run] = array("I", ids).tobytes(), array("I", chars).tobytes()

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """encode() of each text; the batch's new runs are encoded together. The cache holds cache_limit runs and those of one batch at most."""
        shown = [self._shown(t) for t in texts]
        self._learn({r for runs, _ in shown for r in runs})
        out = [self._assemble(t, *s) for t, s in zip(texts, shown)]
        if len(self.cache) > self.cache_limit or self.held > 1 << 22:
            self.cache.clear()
            self.held = 0
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): pieces and their spans of the original text's UTF-8 bytes."""
        return self.encode_batch([text])[0]

    def _shown(self, text: str) -> tuple[list[str], np.ndarray | None]:
        """The runs of the normalised text with visible blanks, and the record of their origin (None: nothing was changed)."""
        if not text:
            return [], None
        normal, source = self.map.normalise(text) if self.map.units else (text, None)
        shown = (SPACE if self.dummy and normal else "") + normal.replace(" ", SPACE)
        return self.runs.findall(shown) if self.runs else [shown], source

    def _assemble(self, text: str, runs: list[str], source: np.ndarray | None):
        got = [self.cache[r] for r in runs]
        ids = np.frombuffer(b"".join([g[0] for g in got]), "<u4")
        ends = np.cumsum(np.frombuffer(b"".join([g[1] for g in got]), "<u4"), dtype=np.int64)
        at = np.maximum(np.concatenate(([0], ends)) - (1 if self.dummy and runs else 0), 0)
        if source is None and not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            source = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))))
        if source is not None and len(ids):
            at = source[at]
        return ids, at[:-1], at[1:]


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


@lru_cache(maxsize=4)
def library_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with ids, begins, ends (arrays): the pieces of each text, without begin and end ids, and their original byte spans.

    Null and empty texts have empty arrays. model_path is a file that every executor has.
    """

    def score(texts):
        model = piece_model(model_path)
        got = model.encode_batch([t or "" for t in texts])
        return {k: [g[i].astype(np.int64) for g in got] for i, k in enumerate(("ids", "begins", "ends"))}

    array = T.ArrayType(T.LongType())
    return map_texts(docs, score, [T.StructField(k, array) for k in ("ids", "begins", "ends")], text_col, keep)


def decode_pieces(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids, by the library's decode(); null ids give a null text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def decode(ids):
        model = library_model(model_path)
        return ids.map(lambda x: None if x is None else model.decode([int(i) for i in x]))

    return encoded.withColumn(out_col, decode(F.col(ids_col)))


def encoding_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes) of every row, in one pass over the texts.

    ids have the begin and end id; covered_bytes are the original bytes in the pieces' spans, which follow each other
    without gaps. Null texts are empty: the begin and end id alone. Null ids stay, repeated rows get equal digests, no rows give none.
    """

    def score(texts):
        model = piece_model(model_path)
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "covered_bytes": []}
        for ids, begins, ends in model.encode_batch([t or "" for t in texts]):
            ids = np.concatenate(([model.begin], ids, [model.end])).astype("<u4")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(model.library.decode(ids.tolist()).encode()).hexdigest())
            out["covered_bytes"].append(int((ends - begins).sum()))
        return out

    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("covered_bytes", T.LongType())]
    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), score, made, keep=["doc_id"])
