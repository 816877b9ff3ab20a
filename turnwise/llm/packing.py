"""Packing by minimum bin slack: each sequence takes the longest piece left and the set of others that fills it best.

Pieces are known by their lengths. A bit set of reachable sums, grown length by length, gives the sum closest to the room
left; walking back through its stages gives how many pieces of each length make it. A task packs its own rows, some
thousand pieces at a time, so nothing is shuffled. What can't be filled exactly is filled by cutting a piece, and a task's last tokens go into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, small_batches

CAPACITY = 2048


class RecentWords(BoundedCache):
    """A cache that, when half of its limit is new, forgets what wasn't asked for since the last time; frequent words are never made again."""

    def __init__(self, make, limit: int):
        super().__init__(make, limit // 2)
        self.before: dict = {}

    def __missing__(self, word):
        value = self.before.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[word] = value
        return value


@lru_cache(maxsize=4)
def word_ids(path: str, cached: int = 800_000):
    """words (without ASCII white space) -> their ids as little-endian u32, through a cache of so many words and half as many cores.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words. Words are first cut at the
    edges of letter runs, as the tokenizer does itself, so that a word with other punctuation is no new word.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}

    four = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def encode(word: str) -> bytes:
        return b"".join([four[i] for i in tokenizer.encode(word, add_special_tokens=False).ids])

    def encode_core(core: str) -> bytes:
        # Lower-case Latin letters are what the normaliser and the splitter leave as they are: the merges do the rest.
        plain = core.isascii()
        if not core.isalpha() or not core.islower() or not plain and max(core) >= "\u0250":
            return encode(core)
        symbols = core if plain else core.encode().decode("latin-1").translate(shown)
        return b"".join([four[t.id] for t in model.tokenize(symbols)])

    cores = RecentWords(encode_core, cached // 2)

    def core(word: str) -> bytes:
        # Lower-casing is the tokenizer's own, letter by letter; a sigma differs in context.
        return cores[word if "\u03a3" in word else word.lower()]

    def split(word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        if "\u0130" in text:  # its lower case ends in a combining mark, which joins what follows
            return encode(text)
        if text[-1] in ".," and text[:-1].isalpha():
            return core(text[:-1]) + cores[text[-1]]
        return core(text) if text.isalpha() else encode(text)

    return RecentWords(split, cached)


def token_bytes(text: str | None, words: BoundedCache, end_id: int) -> bytes:
    return b"".join(map(words.__getitem__, (text or "").encode("utf-8", "surrogatepass").split())) + end_id.to_bytes(4, "little")


class Packer:
    """Takes pieces (doc_id, start, ids, doc_tokens), yields (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.sequence = capacity, first_sequence
        self.queues: dict[int, deque] = {}
        self.waiting = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, cap = len(ids) // 4, self.capacity
        for start in range(0, total, cap):
            piece = (doc_id, start, ids[4 * start : 4 * (start + cap)], total)
            n = len(piece[2]) // 4
            if n == cap:
                yield from self._close([piece])
            else:
                self._put(n, piece)

    def _put(self, n, piece):
        self.queues.setdefault(n, deque()).append(piece)
        self.waiting += 1

    def _take(self, n):
        q = self.queues[n]
        piece = q.popleft()
        if not q:
            del self.queues[n]
        self.waiting -= 1
        return piece

    def _close(self, pieces) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc_id, start, n, zlib.crc32(ids), total, self.sequence, at
            at += n
        self.sequence += 1

    def fill(self, capacity: int) -> tuple[dict[int, int], int]:
        """({length: pieces}, slack): the longest piece and the pieces that with it leave the least room."""
        longest = max(n for n in self.queues if n <= capacity)
        room = capacity - longest
        mask = (1 << (room + 1)) - 1
        reach, stages = 1, []
        for n in sorted((n for n in self.queues if n <= room), reverse=True):
            count, step = min(len(self.queues[n]) - (n == longest), room // n), 1
            while count > 0 and not reach >> room & 1:
                k = min(step, count)
                stages.append((n, k, reach))
                reach |= reach << (k * n) & mask
                count, step = count - k, 2 * step
            if reach >> room & 1:
                break
        best = reach.bit_length() - 1
        slack, chosen = room - best, {longest: 1}
        for n, k, before in reversed(stages):
            if not before >> best & 1:
                best -= k * n
                chosen[n] = chosen.get(n, 0) + k
        return chosen, slack

    def drain(self, down_to: int) -> Iterator[tuple]:
        while self.waiting > down_to:
            chosen, slack = self.fill(self.capacity)
            for _ in range(min(len(self.queues[n]) // k for n, k in chosen.items())):
                pieces = [self._take(n) for n, k in chosen.items() for _ in range(k)]
                room = slack
                while room and self.queues:
                    n = min((n for n in self.queues if n >= room), default=max(self.queues))
                    pieces.append(self._cut(n, min(n, room)))
                    room -= min(n, room)
                if room:  # the last tokens
                    yield from self._powers(pieces)
                else:
                    yield from self._close(pieces)
                if slack:
                    break

    def _cut(self, n, take):
        doc_id, start, ids, total = self._take(n)
        if take < n:
            self._put(n - take, (doc_id, start + take, ids[4 * take :], total))
        return doc_id, start, ids[: 4 * take], total

    def _powers(self, pieces) -> Iterator[tuple]:
        rest, left = deque(pieces), sum(len(p[2]) // 4 for p in pieces)
        while left:
            size = min(1 << (left.bit_length() - 1), self.capacity)
            own, room = [], size
            while room:
                doc_id, start, ids, total = rest.popleft()
                n = min(room, len(ids) // 4)
                own.append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.appendleft((doc_id, start + n, ids[4 * n :], total))
                room -= n
            yield from self._close(own)
            left -= size


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, window: int = 4096, cached: int = 800_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece of each document.

    Null and empty texts have the end id only. Rows that repeat an id are packed as rows of their own. A sequence's id holds
    the task's partition and a number in it. window: pieces that a task holds at most before it packs. cached: words whose ids a task keeps at most.
    """

    small_batches(docs.sparkSession)

    def run(batches):
        words = word_ids(tokenizer_path, cached)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        rows: list[tuple] = []

        def batch_of():
            columns = list(zip(*rows)) or [()] * 7
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, len(texts), 256):
                part = zip(batch.column("doc_id").slice(lo, 256).to_pylist(), texts.slice(lo, 256).to_pylist())
                for doc_id, text in part:
                    rows += packer.add(doc_id, token_bytes(text, words, end_id))
                if packer.waiting > window:
                    rows += packer.drain(window // 4)
                if rows:
                    yield batch_of()
        rows += packer.drain(0)
        yield batch_of()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
