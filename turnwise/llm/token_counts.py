"""Token counts: greedy longest-match word pieces, counted in linear time by an automaton.

The trie of the vocabulary has, at each node, a failure link and the number of tokens popped on the way to it, both computed
once. Reading a word moves down the trie, or pops along failure links where it can't; no piece is ever built.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BoundedCache, map_texts

UNKNOWN = -1
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


class LongestMatch:
    """heads: pieces that start a word; tails: pieces that go on in it. count(word) is the number of greedy pieces, or UNKNOWN."""

    def __init__(self, heads: set[str], tails: set[str]):
        # Two roots: 0 for the start of a word, 1 for its later parts.
        self.child: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, heads), (1, tails)):
            for piece in pieces:
                node = root
                for ch in piece:
                    if (to := self.child[node].get(ch)) is None:
                        self.child.append({})
                        final.append(False)
                        to = self.child[node][ch] = len(self.child) - 1
                    node = to
                final[node] = node > 1
        n = len(self.child)
        self.fail: list[int] = [UNKNOWN] * n
        self.popped = [0] * n
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for ch, v in self.child[u].items():
                    below.append(v)
                    if final[v]:  # the whole of v is one token
                        self.fail[v], self.popped[v] = 1, 1
                        continue
                    z, k = self.fail[u], self.popped[u]
                    while z != UNKNOWN and ch not in self.child[z]:
                        k += self.popped[z]
                        z = self.fail[z]
                    if z != UNKNOWN:
                        self.fail[v], self.popped[v] = self.child[z][ch], k
            level = below

    def count(self, word: str) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = tokens = 0
        for ch in word:
            while (to := child[node].get(ch)) is None:
                tokens += popped[node]
                node = fail[node]
                if node == UNKNOWN:
                    return UNKNOWN
            node = to
        while node > 1:
            tokens += popped[node]
            node = fail[node]
        return UNKNOWN if node == UNKNOWN else tokens


@lru_cache(maxsize=4)
def pieces(path: str) -> frozenset[str]:
    """All normal pieces of a piece model's file as they are: U+2581 stays in front, and alone is a piece too if the model has it."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return frozenset(p.piece for p in proto.pieces if p.type == 1)


@lru_cache(maxsize=4)
def counter(path: str) -> BoundedCache:
    """word -> greedy pieces of U+2581 and the word."""
    every = pieces(path)
    count = LongestMatch({p for p in every if p[0] == "▁"}, every).count
    return BoundedCache(lambda word: count("▁" + word))


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row. Words are runs without ASCII white space.

    A word is matched with U+2581 in front, by all normal pieces. A word with a part that no piece matches is one unknown token. Null and empty texts have no words.
    Rows are counted one by one: null ids stay, repeated rows get equal counts, no rows give none.
    """

    def score(texts):
        tokens = counter(vocabulary_path)
        out = {"n_words": [], "n_tokens": [], "n_unknown": []}
        for text in texts:
            got = [tokens[w] for w in _BLANK.split(text or "") if w]
            unknown = got.count(UNKNOWN)
            out["n_words"].append(len(got))
            out["n_unknown"].append(unknown)
            out["n_tokens"].append(sum(got) + 2 * unknown)
        return out

    made = [T.StructField(k, T.LongType()) for k in ("n_words", "n_tokens", "n_unknown")]
    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), score, made, keep=["doc_id"])
