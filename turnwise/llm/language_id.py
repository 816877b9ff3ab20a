"""Language identification of words and spans: script ranges, hashed letter n-grams, Viterbi with a switching penalty.

A word's script narrows its candidate languages to those that use the script in training. Each word gets a log score for
each language; the best path through a text's words pays a penalty for each change of language, which labels the spans
of a mixed text. A text in which no stretch of another language gains more than half the penalty over the best single one (checked on running
sums) needs no path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, fold_of, map_texts

U64 = np.uint64
#: First code points of script ranges, and their scripts (Unicode blocks, coarse). Fixed values.
SCRIPTS = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_INDEX = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def split_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, index of each word in them, words of each text): runs of letters, lower-cased."""
    index: dict[str, int] = {}
    at, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = _LETTERS.findall(text.lower()) if text else []
        got = [index.setdefault(w, len(index)) for w in own]
        sizes[i] = len(got)
        at += got
    words = list(index)
    real = np.array([any(map(str.isalpha, w)) for w in words], bool)
    at = np.array(at, np.int64)
    if len(words) and not real.all():
        keep = real[at]
        sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[keep], minlength=len(texts))
        at = at[keep]
    return words, at, sizes


def word_grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram buckets, owning words, letters of each word, script of each word): letter 2- to 4-grams of ^word$, hashed."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    n = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), n + 2)
    grams, owners = [], []
    for k in (2, 3, 4):
        if len(codes) < k:
            break
        h = np.full(len(codes) - k + 1, k, U64)
        for j in range(k):
            h = (h ^ codes[j : j + len(h)].astype(U64)) * U64(0x100000001B3)
            h ^= h >> U64(29)
        inside = owner[: len(h)] == owner[k - 1 :]
        grams.append(((h[inside] * U64(0x9E3779B97F4A7C15)) >> U64(64 - buckets)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    ends = np.cumsum(n + 2)
    middle = codes[ends - 2 - (n - 1) // 2] if len(words) else codes
    script = _INDEX[np.maximum(np.searchsorted(_STARTS, middle, side="right") - 1, 0)]
    return (np.concatenate(grams) if grams else codes), (np.concatenate(owners) if owners else codes), n, script


@dataclass
class LanguageModel:
    languages: list[str]
    logs: np.ndarray  # gram bucket x language
    allowed: np.ndarray  # script x language
    buckets: int
    penalty: float

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages log scores, letters of each word). Languages that don't use a word's script get its least score less 8."""
        gram, owner, n, script = word_grams(words, self.buckets)
        score = np.zeros((len(words), len(self.languages)))
        for j in range(len(self.languages)):
            score[:, j] = np.bincount(owner, self.logs[gram, j], minlength=len(words))
        score /= 2.0  # a letter counts in several grams
        score -= score.max(axis=1, keepdims=True)
        score = np.maximum(score, -12.0)
        may = self.allowed[script]
        may |= ~may.any(axis=1, keepdims=True)
        return np.where(may, score, -20.0), n

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best labels of a text's words."""
        total = s.sum(axis=0)
        best = int(total.argmax())
        gain = np.cumsum(s - s[:, best : best + 1], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros(s.shape[1]), gain[:-1]]), axis=0)
        # m stretches of others have m - 1 switches at least, so half the penalty: m * p / 2 <= (m - 1) * p from m = 2 on.
        if (gain - low).max() <= self.penalty / 2:
            return np.full(len(s), best)
        back = np.empty(s.shape, np.int32)
        value, stay, rows = s[0].tolist(), list(range(s.shape[1])), s.tolist()
        for t in range(1, len(s)):
            top = max(value)
            jump = top - self.penalty
            at = value.index(top)
            row = rows[t]
            back[t] = [at if v < jump else j for j, v in zip(stay, value)]
            value = [(jump if v < jump else v) + x for v, x in zip(value, row)]
        out = np.empty(len(s), np.int64)
        j = int(np.argmax(value))
        for t in range(len(s) - 1, -1, -1):
            out[t] = j
            j = back[t, j] if t else j
        return out

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) of each text: the language with most letters, its share of them, and (first word, words, language)."""
        words, at, sizes = split_words(texts)
        if not self.languages:
            return [(UNDETERMINED, 0.0, [])] * len(texts)
        score, letters = self.word_scores(words) if words else (np.zeros((0, len(self.languages))), np.zeros(0, np.int64))
        out, lo = [], 0
        for n in sizes:
            own = at[lo : lo + n]
            lo += n
            if not n:
                out.append((UNDETERMINED, 0.0, []))
                continue
            path = self.path(score[own])
            share = np.bincount(path, letters[own], minlength=len(self.languages))
            best = int(share.argmax())
            cut = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [n]))
            out.append((self.languages[best], float(share[best] / share.sum()), [(int(a), int(b - a), self.languages[path[a]]) for a, b in zip(cut, cut[1:])]))
        return out


def fit_language(docs: DataFrame, rows_per_language: int = 1500, buckets: int = 15, penalty: float = 25.0, seed: int = 11) -> LanguageModel:
    """docs (doc_id, text, lang): about rows_per_language rows of each language, chosen by hashed id, are read whole; null languages are left out.

    Counts by gram and language are added up in Spark; 2^buckets grams x languages come to the driver. No rows: no languages, every text is 'und'.
    """
    known = docs.filter("lang is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1 << buckets, 0)), np.zeros((len(_NAMES), 0), bool), buckets, penalty)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_language / n)))])
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("text", "lang")

    def tally(batches):
        total: dict[str, np.ndarray] = {}
        width = (1 << buckets) + len(_NAMES)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lo in range(0, len(texts), 200):
                for lang in set(langs[lo : lo + 200]):
                    words, at, _ = split_words([t for t, own in zip(texts[lo : lo + 200], langs[lo : lo + 200]) if own == lang])
                    if not words:
                        continue
                    times = np.bincount(at, minlength=len(words))
                    gram, owner, n, script = word_grams(words, buckets)
                    into = total.setdefault(lang, np.zeros(width))
                    into[: 1 << buckets] += np.bincount(gram, times[owner], minlength=1 << buckets)
                    into[1 << buckets :] += np.bincount(script, n * times, minlength=len(_NAMES))
        for lang, count in total.items():
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(count[used], pa.float64())], names=["lang", "slot", "n"])

    got = cut_lineage(sample.mapInArrow(tally, "lang string, slot long, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n"))).toArrow()
    count = np.zeros(((1 << buckets) + len(_NAMES), len(languages)))
    column = np.array([languages.index(x) for x in got.column("lang").to_pylist()], np.int64)
    count[got.column("slot").to_numpy(), column] = got.column("n").to_numpy()
    grams, script = count[: 1 << buckets], count[1 << buckets :]
    logs = np.log((grams + 0.2) / (grams.sum(axis=0) + 0.2 * (1 << buckets)))
    allowed = script >= 0.01 * np.maximum(script.sum(axis=0), 1)
    return LanguageModel(languages, logs, allowed, buckets, penalty)


def label_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None, with_spans: bool = False, least_share: float | None = None) -> DataFrame:
    """docs with lang_pred, score (share of letters in lang_pred) and, if asked for, spans (first word, words, language).

    'und' and 0 for null texts and texts without a letter. least_share drops 'und' rows and rows with a lower score.
    """

    def score(texts):
        got = model.label(texts)
        out = {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}
        if with_spans:
            out["spans"] = [[{"first": a, "words": b, "lang": c} for a, b, c in g[2]] for g in got]
        return out

    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if with_spans:
        made.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("words", T.LongType()), T.StructField("lang", T.StringType())]))))
    where = None if least_share is None else (lambda m: [p != UNDETERMINED and s >= least_share for p, s in zip(m["lang_pred"], m["score"])])
    return map_texts(docs, score, made, text_col, keep, where)


def training_texts(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    return docs.filter(fold_of(F.col("doc_id"), folds) != held_out).select("doc_id", "text", "lang")


def language_predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans) of every row; languages of held-out rows are never used.

    Null texts and texts without a letter are 'und' with score 0. Of languages with equal shares the first by name is taken. Null ids are not held out
    and stay; repeated rows get equal predictions; without any language to learn all texts are 'und'.
    """
    model = fit_language(training_texts(docs))
    scored = label_languages(docs.select("doc_id", "text"), model, keep=["doc_id"], with_spans=True)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
