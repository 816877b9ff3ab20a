"""Column functions on words, texts and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and their plain forms.
_QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"}


def tokens(text: Column) -> Column:
    """Lower-cased words between Unicode white space; none for null and blank texts."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda t: t != "")


def norm_word(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z0-9']", "")


def norm_text(text: Column) -> Column:
    """Lower-cased letters, apostrophes and blanks, trimmed: 'uh-huh' becomes 'uhhuh'."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z' ]", ""))


def strip_punct(text: Column, characters: str = ".,!?") -> Column:
    return F.btrim(text, F.lit(characters))


def clean_quotes(text: Column) -> Column:
    """Typographic quotes, dashes and ellipses become ASCII; other characters beyond ASCII become '?'."""
    plain = F.translate(text, "".join(_QUOTES), "".join(_QUOTES.values()))
    return F.regexp_replace(F.replace(plain, F.lit("…"), F.lit("...")), r"[^\x00-\x7F]", "?")


def seconds(h: Column, m: Column, s: Column, ms: Column) -> Column:
    """Seconds of clock parts given as digits."""
    return h.cast("double") * 3600 + m.cast("double") * 60 + s.cast("double") + ms.cast("double") / 1000


def clock_seconds(text: Column) -> Column:
    """HH:MM:SS,mmm (or with a dot) as seconds; null where it is no clock time."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"(\d+):(\d+):(\d+)[,.](\d+)", i), F.lit(""))
    return seconds(part(1), part(2), part(3), part(4))


def number(text: Column) -> Column:
    """Numbers in texts; null where there is none (bad input never fails)."""
    return text.try_cast("double")


def pair_id(name: Column) -> Column:
    """The number behind 'dyad' in a name, or null."""
    return F.nullif(F.regexp_extract(name, r"dyad(\d+)", 1), F.lit("")).cast("bigint")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.10, "†").otherwise("")


def signed_sentiment(label: Column, score: Column) -> Column:
    return F.when(F.lower(label) == "positive", score).when(F.lower(label) == "negative", -score).when(F.lower(label) == "neutral", F.lit(0.0))


def words_per_second(n_words: Column, dur: Column) -> Column:
    return n_words / F.greatest(F.lit(1e-6), dur)


def repair_json_array(reply: Column) -> Column:
    """The bracketed span of a reply: code fences go, an array cut short is closed behind its last whole object."""
    bare = F.trim(F.regexp_replace(reply, r"```(?:json)?", ""))
    cut = F.regexp_extract(bare, r"(?s)^(.*\})", 1)
    closed = F.when(F.endswith(bare, F.lit("]")), bare).when(cut != "", F.concat(cut, F.lit("]"))).otherwise(bare)
    return F.nullif(F.regexp_extract(closed, r"(?s)(\[.*\])", 1), F.lit(""))


def feature_kind(name: Column) -> Column:
    """The kind of a feature by its suffix."""
    return F.when(F.endswith(name, F.lit("_asym")), "Asymmetry").when(F.endswith(name, F.lit("_mean")), "Mean Level").otherwise("Count/Rate")
