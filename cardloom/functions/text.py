"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English function words.
STOP_WORDS = "the a an and or but in on at to for of with by from as is was are were be been has have had it its that this which who will would not".split()
# Indicator words per language, in order of precedence.
LANGUAGE_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "was"], "es": ["el", "la", "los", "una", "del", "por", "las"],
    "fr": ["le", "les", "des", "une", "est", "du", "dans"], "de": ["der", "die", "und", "das", "von", "den", "im"],
}
# Words of a positive and of a negative tone.
POSITIVE = ["increase", "increased", "growth", "improve", "improved", "gain", "higher", "rose", "better", "success"]
NEGATIVE = ["decrease", "decreased", "decline", "fell", "loss", "losses", "lower", "worse", "failure", "error", "cut"]


def collapsed(text: Column) -> Column:
    """Blanks of any kind become one space, outer ones go."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def cleaned(text: Column) -> Column:
    """Without tags, URLs and e-mail addresses, blanks collapsed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"https?://\S+", " ")
    return collapsed(F.regexp_replace(out, r"[\w.+-]+@[\w-]+\.[\w.]+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of Latin letters and digits; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def truncated(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last three of which are dots where something went."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def without_quotes(text: Column) -> Column:
    """Without quotation marks of any kind; null stays null."""
    return F.translate(text, "\"'“”‘’„«»‹›", "")


def numeric_density(text: Column) -> Column:
    """Number tokens per word or number of a text; 0 without any."""
    every = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+(?:[.,]\d+)*"))
    return F.when(every == 0, F.lit(0.0)).otherwise(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\b\d+(?:[.,]\d+)*")) / every)


def best_window(text: Column, limit: int) -> Column:
    """The first sentence with a number that is no longer than ``limit``, else the first that long; null if none is."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+|\n+", "$1\u0001")
    pieces = F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: (s != "") & (F.length(s) <= limit))
    return F.coalesce(F.get(F.filter(pieces, lambda s: s.rlike("[0-9]")), F.lit(0)), F.get(pieces, F.lit(0)))


def number_tokens(text: Column) -> Column:
    """Distinct number tokens, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:[.,]\d+)*)"), 1)))


def masked_numbers(text: Column) -> Column:
    """Lower case with years, percentages and other numbers replaced by words, for comparing claims."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\b(?:19|20)\d{2}\b", "year")
    out = F.regexp_replace(out, r"\d+(?:[.,]\d+)*\s*(?:%|percent)", "pct")
    return collapsed(F.regexp_replace(out, r"\d+(?:[.,]\d+)*", "num"))


def normalised_claim(text: Column) -> Column:
    """Lower case, punctuation out, blanks collapsed."""
    return collapsed(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays of distinct values; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _member(own: list[str]):
    return lambda w: w.isin(own)


def language_guess(text: Column) -> Column:
    """Language with most indicator words; earlier ones win ties, English without any."""
    words = tokens(text)
    scores = {lang: F.size(F.filter(words, _member(own))) for lang, own in LANGUAGE_WORDS.items()}
    best = F.greatest(*scores.values())
    out = F.lit("en")
    for lang in reversed(list(scores)):
        out = F.when((scores[lang] == best) & (best > 0), F.lit(lang)).otherwise(out)
    return out


def reading_ease(text: Column) -> Column:
    """Flesch reading ease, kept within 0..100; syllables are runs of vowels, at least one per word. 0 without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda w: w != "")
    n = F.size(words)
    ends = F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[.!?]+")))
    syllables = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+"))))
    score = F.lit(206.835) - F.lit(1.015) * n / ends - F.lit(84.6) * syllables / n
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
