"""Texts cut off by field limits or mid-transfer (problem 3).

1. One pass over the cards looks at how each value ends, its page furniture and residue aside. Values that end a sentence,
   repeat the card's headline or are a ``label: figure`` are complete. Values with a mark of a cut or with debris of a
   transfer are cut. What remains is open: it stops without an end.
2. A vocabulary of the whole corpus, with how often each word ends a sentence, gives a trie of word prefixes, kept as a table
   (prefix, occurrences below it). An open value is cut if its final token is unknown but a proper prefix of known words
   (evidence ``trie``), if its length lies at a limit of its provider and field (``length``), or if its final token is a
   known word after which the corpus goes on and hardly ever ends a sentence (``goes_on``).
3. Only an open value about which none of these says anything, such as one that ends in a number or in a word that may well
   end a sentence, is judged by its context: running text, an earlier sentence end, another text of the card that goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.sites import with_site
from cardloom.llm import residue
from cardloom.llm.boilerplate import STOP_WORDS, Rules
from cardloom.session import bounded, cut

#: Occurrences from which a word counts as known, final tokens of unfinished values aside.
KNOWN = 3
#: A token also counts as unknown if the words that it begins are more than so many times as frequent (single letters, "th").
RARE = 100
#: A known word goes on if no larger share of its occurrences ends a sentence.
ENDS = 0.02
#: A length is a limit if it has at least so many unfinished values of the provider and field, this share of all of them, and
#: if this share of the values of that length is unfinished. A cut back to the end of a word falls short by up to ``BACK``.
LIMIT_VALUES, LIMIT_PILE, LIMIT_SHARE, BACK = 5, 0.08, 0.5, 12
#: Share of stop words from which a piece of at least four words is running text.
RUNNING = 0.12

_ENDED = re.compile(r"[.!?。！？]\s*[\"”“»«’')\]]*$")
_ELLIPSIS_QUOTED = re.compile(r"(?:\.\.\.|…)\s*[\"”»’]+$")
_MARK = re.compile(r"(?:(?:\.\.\.|…)\s*|[\[(](?:truncated|gekürzt|tronqué|truncado)[\])]|\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\[\+\s?\d+ \w+\]|(?:\.\.\.|…)\s*(?:\[\+\s?\d+ \w+\]|\(?(?:read |show |see )?more\)?|weiterlesen|mehr|lire la suite|leer más|más)\s*[»>→]?|\(?(?:read more|continue reading|weiterlesen|lire la suite|leer más)\)?\s*[»>→]?)$", re.I)
_DEBRIS = re.compile(r"(?:</?[A-Za-z]{0,8}|&#?\w{0,6}|\\u?[0-9A-Fa-f]{0,4}|(?<=\S)(?:%[0-9A-Fa-f]{2})*%[0-9A-Fa-f]{1,2}|(?:%[0-9A-Fa-f]{2})+%?|�)$")
_FIGURE = re.compile(r"^[^\d.!?]{2,60}?(?:\s?:\s|,\s|\s\()\s?[-+~<>≈]?[€$£]?\s?\d[\d.,\s ]*\s?(?:%|percent|prozent|por ciento|million|billion|mio\.?|mrd\.?|millones|millions|[kmb]n?)?\)?$", re.I)
_ROW = re.compile(r"^(?:[-*•–]\s+.*\d\S*|[^|]+(?:\s\|\s[^|]+)+)$")
_INNER_END = re.compile(r"[.!?][\"”»’)]*\s+\S")
_WORDS = re.compile(r"[^\W\d_]+")
_FINAL = re.compile(r"([^\W\d_]+)$")
_SUFFIX = re.compile(r"\s+[|–—-]\s+[^|–—]{2,50}$")


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


def _headline(text: str, title: str | None) -> bool:
    if not title:
        return False
    a, b = _plain(text), _plain(title)
    return a == b or a == _SUFFIX.sub("", b) or _SUFFIX.sub("", a) == _SUFFIX.sub("", b)


def _last_word(text: str) -> str:
    found = _FINAL.search(text)
    return found.group(1).lower() if found else ""


def ending(text: str | None, title: str | None, others: tuple[str | None, ...] = ()) -> tuple[str, str, bool] | None:
    """(kind, final token, strong) of a value that may be cut, or None for a complete one.

    Kind is ``mark``, ``debris`` or ``open``; strong says that an open value is running text or goes on in ``others``.
    ``text`` is the value without its furniture. Null and blank values are complete.
    """
    bare = (text or "").strip()
    if not bare:
        return None
    quoted = _ELLIPSIS_QUOTED.search(bare)
    if quoted:
        if bare[0] not in "\"“«„" or sum(bare.count(q) for q in "\"“”«»„") > 2:
            return None
        return "mark", "", True
    mark = _MARK.search(bare) or not _ENDED.search(bare) and _DEBRIS.search(bare)
    if mark:
        return "mark" if _MARK.search(bare) else "debris", _last_word(bare[: mark.start()]), True
    last = bare.rsplit("\n", 1)[-1].strip()
    goes_on = False
    tail = bare[-40:].rsplit("\n", 1)[-1]
    if len(tail) >= 8:
        for other in others:
            at = other.find(tail) if other else -1
            if at >= 0 and re.match(r"[^\W_]|[ ,;:'’-]+[^\W_]", other[at + len(tail) : at + len(tail) + 3]):
                goes_on = True
    if _ENDED.search(last):
        cut_figure = goes_on and re.search(r"\d[.,]$", last) and any(o and re.search(re.escape(tail) + r"\d", o) for o in others)
        return ("open", "", True) if cut_figure else None
    if _headline(bare, title) or _headline(last, title) or _FIGURE.match(last) or _ROW.match(last):
        return None
    words = _WORDS.findall(bare.lower())
    running = len(words) >= 4 and (sum(w in STOP_WORDS for w in words) / len(words) >= RUNNING or len(words) >= 6 and ", " in last)
    running = running or text[-1:] == " " or bare.count("(") > bare.count(")") or bare.count("„") + bare.count("“") + bare.count("«") > bare.count("”") + bare.count("»") + bare.count("“")
    return "open", _last_word(bare), bool(goes_on or running or _INNER_END.search(bare))


def _surely_ended(text: str) -> bool:
    """A quick test that most complete values pass: an ordinary sentence end, without dots of a mark and not after a digit."""
    return text[-1] in ".!?" and text[-2:-1].isalpha() or text[-2:] in (".”", ".»", '."') and text[-3:-2].isalpha()


def _endings(cards: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(ingest_idx, field, provider, kind, token, strong, length, several words) of the values that may be cut, those of supporting_text
    included: its unfinished tokens are no words either."""
    model = residue.shared(cards.sparkSession, residue.fitted(cards))
    judged = list(dict.fromkeys([*fields, "supporting_text"]))
    sources = list(dict.fromkeys([*judged, "claim", "snippet"]))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules, words = Rules(), residue.Words()
        for batch in batches:
            columns = {c: batch[c].tolist() for c in sources}
            titles, ids, providers = batch["title"].tolist(), batch["ingest_idx"].tolist(), batch["provider"].tolist()
            for field in judged:
                rows, bodies = [], []
                for k, text in enumerate(columns[field]):
                    if not text or _surely_ended(text):
                        continue
                    body = rules.main_text(text, titles[k]) if "\n" in text else text
                    found = ending(body, titles[k], tuple(columns[c][k] for c in sources if c != field))
                    if found:
                        rows.append((ids[k], field, providers[k], *found, len(text), len(body.split(None, 1)) > 1))
                        bodies.append(body)
                if field in residue.FIELDS and rows:
                    clean = residue.residue_scores(bodies, model.value, words) < residue.SHARE
                    rows = [row for row, ok in zip(rows, clean, strict=True) if ok]
                yield pd.DataFrame(rows, columns=["ingest_idx", "field", "provider", "kind", "token", "strong", "length", "several"])

    schema = "ingest_idx bigint, field string, provider string, kind string, token string, strong boolean, length int, several boolean"
    return cards.select("ingest_idx", "title", _provider().alias("provider"), *sources).mapInPandas(look, schema)


def vocabulary(texts: DataFrame, columns: list[str]) -> DataFrame:
    """(word, n, ends): all words of the given text columns in lower case, letters only, with their number of occurrences and
    how many of these stand before the end of a sentence."""
    each = F.regexp_extract_all(F.lower(F.concat_ws(" . ", *columns)), F.lit(r"(\p{L}+(?:[.!?]+(?=[\s\"”»’)]|$))?)"), 1)
    tokens = texts.select(F.explode(each).alias("token")).select(F.rtrim("token", F.lit(".!?")).alias("word"), (F.col("token").substr(F.length("token"), F.lit(1)).isin(".", "!", "?")).alias("end"))
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("end").alias("ends"))


def trie(known: DataFrame) -> DataFrame:
    """(prefix, words, below): the trie of the known words (word, n) as a table of its inner nodes, with the number of words
    below each and of their occurrences. Words of any length take part."""
    nodes = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring(F.col("word"), F.lit(1), k))
    long = known.where(F.length("word") > 1)
    return long.select("n", F.explode(nodes).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("below"))


def limits(found: DataFrame, cards: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, provider, length, at_limit): the lengths at or just below a limit of a provider's field.

    Limits are lengths at which unfinished values pile up; the counts are one row per provider, field and length.
    """
    keys = ["field", "provider", "length"]
    lengths = cards.select(_provider().alias("provider"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.length(f).alias("length")) for f in fields])))
    every = lengths.where(F.col("length").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("values"))
    unfinished = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("unfinished"))
    totals = unfinished.groupBy("field", "provider").agg(F.sum("unfinished").alias("all"))
    many = F.col("unfinished")
    piles = unfinished.join(every, keys).join(totals, ["field", "provider"]).where((many >= LIMIT_VALUES) & (many >= LIMIT_PILE * F.col("all")) & (many >= LIMIT_SHARE * F.col("values")))
    near = F.explode(F.sequence(F.greatest(F.lit(1), F.col("length") - BACK), F.col("length"))).alias("length")
    return piles.select("field", "provider", near).distinct().withColumn("at_limit", F.lit(True))


def _provider() -> Column:
    """The provider, '' for none, as a key of joins."""
    return F.coalesce("provider", F.lit(""))


def judged_values(cards: DataFrame, fields: tuple[str, ...] = ("snippet", "best_quote")) -> DataFrame:
    """(ingest_idx, field, evidence): values that stop before the end of their last sentence, and what says so: ``mark``,
    ``debris``, ``trie``, ``length``, ``goes_on`` or ``context``, the first that applies; null for open values that nothing
    speaks for.

    Furniture lines do not count as text, and residue values are none. Null, empty and blank values are complete; repeated
    rows are judged one by one. Vocabulary, trie and lengths cover all cards; they are joined by final token, so nothing of
    corpus size is broadcast unless a check finds it small.
    """
    found = cut(_endings(cards, fields))
    final = found.where(F.col("token") != "").groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("as_final"))
    words = vocabulary(cards, list(dict.fromkeys(["title", "claim", "supporting_text", *fields])))
    words = cut(words.join(final, "word", "left").withColumn("n", F.col("n") - F.coalesce(F.col("as_final"), F.lit(0))).where(F.col("n") >= KNOWN).select("word", "n", "ends"))
    below = F.coalesce(F.col("below"), F.lit(0))
    evidence = final.join(words, "word", "left").join(trie(words).withColumnRenamed("prefix", "word"), "word", "left").select(
        F.col("word").alias("token"), (F.coalesce("n", F.lit(0)) * RARE < below).alias("cut_word"), (F.col("ends") <= ENDS * F.col("n")).alias("goes_on")
    )
    at = limits(found, cards, fields)
    own = found.where(F.col("field").isin(list(fields))).join(bounded(cut(evidence), 200_000), "token", "left")
    own = own.join(bounded(cut(at), 50_000), ["field", "provider", "length"], "left")
    said = lambda name: F.coalesce(F.col(name), F.lit(False))
    return own.select(
        "ingest_idx", "field",
        F.when(F.col("kind") != "open", F.col("kind")).when(said("cut_word"), "trie").when(said("at_limit"), "length").when(said("goes_on") & F.col("several"), "goes_on").when(F.col("strong"), "context").alias("evidence"),
    )


def cut_values(cards: DataFrame, fields: tuple[str, ...] = ("snippet", "best_quote")) -> DataFrame:
    """(ingest_idx, field): the cut ones of :func:`judged_values`."""
    return judged_values(cards, fields).where(F.col("evidence").isNotNull()).select("ingest_idx", "field")


def cut_rates(cards: DataFrame, profiles: DataFrame, fields: tuple[str, ...] = ("snippet", "best_quote")) -> DataFrame:
    """Values, cut values and their rate per field, provider and site; cards of unknown providers and sites form groups of their own."""
    sited = with_site(cards.select("ingest_idx", "provider", "source_domain", "url", *fields), profiles, [])
    values = sited.select("ingest_idx", "provider", "site", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("has")) for f in fields]))).where("has")
    flagged = cut_values(cards, fields).withColumn("_cut", F.lit(True))
    joined = values.join(flagged, ["ingest_idx", "field"], "left")
    return joined.groupBy("field", "provider", "site").agg(F.count(F.lit(1)).alias("values"), F.count_if(F.col("_cut")).alias("cut")).withColumn("rate", F.col("cut") / F.col("values"))
