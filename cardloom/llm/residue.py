"""Template residue, filler, error-page text and script notices, by positive-unlabelled naive Bayes (problem 4).

A text is divided into passages: each unfilled placeholder is one of its own, the rest are sentences and lines. A naive
Bayes model over hashed words is learned by expectation-maximization. Residue is a mixture of kinds (failures, script
notices, filler, Latin filler, program text; placeholders are judged among themselves), each with its own distribution:
trusted records keep their kind, all other passages begin as clean with a small prior and are re-estimated. Every passage
is then scored. A record is residue if a placeholder passage is, or if most of the words of its passages are in such ones.

The trusted records are written from public grammars (``trusted.py``), not from any table. Word counts cover all passages
of all rows: one pass adds them up, a second finds the passages that the first estimate does not rule out, and the further
rounds work on these alone, as the others add nothing to the counts of residue.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.trusted import KINDS, trusted_records
from cardloom.session import cut

#: Fields of evidence cards in which residue is looked for.
FIELDS = ("snippet", "supporting_text")
#: Hashed features of words and word pairs, and after them those of placeholders.
FEATURES, MARKS = 1 << 17, 1 << 12
ROUNDS = 6
#: First share of a kind of residue among passages, and of residue among bracketed pieces; bounds of the later estimates.
PRIOR, MARK_PRIOR = 0.01, 0.5
LEAST, MOST = 0.002, 0.2
#: Log odds under the first estimate below which a passage counts as clean in all rounds (a belief of 0.0003).
RULED_OUT = -8.0
#: Weight of the background distribution in that of residue and of clean text, as a share of their words. Rare words thus
#: say little, and no word alone outweighs many.
SMOOTH_RESIDUE, SMOOTH_CLEAN = 0.1, 0.005
#: Share of a record's words that must be in positive passages.
SHARE = 0.6
#: Passages of up to so many words also count their neighbouring pairs.
PAIRED = 12
#: Words that the trusted records of a kind count for together, as a share of all words of the fit, at least.
TRUSTED_SHARE = 0.0005

_PLACEHOLDER = re.compile(
    r"\{\{[^{}]{1,80}\}\}|\{%[^%]{1,80}%\}|<%=?[^%]{1,80}%>|[$#]\{[^{}]{1,80}\}|\{[A-Za-z_][^{}]{0,60}\}|\[\[[^\[\]]{1,80}\]\]|\[[^\[\]]{1,80}\]|%\([^()]{1,60}\)[sd]|@@[^@\s]{1,60}@@|__[^_\s](?:[^\s]{0,58}[^_\s])?__|<[A-Za-z][^<>]{1,60}>"
)
_MARKS = re.compile(r"[{\[<@%_$#]")
_SPLIT = re.compile(r"(?<=[.!?…])[\"”»)]*\s+|\n+")
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?…][\"”»)]*$")
_FIGURE = re.compile(r"^[^\d.!?]{2,60}?(?:\s?:\s|,\s|\s\()\s?[-+]?\d[\d.,\s ]*(?:%|percent|million|billion)?\)?$")
_CODE = re.compile(r"(?=[a-f0-9]*[0-9])[a-f0-9]{6,}")
_INSIDE = re.compile(r"^[{\[<%$#@_=(\s]+|[}\]>%@_)\s]+[sd]?$")


def _key(text: str) -> int:
    return zlib.crc32(text.encode()) & (FEATURES - 1)


_NUMBER = _key("w 0")
BREAK = -1


class Words(dict):
    """Features of each piece of text between blanks, kept as long as there are not too many: those of its words, and
    ``BREAK`` where it ends a sentence. All numbers are one word, and all codes."""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        words = _WORD.findall(piece)
        keys = tuple(_key("w " + ("0" if w.isdigit() else "hex" if _CODE.fullmatch(w) else w)) for w in words)
        self[piece] = keys = (*keys, BREAK) if _END.search(piece) else keys
        return keys


def _mark_key(text: str) -> int:
    return FEATURES + (zlib.crc32(text.encode()) & (MARKS - 1))


def _placeholder_keys(mark: str) -> list[int]:
    """Features of a bracketed piece, each a passage of its own: its brackets with the kind of its inside, or for several
    words the first and the last, either of which may tell a note to the editor."""
    inside = _INSIDE.sub("", mark)
    words = _WORD.findall(inside.lower())
    opening = re.match(r"\{\{|\{%|<%|[$#]\{|\[\[|%\(|@@|__|.", mark).group()
    kind = "name" if re.fullmatch(r"[A-Za-z_][\w.\- ]*", inside) else "other"
    if opening in "[<":
        if not words:
            return [_mark_key("b empty " + opening)]
        return [_mark_key(f"b first {opening} {words[0]}"), _mark_key(f"b last {opening} {words[-1]}")] if len(words) > 1 else [_mark_key(f"b one {opening}")]
    return [_mark_key(f"b {opening} {kind}")]


class Passages:
    """The passages of many texts as flat arrays: per passage its text (``owner``), whether it is a placeholder (``mark``)
    and its ``words``; per feature its ``key`` and the passage (``row``). Null and blank texts have none."""

    def __init__(self, texts: list[str | None], words: Words | None = None):
        known = Words() if words is None else words
        marks: list[tuple[int, int]] = []
        keys: list[int] = []
        ends: list[int] = []
        plain: list[str] = []
        for k, text in enumerate(texts):
            text = (text or "").lower()
            if _MARKS.search(text):
                marks += [(k, key) for piece in _PLACEHOLDER.findall(text) for key in _placeholder_keys(piece)]
                text = _PLACEHOLDER.sub(lambda m: m.group() if m.group()[0] in "[<" else " ", text)
            plain.append(text)
            for line in text.split("\n"):
                keys.extend(chain.from_iterable(map(known.__getitem__, line.split())))
                keys.append(BREAK)
            ends.append(len(keys))
        every = np.array(keys, dtype=np.int64)
        broken = every == BREAK
        piece = np.cumsum(broken) - broken  # number of the piece that each token stands in, of all pieces, empty ones too
        word = ~broken
        filled, size = np.unique(piece[word], return_counts=True)
        text_of = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
        owner = np.zeros(int(broken.sum()), dtype=np.int64)
        owner[piece[broken]] = text_of[broken]
        key, row = every[word], np.repeat(np.arange(len(filled)), size)
        owner = owner[filled]
        drop = self._figures(plain, owner, size, np.bincount(row[key == _NUMBER], minlength=len(filled)) > 0)
        keep = ~drop[row]  # a complete label with its figure says nothing about residue
        key, row, some = key[keep], row[keep], np.where(drop, 0, size)
        more = np.array(marks, dtype=np.int64).reshape(-1, 2)
        self.owner = np.concatenate([owner, more[:, 0]])
        self.mark = np.concatenate([np.zeros(len(filled), dtype=bool), np.ones(len(more), dtype=bool)])
        self.words = np.concatenate([size, np.ones(len(more), dtype=np.int64)])
        size = np.concatenate([some, np.ones(len(more), dtype=np.int64)])
        key = np.concatenate([key, more[:, 1]])
        row = np.concatenate([row, len(filled) + np.arange(len(more))])
        # neighbouring pairs tell short messages from short sentences
        paired = (row[1:] == row[:-1]) & ~self.mark[row[1:]] & (size[row[1:]] <= PAIRED) if len(key) > 1 else np.zeros(0, dtype=bool)
        pairs = (key[:-1][paired] * 31 + key[1:][paired] * 17 + 7) & (FEATURES - 1) if len(key) > 1 else key[:0]
        self.key = np.concatenate([key, pairs])
        self.row = np.concatenate([row, row[1:][paired] if len(key) > 1 else row[:0]])

    @staticmethod
    def _figures(texts: list[str], owner: np.ndarray, size: np.ndarray, numbered: np.ndarray) -> np.ndarray:
        """Which passages are a label with its figure; only texts with a short one that has a number are looked at again."""
        out = np.zeros(len(owner), dtype=bool)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        for k in np.unique(owner[numbered & (size <= 8)]):
            pieces = [p for p in _SPLIT.split(texts[k]) if _WORD.search(p)]
            for at, piece in enumerate(pieces[: first[k + 1] - first[k]], first[k]):
                out[at] = size[at] <= 8 and bool(_FIGURE.match(piece.strip()))
        return out

    def __len__(self) -> int:
        return len(self.owner)

    def margins(self, odds: np.ndarray) -> np.ndarray:
        """Log odds of each kind of residue per passage, one row per kind."""
        return _margins(self.key, self.row, len(self), self.mark, odds)


def _margins(key: np.ndarray, row: np.ndarray, n: int, mark: np.ndarray, odds: np.ndarray) -> np.ndarray:
    sums = np.stack([np.bincount(row, weights=kind[key], minlength=n) for kind in odds])
    return sums + np.where(mark, odds[:, -1:], odds[:, -2:-1])


def _beliefs(margins: np.ndarray) -> np.ndarray:
    """Share of each kind in each passage, clean (log odds 0) being one more kind."""
    top = np.maximum(margins.max(axis=0), 0.0)
    each = np.exp(np.maximum(margins - top, -60.0))
    return each / (each.sum(axis=0) + np.exp(-top))


def _odds(positive: np.ndarray, total: np.ndarray, shares: np.ndarray, mark_share: float, first: bool = False) -> np.ndarray:
    """Log odds against clean per kind and feature, then those of the priors of passages and of placeholders.

    ``positive`` has one row of counts per kind, the last one for placeholders, whose features are normalised apart. Features
    that neither side has get 0. At ``first`` all passages but the trusted ones count as clean, and of bracketed pieces, most
    of which are residue, those without a trusted feature.
    """
    out = np.zeros((len(positive), len(total)))
    clean = np.maximum(total - positive.sum(axis=0), 0.0)
    for part, kinds in ((slice(0, FEATURES), range(len(positive) - 1)), (slice(FEATURES, FEATURES + MARKS), [len(positive) - 1])):
        whole, rest = total[part], clean[part]
        if first and part.start:
            rest = np.where(positive[-1, part] > 0, 0.0, whole)
        background = whole / max(1.0, whole.sum())
        in_clean = (rest + SMOOTH_CLEAN * rest.sum() * background) / ((1 + SMOOTH_CLEAN) * max(1e-9, rest.sum()))
        for k in kinds:
            own = positive[k, part]
            in_kind = (own + SMOOTH_RESIDUE * own.sum() * background) / ((1 + SMOOTH_RESIDUE) * max(1e-9, own.sum()))
            known = (whole > 0) & (in_clean > 0) & (in_kind > 0)
            out[k, part] = np.where(known, np.log(np.where(known, in_kind, 1.0)) - np.log(np.where(known, in_clean, 1.0)), 0.0)
    prior = np.append(np.log(shares / (1 - shares)), -60.0)  # words are of no placeholder, placeholders of no other kind
    marks = np.append(np.full(len(shares), -60.0), np.log(mark_share / (1 - mark_share)))
    return np.hstack([out, prior[:, None], marks[:, None]])


def residue_scores(texts: list[str | None], odds: np.ndarray, words: Words | None = None) -> np.ndarray:
    """Per text 1 if a placeholder passage is residue, else the share of words in such passages; 0 for null and blank ones."""
    found = Passages(texts, words)
    out = np.zeros(len(texts))
    if not len(found):
        return out
    positive = _beliefs(found.margins(odds)).sum(axis=0) > 0.5
    plain = ~found.mark
    every = np.bincount(found.owner[plain], weights=found.words[plain], minlength=len(texts))
    bad = np.bincount(found.owner[plain & positive], weights=found.words[plain & positive], minlength=len(texts))
    np.divide(bad, every, out=out, where=every > 0)
    out[found.owner[found.mark & positive]] = 1.0
    return out


def residue_score(text: str | None, odds: np.ndarray) -> float:
    """The score of one text, see :func:`residue_scores`."""
    return float(residue_scores([text], odds)[0])


def is_residue(text: str | None, odds: np.ndarray) -> bool:
    """Whether a text is residue under the log odds of :func:`fitted`; null and blank texts are none."""
    return residue_score(text, odds) >= SHARE


def _counts(counts: np.ndarray) -> pd.DataFrame:
    kind, feature = np.nonzero(counts)
    return pd.DataFrame({"kind": kind, "feature": feature, "n": counts[kind, feature]})


def _summed(counts: DataFrame, kinds: int) -> np.ndarray:
    """The sum of (kind, feature, n) rows as one array; its size is fixed, whatever the data."""
    out = np.zeros((kinds, FEATURES + MARKS + 2))
    rows = counts.groupBy("kind", "feature").agg(F.sum("n").alias("n")).toArrow()
    out[rows["kind"].to_numpy(), rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return out


def _tally(key: np.ndarray, row: np.ndarray, weight: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Counts per feature, each passage weighing ``weight``, then the weights of passages and of placeholders."""
    out = np.bincount(key, weights=weight[row], minlength=FEATURES + MARKS + 2)
    out[-2], out[-1] = weight[~mark].sum(), weight[mark].sum()
    return out


def fitted(cards: DataFrame, fields: tuple[str, ...] = FIELDS, rounds: int = ROUNDS, trusted: dict[str, list[str]] | None = None) -> np.ndarray:
    """The model, see :func:`_odds`, by expectation-maximization over ``trusted`` records by kind and all texts of ``fields``.

    Two passes over the cards, then ``rounds - 1`` over the passages that the first estimate leaves open.
    """
    spark = cards.sparkSession
    records = trusted_records() if trusted is None else trusted
    texts = cards.select(*fields)
    kinds = len(KINDS) + 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, words = np.zeros((1, FEATURES + MARKS + 2)), Words()
        for batch in batches:
            for f in fields:
                found = Passages(batch[f].tolist(), words)
                total[0] += _tally(found.key, found.row, np.ones(len(found)), found.mark)
        yield _counts(total)

    every = _summed(texts.mapInPandas(count, "kind int, feature int, n double"), 1)[0]
    sure = np.zeros((kinds, FEATURES + MARKS))
    for k, kind in enumerate(KINDS):
        known = Passages(records.get(kind, []))
        own = np.bincount(known.key, minlength=FEATURES + MARKS).astype(float)
        sure[-1, FEATURES:] += own[FEATURES:]
        size = own[:FEATURES].sum()
        sure[k, :FEATURES] = own[:FEATURES] * max(1.0, TRUSTED_SHARE * every[:FEATURES].sum() / size) if size else 0.0
    sure[-1] *= max(1.0, 0.1 * every[FEATURES:-2].sum() / max(1.0, sure[-1].sum()))
    total = every[:-2] + sure.sum(axis=0)
    odds = _odds(sure, total, np.full(len(KINDS), PRIOR), MARK_PRIOR, first=True)
    first = spark.sparkContext.broadcast(odds)

    def open_ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            for f in fields:
                found = Passages(batch[f].tolist(), words)
                if not len(found):
                    continue
                keep = np.nonzero((found.margins(first.value).max(axis=0) > RULED_OUT) & (np.bincount(found.row, minlength=len(found)) > 0))[0]
                order = np.argsort(found.row, kind="stable")
                ends = np.searchsorted(found.row[order], np.arange(len(found) + 1))
                keys = found.key[order].astype(np.int32)
                yield pd.DataFrame({"keys": pd.Series([np.sort(keys[ends[k] : ends[k + 1]]) for k in keep], dtype=object), "mark": found.mark[keep], "n": np.ones(len(keep))})

    left = cut(texts.mapInPandas(open_ones, "keys array<int>, mark boolean, n double").groupBy("keys", "mark").agg(F.sum("n").alias("n")))
    for _ in range(rounds - 1):
        model = spark.sparkContext.broadcast(odds)

        def believe(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            positive = np.zeros((kinds, FEATURES + MARKS + 2))
            for batch in batches:
                if len(batch):
                    key, row = np.concatenate(batch["keys"].to_list()), np.repeat(np.arange(len(batch)), batch["keys"].map(len))
                    mark = batch["mark"].to_numpy()
                    belief = _beliefs(_margins(key, row, len(batch), mark, model.value))
                    belief[:, mark] = belief[:, mark] > 0.5  # of one feature each: parts of it would never settle
                    belief *= batch["n"].to_numpy()
                    for k in range(kinds):
                        positive[k] += _tally(key, row, belief[k], mark)
            yield _counts(positive)

        found = _summed(left.mapInPandas(believe, "kind int, feature int, n double"), kinds)
        shares = np.clip(found[:-1, -2] / max(1.0, every[-2]), LEAST, MOST)
        odds = _odds(sure + found[:, :-2], total, shares, float(np.clip(found[-1, -1] / max(1.0, every[-1]), LEAST, 1 - MOST)))
    return odds


def shared(spark: SparkSession, model: np.ndarray):
    """The model as a broadcast variable; its size is fixed by ``FEATURES``."""
    return spark.sparkContext.broadcast(model)


def residue_values(cards: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(ingest_idx, field, score): values of ``fields`` that are residue, their page furniture aside.

    Null, empty and blank values are none; repeated rows are judged one by one; other columns are not read.
    """
    from cardloom.llm.boilerplate import Rules

    model = shared(cards.sparkSession, fitted(cards, fields))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, rules = Words(), Rules()
        for batch in batches:
            for field in fields:
                bodies = [rules.main_text(text, title) if text and "\n" in text else text for text, title in zip(batch[field], batch["title"], strict=True)]
                scores = residue_scores(bodies, model.value, words)
                hit = scores >= SHARE
                yield pd.DataFrame({"ingest_idx": batch["ingest_idx"][hit], "field": field, "score": scores[hit]})

    return cards.select("ingest_idx", "title", *fields).mapInPandas(score, "ingest_idx bigint, field string, score double")
