"""Evaluation passages in a training corpus, by a prefix-filtered set join on word shingles (problem 7).

What counts is the share of an item's words that lie in runs of three words common with a document. The filter is derived
from that measure, so it loses nothing: a common run covers at most three words, so a share of the ``n`` words takes common
runs at ``required = ceil(ceil(share * n) / 3)`` places of the item.

1. Shingles of three words are taken from every item and every document; document shingles meet the item shingles in a
   map-side join, so that only shared ones go on.
2. An item's shingles are ordered by rarity (number of corpus documents), each weighing the places that it has in the item.
   A document with ``required`` places must have ``l`` of them among the rarest ones that hold ``all - required + l``; only
   these prefix shingles are joined, and pairs with fewer than ``l`` (half of required) are dropped, which ends most pairs
   that share nothing but wording common to many items. So are documents too short to have that many shingles.
3. Each candidate is verified on whole texts: in windows of the item's size, item words covered by common runs are marked;
   windows with at least five covered words count, and the union over all windows is the containment. Only texts of
   candidates move: documents are first filtered where they are read, by a bitmap of candidate ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.membership import possibly_in
from cardloom.functions.words import with_shingles, words
from cardloom.session import bounded, cut, fits

#: Words of a run, and of the shingles that find candidates.
RUN = 3
#: Least words of an item, and of the covered words of a window: fewer are a name or a short phrase.
LEAST = 5
CONTAINMENT = 0.5
#: Distinct item shingles up to which they are broadcast; beyond, a bitmap of fixed size is, and what passes it is shuffled.
KEYS = 500_000


def containment(doc: list[str], item: list[str], run: int = RUN, least: int = LEAST) -> float:
    """Share of the item's words that lie in runs of ``run`` words common with the document, over item-sized windows."""
    n = len(item)
    if n < run or len(doc) < run:
        return 0.0
    at: dict[tuple, list[int]] = {}
    for i in range(n - run + 1):
        at.setdefault(tuple(item[i : i + run]), []).append(i)
    hits = [(p, at[key]) for p in range(len(doc) - run + 1) if (key := tuple(doc[p : p + run])) in at]
    covered: set[int] = set()
    step = max(1, n // 2)
    windows: dict[int, set[int]] = {}
    for p, starts in hits:
        words_covered = {i + k for i in starts for k in range(run)}
        for w in {p // step, max(0, p // step - 1)}:  # every run lies whole in one of these windows of n words
            windows.setdefault(w, set()).update(words_covered)
    for marked in windows.values():
        if len(marked) >= least:
            covered |= marked
    return len(covered) / n


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        shares = [containment(list(d), list(i)) for d, i in zip(batch["_doc"], batch["_item"], strict=True)]
        yield batch[["item_id", "doc_id"]].assign(containment=shares)


def candidates(items: DataFrame, documents: DataFrame, share: float = CONTAINMENT) -> DataFrame:
    """(item_id, _copy, doc_id): pairs that may reach ``share``; none that does is missing. ``items`` has (item_id, _copy, _item)."""
    placed = with_shingles(items, ["item_id", "_copy"], "_item", RUN).where(F.col("_words") >= LEAST)
    required = F.ceil(F.ceil(F.col("_words") * share) / RUN).cast("int")
    weighed = placed.select("item_id", "_copy", F.size("_shingles").alias("_all"), required.alias("_required"), F.explode("_shingles").alias("_h"))
    weighed = cut(weighed.groupBy("item_id", "_copy", "_h").agg(F.count(F.lit(1)).cast("int").alias("_places"), F.first("_all").alias("_all"), F.first("_required").alias("_required")))
    keys = weighed.select("_h").distinct()
    small = fits(keys, KEYS)
    held = with_shingles(documents.select("doc_id", "text"), ["doc_id"], "text", RUN).select("doc_id", F.col("_words").alias("_length"), F.explode(F.array_distinct("_shingles")).alias("_h"))
    shared = cut(held.join(F.broadcast(keys), "_h", "left_semi") if small else possibly_in(held, "_h", keys).join(keys, "_h", "left_semi"))
    rarity = shared.groupBy("_h").agg(F.count(F.lit(1)).alias("_df"))
    by = Window.partitionBy("item_id", "_copy").orderBy(F.coalesce(F.col("_df"), F.lit(0)), "_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.ceil(F.col("_required") / 2).cast("int")
    most = F.max("_places").over(Window.partitionBy("item_id", "_copy"))
    ordered = weighed.join(F.broadcast(rarity) if small else rarity, "_h", "left").withColumns({"_upto": F.sum("_places").over(by), "_shortest": F.ceil(F.col("_required") / most) + RUN - 1})
    index = ordered.where(F.col("_upto") - F.col("_places") < F.col("_all") - F.col("_required") + least)
    index = index.select("_h", "item_id", "_copy", "_places", least.alias("_least"), "_shortest")
    found = shared.join(bounded(index, KEYS), "_h").where(F.col("_length") >= F.col("_shortest")).groupBy("doc_id", "item_id", "_copy").agg(F.sum("_places").alias("_found"), F.first("_least").alias("_least"))
    return found.where(F.col("_found") >= F.col("_least")).select("item_id", "_copy", "doc_id")


def leaked_items(items: DataFrame, documents: DataFrame, share: float = CONTAINMENT) -> DataFrame:
    """(item_id, doc_id, containment): documents that hold at least ``share`` of an item's words in copied passages.

    Letter case, accents, punctuation, spacing and line breaks are ignored. Null and empty texts, and items of fewer than
    five words, are in no pair. Copies of a document are rows of their own. Items whose ids repeat count once per distinct
    text; the pair then carries the largest containment.
    """
    texts = items.select("item_id", F.xxhash64("text").alias("_copy"), F.col("text").alias("_item")).dropDuplicates(["item_id", "_copy"])
    pairs = cut(candidates(texts, documents, share))
    item_words = texts.select("item_id", "_copy", words(F.col("_item")).alias("_item"))
    near = possibly_in(documents.select("doc_id", "text"), "doc_id", pairs.select("doc_id"))
    both = near.join(pairs, "doc_id").select("item_id", "_copy", "doc_id", words(F.col("text")).alias("_doc")).join(bounded(item_words, 10_000), ["item_id", "_copy"])
    checked = both.select("item_id", "doc_id", "_doc", "_item").mapInPandas(_verify, "item_id bigint, doc_id bigint, containment double")
    return checked.where(F.col("containment") >= share).groupBy("item_id", "doc_id").agg(F.max("containment").alias("containment"))
