"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (problem 8).

1. Texts are counted in tokens of a public tokenizer, in one pass.
2. The size of the mix is that of all texts of sources with a target, or the one asked for. Large sources are cut down to
   their share, small ones repeated up to their allowed copies; a source that cannot reach its share gives all copies it
   may, the others keep their sizes, and the report has both the target and the share that could be attained.
3. A tree over the output shards divides the sources' token quotas: node by node a multivariate hypergeometric draw says how
   many tokens of each source go left and right, so that all shards are equally large, every shard is a random sample
   without replacement and the quotas are met. The tree works on one number per source and shard.
4. Each source's documents are cut into blocks by a hash of their ids. The blocks in a drawn order, once per copy, form a
   line that the shards' quotas cut: every copy of a block has a shard of its own. As the order is the same in every round,
   copies of a document are a whole round apart, and so in different shards where there are enough. In the block in which a
   quota ends, documents are taken by smaller blocks, and one by one only in the last of these. A hash orders each shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.session import bounded, cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SHARDS = 8
#: Blocks per source; a document's blocks depend on its id alone.
BLOCKS = 512
SEED = 90_125


def with_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): the size of each text in tokens of the tokenizer file; null and empty texts have 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            sizes = []
            for i in range(0, len(texts), 256):
                sizes += [len(e.ids) for e in tok.encode_batch(texts[i : i + 256], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": sizes})

    return documents.select("doc_id", "source", "text").mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, dict]:
    """Wanted tokens per source, ``share * total``, of which ``drawn`` are at most ``available * repeats``; ``attainable`` is
    the share of these in the mix.

    Without ``total``, the mix is as large as all texts that the targets' sources have.
    """
    if total is None:
        total = sum(available.get(s, 0) for s in targets)
    out = {}
    for source, (share, repeats) in targets.items():
        most = available.get(source, 0) * max(1, repeats or 1)
        wanted = int(round((share or 0.0) * total))
        out[source] = {"share": share or 0.0, "wanted": wanted, "drawn": min(wanted, most)}
    size = sum(x["drawn"] for x in out.values())
    for x in out.values():
        x["attainable"] = x["drawn"] / size if size else 0.0
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): ``quotas`` per source divided at random, level by level, into shards of equal size."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    take = int(quotas.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals") if quotas.sum() else np.zeros_like(quotas)
    return np.vstack([split_tree(drawn, left, rng), split_tree(quotas - drawn, shards - left, rng)])


def lines(blocks: dict[str, list[tuple[int, int]]], quotas: dict[str, int], shards: int, rng: np.random.Generator) -> list[tuple[str, int, int, int, int | None]]:
    """(source, block, copy, shard, part) of all blocks (number, tokens) that the quotas take; part is null for whole blocks
    and the tokens to take in the one in which a quota ends."""
    names = sorted(s for s in blocks if quotas.get(s, 0) > 0)
    quota = np.array([quotas[s] for s in names], dtype=np.int64)
    unit = max(1, -(-int(quota.sum()) // 500_000_000))  # what the generator can divide
    cuts = np.cumsum(split_tree(-(-quota // unit), shards, rng), axis=0) * unit
    out = []
    for k, source in enumerate(names):
        order = [blocks[source][i] for i in rng.permutation(len(blocks[source]))]
        size = np.array([tokens for _, tokens in order], dtype=np.int64)
        left, done, copy = int(quota[k]), 0, 1
        while left > 0:
            ends = np.cumsum(size)
            whole = int(np.searchsorted(ends, left, side="right"))
            middle = done + ends - size / 2
            shard = np.minimum(np.searchsorted(cuts[:, k], middle, side="right"), shards - 1)
            out += [(source, order[i][0], copy, int(shard[i]), None) for i in range(whole)]
            if whole < len(order):
                rest = left - int(ends[whole - 1] if whole else 0)
                if rest:
                    at = int(min(np.searchsorted(cuts[:, k], done + left - rest / 2, side="right"), shards - 1))
                    out.append((source, order[whole][0], copy, at, rest))
                break
            left, done, copy = left - int(ends[-1]), done + int(ends[-1]), copy + 1
    return out


def _ended(rows: DataFrame, sources: int) -> DataFrame:
    """The documents of cut blocks that their ``_part`` takes, in hashed order, the last one if half of it fits.

    Blocks are cut again, so that a window only sees documents of one small block per source.
    """
    spark = rows.sparkSession
    sums = rows.groupBy("source", "_part", "_small").agg(F.sum("tokens").alias("tokens")).collect()  # at most BLOCKS per source
    taken, left = [], {}
    for r in sorted(sums, key=lambda r: (r.source, r._small)):
        rest = left.setdefault(r.source, r._part)
        if rest > 0:
            taken.append((r.source, r._small, min(rest, r.tokens), rest < r.tokens))
            left[r.source] = rest - r.tokens
    plan_rows = spark.createDataFrame(taken or [("", 0, 0, False)], "source string, _small int, _rest long, _cut boolean")
    near = rows.join(bounded(plan_rows, sources * BLOCKS), ["source", "_small"])
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = near.where("_cut").withColumn("_upto", upto).where(F.col("_upto") - F.col("tokens") / 2 <= F.col("_rest")).drop("_upto")
    return near.where("not _cut").unionByName(last).drop("_rest", "_cut")


def mixed(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total: int | None = None, shards: int = SHARDS, blocks: int = BLOCKS, max_targets: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(copies, report) of the mix.

    copies: one row (doc_id, source, copy, tokens, shard, position) per copy of a document, copies numbered from 1; shards are
    read in the order of position. report: (source, target_share, max_repeats, available_tokens, drawn_tokens,
    attainable_share, actual_share, reached), where a target is reached if its tokens are drawn up to one document. Of a
    source's documents, all get the same number of copies and some, in a hashed order, one more. Sources without a target are
    left out of both; targets without documents are reported with 0. Null and empty texts have no tokens and are left out.
    Repeated target rows of one source count once (the largest share). ``targets`` must have at most ``max_targets`` rows,
    which is checked, as the plan is made on the driver.
    """
    spark = documents.sparkSession
    rows = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).limit(max_targets + 1).collect()
    if len(rows) > max_targets:
        raise ValueError(f"more than {max_targets} targets")
    wanted = {r.source: (float(r.share or 0.0), int(r.repeats or 1)) for r in rows}
    order = F.xxhash64(F.lit(SEED), "source", "doc_id")
    names = bounded(spark.createDataFrame([(s,) for s in wanted] or [("",)], "source string"), max_targets)
    sized = with_tokens(documents.join(names, "source", "left_semi"), tokenizer).where(F.col("tokens") > 0)
    sized = cut(sized.withColumns({"_order": order, "_block": F.pmod(order, F.lit(blocks)).cast("int"), "_small": F.pmod(F.shiftrightunsigned(order, 20), F.lit(BLOCKS)).cast("int")}))
    per_block = sized.groupBy("source", "_block").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest")).collect()  # sources x blocks rows
    available: dict[str, int] = {}
    largest: dict[str, int] = {}
    of_source: dict[str, list[tuple[int, int]]] = {}
    for r in sorted(per_block, key=lambda r: (r.source, r._block)):
        available[r.source] = available.get(r.source, 0) + r.tokens
        largest[r.source] = max(largest.get(r.source, 0), r.largest)
        of_source.setdefault(r.source, []).append((r._block, r.tokens))
    quota = plan(available, wanted, total)
    layout = lines(of_source, {s: x["drawn"] for s, x in quota.items()}, shards, np.random.default_rng(SEED))
    plan_rows = spark.createDataFrame(layout or [("", 0, 0, 0, None)], "source string, _block int, copy int, shard int, _part long")
    placed = sized.join(bounded(plan_rows, 1_000_000), ["source", "_block"])
    every = placed.where(F.col("_part").isNull()).unionByName(_ended(placed.where(F.col("_part").isNotNull()), len(wanted)))
    copies = cut(every.select("doc_id", "source", "copy", "tokens", "shard", F.xxhash64(F.lit(SEED + 1), "doc_id", "copy").alias("position")))
    drawn = {r.source: int(r.n) for r in copies.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    size = sum(drawn.values())
    report = [
        (s, share, repeats, available.get(s, 0), drawn.get(s, 0), quota[s]["attainable"], drawn.get(s, 0) / size if size else 0.0, drawn.get(s, 0) + largest.get(s, 0) > quota[s]["wanted"] or not quota[s]["wanted"])
        for s, (share, repeats) in sorted(wanted.items())
    ]
    schema = "source string, target_share double, max_repeats int, available_tokens long, drawn_tokens long, attainable_share double, actual_share double, reached boolean"
    return copies, spark.createDataFrame(report, schema)
