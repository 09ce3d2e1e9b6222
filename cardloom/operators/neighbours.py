"""Nearest vectors by cosine similarity: a stated query set against all rows, in blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.session import cut

#: Queries per block: all that the driver holds at a time, and what one scan of the vectors compares.
BLOCK = 32_768


def nearest(vectors: DataFrame, k: int, every: int = 100) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the ``k`` most similar other vectors of each vector whose id is divisible by ``every``.

    Ties go to the smaller id. Null vectors are left out; a zero vector is similar to nothing (0). Queries are cut into blocks
    by a hash of their ids; each block is one scan, in which every task keeps its own best ``k`` per query, and is
    materialised before the next one, so the ranking sees at most k rows per query and task.
    """
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = -(-queries.count() // BLOCK)
    found = []
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").toArrow()
        if part.num_rows:
            matrix = np.stack(part["embedding"].to_numpy()).astype(np.float64)
            found.append(cut(rows.mapInPandas(_search(part["vec_id"].to_numpy(), _unit(matrix), k), "query_id bigint, vec_id bigint, similarity double")))
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, similarity double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return reduce(DataFrame.unionAll, found).withColumn("rank", rank).where(F.col("rank") <= k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _search(ids: np.ndarray, queries: np.ndarray, k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            own = batch["vec_id"].to_numpy()
            scores = np.round((queries @ _unit(np.stack(batch["embedding"].to_numpy()).astype(np.float64)).T), 6)
            scores[ids[:, None] == own[None, :]] = -np.inf
            top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 8] if scores.shape[1] > k + 8 else np.tile(np.arange(scores.shape[1]), (len(ids), 1))
            cutoff = np.take_along_axis(scores, top[:, -1:], axis=1)
            rows_q, rows_v = np.nonzero(scores >= cutoff)  # ties at the edge all stay for the exact ranking below
            part = pd.DataFrame({"query_id": ids[rows_q], "vec_id": own[rows_v], "similarity": scores[rows_q, rows_v]})
            best = part if best is None else pd.concat([best, part])
            best = best[np.isfinite(best["similarity"])].sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best

    return search
