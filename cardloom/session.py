"""Session-level helpers: shared checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, else (local runs and tests only) a temporary one."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="cardloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage, so that lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> bool:
    """Whether ``df`` has at most so many rows and bytes (texts and nested values by their length, others 8 bytes each)."""
    sizes = [F.coalesce(F.octet_length(c if kind == "string" else F.to_json(F.struct(c))), F.lit(0)) if kind == "string" or "<" in kind else F.lit(8) for c, kind in df.dtypes]
    total = sizes[0].cast("long")
    for size in sizes[1:]:
        total = total + size
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def bounded(df: DataFrame, max_rows: int = 50_000, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it is that small (see :func:`fits`), unchanged (a shuffled join) beyond that."""
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df
