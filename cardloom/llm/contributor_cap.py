"""Capping records per dominant contributor by mergeable quality histograms (problem 2).

Level by level, rows of the groups over their cap are counted into bins of a key that orders them (score bins, exact
scores, blocks of row numbers). The bin in which a group's cap falls is its cutoff: better bins stay, worse bins go, and
only the rows of the cutoff bin go on to the next level with what is left of the cap. The counts are partial aggregates, so
a group holding a third of all rows is spread over all tasks; the last level ranks at most ``BLOCK`` rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.sites import valid_score, with_site
from cardloom.session import cut

#: Score bins of the first level, and row numbers per block of the last one.
BINS = 4096
BLOCK = 16_384
#: Copies of the cutoff table, so that the join key of a hot group is spread over this many partitions.
SALT = 16


def _salted_join(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with one small row per group; the small side is copied ``SALT`` times to split hot groups."""
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.col("ingest_idx"), F.lit(SALT)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def _refine(rows: DataFrame, group: list[str], order: Column) -> DataFrame:
    """Rows with ``_order`` (smaller is better), the group's cutoff ``_cut`` and ``_left``, the cap that remains in the cutoff bin.

    Rows of groups within their cap have no row in the result, as nothing of theirs goes.
    """
    rows = rows.withColumn("_order", order)
    counts = rows.groupBy(*group, "_order").agg(F.count(F.lit(1)).alias("_n"), F.first("_cap").alias("_cap"))
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cutoffs = (
        counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_cap")) & (F.col("_upto") - F.col("_n") <= F.col("_cap")))
        .select(*group, F.col("_order").alias("_cut"), (F.col("_cap") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    return _salted_join(rows.drop("_cap"), cutoffs, group)


def over_cap(records: DataFrame, share_divisor: int = 4, bins: int = BINS, block: int = BLOCK) -> DataFrame:
    """Row numbers (``ingest_idx``) of the records that go so that no contributor exceeds its share.

    ``records`` has ingest_idx (unique), id, pool, contributor and score (valid or null). Of each id only the row with the
    smallest ingest_idx takes part; rows without an id are records of their own but do not count towards a pool's size N,
    its number of distinct ids. Each contributor keeps at most ``max(1, N / share_divisor rounded down)`` records of a
    pool, higher score first, records without score last, ties by smaller ingest_idx. Rows without a pool or contributor
    always stay. Empty input gives an empty result.
    """
    group = ["pool", "contributor"]
    columns = ["ingest_idx", "pool", "contributor", "score"]
    held = F.coalesce(F.col("id"), F.concat(F.lit("\x00row "), F.col("ingest_idx").cast("string")))
    first = (
        records.groupBy(held.alias("_held")).agg(F.min(F.struct(*columns)).alias("_r"), F.max(F.col("id").isNotNull()).alias("_counts"))
        .select("_r.*", "_counts").where(F.col("pool").isNotNull())
    )
    first = cut(first.withColumn("_bin", F.when(F.col("score").isNull(), bins).otherwise(F.floor((1 - F.col("score")) * (bins - 1)))))
    sizes = first.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), F.count_if("_counts").alias("_ids"))
    pool_size = sizes.groupBy("pool").agg(F.sum("_ids").alias("_pool_ids"))
    caps = (
        sizes.join(pool_size, "pool").withColumn("_cap", F.greatest(F.lit(1), F.floor(F.col("_pool_ids") / share_divisor)))
        .where(F.col("contributor").isNotNull() & (F.col("_rows") > F.col("_cap"))).select(*group, "_cap")
    )
    rows = _salted_join(first.select(*columns, "_bin"), caps, group)
    by_bin = cut(_refine(rows, group, F.col("_bin")))
    gone = [by_bin.where(F.col("_order") > F.col("_cut"))]
    border = by_bin.where(F.col("_order") == F.col("_cut")).select(*columns, F.col("_left").alias("_cap"))
    by_score = _refine(border, group, -F.coalesce(F.col("score"), F.lit(-1.0)))
    gone.append(by_score.where(F.col("_order") > F.col("_cut")))
    border = by_score.where(F.col("_order") == F.col("_cut")).select(*columns, F.col("_left").alias("_cap"))
    by_block = _refine(border, group, F.floor(F.col("ingest_idx") / block))
    gone.append(by_block.where(F.col("_order") > F.col("_cut")))
    last = by_block.where(F.col("_order") == F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("ingest_idx"))
    gone.append(last.withColumn("_rank", rank).where(F.col("_rank") > F.col("_left")))
    out = gone[0].select("ingest_idx")
    for part in gone[1:]:
        out = out.unionAll(part.select("ingest_idx"))
    return out


def card_records(cards: DataFrame, profiles: DataFrame) -> DataFrame:
    """Evidence cards as records: pool is the request, contributor the site, score the valid credibility score."""
    sited = with_site(cards.select("ingest_idx", "id", "request_id", "source_domain", "url", "credibility_score"), profiles, [])
    return sited.select("ingest_idx", "id", F.col("request_id").alias("pool"), F.col("site").alias("contributor"), valid_score(F.col("credibility_score")).alias("score"))


def capped_cards(cards: DataFrame, profiles: DataFrame) -> DataFrame:
    """All card rows with ``stays``: false for the rows over their site's share of the request."""
    gone = over_cap(card_records(cards, profiles)).withColumn("_gone", F.lit(True))
    return cards.select("ingest_idx", "request_id").join(gone, "ingest_idx", "left").select("ingest_idx", "request_id", F.col("_gone").isNull().alias("stays"))
