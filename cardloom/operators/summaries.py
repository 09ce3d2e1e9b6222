"""Summaries of evidence tables: counts, distributions, source quality, triangulation by claim, validation, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.sites import valid_score


def source_quality(cards: DataFrame) -> DataFrame:
    """Per source domain: cards, distinct claims, mean scores, first and last stated date, providers, uniqueness.

    Null domains form the group ``unknown``; scores that are no valid number count as 0.5. Two aggregations: one over the
    cards, one over distinct (domain, claim), so that no task holds a domain's claims.
    """
    rows = cards.select(
        F.coalesce("source_domain", F.lit("unknown")).alias("domain"), F.coalesce("claim", "snippet", "title").alias("claim"), "provider", "date",
        F.coalesce(valid_score(F.col("credibility_score")), F.lit(0.5)).alias("credibility"), F.coalesce(valid_score(F.col("confidence")), F.lit(0.5)).alias("confidence"),
    )
    totals = rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("total_cards"), F.avg("credibility").alias("c"), F.avg("confidence").alias("f"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen")
    )
    claims = rows.groupBy("domain", "claim").agg(F.lit(1)).groupBy("domain").agg(F.count("claim").alias("unique_claims"))
    providers = rows.groupBy("domain", "provider").agg(F.lit(1)).groupBy("domain").agg(F.count("provider").alias("provider_count"))
    joined = totals.join(claims, "domain").join(providers, "domain")
    return joined.select(
        "domain", "total_cards", "unique_claims", F.round("c", 9).alias("avg_credibility"), F.round("f", 9).alias("avg_confidence"), "first_seen", "last_seen", "provider_count",
        F.round(F.col("unique_claims") / F.col("total_cards"), 4).alias("uniqueness_ratio"),
    )


def claim_triangulation(cards: DataFrame, key: str = "claim") -> DataFrame:
    """One row: repeated claims, those on at least two and three domains, mean and largest number of domains.

    Claims are counted over distinct (claim, domain) pairs; null claims and null domains do not count.
    """
    rows = cards.where(F.col(key).isNotNull()).groupBy(key, "source_domain").agg(F.count(F.lit(1)).alias("n"))
    per_claim = rows.groupBy(key).agg(F.sum("n").alias("n"), F.count("source_domain").alias("domains")).where(F.col("n") >= 2)
    return per_claim.agg(
        F.count(F.lit(1)).alias("total_claims"), F.count_if(F.col("domains") >= 2).alias("on_two"), F.count_if(F.col("domains") >= 3).alias("on_three"),
        F.round(F.avg("domains"), 4).alias("avg_domains"), F.max("domains").alias("max_domains"),
    )


def evidence_counts(cards: DataFrame) -> DataFrame:
    """One row: cards and distinct domains, providers, claims and requests."""
    distinct = lambda c: F.countDistinct(c).alias(f"{c}s")
    return cards.agg(F.count(F.lit(1)).alias("cards"), distinct("source_domain"), distinct("provider"), distinct("claim"), distinct("request_id"))


def quality_stats(cards: DataFrame) -> DataFrame:
    """One row: mean, sample deviation and exact median of valid credibility scores, mean confidence.

    Cards are first counted per distinct pair of scores, so the median's buffer holds distinct scores instead of all.
    """
    score = valid_score(F.col("credibility_score"))
    pairs = cards.groupBy(score.alias("s"), valid_score(F.col("confidence")).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    scores = F.when(F.col("s").isNotNull(), F.col("n"))
    sums = pairs.agg(
        F.sum(scores).alias("n"), F.sum(F.col("s") * F.col("n")).alias("s1"), F.sum(F.col("s") * F.col("s") * F.col("n")).alias("s2"), F.expr("percentile(s, 0.5, if(s is null, 0, n))").alias("m"),
        F.sum(F.col("f") * F.col("n")).alias("f1"), F.sum(F.when(F.col("f").isNotNull(), F.col("n"))).alias("fn"),
    )
    variance = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1)
    return sums.select(
        F.round(F.col("s1") / F.col("n"), 6).alias("mean"), F.round(F.when(F.col("n") > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))), 6).alias("deviation"), F.round("m", 6).alias("median"), F.round(F.col("f1") / F.col("fn"), 6).alias("confidence")
    )


def distribution(cards: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Cards and mean valid score per value of a column, largest first (ties by value); ``top`` keeps so many of them."""
    out = cards.groupBy(column).agg(F.count(F.lit(1)).alias("cards"), F.round(F.avg(valid_score(F.col("credibility_score"))), 9).alias("avg_credibility"))
    return out.orderBy(F.desc("cards"), F.asc_nulls_last(column)).limit(top) if top else out


def stated_days(cards: DataFrame) -> DataFrame:
    """One row: first and last ISO day stated in ``date``, number of different ones, and cards that state one."""
    day = F.regexp_extract(F.coalesce("date", F.lit("")), r"^(\d{4}-\d{2}-\d{2})$", 1)
    days = cards.select(F.nullif(day, F.lit("")).alias("d"))
    return days.agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.countDistinct("d").alias("days"), F.count("d").alias("cards"))


def schema_report(cards: DataFrame, required: list[str], scores: list[str]) -> DataFrame:
    """(column, rows, filled, coverage, in_range): how complete the required columns and how valid the scores are."""
    counts = [F.count(F.lit(1)).alias("rows")] + [F.count(c).alias(f"f_{c}") for c in [*required, *scores]]
    counts += [F.count_if(valid_score(F.col(c)).isNotNull()).alias(f"v_{c}") for c in scores]
    one = cards.agg(*counts)
    parts = [
        F.struct(
            F.lit(c).alias("column"), F.col("rows"), F.col(f"f_{c}").alias("filled"),
            F.round(F.when(F.col("rows") > 0, F.col(f"f_{c}") / F.col("rows")).otherwise(0.0), 4).alias("coverage"), (F.col(f"v_{c}") if c in scores else F.col(f"f_{c}")).alias("in_range"),
        )
        for c in [*required, *scores]
    ]
    return one.select(F.inline(F.array(*parts)))


def first_delivery(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key by ``order``; rows without a key all stay. The row travels as one struct through a partial
    aggregation, so repeated deliveries are merged before the shuffle."""
    keyed = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("__r")).select("__r.*")
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def cost_rollup(costs: DataFrame, unit: str = "day") -> DataFrame:
    """Records, cost and failed amounts per period, provider and operation; repeated ids count once (their earliest record)."""
    unique = first_delivery(costs, "id", "recorded_at")
    return unique.groupBy(F.date_trunc(unit, "recorded_at").alias("period"), "provider", "operation").agg(
        F.count(F.lit(1)).alias("records"), F.round(F.sum("cost_usd"), 6).alias("cost"), F.sum("units").alias("units"), F.count_if(F.col("cost_usd") < 0).alias("negative")
    )


def running_cost(costs: DataFrame) -> DataFrame:
    """Daily cost per provider with the running total and the mean of the last seven days present."""
    daily = first_delivery(costs, "id", "recorded_at").groupBy("provider", F.date_format("recorded_at", "yyyy-MM-dd").alias("day")).agg(F.sum("cost_usd").alias("c"))
    by = Window.partitionBy("provider").orderBy("day")
    return daily.select(
        "provider", "day", F.round("c", 6).alias("cost"), F.round(F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("total"), F.round(F.avg("c").over(by.rowsBetween(-6, 0)), 6).alias("week_mean")
    )


def requests_with_counts(requests: DataFrame, cards: DataFrame, costs: DataFrame) -> DataFrame:
    """Research requests with the cards and cost that refer to them, beside the stored count; repeated ids count once."""
    found = first_delivery(cards.select("id", "request_id", "ingest_idx"), "id", "ingest_idx").where(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.count(F.lit(1)).alias("cards"))
    spent = first_delivery(costs, "id", "recorded_at").where(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.round(F.sum("cost_usd"), 6).alias("cost"))
    heads = requests.groupBy("id").agg(F.min("evidence_count").alias("stored"), F.min(F.lower("status")).alias("status"))
    joined = heads.withColumnRenamed("id", "request_id").join(found, "request_id", "left").join(spent, "request_id", "left")
    return joined.select("request_id", "status", "stored", F.coalesce("cards", F.lit(0)).alias("cards"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
