"""Structured claims, their triangulation over sources, and contradictions inside groups of cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions import dimensions, quantities, text, urls
from cardloom.functions.steps import step
from cardloom.operators.near_duplicates import components, similar_forest
from cardloom.session import cut


def structured_claims(cards: DataFrame, source: str = "claim") -> DataFrame:
    """(ingest_idx, domain, entity, metric, period, value, unit, key): the parts of each text's claim, null where it names none.

    Metric and entity are canonical names; where no known metric is named, the text with its numbers masked stands for it. The
    key joins entity, metric and period and is null where only one of them is known.
    """
    value, unit = quantities.number_with_unit(F.col("_text"))
    base = cards.select("ingest_idx", urls.domain(F.col("url")).alias("domain"), F.coalesce(F.col(source), F.lit("")).alias("_text"))
    # in steps, so that each part is computed once however often it is used
    named = step(base, ["ingest_idx", "domain", "_text"], dimensions.spaced(F.col("_text")).alias("_spaced"))
    named = step(named, ["ingest_idx", "domain", "_text"], dimensions.longest_name(F.col("_spaced"), dimensions.ENTITIES).alias("entity"), dimensions.longest_name(F.col("_spaced"), dimensions.METRICS).alias("_known"))
    told = F.struct(value.alias("value"), unit.alias("unit"))
    parts = step(named, ["ingest_idx", "domain", "entity"], F.coalesce("_known", F.nullif(text.masked_numbers(F.col("_text")), F.lit(""))).alias("metric"), quantities.period(F.col("_text")).alias("period"), told.alias("_q"))
    known = F.when(F.col("metric").isNotNull() & (F.col("entity").isNotNull() | F.col("period").isNotNull()), F.concat_ws("|", "entity", "metric", "period"))
    return parts.select("ingest_idx", "domain", "entity", "metric", "period", F.col("_q.value").alias("value"), F.col("_q.unit").alias("unit"), known.alias("key"))


def claim_support(claims: DataFrame) -> DataFrame:
    """(key, claims, domains, primaries, label): how many claims and distinct domains state each key, how many of the domains are
    primary, and whether the key is ``triangulated`` (two domains or more) or from a ``single`` one.

    Distinct (key, domain) pairs come first, so no task holds the claims of a key.
    """
    pairs = claims.where(F.col("key").isNotNull()).groupBy("key", "domain").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy("key").agg(F.sum("n").alias("claims"), F.count(F.lit(1)).alias("domains"), F.count_if(dimensions.is_primary_host(F.col("domain"))).alias("primaries"))
    return out.withColumn("label", F.when(F.col("domains") >= 2, "triangulated").otherwise("single"))


def agreement(claims: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(key, domains, low, high, agree): keys to which two domains or more give values, the extremes of these with their units'
    factors, and whether all lie within the relative tolerance. No pairs are formed: extremes decide, and merge map-side."""
    factor = F.coalesce(F.create_map(*[cell for unit, f in quantities.SCALES.items() for cell in (F.lit(unit), F.lit(f))])[F.col("unit")], F.lit(1.0))
    stated = claims.where(F.col("key").isNotNull() & F.col("value").isNotNull()).withColumn("v", F.col("value") * factor)
    sides = stated.groupBy("key", "domain").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    both = sides.groupBy("key").agg(F.count(F.lit(1)).alias("domains"), F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("domains") >= 2)
    agree = F.col("high") - F.col("low") <= tolerance * F.greatest(F.abs("high"), F.abs("low"), F.lit(1.0))
    return both.select("key", "domains", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), agree.alias("agree"))


def uncorroborated(claims: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` keys of a single domain that most deserve another source: those with a value first, then with entity and period,
    then by key. An anti-join with the triangulated keys."""
    good = claim_support(claims).where(F.col("label") == "triangulated").select("key")
    alone = claims.where(F.col("key").isNotNull()).join(good, "key", "left_anti").groupBy("key").agg(
        F.max(F.col("value").isNotNull().cast("int") + (F.col("entity").isNotNull() & F.col("period").isNotNull()).cast("int")).alias("priority")
    )
    return alone.orderBy(F.desc("priority"), "key").limit(k)


def primary_share(cards: DataFrame, key: Column) -> DataFrame:
    """One row: cards whose key is on at least two domains, those of them from primary sources, and their share."""
    rows = cards.select(key.alias("key"), urls.domain(F.col("url")).alias("domain"), F.coalesce("is_primary_source", F.lit(False)).alias("flag")).where(F.coalesce(F.col("key"), F.lit("")) != "")
    pairs = rows.groupBy("key", "domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("flag") | dimensions.is_primary_host(F.col("domain"))).alias("p"))
    good = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n"), F.sum("p").alias("p")).where(F.col("d") >= 2)
    sums = good.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cards"), F.coalesce(F.sum("p"), F.lit(0)).alias("primaries"))
    return sums.withColumn("share", F.round(F.when(F.col("cards") > 0, F.col("primaries") / F.col("cards")).otherwise(0.0), 6))


def source_kinds(cards: DataFrame) -> DataFrame:
    """Cards and domains per family of hosts, with those of primary hosts; hosts outside all families are counted as ``other``."""
    domain = urls.domain(F.col("url"))
    pairs = cards.groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(dimensions.family(F.col("domain")).isin(list(dimensions.FAMILIES)), dimensions.family(F.col("domain"))).otherwise("other")
    return pairs.groupBy(kind.alias("kind")).agg(
        F.sum("n").alias("cards"), F.count(F.lit(1)).alias("domains"), F.countDistinct(urls.registrable(F.col("domain"))).alias("registered"), F.count_if(dimensions.is_primary_host(F.col("domain"))).alias("primary_domains")
    )


def direction_conflicts(cards: DataFrame, group: str = "cluster_id", source: str = "claim") -> DataFrame:
    """(group, rising, falling): groups of cards in which some texts say that something grew and others that it shrank.

    Groups are compared without outer blanks and in lower case; cards without one are left out. No pairs are formed: a group
    disagrees if it has both sides.
    """
    rows = cards.select(F.lower(F.trim(group)).alias("group"), dimensions.direction(F.col(source)).alias("d")).where(F.coalesce(F.col("group"), F.lit("")) != "")
    sides = rows.groupBy("group").agg(F.count_if(F.col("d") > 0).alias("rising"), F.count_if(F.col("d") < 0).alias("falling"))
    return sides.where((F.col("rising") > 0) & (F.col("falling") > 0))


def paraphrase_classes(rows: DataFrame, similarity: float = 0.82, overlap: int = 3) -> DataFrame:
    """(doc_id, class_id, size): texts (doc_id, text) whose sets of words are at least that similar and share ``overlap`` words, as
    connected classes named by their smallest id, with the number of different word sets in the class.

    Equal word sets are one set from the start; texts without words form no class. The join is exact, see ``similar_forest``.
    """
    words = rows.select("doc_id", F.array_sort(F.array_distinct(text.tokens(F.col("text")))).alias("_s")).where(F.size("_s") > 0)
    named = words.withColumn("_a", F.xxhash64(F.array_join("_s", " "))).withColumn("_b", F.xxhash64(F.reverse(F.array_join("_s", " ")), F.lit(5)))
    sets = cut(named.groupBy("_a", "_b").agg(F.min("doc_id").alias("set_id"), F.first("_s").alias("_s")))
    pairs = cut(similar_forest(sets.select(F.col("set_id").alias("doc_id"), "_s"), similarity, overlap))
    groups = components(pairs).withColumnRenamed("node", "set_id")
    classes = sets.drop("_s").join(groups, "set_id", "left").withColumn("class_id", F.coalesce("component", "set_id")).select("_a", "_b", "class_id")
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"))
    return named.select("doc_id", "_a", "_b").join(classes, ["_a", "_b"]).join(sizes, "class_id").select("doc_id", "class_id", "size")
