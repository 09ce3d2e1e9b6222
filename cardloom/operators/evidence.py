"""Operators on evidence cards: back-fill, validation, deduplication, ranking, caps, consensus, diversity, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import quantities, text, urls
from cardloom.functions.sites import valid_score


def _filled(*columns: Column | str) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns], F.lit(""))


def backfilled(cards: DataFrame) -> DataFrame:
    """Cards whose required texts are filled from one another: claim from title, supporting text and snippet from what there is.

    snippet is cut to 500 characters, supporting text to 5000, claim to 2000; the domain comes from the URL if missing.
    """
    return cards.withColumns(
        {
            "snippet": F.substring(_filled("snippet", "best_quote", "supporting_text", "claim", "title"), 1, 500),
            "supporting_text": F.substring(_filled("supporting_text", "snippet", "claim", "title"), 1, 5000),
            "claim": F.substring(_filled("claim", "title", "snippet"), 1, 2000),
            "source_domain": _filled("source_domain", urls.domain(F.col("url"))),
        }
    )


def with_errors(cards: DataFrame) -> DataFrame:
    """Adds ``errors``: names of the rules a card breaks, in a fixed order; empty for a valid card."""
    bad = {
        "id": ~F.coalesce(F.col("id").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False)),
        "url": ~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)),
        "title": F.coalesce(F.trim("title"), F.lit("")) == "",
        "snippet": F.coalesce(F.trim("snippet"), F.lit("")) == "",
        "provider": F.col("provider").isNull(),
        "credibility_score": valid_score(F.col("credibility_score")).isNull(),
        "relevance_score": valid_score(F.col("relevance_score")).isNull(),
        "stance_without_claim_id": (F.coalesce("stance", F.lit("neutral")) != "neutral") & F.col("claim_id").isNull(),
    }
    return cards.withColumn("errors", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in bad.items()])))


def best_per_key(cards: DataFrame, key: Column) -> DataFrame:
    """One row per key: highest valid score, then smallest ingest_idx. Merged map-side, so keys of any size are fine."""
    order = F.struct(F.coalesce(valid_score(F.col("credibility_score")), F.lit(-1.0)).alias("s"), (-F.col("ingest_idx")).alias("i"))
    keyed = cards.withColumn("_key", key).where(F.col("_key").isNotNull())
    return keyed.groupBy("_key").agg(F.max(order).alias("_o"), F.count(F.lit(1)).alias("copies")).select(F.col("_key").alias("key"), (-F.col("_o.i")).alias("ingest_idx"), "copies")


def first_per_work(cards: DataFrame) -> DataFrame:
    """The first card of each work by canonical id, with the number of its cards."""
    key = urls.canonical_id(F.col("doi"), F.col("url"))
    return cards.select(key.alias("work"), "ingest_idx").groupBy("work").agg(F.min("ingest_idx").alias("ingest_idx"), F.count(F.lit(1)).alias("cards"))


def syndicated(cards: DataFrame) -> DataFrame:
    """Texts (by hash of the normalised snippet) that appear on more than one domain, with cards and domains.

    Blank snippets do not count. Counted over distinct (hash, domain), so a text copied everywhere is no burden.
    """
    body = text.normalised_claim(F.col("snippet"))
    rows = cards.where(body != "").select(F.substring(F.sha2(body, 256), 1, 16).alias("hash"), urls.domain(F.col("url")).alias("domain"))
    pairs = rows.groupBy("hash", "domain").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("hash").agg(F.sum("n").alias("cards"), F.count(F.lit(1)).alias("domains")).where(F.col("domains") > 1)


def ranked(cards: DataFrame) -> DataFrame:
    """(ingest_idx, score): 0.6 relevance and 0.3 credibility plus a recency share of 0.05, 5 % more for primary sources, kept within 0..1.

    Missing or invalid scores count as 0.5.
    """
    base = 0.6 * F.coalesce(valid_score(F.col("relevance_score")), F.lit(0.5)) + 0.3 * F.coalesce(valid_score(F.col("credibility_score")), F.lit(0.5)) + 0.05
    boosted = F.when(F.coalesce("is_primary_source", F.lit(False)), base * 1.05).otherwise(base)
    return cards.select("ingest_idx", F.round(F.least(F.lit(1.0), boosted), 6).alias("score"))


def top_per_group(cards: DataFrame, group: str, k: int) -> DataFrame:
    """The ``k`` cards of each group with the highest valid score, ties by ingest_idx; a null group is one of its own.

    Each task first keeps its own best ``k`` of a group (rank limit pushed below the shuffle by the window-group limit).
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last("s"), "ingest_idx"))
    return cards.select(group, "ingest_idx", valid_score(F.col("credibility_score")).alias("s")).withColumn("rank", rank).where(F.col("rank") <= k).select(group, "ingest_idx", "rank")


def provider_diversity(cards: DataFrame) -> DataFrame:
    """One row: providers, Shannon entropy in bits and in nats, entropy relative to the largest possible, largest share."""
    counts = cards.where(F.col("provider").isNotNull()).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))
    logs = counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("l"), F.count(F.lit(1)).alias("k"), F.max("n").alias("m"))
    bits = F.log2(F.col("t").cast("double")) - F.col("l") / F.col("t")
    return logs.where(F.col("k") > 0).select(
        F.col("k").alias("providers"), F.round(bits, 6).alias("bits"), F.round(bits * 0.6931471805599453, 6).alias("nats"),
        F.round(F.when(F.col("k") > 1, bits / F.log2(F.col("k").cast("double"))).otherwise(0.0), 6).alias("evenness"), F.round(F.col("m") / F.col("t"), 6).alias("top_share"),
    )


def numeric_claims(cards: DataFrame, source: str = "claim") -> DataFrame:
    """(ingest_idx, domain, metric, unit, period, value): the first quantity of each text that names a number and a period.

    The metric is the text with numbers masked, so the same statement with another value has the same key.
    """
    value, unit = quantities.number_with_unit(F.col(source))
    out = cards.select("ingest_idx", urls.domain(F.col("url")).alias("domain"), text.masked_numbers(F.col(source)).alias("metric"), F.coalesce(unit, F.lit("")).alias("unit"), quantities.period(F.col(source)).alias("period"), value.alias("value"))
    return out.where(F.col("value").isNotNull() & F.col("period").isNotNull())


def consensus(claims: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """Per (metric, unit, period) with at least two values: exact median, supporting and dissenting values, sources, verdict.

    A value supports the median within the relative tolerance. Values are first counted per distinct value, so repeated
    ones cost one row; triangulated means at least two supporting values on two domains that are half of all.
    """
    keys = ["metric", "unit", "period"]
    values = claims.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    middle = values.groupBy(*keys).agg(F.expr("percentile(value, 0.5, n)").alias("median"), F.sum("n").alias("values")).where(F.col("values") >= 2)
    judged = values.join(middle, keys).withColumn("ok", F.abs(F.col("value") - F.col("median")) <= tolerance * F.greatest(F.abs("median"), F.lit(1e-9)))
    votes = judged.groupBy(*keys).agg(F.first("median").alias("median"), F.sum("n").alias("values"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("support"), F.min("value").alias("low"), F.max("value").alias("high"))
    domains = claims.groupBy(*keys, "domain").agg(F.lit(1)).groupBy(*keys).agg(F.count(F.lit(1)).alias("domains"))
    out = votes.join(domains, keys)
    return out.select(
        *keys, F.round("median", 6).alias("median"), "values", "support", (F.col("values") - F.col("support")).alias("dissent"), "domains",
        ((F.col("support") >= 2) & (F.col("domains") >= 2) & (F.col("support") * 2 >= F.col("values"))).alias("triangulated"), (F.col("high") - F.col("low") > 0.1 * F.greatest(F.abs("high"), F.abs("low"), F.lit(1.0))).alias("conflict"),
    )


def text_statistics(cards: DataFrame, source: str = "supporting_text") -> DataFrame:
    """(ingest_idx, characters, words, sentences, distinct_words, language): text measures; null texts count as empty."""
    words = text.tokens(F.col(source))
    body = F.coalesce(F.col(source), F.lit(""))
    return cards.select(
        "ingest_idx", F.length(body).alias("characters"), F.size(words).alias("words"), F.regexp_count(body, F.lit(r"[.!?]+")).alias("sentences"), F.size(F.array_distinct(words)).alias("distinct_words"), text.language_guess(F.col(source)).alias("language")
    )


def phrases(cards: DataFrame, source: str = "claim", k: int = 20) -> DataFrame:
    """The ``k`` most frequent pairs of neighbouring words without stop words inside a text, with texts that hold them."""
    words = cards.select("ingest_idx", text.without_stop_words(F.filter(text.tokens(F.col(source)), lambda w: ~w.rlike("^[0-9]+$"))).alias("w")).where(F.size("w") >= 2)
    pairs = words.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1))))).alias("phrase"))
    return pairs.groupBy("phrase").agg(F.count(F.lit(1)).alias("texts")).orderBy(F.desc("texts"), "phrase").limit(k)


def without_banned(cards: DataFrame, banned: DataFrame) -> DataFrame:
    """Cards whose domain is not in ``banned.domain``; cards without a domain are dropped, as they cannot be checked."""
    at = F.lower(F.trim("source_domain"))
    return cards.withColumn("_d", at).where(F.col("_d").isNotNull() & (F.col("_d") != "")).join(banned.select(F.col("domain").alias("_d")).distinct(), "_d", "left_anti").drop("_d")


def triangulated_union(cards: DataFrame) -> DataFrame:
    """One row: cards that share a claim or a cluster with another domain, all cards, and the share.

    Distinct (key, domain) pairs decide which keys count; the cards then meet these keys in a semi-join.
    """
    domain = urls.domain(F.col("url"))
    keys = F.array(F.struct(F.lit("claim").alias("kind"), text.normalised_claim(F.col("claim")).alias("key")), F.struct(F.lit("cluster").alias("kind"), F.lower(F.trim("cluster_id")).alias("key")))
    rows = cards.select("ingest_idx", domain.alias("domain"), F.inline(keys)).where(F.coalesce(F.col("key"), F.lit("")) != "")
    good = rows.groupBy("kind", "key", "domain").agg(F.lit(1)).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= 2)
    covered = rows.join(good, ["kind", "key"], "left_semi").groupBy("ingest_idx").agg(F.lit(1)).agg(F.count(F.lit(1)).alias("triangulated"))
    total = cards.agg(F.count(F.lit(1)).alias("cards"))
    both = covered.withColumn("cards", F.lit(0)).unionByName(total.withColumn("triangulated", F.lit(0))).agg(F.sum("triangulated").alias("triangulated"), F.sum("cards").alias("cards"))
    return both.withColumn("rate", F.round(F.when(F.col("cards") > 0, F.col("triangulated") / F.col("cards")).otherwise(0.0), 6))


def triangulation_by(cards: DataFrame, column: str) -> DataFrame:
    """(column, cards, triangulated, rate): per value of a column its cards, and those whose claim another domain states too.

    Claims are counted over distinct (claim, domain) pairs first; cards without a claim count as not triangulated.
    """
    rows = cards.select(column, text.normalised_claim(F.col("claim")).alias("key"), urls.domain(F.col("url")).alias("domain"))
    counts = rows.groupBy(column, "key", "domain").agg(F.count(F.lit(1)).alias("n"))
    good = counts.where(F.col("key") != "").groupBy("key", "domain").agg(F.lit(1)).groupBy("key").agg((F.count(F.lit(1)) >= 2).alias("good"))
    sums = counts.join(good, "key", "left").groupBy(column).agg(F.sum("n").alias("cards"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("triangulated"))
    return sums.withColumn("rate", F.round(F.col("triangulated") / F.col("cards"), 6))


def hashed_sample(rows: DataFrame, key: str, k: int, seed: str = "") -> DataFrame:
    """``k`` distinct values of ``key``, chosen by a hash of value and seed: the same for any order and partitioning of the rows."""
    mark = F.md5(F.concat(F.lit(seed), F.col(key)))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1)).select(key, mark.alias("mark")).orderBy("mark", key).limit(k)


def last_per_key(cards: DataFrame, key: str) -> DataFrame:
    """(key, ingest_idx, first): per key its last row, in the place of its first one; rows without a key are left out."""
    return cards.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("ingest_idx").alias("ingest_idx"), F.min("ingest_idx").alias("first"))


def quote_coverage(cards: DataFrame, by: str = "provider") -> DataFrame:
    """Cards and the share of them with a quote that says something, per value of a column."""
    quoted = F.count_if(F.coalesce(F.trim("best_quote"), F.lit("")) != "")
    return cards.groupBy(by).agg(F.count(F.lit(1)).alias("cards"), F.round(quoted / F.count(F.lit(1)), 6).alias("quoted"))


def claim_sentences(cards: DataFrame, source: str = "supporting_text", k: int = 2) -> DataFrame:
    """(ingest_idx, position, sentence): up to ``k`` sentences per text that hold a number, those with a year first, then by position.

    Works on one text at a time with array functions, so nothing is shuffled. Null and empty texts give nothing.
    """
    pieces = F.split(F.coalesce(source, F.lit("")), r"[.!?]\s+|\n+")
    numbered = F.transform(pieces, lambda s, i: F.struct(F.when(s.rlike(r"\b(19|20)\d{2}\b"), 0).otherwise(1).alias("rank"), i.alias("position"), F.trim(s).alias("sentence")))
    best = F.slice(F.array_sort(F.filter(numbered, lambda x: x["sentence"].rlike("[0-9]"))), 1, k)
    return cards.select("ingest_idx", F.inline(best)).select("ingest_idx", "position", "sentence")


def tone(cards: DataFrame, source: str = "supporting_text") -> DataFrame:
    """(ingest_idx, positive, negative): shares of words of a positive and of a negative tone; 0 for texts without words."""
    words = text.tokens(F.col(source))
    share = lambda own: F.round(F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: w.isin(own))) / F.size(words)), 6)
    return cards.select("ingest_idx", share(text.POSITIVE).alias("positive"), share(text.NEGATIVE).alias("negative"))


def stances(cards: DataFrame) -> DataFrame:
    """Per claim id: cards per stance, domains, and the share of disputing cards; cards without a claim id are left out."""
    rows = cards.where(F.col("claim_id").isNotNull())
    counts = rows.groupBy("claim_id").agg(*[F.count_if(F.col("stance") == s).alias(s) for s in ("supports", "disputes", "neutral")], F.count(F.lit(1)).alias("cards"))
    return counts.withColumn("disputed", F.round(F.col("disputes") / F.col("cards"), 6))


def stance_totals(cards: DataFrame) -> DataFrame:
    """Cards and distinct domains per discipline and stance, over distinct pairs so that no task holds a discipline's domains."""
    pairs = cards.groupBy("discipline", "stance", urls.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("discipline", "stance").agg(F.sum("n").alias("cards"), F.count(F.lit(1)).alias("domains"))


def numeric_disagreements(claims: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(metric, unit, period, low, high, domains): keys for which two domains state values that disagree, without forming pairs.

    The widest gap between two domains has the smallest value of all or the largest of all at one end, so it suffices to set
    each of these two against the extremes of the other domains. Values disagree beyond the relative tolerance.
    """
    keys = ["metric", "unit", "period"]
    sides = claims.groupBy(*keys, "domain").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    ends = sides.groupBy(*keys).agg(F.min(F.struct("lo", "domain")).alias("a"), F.max(F.struct("hi", "domain")).alias("b"), F.count(F.lit(1)).alias("domains")).where(F.col("domains") > 1)
    joined = sides.join(ends, keys).groupBy(*keys).agg(
        F.first("a.lo").alias("lo"), F.first("b.hi").alias("hi"), F.first("domains").alias("domains"),
        F.max(F.when(F.col("domain") != F.col("a.domain"), F.col("hi"))).alias("other_hi"), F.min(F.when(F.col("domain") != F.col("b.domain"), F.col("lo"))).alias("other_lo"),
    )
    apart = lambda low, high: F.col(high) - F.col(low) > tolerance * F.greatest(F.abs(high), F.abs(low), F.lit(1.0))
    first = apart("lo", "other_hi")
    return joined.where(first | apart("other_lo", "hi")).select(
        *keys, F.when(first, F.col("lo")).otherwise(F.col("other_lo")).alias("low"), F.when(first, F.col("other_hi")).otherwise(F.col("hi")).alias("high"), "domains"
    )
