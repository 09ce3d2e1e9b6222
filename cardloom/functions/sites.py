"""Host and site names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.session import bounded


def host_of(text: Column) -> Column:
    """Lower-case host of a URL or of a loosely written domain.

    Drops scheme, user, port, path, query, a final dot and a leading ``www.``. Null and blank give null.
    """
    bare = F.lower(F.trim(F.regexp_replace(text, r"[\s ]+", " ")))
    host = F.regexp_replace(bare, r"^(?:[a-z][a-z0-9+.-]*:)?//|^[^/?#]*@", "")
    host = F.regexp_replace(host, r"[/?#].*$", "")
    host = F.regexp_replace(host, r"^[^@]*@", "")
    host = F.regexp_replace(host, r"(?::\d*)?\.*$", "")
    host = F.regexp_replace(host, r"\.+(?::\d*)?$", "")
    host = F.regexp_replace(host, r"^www\d?\.", "")
    return F.nullif(F.trim(host), F.lit(""))


def with_site(cards: DataFrame, profiles: DataFrame, keep: list[str], max_profiles: int = 50_000) -> DataFrame:
    """Adds ``keep`` columns of the source profile that a card belongs to.

    The site is the profile that ``source_domain`` names, however spelled, or the host of ``url`` when source_domain is
    null or blank. A host that is no profile itself falls back to its parent (``m.x`` to ``x``) if that one is. Cards of
    unknown sites keep nulls; profiles are joined by broadcast only after a size check. Profiles with equal site names
    count once (the smallest by their other columns).
    """
    key = "__site_key"
    fields = [c for c in dict.fromkeys(["site", *keep])]
    known = (
        profiles.select(host_of(F.col("site")).alias(key), F.struct(*[F.col(c) for c in fields]).alias("__p"))
        .where(F.col(key).isNotNull()).groupBy(key).agg(F.min("__p").alias("__p"))
    )
    known = bounded(known, max_profiles)  # the hint stays with the parents' copy below
    parent = known.select(F.col(key).alias("__parent_key"), F.col("__p").alias("__parent"))
    named = F.coalesce(host_of(F.col("source_domain")), host_of(F.col("url")))
    out = (
        cards.drop(*fields).withColumn(key, named)
        .withColumn("__parent_key", F.regexp_replace(F.col(key), r"^[^.]+\.", ""))
        .join(known, key, "left")
        .join(parent, "__parent_key", "left")
    )
    chosen = F.coalesce(F.col("__p"), F.col("__parent"))
    return out.select(*[c for c in cards.columns if c not in fields], *[chosen[c].alias(c) for c in fields])


def valid_score(score: Column) -> Column:
    """The score if it is a number within 0..1, else null (NaN and out-of-range values give null)."""
    value = score.cast("double")
    return F.when(~F.isnan(value) & (value >= 0) & (value <= 1), value)
