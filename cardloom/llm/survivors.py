"""Best representative of each duplicate group by field-by-field survivorship (problem 6).

One aggregation per group takes, for the record and for each field, the maximum of a composite struct (says something,
primary source, valid score, instant, smaller row number), which merges map-side: a group of any size costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.sites import valid_score, with_site
from cardloom.functions.timestamps import with_normal_form

# Texts that mark an absent author or DOI, lower case, without outer blanks.
ABSENT = [
    "", "-", "--", "—", "–", "?", ".", "n/a", "n.a.", "n.a", "na", "#n/a", "nan", "none", "null", "nil", "unknown", "unknown author", "author unknown",
    "anonymous author unknown", "undefined", "no author", "no doi", "not available", "not applicable", "not given", "not stated", "missing",
    "unbekannt", "autor unbekannt", "unbekannter autor", "keine angabe", "k.a.", "k. a.", "inconnu", "auteur inconnu", "non disponible", "non renseigné",
    "desconocido", "autor desconocido", "no disponible", "s/n", "tba", "tbd", "n.n.", "nn",
]


def says_something(text: Column) -> Column:
    """False for null, blanks and markers of absence."""
    bare = F.lower(F.trim(F.regexp_replace(text, r"[\s ]+", " ")))
    return F.coalesce(~bare.isin(ABSENT), F.lit(False))


def survivors(records: DataFrame, group: str, order: list[Column], fields: dict[str, Column]) -> DataFrame:
    """(group, field, ingest_idx): ``field`` = ``record`` gives a group's best row, each other field its best row that says something.

    ``order`` are non-null expressions, larger first; ties go to the smaller ingest_idx. Groups with a null key and those
    with fewer than two distinct ids give nothing; a field that no row fills gives no row.
    """
    rank = [*[c.alias(f"_o{i}") for i, c in enumerate(order)], (-F.col("ingest_idx")).alias("_row")]
    best = lambda says: F.max(F.when(says, F.struct(*rank)))
    picks = {"record": best(F.lit(True))} | {name: best(says) for name, says in fields.items()}
    grouped = (
        records.where(F.col(group).isNotNull()).groupBy(group)
        .agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"), *[pick.alias(f"_pick_{name}") for name, pick in picks.items()])
        .where(F.col("_lo") != F.col("_hi"))
    )
    out = F.array(*[F.struct(F.lit(name).alias("field"), (-F.col(f"_pick_{name}._row")).alias("ingest_idx")) for name in picks])
    return grouped.select(group, F.inline(out)).where(F.col("ingest_idx").isNotNull())


def card_survivors(cards: DataFrame, profiles: DataFrame) -> DataFrame:
    """(cluster_id, field, ingest_idx) for evidence cards: record, author, doi and publication_date of each cluster.

    cluster_id is compared without outer blanks and in lower case; a blank one is none. Rows are ordered by primary source
    (null counts as false), valid score (none last), collected_at as an instant (none last), smaller ingest_idx.
    """
    cluster = F.nullif(F.lower(F.regexp_replace(F.col("cluster_id"), r"^[\s ]+|[\s ]+$", "")), F.lit(""))
    rows = (
        cards.select("ingest_idx", "id", cluster.alias("cluster_id"), "is_primary_source", "credibility_score", "source_domain", "url", "author", "doi", "publication_date", "collected_at")
        .where(F.col("cluster_id").isNotNull())
    )
    rows = with_site(rows, profiles, ["home_zone", "date_order"])
    rows = rows.withColumns({"author": says_something(F.col("author")), "doi": says_something(F.col("doi")), "_utc": F.lit("UTC"), "_stated": F.col("publication_date")})
    rows = with_normal_form(rows, "collected_at", "_utc", "date_order").withColumnRenamed("micros", "_collected").drop("collected_at")
    rows = with_normal_form(rows, "_stated", "home_zone", "date_order").withColumnRenamed("normal", "_published")
    order = [
        F.coalesce(F.col("is_primary_source"), F.lit(False)).cast("int"),
        F.coalesce(valid_score(F.col("credibility_score")), F.lit(-1.0)),
        F.coalesce(F.col("_collected"), F.lit(-(2**62))),
    ]
    return survivors(rows, "cluster_id", order, {"author": F.col("author"), "doi": F.col("doi"), "publication_date": F.col("_published").isNotNull()})
