"""Mixed timestamp formats and zones of evidence cards (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.sites import with_site
from cardloom.functions.timestamps import with_normal_form

#: Field -> zone of its times without zone information; None stands for the home zone of the site.
FIELDS = {"publication_date": None, "date": None, "collected_at": "UTC"}


def normalised_times(cards: DataFrame, profiles: DataFrame, fields: dict[str, str | None] | None = None) -> DataFrame:
    """One row (ingest_idx, field, text, normal, micros) per non-null value of ``fields``.

    ``normal`` is the unambiguous form and null where the text states no date; ``micros`` is its instant (dates: midnight
    UTC) for ordering, null for forms without a day. Null texts give no row; blank texts, impossible dates and words give
    a null ``normal``. Repeated input rows give repeated output rows. Other columns of the input, whatever their names, are
    not read. One scan, one broadcast of the profiles, no shuffle.
    """
    fields = fields or FIELDS
    sited = with_site(cards.select("ingest_idx", "source_domain", "url", *fields), profiles, ["home_zone", "date_order"])
    values = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("text"), (F.lit(zone) if zone else F.col("home_zone")).alias("zone"))
            for name, zone in fields.items()
        ]
    )
    long = sited.select("ingest_idx", "date_order", F.inline(values)).where(F.col("text").isNotNull())
    return with_normal_form(long, "text", "zone", "date_order").select("ingest_idx", "field", "text", "normal", "micros")


def changed_times(cards: DataFrame, profiles: DataFrame) -> DataFrame:
    """Values that state a date or an instant and whose text differs from the normal form; distinct rows."""
    times = normalised_times(cards, profiles)
    return times.where(F.col("normal").isNotNull() & (F.col("normal") != F.col("text"))).select("ingest_idx", "field", "normal")
