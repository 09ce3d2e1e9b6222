"""Evidence cards and their companions in files: JSON lines, rankings in CSV, web archives, Parquet exports."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions import urls
from cardloom.operators.evidence import backfilled, with_errors

_STRINGS = (
    "id request_id subtopic_name claim supporting_text url title snippet best_quote provider search_provider source_domain author doi date publication_date collected_at stance claim_id cluster_id discipline topic"
).split()
CARD_SCHEMA = T.StructType(
    [T.StructField("ingest_idx", T.LongType()), *[T.StructField(c, T.StringType()) for c in _STRINGS]]
    + [T.StructField(c, T.DoubleType()) for c in ("credibility_score", "relevance_score", "confidence")]
    + [T.StructField("is_primary_source", T.BooleanType()), T.StructField("_corrupt", T.StringType())]
)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards from JSON lines under a fixed schema. Fields that the schema lacks are dropped, missing ones are null; lines that
    are no JSON keep their text in ``_corrupt`` and nulls elsewhere."""
    return spark.read.schema(CARD_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_cards(cards: DataFrame, path: str, errors_path: str, strict: tuple[str, ...] = ("id", "url", "title", "snippet")) -> None:
    """Repairs and validates cards, writes valid ones as JSON lines to ``path`` and the rest as (id, url, errors) to ``errors_path``.

    Only the rules named in ``strict`` send a card to the errors. Both outputs come from one set of expressions.
    """
    checked = with_errors(backfilled(cards)).withColumn("_bad", F.size(F.array_intersect("errors", F.array(*[F.lit(r) for r in strict]))) > 0)
    checked.where(~F.col("_bad")).drop("errors", "_bad", "_corrupt").write.mode("overwrite").json(path)
    checked.where("_bad").select("id", "url", "errors").write.mode("overwrite").json(errors_path)


def export_parquet(cards: DataFrame, path: str) -> None:
    """Cards as snappy-compressed Parquet."""
    cards.write.mode("overwrite").option("compression", "snappy").parquet(path)


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    """(rank, domain) from a CSV without header; malformed rows are skipped, domains are in lower case."""
    rows = spark.read.schema("rank int, domain string").option("mode", "DROPMALFORMED").csv(path)
    return rows.where(F.col("rank").isNotNull() & F.col("domain").isNotNull()).withColumn("domain", F.lower(F.trim("domain")))


def cards_from_hits(hits: DataFrame, provider: str) -> DataFrame:
    """Search hits (title, url, snippet, published_at) of any provider as cards with the defaults of a fresh hit.

    Hits without a URL are dropped; the claim is the title, the supporting text the snippet.
    """
    text = F.coalesce("snippet", F.lit(""))
    return hits.where(F.coalesce(F.trim("url"), F.lit("")) != "").select(
        F.sha1("url").alias("id"), "url", F.coalesce("title", F.lit("")).alias("title"), F.substring(text, 1, 500).alias("snippet"), F.coalesce("title", F.lit("")).alias("claim"), F.substring(text, 1, 5000).alias("supporting_text"),
        F.lit(provider).alias("provider"), F.col("published_at").alias("publication_date"), F.lit(0.7).alias("credibility_score"), F.lit(0.7).alias("relevance_score"), F.lit(0.5).alias("confidence"), F.lit(False).alias("is_primary_source"),
    )


# Where the answers of public search services hold what a card needs: (path of the list of hits, fields by path).
PROVIDERS = {
    "openalex": ("$.results", {"url": "$.id", "title": "$.title", "doi": "$.doi", "publication_date": "$.publication_date", "source_domain": "$.primary_location.source.display_name"}),
    "crossref": ("$.message.items", {"url": "$.URL", "title": "$.title[0]", "snippet": "$.abstract", "doi": "$.DOI", "publication_date": "$.created.date-time", "author": "$.author[0].family"}),
    "europepmc": ("$.resultList.result", {"url": "$.id", "title": "$.title", "snippet": "$.abstractText", "doi": "$.doi", "publication_date": "$.firstPublicationDate", "author": "$.authorString"}),
    "wikipedia": ("$.query.search", {"url": "$.pageid", "title": "$.title", "snippet": "$.snippet", "publication_date": "$.timestamp"}),
    "gdelt": ("$.articles", {"url": "$.url", "title": "$.title", "source_domain": "$.domain", "publication_date": "$.seendate"}),
    "brave": ("$.web.results", {"url": "$.url", "title": "$.title", "snippet": "$.description", "publication_date": "$.page_age"}),
    "tavily": ("$.results", {"url": "$.url", "title": "$.title", "snippet": "$.content", "publication_date": "$.published_date"}),
    "serper": ("$.organic", {"url": "$.link", "title": "$.title", "snippet": "$.snippet", "publication_date": "$.date"}),
    "serpapi": ("$.organic_results", {"url": "$.link", "title": "$.title", "snippet": "$.snippet", "publication_date": "$.date"}),
    "semantic_scholar": ("$.data", {"url": "$.url", "title": "$.title", "snippet": "$.abstract", "doi": "$.externalIds.DOI", "publication_date": "$.publicationDate"}),
    "core": ("$.results", {"url": "$.downloadUrl", "title": "$.title", "snippet": "$.abstract", "doi": "$.doi", "publication_date": "$.publishedDate"}),
    "fred": ("$.seriess", {"url": "$.id", "title": "$.title", "snippet": "$.notes", "publication_date": "$.last_updated"}),
    "worldbank": ("$[1]", {"url": "$.id", "title": "$.name", "snippet": "$.sourceNote"}),
}
# Addresses of records of which an answer gives only a number.
PAGES = {"wikipedia": "https://en.wikipedia.org/?curid=", "europepmc": "https://europepmc.org/article/MED/", "fred": "https://fred.stlouisfed.org/series/", "worldbank": "https://data.worldbank.org/indicator/"}


def cards_from_answers(answers: DataFrame) -> DataFrame:
    """Cards from raw answers (provider, body as JSON text) of the services in ``PROVIDERS``.

    One row per hit with an address; hits are read by path, so fields that an answer lacks are null. Tags are taken out of
    titles and snippets. Answers of unknown providers, and bodies that are no JSON, give nothing.
    """
    parts = []
    for provider, (items, fields) in PROVIDERS.items():
        hits = answers.where(F.col("provider") == provider).select(F.explode(F.from_json(F.get_json_object("body", items), "array<string>")).alias("hit"))
        own = {name: F.get_json_object("hit", path) for name, path in fields.items()}
        if provider in PAGES:
            own["url"] = F.concat(F.lit(PAGES[provider]), own["url"])
        columns = [own.get(c, F.lit(None).cast("string")).alias(c) for c in ("url", "title", "snippet", "doi", "author", "source_domain", "publication_date")]
        parts.append(hits.select(F.lit(provider).alias("provider"), *columns))
    every = reduce(DataFrame.unionByName, parts).where(F.coalesce(F.trim("url"), F.lit("")) != "")
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", "")
    return every.withColumns({"title": plain("title"), "snippet": plain("snippet"), "source_domain": F.coalesce("source_domain", urls.domain(F.col("url"))), "id": F.sha1("url")}).withColumn("claim", F.col("title"))


def upserted(existing: DataFrame, updates: DataFrame, key: str = "id", order: str = "ingest_idx") -> DataFrame:
    """``existing`` with the rows of ``updates`` in place of those with the same key; of repeated updates the last by ``order``
    wins. Rows without a key are kept as they are, and appended."""
    keyed = updates.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*updates.columns), F.col(order)).alias("__r")).select("__r.*")
    kept = existing.join(keyed.select(key), key, "left_anti").select(existing.columns)
    return kept.unionByName(keyed, allowMissingColumns=True).unionByName(updates.where(F.col(key).isNull()), allowMissingColumns=True)


def replace_output(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes ``df`` beside ``path`` and then puts it in its place by renaming, so that readers see the old files or the new ones,
    and a failed write leaves the old ones alone. ``df`` may read from ``path``."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.mode("overwrite").format(kind).save(fresh)
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(old))
    fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), target)
    fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def unexpired(entries: DataFrame, now: Column) -> DataFrame:
    """Cache entries whose ``expires_at`` lies after ``now``; those without one never expire."""
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def warc_records(content: bytes) -> Iterator[tuple[str, str, str, str, bytes]]:
    """(type, target URI, date, content type, payload) of the records of a web archive, compressed or not; a broken record ends it.

    Compressed archives are read member by member, so only one record is unpacked at a time.
    """
    if content[:2] == b"\x1f\x8b":
        for member in _members(content):
            yield from warc_records(member)
        return
    at = 0
    while (start := content.find(b"WARC/", at)) >= 0:
        head_end = content.find(b"\r\n\r\n", start)
        if head_end < 0:
            return
        fields = dict(line.split(": ", 1) for line in content[start:head_end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        fields = {k.lower(): v for k, v in fields.items()}
        length = fields.get("content-length", "")
        if not length.strip().isdigit():
            return
        body = content[head_end + 4 : head_end + 4 + int(length)]
        yield fields.get("warc-type", ""), fields.get("warc-target-uri", ""), fields.get("warc-date", ""), fields.get("content-type", ""), body
        at = head_end + 4 + int(length)


def _members(content: bytes) -> Iterator[bytes]:
    while content:
        unpack = zlib.decompressobj(31)
        try:
            yield unpack.decompress(content)
        except zlib.error:
            return
        content = unpack.unused_data


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, url, date, content_type, payload) of the records of web archives; one file is one unit of work."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                for record in warc_records(content):  # one record at a time, as archives are large
                    yield pd.DataFrame([(p, *record)], columns=["path", "kind", "url", "date", "content_type", "payload"])

    schema = "path string, kind string, url string, date string, content_type string, payload binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)
