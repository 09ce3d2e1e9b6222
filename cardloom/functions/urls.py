"""URL and identifier normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track or name a session.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "referer", "referrer",
    "sessionid", "sid", "ssid", "s", "source", "versionid", "v", "t", "timestamp",
]
# Mirror hosts and the hosts they stand for.
MIRRORS = {
    "sgp.fas.org": "www.congress.gov", "www.everycrsreport.com": "www.congress.gov", "papers.ssrn.com": "ssrn.com",
    "dx.doi.org": "doi.org", "europepmc.org": "pubmed.ncbi.nlm.nih.gov",
}
# Public suffixes of two parts under which names are registered.
TWO_PART = [f"{kind}.{land}" for land in ("uk", "au", "nz", "jp", "za", "br", "in", "kr") for kind in ("ac", "co", "com", "edu", "gov", "net", "org")]
_DOI = r"(10\.\d{4,9}/[^\s?#&\"<>]+)"


def host(url: Column) -> Column:
    """Host and port as written; empty without a scheme."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def domain(url: Column, missing: str = "unknown") -> Column:
    """Lower-case host without port and leading ``www.``; ``missing`` if there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(host(url)), r":\d+$", ""), r"^www\.", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(missing))


def _without(url: Column, drop) -> Column:
    """The URL without fragment and without those query parameters whose lower-case name ``drop`` accepts, the rest sorted."""
    plain = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~drop(F.lower(F.substring_index(p, "=", 1)))))
    base = F.regexp_replace(plain, r"\?.*$", "")
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def canonical_url(url: Column) -> Column:
    """Without tracking parameters and fragment, remaining parameters sorted, no slash at the end of a path. Null gives ''.

    The path is cut before the parameters are put back; the slash that stands for the whole path of a host stays.
    """
    clean = _without(F.coalesce(url, F.lit("")), lambda name: name.isin(TRACKING))
    place, query = F.regexp_replace(clean, r"\?.*$", ""), F.regexp_extract(clean, r"(\?.*)$", 1)
    return F.concat(F.regexp_replace(place, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*/.*?)/+$", "$1"), query)


def url_without_campaign(url: Column) -> Column:
    """Scheme and host in lower case, without ``utm_*`` parameters and fragment, order kept."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    kept = F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))
    head = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = F.regexp_extract(plain, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?]*)", 1)
    return F.concat(head, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def doi_in(text: Column) -> Column:
    """The first DOI in a text, lower case, without a final dot; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), _DOI, 1)), r"[.,;]+$", ""), F.lit(""))


# Registries whose URLs carry a number of their own: (prefix, hosts, pattern of the number).
REGISTRIES = [
    ("crs", ["congress.gov", "everycrsreport.com", "fas.org"], r"\b(R[LS]?\d{5}|IF\d{5}|IN\d{5})\b"), ("arxiv", ["arxiv.org"], r"(\d{4}\.\d{4,5})"), ("pmid", ["pubmed.ncbi.nlm.nih.gov"], r"/(\d{7,8})(?:\D|$)"),
]


def registry_id(url: Column) -> Column:
    """``prefix:number`` of the first registry of ``REGISTRIES`` on whose host, or a host below it, the URL lies."""
    at = F.regexp_replace(F.lower(host(url)), r":\d+$", "")
    own = []
    for prefix, hosts, pattern in REGISTRIES:
        inside = F.lit(False)
        for name in hosts:
            inside = inside | (at == name) | at.endswith("." + name)
        number = F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
        own.append(F.when(inside, F.concat(F.lit(prefix + ":"), F.upper(number) if prefix == "crs" else number)))
    return F.coalesce(*own)


def canonical_id(doi: Column, url: Column) -> Column:
    """Identifier of a work: DOI field, DOI or registry number in the URL, else host and path.

    Mirror hosts count as the host they stand for; final slashes and ``.pdf`` do not count.
    """
    url = F.coalesce(url, F.lit(""))
    at = F.lower(host(url))
    mirrors = F.create_map(*[F.lit(name) for pair in MIRRORS.items() for name in pair])
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"(?:/+|\.pdf)*$", "")
    place = F.lower(F.concat(F.lit("url:"), F.coalesce(mirrors[at], at), path))
    return F.coalesce(F.concat(F.lit("doi:"), F.coalesce(doi_in(doi), doi_in(url))), registry_id(url), place)


def registrable(name: Column) -> Column:
    """The part of a host that can be registered: its last two labels, or three under a two-part public suffix."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"^www\.|\.$", "")
    short = F.substring_index(bare, ".", -2)
    return F.when(short.isin(TWO_PART), F.substring_index(bare, ".", -3)).otherwise(short)
