"""Dimension tables: names of metrics and entities, primary sources and domain families, words of direction.

Tables are text, one canonical name per line; lookups are column expressions over them, so that no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _table(text: str) -> dict[str, str]:
    """Alias -> canonical name, from lines ``canonical: alias | alias``; the longest aliases come first, then by name."""
    pairs = {}
    for line in text.strip().splitlines():
        name, aliases = line.strip().split(":", 1)
        pairs |= {a.strip(): name for a in aliases.split("|") if a.strip()}
    return dict(sorted(pairs.items(), key=lambda p: (-len(p[0]), p[0])))


# Canonical metric names and how texts call them.
METRICS = _table(
    """
    international_tourist_arrivals: arrivals | tourist arrivals | international arrivals | visitor arrivals | visitor inflows | international tourists | international visitor arrivals | tourist inflows
    hotel_occupancy_rate: hotel occupancy | occupancy rate | occupancy | room occupancy | hotel room occupancy | accommodation occupancy
    gdp_contribution_travel: tourism gdp | travel gdp | gdp contribution of tourism | tourism contribution to gdp | travel & tourism gdp | t&t gdp | tourism's gdp contribution
    air_passenger_traffic: air passengers | passenger traffic | rpk | pax | revenue passenger kilometers | passenger numbers | airline passengers | air travel demand
    tourism_receipts: tourism receipts | visitor spending | tourist spending | international receipts | tourism revenues | visitor receipts | tourism earnings | travel receipts
    tourism_employment: tourism jobs | travel jobs | tourism employment | travel & tourism employment | t&t jobs | sector employment
    gdp_growth: gdp growth | economic growth | gdp increase | gdp expansion
    inflation_rate: inflation | cpi | consumer price index | price inflation
    unemployment_rate: unemployment | jobless rate | unemployment level
    monthly_active_users: mau | monthly active users | monthly users | active users
    conversion_rate: conversion | conversion rate | cvr | conversion percentage
    co2_emissions: co2 | carbon emissions | greenhouse gas emissions | ghg emissions
    temperature_rise: temperature increase | warming | temperature rise | global warming
    """
)
# Canonical entity names and how texts call them.
ENTITIES = _table(
    """
    united states: united states | usa | u.s. | u.s | us | united states of america | america | the united states
    united kingdom: united kingdom | u.k. | uk | great britain | britain | england | the uk
    south korea: south korea | republic of korea | r.o.k | rok | korea, republic of | s. korea
    north korea: north korea | democratic people's republic of korea | dprk | n. korea
    uae: uae | united arab emirates | the uae | emirates
    china: china | people's republic of china | prc | mainland china
    germany: germany | federal republic of germany | deutschland
    france: france | french republic | republique francaise
    saudi arabia: saudi arabia | kingdom of saudi arabia | ksa | saudi
    european union: european union | eu | e.u. | europe | european
    global: global | international | worldwide | world | globally
    unwto: unwto | un tourism | u.n. tourism | un-tourism | world tourism organization | united nations world tourism organization | un world tourism organization
    iata: iata | international air transport association
    wttc: wttc | world travel & tourism council | world travel and tourism council | world travel tourism council
    who: who | world health organization | w.h.o.
    un: un | united nations | u.n. | the un
    imf: imf | international monetary fund
    world bank: world bank | the world bank | world bank group | ibrd
    oecd: oecd | organisation for economic co-operation and development | organization for economic cooperation and development
    wef: wef | world economic forum | davos
    icao: icao | international civil aviation organization
    asia pacific: asia pacific | asia-pacific | apac | asia and the pacific | asia & pacific
    middle east: middle east | mena | middle east and north africa | near east
    latin america: latin america | latam | central and south america | south america | central america
    north america: north america | n. america | northern america
    sub-saharan africa: sub-saharan africa | ssa | subsaharan africa | africa south of the sahara
    """
)
# Other hosts of primary institutions and the host that stands for each.
PRIMARY_HOSTS = _table(
    """
    unwto.org: unwto.org | www.unwto.org | e-unwto.org | pre-webunwto.s3.eu-west-1.amazonaws.com | unwto-ap.org | en.unwto-ap.org
    iata.org: iata.org | www.iata.org | data.iata.org
    wttc.org: wttc.org | www.wttc.org
    oecd.org: oecd.org | www.oecd.org | data.oecd.org
    imf.org: imf.org | www.imf.org | data.imf.org
    worldbank.org: worldbank.org | www.worldbank.org | data.worldbank.org
    ec.europa.eu: ec.europa.eu
    who.int: who.int | www.who.int | data.who.int
    un.org: un.org | www.un.org | data.un.org
    """
)
# Families of hosts in order of precedence; a leading dot stands for all hosts below a suffix.
FAMILIES = {
    "nps": ["nps.gov", "npshistory.com"], "usgs": ["usgs.gov"], "gov": [".gov"], "edu": [".edu"], "econ": ["worldbank.org", "oecd.org", "imf.org", "wto.org", "bis.org"],
    "eu": ["data.europa.eu", "ec.europa.eu", "eurostat.ec.europa.eu", "ecb.europa.eu"], "un": ["un.org", "unctad.org", "who.int"],
}
# Words that say that something grew or shrank.
RISING = ["increase", "increased", "up", "rise", "rose", "grew", "growth", "higher"]
FALLING = ["decrease", "decreased", "down", "decline", "declined", "fell", "lower"]


def spaced(text: Column) -> Column:
    """A text in lower case as words between single blanks, with one at both ends; signs inside names stay."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}.&'-]+|[.'-]+(?=\s|$)", " "), F.lit(" "))


def longest_name(spaced_text: Column, names: dict[str, str]) -> Column:
    """The canonical name of the longest alias that stands in a text from :func:`spaced` as words of its own; null without any."""
    return F.coalesce(*[F.when(spaced_text.contains(f" {alias} "), F.lit(name)) for alias, name in names.items()])


def canonical_name(text: Column, names: dict[str, str]) -> Column:
    """The canonical name of a text that is an alias as a whole; null if it is none."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.lower(F.trim(text))]


def primary_host(name: Column) -> Column:
    """The host that stands for a primary institution's hosts; other hosts stay, in lower case."""
    low = F.lower(F.trim(name))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in PRIMARY_HOSTS.items() for x in pair])[low], low)


def is_primary_host(name: Column) -> Column:
    """Whether a host is one of a primary institution, or lies below a government, education or treaty suffix; null counts as not."""
    known = sorted(set(PRIMARY_HOSTS.values()))
    low = primary_host(name)
    return F.coalesce(low.isin(known) | low.rlike(r"\.(?:gov|edu|int|mil)(?:\.[a-z]{2})?$"), F.lit(False))


def family(name: Column) -> Column:
    """The first family of ``FAMILIES`` that a host belongs to, else the host itself."""
    low = F.lower(F.trim(name))
    tests = [F.when(low.endswith(h) if h[0] == "." else (low == h) | low.endswith("." + h), F.lit(f)) for f, hosts in FAMILIES.items() for h in hosts]
    return F.coalesce(*tests, low)


def direction(text: Column) -> Column:
    """1 if a text has words of growth only, -1 if of decline only, else 0."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z]+")
    up, down = (F.arrays_overlap(words, F.array(*[F.lit(w) for w in own])).cast("int") for own in (RISING, FALLING))
    return up - down
