import gzip
import json

import pytest
from pyspark.sql import functions as F

from cardloom.functions import dimensions, quantities, text, urls
from cardloom.functions.membership import possibly_in
from cardloom.operators import claims, neighbours
from cardloom.session import fits
from cardloom.sources import files

CARDS = "ingest_idx long, url string, claim string, cluster_id string, is_primary_source boolean"


@pytest.mark.parametrize(
    "said, value, unit",
    [
        ("rose by 5 percent to 300 million", 5.0, "%"), ("reached 12.5 million in 2024", 12.5, "M"), ("1,234.56 units of 7", 1234.56, None), ("in 2024 there were 42", 42.0, None), ("the 12th of 2021", None, None), ("2 bn and 3 tn", 3.0, "T"),
        ("up 3 percentage points", 3.0, "PP"), ("", None, None), (None, None, None), ("no number", None, None), ("4k", 4.0, "K"), ("9 " * 20_000, 9.0, None),
    ],
)
def test_quantities(spark, said, value, unit):
    v, u = quantities.number_with_unit(F.col("t"))
    row = spark.createDataFrame([(said,)], "t string").select(v.alias("v"), u.alias("u")).first()
    assert (row.v, row.u) == (value, unit)


@pytest.mark.parametrize(
    "said, period",
    [
        ("in Q1 2025", "Q1 2025"), ("first quarter 2025", "Q1 2025"), ("fourth quarter of 2019", "Q4 2019"), ("Apr-Jun 2025", "Q2 2025"), ("January – March 2020", "Q1 2020"), ("second half of 2018", "H2 2018"), ("H1 2018", "H1 2018"),
        ("FY 2021", "FY 2021"), ("ytd2021", "YTD 2021"), ("since 2007, Q3 2011", "Q3 2011"), ("in 2007", "2007"), ("in 1999", None), (None, None), ("", None),
    ],
)
def test_periods(spark, said, period):
    assert spark.createDataFrame([(said,)], "t string").select(quantities.period(F.col("t")).alias("p")).first().p == period


def test_compatible_quantities(spark):
    rows = [(1.0, "M", 950_000.0, None, True), (5.0, "%", 5.0, "PP", False), (5.0, "%", 5.2, "%", True), (5.0, "%", 5.0, None, False), (0.0, None, 0.05, None, True), (1.0, "B", 2.0, "B", False)]
    df = spark.createDataFrame(rows, "a double, ua string, b double, ub string, want boolean")
    got = df.select("want", quantities.compatible(F.col("a"), F.col("ua"), F.col("b"), F.col("ub")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_names_and_hosts(spark):
    df = spark.createDataFrame([("Visitor inflows to the U.S. rose",), ("room occupancy",), ("random metric",), (None,), ("The museum",)], "t string")
    wide = dimensions.spaced(F.col("t"))
    got = [(r.m, r.e) for r in df.select(dimensions.longest_name(wide, dimensions.METRICS).alias("m"), dimensions.longest_name(wide, dimensions.ENTITIES).alias("e")).collect()]
    assert got == [("international_tourist_arrivals", "united states"), ("hotel_occupancy_rate", None), (None, None), (None, None), (None, None)]
    hosts = spark.createDataFrame([("data.oecd.org",), ("cdc.gov",), ("a.nps.gov",), ("b.ac.uk",), (None,), ("news.example",), ("health.gov.au",)], "h string")
    own = hosts.select(dimensions.is_primary_host(F.col("h")).alias("p"), dimensions.family(F.col("h")).alias("f"), urls.registrable(F.col("h")).alias("r")).collect()
    assert [r.p for r in own] == [True, True, True, False, False, False, True]
    assert [r.f for r in own[:3]] == ["econ", "gov", "nps"] and own[3].r == "b.ac.uk" and own[2].r == "nps.gov" and own[4].r is None and own[6].r == "health.gov.au"


def test_work_ids(spark):
    rows = [("10.1/x", None), ("10.1234/AbC.", "https://a.example"), (None, "https://arxiv.org/abs/2301.12345v2"), (None, "https://pubmed.ncbi.nlm.nih.gov/12345678/"), (None, "https://www.congress.gov/crs/R45678.html"), (None, "https://notarxiv.org/2301.12345"), (None, None)]
    got = [r.w for r in spark.createDataFrame(rows, "doi string, url string").select(urls.canonical_id(F.col("doi"), F.col("url")).alias("w")).collect()]
    assert got[1:5] == ["doi:10.1234/abc", "arxiv:2301.12345", "pmid:12345678", "crs:R45678"] and got[5] == "url:notarxiv.org/2301.12345" and got[6] == "url:"


def test_structured_claims_and_support(spark):
    rows = [
        (1, "https://data.oecd.org/a", "Global inflation rose by 5 percent in 2024", "c", None), (2, "https://b.example/a", "Global inflation rose by 5.1 percent in 2024", "C ", None), (3, "https://b.example/b", "GDP growth in China was 3 percent", None, True),
        (4, None, None, " ", None), (5, "https://x.example", "", "d", True), (6, "https://x.example", "Inflation fell", "d", True),
    ]
    cards = spark.createDataFrame(rows, CARDS)
    own = {r.ingest_idx: r for r in claims.structured_claims(cards).collect()}
    assert len(own) == 6 and own[1].key == "global|inflation_rate|2024" and own[1].value == 5.0 and own[3].key == "china|gdp_growth" and own[4].key is None and own[6].key is None
    support = {r.key: r for r in claims.claim_support(claims.structured_claims(cards)).collect()}
    assert support["global|inflation_rate|2024"].label == "triangulated" and support["global|inflation_rate|2024"].primaries == 1 and support["china|gdp_growth"].label == "single"
    assert [r.key for r in claims.uncorroborated(claims.structured_claims(cards)).collect()] == ["china|gdp_growth"]
    share = claims.primary_share(cards, F.lower(F.trim("cluster_id"))).first()
    assert (share.cards, share.primaries, share.share) == (2, 1, 0.5)
    assert claims.primary_share(cards.limit(0), F.col("cluster_id")).first().share == 0.0
    conflicts = claims.direction_conflicts(cards.unionByName(cards.withColumn("claim", F.lit("prices fell"))), "cluster_id").collect()
    assert [(r.group, r.rising, r.falling) for r in conflicts] == [("c", 2, 2)]
    assert claims.source_kinds(cards).agg(F.sum("cards")).first()[0] == 6 and claims.structured_claims(cards.limit(0)).count() == 0


def test_paraphrases_equal_brute_force(spark):
    import random

    rng = random.Random(6)
    base = [[f"w{rng.randrange(40)}" for _ in range(12)] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:-1] + ["other"]) for b in base] + [" ".join(reversed(base[0])), "", "one two", "one two", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: frozenset((t or "").split()) for i, t in enumerate(texts)}
    near = lambda a, b: a == b or len(a & b) >= 3 and len(a & b) / len(a | b) >= 0.82
    group = {i: i for i, s in sets.items() if s}
    for _ in group:
        for a in group:
            for b in group:
                if near(sets[a], sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: r.class_id for r in claims.paraphrase_classes(df).collect()}
    assert got == group


def test_answers_of_services(spark):
    rows = [
        ("crossref", json.dumps({"message": {"items": [{"URL": "https://doi.org/10.1/x", "title": ["A <i>b</i>"], "abstract": "<p>Text</p>", "DOI": "10.1/x"}, {"title": ["no address"]}]}})),
        ("wikipedia", json.dumps({"query": {"search": [{"pageid": 7, "title": "T", "snippet": "s", "timestamp": "2024-01-01T00:00:00Z"}]}})), ("worldbank", json.dumps([{"page": 1}, [{"id": "NY.GDP", "name": "GDP", "sourceNote": "note"}]])),
        ("brave", "no json"), ("unknown", "{}"), ("tavily", None), (None, "{}"), ("serper", json.dumps({"organic": []})),
    ]
    got = {r.provider: r for r in files.cards_from_answers(spark.createDataFrame(rows, "provider string, body string")).collect()}
    assert set(got) == {"crossref", "wikipedia", "worldbank"}
    assert got["crossref"].title == "A b" and got["crossref"].snippet == "Text" and got["crossref"].doi == "10.1/x" and got["crossref"].source_domain == "doi.org"
    assert got["wikipedia"].url == "https://en.wikipedia.org/?curid=7" and got["worldbank"].title == "GDP"


def test_upsert_and_replace(spark, tmp_path):
    path = str(tmp_path / "cards")
    old = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old"), (None, 3, "old")], "id string, ingest_idx long, claim string")
    new = spark.createDataFrame([("b", 4, "x"), ("b", 5, "new"), ("c", 6, "new"), (None, 7, "new")], "id string, ingest_idx long, claim string")
    files.replace_output(old, path)
    files.replace_output(files.upserted(spark.read.parquet(path), new), path)
    got = sorted((r.id or "", r.ingest_idx, r.claim) for r in spark.read.parquet(path).collect())
    assert got == [("", 3, "old"), ("", 7, "new"), ("a", 1, "old"), ("b", 5, "new"), ("c", 6, "new")]
    assert [p.name for p in tmp_path.iterdir()] == ["cards"]
    entries = spark.createDataFrame([("a", 5), ("b", None), ("c", 1)], "k string, expires_at long")
    assert sorted(r.k for r in files.unexpired(entries, F.lit(3)).collect()) == ["a", "b"]


def test_compressed_archives():
    record = lambda k: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: https://a.example/{k}\r\nWARC-Date: 2024-01-0{k}T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: 1\r\n\r\n{k}\r\n\r\n".encode()
    got = list(files.warc_records(gzip.compress(record(1)) + gzip.compress(record(2))))
    assert [(kind, url[-1], date[:10], form, body) for kind, url, date, form, body in got] == [("response", "1", "2024-01-01", "text/html", b"1"), ("response", "2", "2024-01-02", "text/html", b"2")]
    assert list(files.warc_records(b"")) == [] and list(files.warc_records(gzip.compress(record(1))[:30])) == []


def test_membership_keeps_all_keys(spark):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(500)] + [(900, None)], "i long, key string")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 500, 7)] + [(None,)], "key string")
    got = [r.key for r in possibly_in(df, "key", keys).collect()]
    assert set(got) == {f"k{i}" for i in range(0, 500, 7)} and possibly_in(df, "key", keys).columns == df.columns
    assert possibly_in(df, "key", keys.limit(0)).count() == 0


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    df = spark.createDataFrame([(1, "x" * 1000, ["y" * 500]), (2, None, None)], "i long, t string, a array<string>")
    assert fits(df, 2) and not fits(df, 1) and not fits(df, 2, 1400) and fits(df.limit(0), 0, 0)


def test_neighbours_in_several_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(300)] + [(1000, None)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, neighbours.nearest(df, 3, every=10).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    assert sorted(map(tuple, neighbours.nearest(df, 3, every=10).collect())) == whole and len(whole) == 90


def test_text_windows(spark):
    df = spark.createDataFrame([("No figure here. Costs rose by 5 percent. More.",), ("Only words here.",), ("x" * 400,), (None,), ("",)], "t string")
    assert [r.w for r in df.select(text.best_window(F.col("t"), 280).alias("w")).collect()] == ["Costs rose by 5 percent.", "Only words here.", None, None, None]
    assert df.select(text.without_quotes(F.lit("“a” 'b'")).alias("q")).first().q == "a b"


def test_sets_met_by_groups_equal_brute_force(spark):
    """Small sets meet by three rare members, larger ones by one; frequent members alone make no rows to join."""
    import random

    from cardloom.operators.near_duplicates import components, similar_forest, similar_sets

    rng = random.Random(4)
    sets = []
    for n in [3, 5, 6, 10, 11, 12, 16, 17, 21, 27, 32, 33, 40]:
        for _ in range(4):
            base = rng.sample(range(80), n)
            sets += [base] + [[*rng.sample(base, n - rng.randrange(3)), *rng.sample(range(80, 90), rng.randrange(3))] for _ in range(4)]
    sets = [sorted(x) for x in {frozenset(x) for x in sets}]
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in enumerate(sets)], "doc_id long, _s array<string>")
    common = lambda a, b: len({*sets[a]} & {*sets[b]})
    want = {(a, b) for b in range(len(sets)) for a in range(b) if (i := common(a, b)) >= 3 and i >= 0.82 * (len(sets[a]) + len(sets[b]) - i)}
    got = similar_sets(df, 0.82, 3)
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 50
    forest = similar_forest(df, 0.82, 3)
    assert {tuple(r) for r in components(forest).collect()} == {tuple(r) for r in components(got).collect()}
