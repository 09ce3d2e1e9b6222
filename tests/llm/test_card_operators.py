import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cardloom.llm import boilerplate, contributor_cap, queries, residue, survivors, truncation
from cardloom.llm.trusted import trusted_records
from cardloom.sources.tables import table

RECORDS = "ingest_idx long, id string, pool string, contributor string, score double, extra string"


def _cap_brute(rows, divisor=4):
    seen, first = set(), []
    for r in sorted(rows):
        if r[1] is None or r[1] not in seen:
            seen.add(r[1])
            first.append(r)
    pools = defaultdict(set)
    groups = defaultdict(list)
    for i, rid, pool, who, score, _ in first:
        if pool is not None:
            if rid is not None:
                pools[pool].add(rid)
            if who is not None:
                groups[pool, who].append((-(score if score is not None else -1.0), i))
    gone = set()
    for (pool, _), members in groups.items():
        gone |= {i for _, i in sorted(members)[max(1, len(pools[pool]) // divisor) :]}
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_cap_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, None if rng.random() < 0.03 else f"id{rng.randrange(700)}", rng.choice(["p", "p", "q", "r", None]), rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([None, 0.5, 0.5, rng.random(), round(rng.random(), 2), 1.0, 0.0]), "x")
        for i in range(900)
    ]
    df = spark.createDataFrame(rows, RECORDS)
    got = [r.ingest_idx for r in contributor_cap.over_cap(df, bins=16, block=32).collect()]
    assert len(got) == len(set(got)) and set(got) == _cap_brute(rows)


def test_cap_edges(spark):
    empty = spark.createDataFrame([], RECORDS)
    assert contributor_cap.over_cap(empty).count() == 0
    ties = [(i, f"i{i}", "p", "a", 0.5, None) for i in range(40)]
    assert {r.ingest_idx for r in contributor_cap.over_cap(spark.createDataFrame(ties, RECORDS)).collect()} == set(range(10, 40))


def test_capped_cards_keep_every_row(spark, data):
    cards, profiles = table(spark, data, "evidence_cards"), table(spark, data, "source_profiles")
    kept = contributor_cap.capped_cards(cards, profiles)
    assert kept.count() == cards.count()
    assert kept.where("not stays").count() == queries.p2_found(spark, data).count()


def test_survivors(spark):
    profiles = spark.createDataFrame([("x.example", "UTC", "DMY")], "site string, home_zone string, date_order string")
    schema = "ingest_idx long, id string, cluster_id string, is_primary_source boolean, credibility_score double, source_domain string, url string, author string, doi string, publication_date string, collected_at string, micros long, normal string"
    rows = [
        (1, "a", "C1 ", False, 0.9, "x.example", None, " N/A", None, "unknown", "2024-01-01T00:00:00Z", 1, "n"),
        (2, "b", "c1", True, 0.1, "x.example", None, None, "10.1/x", "2023-02-30", "2024-01-01T00:00:00Z", 1, "n"),
        (3, "c", " c1", True, 0.1, None, "https://x.example/", "Ann", "-", "2020", "2024-01-02 00:00:00 UTC", None, None),
        (4, "d", "alone", None, float("nan"), "x.example", None, "Bo", None, "2020", None, None, None),
        (5, "d", "alone", None, None, "x.example", None, "Bo", None, "2020", None, None, None),
        (6, "e", None, True, 7.5, "x.example", None, "Bo", None, "2020", None, None, None),
        (7, "f", "  ", True, 0.5, "x.example", None, "Bo", None, "2020", None, None, None),
    ]
    got = {(r.cluster_id, r.field): r.ingest_idx for r in survivors.card_survivors(spark.createDataFrame(rows, schema), profiles).collect()}
    assert got == {("c1", "record"): 3, ("c1", "author"): 3, ("c1", "doi"): 2, ("c1", "publication_date"): 3}
    assert survivors.card_survivors(spark.createDataFrame([], schema), profiles).count() == 0


SENTENCES = [f"The board of town {i} reported that costs had risen by {i} percent, and a study is planned for next year." for i in range(200)]


@pytest.fixture(scope="module")
def odds(spark):
    rows = [(i, s, f"{s} [3] It grew [sic] in town {i}.") for i, s in enumerate(SENTENCES)] + [(900, None, ""), (901, " ", None)]
    return residue.fitted(spark.createDataFrame(rows, "ingest_idx long, snippet string, supporting_text string"))


@pytest.mark.parametrize(
    "text", ["Please enable JavaScript to view this content.", "404 Not Found", "{{title}} of the board reported that costs had risen.", "The board [INSERT name HERE] reported costs.", "Lorem ipsum dolor sit amet.", "null null null", "ZUGRIFF VERWEIGERT. VORGANG 12ab34cd", "The costs of ${city} rose."]
)
def test_residue(odds, text):
    assert residue.is_residue(text, odds)


@pytest.mark.parametrize("text", [None, "", "  \n ", SENTENCES[3], "The board of town 5 [Halsk] reported that costs had risen by 5 percent.", "The set {3, 5, 8} of the board had risen by 5 percent.", "x" * 50_000])
def test_no_residue(odds, text):
    assert not residue.is_residue(text, odds)


def test_trusted_records_stand_in_no_table(spark, data):
    """Seeds are written from public grammars: none of five words or more, and no code, occurs in the tables."""
    plain = lambda text: " " + " ".join(re.findall(r"\w+", text.lower())) + " "
    records = [r for own in trusted_records().values() for r in own]
    long = {p for r in records if len((p := plain(r)).split()) >= 5}
    codes = {c for r in records for c in re.findall(r"\b(?=\w*\d)(?=\w*[a-f])[0-9a-f]{6,}\b", r)}
    cards = table(spark, data, "evidence_cards", "snippet", "supporting_text", "best_quote").toPandas()
    for text in set(cards.to_numpy().ravel()):
        if text:
            found = plain(text)
            assert not any(p in found for p in long) and not any(c in found for c in codes), text


def test_residue_of_wordings_held_out(spark):
    """Whole wordings are left out of the trusted records; at least nine of ten are found among clean texts."""
    records = trusted_records()
    rng = random.Random(4)
    held, kept = [], {}
    for kind, own in records.items():
        out = set(rng.sample(own, len(own) // 5)) if kind in ("failure", "script") else set()
        kept[kind] = [r for r in own if r not in out]
        held += [r for r in out if len(r.split()) >= 4]
    rows = [(i, s, s) for i, s in enumerate(SENTENCES * 5)] + [(5_000 + i, r, None) for i, r in enumerate(held)]
    model = residue.fitted(spark.createDataFrame(rows, "ingest_idx long, snippet string, supporting_text string"), trusted=kept)
    assert (residue.residue_scores(held, model) >= residue.SHARE).mean() >= 0.9
    assert (residue.residue_scores(SENTENCES, model) < residue.SHARE).all()


PAGE = "Home | News | Sign in\nThe title of the piece\nAdvertisement\nMost read\nWhy towns matter now\nNine charts on costs\nThe board of the town said that the costs had risen by a fifth.\nBackground\nIt is not the first time that this was said in the town.\n- 2019: 21.7\nYear | Count | Share\n2019 | 8774 | 1.9\nWe and our 12 partners store cookies to measure visits. Accept all\n© 2020 Board. All rights reserved."


def test_furniture():
    assert boilerplate.furniture(PAGE, "The title of the piece | Board") == [1, 3, 4, 5, 6, 13, 14]
    assert boilerplate.main_text(PAGE, "The title of the piece").split("\n")[0] == "The title of the piece"
    for empty in (None, "", " \n "):
        assert boilerplate.furniture(empty, None) == []
    assert boilerplate.main_text(None) is None
    assert boilerplate.furniture("Cookie banners were seen by 14 percent of visitors in the town, the study says.", None) == []
    assert boilerplate.furniture("word " * 30_000, None) == []


def test_lines_learned_from_repetition(spark):
    """Without any list, lines that a site repeats outside running text are furniture; headings inside it are not."""
    rng = random.Random(2)
    body = lambda: f"The board of town {rng.randrange(10**6)} said that the costs had risen by {rng.randrange(90)} percent in the town."
    rows = []
    for i in range(120):
        text = f"Zubble our gazette today\n{body()}\nBackground\n{body()}\nOur gazette counts on you, dear reader.\nQuibble corner"
        rows.append((i, f"Title {i}", f"https://s{i % 3}.example/{i}", text, None))
    cards = spark.createDataFrame(rows, "ingest_idx long, title string, url string, supporting_text string, snippet string")
    got = {(r.field, r.line_no) for r in boilerplate.card_furniture(cards, lists=False).collect()}
    assert got == {("supporting_text", n) for n in (1, 5, 6)}
    assert boilerplate.learned_phrases(cards.limit(0), ("supporting_text",)).sum() == 0


def test_furniture_without_lists_on_tables(spark):
    cards = table(spark, "/root/testdata/sf0.01", "evidence_cards")
    with_lists = boilerplate.card_furniture(cards)
    found = boilerplate.card_furniture(cards, lists=False)
    n = with_lists.count()
    assert with_lists.join(found, ["ingest_idx", "field", "line_no"], "left_semi").count() >= 0.85 * n
    assert found.join(with_lists, ["ingest_idx", "field", "line_no"], "left_anti").count() <= 0.01 * n


BODY = "The board of the town said that the costs had risen by a fifth."


@pytest.mark.parametrize(
    "text, lines",
    [
        (f"Halsk Courier online edition\nHome | News | Sign in\n{BODY}", [1, 2]),  # undecided at the head and at the foot
        (f"{BODY}\nAdvertisement\nPhotograph: Ann Ostby", [2, 3]),
        (f"{BODY}\nAdvertisement\nHalsk Courier Media Holding Group, Tovstad office\n© 2020 Board", [2, 3, 4]),  # over 30 characters
        (f"Advertisement\nHalsk Courier Media Holding Group, Tovstad office\n\nTown desk\nBackground\n{BODY}", [1, 2]),  # the nearer one; a tie is content
        (f"Advertisement\n\nBackground\n{BODY}", [1]),
        ("Advertisement\nHalsk (43.5 million)", [1]),  # a data row, and a cut sentence as the only content
        ("Home | News | Sign in\nHalsk Council lists 1,796 open", [1]),
        (f"{BODY}\nAdvertisement\nHalsk: 32,338", [2]),
        ("Background\nTown desk", []),  # nothing is decided
    ],
)
def test_undecided_lines_follow_the_nearer_neighbour(text, lines):
    assert boilerplate.furniture(text, None) == lines


@pytest.mark.parametrize(
    "text, kind",
    [
        ("The board said that the cos", "open"), ("The board said… more", "mark"), ("The board said that [...]", "mark"), ("The board said it... [+592 chars]", "mark"), ("The board said that the<br", "debris"), ("The board said&quo", "debris"), ("The board rose \\u20", "debris"), ("The board said�", "debris"),
        ("The board said so.", None), ("« The board said so. »", None), ('The memo ends with one line: "we will see..."', None), ("Halsk: 38.9 million", None), ("Halsk (38,3)", None), ("The title", None), ("the title – Board", None), (None, None), ("", None), ("...of the board said so.", None), ("According to a poll of 1,2", "open"),
    ],
)
def test_endings(text, kind):
    found = truncation.ending(text, "The title", ())
    assert (found and found[0]) == kind


def test_cut_values(spark):
    schema = "ingest_idx long, title string, snippet string, best_quote string, claim string, supporting_text string, provider string, n long"
    rows = [(i, "A title", s, None, None, s, "t", 1) for i, s in enumerate(SENTENCES)]
    rows += [(500, "A title", "Costs rep", None, None, None, None, None), (501, "A title", "A title", "", " ", None, None, None), (502, None, "Please enable JavaScript to view this content", None, None, None, None, None)]
    rows += [(503, "A title", "The board of town 3 reported that costs", None, None, None, None, None)] * 2
    got = sorted((r.ingest_idx, r.field) for r in truncation.cut_values(spark.createDataFrame(rows, schema)).collect())
    assert got == [(500, "snippet"), (503, "snippet"), (503, "snippet")]
    assert truncation.cut_values(spark.createDataFrame([], schema)).count() == 0


def test_evidence_of_cuts(spark):
    """Trie, length limit and words that go on decide open values; context only what they leave."""
    schema = "ingest_idx long, title string, snippet string, best_quote string, claim string, supporting_text string, provider string"
    rng = random.Random(8)
    names = ["alpha", "beta", "gamma", "delta"]
    full = [f"In {rng.choice(names)} the reported costs of the town had risen by {k} percent and the council saw no reason." for k in range(300)]
    rows = [(i, "A title", s, None, None, s, "p") for i, s in enumerate(full)]
    rows += [(1_000 + i, "A title", s[:60] if i % 2 else s[:60].rsplit(" ", 1)[0], None, None, None, "q") for i, s in enumerate(full[:40])]
    rows += [(2_000, "A title", "In alpha the repor", None, None, None, "p"), (2_001, "A title", "In beta the reported costs of the", None, None, None, None), (2_002, "A title", "In beta the reported costs of the town had risen by 7", None, None, None, "p"), (2_003, "A title", "Costs of the town […]", None, None, None, "p"), (2_004, "A title", "Alpha", None, None, None, "p")]
    got = {r.ingest_idx: r.evidence for r in truncation.judged_values(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i] for i in (2_000, 2_001, 2_002, 2_003)] == ["trie", "goes_on", "context", "mark"] and got[2_004] is None
    assert {got[1_000 + i] for i in range(40)} <= {"trie", "length"} and "length" in {got[1_000 + i] for i in range(40)}


def test_trie(spark):
    known = spark.createDataFrame([("report", 5), ("reported", 7), ("a", 9)], "word string, n long")
    nodes = {r.prefix: (r.words, r.below) for r in truncation.trie(known).collect()}
    assert nodes["rep"] == (2, 12) and nodes["report"] == (1, 7) and "reported" not in nodes and "a" not in nodes


def test_bodies_keep_rows_and_columns(spark, data):
    cards = table(spark, data, "evidence_cards")
    bodies = boilerplate.main_bodies(cards)
    assert bodies.columns == cards.columns and bodies.count() == cards.count()
    assert boilerplate.card_furniture(cards.limit(0)).count() == 0 and residue.residue_values(cards.limit(0)).count() == 0


def test_lines_of_residue_values_are_none(spark, data):
    cards = table(spark, data, "evidence_cards")
    bad = residue.residue_values(cards).select("ingest_idx", "field")
    assert boilerplate.card_furniture(cards).join(bad, ["ingest_idx", "field"], "left_semi").count() == 0


def test_p2_equals_sql(spark, data):
    from comparison import connection, rows

    got = queries.p2_found(spark, data).toPandas()
    assert rows(got) == rows(connection(data).sql(queries.oracle_sql()["p2_found"]).df())
    assert len(got)


def test_bodies_query(spark, data):
    out = queries.p5_bodies(spark, data)
    assert out.count() == table(spark, data, "evidence_cards").count() and "supporting_text" in out.columns


def test_all_card_queries_give_distinct_rows(spark, data):
    for name in ("p2_found", "p3_found", "p4_found", "p5_found", "p6_found"):
        out = queries.queries()[name](spark, data)
        assert out.count() == out.distinct().count() > 0, name
    assert queries.p3_rates(spark, data).where((F.col("rate") < 0) | (F.col("rate") > 1)).count() == 0
