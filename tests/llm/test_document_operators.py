import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.llm import contamination, mixing, queries, toxicity
from cardloom.llm.abuse import confirmed, harmless
from cardloom.sources.tables import table


def _tokens(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def _items(rng, n=8):
    words = [f"word{k}" for k in range(300)]
    return [(i, " ".join(rng.choice(words) for _ in range(50))) for i in range(n)]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    items = _items(rng)
    filler = lambda n: " ".join(f"other{rng.randrange(400)}" for _ in range(n))
    docs = []
    for k in range(60):
        words = items[rng.randrange(len(items))][1].split()
        share = rng.choice([0, 5, 15, 24, 30, 40, 50])
        start = rng.randrange(0, 51 - share) if share else 0
        piece = words[start : start + share]
        for _ in range(rng.randrange(3)):
            if piece:
                piece[rng.randrange(len(piece))] = "changed"
        half = len(piece) // 2
        docs.append((k, f"{filler(30)} {' '.join(piece[:half]).upper()},\n{filler(rng.choice([0, 5]))} {'; '.join(piece[half:])} {filler(20)}"))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, items[0][1])]
    got = {(r.item_id, r.doc_id) for r in contamination.leaked_items(spark.createDataFrame(items + [(50, None), (51, "too short")], "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {(i, d) for i, a in items for d, b in docs if contamination.containment(_tokens(b), _tokens(a)) >= 0.5}
    assert got == want and {(0, 102), (0, 103)} <= got


@pytest.mark.parametrize("every", [2, 3, 4, 5, 6])
def test_densely_changed_copies_equal_brute_force(spark, every):
    """Every so-many-th word changed, in whole copies and in copies of half an item: what the measure counts is never lost."""
    rng = random.Random(every)
    items = _items(rng, 5) + [(7, "one two three four " * 9), (8, "say it again and say it again and say it again until all is said")]
    docs = []
    for i, text in items:
        own = text.split()
        for part in (own, own[: len(own) // 2 + 2], own[len(own) // 3 :]):
            docs.append((len(docs), " ".join(f"z{k}" if k % every == every - 1 else w for k, w in enumerate(part)) + " and some more"))
        docs.append((len(docs), " ".join(own[:3])))
    want = {(i, d) for i, a in items for d, b in docs if contamination.containment(_tokens(b), _tokens(a)) >= 0.5}
    got = {(r.item_id, r.doc_id) for r in contamination.leaked_items(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and (every < 4 or len(want) >= len(items))


def test_leaks_beyond_the_broadcast_bound(spark, monkeypatch):
    """With more item shingles than are broadcast, a bitmap filters; the result is the same."""
    rng = random.Random(9)
    items, docs = spark.createDataFrame(_items(rng), "item_id long, text string"), spark.createDataFrame([(k, t) for k, (_, t) in enumerate(_items(random.Random(9)))] + [(50, "none of it at all is here")], "doc_id long, text string")
    want = {tuple(r) for r in contamination.leaked_items(items, docs).collect()}
    monkeypatch.setattr(contamination, "KEYS", 3)
    assert {tuple(r) for r in contamination.leaked_items(items, docs).collect()} == want and len(want) == 8


def test_containment():
    item = [f"w{i}" for i in range(20)]
    assert contamination.containment(item, item) == 1.0
    assert contamination.containment(["x"] * 100 + item[:10] + ["y"] * 100, item) == 0.5
    assert contamination.containment(item[:2] + ["x"] + item[5:7], item) == 0.0
    assert contamination.containment([], item) == contamination.containment(item, []) == 0.0


def test_leaks_of_empty_tables(spark):
    items, docs = spark.createDataFrame(_items(random.Random(1)), "item_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert contamination.leaked_items(items, docs.limit(0)).count() == 0 and contamination.leaked_items(items.limit(0), docs).count() == 0


def test_split_tree_keeps_quotas():
    blocks = np.array([10, 0, 33, 7])
    shards = mixing.split_tree(blocks, 5, np.random.default_rng(1))
    assert shards.shape == (5, 4) and (shards.sum(axis=0) == blocks).all() and (shards >= 0).all() and shards.sum(axis=1).max() - shards.sum(axis=1).min() <= 2


def test_mix(spark, data):
    docs, targets = table(spark, data, "documents"), table(spark, data, "mix_targets")
    copies, report = mixing.mixed(docs, targets)
    limits = {r.source: r.max_repeats for r in report.collect()}
    rows = copies.collect()
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and all(1 <= r.copy <= limits[r.source] for r in rows)
    assert report.count() == targets.count() and abs(report.agg(F.sum("actual_share")).first()[0] - 1) < 1e-9 and abs(report.agg(F.sum("attainable_share")).first()[0] - 1) < 1e-9
    lost = report.where("source = 'lost_almanac'").first()
    assert lost.drawn_tokens == 0 and not lost.reached
    again = {(r.doc_id, r.copy, r.shard, r.position) for r in mixing.mixed(docs, targets)[0].collect()}
    assert again == {(r.doc_id, r.copy, r.shard, r.position) for r in rows}


def test_shards_are_equal_and_copies_spread(spark):
    """Shards differ by less than a block of each source; no two copies of a document share a shard while there are enough."""
    docs = spark.createDataFrame([(i, " ".join(["word"] * (3 + i % 17)), "big" if i % 3 else "small") for i in range(3000)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.4, 2), ("small", 0.6, 5)], "source string, target_share double, max_repeats int")
    copies, report = mixing.mixed(docs, targets, shards=8, blocks=64)
    rows = copies.collect()
    sizes = [sum(r.tokens for r in rows if r.shard == k) for k in range(8)]
    block = {s: 3 * sum(r.tokens for r in rows if r.source == s and r.copy == 1) / 64 for s in ("big", "small")}
    assert max(sizes) - min(sizes) < sum(block.values())
    assert max(r.copy for r in rows) > 1 and len({(r.doc_id, r.shard) for r in rows}) == len(rows)
    assert all(r.reached for r in report.collect())
    drawn = {r.source: r for r in report.collect()}
    assert all(abs(x.actual_share - x.target_share) < 0.01 for x in drawn.values())
    by_copy = {k: {r.doc_id for r in rows if r.copy == k} for k in range(1, 6)}
    assert all(by_copy[k + 1] & {r.doc_id for r in rows if r.source == "small"} <= by_copy[k] for k in range(1, 5))


def test_mix_reaches_shares_and_caps(spark):
    docs = spark.createDataFrame([(i, f"some text number {i} of a source", "big" if i < 400 else "small", "extra") for i in range(420)] + [(900, None, "big", "x"), (901, "t", None, "x")], "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("none", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    copies, report = mixing.mixed(docs.drop("tokens"), targets, total=200)
    got = {r.source: r for r in report.collect()}
    assert abs(got["big"].drawn_tokens - 100) <= 8 and abs(got["small"].drawn_tokens - 100) <= 8
    copies, report = mixing.mixed(docs.drop("tokens"), targets)
    got = {r.source: r for r in report.collect()}
    assert got["small"].drawn_tokens == 3 * got["small"].available_tokens and not got["small"].reached
    assert mixing.mixed(docs.drop("tokens").limit(0), targets)[0].count() == 0
    assert mixing.mixed(docs.drop("tokens"), targets.limit(0))[1].count() == 0


def test_plan_respects_repeats():
    out = mixing.plan({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)})
    assert abs(out["a"]["attainable"] - 55 / 75) < 1e-9
    assert out["a"]["drawn"] == 55 and out["b"]["drawn"] == 20 and out["b"]["wanted"] == 55


@pytest.fixture(scope="module")
def classifier():
    benign = [f"The council of town {i} reported that visits rose by {i} percent, and a study is planned for March." for i in range(3000)]
    benign += ["To stop the job, kill the process and restart the worker.", "Traffic has doubled since the line reopened, according to the office."] * 40
    return toxicity.train(benign, ["You are a stupid moron. The council of town 5 reported that visits rose by 5 percent, and a study is planned for March."])


def test_examples_stand_in_no_table(spark):
    """Examples are written from grammars: none of five words or more occurs in the documents, whole texts included."""
    long = [" " + " ".join(_tokens(s)) + " " for s in (*confirmed(), *harmless()) if len(_tokens(s)) >= 5]
    for row in table(spark, "/root/testdata/sf0.01", "documents", "text").collect():
        text = " " + " ".join(_tokens(row.text)) + " "
        assert not any(s in text for s in long)


def test_one_fit_per_chunk_covers_all_documents(spark):
    """The mean of the chunks' fits is the fit itself where there is one chunk, wherever the documents lie."""
    rows = [(i, f"Visits to town {i} rose by {i} percent. A study is planned.") for i in range(300)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights, bias = toxicity.fitted(docs.coalesce(1), ["You are a stupid moron."])
    direct = toxicity.train([s for _, t in rows for s in toxicity.sentences(t)], ["You are a stupid moron."])
    assert np.allclose(weights, direct[0], atol=1e-9) and abs(bias - direct[1]) < 1e-9
    parts = toxicity.fitted(docs.repartition(3), ["You are a stupid moron."], chunk=100)
    assert toxicity.worst_margin("You are a stupid idiot", *parts)[0] > 0 > toxicity.worst_margin("Visits to town 5 rose", *parts)[0]
    assert toxicity.fitted(docs.limit(0), [])[1] == -1.0


@pytest.mark.parametrize("text", ["You are a stupid idiot.", "Y0u 4r3 4 $tup1d 1d10t.", "Shut up, you i m b e c i l e, nobody asked.", "HALT DEN MUND, DU ABSCHAUM!", "Good news. Their faith is a disease. Ban those who carry that faith."])
def test_toxic(classifier, text):
    assert toxicity.worst_margin(text, *classifier)[0] > 0


@pytest.mark.parametrize("text", [None, "", " \n", "The council of town 7 reported that visits rose by 7 percent.", "To stop the job, kill the process and restart the worker.", "The court in X ruled that calling a rival an idiot on air was not defamation.", "visits rose " * 20_000])
def test_harmless(classifier, text):
    assert toxicity.worst_margin(text, *classifier)[0] < 0


@pytest.mark.parametrize("around", [10, 100, 1000])
def test_toxic_inside_long_text_without_stops(around):
    toxic, weights = "you are a stupid idiot and a worthless moron", np.zeros(toxicity.FEATURES)
    harmless = [f"harmless{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2 * around)]
    for words, value in ((harmless, -0.1), (toxic.split(), 5.0)):
        weights[toxicity.Bags([words]).feature] = value
    assert toxicity.worst_margin(" ".join(harmless), weights, -6.0)[0] < 0
    assert toxicity.worst_margin(" ".join([*harmless[:around], toxic, *harmless[around:]]), weights, -6.0)[0] > 0


def test_windows_equal_bags_of_their_words():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=toxicity.FEATURES)
    texts = [[f"w{rng.integers(50)}" for _ in range(n)] for n in (3, 10, 11, 27, 0, 60)]
    bags = toxicity.Bags(texts)
    for length in (10, 5):
        rows, margins = bags.windows(weights, 0.5, length)
        want = [(k, t[i : i + length]) for k, t in enumerate(texts) if len(t) > length for i in range(0, len(t) - length // 2, length // 2)]
        assert list(rows) == [k for k, _ in want]
        assert np.allclose(margins, toxicity.Bags([w for _, w in want]).margins(weights, 0.5))


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "You are a stupid idiot.", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(3, None), (3, 1), (9, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs, labels).count() == 3
    assert toxicity.toxicity_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity_on_labels(spark):
    """Held-out accuracy: labels play no part in this fit beyond the sampled confirmed sentences; few labels are wrong."""
    path = "/root/testdata/sf0.01"
    docs, labels = table(spark, path, "documents"), table(spark, path, "labels")
    scores = toxicity.toxicity_scores(docs, labels.limit(0)).toPandas().set_index("doc_id").score
    truth = labels.where("toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("t")).toPandas().set_index("doc_id").t
    both = truth.to_frame().join(scores, how="inner")
    clean = both[both.t == 0]
    assert (clean.score < 0.5).mean() > 0.95


def test_document_queries_give_distinct_rows(spark, data):
    for name in ("p7_found", "p9_found"):
        out = queries.queries()[name](spark, data)
        assert out.count() == out.distinct().count(), name
    assert queries.p7_items(spark, data).where("documents < 1").count() == 0
    assert queries.p9_rates(spark, data).agg(F.sum("documents")).first()[0] == table(spark, data, "documents").count()
