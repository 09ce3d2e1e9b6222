import random

from cardloom.operators.near_duplicates import components, exact_classes, near_duplicate_classes, similar_pairs
from cardloom.operators.neighbours import nearest


def _texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(40)]
        out.append(base)
        for _ in range(rng.randrange(3)):
            changed = list(base)
            for _ in range(rng.randrange(3)):
                changed[rng.randrange(40)] = rng.choice(words)
            out.append(changed)
    return [" ".join(t) for t in out] + ["", "too few words", " ".join(out[0])]


def test_hot_shingles_are_split_without_loss(spark, monkeypatch):
    from cardloom.operators import near_duplicates

    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty and so on it goes for all of them"
    docs = spark.createDataFrame([(i, f"{base} x{i}") for i in range(40)], "doc_id long, text string")
    whole = {tuple(r) for r in similar_pairs(docs).collect()}
    monkeypatch.setattr(near_duplicates, "HOT", 7)
    assert {tuple(r) for r in similar_pairs(docs).collect()} == whole and len(whole) == 40 * 39 // 2


def test_sets_do_not_go_through_the_driver(spark, data):
    """Their size is estimated too low, from that of the files, so no join may choose a broadcast by it."""
    pairs = similar_pairs(spark.read.parquet(f"{data}/documents.parquet"))
    joins = [line for line in pairs._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert any("SortMergeJoin" in line for line in joins)
    assert all("__word" in line for line in joins if "Broadcast" in line)  # bitmaps have a fixed size


def test_pairs_equal_brute_force(spark):
    texts = _texts()
    docs = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in enumerate(texts)}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8} if sets else set()
    assert {(r.a, r.b) for r in similar_pairs(docs).collect()} == want


def test_classes_and_links(spark):
    texts = _texts()
    docs = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicate_classes(docs).collect()}
    assert len(got) == len(texts) and 900 not in got
    assert got[len(texts) - 1].class_id == got[0].class_id and got[len(texts) - 1].links == got[0].links
    assert near_duplicate_classes(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100


def test_exact_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.copies) for r in exact_classes(docs).collect()} == {(1, 1, 2), (3, 1, 2), (2, 2, 1), (5, 5, 1)}


def test_neighbours_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(150, 8)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, None), (500, [0.0] * 8)], "vec_id long, embedding array<float>").repartition(5)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = nearest(df, 4, every=50).toPandas()
    for q in (0, 50, 100):
        scores = np.round((unit @ unit[q]).astype("float64"), 6)
        scores[q] = -9
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == np.argsort(-scores, kind="stable")[:4].tolist()


def test_disagreements_equal_brute_force(spark):
    from itertools import combinations

    from cardloom.operators.evidence import consensus, numeric_disagreements

    rng = random.Random(9)
    rows = [(f"m{rng.randrange(40)}", "", "2020", f"d{rng.randrange(4)}", float(rng.choice([10, 10.5, 11, 12, 30]))) for _ in range(150)]
    df = spark.createDataFrame(rows, "metric string, unit string, period string, domain string, value double")
    want = {a[0] for a, b in combinations(rows, 2) if a[0] == b[0] and a[3] != b[3] and abs(a[4] - b[4]) > 0.1 * max(a[4], b[4], 1.0)}
    assert {r.metric for r in numeric_disagreements(df).collect()} == want
    arrivals = spark.createDataFrame([("arrivals", "", "2024", d, v) for d, v in [("a", 5.0), ("b", 5.1), ("c", 9.0)]], df.schema)
    row = consensus(arrivals).first()
    assert (row.median, row.support, row.dissent, row.domains, row.triangulated) == (5.1, 2, 1, 3, True)
    assert consensus(arrivals.limit(0)).count() == numeric_disagreements(arrivals.limit(0)).count() == 0
