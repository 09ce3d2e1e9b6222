import json

from pyspark.sql import functions as F

from cardloom.functions import html, privacy, text
from cardloom.functions.sites import host_of
from cardloom.sources import files
from cardloom.sources.tables import table
from cardloom.streaming import costs


def test_json_round_trip(spark, data, tmp_path):
    cards = table(spark, data, "evidence_cards")
    files.write_cards(cards, str(tmp_path / "ok"), str(tmp_path / "bad"))
    back = files.read_cards(spark, str(tmp_path / "ok"))
    assert back.count() + spark.read.json(str(tmp_path / "bad")).count() == cards.count() if (tmp_path / "bad").exists() and any((tmp_path / "bad").glob("part*.json")) else back.count() == cards.count()
    files.export_parquet(back, str(tmp_path / "cards.parquet"))
    assert spark.read.parquet(str(tmp_path / "cards.parquet")).count() == back.count()


def test_broken_lines_and_errors(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"id": "x", "url": "https://a.example/", "title": "T", "extra": 1}\nnot json\n')
    cards = files.read_cards(spark, str(tmp_path / "in.json")).cache()
    assert cards.where("_corrupt is not null").count() == 1
    files.write_cards(cards, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "bad")).count() == 2


def test_rankings_and_hits(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1,A.example\nx,y\n2,b.example\n")
    assert [(r.rank, r.domain) for r in files.read_rankings(spark, str(tmp_path / "r.csv")).orderBy("rank").collect()] == [(1, "a.example"), (2, "b.example")]
    hits = spark.createDataFrame([("T", "https://a.example", None, "2020"), ("U", None, "s", None)], "title string, url string, snippet string, published_at string")
    assert files.cards_from_hits(hits, "p").count() == 1


def test_web_archive(spark, tmp_path):
    body = b"hello"
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: https://a.example\r\nContent-Length: 5\r\n\r\n" + body + b"\r\n\r\nWARC/1.0\r\nWARC-Type: broken\r\n")
    got = files.read_warc(spark, str(tmp_path / "a.warc")).collect()
    assert [(r.kind, r.url, bytes(r.payload)) for r in got] == [("response", "https://a.example", body)]


def test_pages(spark):
    source = "<html><head><title>A  b</title><meta name='date' content='2020-01-01'></head><body><nav>Menu</nav><p>Main text.</p><script>var x='</p>'</script><a href='/x'>Link here</a></body>"
    df = spark.createDataFrame([(source,), (None,), ("<div",)], "h string")
    got = [r.p for r in df.select(html.parsed_page(F.col("h")).alias("p")).collect()]
    assert (got[0].title, got[0].date, got[0].links) == ("A b", "2020-01-01", 1) and "Main text." in got[0].text and "Menu" not in got[0].text and "var" not in got[0].text
    assert got[1].text == ""


def test_text_scalars(spark):
    df = spark.createDataFrame([("Mail me@x.example or 555-123-4567 <b>now</b> https://a.example/x",), (None,)], "t string")
    rows = df.select(privacy.redacted(F.col("t")).alias("r"), text.cleaned(F.col("t")).alias("c"), text.truncated(F.col("t"), 10).alias("s")).collect()
    assert rows[0].r.startswith("Mail [EMAIL] or [PHONE]") and rows[0].c == "Mail or 555-123-4567 now" and rows[0].s == "Mail me..." and rows[1].r is None and rows[1].c == ""
    hosts = [" health.x.example", "X.EXAMPLE:443", "https://www.x.example/a?b", "x.example.", "x.example/", "user@x.example", "", None]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(host_of(F.col("h"))).collect()]
    assert got == ["health.x.example", "x.example", "x.example", "x.example", "x.example", "x.example", None, None]


def test_windowed_costs_as_stream(spark, tmp_path):
    rows = [("a", "p", 1.0, "2024-01-01 00:10:00"), ("a", "p", 1.0, "2024-01-01 00:10:00"), ("b", "p", 2.0, "2024-01-01 00:50:00"), ("c", "q", 4.0, "2024-01-01 01:10:00"), ("z", "q", 0.0, "2024-01-05 00:00:00")]
    src = spark.createDataFrame(rows, "id string, provider string, cost_usd double, recorded_at string").withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    query = costs.windowed_costs(stream).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(str(r.start), r.provider, r.records, r.cost) for r in spark.table("w").collect()}
    assert got == {("2024-01-01 00:00:00", "p", 2, 3.0), ("2024-01-01 01:00:00", "q", 1, 4.0)}


def test_sessions(spark):
    rows = [(1, f"2024-01-01 00:{m:02d}:00") for m in (0, 5, 30)]
    events = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.events for r in costs.sessions(events, "user_id", "ts").collect()) == [1, 2]


def test_breaker(spark, tmp_path):
    assert costs.breaker_step(0, 0.0, [(1, True), (2, True), (3, True), (4, False), (904, True)], 3, 900) == (1, 903, 1)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"provider": p, "at": float(t), "failed": f}) for p, t, f in [("a", 1, True), ("a", 2, True), ("a", 3, True), ("a", 5, False), ("b", 1, False)]))
    stream = spark.readStream.schema("provider string, at double, failed boolean").json(str(tmp_path / "in"))
    query = costs.breaker_states(stream).writeStream.format("memory").queryName("b").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.provider, r.open_until, r.refused) for r in spark.table("b").collect()} == {("a", 903.0, 1), ("b", 0.0, 0)}
