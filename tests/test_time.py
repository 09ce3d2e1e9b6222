import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from cardloom.functions.timestamps import with_normal_form
from cardloom.operators.normalise_time import changed_times, normalised_times

CASES = [
    ("2017-04-17T12:24:07Z", "UTC", "DMY", "2017-04-17T12:24:07.000000Z"),
    (" 2017/04/17 12:24:07.294 ", "Europe/Berlin", "DMY", "2017-04-17T10:24:07.294000Z"),
    ("2020-03-23T07:01:05.205190250Z", "UTC", "DMY", "2020-03-23T07:01:05.205190Z"),
    ("2022-02-25t21:27:11z", "UTC", "DMY", "2022-02-25T21:27:11.000000Z"),
    ("2018-02-01 02:52:27 +0545", "UTC", "DMY", "2018-01-31T21:07:27.000000Z"),
    ("Fri, 02 Apr 2021 14:00:22 -0400", "UTC", "DMY", "2021-04-02T18:00:22.000000Z"),
    ("03/04/2021", "UTC", "DMY", "2021-04-03"),
    ("03/04/2021", "UTC", "MDY", "2021-03-04"),
    ("03/21/21", "UTC", "MDY", "2021-03-21"),
    ("03/21/21", "UTC", "DMY", None),
    ("27.06.2014, 16:50", "Asia/Kathmandu", "DMY", "2014-06-27T11:05:00.000000Z"),
    ("11/6/2016 1:49 AM", "America/New_York", "MDY", "2016-11-06T05:49:00.000000Z"),  # occurs twice: the first
    ("2021-03-28T02:30", "Europe/Berlin", "DMY", "2021-03-28T01:30:00.000000Z"),  # was skipped: an hour on
    ("10 de junio de 2023, 15:38 h", "Europe/Madrid", "DMY", "2023-06-10T13:38:00.000000Z"),
    ("29 novembre 2016 à 04h32", "Europe/Paris", "DMY", "2016-11-29T03:32:00.000000Z"),
    ("29. März 2020, 05:22 Uhr", "Europe/Berlin", "DMY", "2020-03-29T03:22:00.000000Z"),
    ("1er février 2020", "Europe/Paris", "DMY", "2020-02-01"),
    ("May 15, 2024 4:53 a.m. IST", "UTC", "DMY", "2024-05-14T23:23:00.000000Z"),
    ("12:00", "UTC", "DMY", None),
    ("2016-01-12 23:09:02 CST", "UTC", "DMY", "2016-01-13T05:09:02.000000Z"),
    ("1618229762", "UTC", "DMY", "2021-04-12T12:16:02.000000Z"),
    ("1480718740.583", "UTC", "DMY", "2016-12-02T22:45:40.583000Z"),
    ("1665960169907311", "UTC", "DMY", "2022-10-16T22:42:49.907311Z"),
    ("20191103 084813", "America/Chicago", "MDY", "2019-11-03T14:48:13.000000Z"),
    ("20160410", "UTC", "DMY", "2016-04-10"),
    ("2019-W45-7", "UTC", "DMY", "2019-11-10"),
    ("March 2022", "UTC", "DMY", "2022-03"),
    ("septiembre de 2016", "UTC", "DMY", "2016-09"),
    ("2020", "UTC", "DMY", "2020"),
    ("Tuesday, June 10th, 2014", "UTC", "DMY", "2014-06-10"),
    ("0000-00-00", "UTC", "DMY", None),
    ("2023-02-29", "UTC", "DMY", None),
    ("2024-13-05T10:00:00Z", "UTC", "DMY", None),
    ("2020-01-01 10:00:00 XYZ", "UTC", "DMY", None),
    ("2020-01-01 10:00:00", None, "DMY", None),
    ("2020-01-01 10:00:00", "Nowhere/Land", "DMY", None),
    ("unknown", "UTC", "DMY", None),
    ("", "UTC", "DMY", None),
    (" \t", "UTC", "DMY", None),
    ("x" * 20_000, "UTC", "DMY", None),
    ("=n|2020|1|1||||||", "UTC", "DMY", None),
]


@pytest.mark.parametrize("session_zone", ["UTC", "America/Los_Angeles"])
def test_normal_forms(spark, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, text string, zone string, ord string")
        got = {r.i: r.normal for r in with_normal_form(df, "text", "zone", "ord").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [got[i] for i in range(len(CASES))] == [c[3] for c in CASES]


def test_local_times_follow_zone_rules(spark):
    """Every half hour around both changes of a year, against the standard library."""
    zone = ZoneInfo("America/New_York")
    walls = [datetime.datetime(2019, 3, 9, 22) + datetime.timedelta(minutes=30 * k) for k in range(24)] + [datetime.datetime(2019, 11, 2, 22) + datetime.timedelta(minutes=30 * k) for k in range(24)]
    df = spark.createDataFrame([(i, w.isoformat(sep=" ")) for i, w in enumerate(walls)], "i int, text string").withColumns({"zone": F.lit("America/New_York"), "ord": F.lit("MDY")})
    got = {r.i: r.normal for r in with_normal_form(df, "text", "zone", "ord").collect()}
    for i, w in enumerate(walls):
        want = w.replace(tzinfo=zone, fold=0).astimezone(datetime.timezone.utc)
        assert got[i] == want.strftime("%Y-%m-%dT%H:%M:%S.000000Z"), w


def _cards(spark, rows):
    return spark.createDataFrame(rows, "ingest_idx long, source_domain string, url string, publication_date string, date string, collected_at string, normal string, zone string, site string")


def test_sites_nulls_and_clashing_columns(spark):
    profiles = spark.createDataFrame([("data.x.example", "America/New_York", "MDY"), ("x.example", "Europe/Berlin", "DMY")], "site string, home_zone string, date_order string")
    cards = _cards(
        spark,
        [
            (1, "WWW.X.example.", None, "01.02.2020, 10:00", None, "2020-01-01 10:00:00", "a", "b", "c"),
            (2, None, "https://www.data.x.example:443/p", "01/02/2020 10:00", "01/02/2020", None, None, None, None),
            (3, "  ", None, "2020-01-01 10:00", "2020-01-01", None, None, None, None),
        ],
    )
    got = {(r.ingest_idx, r.field): r.normal for r in changed_times(cards, profiles).collect()}
    assert got == {
        (1, "publication_date"): "2020-02-01T09:00:00.000000Z", (1, "collected_at"): "2020-01-01T10:00:00.000000Z",
        (2, "publication_date"): "2020-01-02T15:00:00.000000Z", (2, "date"): "2020-01-02",
    }
    assert normalised_times(cards.limit(0), profiles).count() == 0
    assert normalised_times(cards, profiles.limit(0)).count() == 6
