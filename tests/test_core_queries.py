import pytest
from comparison import connection, rows

from cardloom.plans import core_queries

SQL = core_queries.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    got = core_queries.queries()[name](spark, data).toPandas()
    want = con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_only_times_lack_sql():
    assert set(core_queries.queries()) - set(SQL) == {"p1_found"}


def test_times_are_in_normal_form(spark, data):
    """What SQL would not express: every row is a value that differs from its normal form, which is a form of its own."""
    got = core_queries.queries()["p1_found"](spark, data).toPandas()
    cards = spark.read.parquet(f"{data}/evidence_cards.parquet").select("ingest_idx", "publication_date", "date", "collected_at").toPandas().set_index("ingest_idx")
    assert len(got) and not got.duplicated().any()
    assert got["normal"].str.fullmatch(r"\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}:\d{2}\.\d{6}Z)?)?)?").all()
    assert all(cards.at[i, f] not in (None, n) for i, f, n in got.itertuples(index=False))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
