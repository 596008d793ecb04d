import pytest

from ballast.plans import oracle, queries
from ballast.sources import files
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    with files.cleared(spark):
        assert compare(spark, con, SF, queries.queries()[name], SQL[name]) is None
    spark.catalog.clearCache()


#: Tested against plain code in test_boosting.py.
BEYOND_SQL = {"ball_boosted_probs"}


def test_every_query_has_sql():
    assert set(queries.queries()) == set(SQL) | BEYOND_SQL


def test_report_round_trip(spark):
    from pyspark.sql import functions as F

    from ballast.sources import reports

    lines = queries.analysis_report_lines(spark, SF)
    bets = reports.parse_bets(lines.withColumn("path", F.lit("r"))).collect()
    assert sum(b.kind == "single" for b in bets) == 10
    (duplex,) = [b for b in bets if b.kind == "duplex"]
    assert len(duplex.reds) == 7 and len(duplex.blues) == 7 and duplex.reds == sorted(duplex.reds)
    spark.catalog.clearCache()
