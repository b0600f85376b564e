"""Steps whose tasks stay as large as they are when tables grow."""

from collections import Counter

from statloom.operators import relational as R
from statloom.plans import registry


def test_dealt_by_rows(spark):
    df = spark.range(1000)
    assert R.dealt(df, 4 * 10, ["id"], 10) is df  # four shuffle partitions are enough
    more = R.dealt(df, 1000, ["id"], 10)
    assert more.rdd.getNumPartitions() == 100 and more.count() == 1000


def test_pair_counts(spark):
    """Copies, null members, groups of one, rows without a group; a pair's both orders."""
    rows = [(1, 5), (1, 5), (1, 3), (1, None), (2, 5), (2, 3), (3, 3), (None, 3), (4, None), (4, None)]
    want = Counter((a, b) for g, a in rows for h, b in rows if g is not None and g == h)
    got = R.pair_counts(spark.createDataFrame(rows, "g int, x int"), "g", "x", len(rows))
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "int", "bigint"]
    assert {(r.a, r.b): r.n for r in got.collect()} == want and got.count() == len(want)


def test_pairs_are_dealt_by_rows(spark):
    got = R.pair_counts(spark.createDataFrame([(1, 2), (1, 3)], "g int, x int"), "g", "x", 10 << 17)
    assert got.rdd.getNumPartitions() == 10


def test_games_are_not_joined_with_ten(spark):
    """projected_participation makes at most three rows of a played game."""
    plan = registry.QUERIES["projected_participation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and plan.count("Join") == 1
