"""Scans over ranges, as-of joins, interval joins, lineups and quantiles against plain Python."""

import bisect
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import relational as R
from statloom.operators.numbering import numbered, ranged
from statloom.operators.scans import scan


def hot_rows(n=3000, seed=5):
    draw = random.Random(seed)
    return [(None if draw.random() < 0.02 else 1 if draw.random() < 0.9 else draw.randrange(9), draw.randrange(400), k, None if draw.random() < 0.3 else draw.randrange(50)) for k in range(n)]


@pytest.mark.parametrize("earlier", [False, True])
def test_scan(spark, earlier):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "key int, t int, id int, v int").repartition(7)
    c = F.col("v")
    got = {r["id"]: r for r in scan(df, ["key"], ["t", "id"], {"last": ("last", c), "total": ("sum", c), "most": ("max", c), "n": ("count", c)}, earlier).collect()}
    assert len(got) == len(rows)
    keys = defaultdict(list)
    for key, t, at, v in sorted(rows, key=lambda r: (r[1], r[2])):
        own = keys[key]
        seen = [x for x in own if x is not None] if earlier else [x for x in [*own, v] if x is not None]
        r = got[at]
        assert (r["last"], r["total"], r["most"], r["n"]) == (seen[-1] if seen else None, sum(seen) if seen else None, max(seen) if seen else None, len(seen))
        own.append(v)
    assert scan(df.limit(0), ["key"], ["t"], {"n": ("count", c)}).count() == 0


def test_a_key_with_most_rows_is_spread(spark):
    """No range, and so no task of the scan, has much more than its share, though nine tenths are of one key or all of one value."""
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("key"), F.col("id"), F.lit(1).alias("same"))
    for order in (["key", "id"], ["same"]):
        sizes = [r["count"] for r in ranged(df, order).groupBy("_range").count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 2 * 20_000 / 4
    places = sorted(r["place"] for r in numbered(df, ["same"], "place").collect())
    assert places == list(range(20_000))


def test_asof(spark):
    draw = random.Random(2)
    left = [(k, draw.choice([1, 1, 1, 2, None]), draw.choice([None, *range(60)])) for k in range(800)]
    right = [(draw.choice([1, 1, 2, None]), draw.choice([None, *range(60)]), k) for k in range(300)]
    a, b = spark.createDataFrame(left, "id int, key int, t int"), spark.createDataFrame(right, "key int, s int, v int")
    for r in R.asof_strict(a, b, "t", "s", ["key"], ["v"]).collect():
        before = [(s, v) for key, s, v in right if key is not None and key == r["key"] and s is not None and r["t"] is not None and s < r["t"]]
        assert (r["s"], r["v"]) == (max(before) if before else (None, None))
    dates = sorted({s for _, s, _ in right if s is not None})
    for most in (5000, 10):
        got = R.asof_broadcast(a, b, "t", "s", most).collect()
        assert len(got) == len(left)
        for r in got:
            at = bisect.bisect_left(dates, r["t"]) if r["t"] is not None else 0
            assert r["s"] == (dates[at - 1] if at else None)
    assert all(r["s"] is None for r in R.asof_broadcast(a, b.limit(0), "t", "s").collect())


def test_within_spans_of_any_length(spark):
    draw = random.Random(3)
    spans = [(draw.choice([1, 1, 2, None]), float(a := draw.randrange(1000)), a + draw.choice([0.25, 1.0, 2.0, 3.0, 17.0, 64.0, 500.0, -1.0, 0.0]), k) for k in range(200)] + [(1, -5.0, 3e7, 900), (2, None, 4.0, 901)]
    points = [(draw.choice([1, 2, None]), draw.choice([float(draw.randrange(1100)), draw.random() * 1000, None]), k) for k in range(500)]
    a, b = spark.createDataFrame(points, "key int, at double, p int"), spark.createDataFrame(spans, "key int, a double, b double, s int")
    got = {(r["p"], r["s"]) for r in R.within(a, b, ["key"], "at", "a", "b").collect()}
    assert got == {(p, s) for key, at, p in points for k, x, y, s in spans if key is not None and key == k and at is not None and x is not None and x <= at < y}
    assert R.within(a, b.limit(0), ["key"], "at", "a", "b").count() == 0


def test_a_long_span_adds_two_rows(spark):
    """Thirty million seconds among seconds: its level has two buckets at most."""
    spans = spark.range(99).select(F.lit(1).alias("key"), F.col("id").cast("double").alias("a"), (F.col("id") + 1.0).alias("b")).union(spark.createDataFrame([(1, 0.0, 3e7)], "key int, a double, b double"))
    joined = R.within(spark.createDataFrame([(1, 50.5)], "key int, at double"), spans, ["key"], "at", "a", "b")
    assert joined.count() == 2
    import re

    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "_level" in plan and not re.search("percentile", plan)


def test_linked(spark):
    stints = [(1, 10, p, 0.0, 100.0) for p in (5, 4, 3, 2, 1)] + [(1, 20, p, 0.0, 50.0) for p in (11, 12, 13, 14)] + [(1, 20, 15, 0.0, 20.0), (1, 10, 6, 90.0, 200.0), (1, 10, 7, None, 200.0)]
    stints += [(2, 10, p, 0.0, 100.0) for p in range(5)]
    events = [(1, 1, 0.0), (1, 2, 1.9), (1, 3, 2.0), (1, 4, 9.5), (1, 5, 30.0), (1, 6, None), (2, 7, 1.0), (3, 8, 1.0)]
    a, b = spark.createDataFrame(events, "game long, event long, event_time double"), spark.createDataFrame(stints, "game long, team long, player long, in_time double, out_time double")
    five, other = [1, 2, 3, 4, 5], [11, 12, 13, 14, 15]
    got = {r["event"]: (r["home_lineup"], r["away_lineup"], r["lineup_valid"]) for r in R.linked(a, b).collect()}
    assert got == {1: (five, other, True), 2: (five, other, True), 3: (five, [], False), 4: ([], [], False), 5: ([], [], False), 6: ([], [], False)}
    older = {r["event"]: (r["home_lineup"], r["away_lineup"], r["lineup_valid"]) for r in R.linked(a, b, both=True).collect()}
    assert older == got | {3: ([], [], False)}


def test_quantiles(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, 1.0, 1.0, 1.0, draw.random()]), None if k % 3 else float(k)) for k in range(900)] + [("empty", None, None), ("one", 4.0, None)]
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in R.many_quantiles(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], ["x", "y"], shares).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        for name, at in (("x", 1), ("y", 2)):
            values = [v[at] for v in rows if v[0] == g and v[at] is not None]
            assert r[name] == pytest.approx(np.quantile(values, shares).tolist()) if values else r[name] is None


def test_within_broadcasts_neither_side(spark):
    """Generated rows count once in Spark's sizes, so that either side may be many times what it is taken for."""
    spans = spark.createDataFrame([(1, 0.0, 3e7)], "key int, a double, b double")
    for points in (spark.createDataFrame([(1, 50.5)], "key int, at double"), spark.range(99).selectExpr("1 as key", "cast(id as double) as at")):
        joined = R.within(points, spans, ["key"], "at", "a", "b")
        assert joined.count() == points.count()
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_within_makes_a_point_for_two_powers_of_two(spark):
    """Spans of 1 to 2^20 seconds have eleven levels, and a point as many rows, not twenty-one."""
    spans = spark.range(21).selectExpr("1 as key", "0.0D as a", "pow(2.0D, id) as b")
    joined = R.within(spark.createDataFrame([(1, 0.5)], "key int, at double"), spans, ["key"], "at", "a", "b")
    assert joined.count() == 21
    generated = joined._jdf.queryExecution().analyzed().toString()
    assert "array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)" in generated
