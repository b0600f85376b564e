"""The report of a track on a fixture: sections, constants, empty phases."""

import numpy as np
import pytest

from statloom.operators.report import track_report

SCHEMA = "id long, season int, phase string, matched boolean, actual double, home double, weekly double, early boolean"


def report(spark, rows):
    return {(r.section, r.variant, r.key, r.model, r.measure): r.value for r in track_report(spark.createDataFrame(rows, SCHEMA), ["home", "weekly"], "home", "weekly", ["early"]).collect()}


def test_report(spark):
    rows = [(k, 2000 + k // 20, "development" if k < 40 else "holdout", k % 7 != 0, 2.0 * k + 3 + (k % 3), 1.0, float(k), [True, False, None][k % 3]) for k in range(80)]
    got = report(spark, rows)
    kept = [r for r in rows if r[3]]
    dev, hold = [r for r in kept if r[2] == "development"], [r for r in kept if r[2] == "holdout"]
    assert got["population", "", "holdout", "", "rows"] == 40 and got["population", "", "holdout", "", "matched"] == len(hold)
    y, f = np.array([r[4] for r in dev]), np.array([r[6] for r in dev])
    h = (y - f).mean()
    assert got["frozen", "", "", "weekly", "h"] == pytest.approx(h) and got["frozen", "", "", "weekly", "q10"] == pytest.approx(np.quantile(y - f, 0.1) - h)
    b, a = np.polyfit(f, y, 1)
    assert got["scale", "", "", "weekly", "b"] == pytest.approx(b) and ("scale", "", "", "home", "b") not in got
    z, g = np.array([r[4] for r in hold]), np.array([r[6] for r in hold])
    assert got["point", "frozen", "", "weekly", "rmse"] == pytest.approx(np.sqrt(((g + h - z) ** 2).mean())) and got["point", "rescaled", "", "weekly", "rmse"] == pytest.approx(np.sqrt(((a + b * g - z) ** 2).mean()))
    assert got["point", "frozen", "", "home", "correlation"] is None and got["point", "frozen", "", "weekly", "correlation"] == pytest.approx(np.corrcoef(z, g)[0, 1])
    assert got["point", "frozen", "", "home", "rmse"] == got["point", "rescaled", "", "home", "rmse"]
    assert got["subgroup", "", "early", "weekly", "n"] == sum(r[7] is True for r in hold) and sum(v for k, v in got.items() if k[0] == "calibration" and k[4] == "n") == len(hold)
    assert sum(v for k, v in got.items() if k[:2] == ("season", "frozen") and k[3:] == ("weekly", "n")) == len(hold)


def test_no_holdout(spark):
    got = report(spark, [(1, 2000, "development", True, 1.0, 1.0, 2.0, True), (2, 2000, "holdout", False, None, None, None, None)])
    assert {k[0] for k in got} == {"population", "frozen", "scale"} and got["population", "", "holdout", "", "matched"] == 0


def test_constants_of_many_parts(spark):
    """The deviation of a constant, put together of parts, may be a little above 0: the line and the correlation are null all the same."""
    from pyspark.sql import functions as F

    from statloom.functions.scalars import correlation
    from statloom.operators.forecasts import point_metrics

    x = 150.0 + 100 / 3
    n = next(n for n in range(2, 1000) if x / n * n != x)  # rows of a part whose mean, put together, isn't x
    rows = spark.range(0, 8 * n, 1, 8).select(F.lit(1).alias("h"), F.lit(x).alias("forecast"), (F.col("id") * 7919 % 101).cast("double").alias("actual"))
    assert rows.groupBy("h").agg(F.stddev_pop(F.col("forecast")).alias("s")).first()["s"] > 0
    for r in point_metrics(rows, ["h"]).collect():
        assert (r["correlation"], r["slope"], r["intercept"]) == (None, None, None) and r["rmse"] > 0
    assert [r[1] for r in rows.groupBy("h").agg(correlation(F.col("forecast"), F.col("actual"))).collect()] == [None]
