"""Runs bound to their inputs: names by hashes, staleness, refusals, and seasons from released runs."""

import pytest
from pyspark.sql import functions as F

from statloom.sources import files, lineage


def doubled(spark, inputs):
    return {"t": spark.read.parquet(inputs["rows"]).select((F.col("id") * 2).alias("id"))}


def summed(spark, inputs):
    return {"s": spark.read.parquet(f"{inputs['doubled']}/t.parquet").agg(F.sum("id").alias("total"))}


def test_graph(spark, tmp_path):
    rows, root = f"{tmp_path}/rows.parquet", f"{tmp_path}/runs"
    spark.range(5).coalesce(1).write.parquet(rows)
    # given out of order; each is named by what it reads
    stages = [lineage.Stage("summed", {"doubled": "doubled"}, summed), lineage.Stage("doubled", {"rows": rows}, doubled, {"penalty": 1})]
    made = lineage.run_all(spark, stages, root)
    assert spark.read.parquet(f"{made['summed']}/s.parquet").first().total == 20
    assert lineage.run_all(spark, stages, root) == made and lineage.stale(spark, made["summed"]) == []
    assert [(d, s, i) for d, s, i, _, _ in lineage.ancestry(spark, made["summed"])] == [(0, "summed", "doubled"), (1, "doubled", "rows")]
    other = lineage.run_stage(spark, lineage.Stage("doubled", {"rows": rows}, doubled, {"penalty": 2}), root)
    assert other != made["doubled"]
    spark.range(6).coalesce(1).write.mode("overwrite").parquet(rows)
    assert lineage.stale(spark, made["summed"]) == ["doubled/rows"] and lineage.stale(spark, made["doubled"]) == ["doubled/rows"]
    again = lineage.run_all(spark, stages, root)
    assert all(again[s] != made[s] for s in again) and lineage.stale(spark, again["summed"]) == []


def test_inputs_that_change_meanwhile_leave_no_run(spark, tmp_path):
    rows, root = f"{tmp_path}/rows.parquet", f"{tmp_path}/runs"
    spark.range(5).coalesce(1).write.parquet(rows)

    def meddled(spark, inputs):
        spark.range(7).coalesce(1).write.mode("overwrite").parquet(inputs["rows"])
        return {"t": spark.range(1)}

    with pytest.raises(OSError, match="changed while it worked"):
        lineage.run_stage(spark, lineage.Stage("meddled", {"rows": rows}, meddled), root)
    assert files.found(spark, f"{root}/meddled/*") == []
    with pytest.raises(FileNotFoundError):
        lineage.run_stage(spark, lineage.Stage("doubled", {"rows": f"{tmp_path}/none"}, doubled), root)
    with pytest.raises(ValueError, match="wait"):
        lineage.run_all(spark, [lineage.Stage("a", {"x": "b"}, doubled), lineage.Stage("b", {"x": "a"}, doubled)], root)


def season(spark, tmp_path, name, stints, poss, release="PASS"):
    tables = {"stints": spark.createDataFrame(stints, "game long, home_team long, away_team long, possessions long"), "possessions": spark.createDataFrame(poss, "game long, offense_team long, home_pts double, away_pts double")}
    return files.write_run(tables, f"{tmp_path}/{name}", {}, {"stage": "season", "season": "2023-24", "release": release, "paths": {}})


def test_load_season(spark, tmp_path):
    dates = spark.createDataFrame([(1, "2023-10-24"), (2, "2023-10-25")], "game long, day string")
    stints, poss = [(1, 10, 20, 3), (1, 10, 20, 1)], [(1, 10, 2.0, 0.0), (1, 20, 0.0, 3.0), (1, None, 0.0, 0.0), (1, 10, 2.0, 0.0), (2, 10, 1.0, 0.0)]
    kept, games, without = lineage.load_season(spark, season(spark, tmp_path, "ok", stints, poss), "2023-24", dates)
    assert kept.count() == 2 and [r.game for r in without.collect()] == [2]
    assert [(r.game, r.rows, r.target, r.home_team, r.away_team, r.day) for r in games.collect()] == [(1, 4, 25.0, 10, 20, "2023-10-24")]
    for name, s, p, release, wanted, why in (
        ("a", stints, poss, "FAIL", "2023-24", "released"), ("b", stints, poss, "PASS", "2022-23", "released"), ("c", [*stints, (1, 20, 10, 1)], poss, "PASS", "2023-24", "more than one pair"),
        ("d", stints, [*poss, (1, 30, 0.0, 0.0)], "PASS", "2023-24", "outside"), ("e", [*stints, (5, 10, 20, 1)], poss, "PASS", "2023-24", "without possessions"), ("f", [*stints, (6, 10, 20, 1)], [*poss, (6, 10, 1.0, 1.0)], "PASS", "2023-24", "no date"),
    ):
        with pytest.raises(ValueError, match=why):
            lineage.load_season(spark, season(spark, tmp_path, name, s, p, release), wanted, dates)
    run = season(spark, tmp_path, "g", stints, poss)
    part = next((tmp_path / "g").glob("*/stints.parquet/*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(OSError, match="changed"):
        lineage.load_season(spark, run, "2023-24", dates)
