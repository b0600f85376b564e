"""Steps whose time and tasks must not grow faster than their tables."""

from pyspark.sql import functions as F

from compare import expected, rows_of
from statloom.operators import events as EV
from statloom.operators import legacy as L
from statloom.operators import relational as R
from statloom.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_dealt_where_shuffle_partitions_are_many(spark):
    """Adaptive execution puts small partitions together until there is one a core, so that 40 of them would end as four."""
    df, before = spark.range(1000), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert R.dealt(df, 60, ["id"], 10).rdd.getNumPartitions() == 40
        assert R.dealt(df, 40, ["id"], 10) is df
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stint_sides_neither_sort_nor_keep_the_roster(spark):
    """Repeated and unknown rows of a roster, a game without a home team, one without an away team, and one whose sides are of one team."""
    possessions = spark.createDataFrame([(g, at, [h], [a]) for g, at, h, a in [(1, 2, 9, 9), (1, 1, 1, 2), (2, 1, 7, 2), (3, 1, 1, 7), (4, 1, 1, 2), (None, 1, 1, 2), (5, 1, None, 2)]], "game long, at long, offense_lineup array<long>, defense_lineup array<long>")
    roster = [(g, p, t) for g in (1, 2, 3, 5, None) for p, t in [(1, 10), (1, 10), (1, None), (2, 20), (2, 19), (9, 30), (None, 40)]] + [(4, 1, 10), (4, 2, 10)]
    sides = L.stint_sides(possessions, spark.createDataFrame(roster, "game long, player long, team long"))
    assert {r.game: (r.home_team, r.away_team) for r in sides.collect()} == {1: (10, 20), 3: (10, 0), 4: (10, 0)}
    plan = sides._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_unknown_players_of_a_lineup_stay_last(spark):
    rows = [(1, 1, [3, None, 1, 2, 4], [9, 8, 7, 6, 5], 2, 10, 10, 1.0)]
    schema = "game long, at long, offense_lineup array<long>, defense_lineup array<long>, points long, scoring_team long, offense_team long, duration double"
    (r,) = L.legacy_stints(spark.createDataFrame(rows, schema), spark.createDataFrame([(1, 3, 10)], "game long, player long, team long"), 1).collect()
    assert (r.home_lineup, r.away_lineup) == ([1, 2, 3, 4, None], [5, 6, 7, 8, 9])


def test_logs_are_dealt_by_rows(spark, monkeypatch):
    """A task sorts no more rows of a longer log; the same rows come out."""
    monkeypatch.setattr(EV, "EACH", 50)
    n = spark.read.parquet(f"{SMALL}/events.parquet").count()
    made = registry.QUERIES["normalized_events"](spark, SMALL)
    assert made.rdd.getNumPartitions() == -(-n // 50) > 4
    for name in ("normalized_events", "game_status"):
        assert rows_of(registry.QUERIES[name](spark, SMALL).toPandas()) == expected(registry.SQL[name], SMALL)


def test_the_end_of_the_last_period_takes_no_window(spark):
    """The last period in which anything but a marker happens, though a marker follows it; rows without a game have no status."""
    rows = [(g, k, p, 4.0 * k, a, end) for g in ("1", None) for k, (p, a, end) in enumerate([(1, "made_shot", False), (1, "period", True), (2, "missed_shot", False), (2, "period", True), (2, "made_shot", False), (3, "period", False)])]
    norm = spark.createDataFrame(rows, "GAME_ID string, SEQ int, PERIOD int, ELAPSED double, ACTION string, PERIOD_END boolean")
    none = F.lit(None).cast("double")
    norm = norm.withColumns({"SCORE_HOME": F.lit(2.0), "SCORE_AWAY": F.lit(0.0), "OBS_SCORE_HOME": none, "OBS_SCORE_AWAY": none, "SCORING_UNRESOLVED": F.lit(False), "ORDER_INVERSION": F.lit(False), "FT_MADE": F.lit(None).cast("boolean")})
    status = EV.game_status(norm, spark.createDataFrame([("1", 2, 0)], "GAME_ID string, HOME_PTS int, AWAY_PTS int"))
    assert [(r.HAS_PERIOD_END, r.REASON) for r in status.collect()] == [(True, "final_score_mismatch_box; scoring_after_final_period_end")]
    windows = status._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows == 3  # those of the scoreboard's periods


def test_accounting_is_dealt_once(spark, monkeypatch):
    """Lines are dealt out by games and their rows, and meet their box and periods there; the same rows come out."""
    from statloom.plans import contracts

    monkeypatch.setattr(contracts, "dealt", lambda df, rows, keys, each=0: R.dealt(df, rows, keys, 500))
    made = registry.QUERIES["game_accounting"](spark, SMALL)
    assert made.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 500) > 4
    for name in ("game_accounting", "released_seasons", "season_summary"):
        assert rows_of(registry.QUERIES[name](spark, SMALL).toPandas()) == expected(registry.SQL[name], SMALL)


def test_members_are_dealt_by_rows(spark, monkeypatch):
    """Ratings sent to all tasks, or not: members are dealt out by games and their rows, and none is gathered in an array."""
    from statloom.plans import details

    deal = R.dealt
    monkeypatch.setattr(R, "dealt", lambda df, rows, keys, each=0: deal(df, rows, keys, 500))
    for most in (1 << 20, 0):
        monkeypatch.setattr(details, "MOST_RATED", most)
        made = registry.QUERIES["lineup_strength"](spark, SMALL)
        assert made.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 500) > 4
        assert "collect_set" not in made._jdf.queryExecution().optimizedPlan().toString()
        assert rows_of(made.toPandas()) == expected(registry.SQL["lineup_strength"], SMALL)


def test_bins_rise_with_values(spark):
    inf = float("inf")
    values = [-inf, -1e308, -2.5, -1.0, -0.3, -5e-324, 0.0, 5e-324, 1e-300, 0.3, 1.0, 1.0000000000000002, 2.5, 1e308, inf, float("nan")]
    bins = [r.b for r in spark.createDataFrame(list(enumerate(values)), "k int, v double").select("k", R.size_bin(F.col("v")).alias("b")).orderBy("k").collect()]
    assert bins == sorted(bins) and bins[6] == 0 and len(set(bins)) >= 14


def test_only_values_beside_a_quantile_are_numbered(spark, monkeypatch):
    """Of 4000 values the scan sees those of the bins with a wanted rank; where groups are many, all of them; both give the same."""
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), (F.col("id") - 1000.0).alias("v"))
    seen, scan = [], R.scan
    monkeypatch.setattr(R, "scan", lambda rows, *a: (seen.append(rows.count()), scan(rows, *a))[1])
    got = []
    for few in (1 << 17, 0):
        monkeypatch.setattr(R, "FEW", few)
        got.append({r.g: r.v for r in R.many_quantiles(df, ["g"], ["v"], [0.0, 0.1, 0.5, 1.0]).collect()})
    assert got[0] == got[1] and got[0][0] == [-1000.0, -1000 + 0.1 * 3998, 999.0, 2998.0]
    assert seen[0] < 200 and seen[1] == 4000


def test_games_of_a_season_are_worked_out_once(spark, monkeypatch):
    from statloom.operators import coverage

    names = []
    monkeypatch.setattr(coverage, "stored", lambda df, name: (names.append(name), df)[1], raising=False)
    assert rows_of(registry.QUERIES["season_coverage"](spark, SMALL).toPandas()) == expected(registry.SQL["season_coverage"], SMALL)
    assert names == ["covered-games"]
