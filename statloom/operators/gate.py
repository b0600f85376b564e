"""The independent gate of a run: checks that share nothing with the code that wrote it.

Tables, by name: game_status, possessions, segments, stints, exclusions,
excluded_possessions, excluded_events, team_game (the raw box), all with the columns of
FIXTURES F9 to F12. Each check is a count of what breaks it; an empty table breaks none
but the cohort's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import padded_id

# Reasons that may be declared, those of removals for alternation, outcomes that give the ball away, control actions.
EXCLUDABLE = {
    "no_bronze_pbp": "source-absence-v1", "link_empty": "source-absence-v1", "no_events_in_source": "source-absence-v1",
    "source_order_unresolvable": "source-order-v1", "source_possession_unlogged": "source-absence-v2",
}
ALTERNATION = ["source_order_unresolvable", "source_possession_unlogged", "possession_alternation_unexplained"]
TRANSFERS = ["made_shot", "and_one", "turnover", "defensive_rebound", "free_throw_made"]
CONTROL = ["made_shot", "missed_shot", "turnover"]


def team_counts(possessions: DataFrame, by: list[str]) -> DataFrame:
    """by.., na, nb: possessions of a game's two teams, the one of the smaller id first."""
    known = possessions.where("OFFENSE_TEAM_ID is not null")
    first = known.groupBy("GAME_ID").agg(F.min("OFFENSE_TEAM_ID").alias("_a"), F.max("OFFENSE_TEAM_ID").alias("_b"))
    return known.join(first, "GAME_ID").groupBy("GAME_ID", *by).agg(F.count_if(F.col("OFFENSE_TEAM_ID") == F.col("_a")).alias("na"), F.count_if((F.col("OFFENSE_TEAM_ID") == F.col("_b")) & (F.col("_a") != F.col("_b"))).alias("nb"))


def accounting_rows(possessions: DataFrame, box: DataFrame, periods: DataFrame) -> DataFrame:
    """The accounting of each game that has a box record of both teams and possessions, the team of the smaller id first. Points are
    credited to the scoring team, else to the offence; possessions without an offence, and points without either, are unattributed.
    possessions: game, offense_team, scoring_team, points; box: game, season, team, pts; periods: game, periods (null if not known)."""
    teams = box.groupBy("game", "season").agg(F.count("*").alias("_n"), F.min("team").alias("a"), F.max("team").alias("b"), F.min_by("pts", "team").alias("box_a"), F.max_by("pts", "team").alias("box_b")).where("_n = 2 and a < b")
    # hashed by games, as possessions and box may lie: a task sorts neither of them
    rows = possessions.join(teams.hint("shuffle_hash"), "game")
    credit = F.coalesce("scoring_team", "offense_team")
    scored = lambda team: F.sum(F.when((credit == F.col(team)) & (F.col("points") > 0), F.col("points")).otherwise(0)).cast("double")
    said = rows.groupBy("game", "season", "a", "b", "box_a", "box_b").agg(
        scored("a").alias("PBP_PTS_A"), scored("b").alias("PBP_PTS_B"), F.count_if(F.col("offense_team") == F.col("a")).alias("POSS_A"), F.count_if(F.col("offense_team") == F.col("b")).alias("POSS_B"),
        F.count_if(F.col("offense_team").isNull()).alias("UNATTRIBUTED_POSS"), F.sum(F.when(credit.isNull() & (F.col("points") > 0), F.col("points")).otherwise(0)).cast("double").alias("UNATTRIBUTED_PTS"))
    return said.join(periods.hint("shuffle_hash"), "game", "left").select(
        padded_id(F.col("game")).alias("GAME_ID"), F.col("season").alias("SEASON_ID"), F.col("periods").alias("PERIODS"), "PBP_PTS_A", "PBP_PTS_B", F.col("box_a").cast("double").alias("BOX_PTS_A"), F.col("box_b").cast("double").alias("BOX_PTS_B"),
        "POSS_A", "POSS_B", "UNATTRIBUTED_POSS", "UNATTRIBUTED_PTS")


def game_accounting(games: DataFrame) -> DataFrame:
    """The release predicate of each game: reconciled by side, all attributed, counts apart by at
    most the periods; what is unknown isn't valid."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    out = games.withColumn("SCORING_RECONCILED", sure((F.col("PBP_PTS_A") == F.col("BOX_PTS_A")) & (F.col("PBP_PTS_B") == F.col("BOX_PTS_B"))))
    out = out.withColumn("ATTRIBUTION_COMPLETE", sure((F.col("UNATTRIBUTED_POSS") == 0) & (F.col("UNATTRIBUTED_PTS") == 0)))
    out = out.withColumn("ALTERNATION_OK", sure(F.abs(F.col("POSS_A") - F.col("POSS_B")) <= F.col("PERIODS")))
    return out.withColumn("GAME_VALID", F.col("SCORING_RECONCILED") & F.col("ATTRIBUTION_COMPLETE") & F.col("ALTERNATION_OK"))


def season_release(accounting: DataFrame, expected: DataFrame, declared: DataFrame) -> DataFrame:
    """A row for each expected season with its counts and status. expected: SEASON_ID, GAME_ID;
    declared: GAME_ID, DECLARED, ACTUAL. An exclusion counts only if both reasons agree and may
    be declared; games outside the expected cohort fail the season."""
    a = game_accounting(accounting).select("GAME_ID", F.col("SEASON_ID").alias("_season"), "GAME_VALID")
    accepted = F.coalesce((F.col("DECLARED") == F.col("ACTUAL")) & F.col("DECLARED").isin(*EXCLUDABLE), F.lit(False))
    d = declared.groupBy("GAME_ID").agg(F.bool_and(accepted).alias("accepted"))
    met = expected.select("GAME_ID", "SEASON_ID").join(a, "GAME_ID", "full").join(d, "GAME_ID", "left")
    met = met.withColumn("wanted", F.col("SEASON_ID").isNotNull()).withColumn("here", F.col("GAME_VALID").isNotNull()).withColumn("out", F.coalesce("accepted", F.lit(False)) & F.col("wanted"))
    kept = F.col("here") & ~F.col("out")
    seasons = met.groupBy(F.coalesce("SEASON_ID", "_season").alias("SEASON_ID")).agg(
        F.count_if("wanted").alias("expected_games"), F.count_if(F.col("wanted") & kept).alias("present_games"), F.count_if(F.col("wanted") & ~F.col("out") & ~F.col("here")).alias("missing_games"),
        F.count_if(~F.col("wanted") & kept).alias("unexpected_games"), F.count_if("out").alias("excluded_games"), F.count_if(F.col("wanted") & (~F.col("accepted"))).alias("rejected_exclusions"), F.count_if(kept & ~F.col("GAME_VALID")).alias("invalid_games"),
    )
    bad = F.col("missing_games") + F.col("unexpected_games") + F.col("rejected_exclusions") + F.col("invalid_games") > 0
    return seasons.where("expected_games > 0").withColumn("status", F.when(bad, "FAIL").when(F.col("excluded_games") > 0, "PASS_WITH_EXCLUSIONS").otherwise("PASS"))


def table_checks(t: dict[str, DataFrame], cohort: DataFrame, declared: DataFrame) -> DataFrame:
    """check, broken: how many rows or games break each check of the tables. cohort: GAME_ID;
    declared: GAME_ID, DECLARED of the accepted exclusions."""
    status, poss, segments, stints = t["game_status"], t["possessions"], t["segments"], t["stints"]
    ep, ee = t["excluded_possessions"], t["excluded_events"]
    admitted = status.where("STATUS = 'ADMITTED'").select("GAME_ID")
    made: list[DataFrame] = []  # fixed values: the checks' names

    def check(name: str, rows: DataFrame) -> None:
        made.append(rows.agg(F.count("*").alias("broken")).select(F.lit(name).alias("check"), "broken"))

    ids = status.select("GAME_ID").distinct()
    check("every_cohort_game_has_a_status", ids.join(cohort.select("GAME_ID", F.lit(1).alias("c")), "GAME_ID", "full").join(ids.withColumn("s", F.lit(1)), "GAME_ID", "left").where("c is null or s is null"))
    check("quarantine_has_reason", status.where("STATUS <> 'ADMITTED' and coalesce(REASON, '') = ''"))
    check("only_admitted_games_reconstructed", poss.join(admitted, "GAME_ID", "left_anti"))
    order = Window.partitionBy("GAME_ID").orderBy("START_SEQ")
    check("possessions_tile_each_game", poss.withColumn("before", F.lag("END_SEQ").over(order)).where("before is not null and START_SEQ <> before + 1"))
    box = t["team_game"].groupBy(F.lpad(F.col("GAME_ID").cast("string"), 10, "0").alias("GAME_ID")).agg(
        F.sum(F.when(F.col("MATCHUP").contains(" vs. "), F.col("PTS")).cast("double")).alias("bh"), F.sum(F.when(F.col("MATCHUP").contains(" @ "), F.col("PTS")).cast("double")).alias("ba"))
    scored = poss.groupBy("GAME_ID").agg(F.sum("HOME_PTS").alias("h"), F.sum("AWAY_PTS").alias("a"))
    sides = admitted.join(scored, "GAME_ID", "left").join(box, "GAME_ID", "left")
    check("admitted_points_equal_box_by_side", sides.where(~F.col("h").eqNullSafe(F.col("bh")) | ~F.col("a").eqNullSafe(F.col("ba"))))
    keys = ["GAME_ID", "PERIOD", "POSS_IDX"]
    parts = segments.groupBy(*keys).agg(F.sum("HOME_PTS").alias("sh"), F.sum("AWAY_PTS").alias("sa"), F.sum("POSS_COUNT").alias("sc"))
    met = poss.select(*keys, "HOME_PTS", "AWAY_PTS", F.lit(1).alias("p")).join(parts, keys, "full")
    check("segments_sum_to_possessions", met.where("p is null or sc is null or sh <> HOME_PTS or sa <> AWAY_PTS or sc <> 1"))
    chain = segments.groupBy("GAME_ID").agg(F.sum("POSS_COUNT").alias("c"), F.sum("HOME_PTS").alias("h"), F.sum("AWAY_PTS").alias("a"))
    chain = chain.join(stints.groupBy(F.col("game_id").alias("GAME_ID")).agg(F.sum("possessions").alias("tc"), F.sum("home_points").alias("th"), F.sum("away_points").alias("ta")), "GAME_ID", "left")
    chain = chain.join(t["exclusions"].groupBy("GAME_ID").agg(F.sum("EXCLUDED_POSS").alias("xc"), F.sum("EXCLUDED_HOME_PTS").alias("xh"), F.sum("EXCLUDED_AWAY_PTS").alias("xa")), "GAME_ID", "left")
    check("stints_plus_exclusions_equal_segments", chain.where(" or ".join(f"{k} <> coalesce(t{k}, 0) + coalesce(x{k}, 0)" for k in "cha")))
    rate = F.col("net_rating_per_100")
    check("stint_rates_finite_or_nan", stints.where((F.abs(rate) == F.lit(float("inf"))) | ((F.col("possessions") == 0) & rate.isNotNull() & ~F.isnan(rate))))
    check("every_possession_attributed", poss.where("OFFENSE_TEAM_ID is null"))
    periods = poss.groupBy("GAME_ID").agg(F.count_distinct("PERIOD").alias("periods"))
    check("possession_alternation_within_periods", team_counts(poss, []).join(periods, "GAME_ID").where("abs(na - nb) > periods"))
    check("possession_alternation_per_period", team_counts(poss, ["PERIOD"]).where("abs(na - nb) > 1").select("GAME_ID").distinct())
    said = declared.join(status.select("GAME_ID", "REASON"), "GAME_ID", "left")
    check("exclusions_are_declared_and_excludable", said.where(~F.coalesce(F.col("REASON").isin(*EXCLUDABLE) & (F.col("REASON") == F.col("DECLARED")), F.lit(False))))

    used = poss.select("GAME_ID").union(segments.select("GAME_ID")).union(stints.select(F.col("game_id").alias("GAME_ID"))).distinct().withColumn("used", F.lit(True))
    inexact = ~F.col("FINAL_HOME").eqNullSafe(F.col("BOX_HOME")) | ~F.col("FINAL_AWAY").eqNullSafe(F.col("BOX_AWAY")) | ~F.coalesce(F.col("UNRESOLVED_SCORING_EVENTS") == 0, F.lit(False))
    held = status.join(used, "GAME_ID", "left")
    check("source_order_exclusions_meet_policy", held.where(F.col("REASON") == "source_order_unresolvable").where(inexact | (F.coalesce("ORDER_INVERSIONS", F.lit(0)) == 0) | ~F.col("EVENT_SCHEMA").eqNullSafe(F.lit("legacy")) | F.col("used")))
    removed = status.where(F.col("REASON").isin(ALTERNATION)).select("GAME_ID", F.lit(1).alias("bit"))
    sealed = removed.union(ep.select("GAME_ID", F.lit(2))).union(ee.select("GAME_ID", F.lit(4))).groupBy("GAME_ID").agg(F.bit_or("bit").alias("bits"))
    check("alternation_removals_sealed", sealed.where("bits <> 7"))

    unlogged = status.where("REASON = 'source_possession_unlogged'").select("GAME_ID")
    own = ep.join(unlogged, "GAME_ID", "left_semi")
    failing = team_counts(own, ["PERIOD"]).where("abs(na - nb) > 1").select("GAME_ID", "PERIOD")
    w = Window.partitionBy("GAME_ID", "PERIOD").orderBy("START_SEQ")
    following = own.withColumn("team", F.lag("OFFENSE_TEAM_ID").over(w)).withColumn("outcome", F.lag("OUTCOME").over(w)).withColumn("ended", F.lag("END_SEQ").over(w))
    repeats = following.where("team = OFFENSE_TEAM_ID").join(failing, ["GAME_ID", "PERIOD"])
    row = lambda p, seq: ee.select("GAME_ID", F.col("SEQ").alias(seq), *(F.col(c).alias(p + c) for c in ("ACTION", "TEAM_ID", "PERSON_ID", "PERSON_TEAM_ID", "ELAPSED")))
    named = lambda p: (F.col(f"{p}PERSON_TEAM_ID") == F.col(f"{p}TEAM_ID")) | (F.col(f"{p}PERSON_ID") == F.col(f"{p}TEAM_ID"))
    rows = repeats.join(row("t_", "ended"), ["GAME_ID", "ended"], "left").join(row("n_", "START_SEQ"), ["GAME_ID", "START_SEQ"], "left")
    verified = F.coalesce(F.col("outcome").isin(TRANSFERS) & F.col("n_ACTION").isin(CONTROL) & (F.col("n_TEAM_ID") == F.col("OFFENSE_TEAM_ID")) & (F.col("n_ELAPSED") > F.col("t_ELAPSED")) & named("t_") & named("n_"), F.lit(False))
    by_period = rows.groupBy("GAME_ID", "PERIOD").agg(F.bool_and(verified).alias("ok"))
    by_game = failing.join(by_period, ["GAME_ID", "PERIOD"], "left").groupBy("GAME_ID").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("explained"))
    open_ = own.where("OFFENSE_TEAM_ID is null").select("GAME_ID", F.lit(True).alias("open")).distinct()
    policy = held.join(unlogged, "GAME_ID", "left_semi").join(by_game, "GAME_ID", "left").join(open_, "GAME_ID", "left")
    check("source_possession_unlogged_exclusions_meet_policy", policy.where(inexact | ~F.coalesce("explained", F.lit(False)) | F.col("open") | F.col("used")))
    out = made[0]
    for df in made[1:]:
        out = out.union(df)
    return out


def run_checks(t: dict[str, DataFrame], manifest: dict, folder_name: str, hashes: dict[str, str], input_hashes: dict[str, str]) -> dict[str, bool]:
    """All 19 checks by name: the manifest's (hashes of files and inputs, identity, status of the
    release), and those of the tables."""
    spark = t["game_status"].sparkSession
    release = manifest["release"]
    declared = [(g, manifest["declared_exclusions"][g]["declared"]) for g in release.get("excluded", [])]
    cohort = spark.createDataFrame([(g,) for g in manifest["cohort"]], "GAME_ID string")
    tables = table_checks(t, cohort, spark.createDataFrame(declared, "GAME_ID string, DECLARED string"))
    out = {r["check"]: r["broken"] == 0 for r in tables.collect()}  # a row a check
    out["manifest_file_hashes"] = all(hashes.get(name) == want for name, want in manifest["files"].items())
    out["run_id_consistent"] = folder_name == manifest["run_id"]
    out["sealed_inputs_unchanged"] = all(input_hashes.get(k) == v["sha256"] for k, v in manifest["inputs"].items())
    out["release_status_recorded"] = release["status"] in ("PASS", "PASS_WITH_EXCLUSIONS", "FAIL")
    return out


def releasable(release: str, checks: dict[str, bool]) -> bool:
    """A run may be used when its release passes and so does every check of the gate."""
    return release in ("PASS", "PASS_WITH_EXCLUSIONS") and all(checks.values())
