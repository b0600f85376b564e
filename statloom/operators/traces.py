"""What a stored artifact was fitted on, and single games reconciled by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ridge
from .numbering import numbered


def refit_trace(artifact: DataFrame, stints: DataFrame, inputs: DataFrame, penalty: float, target: str = "target") -> DataFrame:
    """input, status, players, share_exact, largest_difference: for each of inputs (m) whether the artifact (player, rating, total_poss) comes
    from its stints (m, weight, target, members): the share of players whose exposure, cut to a whole number, is the artifact's, and the largest difference of
    their ratings when all inputs are fitted anew, in one solve. An input without stints is SOURCE_MISSING. Players on one side only don't count."""
    found = ridge.fit_each(stints, {"rating": (penalty, target)})
    both = found.join(artifact.withColumnRenamed("player", "i"), "i")
    # sums of weights are whole within the sums' rounding
    exact = F.col("total_poss") == F.floor(F.col("exposure") + 1e-6)
    said = both.groupBy("m").agg(F.count("*").alias("players"), F.avg(exact.cast("double")).alias("share_exact"), F.max(F.abs(F.col("x_rating") - F.col("rating"))).alias("largest_difference"))
    return inputs.join(said, "m", "left").select(F.col("m").alias("input"), F.when(F.col("players").isNull(), "SOURCE_MISSING").otherwise("MEASURED").alias("status"), "players", "share_exact", "largest_difference")


def picked_games(games: DataFrame, rotation: DataFrame) -> DataFrame:
    """case, game, player, team: the middle one of the games of regulation length, the longest overtime, the one with most rotation stints (of equals, the
    least game), and for the least player of several teams the first game with each. games: game, game_seconds; rotation: game, team, player."""
    none = [F.lit(None).cast("long").alias(c) for c in ("player", "team")]
    regular = numbered(games.where("game_seconds = 2880").select("game"), ["game"], "place")
    middle = regular.join(F.broadcast(regular.agg(F.floor(F.count("*") / 2).alias("_m"))), F.col("place") == F.col("_m"))  # a row
    longest = games.where("game_seconds > 2880").orderBy(F.desc("game_seconds"), "game").limit(1)
    heavy = rotation.join(games.select("game"), "game", "left_semi").groupBy("game").count().orderBy(F.desc("count"), "game").limit(1)
    out = [df.select(F.lit(name).alias("case"), "game", *none) for name, df in (("regulation", middle), ("overtime", longest), ("substitution_heavy", heavy))]
    teams = rotation.groupBy("player").agg(F.count_distinct("team").alias("n")).where("n > 1").orderBy("player").limit(1)
    with_each = rotation.join(F.broadcast(teams.select("player")), "player").groupBy("player", "team").agg(F.min("game").alias("game"))
    return out[0].union(out[1]).union(out[2]).union(with_each.join(games.select("game"), "game", "left_semi").select(F.lit("traded_player").alias("case"), "game", "player", "team"))


def reconciliations(games: DataFrame, rotation: DataFrame, stints: DataFrame) -> DataFrame:
    """The picked games with what box, log, stints and rotation say of them, and of a traded player in each: seconds on court, possessions of the
    stints that have the player, and the box possessions by the share of time. games: game, game_seconds, box_points, box_poss, rows, rows_five, points, and
    more, which stay; rotation: game, team, player, stint_seconds; stints: game, home_lineup, away_lineup, possessions, home_points, away_points."""
    picks = F.broadcast(picked_games(games, rotation))  # some five rows
    inside = F.coalesce(F.array_contains("home_lineup", F.col("player")) | F.array_contains("away_lineup", F.col("player")), F.lit(False))
    own = stints.join(picks, "game").groupBy("case", "game", "team").agg(
        F.count("*").alias("stints"), F.sum("possessions").alias("stint_poss_sum"), F.sum(F.col("home_points") + F.col("away_points")).alias("stint_points_sum"), F.sum(F.col("home_points") - F.col("away_points")).alias("stint_margin_sum"),
        F.sum(F.when(inside, F.col("possessions"))).alias("player_stint_poss"))
    court = rotation.withColumnRenamed("team", "_team").withColumnRenamed("player", "_player").join(picks, "game").groupBy("case", "game", "team").agg(
        F.count("*").alias("rotation_stints"), F.sum(F.when(F.col("_player") == F.col("player"), F.col("stint_seconds"))).alias("oncourt_seconds"))
    rows = picks.join(games, "game")
    for more in (own, court):
        named = more.withColumnsRenamed({"case": "_case", "game": "_game", "team": "_team"})
        same = (F.col("case") == F.col("_case")) & (F.col("game") == F.col("_game")) & F.col("team").eqNullSafe(F.col("_team"))
        rows = rows.join(named, same, "left").drop("_case", "_game", "_team")
    return rows.withColumn("share_of_box_poss", F.col("oncourt_seconds") / F.col("game_seconds") * F.col("box_poss"))
