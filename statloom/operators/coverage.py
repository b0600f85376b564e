"""How far the logs of each season cover its box record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import correlation, safe_ratio
from .numbering import stored
from .relational import many_quantiles

#: Measures that are medians over a season's games: name to column of games().
MEDIANS = {
    "rows_per_game": "rows", "box_poss_per_game": "box_poss", "rows_over_box_poss": "r_rows", "points_over_box_points": "r_points", "offense_teams_per_game": "offense_teams",
    "stint_poss_over_rows": "r_stint_rows", "stint_poss_over_box_poss": "r_stint_poss", "stint_points_over_box_points": "r_stint_points",
}
#: Outcomes that are counted per game, and box columns whose mean stands beside them.
OUTCOMES = ["field_goal_made", "turnover", "defensive_rebound", "free_throw_made", "end_of_period"]
BOX_MEANS = ["box_fgm", "box_tov", "box_dreb", "box_fta"]


def games(possessions: DataFrame, stints: DataFrame, box: DataFrame) -> DataFrame:
    """A row for each game of the possessions, with what its stints and its box record say; ratios
    with nothing below the line are null."""
    rows = possessions.groupBy("season", "game").agg(F.count("*").alias("rows"), F.count_if("five").alias("rows_five"), F.sum("points").alias("points"), F.count_distinct("offense_team").alias("offense_teams"))
    own = stints.groupBy("game").agg(F.sum("possessions").alias("stint_poss"), F.sum(F.col("home_points") + F.col("away_points")).alias("stint_points"), (F.sum("home_points") - F.sum("away_points")).alias("stint_margin"))
    both = rows.join(own, "game", "left").join(box.drop("season"), "game", "left")
    ratio = lambda a, b: safe_ratio(F.col(a), F.col(b))
    return both.select(
        "*", ratio("rows", "box_poss").alias("r_rows"), ratio("points", "box_points").alias("r_points"), ratio("stint_poss", "rows").alias("r_stint_rows"), ratio("stint_poss", "box_poss").alias("r_stint_poss"), ratio("stint_points", "box_points").alias("r_stint_points")
    )


def season_coverage(possessions: DataFrame, stints: DataFrame, box: DataFrame, seasons: DataFrame) -> DataFrame:
    """A row for each of seasons: status (SOURCE_MISSING where possessions or stints have no row of it), seventeen measures
    and nine rates of outcomes. possessions: season, game, five (a full lineup on both sides), points, offense_team, outcome;
    stints: season, game, possessions, home_points, away_points; box: season, game, box_points and box_poss (null for a game of
    one side), box_margin, box_free_margin, real_home, and BOX_MEANS. A game is of one season; nulls are left out of medians and means."""
    g = stored(games(possessions, stints, box), "covered-games")
    whole = F.col("stint_margin").isNotNull() & F.col("box_margin").isNotNull() & F.col("box_free_margin").isNotNull()
    kept = lambda c: F.when(whole, c)
    sums = g.groupBy("season").agg(
        F.count("*").alias("games"), F.count("in_box").alias("_in_box"), safe_ratio(F.sum("points"), F.sum("rows")).alias("points_per_row"), safe_ratio(F.sum("box_points"), F.sum("box_poss")).alias("box_points_per_possession"),
        safe_ratio(F.sum("rows_five"), F.sum("rows")).alias("share_five"), F.avg(F.col("real_home").cast("double")).alias("share_real_home"), correlation(kept(F.col("stint_margin")), kept(F.col("box_margin"))).alias("corr_margin"),
        correlation(kept(F.col("stint_margin")), kept(F.col("box_margin") - F.col("box_free_margin"))).alias("corr_margin_without_free"), *(F.avg(c).alias(f"{c}_per_game") for c in BOX_MEANS),
    )
    middle = many_quantiles(g, ["season"], list(MEDIANS.values()), [0.5]).select("season", *(F.col(c)[0].alias(name) for name, c in MEDIANS.items()))
    said = possessions.groupBy("season").agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in OUTCOMES))
    recorded = box.groupBy("season").agg(F.count("*").alias("box_games"))
    there = stints.select("season").distinct().withColumn("_stints", F.lit(True))
    out = seasons.join(sums, "season", "left").join(middle, "season", "left").join(said, "season", "left").join(recorded, "season", "left").join(there, "season", "left")
    measured = F.col("games").isNotNull() & F.col("_stints").isNotNull()
    shown = lambda c, name: F.when(measured, c).alias(name)
    n = F.coalesce("box_games", F.lit(0))
    columns: list[Column] = [shown(n, "box_games"), shown(F.col("games"), "games"), shown(n - F.col("_in_box"), "games_missing"), *(shown(F.col(c), c) for c in MEDIANS)]
    columns += [shown(F.col(c), c) for c in ("points_per_row", "box_points_per_possession", "share_five", "share_real_home", "corr_margin", "corr_margin_without_free")]
    columns += [shown(F.col(x) / F.col("games"), f"{x}_per_game") for x in OUTCOMES] + [shown(F.col(f"{c}_per_game"), f"{c}_per_game") for c in BOX_MEANS]
    return out.select("season", F.when(measured, "MEASURED").otherwise("SOURCE_MISSING").alias("status"), *columns)
