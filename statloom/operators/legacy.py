"""Evidence for possessions that a log lacks, the older feed's words, and the older stints.

Nulls: an unknown team, time or player is evidence of nothing; rows without a game are left out.
A period's possessions, and a game's periods, are few; nothing here holds more than these together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import known_true
from .contracts import Refused
from .numbering import stored
from .possessions import SHOWS_BALL, TRANSFERS

# Words of the live feed's shots, and its other words' standard names; descriptors of fouls that get a type.
LIVE_SHOTS = {"2pt": 2, "3pt": 3}
LIVE_WORDS = {
    "rebound": "Rebound", "turnover": "Turnover", "foul": "Foul", "substitution": "Substitution", "timeout": "Timeout", "jumpball": "Jump Ball", "freethrow": "Free Throw", "violation": "Violation", "ejection": "Ejection",
}
FOUL_TYPES = {"shooting": "Shooting", "charge": "Charge"}


def same_team_repeats(possessions: DataFrame, rows: DataFrame) -> DataFrame:
    """Possessions that follow one of the same team in their period: game, period, index, team, prev_outcome, transfer_seq, next_seq,
    next_action, gap_seconds, identity_ok, verified. Verified: the one before gave the ball away, this one's first row is that team's own
    shot or turnover at a later clock, and on both rows the acting player is of the row's team, or the row names the team itself.
    possessions: game, period, index, team, outcome, first_seq, last_seq; rows: game, seq, action, team, person, person_team, elapsed."""
    order = Window.partitionBy("game", "period").orderBy("first_seq")
    before = possessions.select("game", "period", "index", "team", F.col("first_seq").alias("next_seq"), F.lag("team").over(order).alias("_team"), F.lag("outcome").over(order).alias("prev_outcome"), F.lag("last_seq").over(order).alias("transfer_seq"))
    again = before.where("team = _team").drop("_team")
    named = known_true(F.col("person_team") == F.col("team")) | known_true(F.col("person") == F.col("team"))
    row = lambda seq, p: rows.select("game", F.col("seq").alias(seq), F.col("action").alias(f"{p}action"), F.col("team").alias(f"{p}team"), F.col("elapsed").alias(f"{p}elapsed"), named.alias(f"{p}named"))
    met = again.join(row("transfer_seq", "_t_"), ["game", "transfer_seq"], "left").join(row("next_seq", "_n_"), ["game", "next_seq"], "left")
    gap, identity = F.col("_n_elapsed") - F.col("_t_elapsed"), known_true(F.col("_t_named")) & known_true(F.col("_n_named"))
    verified = F.col("prev_outcome").isin(*sorted(TRANSFERS)) & F.col("_n_action").isin(*sorted(SHOWS_BALL)) & (F.col("_n_team") == F.col("team")) & (gap > 0) & identity
    return met.select("game", "period", "index", "team", "prev_outcome", "transfer_seq", "next_seq", F.col("_n_action").alias("next_action"), gap.alias("gap_seconds"), identity.alias("identity_ok"), known_true(verified).alias("verified"))


def alternation_failures(possessions: DataFrame, repeats: DataFrame, inversions: DataFrame, schemas: DataFrame) -> DataFrame:
    """game, failing (periods in which one team has two or more possessions more than the other) and reason, of games that have
    such periods. source_order_unresolvable: a legacy feed, all possessions attributed, an inversion of the order in every failing
    period; source_possession_unlogged: all attributed, every failing period has a repeat, and all of these are verified; else
    possession_alternation_unexplained. inversions: game, period of each inverted row; schemas: game, legacy."""
    sides = possessions.where("team is not null").groupBy("game").agg(F.min("team").alias("_a"), F.max("team").alias("_b"))
    counts = possessions.join(sides, "game").groupBy("game", "period").agg(F.count_if(F.col("team") == F.col("_a")).alias("na"), F.count_if((F.col("team") == F.col("_b")) & (F.col("_a") != F.col("_b"))).alias("nb"))
    failing = counts.where("abs(na - nb) > 1").select("game", "period")
    seen = inversions.select("game", "period").distinct().withColumn("inverted", F.lit(True))
    again = repeats.groupBy("game", "period").agg(F.bool_and("verified").alias("verified"))
    games = failing.join(seen, ["game", "period"], "left").join(again, ["game", "period"], "left").groupBy("game").agg(
        F.count("*").alias("failing"), F.bool_and(known_true(F.col("inverted"))).alias("_inverted"), F.bool_and(known_true(F.col("verified"))).alias("_verified"))
    whole = possessions.groupBy("game").agg((F.count("team") == F.count("*")).alias("_whole"))
    said = games.join(whole, "game").join(schemas, "game", "left")
    reason = F.when(F.col("_whole") & known_true(F.col("legacy")) & F.col("_inverted"), "source_order_unresolvable").when(F.col("_whole") & F.col("_verified"), "source_possession_unlogged").otherwise("possession_alternation_unexplained")
    return said.select("game", "failing", reason.alias("reason"))


def canonical_feed(events: DataFrame) -> DataFrame:
    """events with the standard names of actions, values of shots and types of fouls. A game is of the live feed if
    any of its actions is a live shot or free throw; others stay as they are. A live shot of no known result keeps its word. events: game,
    actionType, shotResult, shotValue, subType, descriptor, and more."""
    kind = F.col("actionType")
    live = events.groupBy("game").agg(F.bool_or(known_true(kind.isin(*LIVE_SHOTS, "freethrow"))).alias("_live")).where("_live")
    marked = events.join(live, "game", "left")
    on, shot = known_true(F.col("_live")), kind.isin(*LIVE_SHOTS)
    words = F.create_map(*(F.lit(x) for pair in LIVE_WORDS.items() for x in pair))
    name = F.when(~on, kind).when(shot & (F.col("shotResult") == "Made"), "Made Shot").when(shot & (F.col("shotResult") == "Missed"), "Missed Shot").otherwise(F.coalesce(F.try_element_at(words, kind), kind))
    value = F.when(on & (kind == "2pt"), 2).when(on & (kind == "3pt"), 3).otherwise(F.col("shotValue"))
    types = F.create_map(*(F.lit(x) for pair in FOUL_TYPES.items() for x in pair))
    foul = F.when(on & (kind == "foul"), F.try_element_at(types, "descriptor"))
    new = {"actionType": name, "shotValue": value, "subType": F.coalesce(foul, F.col("subType"))}
    return marked.select(*(new.get(c, F.col(c)).alias(c) for c in events.columns))


def stint_sides(possessions: DataFrame, player_team: DataFrame) -> DataFrame:
    """game, home_team and away_team (0 if not known) as legacy_stints takes them. A game's first players are looked up in the roster as it streams by, which may
    repeat rows, so that no player of a game but these two is sorted or kept."""
    first = possessions.groupBy("game").agg(F.min_by(F.col("offense_lineup")[0], "at").alias("_h"), F.min_by(F.col("defense_lineup")[0], "at").alias("_a"))
    own = lambda c: F.col("player") == F.col(c)
    asked = player_team.select("game", "player", "team").join(first.hint("shuffle_hash"), "game").where(own("_h") | own("_a"))
    teams = asked.groupBy("game").agg(F.count_if(own("_h")).alias("_n"), F.max(F.when(own("_h"), F.col("team"))).alias("home_team"), F.max(F.when(own("_a"), F.col("team"))).alias("_away")).where("_n > 0")
    return teams.select("game", "home_team", F.when(F.col("_away") != F.col("home_team"), F.col("_away")).otherwise(0).alias("away_team"))


def legacy_stints(possessions: DataFrame, player_team: DataFrame, least: int, sides: DataFrame | None = None) -> DataFrame:
    """Possessions of the older form added up by game and both lineups, of at least so many: game, home_lineup, away_lineup, home_team,
    away_team (0 if not known), possessions, home_points, away_points, net_points, net_rating_per_100, duration. The home team is that of the first player of a game's first
    possession's offence, the away team likewise of the defence; games without a home team and possessions without
    two fives are left out. Points go to the scoring team, else to the offence. A negative duration is refused, an unknown one is 0.
    possessions: game, at (their order), offense_lineup, defense_lineup, points, scoring_team, offense_team, duration; player_team: game, player, team. sides: a written table of stint_sides(), where
    it is used more than once."""
    sides = stored(stint_sides(possessions, player_team), "stint-sides") if sides is None else sides
    rows = possessions.join(sides.hint("shuffle_hash"), "game").where((F.size("offense_lineup") == 5) & (F.size("defense_lineup") == 5))
    negative = rows.where("duration < 0").select("game", "at", "duration").limit(5).collect()
    if negative:
        raise Refused(f"negative durations: {[tuple(r) for r in negative]}")
    points = F.coalesce(F.col("points"), F.lit(0))
    credit = F.coalesce(F.when(F.col("scoring_team") > 0, F.col("scoring_team")), F.when(F.col("offense_team") > 0, F.col("offense_team")))
    scored = lambda own: F.sum(F.when((points > 0) & credit.isNotNull() & ((credit == F.col("home_team")) == F.lit(own)), points).otherwise(0))
    some_null = lambda c: F.greatest(*(F.col(c)[k].isNull() for k in range(5)))
    in_order = lambda c: F.when(some_null(c), F.array_sort(c)).otherwise(F.sort_array(c))  # noqa: E731  (the latter is compiled, but has nulls first)
    keys = [in_order("offense_lineup").alias("home_lineup"), in_order("defense_lineup").alias("away_lineup")]
    out = rows.groupBy("game", *keys, "home_team", "away_team").agg(F.count("*").alias("possessions"), scored(True).alias("home_points"), scored(False).alias("away_points"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("duration"))
    net = F.col("home_points") - F.col("away_points")
    return out.where(F.col("possessions") >= least).withColumn("net_points", net).withColumn("net_rating_per_100", 100.0 * net / F.col("possessions"))
