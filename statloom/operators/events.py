"""A raw log of linked events made into one normal form, and its scoring reconciled.

events: gameId, period, event_time, orderNumber, ingest_ord, actionType, subType,
descriptor, description, teamId, personId, shotResult, shotValue, scoreHome, scoreAway,
home_lineup, away_lineup (optional ones null). Every result column is an expression or a
window over a game or an instant of it; nothing runs in Python. What isn't known stays
null and is never read as a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import known_true, padded_id, squeezed
from .relational import dealt

# Names of actions, phrases of free throws in order of priority, phrases of fouls that award one throw and the ball, administrative actions.
ACTIONS = {
    "made shot": "made_shot", "missed shot": "missed_shot", "free throw": "free_throw", "rebound": "rebound", "turnover": "turnover", "foul": "foul", "substitution": "substitution",
    "period": "period", "jump ball": "jump_ball", "violation": "violation", "timeout": "timeout",
}
THROWS = {"technical": "technical", "flagrant": "flagrant", "clear path": "clear_path", "away from play": "away_from_play", "transition take": "transition_take"}
RETAINED = {"away from play": "away_from_play", "transition take": "transition_take", "inbound": "inbound"}
ADMINISTRATIVE = ["substitution", "timeout", "other"]
COLUMNS = (
    "GAME_ID SEQ PERIOD ELAPSED ACTION SUBTYPE_RAW TEAM_ID PERSON_ID SHOT_VALUE FT_MADE FT_OUTCOME_SOURCE FT_KIND FT_NUM FT_OF PERIOD_END SCORE_HOME SCORE_AWAY PTS_HOME PTS_AWAY "
    "SCORING_UNRESOLVED OBS_SCORE_HOME OBS_SCORE_AWAY HOME_ON AWAY_ON LINEUP_VALID HOME_TEAM_ID AWAY_TEAM_ID ORDER_NUMBER ORDER_INVERSION"
).split()
#: Rows of a log that a task sorts at a time, as eight windows and joins of wide rows follow each other in it.
EACH = 1 << 16


def first_phrase(text: Column, phrases: dict[str, str]) -> Column:
    """The name of the first phrase, in their order, that the text holds."""
    return F.coalesce(*(F.when(text.contains(k), v) for k, v in phrases.items()))


def numbered_log(events: DataFrame, rows: int = 0) -> DataFrame:
    """Keys, order and the flag of rows whose entry number is below one placed before them; a feed
    without orderNumber is ordered by actionNumber. rows: those of events, where they are dealt out by games."""
    entry = F.col("orderNumber" if "orderNumber" in events.columns else "actionNumber")
    e = events.withColumns({
        "GAME_ID": padded_id(F.col("gameId")), "PERIOD": F.col("period").cast("int"), "ELAPSED": F.col("event_time").cast("string").try_cast("double"), "ORDER_NUMBER": entry.cast("string").try_cast("double"),
        "ACTION": F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair)), squeezed(F.col("actionType"))), F.lit("other")),
    })
    e = dealt(e, rows, ["GAME_ID"], EACH)
    place = [F.col("PERIOD").asc_nulls_last(), F.col("ELAPSED").asc_nulls_last(), F.col("ORDER_NUMBER").asc_nulls_last(), "ingest_ord"]
    e = e.withColumn("SEQ", (F.row_number().over(Window.partitionBy("GAME_ID").orderBy(*place)) - 1).cast("int"))
    w = Window.partitionBy("GAME_ID", "PERIOD").orderBy("SEQ")
    before = F.max("ORDER_NUMBER").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumn("ORDER_INVERSION", known_true(F.lag("ORDER_NUMBER").over(w).isNotNull() & (F.col("ORDER_NUMBER") < before)))


def with_teams(e: DataFrame) -> DataFrame:
    """TEAM_ID: a team's own rows have 0 and the team as the person; an excess-timeout turnover
    without a team is that of the game's last timeout before it."""
    number = lambda c: F.col(c).cast("string").try_cast("double").cast("long")
    raw, person = number("teamId"), number("personId")  # what isn't a number isn't known
    own = (raw == 0) & ((person == F.col("HOME_TEAM_ID")) | (person == F.col("AWAY_TEAM_ID")))
    e = e.withColumn("TEAM_ID", F.when(own, person).when(raw != 0, raw)).withColumn("PERSON_ID", person)
    past = Window.partitionBy("GAME_ID").orderBy("SEQ").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.last(F.when(F.col("ACTION") == "timeout", F.col("TEAM_ID")), ignorenulls=True).over(past)
    excess = (F.col("ACTION") == "turnover") & F.col("TEAM_ID").isNull() & known_true(F.lower("subType").contains("excess timeout"))
    return e.withColumn("TEAM_ID", F.when(excess, asked).otherwise(F.col("TEAM_ID")))


def with_throws(e: DataFrame) -> DataFrame:
    """Free throws: outcome with its source, kind and place in the trip."""
    throw, said, result = F.col("ACTION") == "free_throw", F.trim("description"), F.trim("shotResult")
    has = F.coalesce(result != "", F.lit(False))
    miss, points = known_true(said.rlike("^MISS\\s")), known_true(F.col("description").rlike("\\(\\d+ PTS\\)"))
    decisive = F.when(~F.col("ACTION").isin(ADMINISTRATIVE), F.struct("ACTION", "ELAPSED"))
    order = Window.partitionBy("GAME_ID").orderBy("SEQ")
    after = F.first(decisive, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(decisive, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    follows, beside = known_true(after["ACTION"] == "rebound"), known_true((before["ACTION"] == "rebound") & (before["ELAPSED"] == F.col("ELAPSED")))
    source = F.when(throw, F.when(has, "shot_result").when(points & ~miss, "description_pts").when(miss & ~points, "description_miss").when(miss & points, "unknown").when(follows, "inferred_next_rebound").when(beside, "inferred_adjacent_rebound").otherwise("unknown"))
    e = e.withColumn("FT_OUTCOME_SOURCE", source)
    s = F.col("FT_OUTCOME_SOURCE")
    e = e.withColumn("FT_MADE", F.when(s == "shot_result", F.lower(result) == "made").when(s == "description_pts", True).when(s.isin("description_miss", "inferred_next_rebound", "inferred_adjacent_rebound"), False))

    text = F.lower(F.concat_ws(" ", "subType", F.translate("descriptor", "-", " ")))
    trip = "(\\d+)\\s+of\\s+(\\d+)"
    number = lambda k: F.when(throw, F.nullif(F.regexp_extract(text, trip, k), F.lit("")).cast("int"))
    kind = F.coalesce(first_phrase(text, THROWS), F.when(text.rlike(trip), "regular").otherwise("unknown"))
    e = e.withColumn("FT_KIND", F.when(throw, kind)).withColumn("FT_NUM", F.when(F.col("FT_KIND") != "technical", number(1))).withColumn("FT_OF", F.when(F.col("FT_KIND") != "technical", number(2)))

    # One throw after a foul at its instant: the last foul that isn't technical says whether the ball is kept. A foul
    # without a descriptor keeps its other words, as the older feed has no descriptors.
    foul = F.col("ACTION") == "foul"
    words = F.concat_ws(" ", F.concat(F.translate(F.lower("subType"), "-.", "  "), F.lit(" "), F.translate(F.lower("description"), "-.", "  ")), F.translate(F.lower("descriptor"), "-", " "))
    technical = foul & known_true(words.contains("technical"))
    mark = F.when(foul & ~technical, F.coalesce(*(F.when(words.contains(k), v) for k, v in reversed(RETAINED.items())), F.lit("none")))
    instant = Window.partitionBy("GAME_ID", "ELAPSED").orderBy("SEQ").rowsBetween(Window.unboundedPreceding, 0)
    timed = F.col("ELAPSED").isNotNull()
    last = F.when(timed, F.last(mark, ignorenulls=True).over(instant))
    seen = timed & (F.sum(technical.cast("int")).over(instant) > 0)
    scored = F.bool_or(F.col("ACTION") == "made_shot").over(Window.partitionBy("GAME_ID", "ELAPSED", "TEAM_ID"))
    one = (F.col("FT_KIND") == "regular") & (F.col("FT_OF") == 1)
    e = e.withColumns({"_last": last, "_seen": seen, "_scored": scored})
    return e.withColumn("FT_KIND", F.when(known_true(one & F.col("_last").isin(*RETAINED.values())), F.col("_last")).when(known_true(one) & F.col("_last").isNull() & F.col("_seen") & ~F.col("_scored"), "technical").otherwise(F.col("FT_KIND")))


def with_points(e: DataFrame) -> DataFrame:
    """Points by what happened, not by the scoreboard; the scoreboard is kept on scoring rows only."""
    shot, throw = F.col("ACTION") == "made_shot", F.col("ACTION") == "free_throw"
    made = throw & known_true(F.col("FT_MADE"))
    home, away = (known_true(F.col("TEAM_ID") == F.col(c)) for c in ("HOME_TEAM_ID", "AWAY_TEAM_ID"))
    value = F.col("shotValue").cast("string").try_cast("double")
    worth = known_true(value.isin(2.0, 3.0))
    points = F.when(shot & worth, value).when(made, 1.0).otherwise(0.0)
    run = Window.partitionBy("GAME_ID").orderBy("SEQ").rowsBetween(Window.unboundedPreceding, 0)
    observed = lambda c: F.when(shot | throw, F.col(c).cast("string").try_cast("double"))
    e = e.withColumns({
        "SHOT_VALUE": value, "SUBTYPE_RAW": F.col("subType"), "PERIOD_END": (F.col("ACTION") == "period") & known_true(F.lower("subType").contains("end")), "OBS_SCORE_HOME": observed("scoreHome"), "OBS_SCORE_AWAY": observed("scoreAway"),
        "SCORING_UNRESOLVED": throw & F.col("FT_MADE").isNull() | (shot | made) & (~(home | away) | shot & ~worth), "PTS_HOME": F.when(home, points).otherwise(0.0), "PTS_AWAY": F.when(away & ~home, points).otherwise(0.0),
    })
    return e.withColumns({"SCORE_HOME": F.sum("PTS_HOME").over(run), "SCORE_AWAY": F.sum("PTS_AWAY").over(run)})


def with_lineups(e: DataFrame, player_team: DataFrame) -> DataFrame:
    """The ten on the floor, split by the game's roster; valid when five and five."""
    roster = player_team.groupBy(padded_id(F.col("GAME_ID")).alias("GAME_ID"), "PLAYER_ID").agg(F.max("TEAM_ID").alias("TEAM_ID"))
    rosters = roster.groupBy("GAME_ID").agg(F.map_from_entries(F.collect_list(F.struct("PLAYER_ID", "TEAM_ID"))).alias("_team_of"))  # some thirty players
    e = e.join(rosters, "GAME_ID", "left")
    none = F.array().cast("array<bigint>")
    pool = F.array_distinct(F.concat(F.coalesce("home_lineup", none), F.coalesce("away_lineup", none)))
    side = lambda team: F.array_sort(F.filter(pool, lambda p: F.try_element_at("_team_of", p) == F.col(team)))
    e = e.withColumns({"_home": side("HOME_TEAM_ID"), "_away": side("AWAY_TEAM_ID"), "_pool": F.size(pool)})
    e = e.withColumn("LINEUP_VALID", known_true((F.col("_pool") == 10) & (F.size("_home") == 5) & (F.size("_away") == 5)))
    return e.withColumns({"HOME_ON": F.when(F.col("LINEUP_VALID"), F.col("_home")), "AWAY_ON": F.when(F.col("LINEUP_VALID"), F.col("_away"))})


def normalized(events: DataFrame, game_teams: DataFrame, player_team: DataFrame, rows: int = 0) -> DataFrame:
    """The 29 columns of the normal form, a row for each event. game_teams: GAME_ID,
    HOME_TEAM_ID, AWAY_TEAM_ID; player_team: GAME_ID, PLAYER_ID, TEAM_ID; rows: how many events there are, if known."""
    teams = game_teams.select(padded_id(F.col("GAME_ID")).alias("GAME_ID"), "HOME_TEAM_ID", "AWAY_TEAM_ID")
    e = with_teams(numbered_log(events, rows).join(teams, "GAME_ID", "left"))
    return with_lineups(with_points(with_throws(e)), player_team).select(*COLUMNS)


def instant_checkpoints(norm: DataFrame, rows: int = 0) -> DataFrame:
    """GAME_ID, instants with a scoreboard and how many of them differ: the score after an
    instant against the highest that the scoreboard shows in it."""
    timed = norm.where("ELAPSED is not null").select("GAME_ID", "SEQ", "PERIOD", "ELAPSED", "SCORE_HOME", "SCORE_AWAY", "OBS_SCORE_HOME", "OBS_SCORE_AWAY")
    inst = dealt(timed, rows, ["GAME_ID"], 2 * EACH).groupBy("GAME_ID", "PERIOD", "ELAPSED").agg(*(F.max_by(f"SCORE_{s}", "SEQ").alias(f"end_{s}") for s in ("HOME", "AWAY")), *(F.max(f"OBS_SCORE_{s}").alias(f"obs_{s}") for s in ("HOME", "AWAY")))
    shown = F.col("obs_HOME").isNotNull() | F.col("obs_AWAY").isNotNull()
    off = known_true(F.col("obs_HOME") != F.col("end_HOME")) | known_true(F.col("obs_AWAY") != F.col("end_AWAY"))
    return inst.groupBy("GAME_ID").agg(F.count_if(shown).alias("INSTANT_CHECKPOINTS"), F.count_if(shown & off).alias("INSTANT_CHECKPOINT_MISMATCHES"))


def period_checkpoints(norm: DataFrame, box: DataFrame, rows: int = 0) -> DataFrame:
    """GAME_ID, CHECKPOINTS, CHECKPOINT_MISMATCHES, SCOREBOARD_UNCHECKED_PERIODS and
    SCOREBOARD_FINAL_MATCHES_BOX. A side's scoreboard is evidence only if its last value is the
    box's, and only in periods after it has last contradicted itself (a value below the one before)
    and agreed with the events again."""
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"SCORE_{s}").alias("score"), F.col(f"OBS_SCORE_{s}").alias("obs")) for s in ("HOME", "AWAY")))
    each_side = norm.select("GAME_ID", "SEQ", "PERIOD", F.explode(sides).alias("x")).select("GAME_ID", "SEQ", "PERIOD", "x.*")
    ends = each_side.groupBy("GAME_ID", "side", "PERIOD").agg(F.max_by("score", "SEQ").alias("end"), F.max("obs").alias("most"))
    key = ["GAME_ID", "side"]
    shown = dealt(each_side.where("obs is not null"), 2 * rows, key, 2 * EACH)
    w = Window.partitionBy(*key).orderBy("SEQ")
    broke = F.max(F.when(F.col("obs") < F.col("before"), F.col("SEQ"))).over(Window.partitionBy(*key))
    marked = shown.withColumn("before", F.lag("obs").over(w)).withColumn("broke", broke)
    later = marked.where("SEQ >= broke").withColumn("anchor", F.min(F.when(F.col("obs") == F.col("score"), F.col("SEQ"))).over(Window.partitionBy(*key)))
    # the rows from the break up to the one before it agrees again; where the break itself agrees, that row
    unsure = later.where(F.col("anchor").isNull() | (F.col("SEQ") < F.col("anchor")) | (F.col("SEQ") == F.col("broke"))).groupBy(*key).agg(F.max("PERIOD").alias("until"))
    last = shown.groupBy(*key).agg(F.max_by("obs", "SEQ").alias("final"))
    b = box.select(padded_id(F.col("GAME_ID")).alias("GAME_ID"), F.explode(F.array(F.struct(F.lit("HOME").alias("side"), F.col("HOME_PTS").cast("double").alias("box")), F.struct(F.lit("AWAY").alias("side"), F.col("AWAY_PTS").cast("double").alias("box")))).alias("b")).select("GAME_ID", "b.*")
    state = last.join(b, key, "left").join(unsure, key, "left").withColumn("ok", known_true(F.col("final") == F.col("box"))).withColumn("until", F.coalesce("until", F.lit(0)))
    each = ends.where("most is not null").join(state, key).withColumn("checked", F.col("ok") & (F.col("PERIOD") > F.col("until")))
    return each.groupBy("GAME_ID").agg(F.count_if("checked").alias("CHECKPOINTS"), F.count_if(F.col("checked") & (F.col("most") != F.col("end"))).alias("CHECKPOINT_MISMATCHES"), F.count_if(~F.col("checked")).alias("SCOREBOARD_UNCHECKED_PERIODS"), F.bool_and("ok").alias("SCOREBOARD_FINAL_MATCHES_BOX"))


def scoring_events(norm: DataFrame) -> DataFrame:
    """GAME_ID, SEQ, SCORING_TEAM_ID, POINTS, LINEUP_VALID, SOURCE_ACTION: rows that scored, and
    unresolved ones with neither team nor points."""
    home = F.col("PTS_HOME") > 0
    scored = (home | (F.col("PTS_AWAY") > 0)) & ~F.col("SCORING_UNRESOLVED")
    team = F.when(scored, F.when(home, F.col("HOME_TEAM_ID")).otherwise(F.col("AWAY_TEAM_ID")))
    points = F.when(scored, F.when(home, F.col("PTS_HOME")).otherwise(F.col("PTS_AWAY")))
    return norm.where(scored | F.col("SCORING_UNRESOLVED")).select("GAME_ID", "SEQ", team.alias("SCORING_TEAM_ID"), points.alias("POINTS"), "LINEUP_VALID", F.col("ACTION").alias("SOURCE_ACTION"))


def game_status(norm: DataFrame, box: DataFrame, rows: int = 0) -> DataFrame:
    """A row for each game: final scores against the box (GAME_ID, HOME_PTS, AWAY_PTS), checkpoints,
    and ADMITTED or QUARANTINED with its reasons. rows: those of norm, if known."""
    sides = box.select(padded_id(F.col("GAME_ID")).alias("GAME_ID"), F.col("HOME_PTS").cast("double").alias("BOX_HOME"), F.col("AWAY_PTS").cast("double").alias("BOX_AWAY"))
    # the last period in which anything but a marker happens
    periods = norm.where("PERIOD is not null").groupBy("GAME_ID", "PERIOD").agg(F.bool_or(known_true(F.col("ACTION") != "period")).alias("_played"), F.max(F.when(F.col("PERIOD_END"), F.col("SEQ"))).alias("_end"))
    last = F.struct("PERIOD", "_end")
    ends = periods.groupBy("GAME_ID").agg(F.coalesce(F.max(F.when(F.col("_played"), last)), F.max(last))["_end"].alias("_end"))
    scores = (F.col("ACTION") == "made_shot") | (F.col("ACTION") == "free_throw") & known_true(F.col("FT_MADE"))
    g = norm.where("GAME_ID is not null").groupBy("GAME_ID").agg(
        F.max_by("SCORE_HOME", "SEQ").alias("FINAL_HOME"), F.max_by("SCORE_AWAY", "SEQ").alias("FINAL_AWAY"), F.count_if("SCORING_UNRESOLVED").alias("UNRESOLVED_SCORING_EVENTS"),
        F.max(F.when(scores, F.col("SEQ"))).alias("_scored"), F.count_if("ORDER_INVERSION").alias("ORDER_INVERSIONS"))
    g = g.join(ends, "GAME_ID", "left").select(
        "GAME_ID", "FINAL_HOME", "FINAL_AWAY", "UNRESOLVED_SCORING_EVENTS", F.col("_end").isNotNull().alias("HAS_PERIOD_END"), known_true(F.col("_scored") > F.col("_end")).alias("_after"), "ORDER_INVERSIONS")
    g = g.join(sides, "GAME_ID", "left").join(period_checkpoints(norm, box, rows), "GAME_ID", "left").join(instant_checkpoints(norm, rows).drop("INSTANT_CHECKPOINTS"), "GAME_ID", "left")
    g = g.fillna(0, ["CHECKPOINTS", "CHECKPOINT_MISMATCHES", "SCOREBOARD_UNCHECKED_PERIODS", "INSTANT_CHECKPOINT_MISMATCHES"]).fillna(True, ["SCOREBOARD_FINAL_MATCHES_BOX"])
    exact = known_true((F.col("FINAL_HOME") == F.col("BOX_HOME")) & (F.col("FINAL_AWAY") == F.col("BOX_AWAY")))
    reasons = F.concat_ws(
        "; ", F.when(~exact, "final_score_mismatch_box"), F.when(F.col("UNRESOLVED_SCORING_EVENTS") > 0, "unresolved_scoring_event"), F.when(F.col("CHECKPOINT_MISMATCHES") > 0, "scoreboard_checkpoint_mismatch"),
        F.when(~F.col("HAS_PERIOD_END"), "stream_missing_final_period_end").when(F.col("_after"), "scoring_after_final_period_end"),
    )
    return g.withColumn("STATUS", F.when(reasons == "", "ADMITTED").otherwise("QUARANTINED")).withColumn("REASON", F.nullif(reasons, F.lit(""))).drop("_after")
