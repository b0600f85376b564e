"""The event normaliser and the scoring ledger on a raw log made of the event table: a user is a game."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import events as EV
from ..operators.numbering import stored
from ..operators.relational import dealt
from .registry import query

#: The raw log: words, phrases, results and scoreboards that follow from an event's type, value and number.
RAW = """WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS total, CAST(floor(value) AS BIGINT) % 10 AS k, user_id % 2 = 1 AS odd FROM events),
 w AS (SELECT user_id AS game, event_id AS id, rn, k, odd, CAST(1 + rn // 30 AS INT) AS PERIOD, rn * 4.0::DOUBLE - CASE WHEN event_id % 6 = 0 THEN 4.0 ELSE 0.0 END AS ELAPSED, CASE WHEN event_id % 29 <> 0 THEN rn * 10.0::DOUBLE - CASE WHEN event_id % 23 = 0 THEN 15 ELSE 0 END END AS ORD,
 CASE WHEN rn % 30 = 29 OR rn = total - 1 THEN 'period' WHEN event_type = 'view' THEN 'made_shot' WHEN event_type = 'click' THEN 'missed_shot' WHEN event_type = 'purchase' THEN 'free_throw' WHEN event_type = 'error' THEN 'rebound' WHEN k % 5 = 0 THEN 'foul' WHEN k % 5 = 1 THEN 'turnover' WHEN k % 5 = 2 THEN 'timeout' WHEN k % 5 = 3 THEN 'substitution' ELSE 'other' END AS ACTION FROM b),
 r AS (SELECT *, CASE ACTION WHEN 'free_throw' THEN CASE k % 5 WHEN 0 THEN 'Free Throw 1 of 1' WHEN 1 THEN 'Free Throw 1 of 2' WHEN 2 THEN 'Free Throw 2 of 2' WHEN 3 THEN 'Technical' ELSE 'Flagrant 1 of 2' END WHEN 'foul' THEN CASE id % 3 WHEN 0 THEN 'Personal' WHEN 1 THEN 'Technical' ELSE 'Away-From-Play' END
 WHEN 'turnover' THEN CASE WHEN id % 2 = 0 THEN 'Excess Timeout' END WHEN 'period' THEN CASE WHEN id % 19 <> 0 THEN 'end' ELSE 'start' END END AS sub, CASE WHEN ACTION = 'foul' AND id % 4 = 0 THEN 'transition-take' END AS descr,
 CASE WHEN ACTION = 'free_throw' THEN CASE WHEN k = 7 THEN 'MISS x' WHEN k = 8 THEN 'MISS x (3 PTS)' WHEN k > 4 THEN 'y (3 PTS)' ELSE 'z' END WHEN ACTION = 'foul' THEN 'f' END AS said, CASE WHEN ACTION = 'free_throw' THEN CASE WHEN id % 5 = 0 THEN 'Made' WHEN id % 5 = 1 OR NOT odd AND id % 2 = 0 THEN 'Missed' WHEN NOT odd THEN 'Made' ELSE '' END END AS result,
 CASE WHEN ACTION = 'made_shot' AND (id % 37 <> 0 OR NOT odd) THEN 2.0 + id % 2 END AS worth, CASE WHEN id % 11 = 0 AND odd THEN 0 ELSE 10 + k % 2 END AS tid, CASE WHEN id % 22 = 0 THEN 10 + k % 2 ELSE id % 500 + 1000 END AS pid,
 CAST(CASE WHEN id % 41 = 0 THEN 0 ELSE rn // 3 END AS DOUBLE) AS sh, CAST(rn // 4 AS DOUBLE) AS sa, id % 13 <> 0 AS ten FROM w),"""
NORMAL = RAW + r""" n1 AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY PERIOD, ELAPSED, ORD NULLS LAST, id) - 1 AS SEQ FROM r),
 n2 AS (SELECT *, coalesce(lag(ORD) OVER (PARTITION BY game, PERIOD ORDER BY SEQ) IS NOT NULL AND ORD < max(ORD) OVER (PARTITION BY game, PERIOD ORDER BY SEQ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inverted, CASE WHEN tid = 0 AND pid IN (10, 11) THEN pid WHEN tid <> 0 THEN tid END AS t0 FROM n1),
 n3 AS (SELECT *, CASE WHEN ACTION = 'turnover' AND t0 IS NULL AND coalesce(contains(lower(sub), 'excess timeout'), false) THEN last_value(CASE WHEN ACTION = 'timeout' THEN t0 END IGNORE NULLS) OVER (PARTITION BY game ORDER BY SEQ ROWS UNBOUNDED PRECEDING) ELSE t0 END AS team,
 first_value(CASE WHEN ACTION NOT IN ('substitution', 'timeout', 'other') THEN {'a': ACTION, 'e': ELAPSED} END IGNORE NULLS) OVER (PARTITION BY game ORDER BY SEQ ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
 last_value(CASE WHEN ACTION NOT IN ('substitution', 'timeout', 'other') THEN {'a': ACTION, 'e': ELAPSED} END IGNORE NULLS) OVER (PARTITION BY game ORDER BY SEQ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prv,
 coalesce(regexp_matches(said, '^MISS\s'), false) AS miss, coalesce(regexp_matches(said, '\([0-9]+ PTS\)'), false) AS pts FROM n2),
 n4 AS (SELECT *, CASE WHEN ACTION = 'free_throw' THEN CASE WHEN result <> '' THEN 'shot_result' WHEN pts AND NOT miss THEN 'description_pts' WHEN miss AND NOT pts THEN 'description_miss' WHEN miss AND pts THEN 'unknown' WHEN coalesce(nxt.a = 'rebound', false) THEN 'inferred_next_rebound'
 WHEN coalesce(prv.a = 'rebound' AND prv.e = ELAPSED, false) THEN 'inferred_adjacent_rebound' ELSE 'unknown' END END AS source, lower(concat_ws(' ', sub, replace(descr, '-', ' '))) AS txt,
 concat_ws(' ', translate(lower(sub), '-.', '  ') || ' ' || translate(lower(said), '-.', '  '), replace(lower(descr), '-', ' ')) AS words FROM n3),
 n5 AS (SELECT *, CASE source WHEN 'shot_result' THEN result = 'Made' WHEN 'description_pts' THEN true WHEN 'description_miss' THEN false WHEN 'inferred_next_rebound' THEN false WHEN 'inferred_adjacent_rebound' THEN false END AS made,
 CASE WHEN ACTION = 'free_throw' THEN CASE WHEN contains(txt, 'technical') THEN 'technical' WHEN contains(txt, 'flagrant') THEN 'flagrant' WHEN contains(txt, 'clear path') THEN 'clear_path' WHEN contains(txt, 'away from play') THEN 'away_from_play' WHEN contains(txt, 'transition take') THEN 'transition_take' WHEN regexp_matches(txt, '[0-9]+\s+of\s+[0-9]+') THEN 'regular' ELSE 'unknown' END END AS kind0,
 ACTION = 'foul' AND coalesce(contains(words, 'technical'), false) AS technical, CASE WHEN ACTION = 'foul' AND NOT coalesce(contains(words, 'technical'), false) THEN CASE WHEN contains(words, 'inbound') THEN 'inbound' WHEN contains(words, 'transition take') THEN 'transition_take' WHEN contains(words, 'away from play') THEN 'away_from_play' ELSE 'none' END END AS mark FROM n4),
 n6 AS (SELECT *, CASE WHEN kind0 <> 'technical' THEN TRY_CAST(regexp_extract(txt, '([0-9]+)\s+of\s+([0-9]+)', 1) AS INT) END AS num, CASE WHEN kind0 <> 'technical' THEN TRY_CAST(regexp_extract(txt, '([0-9]+)\s+of\s+([0-9]+)', 2) AS INT) END AS of_,
 last_value(mark IGNORE NULLS) OVER (PARTITION BY game, ELAPSED ORDER BY SEQ ROWS UNBOUNDED PRECEDING) AS lastmark, sum(CAST(technical AS INT)) OVER (PARTITION BY game, ELAPSED ORDER BY SEQ ROWS UNBOUNDED PRECEDING) > 0 AS seen, bool_or(ACTION = 'made_shot') OVER (PARTITION BY game, ELAPSED, team) AS scored FROM n5),
 n7 AS (SELECT *, CASE WHEN kind0 = 'regular' AND of_ = 1 AND lastmark IN ('away_from_play', 'transition_take', 'inbound') THEN lastmark WHEN kind0 = 'regular' AND of_ = 1 AND lastmark IS NULL AND seen AND NOT scored THEN 'technical' ELSE kind0 END AS kind,
 CASE WHEN ACTION = 'made_shot' AND worth IN (2, 3) THEN worth WHEN ACTION = 'free_throw' AND coalesce(made, false) THEN 1.0 ELSE 0.0 END AS points, coalesce(team = 10, false) AS home, coalesce(team = 11, false) AS away FROM n6),
 n AS (SELECT lpad(CAST(game AS VARCHAR), 10, '0') AS GAME_ID, CAST(SEQ AS INT) AS SEQ, PERIOD, ELAPSED, ACTION, team AS TEAM_ID, made AS FT_MADE, source AS FT_OUTCOME_SOURCE, kind AS FT_KIND, num AS FT_NUM, of_ AS FT_OF, ACTION = 'period' AND coalesce(contains(sub, 'end'), false) AS PERIOD_END,
 CAST(CASE WHEN home THEN points ELSE 0 END AS DOUBLE) AS PTS_HOME, CAST(CASE WHEN away THEN points ELSE 0 END AS DOUBLE) AS PTS_AWAY, CAST(sum(CASE WHEN home THEN points ELSE 0 END) OVER q AS DOUBLE) AS SCORE_HOME, CAST(sum(CASE WHEN away THEN points ELSE 0 END) OVER q AS DOUBLE) AS SCORE_AWAY,
 ACTION = 'free_throw' AND made IS NULL OR (ACTION = 'made_shot' OR ACTION = 'free_throw' AND coalesce(made, false)) AND (NOT (home OR away) OR ACTION = 'made_shot' AND NOT coalesce(worth IN (2, 3), false)) AS SCORING_UNRESOLVED,
 CASE WHEN ACTION IN ('made_shot', 'free_throw') THEN sh END AS OBS_SCORE_HOME, CASE WHEN ACTION IN ('made_shot', 'free_throw') THEN sa END AS OBS_SCORE_AWAY, ten AS LINEUP_VALID, inverted AS ORDER_INVERSION FROM n7 WINDOW q AS (PARTITION BY game ORDER BY SEQ ROWS UNBOUNDED PRECEDING))"""
SHOWN = "GAME_ID SEQ PERIOD ELAPSED ACTION TEAM_ID FT_MADE FT_OUTCOME_SOURCE FT_KIND FT_NUM FT_OF PERIOD_END PTS_HOME PTS_AWAY SCORE_HOME SCORE_AWAY SCORING_UNRESOLVED OBS_SCORE_HOME OBS_SCORE_AWAY LINEUP_VALID ORDER_INVERSION".split()


def raw_log(t) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = dealt(t.events.select("user_id", "event_id", "event_type", "ts", "value"), t.events.count(), ["user_id"])
    b = events.withColumn("rn", (F.row_number().over(w) - 1).cast("long")).withColumn("k", F.floor("value") % 10).withColumn("total", F.count("*").over(Window.partitionBy("user_id")))
    kind, i, k, rn, odd = F.col("event_type"), F.col("event_id"), F.col("k"), F.col("rn"), F.col("user_id") % 2 == 1
    signup = F.when(k % 5 == 0, "Foul").when(k % 5 == 1, "Turnover").when(k % 5 == 2, "Timeout").when(k % 5 == 3, "Substitution").otherwise("Ejection")
    b = b.withColumn("actionType", F.when((rn % 30 == 29) | (rn == F.col("total") - 1), "period").when(kind == "view", " Made  Shot").when(kind == "click", "Missed Shot").when(kind == "purchase", "FREE THROW").when(kind == "error", "rebound").otherwise(signup))
    word = F.col("actionType")
    throw, foul = word == "FREE THROW", word == "Foul"
    trip = F.when(k % 5 == 0, "Free Throw 1 of 1").when(k % 5 == 1, "Free Throw 1 of 2").when(k % 5 == 2, "Free Throw 2 of 2").when(k % 5 == 3, "Technical").otherwise("Flagrant 1 of 2")
    sub = F.when(throw, trip).when(foul, F.when(i % 3 == 0, "Personal").when(i % 3 == 1, "Technical").otherwise("Away-From-Play")).when((word == "Turnover") & (i % 2 == 0), "Excess Timeout").when(word == "period", F.when(i % 19 != 0, "end").otherwise("start"))
    said = F.when(throw, F.when(k == 7, "MISS x").when(k == 8, "MISS x (3 PTS)").when(k > 4, "y (3 PTS)").otherwise("z")).when(foul, "f")
    five = lambda a: F.array(*(F.lit(x).cast("long") for x in range(a, a + 5)))
    return b.select(
        F.col("user_id").alias("gameId"), (1 + F.floor(rn / 30)).alias("period"), (rn * 4.0 - F.when(i % 6 == 0, 4.0).otherwise(0.0)).alias("event_time"), F.when(i % 29 != 0, rn * 10.0 - F.when(i % 23 == 0, 15).otherwise(0)).alias("orderNumber"), i.alias("ingest_ord"), "actionType",
        sub.alias("subType"), F.when(foul & (i % 4 == 0), "transition-take").alias("descriptor"), said.alias("description"), F.when((i % 11 == 0) & odd, 0).otherwise(10 + k % 2).alias("teamId"), F.when(i % 22 == 0, 10 + k % 2).otherwise(i % 500 + 1000).alias("personId"),
        F.when(throw, F.when(i % 5 == 0, "Made").when((i % 5 == 1) | (~odd & (i % 2 == 0)), "Missed").when(~odd, "Made").otherwise("")).alias("shotResult"), F.when((word == " Made  Shot") & ((i % 37 != 0) | ~odd), 2 + i % 2).alias("shotValue"),
        F.when(i % 41 == 0, "0").otherwise(F.floor(rn / 3).cast("string")).alias("scoreHome"), F.floor(rn / 4).cast("string").alias("scoreAway"), five(1).alias("home_lineup"), F.when(i % 13 != 0, five(6)).otherwise(F.slice(five(6), 1, 4)).alias("away_lineup"))


def normal_log(t) -> DataFrame:
    games = t.events.select(F.col("user_id").alias("GAME_ID")).distinct()
    teams = games.select("GAME_ID", F.lit(10).cast("long").alias("HOME_TEAM_ID"), F.lit(11).cast("long").alias("AWAY_TEAM_ID"))
    players = games.select("GAME_ID", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("p")).select("GAME_ID", F.col("p").cast("long").alias("PLAYER_ID"), F.when(F.col("p") <= 5, 10).otherwise(11).cast("long").alias("TEAM_ID"))
    return EV.normalized(raw_log(t), teams, players, t.events.count())


@query(NORMAL + f" SELECT {', '.join(SHOWN)} FROM n")
def normalized_events(t):
    """A raw log in normal form: order and inversions, teams, free throws with the sources of their outcomes and their kinds, points, scoreboard, lineups."""
    return normal_log(t).select(*SHOWN)


LEDGER = NORMAL + """, bx AS (SELECT GAME_ID, CASE WHEN g % 5 = 0 THEN oh WHEN g % 3 = 0 THEN fh ELSE fh + 1 END AS bh, CASE WHEN g % 5 = 0 THEN oa WHEN g % 3 = 0 THEN fa ELSE fa END AS ba FROM (SELECT GAME_ID, CAST(GAME_ID AS BIGINT) AS g, arg_max(SCORE_HOME, SEQ) AS fh, arg_max(SCORE_AWAY, SEQ) AS fa,
 arg_max(OBS_SCORE_HOME, SEQ) FILTER (WHERE OBS_SCORE_HOME IS NOT NULL) AS oh, arg_max(OBS_SCORE_AWAY, SEQ) FILTER (WHERE OBS_SCORE_AWAY IS NOT NULL) AS oa FROM n GROUP BY 1)),
 sd AS (SELECT GAME_ID, SEQ, PERIOD, 'HOME' AS side, SCORE_HOME AS score, OBS_SCORE_HOME AS obs FROM n UNION ALL SELECT GAME_ID, SEQ, PERIOD, 'AWAY', SCORE_AWAY, OBS_SCORE_AWAY FROM n),
 en AS (SELECT GAME_ID, side, PERIOD, arg_max(score, SEQ) AS fin, max(obs) AS most FROM sd GROUP BY 1, 2, 3), sh AS (SELECT *, lag(obs) OVER (PARTITION BY GAME_ID, side ORDER BY SEQ) AS bef FROM sd WHERE obs IS NOT NULL),
 mk AS (SELECT *, max(CASE WHEN obs < bef THEN SEQ END) OVER (PARTITION BY GAME_ID, side) AS broke FROM sh), lt AS (SELECT *, min(CASE WHEN obs = score THEN SEQ END) OVER (PARTITION BY GAME_ID, side) AS anchor FROM mk WHERE SEQ >= broke),
 us AS (SELECT GAME_ID, side, max(PERIOD) AS until FROM lt WHERE anchor IS NULL OR SEQ < anchor OR SEQ = broke GROUP BY 1, 2), la AS (SELECT GAME_ID, side, arg_max(obs, SEQ) AS final FROM sh GROUP BY 1, 2),
 st AS (SELECT la.GAME_ID, la.side, coalesce(final = CASE la.side WHEN 'HOME' THEN bh ELSE ba END, false) AS ok, coalesce(until, 0) AS until FROM la LEFT JOIN bx USING (GAME_ID) LEFT JOIN us ON us.GAME_ID = la.GAME_ID AND us.side = la.side),
 pc AS (SELECT en.GAME_ID, count(*) FILTER (WHERE ok AND PERIOD > until) AS cp, count(*) FILTER (WHERE ok AND PERIOD > until AND most <> fin) AS mm, count(*) FILTER (WHERE NOT (ok AND PERIOD > until)) AS un, bool_and(ok) AS final_ok FROM en JOIN st ON st.GAME_ID = en.GAME_ID AND st.side = en.side WHERE most IS NOT NULL GROUP BY 1),
 ins AS (SELECT GAME_ID, arg_max(SCORE_HOME, SEQ) AS eh, arg_max(SCORE_AWAY, SEQ) AS ea, max(OBS_SCORE_HOME) AS oh, max(OBS_SCORE_AWAY) AS oa FROM n WHERE ELAPSED IS NOT NULL GROUP BY GAME_ID, PERIOD, ELAPSED),
 ic AS (SELECT GAME_ID, count(*) FILTER (WHERE oh IS NOT NULL OR oa IS NOT NULL) AS shown, count(*) FILTER (WHERE coalesce(oh <> eh, false) OR coalesce(oa <> ea, false)) AS off FROM ins GROUP BY 1),
 fp AS (SELECT GAME_ID, coalesce(max(CASE WHEN ACTION <> 'period' THEN PERIOD END), max(PERIOD)) AS final FROM n GROUP BY 1), ep AS (SELECT n.GAME_ID, max(CASE WHEN PERIOD_END AND PERIOD = final THEN SEQ END) AS endseq FROM n JOIN fp USING (GAME_ID) GROUP BY 1),
 gs AS (SELECT n.GAME_ID, arg_max(SCORE_HOME, SEQ) AS fh, arg_max(SCORE_AWAY, SEQ) AS fa, count(*) FILTER (WHERE SCORING_UNRESOLVED) AS unresolved, any_value(endseq) IS NOT NULL AS has_end, coalesce(bool_or(SEQ > endseq AND (ACTION = 'made_shot' OR ACTION = 'free_throw' AND coalesce(FT_MADE, false))), false) AS late,
 count(*) FILTER (WHERE ORDER_INVERSION) AS inversions FROM n JOIN ep USING (GAME_ID) GROUP BY 1),
 ga AS (SELECT gs.*, bh, ba, coalesce(cp, 0) AS cp, coalesce(mm, 0) AS mm, coalesce(un, 0) AS un, coalesce(final_ok, true) AS final_ok, coalesce(off, 0) AS off, concat_ws('; ', CASE WHEN NOT coalesce(fh = bh AND fa = ba, false) THEN 'final_score_mismatch_box' END, CASE WHEN unresolved > 0 THEN 'unresolved_scoring_event' END,
 CASE WHEN coalesce(mm, 0) > 0 THEN 'scoreboard_checkpoint_mismatch' END, CASE WHEN NOT has_end THEN 'stream_missing_final_period_end' WHEN late THEN 'scoring_after_final_period_end' END) AS reasons FROM gs LEFT JOIN bx USING (GAME_ID) LEFT JOIN pc USING (GAME_ID) LEFT JOIN ic USING (GAME_ID))"""


def box_of(norm: DataFrame) -> DataFrame:
    """A box record that agrees with the scoreboard, with the log, or with neither."""
    g = F.col("GAME_ID").cast("long") % 15
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("SEQ")))
    sides = norm.groupBy("GAME_ID").agg(F.max_by("SCORE_HOME", "SEQ").alias("fh"), F.max_by("SCORE_AWAY", "SEQ").alias("fa"), last("OBS_SCORE_HOME").alias("oh"), last("OBS_SCORE_AWAY").alias("oa"))
    return sides.select("GAME_ID", F.when(g % 5 == 0, F.col("oh")).when(g % 3 == 0, F.col("fh")).otherwise(F.col("fh") + 1).alias("HOME_PTS"), F.when(g % 5 == 0, F.col("oa")).otherwise(F.col("fa")).alias("AWAY_PTS"))


@query(LEDGER + """ SELECT GAME_ID, fh AS FINAL_HOME, fa AS FINAL_AWAY, bh AS BOX_HOME, ba AS BOX_AWAY, unresolved AS UNRESOLVED_SCORING_EVENTS, has_end AS HAS_PERIOD_END, inversions AS ORDER_INVERSIONS, cp AS CHECKPOINTS, mm AS CHECKPOINT_MISMATCHES, un AS SCOREBOARD_UNCHECKED_PERIODS, final_ok AS SCOREBOARD_FINAL_MATCHES_BOX,
 off AS INSTANT_CHECKPOINT_MISMATCHES, CASE WHEN reasons = '' THEN 'ADMITTED' ELSE 'QUARANTINED' END AS STATUS, nullif(reasons, '') AS REASON FROM ga""")
def game_status(t):
    """Each game's score against its box and its scoreboard by period and instant; admitted, or quarantined with its reasons in order."""
    norm = stored(normal_log(t), "normal-log")
    return EV.game_status(norm, box_of(norm), t.events.count())


@query(LEDGER + """ SELECT GAME_ID, count(*) AS events, CAST(sum(PTS_HOME + PTS_AWAY) AS DOUBLE) AS points, count(*) FILTER (WHERE SCORING_UNRESOLVED) AS unresolved, count(*) FILTER (WHERE LINEUP_VALID) AS in_lineups FROM n
 WHERE SCORING_UNRESOLVED OR PTS_HOME > 0 OR PTS_AWAY > 0 GROUP BY 1""")
def scoring_events(t):
    """The rows that scored and those of unknown outcome, summed by game; an unknown one has neither team nor points."""
    made = EV.scoring_events(normal_log(t))
    none = F.col("POINTS").isNull()
    return made.groupBy("GAME_ID").agg(F.count("*").alias("events"), F.sum(F.coalesce("POINTS", F.lit(0.0))).alias("points"), F.count_if(none).alias("unresolved"), F.count_if("LINEUP_VALID").alias("in_lineups"))
