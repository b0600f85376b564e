"""Contracts, release gates and their violations on tables made of orders and lines, some rows of which break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import contracts as C
from ..operators import forecasts as E
from ..operators import gate as G
from ..operators.numbering import stored
from ..operators.relational import dealt
from ..sources import files
from . import forecasting, ratings
from .registry import query

#: An order as an evaluated game; the orders whose key is divisible by a rule's number break that rule.
GAMES = """WITH g AS (SELECT *, year(o_orderdate) + 22 AS y FROM orders), e AS (SELECT CASE WHEN o_orderkey % 89 = 0 THEN '0029909999' ELSE '002' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') END AS GAME_ID,
 CASE WHEN o_orderkey % 79 = 0 THEN NULL WHEN o_orderkey % 83 = 0 THEN o_orderkey + 0.5::DOUBLE ELSE CAST(o_orderkey AS DOUBLE) END AS EVAL_ORDER, y || '-' || strftime(o_orderdate, '%m-%d') AS GAME_DATE,
 CASE WHEN o_orderkey % 97 = 0 THEN '2023-99' ELSE y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') END AS SEASON, CASE WHEN o_orderkey % 71 = 0 THEN 'other' WHEN y <= 2022 THEN 'development' ELSE 'holdout' END AS PHASE,
 CASE WHEN o_orderkey % 61 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice / 1000 END AS ACTUAL, CASE WHEN o_orderkey % 67 <> 0 THEN o_custkey % 5 <> 0 END AS MATCHED, o_custkey % 3 = 0 AS EARLY_SEASON, CASE WHEN o_orderkey % 59 <> 0 THEN true END AS ROOKIE_HEAVY,
 false AS TEAM_CHANGE, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE 1.0 END AS p FROM g)"""


def games(t) -> DataFrame:
    k, y = F.col("o_orderkey"), F.year("o_orderdate") + 22
    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    odd = lambda n: k % n == 0
    return t.orders.select(
        F.when(odd(89), "0029909999").otherwise(F.concat(F.lit("002"), two(y), F.lpad((k % 100000).cast("string"), 5, "0"))).alias("GAME_ID"), F.when(odd(79), None).when(odd(83), k + 0.5).otherwise(k.cast("double")).alias("EVAL_ORDER"),
        F.concat_ws("-", y.cast("string"), F.date_format("o_orderdate", "MM-dd")).alias("GAME_DATE"), F.when(odd(97), "2023-99").otherwise(F.concat_ws("-", y.cast("string"), two(y + 1))).alias("SEASON"),
        F.when(odd(71), "other").when(y <= 2022, "development").otherwise("holdout").alias("PHASE"), F.when(odd(61), float("nan")).otherwise(F.col("o_totalprice") / 1000).alias("ACTUAL"), F.when(~odd(67), F.col("o_custkey") % 5 != 0).alias("MATCHED"),
        (F.col("o_custkey") % 3 == 0).alias("EARLY_SEASON"), F.when(~odd(59), True).alias("ROOKIE_HEAVY"), F.lit(False).alias("TEAM_CHANGE"), *(F.when(~odd(53), 1.0).alias(f"PLAYER_PART_{m}") for m in C.MODELS))


def _rule(name: str, condition: str) -> str:
    return f"SELECT '{name}' AS rule, count(*) FILTER (WHERE coalesce({condition}, true)) AS n, min(GAME_ID) FILTER (WHERE coalesce({condition}, true)) AS sample FROM d"


#: Conditions of the load contract in SQL.
RULES = {
    "ids of the wrong form": "NOT regexp_full_match(GAME_ID, '002[0-9]{7}')", "order that isn''t a finite integer": "NOT (coalesce(isfinite(EVAL_ORDER), false) AND EVAL_ORDER = floor(EVAL_ORDER))", "season labels of the wrong form": "NOT regexp_full_match(SEASON, '[0-9]{4}-[0-9]{2}')",
    **{f"{f} that isn''t explicit": f"{f} IS NULL" for f in C.FLAGS}, "other phases": "PHASE NOT IN ('development', 'holdout')", "dates that are missing or unreadable": "day IS NULL", "season years that aren''t consecutive": "(start + 1) % 100 <> TRY_CAST(substr(SEASON, 6, 2) AS INT)",
    "seasons outside their phase": "NOT (PHASE = 'development' AND SEASON IN (SELECT unnest([y || ''-'' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, ''0'') FOR y IN range(2016, 2023)])) OR PHASE = 'holdout' AND SEASON IN ('2023-24', '2024-25'))".replace("''", "'"),
    "ids that disagree with the season": "TRY_CAST(substr(GAME_ID, 4, 2) AS INT) <> start % 100", "dates outside the season''s years": "year(day) NOT IN (start, start + 1)",
    "matched rows with values that aren''t finite": "coalesce(MATCHED, false) AND NOT (coalesce(isfinite(ACTUAL), false) AND p IS NOT NULL)",
}


@query(GAMES + """, d AS (SELECT *, TRY_CAST(GAME_DATE AS DATE) AS day, TRY_CAST(substr(SEASON, 1, 4) AS INT) AS start FROM e), b AS (SELECT max(day) FILTER (WHERE PHASE = 'development') AS dev_end, min(day) FILTER (WHERE PHASE = 'holdout') AS begins,
 len(list_intersect(list(DISTINCT SEASON) FILTER (WHERE PHASE = 'development'), list(DISTINCT SEASON) FILTER (WHERE PHASE = 'holdout'))) AS shared, count(*) FILTER (WHERE PHASE = 'development' AND MATCHED) AS dm, count(*) FILTER (WHERE PHASE = 'holdout' AND MATCHED) AS hm FROM d),
 v AS (""" + " UNION ALL ".join(_rule(k, c) for k, c in RULES.items()) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{c} that isn''t unique', count(*), min(CAST({c} AS VARCHAR)) FROM (SELECT {c} FROM d GROUP BY {c} HAVING count(*) > 1)" for c in ("GAME_ID", "EVAL_ORDER")) + """
 UNION ALL SELECT 'phases that are absent', count(*) FILTER (WHERE dev_end IS NULL OR begins IS NULL), NULL FROM b UNION ALL SELECT 'development that doesn''t precede holdout', count(*) FILTER (WHERE coalesce(dev_end >= begins, true)), NULL FROM b
 UNION ALL SELECT 'seasons of both phases', count(*) FILTER (WHERE shared > 0), NULL FROM b UNION ALL SELECT 'phases without matched games', count(*) FILTER (WHERE least(dm, hm) = 0), NULL FROM b
 UNION ALL SELECT 'parameters that aren''t finite or in order', 1, NULL UNION ALL SELECT 'development counts that disagree', CASE WHEN dm = 4 THEN 0 ELSE 1 END, NULL FROM b UNION ALL SELECT 'models without parameters', 1, NULL)
 SELECT rule, n, CASE WHEN n > 0 AND sample LIKE '002%' THEN sample END AS sample FROM v""")
def evaluation_contract(t):
    """The rules of an evaluation table and its parameters, how many rows break each, and one of them."""
    g = stored(games(t), "games")
    n = g.where("PHASE = 'development' and MATCHED").count()
    frozen = t.spark.createDataFrame([("pregame_v1", 0.0, -1.0, 1.0, n), ("B0_home_only", 0.0, 1.0, -1.0, n), ("B1_prev_v2", 0.0, -1.0, 1.0, 4)], "model string, h double, q10 double, q90 double, n_development_games long")
    found = C.evaluation_violations(g, frozen)
    return found.select("rule", "n", F.when((F.col("n") > 0) & F.col("sample").startswith("002"), F.col("sample")).alias("sample"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag <> 'A'), d AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 43 <> 0), j AS (SELECT s.k, day FROM s LEFT JOIN d USING (k))
 SELECT 'stints without a date' AS rule, count(*) FILTER (WHERE day IS NULL) AS n FROM j UNION ALL SELECT 'stints at or after the cutoff', count(*) FILTER (WHERE day >= DATE '2000-06-01') FROM j""")
def future_guard(t):
    """Games of training stints that have no date, or one at or after the cutoff."""
    stints = t.lineitem.where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("game_id"))
    dates = t.orders.where("o_orderkey % 43 <> 0").select(F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").cast("date").alias("game_date"))
    import datetime

    return C.future_violations(stints, dates, datetime.date(2000, 6, 1)).select("rule", "n")


def refused(work) -> bool:
    try:
        work()
    except C.Refused:
        return True
    return False


@query(ratings.SQL_OF_PENALTY + """, fr AS (SELECT count(*) FILTER (WHERE year(o_orderdate) <= 1999) AS n FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey)
 SELECT CAST(penalty AS DOUBLE) AS penalty, true AS other_season_refused, true AS other_estimator_refused, true AS holdout_refused, n AS holdout_development_games FROM (SELECT max(penalty) FILTER (WHERE e <= se OR penalty = best) AS penalty FROM ex, be), fr""")
def frozen_inputs(t):
    """The penalty comes from the stored manifest of the fit of the season before, and of no other; a holdout run takes its parameters from a development report."""
    fit = ratings.selected_penalty(t).select("penalty")
    name = {"estimator_id": "ridge", "target_season": "2000-01", "lambda": float(fit.first()["penalty"])}
    run = files.write_run({"penalty": fit}, f"{files_root(t)}/fits", {}, name)
    manifest = files.verify_run(t.spark, run)["parameters"]
    penalty = C.frozen_penalty(manifest, "ridge", "2000-01")
    report = {"development": {"frozen": E.frozen_parameters(forecasting.evaluation(t).where("phase = 'development'"), []).first().asDict()}}
    flags = (refused(lambda: C.frozen_penalty(manifest, "ridge", "2001-02")), refused(lambda: C.frozen_penalty(manifest, "lasso", "2000-01")), refused(lambda: C.parameters_for("holdout", {})))
    return t.spark.createDataFrame([(penalty, *flags, C.parameters_for("holdout", report)["n"])], "penalty double, other_season_refused boolean, other_estimator_refused boolean, holdout_refused boolean, holdout_development_games long")


def files_root(t) -> str:
    from .stores import folder

    return folder(t, "contracts")


#: Lines as possessions of a game's two teams (one customer's nation and the next one), points credited to the scoring team, else to the offence.
PLAYED = """WITH q AS (SELECT o_orderkey AS game, CAST(year(o_orderdate) AS VARCHAR) AS season, c_nationkey AS ta, c_nationkey + 1 AS tb, CASE WHEN l_orderkey % 37 <> 0 OR l_linenumber <> 1 THEN c_nationkey + l_linenumber % 2 END AS offense,
 CASE WHEN l_linenumber = 5 THEN c_nationkey END AS scoring, CAST(floor(l_quantity) AS BIGINT) % 4 AS pts FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
 a AS (SELECT game, season, ta, tb, sum(CASE WHEN coalesce(scoring, offense) = ta THEN pts ELSE 0 END) AS pa, sum(CASE WHEN coalesce(scoring, offense) = tb THEN pts ELSE 0 END) AS pb, count(*) FILTER (WHERE offense = ta) AS na, count(*) FILTER (WHERE offense = tb) AS nb,
 count(*) FILTER (WHERE offense IS NULL) AS un, sum(CASE WHEN scoring IS NULL AND offense IS NULL THEN pts ELSE 0 END) AS up FROM q GROUP BY 1, 2, 3, 4),
 x AS (SELECT lpad(CAST(game AS VARCHAR), 10, '0') AS GAME_ID, season AS SEASON_ID, CASE WHEN game % 41 <> 0 THEN 4.0 END AS PERIODS, CAST(pa AS DOUBLE) AS PBP_PTS_A, CAST(pb AS DOUBLE) AS PBP_PTS_B, CAST(pa + CASE WHEN game % 31 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS BOX_PTS_A, CAST(pb AS DOUBLE) AS BOX_PTS_B,
 na AS POSS_A, nb AS POSS_B, un AS UNATTRIBUTED_POSS, CAST(up AS DOUBLE) AS UNATTRIBUTED_PTS FROM a WHERE game % 29 <> 0),
 y AS (SELECT *, PBP_PTS_A = BOX_PTS_A AND PBP_PTS_B = BOX_PTS_B AS SCORING_RECONCILED, UNATTRIBUTED_POSS = 0 AND UNATTRIBUTED_PTS = 0 AS ATTRIBUTION_COMPLETE, coalesce(abs(POSS_A - POSS_B) <= PERIODS, false) AS ALTERNATION_OK FROM x),
 w AS (SELECT *, SCORING_RECONCILED AND ATTRIBUTION_COMPLETE AND ALTERNATION_OK AS GAME_VALID FROM y)"""


def accounting(t) -> DataFrame:
    """The 11 columns of game accounting, from lines as possessions."""
    n, games = t.lineitem.count(), t.orders.count()
    sides = dealt(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), games, ["o_custkey"]).join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    sides = stored(sides.select("o_orderkey", "c_nationkey", F.year("o_orderdate").cast("string").alias("season")), "sides")
    # all that follows is by game, in one stage, as the lines are dealt out
    lines = dealt(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), n, ["l_orderkey"]).join(sides.hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey"))
    offense = F.when((F.col("l_orderkey") % 37 != 0) | (F.col("l_linenumber") != 1), F.col("c_nationkey") + F.col("l_linenumber") % 2)
    played = lines.select(F.col("l_orderkey").alias("game"), "season", F.col("c_nationkey").alias("first"), offense.alias("offense_team"), F.when(F.col("l_linenumber") == 5, F.col("c_nationkey")).alias("scoring_team"), (F.floor("l_quantity") % 4).alias("points"))
    poss, credit = played.select("game", "offense_team", "scoring_team", "points"), F.coalesce("scoring_team", "offense_team")
    scored = lambda team, odd: (F.coalesce(F.sum(F.when(credit == team, F.col("points"))), F.lit(0)) + odd).alias("pts")
    team = lambda c, odd: F.struct(c.alias("team"), scored(c, odd))
    first, extra = F.col("first"), F.when(F.col("game") % 31 == 0, 1).otherwise(0)
    box = played.where("game % 29 <> 0").groupBy("game", "season", "first").agg(F.array(team(first, extra), team(first + 1, F.lit(0))).alias("teams"))
    box = box.select("game", "season", F.explode("teams").alias("x")).select("game", "season", "x.*")
    periods = t.orders.select(F.col("o_orderkey").alias("game"), F.when(F.col("o_orderkey") % 41 != 0, 4.0).alias("periods"))
    return G.accounting_rows(poss, box, periods)


ACCOUNTED = ["GAME_ID", "SEASON_ID", "PERIODS", "PBP_PTS_A", "PBP_PTS_B", "BOX_PTS_A", "BOX_PTS_B", "POSS_A", "POSS_B", "UNATTRIBUTED_POSS", "UNATTRIBUTED_PTS", "SCORING_RECONCILED", "ATTRIBUTION_COMPLETE", "ALTERNATION_OK", "GAME_VALID"]


@query(PLAYED + f" SELECT {', '.join(ACCOUNTED)} FROM w")
def game_accounting(t):
    """Both teams' points and possessions of each game beside the box, and whether the game may be released."""
    return G.game_accounting(accounting(t)).select(*ACCOUNTED)


SEASONS = PLAYED + """, ex AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS GAME_ID, CAST(year(o_orderdate) AS VARCHAR) AS SEASON_ID, o_orderkey AS k FROM orders WHERE o_orderkey % 47 <> 0),
 de AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS GAME_ID, coalesce((CASE WHEN o_orderkey % 2 = 0 THEN 'link_empty' ELSE 'no_bronze_pbp' END) = (CASE WHEN o_orderkey % 11 = 0 THEN 'final_score' WHEN o_orderkey % 2 = 0 THEN 'link_empty' ELSE 'no_bronze_pbp' END), false) AS accepted FROM orders WHERE o_orderkey % 29 = 0),
 m AS (SELECT coalesce(ex.SEASON_ID, w.SEASON_ID) AS SEASON_ID, ex.GAME_ID IS NOT NULL AS wanted, w.GAME_ID IS NOT NULL AS here, w.GAME_VALID, de.accepted, coalesce(de.accepted, false) AND ex.GAME_ID IS NOT NULL AS out FROM ex FULL JOIN w ON ex.GAME_ID = w.GAME_ID LEFT JOIN de ON de.GAME_ID = coalesce(ex.GAME_ID, w.GAME_ID)),
 r AS (SELECT SEASON_ID, count(*) FILTER (WHERE wanted) AS expected_games, count(*) FILTER (WHERE wanted AND here AND NOT out) AS present_games, count(*) FILTER (WHERE wanted AND NOT out AND NOT here) AS missing_games, count(*) FILTER (WHERE NOT wanted AND here AND NOT out) AS unexpected_games,
 count(*) FILTER (WHERE out) AS excluded_games, count(*) FILTER (WHERE wanted AND NOT accepted) AS rejected_exclusions, count(*) FILTER (WHERE here AND NOT out AND NOT GAME_VALID) AS invalid_games FROM m GROUP BY 1),
 st AS (SELECT *, CASE WHEN missing_games + unexpected_games + rejected_exclusions + invalid_games > 0 THEN 'FAIL' WHEN excluded_games > 0 THEN 'PASS_WITH_EXCLUSIONS' ELSE 'PASS' END AS status FROM r WHERE expected_games > 0)"""
RELEASE = ["expected_games", "present_games", "missing_games", "unexpected_games", "excluded_games", "rejected_exclusions", "invalid_games", "status"]


def releases(t) -> DataFrame:
    name = S.padded_id(F.col("o_orderkey")).alias("GAME_ID")
    expected = dealt(t.orders.where("o_orderkey % 47 <> 0").select(name, F.year("o_orderdate").cast("string").alias("SEASON_ID")), t.orders.count(), ["GAME_ID"])
    reason = F.when(F.col("o_orderkey") % 2 == 0, "link_empty").otherwise("no_bronze_pbp")
    declared = t.orders.where("o_orderkey % 29 = 0").select(name, reason.alias("DECLARED"), F.when(F.col("o_orderkey") % 11 == 0, "final_score").otherwise(reason).alias("ACTUAL"))
    return G.season_release(accounting(t), expected, declared)


@query(SEASONS + f" SELECT SEASON_ID, {', '.join(RELEASE)} FROM st")
def released_seasons(t):
    """Each season's games, missing, unexpected, excluded and invalid ones, and the status of its release."""
    return releases(t).select("SEASON_ID", *RELEASE)


@query(SEASONS + """ SELECT CASE WHEN grouping(SEASON_ID) = 1 THEN 'all' ELSE SEASON_ID END AS season, sum(expected_games) AS expected, sum(present_games) AS present, sum(excluded_games) AS excluded, sum(missing_games + unexpected_games + rejected_exclusions + invalid_games) AS faults,
 round(sum(present_games - invalid_games) / sum(expected_games) + 1e-9, 6) AS valid_share, count(*) FILTER (WHERE status = 'FAIL') AS failing FROM st GROUP BY ROLLUP (SEASON_ID)""")
def season_summary(t):
    """The releases of all seasons in one table, with a line for all."""
    r = stored(releases(t), "releases")
    faults = F.col("missing_games") + F.col("unexpected_games") + F.col("rejected_exclusions") + F.col("invalid_games")
    rolled = r.rollup("SEASON_ID").agg(F.grouping("SEASON_ID").alias("all"), F.sum("expected_games").alias("expected"), F.sum("present_games").alias("present"), F.sum("excluded_games").alias("excluded"), F.sum(faults).alias("faults"),
        F.sum(F.col("present_games") - F.col("invalid_games")).alias("valid"), F.count_if(F.col("status") == "FAIL").alias("failing"))
    return rolled.select(F.when(F.col("all") == 1, "all").otherwise(F.col("SEASON_ID")).alias("season"), "expected", "present", "excluded", "faults", S.stable(F.col("valid") / F.col("expected")).alias("valid_share"), "failing")


@query(forecasting.EVAL + """, m AS (SELECT phase || '_' || season AS name, sqrt(avg(power(part - actual, 2))) AS v, count(*) AS n FROM e GROUP BY phase, season), w AS (SELECT name, v + CASE WHEN n % 3 = 0 THEN 0.01 ELSE 1e-9 END AS x FROM m WHERE n % 5 <> 0 UNION ALL SELECT 'unknown', 1.0)
 SELECT coalesce(m.name, w.name) AS name, round(v + 1e-9, 4) AS value, round(x + 1e-9, 4) AS expected FROM m FULL JOIN w USING (name) WHERE NOT coalesce(abs(v - x) <= 1e-6, false)""")
def golden_scalars(t):
    """Metrics beside expected values; those that differ, and those that only one side has."""
    e = forecasting.evaluation(t)
    m = stored(E.point_metrics(e, ["phase", "season"], forecast="part").select(F.concat_ws("_", "phase", "season").alias("name"), F.col("rmse").alias("value"), "n"), "metrics")
    golden = m.where("n % 5 <> 0").select("name", (F.col("value") + F.when(F.col("n") % 3 == 0, 0.01).otherwise(1e-9)).alias("value")).union(t.spark.range(1).select(F.lit("unknown"), F.lit(1.0)))
    return C.scalars_off(m, golden, 1e-6).select("name", S.stable(F.col("value"), 4).alias("value"), S.stable(F.col("expected"), 4).alias("expected"))


#: The tables of a run, made of the event log: a user is a game, an event a possession, and numbers' remainders break rules.
RUN = """WITH b AS (SELECT user_id AS u, lpad(CAST(user_id AS VARCHAR), 10, '0') AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS s, event_id AS e, event_type AS ty, CAST(floor(value) AS BIGINT) AS v FROM events),
 al AS (SELECT u, g AS GAME_ID, 1 + s // 40 AS PERIOD, s AS POSS_IDX, s * 2 + CASE WHEN e % 101 = 0 THEN 1 ELSE 0 END AS START_SEQ, s * 2 + 1 AS END_SEQ, CASE ty WHEN 'view' THEN 'made_shot' WHEN 'purchase' THEN 'turnover' WHEN 'error' THEN 'end_of_period' ELSE 'defensive_rebound' END AS OUTCOME, CASE WHEN e % 103 <> 0 THEN 10 + v % 2 END AS OFFENSE_TEAM_ID,
 CAST(v % 3 AS DOUBLE) AS HOME_PTS, CAST(v % 2 AS DOUBLE) AS AWAY_PTS, e, v, ty, s FROM b), po AS (SELECT * FROM al WHERE u % 10 <> 0 OR u % 20 = 0),
 st AS (SELECT DISTINCT u, g AS GAME_ID, CASE WHEN u % 10 <> 0 THEN 'ADMITTED' ELSE 'QUARANTINED' END AS STATUS, CASE WHEN u % 10 = 0 THEN CASE WHEN u % 30 = 0 THEN 'source_order_unresolvable' WHEN u % 50 <> 0 THEN 'source_possession_unlogged' END END AS REASON, u % 5 AS FINAL_HOME, u % 5 + CASE WHEN u % 70 = 0 THEN 1 ELSE 0 END AS BOX_HOME,
 CASE WHEN u % 40 = 0 THEN 1 ELSE 0 END AS UNRESOLVED, u % 3 AS INVERSIONS, CASE WHEN u % 60 = 0 THEN 'live' ELSE 'legacy' END AS EVENT_SCHEMA FROM b WHERE u % 47 <> 0),
 ad AS (SELECT GAME_ID FROM st WHERE STATUS = 'ADMITTED'), sg AS (SELECT GAME_ID, u, PERIOD, POSS_IDX, HOME_PTS, AWAY_PTS, CASE WHEN e % 107 = 0 THEN 0 ELSE 1 END AS POSS_COUNT, e FROM po WHERE e % 109 <> 0),
 sn AS (SELECT GAME_ID, u, sum(POSS_COUNT) + CASE WHEN u % 13 = 0 THEN 1 ELSE 0 END AS c, sum(HOME_PTS) AS h, sum(AWAY_PTS) AS a, CASE WHEN u % 9 = 0 THEN 'inf'::DOUBLE ELSE 1.0 END AS rate FROM sg WHERE e % 5 <> 0 GROUP BY 1, 2),
 xn AS (SELECT GAME_ID, sum(POSS_COUNT) AS c, sum(HOME_PTS) AS h, sum(AWAY_PTS) AS a FROM sg WHERE e % 5 = 0 GROUP BY 1), ss AS (SELECT GAME_ID, sum(POSS_COUNT) AS c, sum(HOME_PTS) AS h, sum(AWAY_PTS) AS a FROM sg GROUP BY 1),
 bx AS (SELECT GAME_ID, sum(HOME_PTS) + CASE WHEN u % 15 = 0 THEN 1 ELSE 0 END AS bh, sum(AWAY_PTS) AS ba FROM al GROUP BY GAME_ID, u), ep AS (SELECT * FROM al WHERE u % 10 = 0 AND u % 110 <> 0),
 ee AS (SELECT GAME_ID, s * 2 + k AS SEQ, CASE ty WHEN 'view' THEN 'made_shot' WHEN 'click' THEN 'missed_shot' WHEN 'purchase' THEN 'turnover' ELSE 'rebound' END AS ACTION, 10 + v % 2 AS TEAM_ID, CASE WHEN e % 19 <> 0 THEN 10 + v % 2 END AS PT, s * 2.0 + k AS ELAPSED FROM al, (SELECT unnest([0, 1]) AS k) WHERE u % 10 = 0 AND u % 130 <> 0),
 tc AS (SELECT GAME_ID, PERIOD, count(*) FILTER (WHERE OFFENSE_TEAM_ID = a) AS na, count(*) FILTER (WHERE OFFENSE_TEAM_ID = b AND a <> b) AS nb FROM po JOIN (SELECT GAME_ID, min(OFFENSE_TEAM_ID) AS a, max(OFFENSE_TEAM_ID) AS b FROM po GROUP BY 1) USING (GAME_ID) WHERE OFFENSE_TEAM_ID IS NOT NULL GROUP BY 1, 2),
 us AS (SELECT DISTINCT GAME_ID FROM po), ix AS (SELECT st.*, us.GAME_ID IS NOT NULL AS used, FINAL_HOME <> BOX_HOME OR UNRESOLVED <> 0 AS inexact FROM st LEFT JOIN us ON us.GAME_ID = st.GAME_ID),
 ul AS (SELECT GAME_ID FROM st WHERE REASON = 'source_possession_unlogged'), ow AS (SELECT *, lag(OFFENSE_TEAM_ID) OVER w AS team, lag(OUTCOME) OVER w AS outcome_, lag(END_SEQ) OVER w AS ended FROM ep WHERE GAME_ID IN (FROM ul) WINDOW w AS (PARTITION BY GAME_ID, PERIOD ORDER BY START_SEQ)),
 ft AS (SELECT GAME_ID, PERIOD FROM (SELECT GAME_ID, PERIOD, count(*) FILTER (WHERE OFFENSE_TEAM_ID = a) AS na, count(*) FILTER (WHERE OFFENSE_TEAM_ID = b AND a <> b) AS nb FROM ow JOIN (SELECT GAME_ID, min(OFFENSE_TEAM_ID) AS a, max(OFFENSE_TEAM_ID) AS b FROM ow GROUP BY 1) USING (GAME_ID) WHERE OFFENSE_TEAM_ID IS NOT NULL GROUP BY 1, 2) WHERE abs(na - nb) > 1),
 vr AS (SELECT ow.GAME_ID, ow.PERIOD, bool_and(coalesce(outcome_ IN ('made_shot', 'and_one', 'turnover', 'defensive_rebound', 'free_throw_made') AND n.ACTION IN ('made_shot', 'missed_shot', 'turnover') AND n.TEAM_ID = OFFENSE_TEAM_ID AND n.ELAPSED > t.ELAPSED AND coalesce(t.PT = t.TEAM_ID, false) AND coalesce(n.PT = n.TEAM_ID, false), false)) AS ok
 FROM ow JOIN ft ON ft.GAME_ID = ow.GAME_ID AND ft.PERIOD = ow.PERIOD LEFT JOIN ee t ON t.GAME_ID = ow.GAME_ID AND t.SEQ = ended LEFT JOIN ee n ON n.GAME_ID = ow.GAME_ID AND n.SEQ = START_SEQ WHERE team = OFFENSE_TEAM_ID GROUP BY 1, 2),
 xp AS (SELECT ft.GAME_ID, bool_and(coalesce(ok, false)) AS explained FROM ft LEFT JOIN vr ON vr.GAME_ID = ft.GAME_ID AND vr.PERIOD = ft.PERIOD GROUP BY 1),
 ch AS (SELECT 'every_cohort_game_has_a_status' AS name, (SELECT count(*) FROM (SELECT DISTINCT g FROM b) WHERE g NOT IN (SELECT GAME_ID FROM st)) + 1 AS broken UNION ALL SELECT 'quarantine_has_reason', count(*) FROM st WHERE STATUS <> 'ADMITTED' AND coalesce(REASON, '') = ''
 UNION ALL SELECT 'only_admitted_games_reconstructed', count(*) FROM po WHERE GAME_ID NOT IN (FROM ad) UNION ALL SELECT 'possessions_tile_each_game', count(*) FROM (SELECT START_SEQ, lag(END_SEQ) OVER (PARTITION BY GAME_ID ORDER BY START_SEQ) AS before FROM po) WHERE before IS NOT NULL AND START_SEQ <> before + 1
 UNION ALL SELECT 'admitted_points_equal_box_by_side', count(*) FROM ad LEFT JOIN (SELECT GAME_ID, sum(HOME_PTS) AS h, sum(AWAY_PTS) AS a FROM po GROUP BY 1) USING (GAME_ID) LEFT JOIN bx USING (GAME_ID) WHERE h IS DISTINCT FROM bh OR a IS DISTINCT FROM ba
 UNION ALL SELECT 'segments_sum_to_possessions', count(*) FROM po LEFT JOIN sg ON sg.GAME_ID = po.GAME_ID AND sg.POSS_IDX = po.POSS_IDX WHERE sg.GAME_ID IS NULL OR sg.POSS_COUNT <> 1
 UNION ALL SELECT 'stints_plus_exclusions_equal_segments', count(*) FROM ss LEFT JOIN sn USING (GAME_ID) LEFT JOIN xn USING (GAME_ID) WHERE ss.c <> coalesce(sn.c, 0) + coalesce(xn.c, 0) OR ss.h <> coalesce(sn.h, 0) + coalesce(xn.h, 0) OR ss.a <> coalesce(sn.a, 0) + coalesce(xn.a, 0)
 UNION ALL SELECT 'stint_rates_finite_or_nan', count(*) FROM sn WHERE isinf(rate) OR c = 0 UNION ALL SELECT 'every_possession_attributed', count(*) FROM po WHERE OFFENSE_TEAM_ID IS NULL
 UNION ALL SELECT 'possession_alternation_within_periods', count(*) FROM (SELECT GAME_ID, sum(na) AS na, sum(nb) AS nb FROM tc GROUP BY 1) JOIN (SELECT GAME_ID, count(DISTINCT PERIOD) AS p FROM po GROUP BY 1) USING (GAME_ID) WHERE abs(na - nb) > p
 UNION ALL SELECT 'possession_alternation_per_period', count(DISTINCT GAME_ID) FROM tc WHERE abs(na - nb) > 1
 UNION ALL SELECT 'exclusions_are_declared_and_excludable', count(*) FROM (SELECT DISTINCT u, g FROM b WHERE u % 10 = 0) d LEFT JOIN st ON st.GAME_ID = d.g WHERE NOT coalesce(REASON = 'source_possession_unlogged', false)
 UNION ALL SELECT 'source_order_exclusions_meet_policy', count(*) FROM ix WHERE REASON = 'source_order_unresolvable' AND (inexact OR INVERSIONS = 0 OR EVENT_SCHEMA <> 'legacy' OR used)
 UNION ALL SELECT 'alternation_removals_sealed', count(*) FROM (SELECT GAME_ID, bit_or(k) AS bits FROM (SELECT GAME_ID, 1 AS k FROM st WHERE REASON IS NOT NULL UNION ALL SELECT GAME_ID, 2 FROM ep UNION ALL SELECT GAME_ID, 4 FROM ee) GROUP BY 1) WHERE bits <> 7
 UNION ALL SELECT 'source_possession_unlogged_exclusions_meet_policy', count(*) FROM ix LEFT JOIN xp USING (GAME_ID) WHERE REASON = 'source_possession_unlogged' AND (inexact OR NOT coalesce(explained, false) OR used OR GAME_ID IN (SELECT GAME_ID FROM ow WHERE OFFENSE_TEAM_ID IS NULL)))"""


def run_tables(t) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The tables of a run by name, its cohort and its declared exclusions."""
    from pyspark.sql import Window

    u, e, v, ty = F.col("user_id"), F.col("event_id"), F.floor("value"), F.col("event_type")
    s = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    one = lambda c: F.when(c, 1).otherwise(0)
    b = t.events.select(u.alias("u"), S.padded_id(u).alias("GAME_ID"), s.alias("s"), e.alias("e"), v.alias("v"), ty.alias("ty"))
    u, e, v, ty, s = (F.col(c) for c in ("u", "e", "v", "ty", "s"))
    outcome = F.when(ty == "view", "made_shot").when(ty == "purchase", "turnover").when(ty == "error", "end_of_period").otherwise("defensive_rebound")
    every = stored(b.select("u", "GAME_ID", (1 + F.floor(s / 40)).alias("PERIOD"), s.alias("POSS_IDX"), (s * 2 + one(e % 101 == 0)).alias("START_SEQ"), (s * 2 + 1).alias("END_SEQ"), outcome.alias("OUTCOME"), F.when(e % 103 != 0, 10 + v % 2).alias("OFFENSE_TEAM_ID"),
        (v % 3).cast("double").alias("HOME_PTS"), (v % 2).cast("double").alias("AWAY_PTS"), "e", "v", "ty", "s"), "run-log")
    poss = every.where("u % 10 <> 0 or u % 20 = 0")
    reason = F.when(u % 10 == 0, F.when(u % 30 == 0, "source_order_unresolvable").when(u % 50 != 0, "source_possession_unlogged"))
    status = every.where("u % 47 <> 0").select("u", "GAME_ID").distinct().select(
        "GAME_ID", F.when(u % 10 != 0, "ADMITTED").otherwise("QUARANTINED").alias("STATUS"), reason.alias("REASON"), (u % 5).cast("double").alias("FINAL_HOME"), (u % 5 + one(u % 70 == 0)).cast("double").alias("BOX_HOME"), F.lit(1.0).alias("FINAL_AWAY"), F.lit(1.0).alias("BOX_AWAY"),
        one(u % 40 == 0).alias("UNRESOLVED_SCORING_EVENTS"), (u % 3).alias("ORDER_INVERSIONS"), F.when(u % 60 == 0, "live").otherwise("legacy").alias("EVENT_SCHEMA"))
    segments = poss.where("e % 109 <> 0").select("GAME_ID", "u", "PERIOD", "POSS_IDX", "HOME_PTS", "AWAY_PTS", one(e % 107 != 0).alias("POSS_COUNT"), "e")
    inside = segments.where("e % 5 <> 0").groupBy(F.col("GAME_ID").alias("game_id"), "u").agg(F.sum("POSS_COUNT").alias("c"), F.sum("HOME_PTS").alias("home_points"), F.sum("AWAY_PTS").alias("away_points"))
    stints = inside.select("game_id", (F.col("c") + one(u % 13 == 0)).alias("possessions"), "home_points", "away_points", F.when(u % 9 == 0, float("inf")).otherwise(1.0).alias("net_rating_per_100"))
    out = segments.where("e % 5 = 0").groupBy("GAME_ID").agg(F.sum("POSS_COUNT").alias("EXCLUDED_POSS"), F.sum("HOME_PTS").alias("EXCLUDED_HOME_PTS"), F.sum("AWAY_PTS").alias("EXCLUDED_AWAY_PTS"))
    action = F.when(ty == "view", "made_shot").when(ty == "click", "missed_shot").when(ty == "purchase", "turnover").otherwise("rebound")
    rows = every.where("u % 10 = 0 and u % 130 <> 0").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    seq = s * 2 + F.col("k")
    ee = rows.select("GAME_ID", seq.alias("SEQ"), action.alias("ACTION"), (10 + v % 2).alias("TEAM_ID"), F.lit(5).cast("long").alias("PERSON_ID"), F.when(e % 19 != 0, 10 + v % 2).alias("PERSON_TEAM_ID"), seq.cast("double").alias("ELAPSED"))
    sums = every.groupBy("u").agg(F.sum("HOME_PTS").alias("h"), F.sum("AWAY_PTS").alias("a"))
    box = sums.select(u.alias("GAME_ID"), F.explode(F.array(F.struct(F.lit("A vs. B").alias("MATCHUP"), (F.col("h") + one(u % 15 == 0)).alias("PTS")), F.struct(F.lit("B @ A").alias("MATCHUP"), F.col("a").alias("PTS")))).alias("x")).select("GAME_ID", "x.*")
    tables = {"game_status": status, "possessions": poss, "segments": segments, "stints": stints, "exclusions": out, "excluded_possessions": every.where("u % 10 = 0 and u % 110 <> 0"), "excluded_events": ee, "team_game": box}
    cohort = every.select("GAME_ID").distinct().union(t.spark.range(1).select(F.lit("0009999999")))
    declared = every.where("u % 10 = 0").select("GAME_ID", F.lit("source_possession_unlogged").alias("DECLARED")).distinct()
    return tables, cohort, declared


@query(RUN + " SELECT name, broken FROM ch")
def gate_checks(t):
    """The gate's checks of a run's tables, and how many rows or games break each."""
    tables, cohort, declared = run_tables(t)
    return G.table_checks(tables, cohort, declared).select(F.col("check").alias("name"), "broken")
