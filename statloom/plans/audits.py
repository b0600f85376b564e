"""Ledgers, stints, release gates and audit reports
on the order and event tables: a user's events are a game's log, an order's lines its possessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import coverage as COV
from ..operators import legacy as L
from ..operators import possessions as P
from ..operators import relational as R
from ..operators import traces as TR
from ..operators.contracts import Refused
from ..operators.numbering import stored
from .registry import query

LOG = """WITH s AS (SELECT user_id AS game, CAST(ts AS DATE) AS period, ts, event_id, value, CASE WHEN event_type IN ('view', 'click') THEN 'home' WHEN event_type IN ('purchase', 'signup') THEN 'away' END AS team FROM events)"""


def log(t):
    """game, period, ts, event_id, value, team (null: not attributed)."""
    kind = F.col("event_type")
    team = F.when(kind.isin("view", "click"), "home").when(kind.isin("purchase", "signup"), "away")
    return t.events.select(F.col("user_id").alias("game"), F.col("ts").cast("date").alias("period"), "ts", "event_id", "value", team.alias("team"))


def dec(c, kind: str = "decimal(18,4)"):
    return F.col(c).cast(kind)


@query("""WITH l AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS derived, count(*) AS n, count(*) FILTER (WHERE l_quantity < 3) AS unresolved, max(l_shipdate) AS last_day FROM lineitem GROUP BY 1),
 r AS (SELECT o_orderkey, concat_ws('; ', CASE WHEN coalesce(derived, 0) <> CAST(o_totalprice AS DECIMAL(18,4)) THEN 'final_score_mismatch' END, CASE WHEN coalesce(unresolved, 0) > 0 THEN 'unresolved_event' END,
 CASE WHEN n IS NULL THEN 'stream_missing' END, CASE WHEN last_day > o_orderdate + INTERVAL 90 DAY THEN 'scoring_after_end' END) AS reasons FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
 SELECT o_orderkey, CASE WHEN reasons = '' THEN 'ADMITTED' ELSE 'QUARANTINED' END AS status, reasons FROM r""")
def scoring_ledger(t):
    """Each game admitted, or quarantined with its reasons in order."""
    l = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(dec("l_extendedprice")).alias("derived"), F.count("*").alias("n"), F.count_if(F.col("l_quantity") < 3).alias("unresolved"), F.max("l_shipdate").alias("last_day"))
    reasons = F.concat_ws("; ", F.when(F.coalesce("derived", F.lit(0)) != dec("o_totalprice"), "final_score_mismatch"), F.when(F.coalesce("unresolved", F.lit(0)) > 0, "unresolved_event"),
        F.when(F.col("n").isNull(), "stream_missing"), F.when(F.col("last_day") > F.col("o_orderdate") + F.expr("interval 90 days"), "scoring_after_end"))
    return t.orders.join(l, "o_orderkey", "left").select("o_orderkey", reasons.alias("reasons")).select("o_orderkey", F.when(F.col("reasons") == "", "ADMITTED").otherwise("QUARANTINED").alias("status"), "reasons")


@query("""SELECT l_orderkey, l_returnflag, l_linestatus, n_home, n_away, CAST(home AS DOUBLE) AS home, CAST(away AS DOUBLE) AS away, round(100 * (CAST(home AS DOUBLE) / nullif(n_home, 0) - CAST(away AS DOUBLE) / nullif(n_away, 0)) + 1e-9, 6) AS net, invalid FROM
 (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) FILTER (WHERE ok AND l_linenumber % 2 = 1) AS n_home, count(*) FILTER (WHERE ok AND l_linenumber % 2 = 0) AS n_away, count(*) FILTER (WHERE NOT ok) AS invalid,
 coalesce(sum(CASE WHEN ok AND l_linenumber % 2 = 1 THEN CAST(l_quantity AS DECIMAL(18,4)) END), 0) AS home, coalesce(sum(CASE WHEN ok AND l_linenumber % 2 = 0 THEN CAST(l_quantity AS DECIMAL(18,4)) END), 0) AS away
 FROM (SELECT *, l_quantity >= 3 AS ok FROM lineitem) GROUP BY ALL)""")
def built_stints(t):
    """Possessions by game and lineups, with a net rating that is null where a side has none; invalid segments are counted."""
    ok, odd = F.col("l_quantity") >= 3, F.col("l_linenumber") % 2 == 1
    q, none = dec("l_quantity"), F.lit(0).cast("decimal(18,4)")
    out = t.lineitem.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.count_if(ok & odd).alias("n_home"), F.count_if(ok & ~odd).alias("n_away"), F.count_if(~ok).alias("invalid"),
        F.coalesce(F.sum(F.when(ok & odd, q)), none).cast("double").alias("home"), F.coalesce(F.sum(F.when(ok & ~odd, q)), none).cast("double").alias("away"))
    return out.withColumn("net", S.stable(100 * (S.safe_ratio(F.col("home"), F.col("n_home")) - S.safe_ratio(F.col("away"), F.col("n_away")))))


PLAYS = """WITH r AS (SELECT user_id AS game, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id, event_type, 10 + CAST(floor(value) AS BIGINT) % 2 AS side FROM events),
 ev AS (SELECT game, seq, 1 + seq // 12 AS period, event_id, CASE event_type WHEN 'view' THEN 'made_shot' WHEN 'click' THEN 'missed_shot' WHEN 'purchase' THEN 'turnover' WHEN 'error' THEN 'rebound' ELSE 'foul' END AS action, side AS team,
 CASE WHEN event_id % 7 = 0 THEN side ELSE event_id % 500 + 1000 END AS person, CASE WHEN event_id % 17 <> 0 THEN side END AS person_team, seq * 3.0 - CASE WHEN event_id % 5 = 0 THEN 3.0 ELSE 0.0 END AS elapsed FROM r),
 po AS (SELECT game, seq // 2 AS index, min(period) AS period, arg_min(CASE WHEN event_id % 401 <> 0 THEN team END, seq) FILTER (WHERE event_id % 401 <> 0 AND seq % 2 = 0) AS team, CASE arg_max(action, seq) WHEN 'missed_shot' THEN 'defensive_rebound' WHEN 'foul' THEN 'end_of_period' WHEN 'rebound' THEN 'free_throw_made' ELSE arg_max(action, seq) END AS outcome,
 min(seq) AS first_seq, max(seq) AS last_seq FROM ev GROUP BY 1, 2),
 la AS (SELECT *, lag(team) OVER w AS prev_team, lag(outcome) OVER w AS prev_outcome, lag(last_seq) OVER w AS transfer_seq FROM po WINDOW w AS (PARTITION BY game, period ORDER BY first_seq)),
 re AS (SELECT la.game, la.period, index, la.team, prev_outcome, transfer_seq, first_seq AS next_seq, n.action AS next_action, n.elapsed - t.elapsed AS gap_seconds, coalesce((t.person_team = t.team) OR (t.person = t.team), false) AND coalesce((n.person_team = n.team) OR (n.person = n.team), false) AS identity_ok,
 n.team AS n_team FROM la LEFT JOIN ev t ON t.game = la.game AND t.seq = transfer_seq LEFT JOIN ev n ON n.game = la.game AND n.seq = first_seq WHERE la.team = prev_team),
 rv AS (SELECT *, coalesce(prev_outcome IN ('made_shot', 'and_one', 'turnover', 'defensive_rebound', 'free_throw_made') AND next_action IN ('made_shot', 'missed_shot', 'turnover') AND n_team = team AND gap_seconds > 0 AND identity_ok, false) AS verified FROM re)"""


def plays(t):
    """Rows of a log, two of which are a possession: game, seq, period, event_id, action, team, person, person_team, elapsed; and the possessions."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    side, kind, k = 10 + F.floor("value") % 2, F.col("event_type"), F.col("event_id")
    action = F.when(kind == "view", "made_shot").when(kind == "click", "missed_shot").when(kind == "purchase", "turnover").when(kind == "error", "rebound").otherwise("foul")
    rows = t.events.select(F.col("user_id").alias("game"), seq.cast("long").alias("seq"), "event_id", action.alias("action"), side.alias("team"), F.when(k % 7 == 0, side).otherwise(k % 500 + 1000).alias("person"), F.when(k % 17 != 0, side).alias("person_team"))
    rows = rows.withColumn("period", 1 + F.floor(F.col("seq") / 12)).withColumn("elapsed", F.col("seq") * 3.0 - F.when(k % 5 == 0, 3.0).otherwise(0.0))
    last = F.max_by("action", "seq")
    outcome = F.when(last == "missed_shot", "defensive_rebound").when(last == "foul", "end_of_period").when(last == "rebound", "free_throw_made").otherwise(last)
    own = F.max(F.when((F.col("seq") % 2 == 0) & (k % 401 != 0), F.col("team")))
    found = rows.groupBy("game", F.floor(F.col("seq") / 2).alias("index")).agg(F.min("period").alias("period"), own.alias("team"), outcome.alias("outcome"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return rows, found


REPEATED = ["game", "period", "index", "team", "prev_outcome", "transfer_seq", "next_seq", "next_action", "gap_seconds", "identity_ok", "verified"]


@query(PLAYS + f" SELECT {', '.join(REPEATED)} FROM rv")
def same_team_repeats(t):
    """Consecutive possessions of one team in a period, with the evidence that the other team's lies between them."""
    rows, found = plays(t)
    rows = stored(rows, "plays")
    return L.same_team_repeats(found, rows).select(*REPEATED)


@query(PLAYS + """, sd AS (SELECT game, min(team) AS a, max(team) AS b FROM po WHERE team IS NOT NULL GROUP BY 1), co AS (SELECT po.game, period, count(*) FILTER (WHERE team = a) AS na, count(*) FILTER (WHERE team = b AND a <> b) AS nb FROM po JOIN sd USING (game) GROUP BY 1, 2),
 fa AS (SELECT co.game, co.period, (SELECT count(*) FROM ev WHERE ev.game = co.game AND ev.period = co.period AND event_id % 31 = 0) > 0 AS inverted, (SELECT bool_and(verified) FROM rv WHERE rv.game = co.game AND rv.period = co.period) AS verified FROM co WHERE abs(na - nb) > 1),
 wh AS (SELECT game, count(team) = count(*) AS whole FROM po GROUP BY 1)
 SELECT game, count(*) AS failing, CASE WHEN any_value(whole) AND game % 2 = 0 AND bool_and(inverted) THEN 'source_order_unresolvable' WHEN any_value(whole) AND bool_and(coalesce(verified, false)) THEN 'source_possession_unlogged' ELSE 'possession_alternation_unexplained' END AS reason
 FROM fa JOIN wh USING (game) GROUP BY game""")
def alternation_failures(t):
    """Why the teams' counts of a period differ by more than one, by an ordered list of causes; games of even numbers are of the legacy feed."""
    rows, found = plays(t)
    rows, found = stored(rows, "plays"), stored(found, "possessions")
    schemas = found.select("game", (F.col("game") % 2 == 0).alias("legacy")).distinct()
    return L.alternation_failures(found, L.same_team_repeats(found, rows), rows.where("event_id % 31 = 0"), schemas)


ROTATIONS = """WITH ro AS (SELECT user_id AS game, CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS team, event_id, epoch_us(ts) / 1e5 AS in_time,
 CASE WHEN event_id % 31 = 0 THEN epoch_us(ts) / 1e5 + 3e8 ELSE epoch_us(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) / 1e5 END AS out_time FROM events WHERE event_type IN ('click', 'view')),
 st AS (SELECT game, team, in_time, out_time, (event_id * 13 + 17 * unnest(range(CASE WHEN event_id % 7 = 0 THEN 4 ELSE 5 END))) % 1000 AS player FROM ro),
 n AS (SELECT game, team, count(*) AS n FROM st GROUP BY 1, 2), h AS (SELECT game, arg_max(team, (n, -team)) AS home FROM n GROUP BY 1 HAVING count(*) > 1),
 sides AS (SELECT h.game, home, min(team) AS away FROM h JOIN n ON n.game = h.game AND team <> home GROUP BY 1, 2),
 sp AS (SELECT st.game, team = home AS own, player, in_time / 10.0::DOUBLE AS t_in, out_time / 10.0::DOUBLE AS t_out FROM st JOIN sides ON st.game = sides.game AND team IN (home, away)),
 ev AS (SELECT user_id AS game, event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE user_id IN (SELECT game FROM sides)),
 met AS (SELECT ev.game, ev.event_id, coalesce(list_sort(list(player) FILTER (WHERE own)), []) AS h, coalesce(list_sort(list(player) FILTER (WHERE NOT own)), []) AS a FROM ev LEFT JOIN sp ON sp.game = ev.game AND t_in <= t AND t < t_out GROUP BY 1, 2)"""


def rotations(t):
    """A log and its rotation stints, of five or four players: a user's clicks open those of one team, views the
    other's, until the next; some last for thirty million seconds."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    opened = t.events.where("event_type in ('click', 'view')").select("user_id", "event_id", "event_type", micros.alias("us"), F.lead(micros).over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("later"))
    long = F.col("event_id") % 31 == 0
    st = opened.select(F.col("user_id").alias("game"), F.when(F.col("event_type") == "click", 2).otherwise(1).alias("team"), "event_id", (F.col("us") / 1e5).alias("in_time"), F.when(long, F.col("us") / 1e5 + 3e8).otherwise(F.col("later") / 1e5).alias("out_time"))
    k = F.explode(F.sequence(F.lit(0), F.when(F.col("event_id") % 7 == 0, 3).otherwise(4)))
    st = st.withColumn("k", k).select("game", "team", "in_time", "out_time", ((F.col("event_id") * 13 + 17 * F.col("k")) % 1000).alias("player"))
    return t.events.select(F.col("user_id").alias("game"), F.col("event_id").alias("event"), (micros / 1e6).alias("event_time")), st


@query(ROTATIONS + """ SELECT event_id, CASE WHEN len(h) = 5 THEN h ELSE [] END AS home, CASE WHEN len(a) = 5 THEN a ELSE [] END AS away, len(h) = 5 AND len(a) = 5 AS valid FROM met""")
def linked_lineups(t):
    """Who is on court at each event, five a side; home is the modal team; a side that isn't five is empty."""
    return R.linked(*rotations(t)).select(F.col("event").alias("event_id"), F.col("home_lineup").alias("home"), F.col("away_lineup").alias("away"), F.col("lineup_valid").alias("valid"))


@query(ROTATIONS + """ SELECT event_id, CASE WHEN len(h) = 5 AND len(a) = 5 THEN h ELSE [] END AS home, CASE WHEN len(h) = 5 AND len(a) = 5 THEN a ELSE [] END AS away, len(h) = 5 AND len(a) = 5 AS valid FROM met""")
def older_linked_lineups(t):
    """By the older rule both sides are empty unless both are five."""
    return R.linked(*rotations(t), both=True).select(F.col("event").alias("event_id"), F.col("home_lineup").alias("home"), F.col("away_lineup").alias("away"), F.col("lineup_valid").alias("valid"))


FEED = """WITH f AS (SELECT event_id, user_id AS game, CASE WHEN user_id % 3 = 0 THEN CASE event_type WHEN 'view' THEN '2pt' WHEN 'click' THEN '3pt' WHEN 'purchase' THEN 'freethrow' WHEN 'error' THEN 'foul' ELSE 'jumpball' END
 ELSE CASE event_type WHEN 'view' THEN 'Made Shot' WHEN 'click' THEN 'Missed Shot' WHEN 'purchase' THEN 'Free Throw' WHEN 'error' THEN 'foul' ELSE 'rebound' END END AS kind, CASE WHEN value > 50 THEN 'Made' WHEN value > 10 THEN 'Missed' END AS result,
 CASE floor(value) % 3 WHEN 0 THEN 'shooting' WHEN 1 THEN 'charge' ELSE 'loose' END AS descriptor, CASE WHEN user_id % 3 <> 0 AND event_type = 'view' THEN 2 END AS worth FROM events),
 li AS (SELECT game, bool_or(kind IN ('2pt', '3pt', 'freethrow')) AS live FROM f GROUP BY 1)"""


@query(FEED + """ SELECT event_id, CASE WHEN NOT live THEN kind WHEN kind IN ('2pt', '3pt') AND result = 'Made' THEN 'Made Shot' WHEN kind IN ('2pt', '3pt') AND result = 'Missed' THEN 'Missed Shot' WHEN kind = 'freethrow' THEN 'Free Throw' WHEN kind = 'foul' THEN 'Foul' WHEN kind = 'jumpball' THEN 'Jump Ball' ELSE kind END AS action,
 CASE WHEN live AND kind = '2pt' THEN 2 WHEN live AND kind = '3pt' THEN 3 ELSE worth END AS worth, CASE WHEN live AND kind = 'foul' AND descriptor = 'shooting' THEN 'Shooting' WHEN live AND kind = 'foul' AND descriptor = 'charge' THEN 'Charge' ELSE 'personal' END AS subtype FROM f JOIN li USING (game)""")
def feed_taxonomy(t):
    """A game's feed is known by words that only it uses; its actions, shots and fouls get standard names, values and types."""
    kind, live = F.col("event_type"), F.col("user_id") % 3 == 0
    word = lambda a, b, c, d, e: F.when(kind == "view", a).when(kind == "click", b).when(kind == "purchase", c).when(kind == "error", d).otherwise(e)
    raw = t.events.select("event_id", F.col("user_id").alias("game"), F.when(live, word("2pt", "3pt", "freethrow", "foul", "jumpball")).otherwise(word("Made Shot", "Missed Shot", "Free Throw", "foul", "rebound")).alias("actionType"),
        F.when(F.col("value") > 50, "Made").when(F.col("value") > 10, "Missed").alias("shotResult"), F.when(F.floor("value") % 3 == 0, "shooting").when(F.floor("value") % 3 == 1, "charge").otherwise("loose").alias("descriptor"),
        F.when(~live & (kind == "view"), 2).alias("shotValue"), F.lit("personal").alias("subType"))
    return L.canonical_feed(raw).select("event_id", F.col("actionType").alias("action"), F.col("shotValue").alias("worth"), F.col("subType").alias("subtype"))


OLDER = """WITH q AS (SELECT l_orderkey AS game, l_linenumber * 100000000 + l_partkey AS place, list_transform(range(CASE WHEN l_quantity >= 3 THEN 5 ELSE 4 END), lambda k: (l_orderkey + l_linenumber // 4 + 7 * k) % 1000) AS h, list_transform(range(5), lambda k: 1000 + (l_orderkey + 11 * k) % 1000) AS a,
 CASE WHEN l_suppkey % 9 <> 0 THEN CAST(floor(l_quantity) AS BIGINT) % 4 END AS points, CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey % 30 WHEN l_linenumber % 3 = 1 THEN 30 + l_orderkey % 30 END AS scoring, CASE WHEN l_partkey % 5 <> 0 THEN l_orderkey % 30 END AS offense,
 CASE WHEN l_partkey % 11 <> 0 THEN abs(date_diff('day', o_orderdate, l_shipdate))::DOUBLE END AS duration FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 f AS (SELECT game, arg_min(h[1], place) AS ph, arg_min(a[1], place) AS pa FROM q GROUP BY 1), s AS (SELECT game, game % 30 AS home_team, CASE WHEN pa % 37 <> 0 THEN 30 + game % 30 ELSE 0 END AS away_team FROM f WHERE ph % 41 <> 0),
 r AS (SELECT q.*, home_team, away_team, coalesce(CASE WHEN scoring > 0 THEN scoring END, CASE WHEN offense > 0 THEN offense END) AS credit FROM q JOIN s USING (game) WHERE len(h) = 5 AND len(a) = 5)"""


@query(OLDER + """ SELECT game, list_sort(h) AS home_lineup, list_sort(a) AS away_lineup, home_team, away_team, count(*) AS possessions, CAST(sum(CASE WHEN points > 0 AND credit = home_team THEN points ELSE 0 END) AS BIGINT) AS home_points,
 CAST(sum(CASE WHEN points > 0 AND credit <> home_team THEN points ELSE 0 END) AS BIGINT) AS away_points, sum(coalesce(duration, 0)) AS duration, true AS negative_refused FROM r GROUP BY ALL HAVING count(*) >= 2""")
def legacy_stints(t):
    """Possessions by game and both lineups; the home team is that of the first possession's first player; two possessions or more, no negative durations."""
    n = t.lineitem.count()
    order, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    lines = R.dealt(t.lineitem.select(order, line, part, "l_suppkey", "l_quantity", "l_shipdate"), n, ["l_orderkey"])
    rows = lines.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == order).drop("o_orderkey")
    # written narrow, so that what is shuffled by games again has no arrays
    rows = R.dealt(stored(rows, "older-lines"), n, ["l_orderkey"])
    h, a = [(order + F.floor(line / 4) + 7 * k) % 1000 for k in range(5)], [1000 + (order + 11 * k) % 1000 for k in range(5)]
    h, a = F.when(F.col("l_quantity") >= 3, F.array(*h)).otherwise(F.array(*h[:4])), F.array(*a)
    scoring = F.when(line % 3 == 0, order % 30).when(line % 3 == 1, 30 + order % 30)
    days = F.datediff("l_shipdate", "o_orderdate").cast("double")
    p = rows.select(order.alias("game"), (line * F.lit(100000000).cast("long") + part).alias("at"), h.alias("offense_lineup"), a.alias("defense_lineup"), F.when(F.col("l_suppkey") % 9 != 0, F.floor("l_quantity") % 4).alias("points"), scoring.alias("scoring_team"),
        F.when(part % 5 != 0, order % 30).alias("offense_team"), F.when(part % 11 != 0, days).alias("duration"))
    # the players of both sides, of which some are of no team; a row for each possession
    players = p.select("game", F.size("offense_lineup").alias("home"), F.posexplode(F.concat("offense_lineup", "defense_lineup")).alias("at", "player"))
    own = F.col("at") < F.col("home")
    players = players.where(F.when(own, F.col("player") % 41 != 0).otherwise(F.col("player") % 37 != 0)).select("game", "player", F.when(own, F.col("game") % 30).otherwise(30 + F.col("game") % 30).alias("team"))
    sides = stored(L.stint_sides(p, players), "stint-sides")
    try:
        L.legacy_stints(p, players, 2, sides)
        refused = False
    except Refused:
        refused = True
    made = L.legacy_stints(p.withColumn("duration", F.abs("duration")), players, 2, sides)
    return made.select("game", "home_lineup", "away_lineup", "home_team", "away_team", "possessions", "home_points", "away_points", "duration", F.lit(refused).alias("negative_refused"))


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DECIMAL(18,4)) END) - sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS DECIMAL(18,4)) END) AS DOUBLE) AS margin, count(DISTINCT l_linestatus) AS sides FROM lineitem GROUP BY 1""")
def box_margins(t):
    """A game's margin, null (not half of it) where one side is missing."""
    side = lambda x: F.sum(F.when(F.col("l_linestatus") == x, dec("l_quantity")))
    return t.lineitem.groupBy("l_orderkey").agg((side("F") - side("O")).cast("double").alias("margin"), F.count_distinct("l_linestatus").alias("sides"))


COVERED = """WITH p AS (SELECT year(o_orderdate) AS season, o_orderkey AS game, l_quantity >= 5 AS five, l_extendedprice / 1000 AS points, l_returnflag AS offense_team, CASE l_linestatus || l_returnflag WHEN 'FA' THEN 'field_goal_made' WHEN 'FR' THEN 'turnover'
 WHEN 'ON' THEN 'defensive_rebound' WHEN 'FN' THEN 'free_throw_made' ELSE 'end_of_period' END AS outcome, l_quantity AS possessions, CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice / 1000 ELSE 0 END AS home_points, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / 1000 ELSE 0 END AS away_points FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 b AS (SELECT year(o_orderdate) AS season, o_orderkey AS game, CASE WHEN o_custkey % 13 <> 0 THEN o_totalprice / 1000 END AS box_points, CASE WHEN o_custkey % 13 <> 0 THEN 10.0 + o_custkey % 90 END AS box_poss, o_totalprice / 2000 - o_custkey % 41 AS box_margin,
 CASE WHEN o_custkey % 5 <> 0 THEN o_orderkey % 11 - 5.0 END AS box_free_margin, o_custkey % 2 = 0 AS real_home, 0.5 * (o_custkey % 17) AS box_fgm, 1.0 * (o_orderkey % 5) AS box_tov, 1.0 * (o_custkey % 9) AS box_dreb, 1.0 * (o_orderkey % 23) AS box_fta FROM orders WHERE o_orderkey % 10 <> 3),
 g0 AS (SELECT season, game, count(*) AS rows_, count(*) FILTER (WHERE five) AS rows_five, sum(points) AS points, count(DISTINCT offense_team) AS offense_teams, sum(possessions) AS stint_poss, sum(home_points + away_points) AS stint_points, sum(home_points) - sum(away_points) AS stint_margin FROM p GROUP BY 1, 2),
 g AS (SELECT g0.*, b.game AS in_box, box_points, box_poss, box_margin, box_free_margin, real_home, box_fgm, box_tov, box_dreb, box_fta, stint_margin IS NOT NULL AND box_margin IS NOT NULL AND box_free_margin IS NOT NULL AS whole FROM g0 LEFT JOIN b ON g0.game = b.game),
 m AS (SELECT season, count(*) AS games, count(in_box) AS n_in, median(rows_) AS rows_per_game, median(box_poss) AS box_poss_per_game, median(rows_ / nullif(box_poss, 0)) AS rows_over_box_poss, median(points / nullif(box_points, 0)) AS points_over_box_points, median(offense_teams) AS offense_teams_per_game,
 median(stint_poss / rows_) AS stint_poss_over_rows, median(stint_poss / nullif(box_poss, 0)) AS stint_poss_over_box_poss, median(stint_points / nullif(box_points, 0)) AS stint_points_over_box_points, sum(points) / sum(rows_) AS points_per_row, sum(box_points) / sum(box_poss) AS box_points_per_possession,
 sum(rows_five) / sum(rows_) AS share_five, avg(CAST(real_home AS INT)) AS share_real_home, corr(stint_margin, box_margin) FILTER (WHERE whole) AS corr_margin, corr(stint_margin, box_margin - box_free_margin) FILTER (WHERE whole) AS corr_margin_without_free,
 avg(box_fgm) AS box_fgm_per_game, avg(box_tov) AS box_tov_per_game, avg(box_dreb) AS box_dreb_per_game, avg(box_fta) AS box_fta_per_game FROM g GROUP BY 1),
 o AS (SELECT season, {} FROM p GROUP BY 1), bn AS (SELECT season, count(*) AS box_games FROM b GROUP BY 1)"""
OUTCOME_COUNTS = ", ".join(f"count(*) FILTER (WHERE outcome = '{x}') AS {x}" for x in COV.OUTCOMES)
COVERAGE_COLUMNS = [*COV.MEDIANS, "points_per_row", "box_points_per_possession", "share_five", "share_real_home", "corr_margin", "corr_margin_without_free", *(f"{x}_per_game" for x in (*COV.OUTCOMES, *COV.BOX_MEANS))]


@query(COVERED.format(OUTCOME_COUNTS) + " SELECT z.season, CASE WHEN games IS NULL THEN 'SOURCE_MISSING' ELSE 'MEASURED' END AS status, CASE WHEN games IS NOT NULL THEN coalesce(box_games, 0) END AS box_games, games, coalesce(box_games, 0) - n_in AS games_missing, "
 + ", ".join(f"round({c.removesuffix('_per_game') + ' / games' if c.removesuffix('_per_game') in COV.OUTCOMES else c} + 1e-9, 6) AS {c}" for c in COVERAGE_COLUMNS) + " FROM (SELECT unnest(range(1994, 2002)) AS season) z LEFT JOIN m USING (season) LEFT JOIN o USING (season) LEFT JOIN bn USING (season)")
def season_coverage(t):
    """Seventeen measures and nine rates of each season, and which seasons have no source."""
    p, st, box = covered(t)
    seasons = t.spark.range(1994, 2002).select(F.col("id").cast("int").alias("season"))
    st = st.select("season", "game", "possessions", "home_points", "away_points")
    found = COV.season_coverage(stored(p, "possessions"), stored(st, "stints"), box, seasons)
    return found.select("season", "status", "box_games", "games", "games_missing", *(S.stable(F.col(x)).alias(x) for x in COVERAGE_COLUMNS))


def covered(t):
    """Possessions, stints and box of the order tables, as the coverage takes them."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("points", F.col("l_extendedprice") / 1000)
    odd, kind = F.col("l_linenumber") % 2 == 1, F.concat("l_linestatus", "l_returnflag")
    outcome = F.when(kind == "FA", "field_goal_made").when(kind == "FR", "turnover").when(kind == "ON", "defensive_rebound").when(kind == "FN", "free_throw_made").otherwise("end_of_period")
    season, game = F.year("o_orderdate").alias("season"), F.col("o_orderkey").alias("game")
    p = lines.select(season, game, (F.col("l_quantity") >= 5).alias("five"), "points", F.col("l_returnflag").alias("offense_team"), outcome.alias("outcome"))
    st = lines.select(season, game, F.col("l_quantity").alias("possessions"), F.when(odd, F.col("points")).otherwise(0.0).alias("home_points"), F.when(~odd, F.col("points")).otherwise(0.0).alias("away_points"), F.array("l_suppkey").alias("home_lineup"), F.array("l_partkey").alias("away_lineup"))
    two, c, o = F.col("o_custkey") % 13 != 0, F.col("o_custkey"), F.col("o_orderkey")
    box = t.orders.where("o_orderkey % 10 <> 3").select(
        season, game, o.alias("in_box"), F.when(two, F.col("o_totalprice") / 1000).alias("box_points"), F.when(two, 10.0 + c % 90).alias("box_poss"), (F.col("o_totalprice") / 2000 - c % 41).alias("box_margin"),
        F.when(c % 5 != 0, o % 11 - 5.0).alias("box_free_margin"), (c % 2 == 0).alias("real_home"), (0.5 * (c % 17)).alias("box_fgm"), (1.0 * (o % 5)).alias("box_tov"), (1.0 * (c % 9)).alias("box_dreb"), (1.0 * (o % 23)).alias("box_fta"))
    return p, st, box


ROTATION = COVERED.format(OUTCOME_COUNTS) + """, ro AS (SELECT l_orderkey AS game, CASE WHEN l_orderkey % 50 = 0 THEN 99 ELSE l_suppkey % 7 END AS team, l_suppkey AS player, 10 * l_quantity AS stint_seconds FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE year(o_orderdate) = 2000),
 pg AS (SELECT g.*, CASE WHEN game % 4 = 0 THEN 2880.0 WHEN game % 4 = 1 THEN 2880.0 + 300 * (game % 5) ELSE 2700.0 END AS game_seconds FROM g WHERE season = 2000 AND in_box IS NOT NULL),
 rg AS (SELECT game, row_number() OVER (ORDER BY game) - 1 AS place, count(*) OVER () AS n FROM pg WHERE game_seconds = 2880), tr AS (SELECT player FROM ro GROUP BY 1 HAVING count(DISTINCT team) > 1 ORDER BY 1 LIMIT 1),
 pk AS (SELECT 'regulation' AS kind, game, NULL::BIGINT AS player, NULL::BIGINT AS team FROM rg WHERE place = n // 2 UNION ALL (SELECT 'overtime', game, NULL, NULL FROM pg WHERE game_seconds > 2880 ORDER BY game_seconds DESC, game LIMIT 1)
 UNION ALL (SELECT 'substitution_heavy', game, NULL, NULL FROM ro WHERE game IN (SELECT game FROM pg) GROUP BY game ORDER BY count(*) DESC, game LIMIT 1) UNION ALL SELECT 'traded_player', min(game), player, team FROM ro WHERE player IN (FROM tr) GROUP BY player, team HAVING min(game) IN (SELECT game FROM pg))"""
RECONCILED = ["box_points", "box_poss", "rows", "rows_five", "points", "box_margin", "stints", "stint_poss_sum", "stint_points_sum", "stint_margin_sum", "rotation_stints", "player_stint_poss", "oncourt_seconds", "share_of_box_poss"]


@query(ROTATION + """ SELECT kind, pk.game, pk.player, pk.team, game_seconds, real_home, round(box_points + 1e-9, 3) AS box_points, round(box_poss + 1e-9, 3) AS box_poss, round(rows_ + 1e-9, 3) AS rows, round(rows_five + 1e-9, 3) AS rows_five, round(points + 1e-9, 3) AS points, round(box_margin + 1e-9, 3) AS box_margin,
 round(st.n + 1e-9, 3) AS stints, round(st.poss + 1e-9, 3) AS stint_poss_sum, round(st.pts + 1e-9, 3) AS stint_points_sum, round(st.margin + 1e-9, 3) AS stint_margin_sum, round(rt.n + 1e-9, 3) AS rotation_stints, round(st.own + 1e-9, 3) AS player_stint_poss, round(rt.own + 1e-9, 3) AS oncourt_seconds,
 round(rt.own / game_seconds * box_poss + 1e-9, 3) AS share_of_box_poss FROM pk JOIN pg ON pg.game = pk.game, LATERAL (SELECT count(*) AS n, sum(l_quantity) AS poss, sum(l_extendedprice / 1000) AS pts, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice / 1000 ELSE -l_extendedprice / 1000 END) AS margin,
 sum(l_quantity) FILTER (WHERE l_suppkey = pk.player OR l_partkey = pk.player) AS own FROM lineitem WHERE l_orderkey = pk.game) st, LATERAL (SELECT count(*) AS n, sum(stint_seconds) FILTER (WHERE ro.player = pk.player) AS own FROM ro WHERE ro.game = pk.game) rt""")
def game_reconciliations(t):
    """The middle game of regulation length, the longest, the one of most substitutions, and a traded player's first game with each team, with what box, log, stints and rotation say of them."""
    p, st, box = covered(t)
    g = COV.games(p.where("season = 2000"), st, box).where("in_box is not null")
    n = F.col("game") % 4
    g = g.select("game", F.when(n == 0, 2880.0).when(n == 1, 2880.0 + 300 * (F.col("game") % 5)).otherwise(2700.0).alias("game_seconds"), "box_points", "box_poss", "rows", "rows_five", "points", "box_margin", "real_home")
    lines = t.lineitem.join(t.orders.where("year(o_orderdate) = 2000"), F.col("l_orderkey") == F.col("o_orderkey"))
    rotation = lines.select(F.col("l_orderkey").alias("game"), F.when(F.col("l_orderkey") % 50 == 0, 99).otherwise(F.col("l_suppkey") % 7).alias("team"), F.col("l_suppkey").alias("player"), (10 * F.col("l_quantity")).alias("stint_seconds"))
    found = TR.reconciliations(stored(g, "games"), stored(rotation, "rotation"), st)
    return found.select(F.col("case").alias("kind"), "game", "player", "team", "game_seconds", "real_home", *(S.stable(F.col(c).cast("double"), 3).alias(c) for c in RECONCILED))


@query("""SELECT event_type, n, round(n / sum(n) OVER () + 1e-9, 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def event_vocabulary(t):
    """The words of the log; the window is over the distinct words only."""
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("event_type", "n", S.stable(F.col("n") / F.col("all")).alias("share"))


@query("""WITH a AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
 SELECT count(*) AS members, count(*) FILTER (WHERE b.n IS NULL) AS lost, round(quantile_cont(coalesce(b.n, 0) / a.n, 0.1) + 1e-9, 6) AS q10, round(median(coalesce(b.n, 0) / a.n) + 1e-9, 6) AS mid, max(a.n - coalesce(b.n, 0)) AS most FROM a LEFT JOIN b USING (l_suppkey)""")
def exposure_comparison(t):
    """members' exposure before and after an exclusion."""
    both = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("a"), F.count_if(F.col("l_returnflag") != "R").alias("b"))
    rows = stored(both.withColumn("ratio", F.col("b") / F.col("a")), "exposures")
    q = R.quantiles(rows, [], "ratio", [0.1, 0.5])
    said = rows.agg(F.count("*").alias("members"), F.count_if(F.col("b") == 0).alias("lost"), F.max(F.col("a") - F.col("b")).alias("most"))
    return said.crossJoin(F.broadcast(q)).select("members", "lost", S.stable(F.col("q")[0]).alias("q10"), S.stable(F.col("q")[1]).alias("mid"), "most")  # a row each


@query("""SELECT o_orderkey, CASE WHEN s >= 2880 AND (s - 2880) % 300 = 0 THEN 4 + (s - 2880) // 300 END AS periods FROM (SELECT o_orderkey, 2580 + 60 * CAST(floor(o_totalprice / 10000) AS BIGINT) AS s FROM orders)""")
def game_periods(t):
    """A game's periods from its seconds, null unless these are of a legal length."""
    s = 2580 + 60 * F.floor(F.col("o_totalprice") / 10000)
    return t.orders.select("o_orderkey", s.alias("s")).selectExpr("o_orderkey", "case when s >= 2880 and (s - 2880) % 300 = 0 then 4 + (s - 2880) div 300 end as periods")


@query("""WITH n AS (SELECT l_orderkey, l_returnflag AS team, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT l_orderkey, min(team) AS team_a, max(team) AS team_b FROM n GROUP BY 1 HAVING count(*) = 2)
 SELECT g.l_orderkey, team_a, team_b, a.n AS n_a, b.n AS n_b, a.n - b.n AS gap, abs(a.n - b.n) <= 1 AS released FROM g JOIN n a ON a.l_orderkey = g.l_orderkey AND a.team = team_a JOIN n b ON b.l_orderkey = g.l_orderkey AND b.team = team_b""")
def possession_accounting(t):
    """Both teams of a game in canonical roles, their possessions and whether the game may be released."""
    n = t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("team")).agg(F.count("*").alias("n"))
    g = n.groupBy("l_orderkey").agg(F.min("team").alias("team_a"), F.max("team").alias("team_b"), F.min_by("n", "team").alias("n_a"), F.max_by("n", "team").alias("n_b"), F.count("*").alias("teams")).where("teams = 2")
    gap = F.col("n_a") - F.col("n_b")
    return g.select("l_orderkey", "team_a", "team_b", "n_a", "n_b", gap.alias("gap"), S.known_true(F.abs(gap) <= 1).alias("released"))


@query("""WITH s AS (SELECT DISTINCT year(o_orderdate) AS season, o_custkey FROM orders)
 SELECT a.season, count(*) AS members, count(b.o_custkey) AS stayed, round(count(b.o_custkey) / count(*) + 1e-9, 6) AS overlap FROM s a LEFT JOIN s b ON b.o_custkey = a.o_custkey AND b.season = a.season + 1 GROUP BY 1""")
def season_overlap(t):
    """Members of a season that are in the next one."""
    s = t.orders.select(F.year("o_orderdate").alias("season"), "o_custkey").distinct()
    marked = s.withColumn("stays", F.lead("season").over(Window.partitionBy("o_custkey").orderBy("season")) == F.col("season") + 1)
    stayed = F.count_if("stays")
    return marked.groupBy("season").agg(F.count("*").alias("members"), stayed.alias("stayed"), S.stable(stayed / F.count("*")).alias("overlap"))


@query("""WITH m AS (SELECT o_custkey, avg(CAST(o_totalprice AS DOUBLE)) AS x, count(*) AS n FROM orders GROUP BY 1)
 SELECT least_n, count(*) AS members, CASE WHEN count(*) > 10 THEN round(corr(x, c_acctbal) + 1e-9, 5) END AS r FROM m JOIN customer ON c_custkey = o_custkey, (SELECT unnest([1, 5, 10, 15]) AS least_n) WHERE n >= least_n GROUP BY 1""")
def validation_by_exposure(t):
    """Correlation with an outside figure at several least exposures; none for ten members or fewer."""
    m = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("x"), F.count("*").alias("n"))
    each = m.join(t.customer.select("c_custkey", "c_acctbal"), "c_custkey").withColumn("least_n", F.explode(F.array(*map(F.lit, (1, 5, 10, 15))))).where("n >= least_n")
    return each.groupBy("least_n").agg(F.count("*").alias("members"), F.when(F.count("*") > 10, S.stable(F.corr("x", "c_acctbal"), 5)).alias("r"))


@query("""WITH g AS (SELECT o_orderkey, year(o_orderdate) AS season, o_orderstatus = 'P' AS declared, NOT coalesce(good, false) AS actual FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(l_quantity >= 3) AS good FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
 SELECT season, count(*) AS games, count(*) FILTER (WHERE declared) AS declared, count(*) FILTER (WHERE actual) AS actual, CASE WHEN count(*) FILTER (WHERE declared <> actual) > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE actual) > 0 THEN 'PASS_WITH_EXCLUSIONS' ELSE 'PASS' END AS verdict FROM g GROUP BY 1""")
def season_release(t):
    """A season passes if the declared exclusions are exactly those that its games call for."""
    good = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_quantity") >= 3).alias("good"))
    g = t.orders.join(good, "o_orderkey", "left").select(F.year("o_orderdate").alias("season"), (F.col("o_orderstatus") == "P").alias("declared"), (~S.known_true(F.col("good"))).alias("actual"))
    verdict = F.when(F.count_if(F.col("declared") != F.col("actual")) > 0, "FAIL").when(F.count_if("actual") > 0, "PASS_WITH_EXCLUSIONS").otherwise("PASS")
    return g.groupBy("season").agg(F.count("*").alias("games"), verdict.alias("verdict"), F.count_if("declared").alias("declared"), F.count_if("actual").alias("actual"))


@query("""SELECT season, season - lag(season) OVER (ORDER BY season) > 1 AS gap_before FROM (SELECT DISTINCT year(o_orderdate) AS season FROM orders)""")
def contiguous_seasons(t):
    """A season after a gap; the window is over the distinct seasons only."""
    seasons = t.orders.select(F.year("o_orderdate").alias("season")).distinct()
    earlier = seasons.select((F.col("season") + 1).alias("season"), F.lit(True).alias("follows"))
    first = F.broadcast(seasons.agg(F.min("season").alias("first")))
    gap = F.when(F.col("season") != F.col("first"), F.col("follows").isNull())
    return seasons.join(earlier, "season", "left").crossJoin(first).select("season", gap.alias("gap_before"))


@query("""WITH a AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,4)))::DOUBLE AS x, max(l_returnflag) AS f FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, o_totalprice AS x, o_orderstatus AS f FROM orders)
 SELECT count(*) AS n, count(*) FILTER (WHERE a.k IS NULL) AS only_right, count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE abs(a.x - b.x) > 1e-9 + 1e-9 * abs(b.x)) AS numbers_differ, count(*) FILTER (WHERE a.f <> b.f) AS texts_differ FROM a FULL JOIN b ON a.k = b.k""")
def table_equality(t):
    """Two tables held against each other by key; numbers within 1e-9, all else exactly."""
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(dec("l_extendedprice")).cast("double").alias("x"), F.max("l_returnflag").alias("f")).withColumn("in_a", F.lit(True))
    b = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("y"), F.col("o_orderstatus").alias("g"), F.lit(True).alias("in_b"))
    return a.join(b, "k", "full").agg(F.count("*").alias("n"), F.count_if(F.col("in_a").isNull()).alias("only_right"), F.count_if(F.col("in_b").isNull()).alias("only_left"),
        F.count_if(F.abs(F.col("x") - F.col("y")) > 1e-9 + 1e-9 * F.abs(F.col("y"))).alias("numbers_differ"), F.count_if(F.col("f") != F.col("g")).alias("texts_differ"))


def played(t):
    """The log of each game with the columns that the possession fold takes; a month's last event ends a period."""
    kind, n = F.col("event_type"), F.floor("value").cast("int")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ends = F.coalesce(F.lead(F.weekofyear("ts")).over(w) != F.weekofyear("ts"), F.lit(True))
    action = F.when(ends, "period").when(kind == "view", "made_shot").when(kind == "click", "missed_shot").when(kind == "error", "rebound").when(kind == "purchase", "free_throw").when(n % 3 == 0, "foul").otherwise("turnover")
    team, made = F.when(n % 2 == 0, "home").otherwise("away"), F.col("value") > 20
    pts = F.when(action == "made_shot", 2.0).when((action == "free_throw") & made, 1.0).otherwise(0.0)
    five = lambda k: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda x: x + n % k)
    return t.events.select(
        F.col("user_id").alias("game"), F.weekofyear("ts").alias("period"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 6e10).cast("double").alias("elapsed"), action.alias("action"), team.alias("team"),
        F.when(action == "free_throw", F.when(n % 7 == 0, "technical").when(n % 7 == 1, "flagrant").otherwise("regular")).alias("ft_kind"), (n % 2 + 1).alias("ft_number"), F.lit(2).alias("ft_of"), made.alias("ft_made"), ends.alias("period_end"),
        F.when(team == "home", pts).otherwise(0.0).alias("home_pts"), F.when(team == "away", pts).otherwise(0.0).alias("away_pts"), five(3).alias("home_on"), F.when(n % 11 != 0, five(2)).alias("away_on"), "ts", "event_id")


@query()
def possession_machine(t):
    """D3: the log of each game folded into possessions; what follows depends on all that came before, so there is no SQL."""
    return P.possessions(played(t), ["ts", "event_id"])


@query()
def possession_segments(t):
    """Possessions cut where the lineups change, with their points; only the last segment counts as a possession."""
    return P.segments(played(t), stored(P.possessions(played(t), ["ts", "event_id"]), "possessions"), ["ts", "event_id"])


CONSERVED = """WITH w AS (SELECT *, coalesce(lead(weekofyear(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> weekofyear(ts), true) AS ends FROM events),
 p AS (SELECT user_id AS game, CASE WHEN ends THEN 0.0 WHEN event_type = 'view' THEN 2.0 WHEN event_type = 'purchase' AND value > 20 THEN 1.0 ELSE 0.0 END AS pts, CAST(floor(value) AS INT) % 2 = 0 AS home FROM w)"""


@query(CONSERVED + " SELECT game, sum(CASE WHEN home THEN pts ELSE 0 END) AS home, sum(CASE WHEN home THEN 0 ELSE pts END) AS away, true AS counts_agree FROM p GROUP BY 1")
def possession_conservation(t):
    """Stints and exclusions give back a game's points by side, and as many possessions as the fold made."""
    found = stored(P.possessions(played(t), ["ts", "event_id"]), "possessions")
    made, out = P.stints(stored(P.segments(played(t), found, ["ts", "event_id"]), "segments"))
    parts = made.select("game", F.col("home_points").alias("h"), F.col("away_points").alias("a"), F.col("possessions").alias("c")).union(out.select("game", "excluded_home_pts", "excluded_away_pts", "excluded_poss"))
    counts = found.groupBy("game").agg(F.count("*").alias("n"))
    return parts.groupBy("game").agg(F.sum("h").alias("home"), F.sum("a").alias("away"), F.sum("c").alias("c")).join(counts, "game").select("game", "home", "away", (F.col("c") == F.col("n")).alias("counts_agree"))
