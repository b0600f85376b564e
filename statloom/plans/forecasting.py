"""Ratings and forecast evaluation on the order tables: an order's
total is the outcome, its lines' sum the forecast, years are seasons."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import forecasts as E
from ..operators import report as R
from ..operators.numbering import checkpoint_folder, stored
from ..operators.relational import quantiles
from ..operators.resampling import split_draws
from ..sources import files
from .registry import query

#: Seasons up to 1999 are development, the two after them holdout.
EVAL = """WITH e AS (SELECT o_orderkey AS id, o_orderdate AS day, year(o_orderdate) AS season, CASE WHEN year(o_orderdate) <= 1999 THEN 'development' ELSE 'holdout' END AS phase,
 o_totalprice / 1000 AS actual, 50.0 + l.q AS part, l.q AS q, l.k AS k FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS k FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)"""


def evaluation(t) -> DataFrame:
    """id, day, season, phase, actual, part, and what it is made of: q, k."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("k"))
    return t.orders.join(lines, "o_orderkey").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("day"), F.year("o_orderdate").alias("season"),
        F.when(F.year("o_orderdate") <= 1999, "development").otherwise("holdout").alias("phase"), (F.col("o_totalprice") / 1000).alias("actual"), (F.lit(50.0) + F.col("q")).alias("part"), "q", "k")


def rounded(df: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    return df.select(*keys, *(F.round(F.col(c) + 1e-9, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes if c not in keys))


POINT = """count(*) AS n, round(sqrt(avg((part - actual) * (part - actual))) + 1e-9, 4) AS rmse, round(avg(abs(part - actual)) + 1e-9, 4) AS mae, round(avg(part - actual) + 1e-9, 4) AS bias,
 round(corr(actual, part) + 1e-9, 4) AS correlation, round(regr_slope(actual, part) + 1e-9, 4) AS slope, round(regr_intercept(actual, part) + 1e-9, 4) AS intercept"""


@query(EVAL + f" SELECT phase, season, {POINT} FROM e GROUP BY GROUPING SETS ((phase), (phase, season))")
def forecast_scoring(t):
    """Point metrics pooled and by season."""
    e = evaluation(t)
    pooled = E.point_metrics(e, ["phase"], forecast="part").withColumn("season", F.lit(None).cast("int"))
    return rounded(pooled.unionByName(E.point_metrics(e, ["phase", "season"], forecast="part")), ["phase", "season"])


FROZEN = ", f AS (SELECT avg(actual - part) AS h, quantile_cont(actual - part, 0.1) - avg(actual - part) AS q10, quantile_cont(actual - part, 0.9) - avg(actual - part) AS q90 FROM e WHERE phase = 'development')"


@query(EVAL + FROZEN + " SELECT round(h + 1e-9, 4) AS h, round(q10 + 1e-9, 4) AS q10, round(q90 + 1e-9, 4) AS q90, (SELECT count(*) FROM e WHERE phase = 'development') AS n FROM f")
def frozen_parameters(t):
    """Parameters frozen on development rows."""
    return rounded(E.frozen_parameters(evaluation(t).where("phase = 'development'"), []), [])


@query(EVAL + FROZEN + """, i AS (SELECT phase, actual, part + h + q10 AS low, part + h + q90 AS high FROM e, f)
 SELECT phase, count(*) AS n, round(avg(CAST(actual >= low AND actual <= high AS DOUBLE)) + 1e-9, 4) AS coverage, round(avg(high - low) + 1e-9, 4) AS width, round(avg(CAST(actual < low AS DOUBLE)) + 1e-9, 4) AS below,
 round(avg(CAST(actual > high AS DOUBLE)) + 1e-9, 4) AS above, round(avg(high - low + 10 * greatest(low - actual, 0) + 10 * greatest(actual - high, 0)) + 1e-9, 4) AS score FROM i GROUP BY phase""")
def interval_scoring(t):
    """Interval metrics under frozen parameters."""
    e = evaluation(t)
    f = E.frozen_parameters(e.where("phase = 'development'"), [])
    i = e.crossJoin(F.broadcast(f)).select("phase", "actual", (F.col("part") + F.col("h") + F.col("q10")).alias("low"), (F.col("part") + F.col("h") + F.col("q90")).alias("high"))
    return rounded(E.interval_metrics(i, ["phase"]), ["phase"])


@query(EVAL + """, s AS (SELECT regr_slope(actual, part) AS b, regr_intercept(actual, part) AS a FROM e WHERE phase = 'development')
 SELECT round(a + 1e-9, 4) AS a, round(b + 1e-9, 4) AS b, round(sqrt(avg(power(a + b * part - actual, 2))) + 1e-9, 4) AS rmse FROM e, s WHERE phase = 'holdout' GROUP BY a, b""")
def development_scale(t):
    """A line fitted on development rows and applied to holdout rows."""
    e = evaluation(t)
    s = e.where("phase = 'development'").agg(F.regr_slope(F.col("actual"), F.col("part")).alias("b"), F.regr_intercept(F.col("actual"), F.col("part")).alias("a"))
    error = F.col("a") + F.col("b") * F.col("part") - F.col("actual")
    return rounded(e.where("phase = 'holdout'").crossJoin(F.broadcast(s)).groupBy("a", "b").agg(F.sqrt(F.avg(error * error)).alias("rmse")), [])


@query(EVAL + """, q AS (SELECT quantile_cont(part, 0.2) AS a, quantile_cont(part, 0.4) AS b, quantile_cont(part, 0.6) AS c, quantile_cont(part, 0.8) AS d FROM e WHERE phase = 'development'),
 x AS (SELECT actual, part, CAST(part >= a AS INT) + CAST(part >= b AS INT) + CAST(part >= c AS INT) + CAST(part >= d AS INT) AS bin FROM e, q WHERE phase = 'holdout')
 SELECT bin, count(*) AS n, round(avg(part) + 1e-9, 4) AS forecast, round(avg(actual) + 1e-9, 4) AS observed FROM x GROUP BY bin""")
def calibration_bins(t):
    """Development quintiles applied to holdout rows."""
    e = evaluation(t)
    cuts = quantiles(e.where("phase = 'development'"), [], "part", [0.2, 0.4, 0.6, 0.8]).withColumnRenamed("q", "cuts")
    x = e.where("phase = 'holdout'").drop("q").crossJoin(F.broadcast(cuts)).withColumn("bin", S.right_closed_bin(F.col("part"), F.col("cuts")))
    return rounded(x.groupBy("bin").agg(F.count("*").alias("n"), F.avg("part").alias("forecast"), F.avg("actual").alias("observed")), ["bin"])


DRAWN = "CAST(('0x' || substr(md5('{seed}|' || {b} || '|' || {i}), 1, 8)) AS BIGINT)"
#: Each track's forecasts, by model: of the lines' quantities (A) and of their number (B).
FORECASTS = {
    "A_home": "150.0", "A_legacy": "50.0 + q", "A_prior": "100.0 + 0.5 * q", "A_weekly": "120.0 + 0.8 * q",
    "B_home": "150.0", "B_legacy": "40.0 * k", "B_prior": "75.0 + 18.0 * k", "B_weekly": "120.0 + 25.0 * k",
}
LOSSES = ", ".join(f"power(actual - ({f}), 2) AS {m}" for m, f in FORECASTS.items())


def losses(t) -> DataFrame:
    """The holdout cohort: id, day, season, and each model's squared losses."""
    return evaluation(t).where("phase = 'holdout'").select("id", "day", "season", *(F.expr(f"power(actual - ({f}), 2)").alias(m) for m, f in FORECASTS.items()))


def contrast_sql(by: str = "") -> str:
    """Rows of estimates and intervals from the tables o (observed RMSE) and s (RMSE of draws)."""
    parts, comma = [], f"{by}, " if by else ""
    for track in "AB":
        for name, terms in E.CONTRASTS.items():
            value = " + ".join(f"{c} * {{}}{track}_{m}" for m, c in terms.items())
            left, right = (value.replace("{}", x) for x in ("o.", "s."))
            join = f"JOIN s USING ({by}) GROUP BY {by}, o.{track}_home, o.{track}_legacy, o.{track}_prior, o.{track}_weekly" if by else f", s GROUP BY o.{track}_home, o.{track}_legacy, o.{track}_prior, o.{track}_weekly"
            parts.append(f"SELECT {comma}'{track}' AS track, '{name}' AS contrast, round({left} + 1e-9, 4) AS estimate, round(quantile_cont({right}, 0.025) + 1e-9, 4) AS low, round(quantile_cont({right}, 0.975) + 1e-9, 4) AS high FROM o {join}")
    return " UNION ALL ".join(parts)


RMSES = ", ".join(f"sqrt(avg({m})) AS {m}" for m in FORECASTS)


@query(EVAL + f""", c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS place, {LOSSES} FROM e WHERE phase = 'holdout'),
 n AS (SELECT count(*) AS n FROM c), d AS (SELECT draw, CAST(('0x' || substr(md5('20260926|' || draw // 4 || '|' || place), 1 + 8 * (draw % 4), 8)) AS BIGINT) % n AS place FROM c, n, range(2000) r(draw)),
 s AS (SELECT draw, {RMSES} FROM d JOIN c USING (place) GROUP BY draw), o AS (SELECT {RMSES} FROM c) {contrast_sql()}""")
def paired_bootstrap(t):
    """2000 paired draws by counters; differences of RMSE with their 95 % intervals."""
    cohort = losses(t)
    models = list(FORECASTS)
    draws = E.paired_draws(cohort, 2000, "20260926", ["id"], models)
    observed = cohort.agg(*(F.sqrt(F.avg(m)).alias(m) for m in models))
    return rounded(E.contrasts(draws, observed, ["A", "B"]), ["track", "contrast"])


@query()
def split_bootstrap(t):
    """The same contrasts by draws that are split down a tree of ranges, so that no draw is moved or joined; other random numbers than
    paired_bootstrap's, which SQL can't repeat: the tests walk the whole tree."""
    cohort, models = losses(t), list(FORECASTS)
    draws = stored(split_draws(cohort, 2000, 20260926, ["id"], models), "draws")
    observed = cohort.agg(*(F.sqrt(F.avg(m)).alias(m) for m in models))
    return rounded(E.contrasts(draws, observed, ["A", "B"]), ["track", "contrast"])


def calendar_sql(days: int) -> str:
    sums = ", ".join(f"sum({m}) AS {m}" for m in FORECASTS)
    ratios = ", ".join(f"sum(b.{m}) / sum(b.n) AS {m}" for m in FORECASTS)
    totals = ", ".join(f"sqrt(sum(rows_ / total * {m})) AS {m}" for m in FORECASTS)
    return f"""b{days} AS (SELECT season, row_number() OVER (PARTITION BY season ORDER BY number) - 1 AS block, n, {", ".join(FORECASTS)} FROM (SELECT season, number, count(*) AS n, {sums} FROM
 (SELECT *, CAST(floor(date_diff('day', date_trunc('week', min(day) OVER (PARTITION BY season)), day) / {days}) AS INT) AS number FROM l) GROUP BY 1, 2)),
 k{days} AS (SELECT season, count(*) AS k, sum(n) AS rows_, (SELECT sum(n) FROM b{days}) AS total FROM b{days} GROUP BY 1),
 p{days} AS (SELECT draw, season, rows_, total, {DRAWN.format(seed='20261001', b='draw', i="season || '|' || block")} % k AS block FROM b{days} JOIN k{days} USING (season), range(2000) r(draw)),
 z{days} AS (SELECT draw, season, rows_, total, {ratios} FROM p{days} JOIN b{days} b USING (season, block) GROUP BY 1, 2, 3, 4), s{days} AS (SELECT {days} AS days, draw, {totals} FROM z{days} GROUP BY draw)"""


CALENDAR = f"{EVAL}, l AS (SELECT id, day, season, {LOSSES} FROM e WHERE phase = 'holdout'), {', '.join(calendar_sql(x) for x in (7, 14, 28))}, s AS (FROM s7 UNION ALL FROM s14 UNION ALL FROM s28), o AS (SELECT days, {RMSES} FROM l, (SELECT unnest([7, 14, 28]) AS days) GROUP BY days)"


def calendar_contrasts(t) -> DataFrame:
    """days, track, contrast, estimate, low, high."""
    cohort, models = losses(t), list(FORECASTS)
    firsts = cohort.groupBy("season").agg(F.min("day").alias("first"))
    observed = cohort.agg(*(F.sqrt(F.avg(m)).alias(m) for m in models))
    made = []
    for days in (7, 14, 28):
        sums = cohort.join(firsts, "season").withColumn("number", S.monday_block(F.col("day"), F.col("first"), days)).groupBy("season", "number").agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in models))
        numbers = Window.partitionBy("season").orderBy("number")  # a season has some fifty blocks
        blocks = stored(sums.withColumn("block", (F.row_number().over(numbers) - 1).cast("long")).drop("number"), "blocks")
        made.append(E.contrasts(E.calendar_draws(blocks, 2000, "20261001", models).withColumn("days", F.lit(days)), observed.withColumn("days", F.lit(days)), ["A", "B"], ["days"]))
    return made[0].union(made[1]).union(made[2])


@query(f"{CALENDAR} {contrast_sql('days')}")
def calendar_bootstrap(t):
    """Block draws within each season for 7, 14 and 28 days, shared by all models."""
    return rounded(calendar_contrasts(t), ["days", "track", "contrast"])


@query(f"{CALENDAR} SELECT bool_and(high < 0) AS promote, count(*) AS intervals, count(*) FILTER (WHERE high < 0) AS below FROM ({contrast_sql('days')}) WHERE days = 28 AND contrast LIKE 'weekly-%'")
def promotion_decision(t):
    """Promoted when every interval of the weekly model lies below zero in both tracks."""
    kept = calendar_contrasts(t).where("days = 28 and contrast like 'weekly-%'").select(F.round(F.col("high") + 1e-9, 4).alias("high"))
    return kept.agg(F.bool_and(F.col("high") < 0).alias("promote"), F.count("*").alias("intervals"), F.count_if(F.col("high") < 0).alias("below"))


@query(EVAL + """, b AS (SELECT season, CAST(floor(date_diff('day', date_trunc('week', min(day) OVER (PARTITION BY season)), day) / 28) AS INT) AS block, power(actual - part, 2) AS loss FROM e)
 SELECT season, block, count(*) AS n, round(sum(loss) + 1e-9, 2) AS total FROM b GROUP BY 1, 2""")
def calendar_cluster_sums(t):
    """Losses summed over calendar blocks of each season, what cluster draws are made of."""
    firsts = evaluation(t).groupBy("season").agg(F.min("day").alias("first"))
    b = evaluation(t).join(F.broadcast(firsts), "season").withColumn("block", S.monday_block(F.col("day"), F.col("first"), 28))
    return b.groupBy("season", "block").agg(F.count("*").alias("n"), F.round(F.sum(F.pow(F.col("actual") - F.col("part"), 2)) + 1e-9, 2).alias("total"))


@query("""SELECT count(*) AS players, round(sum(w) + 1e-9, 2) AS weight, max(seasons_ago) AS oldest FROM (SELECT l_suppkey, sum(l_quantity * power(0.8, 1998 - year(l_shipdate))) AS w, max(1998 - year(l_shipdate)) AS seasons_ago FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1)""")
def decayed_exposure(t):
    """Weights that decay by season, pooled by member."""
    ago = F.lit(1998) - F.year("l_shipdate")
    each = t.lineitem.where("l_shipdate < timestamp'1999-01-01'").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity") * F.pow(F.lit(0.8), ago)).alias("w"), F.max(ago).cast("long").alias("ago"))
    return each.agg(F.count("*").alias("players"), F.round(F.sum("w") + 1e-9, 2).alias("weight"), F.max("ago").alias("oldest"))


#: The models of track A with the flags of each game.
TRACK = {m[2:]: f for m, f in FORECASTS.items() if m.startswith("A_")}
FLAGS = {"early": "id % 5 = 0", "rookie_heavy": "k > 4", "team_change": "CASE WHEN id % 7 <> 0 THEN q > 100 END"}
MATCHED = "id % 11 <> 0"
_POINT = "count(*) AS n, sqrt(avg(power(f - actual, 2))) AS rmse, avg(abs(f - actual)) AS mae, avg(f - actual) AS bias, CASE WHEN stddev_pop(f) > 0 THEN corr(actual, f) END AS correlation, CASE WHEN stddev_pop(f) > 0 THEN regr_slope(actual, f) END AS slope, CASE WHEN stddev_pop(f) > 0 THEN regr_intercept(actual, f) END AS intercept"


def _long(table: str, section: str, measures: list[str], variant: str = "''", key: str = "''", model: str = "model") -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {variant} AS variant, CAST({key} AS VARCHAR) AS key, {model} AS model, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM {table}" for m in measures)


REPORT = EVAL + ", g AS (SELECT *, " + MATCHED + " AS matched, " + ", ".join(f"{c} AS {f}" for f, c in FLAGS.items()) + " FROM e), lo AS (" + " UNION ALL ".join(f"SELECT id, season, phase, actual, early, rookie_heavy, coalesce(team_change, false) AS team_change, '{m}' AS model, CAST({f} AS DOUBLE) AS part FROM g WHERE matched" for m, f in TRACK.items()) + """),
 fz AS (SELECT model, avg(actual - part) AS h, quantile_cont(actual - part, 0.1) - avg(actual - part) AS q10, quantile_cont(actual - part, 0.9) - avg(actual - part) AS q90, count(*) AS n FROM lo WHERE phase = 'development' GROUP BY 1),
 sc AS (SELECT model, regr_intercept(actual, part) AS a, regr_slope(actual, part) AS b FROM lo WHERE phase = 'development' AND model <> 'home' GROUP BY 1),
 ho AS (SELECT lo.*, h, q10, q90, a, b FROM lo JOIN fz USING (model) LEFT JOIN sc USING (model) WHERE phase = 'holdout'), sa AS (SELECT *, 'frozen' AS variant, part + h AS f FROM ho UNION ALL SELECT *, 'rescaled', coalesce(a + b * part, part + h) FROM ho),
 ow AS (SELECT * FROM sa WHERE variant = 'frozen'), ii AS (SELECT model, avg(CAST(actual BETWEEN f + q10 AND f + q90 AS INT)) AS coverage, avg(q90 - q10) AS width, avg(CAST(actual < f + q10 AS INT)) AS below, avg(CAST(actual > f + q90 AS INT)) AS above, avg(q90 - q10 + 10 * greatest(f + q10 - actual, 0) + 10 * greatest(actual - f - q90, 0)) AS score FROM ow GROUP BY 1),
 p1 AS (SELECT variant, model, """ + _POINT + " FROM sa GROUP BY 1, 2), p2 AS (SELECT variant, model, season, " + _POINT + " FROM sa GROUP BY 1, 2, 3), p3 AS (SELECT model, flag, " + _POINT + " FROM (" + " UNION ALL ".join(f"SELECT *, '{f}' AS flag FROM ow WHERE {f}" for f in FLAGS) + """) GROUP BY 1, 2),
 cu AS (SELECT quantile_cont(part + h, 0.2) AS c1, quantile_cont(part + h, 0.4) AS c2, quantile_cont(part + h, 0.6) AS c3, quantile_cont(part + h, 0.8) AS c4 FROM lo JOIN fz USING (model) WHERE model = 'weekly' AND phase = 'development'),
 cb AS (SELECT 1 + CAST(f >= c1 AS INT) + CAST(f >= c2 AS INT) + CAST(f >= c3 AS INT) + CAST(f >= c4 AS INT) AS bin, count(*) AS n, avg(f) AS forecast, avg(actual) AS observed FROM ow, cu WHERE model = 'weekly' GROUP BY 1),
 po AS (SELECT phase, count(*) AS rows, count(*) FILTER (WHERE matched) AS matched FROM g GROUP BY 1), al AS (""" + " UNION ALL ".join([
    _long("po", "population", ["rows", "matched"], key="phase", model="''"), _long("fz", "frozen", ["h", "q10", "q90", "n"]), _long("sc", "scale", ["a", "b"]), _long("p1", "point", R.POINT, "variant"), _long("ii", "interval", R.INTERVAL),
    _long("p2", "season", R.POINT, "variant", "season"), _long("p3", "subgroup", R.POINT, key="flag"), _long("cb", "calibration", ["n", "forecast", "observed"], key="bin", model="'weekly'")]) + ")"


@query(REPORT + " SELECT section, variant, key, model, measure, round(value + 1e-9, 4) AS value FROM al")
def track_report(t):
    """The report of a track from a stored run whose files were verified."""
    e = evaluation(t)
    games = e.select("id", "season", "phase", F.expr(MATCHED).alias("matched"), "actual", *(F.expr(f).cast("double").alias(m) for m, f in TRACK.items()), *(F.expr(c).alias(f) for f, c in FLAGS.items()))
    run = files.write_run({"games": games}, f"{checkpoint_folder(t.spark)}/tracks-{uuid.uuid4().hex}", {}, {"track": "A"})
    files.verify_run(t.spark, run)
    found = R.track_report(t.spark.read.parquet(f"{run}/games.parquet"), list(TRACK), "home", "weekly", list(FLAGS))
    return found.select("section", "variant", "key", "model", "measure", S.stable(F.col("value"), 4).alias("value"))
