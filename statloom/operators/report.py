"""One report of a forecast track: how its models did on the holdout, as they were frozen and rescaled on development."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import right_closed_bin
from .forecasts import frozen_parameters, interval_metrics, point_metrics
from .numbering import stored
from .relational import quantiles

POINT = ["n", "rmse", "mae", "bias", "correlation", "slope", "intercept"]
INTERVAL = ["coverage", "width", "below", "above", "score"]


def long(df: DataFrame, section: str, measures: list[str], variant: str | None = None, key: str | None = None) -> DataFrame:
    """section, variant, key, model, measure, value: a row for each measure."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))).alias("x")
    return df.select(F.lit(section).alias("section"), (F.col(variant) if variant else F.lit("")).alias("variant"), (F.col(key).cast("string") if key else F.lit("")).alias("key"), "model", each).select("section", "variant", "key", "model", "x.*")


def track_report(games: DataFrame, models: list[str], constant: str, calibrated: str, flags: list[str]) -> DataFrame:
    """games: id, season, phase (development or holdout), matched, actual, a column for each model's part, and boolean flags. Unmatched games are only counted.
    Sections: population, frozen (h, q10, q90), scale (the line fitted on development; not for the constant model), point and interval
    metrics of the holdout, the same by season and by flag, and calibration bins of one model, cut on development. Null flags are false; a phase without matched games has no rows of its sections."""
    parts = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("part")) for m in models))).alias("x")
    rows = stored(games.where("matched").select("id", "season", "phase", "actual", *(F.coalesce(F.col(f), F.lit(False)).alias(f) for f in flags), parts).select("id", "season", "phase", "actual", *flags, "x.*"), "report-rows")
    dev, hold = rows.where("phase = 'development'"), rows.where("phase = 'holdout'")
    frozen = stored(frozen_parameters(dev, ["model"]), "report-frozen")  # a row a model
    lines = dev.where(F.col("model") != constant).groupBy("model").agg(F.regr_intercept("actual", "part").alias("a"), F.regr_slope("actual", "part").alias("b"))
    fixed = F.col("part") + F.col("h")
    variants = F.array(F.struct(F.lit("frozen").alias("variant"), fixed.alias("forecast")), F.struct(F.lit("rescaled").alias("variant"), F.coalesce(F.col("a") + F.col("b") * F.col("part"), fixed).alias("forecast")))
    said = hold.join(F.broadcast(frozen.drop("n")), "model").join(F.broadcast(lines), "model", "left")
    said = stored(said.select("season", "actual", *flags, "model", "q10", "q90", F.explode(variants).alias("v")).select("season", "actual", *flags, "model", "q10", "q90", "v.*"), "report-forecasts")
    own = said.where("variant = 'frozen'")
    ends = own.withColumn("low", F.col("forecast") + F.col("q10")).withColumn("high", F.col("forecast") + F.col("q90"))
    by_flag = own.withColumn("flag", F.explode(F.array(*(F.when(F.col(f), F.lit(f)) for f in flags)))).where("flag is not null")
    cuts = quantiles(dev.where(F.col("model") == calibrated).join(F.broadcast(frozen.select("model", "h")), "model").withColumn("x", fixed), [], "x", [0.2, 0.4, 0.6, 0.8])
    bins = own.where(F.col("model") == calibrated).crossJoin(F.broadcast(cuts)).withColumn("bin", 1 + right_closed_bin(F.col("forecast"), F.col("q")))  # a row of cuts
    bins = bins.groupBy("model", "bin").agg(F.count("*").alias("n"), F.avg("forecast").alias("forecast"), F.avg("actual").alias("observed"))
    people = games.groupBy("phase").agg(F.count("*").alias("rows"), F.count_if("matched").alias("matched")).withColumn("model", F.lit(""))
    out = [
        long(people, "population", ["rows", "matched"], key="phase"), long(frozen, "frozen", ["h", "q10", "q90", "n"]), long(lines, "scale", ["a", "b"]), long(point_metrics(said, ["variant", "model"]), "point", POINT, "variant"), long(interval_metrics(ends, ["model"]), "interval", INTERVAL),
        long(point_metrics(said, ["variant", "model", "season"]), "season", POINT, "variant", "season"), long(point_metrics(by_flag, ["model", "flag"]), "subgroup", POINT, key="flag"), long(bins, "calibration", ["n", "forecast", "observed"], key="bin"),
    ]
    report = out[0]
    for more in out[1:]:
        report = report.union(more)
    return report
