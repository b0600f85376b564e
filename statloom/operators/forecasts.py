"""Scores of forecasts: point, interval and bootstrap metrics.

n counts rows; a null actual, forecast or end is left out of the means and shares. A null group is a group of point
and interval metrics, and none of joined ones (frozen parameters by group, calendar blocks), where it is dropped. Equal
rows of a cohort are placed by the hash of their columns. An empty table has no groups, and of ungrouped
metrics one row of nulls and n = 0.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import correlation
from .numbering import numbered, stored
from .relational import quantiles

#: Slots that a task counts at once, four draws of them (the more, the fewer bits a pick), and cases of a block of counts.
SLOTS, CASES = 1 << 22, 1 << 15


def point_metrics(df: DataFrame, by: list[str], actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """n, rmse, mae, bias, correlation and calibration line of each group; the last
    three are null where the forecast is constant."""
    e = F.col(forecast) - F.col(actual)
    varies = F.max(forecast) > F.min(forecast)  # the deviation of a constant, put together of parts, isn't always 0
    r = correlation(F.col(actual), F.col(forecast))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        F.when(varies, r).alias("correlation"),
        F.when(varies, F.regr_slope(F.col(actual), F.col(forecast))).alias("slope"),
        F.when(varies, F.regr_intercept(F.col(actual), F.col(forecast))).alias("intercept"),
    )


def interval_score(actual: Column, low: Column, high: Column, penalty: float = 10.0) -> Column:
    return (high - low) + penalty * F.greatest(low - actual, F.lit(0.0)) + penalty * F.greatest(actual - high, F.lit(0.0))


def interval_metrics(df: DataFrame, by: list[str], actual: str = "actual", low: str = "low", high: str = "high") -> DataFrame:
    a, lo, hi = F.col(actual), F.col(low), F.col(high)
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), share((a >= lo) & (a <= hi)).alias("coverage"), F.avg(hi - lo).alias("width"),
        share(a < lo).alias("below"), share(a > hi).alias("above"), F.avg(interval_score(a, lo, hi)).alias("score"),
    )


def frozen_parameters(df: DataFrame, by: list[str], actual: str = "actual", part: str = "part") -> DataFrame:
    """h = mean(actual - part), the 10 and 90 % quantiles of what is left, and n."""
    residuals = df.select(*by, (F.col(actual) - F.col(part)).alias("_residual"))
    means = residuals.groupBy(*by).agg(F.avg("_residual").alias("h"), F.count("*").alias("n"))
    q = quantiles(residuals, by, "_residual", [0.1, 0.9])
    joined = means.join(q, by) if by else means.crossJoin(q)  # a row each
    return joined.select(*by, "h", (F.col("q")[0] - F.col("h")).alias("q10"), (F.col("q")[1] - F.col("h")).alias("q90"), "n")


def drawn(seed: str, draw: Column, slot: Column, n: Column, part: int = 0) -> Column:
    """A pseudo-random number below n from counters, the same in every engine that has md5,
    which has four such parts of 32 bits."""
    text = F.concat_ws("|", F.lit(seed), draw.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text), 1 + 8 * part, 8), 16, 10).cast("long") % n


#: Differences of models' RMSE: weekly against each other one, prior against legacy, and the gain of one step beyond that of another.
CONTRASTS = {
    "weekly-home": {"weekly": 1, "home": -1}, "weekly-legacy": {"weekly": 1, "legacy": -1}, "weekly-prior": {"weekly": 1, "prior": -1},
    "prior-legacy": {"prior": 1, "legacy": -1}, "gain-gain": {"legacy": 1, "prior": -2, "weekly": 1},
}


def paired_draws(losses: DataFrame, draws: int, seed: str, order: list[str], models: list[str], lot: int = SLOTS, size: int = CASES) -> DataFrame:
    """Of a paired bootstrap over rows: draw and each model's RMSE; all models share the
    draws. losses has a row for each case of a fixed cohort, numbered in order, and a column
    of squared losses for each model. Draws follow from counters that SQL can repeat (those of drawn()). A task makes four draws' picks of a range of slots and
    counts them by case; what is shuffled are the compressed counts of blocks of cases, a few bits a pick, to where a block's losses are.
    split_draws() of resampling.py needs no counts moved."""
    cases = stored(numbered(losses, order, "place").select("place", *(F.col(m).cast("double").alias(m) for m in models)), "cases")
    n = cases.count()
    spark = losses.sparkSession
    lots = spark.range(-(-n // lot)).withColumn("first", F.col("id") * lot).select("first", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 4))).alias("quarter"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def picked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, quarter in zip(frame["first"], frame["quarter"]):
                yield from counted(int(first), min(int(first) + lot, n), int(quarter), n, draws, seed, size)

    counts = lots.repartition(parts * 4, "first", "quarter").mapInPandas(picked, "block long, draw int, counts binary")
    blocks = cases.withColumn("block", F.floor(F.col("place") / size))

    def summed(counts: pd.DataFrame, cases: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((size, 2 * len(models)))
        given = cases[models].to_numpy(float)
        # a null loss is left out of its model's mean
        values[cases["place"].to_numpy() % size] = np.hstack([np.nan_to_num(given), ~np.isnan(given)])
        rows = [np.frombuffer(zlib.decompress(x), np.uint8).astype(float) @ values for x in counts["counts"]]
        return pd.DataFrame(np.array(rows).reshape(-1, 2 * len(models)), columns=[*(f"s_{k}" for k in range(len(models))), *(f"n_{k}" for k in range(len(models)))]).assign(draw=counts["draw"].to_numpy())

    schema = "".join(f"s_{k} double, " for k in range(len(models))) + "".join(f"n_{k} double, " for k in range(len(models))) + "draw int"
    sums = counts.groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(summed, schema)
    mean = lambda k: F.when(F.sum(f"n_{k}") > 0, F.sum(f"s_{k}") / F.sum(f"n_{k}"))
    return sums.groupBy("draw").agg(*(F.sqrt(mean(k)).alias(m) for k, m in enumerate(models)))


def counted(first: int, last: int, quarter: int, n: int, draws: int, seed: str, size: int = CASES) -> Iterator[pd.DataFrame]:
    """block, draw, counts: how often the slots from first to before last pick each case of a block, in the four draws of a quarter; a count
    above 255 goes on in a further row."""
    start, made = f"{seed}|{quarter}|".encode(), []
    for at in range(first, last, size):
        made.append(np.frombuffer(b"".join([hashlib.md5(start + b"%d" % slot).digest() for slot in range(at, min(at + size, last))]), ">u4").reshape(-1, 4).astype(np.uint32))
    numbers = np.concatenate(made)
    for part in range(min(4, draws - 4 * quarter)):
        places = np.sort(numbers[:, part] % np.uint64(n))
        blocks = np.arange(-(-n // size))
        ends = np.searchsorted(places, np.append(blocks, len(blocks)) * np.uint64(size))
        rows = []
        for block, a, z in zip(blocks, ends, ends[1:]):
            counts = np.bincount((places[a:z] - np.uint64(block * size)).astype(np.int64), minlength=size)
            while counts.any():
                now = np.minimum(counts, 255)
                rows.append((block, zlib.compress(now.astype(np.uint8).tobytes(), 1)))
                counts = counts - now
        yield pd.DataFrame(rows, columns=["block", "counts"]).assign(draw=4 * quarter + part)[["block", "draw", "counts"]]


def calendar_draws(blocks: DataFrame, draws: int, seed: str, models: list[str]) -> DataFrame:
    """Of a bootstrap over calendar blocks: draw and each model's RMSE. blocks: season, block
    (its number within the season's blocks that aren't empty, from 0), n, and a sum of squared
    losses for each model. A season's K blocks are drawn K times; its mean is the drawn sums
    by the drawn counts; seasons weigh by their rows."""
    sizes = blocks.groupBy("season").agg(F.count("*").alias("k"), F.sum("n").alias("rows"))
    total = sizes.agg(F.sum("rows").alias("total"))
    slots = blocks.select("season", F.col("block").alias("slot")).join(sizes, "season").crossJoin(F.broadcast(total))  # a row
    slots = slots.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = slots.withColumn("block", drawn(seed, F.col("draw"), F.concat_ws("|", "season", "slot"), F.col("k"))).select("draw", "season", "block", "rows", "total")
    seasons = picks.join(blocks, ["season", "block"]).groupBy("draw", "season", "rows", "total").agg(*((F.sum(m) / F.sum("n")).alias(m) for m in models))
    return seasons.groupBy("draw").agg(*(F.sqrt(F.sum(F.col("rows") / F.col("total") * F.col(m))).alias(m) for m in models))


def contrasts(draws: DataFrame, observed: DataFrame, tracks: list[str], by: list[str] | None = None) -> DataFrame:
    """track, contrast, estimate, low, high (2.5 and 97.5 %): of draws and a row of observed
    RMSE, with a column track_model for each."""
    by = by or []

    def long(df: DataFrame) -> DataFrame:
        made = [
            F.struct(F.lit(track).alias("track"), F.lit(name).alias("contrast"), sum((F.col(f"{track}_{m}") * F.lit(float(c)) for m, c in parts.items()), F.lit(0.0)).alias("value"))
            for track in tracks
            for name, parts in CONTRASTS.items()
        ]
        return df.select(*by, F.explode(F.array(*made)).alias("x")).select(*by, "x.*")

    ends = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))  # of as many values as draws
    spread = long(draws).groupBy(*by, "track", "contrast").agg(ends[0].alias("low"), ends[1].alias("high"))
    return long(observed).withColumnRenamed("value", "estimate").join(spread, [*by, "track", "contrast"])
