"""Joins and windows that Spark has no single operator for.

Null keys match nothing in joins, and are a key of their own in places, shares, islands and quantiles. Rows equal in
an order follow the hash of their other columns where places are numbered over ranges, and any order in plain windows
(islands, trailing), whose orders should be unique. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered, stored
from .scans import scan


def asof_strict(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: list[str], values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key strictly
    before it, else nulls. Union and one scan of ranges: linear in the rows, no join, and no
    task for a key. Right rows of one time are decided by their values, the largest. A null key or
    time matches nothing."""
    keys = [F.col(k) for k in by]
    held = F.struct(F.col(right_ts).alias("ts"), *(F.col(v) for v in values))
    known = right.where(F.col(right_ts).isNotNull())
    for key in keys:
        known = known.where(key.isNotNull())
    a = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(0).alias("_side"), F.struct("*").alias("_row"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("_held"))
    b = known.select(*keys, F.col(right_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), held.alias("_held"))
    # of one time, left rows come first: what is given at that time isn't seen
    seen = scan(a.unionByName(b), by, ["_ts", "_side", "_held"], {"_held": ("last", F.col("_held"))}).where("_side = 0")
    return seen.select("_row.*", *(F.col(f"_held.{v}").alias(v) for v in values), F.col("_held.ts").alias(right_ts))


def asof_broadcast(left: DataFrame, dates: DataFrame, left_ts: str, right_ts: str, most: int = 5000) -> DataFrame:
    """Each left row with the last of few dates strictly before it. Up to `most` distinct
    dates (issuance calendars have hundreds) are gathered into one array, in which each row searches by
    halves; more are met by the scan of ranges. A null time has no date before it."""
    dates = dates.select(right_ts).where(F.col(right_ts).isNotNull()).distinct()
    n = dates.limit(most + 1).count()
    if n > most:
        return asof_strict(left, dates, left_ts, right_ts, [], [])
    joined = left.crossJoin(F.broadcast(dates.agg(F.array_sort(F.collect_list(right_ts)).alias("_dates"))))
    steps = F.array(*(F.lit(1 << k) for k in range(n.bit_length(), -1, -1)))
    # how many dates lie before: by steps of half the length
    before = F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.get("_dates", found + step - 1) < F.col(left_ts), found + step).otherwise(found))
    return joined.withColumn(right_ts, F.get("_dates", before - 1)).drop("_dates")


def within(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points with the spans of their key that hold them: start <= at < end. A span lies in
    the level of buckets of the smallest power of four seconds that is as long, so that it touches two at
    most; a point looks in its bucket of every level that has spans, some thirty at most. Spans that
    end before they start, null keys and null times match nothing. Both sides are many times as large as
    Spark takes them for, as it counts a generated row once, so neither may be broadcast."""
    timed = spans.schema[start].dataType.simpleString().startswith("timestamp")
    seconds = lambda c: F.col(c).cast("timestamp").cast("double") if timed else F.col(c).cast("double")
    spans = spans.where(F.col(start) < F.col(end)).withColumn("_level", F.ceil(F.log2(seconds(end) - seconds(start)) / 2).cast("int"))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # exponents of four
    size = F.pow(F.lit(4.0), F.col("_level"))
    first = F.floor(seconds(start) / size)
    b = spans.withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, F.ceil(seconds(end) / size) - 1))))
    each = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    a = points.withColumn("_level", F.explode(each)).withColumn("_bucket", F.floor(seconds(at) / size))
    return a.join(b.hint("merge"), [*by, "_level", "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_bucket")


def linked(events: DataFrame, stints: DataFrame, both: bool = False) -> DataFrame:
    """events (game, event, event_time in seconds, and more) with home_lineup and away_lineup, the sorted players on court,
    and lineup_valid. stints: game, team, player, in_time and out_time in tenths of a second; a player is on court
    from in_time to before out_time. Home is the team of most stints (of equals, the smallest), away the smallest other one. A
    lineup that isn't of five is empty; with `both`, by the older rule, both are unless both are of five. Games without two
    teams, and events of games without stints, have no rows; an event without a time has empty lineups; an event's game and event are unique."""
    teams = stints.where("team is not null").groupBy("game", "team").agg(F.count("*").alias("n"))
    home = teams.groupBy("game").agg(F.max_by("team", F.struct("n", -F.col("team"))).alias("home"), F.count("*").alias("teams")).where("teams > 1").drop("teams")
    sides = teams.join(home, "game").where("team != home").groupBy("game", "home").agg(F.min("team").alias("away"))
    spans = stints.join(sides, "game").where("team in (home, away)").select("game", (F.col("team") == F.col("home")).alias("own"), "player", (F.col("in_time") / 10.0).alias("t_in"), (F.col("out_time") / 10.0).alias("t_out"))
    met = within(events.select("game", "event", "event_time"), spans, ["game"], "event_time", "t_in", "t_out")
    five = lambda own: F.array_sort(F.collect_list(F.when(own, F.col("player"))))
    on = met.groupBy("game", "event").agg(five(F.col("own")).alias("_h"), five(~F.col("own")).alias("_a"))
    none = F.array().cast(dict(on.dtypes)["_h"])
    h, a = F.coalesce("_h", none), F.coalesce("_a", none)
    valid = (F.size(h) == 5) & (F.size(a) == 5)
    shown = lambda side: F.when(valid if both else F.size(side) == 5, side).otherwise(none)
    return events.join(sides.select("game"), "game", "left_semi").join(on, ["game", "event"], "left").select(*events.columns, shown(h).alias("home_lineup"), shown(a).alias("away_lineup"), valid.alias("lineup_valid"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by.., q: the interpolated quantiles of each group, exact; null values don't count."""
    return many_quantiles(df, by, [value], shares).select(*by, F.col(value).alias("q"))


def dealt(df: DataFrame, rows: int, keys: list[str], each: int = 1 << 19) -> DataFrame:
    """df by a hash of keys, where its rows are more than `each` a shuffle partition of the session or a core, into as many partitions as leave each of them
    so many, at least; else as it is. So a task's memory does not grow with the table. Adaptive execution puts the partitions of other shuffles
    together until there is one a core, so that many shuffle partitions alone don't bound it."""
    parts, shuffled = -(-rows // each), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, shuffled), *keys) if parts > min(shuffled, df.sparkSession.sparkContext.defaultParallelism) else df


def pair_counts(df: DataFrame, group: str, member: str, rows: int) -> DataFrame:
    """a, b, n: how many pairs of rows of one group have the members a and b, each row with itself included. A group's equal members count
    once, by their product; pairs are added up in the bucket of their groups, as one of both orders, before they are dealt out by their members. Rows
    without a group are left out; a null member is one like others. rows: those of df."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (1 << 17)))
    x = df.where(F.col(group).isNotNull()).select(F.col(group).alias("_group"), F.col(member).alias("_member"))
    x = x.withColumn("_bucket", F.pmod(F.xxhash64("_group"), F.lit(parts)).cast("int")).repartition(parts, "_bucket")
    sets = x.groupBy("_bucket", "_group", "_member").agg(F.count("*").alias("_n")).groupBy("_bucket", "_group").agg(F.array_sort(F.collect_list(F.struct("_member", "_n"))).alias("_set"))
    pairs = sets.select("_bucket", "_set", F.posexplode("_set").alias("_at", "_x")).select("_bucket", "_x", F.explode(F.expr("slice(_set, _at + 1, size(_set))")).alias("_y"))
    own = pairs.groupBy("_bucket", F.col("_x._member").alias("a"), F.col("_y._member").alias("b")).agg(F.sum(F.col("_x._n") * F.col("_y._n")).alias("n"))
    both = own.repartition(parts, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # of the other order
    turned = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return both.select(F.explode(turned).alias("_p"), "n").select("_p.a", "_p.b", "n")


def size_bin(value: Column) -> Column:
    """A whole number that doesn't fall as a double rises: 256 bins to a power of two, below and above zero; NaN is the greatest."""
    size = (1 << 20) + F.floor(F.least(F.log2(F.abs(value)), F.lit(2000.0)) * 256)
    return F.when(F.isnan(value), 1 << 40).when(value > 0, size).when(value < 0, -size).otherwise(0).cast("long")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls too, of a's and of b's, which has them as _s_ and their name."""
    same = F.lit(True)
    for k in keys:
        same = same & a[k].eqNullSafe(b[f"_s_{k}"])
    return same


#: Bins with a wanted rank, of all groups together, that are sent to all tasks.
FEW = 1 << 17


def many_quantiles(df: DataFrame, by: list[str], values: list[str], shares: list[float]) -> DataFrame:
    """by.., and for each of values an array of its quantiles (null if it has no values): all measures are numbered at once. First values
    are counted in bins, 256 to a power of two; where groups are few, only values of bins that hold a wanted rank are numbered. Equal values
    of a group are one row with a count, and counts are added up over ranges of group, measure and value, so that no task or buffer
    holds a group, and no value is too frequent. A group with no value at all has no row. df is read twice."""
    stacked = df.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("_measure"), F.col(v).cast("double").alias("_value")) for k, v in enumerate(values)))).alias("_x")).select(*by, "_x.*")
    known, keys = stacked.where("_value is not null").withColumn("_bin", size_bin(F.col("_value"))), [*by, "_measure"]
    group = Window.partitionBy(*keys)
    bins = known.groupBy(*keys, "_bin").agg(F.count("*").alias("_count"))
    bins = bins.withColumns({"_upto": F.sum("_count").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_count").over(group)})
    # the two ranks between which a quantile lies, where this value has one of them
    ranks = F.transform(F.array(*(F.lit(float(x)) for x in shares)), lambda x, at: F.struct(at.alias("at"), (x * (F.col("_n") - 1)).alias("rank")))
    lower = F.col("_upto") - F.col("_count")
    holds = lambda rank: (lower <= rank) & (rank < F.col("_upto"))
    mine = F.filter(ranks, lambda r: holds(F.floor(r["rank"])) | holds(F.ceil(r["rank"])))
    inside = [*keys, "_bin"]
    wanted = stored(bins.where(F.size(mine) > 0).select(*(F.col(k).alias(f"_s_{k}") for k in inside), lower.alias("_below"), "_n"), "wanted-bins")
    few = wanted.limit(FEW + 1).count() <= FEW
    if few:
        held = known.join(F.broadcast(wanted), same_keys(known, wanted, inside)).select(*inside, "_below", "_n", "_value")
        counts = held.groupBy(*held.columns).agg(F.count("*").alias("_count"))
        upto = scan(counts, inside, ["_value"], {"_upto": ("sum", F.col("_count"))}).withColumn("_upto", F.col("_upto") + F.col("_below"))
    else:
        upto = scan(known.groupBy(*keys, "_value").agg(F.count("*").alias("_count")), keys, ["_value"], {"_upto": ("sum", F.col("_count"))})
        sizes = wanted.groupBy(*(f"_s_{k}" for k in keys)).agg(F.max("_n").alias("_n"))
        upto = upto.join(sizes, same_keys(upto, sizes, keys))
    met = upto.select(*keys, "_value", F.explode(mine).alias("_r")).select(*keys, "_value", "_r.*")
    part = F.max("rank") - F.floor(F.max("rank"))
    each = met.groupBy(*keys, "at").agg((F.min("_value") + (F.max("_value") - F.min("_value")) * part).alias("_q"))
    mine_of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("_measure") == k, F.struct("at", "_q")))), lambda x: x["_q"])
    made = each.groupBy(*by).agg(*(mine_of(k).alias(v) for k, v in enumerate(values)))
    return made.select(*by, *(F.when(F.size(v) > 0, F.col(v)).alias(v) for v in values))


def islands(df: DataFrame, by: list[str], order: list[str], value: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of equal values (nulls are equal) in order, from 0."""
    window = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(window) == 1
    changed = F.when(first | value.eqNullSafe(F.lag(value).over(window)), 0).otherwise(1)
    marked = df.withColumn("_changed", changed)
    return marked.withColumn(name, F.sum("_changed").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def placed(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with _place, each row's number from 0 within its key, and _n, the key's rows. Rows are
    numbered over ranges of key and order, so that a key with most of the rows isn't one task."""
    rows = numbered(df, [*by, *order], "_place")
    sizes = rows.groupBy(*(F.col(k).alias(f"_key_{k}") for k in by)).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    same = F.lit(True)
    for k in by:
        same = same & rows[k].eqNullSafe(sizes[f"_key_{k}"])
    return rows.join(sizes, same).withColumn("_place", F.col("_place") - F.col("_first")).drop("_first", *(f"_key_{k}" for k in by))


def first_share(df: DataFrame, by: list[str], order: list[str], share: float, name: str) -> DataFrame:
    """Marks the first ceil(share * n) rows of each key."""
    return placed(df, by, order).withColumn(name, F.col("_place") < F.ceil(F.lit(share) * F.col("_n"))).drop("_place", "_n")


def chunk(place: Column, n: Column, chunks: int) -> Column:
    """Which of so many consecutive chunks, from 0, a place is in; earlier ones take the extra rows."""
    size, more = F.floor(n / chunks), n % chunks
    long = more * (size + 1)
    return F.when(place < long, F.floor(place / (size + 1))).otherwise(more + F.floor((place - long) / F.greatest(size, F.lit(1))))


def unique_right(right: DataFrame, keys: list[str]) -> DataFrame:
    """right, when its keys are unique; else an error that names some."""
    twice = right.groupBy(*keys).count().where("count > 1").limit(10).collect()
    if twice:
        raise ValueError(f"keys that aren't unique: {[tuple(x[k] for k in keys) for x in twice]}")
    return right


def trailing(df: DataFrame, by: list[str], order: list[str], n: int):
    """The window of the n rows before the current one."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)


def spine(keys: DataFrame, facts: DataFrame, on: list[str], fill: dict) -> DataFrame:
    """Every key once, with its facts or the fill values."""
    return keys.join(facts, on, "left").fillna(fill)
