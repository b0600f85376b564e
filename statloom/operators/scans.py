"""Running values in an order, without a task for a key.

Rows are cut into ranges of key and order. A range works out its own running values; what
the earlier ranges of a key leave behind (a last value, a sum, a maximum, a count) is carried
over by a scan of one row for each range and key. Only the first key of a range can go on from the range before,
so what is carried has at most a row for each range, and is broadcast. A key with most of the rows spreads over all tasks.

Null keys are a key; rows equal in key and order follow the hash of their other columns;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import ranged

#: How rows of a range, and what ranges leave, are put together: (over rows, over ranges, both).
KINDS = {
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), lambda own, carried: F.coalesce(own, carried)),
    "sum": (F.sum, F.sum, lambda own, carried: F.coalesce(own + carried, own, carried)),
    "max": (F.max, F.max, lambda own, carried: F.greatest(own, carried)),
    "count": (F.count, F.sum, lambda own, carried: own + F.coalesce(carried, F.lit(0))),
}


def scan(df: DataFrame, by: list[str], order: list[str], running: dict[str, tuple[str, Column]], earlier: bool = False) -> DataFrame:
    """df with the running values: name to kind (last: that isn't null; sum; max; count) and
    column, over the rows of a key up to each row, or with `earlier`, before it."""
    rows = ranged(df.select("*", *(c.alias(f"_v_{name}") for name, (_, c) in running.items())), [*by, *order])
    inside = Window.partitionBy("_range", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1 if earlier else 0)
    own = rows.select(*df.columns, "_range", *(KINDS[kind][0](F.col(f"_v_{name}")).over(inside).alias(f"_own_{name}") for name, (kind, _) in running.items()))
    left = []
    for name, (kind, _) in running.items():
        c = F.col(f"_v_{name}")
        left.append((F.max_by(c, F.when(c.isNotNull(), F.col("_at"))) if kind == "last" else KINDS[kind][0](c)).alias(name))
    ends = rows.groupBy("_range", *by).agg(*left)
    ranges = Window.partitionBy(*by).orderBy("_range")
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k_{k}") for k in by), F.row_number().over(ranges).alias("_n"), *(KINDS[kind][1](F.col(name)).over(before).alias(f"_c_{name}") for name, (kind, _) in running.items()))
    carried = carried.where("_n > 1").drop("_n")  # at most a row for each range
    same = own["_range"] == carried["_r"]
    for k in by:
        same = same & own[k].eqNullSafe(carried[f"_k_{k}"])
    both = own.join(F.broadcast(carried), same, "left")
    return both.select(*(c for c in df.columns if c not in running), *(KINDS[kind][2](F.col(f"_own_{name}"), F.col(f"_c_{name}")).alias(name) for name, (kind, _) in running.items()))
