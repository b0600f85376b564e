"""Sharding by a k-d tree over documents' metadata.

A node that is to give s shards is split along its widest dimension at the
weighted quantile that gives each side its share of the bytes, until every leaf
is one shard. The quantile of all nodes of a level is found together, by
histograms of bytes over the coordinate that are refined around it: the driver
sees at most `BINS` sums for each node, never rows. Coordinates end with random
bits of the row, so that a value that holds a third of all rows can be split.

Dimensions: size in bytes (logarithm), source and language (places of the different
labels in their order), id (its place between the least and the greatest; hashed where
ids are strings). The widest is that with the largest share of its spread over all
rows; the first of equals. All on DataFrame functions.

Edge cases: a null text has no bytes and size 1; null labels are a value of their own,
before all others; a null id is the least; repeated rows are rows of their own; an empty table gives no rows;
other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import written

#: Bins of a node's histogram; steps of a coordinate, and bits that break its ties.
BINS, STEPS, TIE_BITS = 2048, 1 << 24, 30
#: A cut is fine enough when the bin around it has this share of a shard.
FINE = 1 / 2000
#: Parts in which a shard's rows are numbered.
BUCKETS = 64


@dataclass
class Node:
    first: int
    shards: int
    dim: int = 0
    cut: int = 0


def pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(int(x)).cast("long") for x in values)), index)


def label_places(docs: DataFrame) -> DataFrame:
    """dim, label, place (0 to STEPS - 1): the different labels of source and lang in their
    order. A row for each label, written, so that Spark broadcasts it only if it is small."""
    have = set(docs.columns)
    label = lambda c: F.col(f"`{c}`").cast("string") if c in have else F.lit(None).cast("string")
    both = F.array(*(F.struct(F.lit(c).alias("dim"), label(c).alias("label")) for c in ("source", "lang")))
    labels = numbered(docs.select(F.explode(both).alias("x")).select("x.*").distinct(), ["dim", "label"], "number")
    labels = written(labels, "labels")
    last = max(labels.count() - 1, 1)
    return labels.select("dim", "label", F.floor(F.col("number") * (STEPS - 1) / last).alias("place"))


def metadata(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, size, crc and the coordinates k0.. of each row."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    have = set(docs.columns)
    label = lambda c: F.col(f"`{c}`").cast("string") if c in have else F.lit(None).cast("string")
    rows = docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        label("source").alias("source"), label("lang").alias("lang"), F.monotonically_increasing_id().alias("uid"),
    )
    if dict(rows.dtypes)["id"] == "string":
        id_step = F.pmod(F.xxhash64("id"), F.lit(STEPS))
    else:
        number = F.col(id_column).cast("double")
        least, most = docs.agg(F.min(number), F.max(number)).first()
        share = (F.col("id").cast("double") - F.lit(least or 0.0)) / F.lit(((most or 0.0) - (least or 0.0)) or 1.0)
        id_step = F.floor(F.coalesce(share, F.lit(0.0)) * (STEPS - 1))
    places = label_places(docs)
    for c in ("source", "lang"):
        own = places.where(F.col("dim") == c).select(F.col("label").alias(f"{c}_label"), F.col("place").alias(f"{c}_step"))
        rows = rows.join(own, F.col(c).eqNullSafe(F.col(f"{c}_label")), "left")
    steps = [F.least(F.floor(F.log2("size") * (STEPS / 48)), F.lit(STEPS - 1)), F.col("source_step"), F.col("lang_step"), id_step]
    tie = F.pmod(F.xxhash64("uid"), F.lit(1 << TIE_BITS))
    keys = [(x.cast("long") * (1 << TIE_BITS) + tie).alias(f"k{i}") for i, x in enumerate(steps)]
    return written(rows.select("id", "size", "crc", "uid", *keys), "shard-metadata")


def descend(rows: DataFrame, levels: list[list[Node]], dims: int) -> Column:
    """The number of each row's node on the level after `levels`."""
    keys = F.array(*(F.col(f"k{i}") for i in range(dims)))
    node = F.lit(0)
    for level in levels:
        at = node + 1
        key = F.element_at(keys, (pick([x.dim for x in level], at) + 1).cast("int"))
        # a node of one shard keeps its rows on the left side
        left = (pick([x.shards for x in level], at) == 1) | (key < pick([x.cut for x in level], at))
        node = (2 * node + F.when(left, 0).otherwise(1)).cast("int")
    return node


def spreads(bounds, dims: int) -> list[int]:
    """The steps between the least and the greatest coordinate of each dimension."""
    return [(bounds[f"hi{i}"] >> TIE_BITS) - (bounds[f"lo{i}"] >> TIE_BITS) for i in range(dims)]


def split_level(rows: DataFrame, nodes: list[Node], levels: list[list[Node]], dims: int, whole: list[int]) -> None:
    """Gives each node of a level its dimension and cut. whole: the spreads over all rows, set by the root's level."""
    at = rows.withColumn("node", descend(rows, levels, dims))
    wide = at.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(f"k{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))))
    seen = {x["node"]: x for x in wide.collect()}  # at most a row for each node
    if not whole and seen:
        whole += spreads(seen[0], dims)
    open_, state = [], {}
    for number, node in enumerate(nodes):
        if node.shards < 2 or number not in seen:
            continue
        x = seen[number]
        shares = [a / b if b else 0.0 for a, b in zip(spreads(x, dims), whole)]
        node.dim = shares.index(max(shares))
        goal = x["bytes"] * (node.shards // 2) / node.shards
        state[number] = [x[f"lo{node.dim}"], x[f"hi{node.dim}"] + 1, 0, goal, x["bytes"] / node.shards * FINE]
        open_.append(number)
    while open_:
        blank = [0, 0, 0, 0, 0]
        low = [state.get(i, blank)[0] if i in open_ else 0 for i in range(len(nodes))]
        high = [state.get(i, blank)[1] if i in open_ else 0 for i in range(len(nodes))]
        width = [max(1, -(-(h - w) // BINS)) for w, h in zip(low, high)]
        number = F.col("node") + 1
        key = F.element_at(F.array(*(F.col(f"k{i}") for i in range(dims))), (pick([x.dim for x in nodes], number) + 1).cast("int"))
        inside = at.withColumn("key", key).where((F.col("key") >= pick(low, number)) & (F.col("key") < pick(high, number)))
        bins = inside.withColumn("bin", F.floor((F.col("key") - pick(low, number)) / pick(width, number))).groupBy("node", "bin").agg(F.sum("size").alias("bytes"))
        found: dict[int, dict[int, int]] = {}
        for x in bins.collect():  # at most BINS rows for each node
            found.setdefault(x["node"], {})[x["bin"]] = x["bytes"]
        for i in list(open_):
            start, _, below, goal, fine = state[i]
            w, done = width[i], False
            for b in sorted(found.get(i, {})):
                held = found[i][b]
                if below + held >= goal:
                    if held <= fine or w == 1:
                        over = below + held - goal < goal - below
                        nodes[i].cut, done = start + (b + over) * w, True
                    else:
                        state[i] = [start + b * w, start + (b + 1) * w, below, goal, fine]
                    break
                below += held
            else:
                nodes[i].cut, done = state[i][1], True
            if done:
                open_.remove(i)


def kd_shards(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: its id, size, text_crc32, shard and slot (from 0
    without gaps in its shard)."""
    rows, dims = metadata(docs, id_column, text_column), 4
    levels: list[list[Node]] = []
    nodes, whole = [Node(0, shards)], []
    while any(x.shards > 1 for x in nodes):
        split_level(rows, nodes, levels, dims, whole)
        levels.append(nodes)
        below = []
        for x in nodes:
            left = x.shards // 2 if x.shards > 1 else x.shards
            below += [Node(x.first, left), Node(x.first + left, x.shards - left)]
        nodes = below
    shard = pick([x.first for x in nodes], descend(rows, levels, dims) + 1).cast("int")
    placed = written(rows.select("id", "size", "crc", "uid", shard.alias("shard"), F.pmod(F.xxhash64("uid"), F.lit(BUCKETS)).cast("int").alias("bucket")), "sharded")
    counts = placed.groupBy("shard", "bucket").count()  # at most shards x BUCKETS rows
    bases = counts.selectExpr("shard", "bucket", "coalesce(sum(count) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding), 0) as base")
    numbered = placed.selectExpr("*", "row_number() over (partition by shard, bucket order by uid) - 1 as place")
    out = numbered.join(F.broadcast(bases), ["shard", "bucket"])
    return out.select(F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    found = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
