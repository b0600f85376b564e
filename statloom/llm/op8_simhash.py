"""Near duplicates by SimHash and anchor-point covering.

A fingerprint's bits are cut into blocks; in each block the words of a perfect
Hamming code are the anchors: every block value is within one bit (the covering
radius) of an anchor. Two fingerprints that differ in few bits differ in still
fewer in one of the blocks, so each fingerprint is replicated to every anchor
within covering radius plus the block's share of the threshold, and fingerprints
are compared per anchor only. An anchor's list gives a spanning forest of its
links, not all pairs; long lists are compared in tiles.

Edge cases: a null or empty text, or one of white space, has fingerprint zero
and is linked like any other; repeated rows and ids stay, each with its own row;
a component of null ids alone has a null component_id; an empty table gives an
empty result; other columns of the table don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, key_runs, small_batches, written

LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Rows of an anchor's list that are compared at once; longer lists go in tiles.
TILE = 2048
#: Shingles of a document that are held at once.
HELD = 200_000
#: Block lengths of the perfect Hamming codes that serve as anchors: 2**r - 1.
CODES = (7, 15, 31)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash (unsigned) of the lower-cased text's word shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    counts = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for at in range(0, n, HELD):
        part = found[at : min(at + HELD, n) + words - 1]
        size = min(HELD, n - at)
        shingles = map(join, zip(*(part[k : k + size] for k in range(words)))) if n > 1 or len(found) == words else [join(part)]
        raw = np.frombuffer(b"".join([digest(x, 42) for x in shingles]), np.uint8)
        counts += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, fp (the fingerprint as a signed long)."""
    kind = docs.schema[id_column].dataType.simpleString()

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = np.array([fingerprint(x, words) for x in frame["text"]], np.uint64).astype(np.int64)
            yield pd.DataFrame({"id": frame["id"], "fp": fps})

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInPandas(compute, f"id {kind}, fp long")


def block_layout(blocks: int) -> list[tuple[int, int]]:
    """(first bit, length) of each block: the longest code that fits `blocks` times into 64 bits."""
    length = max(x for x in CODES if x * blocks <= 64)
    return [(k * length, length) for k in range(blocks)]


def near_anchors(length: int, reach: int) -> list[np.ndarray]:
    """For each syndrome of the Hamming code of that length: the bit patterns of
    at most `reach` bits that lead to an anchor."""
    found: list[list[int]] = [[] for _ in range(length + 1)]
    for weight in range(reach + 1):
        for places in combinations(range(1, length + 1), weight):
            syndrome, mask = 0, 0
            for place in places:
                syndrome ^= place
                mask |= 1 << (place - 1)
            found[syndrome].append(mask)
    return [np.array(x, np.int64) for x in found]


def anchored(fps: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """block, anchor, fp, home: a row for each anchor within covering radius plus
    the block's share of max_bits. home: the anchor within the covering radius."""
    layout = block_layout(blocks)
    reach = 1 + max_bits // blocks

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = near_anchors(layout[0][1], reach)
        weights = [np.array([bin(x).count("1") for x in m.tolist()]) for m in masks]
        for frame in frames:
            all_fps = frame["fp"].to_numpy()
            for lot in np.array_split(all_fps, max(1, len(all_fps) // 2000)):
                for block, (first, length) in enumerate(layout):
                    value = (lot.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << length) - 1)
                    syndrome = np.zeros(len(lot), np.int64)
                    for bit in range(length):
                        syndrome ^= np.where(value >> bit & 1, bit + 1, 0)
                    for s in np.unique(syndrome):
                        own = syndrome == s
                        anchors = value[own][:, None] ^ masks[s][None, :]
                        yield pd.DataFrame({"block": np.int8(block), "anchor": anchors.ravel().astype(np.int32), "fp": np.repeat(lot[own], len(masks[s])), "home": np.tile(weights[s] <= 1, own.sum())})

    def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for frame in compute(frames):
            held.append(frame)
            rows += len(frame)
            if rows > 50_000:
                yield pd.concat(held, ignore_index=True)
                held, rows = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return fps.select("fp").mapInPandas(gathered, "block tinyint, anchor int, fp long, home boolean")


def spanning_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between some fingerprints."""
    left, out = np.unique(fps).view(np.uint64), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                joined = left[near]
                out += [(int(at.view(np.int64)), int(x)) for x in joined.view(np.int64)]
                todo += list(joined)
                left = left[~near]
    return out


def links(fps: DataFrame, max_bits: int = 3, blocks: int = 2, shared: Shared | None = None) -> DataFrame:
    """u, v: links u > v between distinct fingerprints that differ in at most
    max_bits bits; per anchor and tile a spanning forest, so that none is lost
    for the components."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in key_runs(frames, ["block", "anchor", "tile"]):
            fp, found = frame["fp"].to_numpy(), []
            for start, end in zip(bounds[:-1], bounds[1:]):
                if end - start > 1:
                    found += spanning_links(fp[start:end], max_bits)
            if found:
                pairs = np.array(found, np.int64)
                yield pd.DataFrame({"u": pairs.max(axis=1), "v": pairs.min(axis=1)})

    # Long lists are counted map-side first, so that none goes through one task.
    list_, keys = ["block", "anchor"], ["block", "anchor", "tile"]
    rows = anchored(fps, max_bits, blocks)
    long = rows.groupBy(*list_).agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where(F.col("n") > TILE)
    long = (shared or Shared(fps.sparkSession)).written(long.select(*list_, "any_home", F.ceil(F.col("n") / TILE).cast("long").alias("parts")), "long-lists")
    short = rows.join(long.select(*list_), list_, "left_anti").selectExpr("*", "count(*) over (partition by block, anchor) as n", "max(home) over (partition by block, anchor) as any_home")
    short = short.where("n > 1 and any_home").select(*list_, "fp", F.lit(0).cast("long").alias("tile"))
    found = short.sortWithinPartitions(*list_).mapInPandas(compare, "u long, v long")
    tiled = rows.join(long.where("any_home").drop("any_home"), list_).withColumn("own", F.pmod(F.xxhash64("fp"), "parts"))
    tile = F.expr("transform(sequence(0L, parts - 1), k -> least(own, k) * parts + greatest(own, k))")
    tiled = tiled.select(*list_, "fp", F.explode(tile).alias("tile"))
    return found.union(tiled.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "u long, v long")).distinct()


def components(edges: DataFrame, rounds: int = 60, shared: Shared | None = None) -> DataFrame:
    """u, v: each linked node but a component's smallest, and that smallest one.
    Large and small stars in turn until nothing changes; every round is a written
    table, and goes when the next is there."""
    spark = edges.sparkSession

    def star(now: DataFrame, large: bool, own: Shared) -> DataFrame:
        both = now.union(now.select(F.col("v"), F.col("u"))) if large else now
        least = own.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        met = both.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        return own.written(out.where("u > v").distinct(), "star")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = Shared(spark)
    now = last.written(edges.where("u > v").distinct(), "links")
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        own = Shared(spark)
        now = star(star(now, True, own), False, own)
        last.drop()
        last, after = own, state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    (shared or last).paths += last.paths if shared else []
    return now


def near_duplicates(docs: DataFrame, max_bits: int = 3, words: int = 3, blocks: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: its id, fp (signed long) and component_id, the
    smallest id that links of at most max_bits bits reach."""
    prints = written(fingerprints(docs, words, id_column, text_column), "fingerprints")
    firsts = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = components(links(firsts, max_bits, blocks))
    named = firsts.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("v", "fp").alias("root"), "first")
    named = written(named, "roots")
    least = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    named = written(named.join(least, "root").select("fp", "component_id"), "named-fingerprints")
    return prints.join(named, "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
