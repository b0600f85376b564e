"""Near texts: groups of documents that share four fifths of their word shingles.

SimHash anchors come first: sets of shingles whose 64-bit fingerprints are linked
through anchors (op8_simhash.links) meet in a bucket. At a similarity of 0.8
fingerprints differ in about a seventh of their bits, which no covering code reaches
with a bounded number of copies (see the README), so bands of minima of the same
hashes give the other buckets. What a bucket proposes is counted exactly, in the task
that has the bucket's sets, and only links that hold leave it: a star for each linked
part of a bucket, never pairs. Later rounds look only at buckets that still hold
several groups. Long buckets are cut into tiles by the size of their sets.

Edge cases: texts without words have the empty set and are one group; texts of fewer
words than a shingle are one shingle; null and repeated ids don't matter to groups;
texts of equal 64-bit hash are held to be equal; an empty table gives no rows; other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, giving_back, key_runs, small_batches, written
from .op8_simhash import HELD, LOWER, components, links

#: Two sets with a similarity s meet in a band with probability s ** DEPTH; all of the
#: bands miss a pair at 0.8 with probability (1 - 0.8 ** 5) ** 30, or 7 in a million.
BANDS, DEPTH = 30, 5
#: Bands of the first round; the rest is looked at where groups remain apart.
EARLY = 6
#: Shingles of the sets that are held in a task at once; longer buckets go in tiles.
TILE_SHINGLES = 1_000_000
#: One in so many members of a long bucket meets those of its other tiles in the first round.
HUBS = 1024


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes (unsigned) of the lower-cased text's different word
    shingles; of all its words where they are fewer, of none for none."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    digest, join = xxhash.xxh64_digest, b" ".join
    shingles = map(join, zip(*(found[k:] for k in range(words)))) if len(found) >= words else [join(found)] if found else []
    return np.unique(np.frombuffer(b"".join([digest(x, 42) for x in shingles]), ">u8").astype(np.uint64))


def set_name(hashes: np.ndarray) -> int:
    """A hash of a set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64))


def set_print(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set, as a signed long."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HELD):
        counts += np.unpackbits(hashes[at : at + HELD].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(np.int64)[0])


def band_keys(hashes: np.ndarray, bands: int = BANDS, depth: int = DEPTH) -> np.ndarray:
    """A key (signed long) for each band of a set that isn't empty: the minima of
    `depth` hash functions."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    draw = np.random.default_rng(8)
    factors = draw.integers(1 << 31, size=bands * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = draw.integers(1 << 32, size=bands * depth, dtype=np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * depth, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 2000):
        least = np.minimum(least, (short[at : at + 2000, None] * factors + shifts).min(axis=0))
    raw = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[4 * depth * k : 4 * depth * (k + 1)], k) for k in range(bands)], np.uint64).view(np.int64)


def linked(sets: list[np.ndarray], labels: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(place, first place) for each set but the first of the parts that links of at least
    that Jaccard similarity join, each counted; sets of one label are joined already."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(1, 0)] if both >= least * (len(sets[0]) + len(sets[1]) - both) - 1e-9 else []
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, columns, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    mark, own = np.zeros(len(times), bool), np.append(0, np.cumsum(sizes))
    shared = times[columns] > 1  # the others are in no intersection
    own, columns = np.append(0, np.cumsum(shared))[own], columns[shared]
    owner = owner[shared]
    left, out = np.arange(len(sets)), []

    def narrowed(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The columns of the sets that are left, and where each one's start."""
        there = np.zeros(len(sets), bool)
        there[keep] = True
        return columns[there[owner]], np.append(0, np.cumsum(np.diff(own)[keep]))

    while len(left):
        root, todo, left = left[0], [left[0]], left[1:]
        held, starts = narrowed(left)
        while todo and len(left):
            at = todo.pop()
            mark[columns[own[at] : own[at + 1]]] = True
            both = np.diff(np.append(0, np.cumsum(mark[held]))[starts])
            mark[columns[own[at] : own[at + 1]]] = False
            hit = (labels[left] == labels[at]) | (both >= least * (sizes[left] + sizes[at] - both) - 1e-9)
            if hit.any():
                todo += left[hit].tolist()
                out += [(x, root) for x in left[hit].tolist()]
                left = left[~hit]
                held, starts = narrowed(left)
    return out


def met(members: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """u, v: the links that hold between the members (key, tile, fp, root) of each bucket's
    tile; texts: fp, text."""

    def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fp, text, places in frame[["fp", "text", "places"]].itertuples(index=False):
                hashes = shingle_hashes(text, words)
                if set_name(hashes) == fp:
                    raw = hashes.tobytes()
                    for at in range(0, len(places), 10):
                        part = places[at : at + 10]
                        yield pd.DataFrame({"key": [x["key"] for x in part], "tile": [x["tile"] for x in part], "fp": fp, "root": part[0]["root"], "shingles": [raw] * len(part)})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in key_runs(frames, ["key", "tile"]):
            us, vs = [], []
            names, roots, raws = (frame[c].to_numpy() for c in ("fp", "root", "shingles"))
            for start, end in zip(bounds[:-1], bounds[1:]):
                if end - start < 2 or (roots[start:end] == roots[start]).all():
                    continue
                order = start + np.argsort(names[start:end])
                for x, y in linked([np.frombuffer(raws[k], np.uint64) for k in order], roots[order], least):
                    if roots[order[x]] != roots[order[y]]:
                        us.append(names[order[x]])
                        vs.append(names[order[y]])
            if us:
                yield pd.DataFrame({"u": np.maximum(us, vs), "v": np.minimum(us, vs)}).drop_duplicates()

    placed = members.groupBy("fp").agg(F.collect_list(F.struct("key", "tile", "root")).alias("places"))
    rows = texts.join(placed, "fp").mapInPandas(giving_back(sets_of), "key long, tile long, fp long, root long, shingles binary")
    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInPandas(giving_back(compare), "u long, v long").distinct()


def near_texts(docs: DataFrame, words: int = 5, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: its id, text_hash, fp (a hash of its set of shingles), root
    (its group's own name) and component_id (the group's smallest id, null if it has none).
    Groups are those of the links between texts that have at least that share of their
    different shingles in common."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = Shared(docs.sparkSession)

    def prints_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingle_hashes(x, words) for x in frame["text"]]
            made = {"fp": [set_name(x) for x in sets], "size": [len(x) for x in sets], "print": [set_print(x) for x in sets], "bands": [band_keys(x) for x in sets]}
            yield pd.DataFrame({"id": frame["id"], "text_hash": frame["text_hash"], **made})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_hash"))
    prints = shared.written(rows.mapInPandas(giving_back(prints_of), f"id {kind}, text_hash long, fp long, size int, print long, bands array<long>"), "prints")
    firsts = prints.groupBy("fp").agg(F.min("text_hash").alias("text_hash"), *(F.first(c).alias(c) for c in ("size", "print", "bands")))
    firsts = shared.written(firsts, "sets")

    # Buckets: linked fingerprints, then bands; only those of several sets, with the tiles that long ones need.
    anchors = components(links(firsts.select(F.col("print").alias("fp")).distinct(), shared=shared), shared=shared).withColumnRenamed("u", "print")
    by_print = firsts.select("fp", "size", "print").join(anchors, "print", "left").select("fp", "size", F.lit(0).alias("band"), F.xxhash64(F.coalesce("v", "print")).alias("key"))
    by_band = firsts.select("fp", "size", F.posexplode("bands").alias("band", "key")).select("fp", "size", F.col("band") + 1, "key")
    places = by_print.union(by_band)
    several = places.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1")
    several = several.select("key", F.ceil(F.col("shingles") / TILE_SHINGLES).cast("int").alias("parts"))
    members = shared.written(places.select("fp", "band", "key").join(several, "key"), "members")
    wanted = members.select("fp").distinct().join(firsts.select("fp", "text_hash"), "fp")
    once = rows.select("text_hash", "text").groupBy("text_hash").agg(F.first("text").alias("text"))
    texts = shared.written(once.join(wanted, "text_hash").select("fp", "text"), "texts")

    tile = F.pmod(F.xxhash64("fp", "key"), F.greatest("parts", F.lit(1)))
    own = F.array(tile)
    hubs = F.when((F.col("parts") > 1) & (F.pmod(F.xxhash64("key", "fp"), F.lit(HUBS)) == 0), F.array(tile, F.lit(-1).cast("long"))).otherwise(own)
    others = F.expr("transform(sequence(0L, parts - 1L), k -> least(own, k) * parts + greatest(own, k))")
    roots, edges = None, None
    rounds = [(F.col("band") <= EARLY, hubs), (F.col("band") > EARLY, hubs), (F.col("parts") > 1, others)]
    for number, (which, tiles) in enumerate(rounds):
        now = members.where(which).withColumn("own", tile)
        if number == 2 and now.isEmpty():
            break
        if roots is None:
            now = now.withColumn("root", F.col("fp"))
        else:  # buckets of one group are done
            now = now.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("v", "fp")).drop("v")
            mixed = now.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("key")
            now = now.join(mixed, "key", "left_semi")
        found = shared.written(met(now.select("key", F.explode(tiles).alias("tile"), "fp", "root"), texts, words, least), "links")
        edges = found if edges is None else edges.union(found)
        roots = components(edges, shared=shared)

    named = firsts.select("fp").join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("v", "fp").alias("root"))
    named = prints.select("id", "text_hash", "fp").join(named, "fp")
    least_ids = named.groupBy("root").agg(F.min("id").alias("component_id"))
    groups = written(named.join(least_ids, "root").select(F.col("id").alias(id_column), "fp", "component_id", "text_hash", "root"), "groups")
    shared.drop()
    return groups


def first_of_groups(docs: DataFrame, groups: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of docs for each root of groups: that of the smallest id, a null id only where
    there is no other. Of texts that share this id and root, that of the smallest hash stays;
    of rows that share id and text, that whose columns, as JSON, have the smallest hash (maps
    can't be ordered). A null text is a text of its own; an empty table gives no rows."""
    rows = groups.groupBy("root", id_column, "text_hash").agg(F.count("*").alias("copies"))
    first = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), "text_hash")
    keepers = rows.groupBy("root").agg(F.min(first).alias("k"))
    # Few rows go, as a rule: they are named, not those that stay.
    said = rows.join(keepers, "root").withColumn("stays", first == F.col("k")).where("not stays or copies > 1")
    said = written(said.select(F.col(id_column).alias("_id"), F.col("text_hash").alias("_hash"), "stays"), "named-rows")
    same = docs[id_column].eqNullSafe(said["_id"]) & (F.xxhash64(docs[text_column]) == said["_hash"])
    out = docs.join(said, same, "left_anti")
    if said.where("stays").isEmpty():
        return out
    several = docs.join(said.where("stays"), same, "left_semi")
    keys = [F.col(f"`{id_column}`"), F.xxhash64(F.col(f"`{text_column}`"))]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = several.groupBy(*(k.alias(f"_key{n}") for n, k in enumerate(keys))).agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("row"))
    return out.union(least.select("row.*"))
