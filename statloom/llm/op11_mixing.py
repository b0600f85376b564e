"""Mixing sources to target weights by hash thresholds.

Every document has a hash; a source's documents are taken in a pass up to a threshold
of it. Words are summed by source and hash bucket; the bucket in which a source's budget
ends is split again by the next bits, and only that one, until it holds a single document.
Budgets over a source's size are whole passes and a last one, so thresholds are nested: who
is in a pass is in every earlier one. Documents are then filtered by their source's threshold:
no sort, and no window over documents.

Targets share the words of all sources by weight, none above `most` times its source;
what is over is shared again, until none is above. The driver sees three sums a round.

Edge cases: a null text has no words, and takes none; the null source is one of its
own, after the others; a null id is a value like any; rows equal in id, source and
text have one hash: a threshold that ends among them takes as many of them as fit, told apart by
their place in the written ledger; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import Shared, written

SPACE = "[ \\t-\\r]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = [1, 2, 3]
#: A document is taken so many times at most.
MOST = 3
#: A level splits a bucket in so many by the next bits of the hash (60 bits), then of the place in the ledger (63).
DIGIT, HASH_BITS, PLACE_BITS = 10, 60, 60
KEYS = ["none", "source"]


def ledger(docs: DataFrame, kept: Column, shared: Shared, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """`kept`, source and none (it is null), size (words), hash and place; a written table."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    source = F.col(f"`{source_column}`").cast("string")
    name = F.concat(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")), F.lit("|"), F.coalesce(source, F.lit("")), F.lit("|"), F.md5(text))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    rows = docs.select(
        kept, source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("source"), F.size(words).cast("long").alias("size"),
        F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"), F.monotonically_increasing_id().alias("place"),
    )
    return shared.written(rows, "mix-ledger")


def targets(sizes: DataFrame, weights: list[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (none, source, size: a row a source) with weight and target."""
    lot = F.array(*map(F.lit, weights))
    rows = numbered(sizes, KEYS, "number").withColumn("weight", F.get(lot, (F.col("number") % len(weights)).cast("int")).cast("long")).drop("number")
    limit = most * F.col("size")
    total = rows.agg(F.sum("size")).first()[0] or 0
    held, weight, full = 0, rows.agg(F.sum("weight")).first()[0] or 0, F.lit(False)
    while weight:
        # those above their limit at this share; a share only grows, so they stay
        full = F.col("weight") * F.lit(float(total - held)) / F.lit(float(weight)) > limit
        said = rows.agg(F.sum(F.when(full, limit)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if ((said["held"] or 0), (said["weight"] or 0)) == (held, weight):
            break
        held, weight = said["held"] or 0, said["weight"] or 0
    share = F.col("weight") * F.lit(float(total - held)) / F.lit(float(weight)) if weight else F.lit(0.0)
    return rows.withColumn("target", F.when(full, limit.cast("double")).otherwise(share) if weight else limit.cast("double"))


def digit(level: int) -> Column:
    """A document's bucket at a level, from 0: of the bits that follow those of the levels before."""
    at = level * DIGIT
    bits, column = (HASH_BITS, "hash") if at < HASH_BITS else (PLACE_BITS, "place")
    return F.shiftright(F.col(column), bits - DIGIT - at % HASH_BITS).bitwiseAND((1 << DIGIT) - 1)


def above(level: int) -> list[Column]:
    """What the documents of one bucket of a level's parent have in common, of the hash and the place."""
    at = level * DIGIT
    return [F.shiftright("hash", max(0, HASH_BITS - at)), F.shiftright("place", PLACE_BITS - max(0, at - HASH_BITS))]


def thresholds(rows: DataFrame, budgets: DataFrame, shared: Shared) -> DataFrame:
    """budgets (none, source, size, target) with passes (whole ones), to_hash and to_place: in
    the last pass those are taken whose pair of hash and place lies below. The document in which
    the budget ends is taken if more than half of it fits."""
    passes = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(MOST))).otherwise(0).cast("long")
    state = budgets.withColumn("passes", passes).withColumn("left", F.col("target") - F.col("passes") * F.col("size"))
    state = shared.written(state.withColumn("hash_above", F.lit(0).cast("long")).withColumn("place_above", F.lit(0).cast("long")), "mix-state")
    done: list[DataFrame] = []
    rows = rows.where("size > 0").select(*KEYS, "size", "hash", "place")
    nothing = state.where((F.col("left") <= 0) | (F.col("size") == 0))
    done.append(nothing.select(*KEYS, F.lit(0).cast("long").alias("to_hash"), F.lit(0).cast("long").alias("to_place")))
    open_ = state.where((F.col("left") > 0) & (F.col("size") > 0)).select(*KEYS, "left", "hash_above", "place_above")
    levels = (HASH_BITS + PLACE_BITS) // DIGIT
    for level in range(levels):
        hashes, places = above(level)
        inside = rows if level == 0 else rows.withColumn("hash_above", hashes).withColumn("place_above", places).join(open_.drop("left"), [*KEYS, "hash_above", "place_above"], "left_semi")
        sums = inside.groupBy(*KEYS, digit(level).alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        # a source has 2^DIGIT sums at most: the bucket in which its budget ends, by adding up its array
        each = sums.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("digit", "words", "docs"))).alias("buckets")).join(open_, KEYS)
        ends = F.expr(
            "aggregate(buckets, struct(left as left, cast(null as bigint) as digit, 0L as words, 0L as docs), (a, b) ->"
            " if(a.digit is null, if(b.words > a.left, struct(a.left as left, b.digit as digit, b.words as words, b.docs as docs), struct(a.left - b.words as left, a.digit as digit, 0L as words, 0L as docs)), a))"
        )
        # which bucket's lower end, in hash and place
        in_hash = level * DIGIT < HASH_BITS
        found = each.select(*KEYS, "hash_above", "place_above", ends.alias("e")).select(*KEYS, "hash_above", "place_above", "e.*")
        down = (F.col("hash_above") * (1 << DIGIT) + F.col("digit")) if in_hash else F.col("hash_above"), F.col("place_above") if in_hash else F.col("place_above") * (1 << DIGIT) + F.col("digit")
        found = shared.written(found.select(*KEYS, "left", "words", "docs", down[0].alias("hash_above"), down[1].alias("place_above")), "mix-state")
        last = (F.col("docs") <= 1) | F.lit(level == levels - 1)
        # the single document in the bucket goes in if more than half of it fits: then the bucket's upper end
        taken = F.when(2 * F.col("left") > F.col("words"), 1).otherwise(0)
        used = (level + 1) * DIGIT
        to_hash = (F.col("hash_above") + taken) * (1 << (HASH_BITS - used)) if in_hash else F.col("hash_above")
        to_place = F.lit(0).cast("long") if in_hash else (F.col("place_above") + taken) * (1 << (HASH_BITS + PLACE_BITS - used))
        done.append(found.where(last).select(*KEYS, to_hash.cast("long").alias("to_hash"), to_place.cast("long").alias("to_place")))
        open_ = found.where(~last).select(*KEYS, "left", "hash_above", "place_above")
        if open_.isEmpty():
            break
    ends = done[0]
    for more in done[1:]:
        ends = ends.unionByName(more)
    return state.join(ends, KEYS).select(*KEYS, F.col("size").alias("source_size"), "target", "passes", "to_hash", "to_place")


def mixed(docs: DataFrame, kept: Column, shared: Shared, **columns: str) -> DataFrame:
    """`kept`, size, none and source, source_size, target, and copies: how many times the mix takes the document."""
    rows = ledger(docs, kept, shared, **columns)
    sizes = rows.groupBy(*KEYS).agg(F.sum("size").alias("size"))
    ends = shared.written(thresholds(rows, targets(sizes), shared), "mix-ends")  # a row a source
    under = (F.col("hash") < F.col("to_hash")) | ((F.col("hash") == F.col("to_hash")) & (F.col("place") < F.col("to_place")))
    name = next(c for c in rows.columns if c not in ("none", "source", "size", "hash", "place"))
    copies = (F.col("passes") + under.cast("long")).alias("copies")
    return rows.join(ends, KEYS).select(f"`{name}`", "size", *KEYS, "source_size", "target", copies)


def mixture(docs: DataFrame, shared: Shared, **columns: str) -> DataFrame:
    """The mix itself: docs' rows as often as it takes them, with copy, from 0. A column called copy gives way."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "copy")).alias("row")
    rows = mixed(docs, row, shared, **columns).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select("row.*", "copy")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = Shared(spark)
    made = mixed(docs.select("doc_id", "text", "source"), F.col("doc_id"), steps)
    source = F.when(~F.col("none"), F.col("source")).alias("source")
    made = written(made.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), source), "mix")
    steps.drop()
    return made


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY 1),
r AS (SELECT 0 AS round, sum(source_size)::BIGINT AS room, sum(w)::BIGINT AS ws FROM s
  UNION ALL SELECT round + 1, (SELECT sum(source_size) FROM s)::BIGINT - x.held, x.ws FROM r, LATERAL (SELECT coalesce(sum(3 * source_size) FILTER (WHERE w * CAST(room AS DOUBLE) / CAST(r.ws AS DOUBLE) > 3 * source_size), 0)::BIGINT AS held,
    coalesce(sum(w) FILTER (WHERE NOT w * CAST(room AS DOUBLE) / CAST(r.ws AS DOUBLE) > 3 * source_size), 0)::BIGINT AS ws FROM s) x WHERE r.ws > 0 AND x.ws < r.ws),
z AS (SELECT room, ws FROM r ORDER BY round DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN ws = 0 OR w * CAST(room AS DOUBLE) / CAST(ws AS DOUBLE) > 3 * source_size THEN 3.0 * source_size ELSE w * CAST(room AS DOUBLE) / CAST(ws AS DOUBLE) END::DOUBLE AS target FROM s, z),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS passes FROM t),
c AS (SELECT doc_id, d.source, size, source_size, target, passes, target - passes * source_size AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS earlier
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((passes + CASE WHEN earlier + size <= budget OR (earlier <= budget AND 2 * (budget - earlier) > size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken, source FROM c
"""
