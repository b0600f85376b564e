"""Filter interaction audit by a subset-zeta transform.

Each document gets a mask of the filters it fails. Documents are counted by part
and mask, with the good and the toxic ones among them. A zeta transform over subsets
turns a part's 32 counts into the survivors of every set of filters: those whose mask
lies in the set's complement. A step of an order is a difference of two neighbouring
sets, and so are its label losses; a filter's Shapley sum is a weighted sum of such differences.

Only a hash, the id, the part and the mask of a document are shuffled; the equal
texts of a group meet in no task: a document is the first of its text exactly if its pair
of hash and id is that of the text's least id, a join on both.

Edge cases: a null text is an empty one, a null part the empty string; a null id is
neither smaller nor greater than another, so such a document never fails as a copy, and has no
labels; rows of one id and text are equals, none is the other's copy; labels of an id given
twice count if any says so, and null labels say nothing; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared

SPACE = "[ \\t-\\r]+"
#: The filters in the order of their bits: SQL conditions of failure on what measured() gives; the last, of copies, is of the whole table.
FILTERS = [("A", "n_words < 200"), ("B", "100 * n_distinct < 50 * n_words"), ("C", "100 * n_capitals > 2 * n_chars"), ("D", "marks")]
COPY = "E"
LETTERS = "".join(name for name, _ in FILTERS) + COPY
SETS = 1 << len(LETTERS)
#: What is counted of each mask.
COUNTS = ["docs", "good", "toxic"]


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """id, part, hash of the text, and mask of the filters that look at one text."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{part_column}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("hash"), words.alias("_words"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).alias("n_capitals"), F.length(text).alias("n_chars"), text.rlike("[#$%&*|]").alias("marks"),
    )
    rows = rows.select("id", "part", "hash", F.size("_words").alias("n_words"), F.size(F.array_distinct("_words")).alias("n_distinct"), "n_capitals", "n_chars", "marks")
    bits = " + ".join(f"if({condition}, {1 << at}, 0)" for at, (_, condition) in enumerate(FILTERS))
    return rows.select("id", "part", "hash", F.expr(bits).alias("mask"))


def ledger(docs: DataFrame, labels: DataFrame, shared: Shared, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """part, mask of all filters, good and toxic, and docs, how many documents have the
    same of these, id and text. labels: the id, quality and toxic."""
    rows = measured(docs, id_column, text_column, part_column).groupBy("id", "hash", "part", "mask").agg(F.count("*").alias("docs"))
    rows = shared.written(rows, "filter-masks")
    firsts = rows.where("id is not null").groupBy("hash").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = rows.join(firsts, ["hash", "id"], "left")
    copies = F.when(F.col("id").isNotNull() & F.col("first").isNull(), SETS >> 1).otherwise(0)
    # null ids have no labels, but must not meet in one task
    spread = F.when(F.col("id").isNull(), F.xxhash64("hash")).otherwise(0)
    marked = marked.select("id", spread.alias("_spread"), "part", (F.col("mask") + copies).alias("mask"), "docs")
    said = labels.where(F.col(f"`{id_column}`").isNotNull()).groupBy(F.col(f"`{id_column}`").alias("id"))
    said = said.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    each = marked.join(said.withColumn("_spread", F.lit(0).cast("long")), ["id", "_spread"], "left")
    return each.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "docs")


def mask_counts(rows: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: sums of the ledger."""
    marked = lambda c: F.sum(F.when(F.col(c), F.col("docs")).otherwise(0)).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), marked("good"), marked("toxic"))


def _zeta_pass(bit: int):
    return lambda z: F.transform(z, lambda v, i: F.when(i.bitwiseAND(F.lit(bit)) != 0, v + F.get(z, i - bit)).otherwise(v))


def zeta(counts: Column, filters: int) -> Column:
    """From an array of counts by mask, that of sums over the masks that lie in each mask: a bit a pass."""
    for bit in range(filters):
        counts = F.transform(F.array(counts), _zeta_pass(1 << bit))[0]  # each pass by name, so that it isn't computed anew for each place
    return counts


def survivors(counts: DataFrame) -> DataFrame:
    """part, and for docs, good and toxic an array of 32: how many of these fail none but the
    filters of each mask. 32 rows at most of a part come together."""
    dense = counts.groupBy("part").agg(*(F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in COUNTS))
    for c in COUNTS:
        filled = F.expr(f"transform(sequence(0, {SETS - 1}), m -> coalesce(try_element_at({c}, m), 0L))")
        dense = dense.withColumn(c, zeta(filled, len(LETTERS)))
    return dense


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from mask_counts()."""
    inside = survivors(counts)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(LETTERS)))
    rows = inside.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    letter_bit = "shiftleft(1, ascii(substring(filter_order, {}, 1)) - ascii('A'))"
    used = F.expr(f"if(step = 1, 0, aggregate(sequence(1, greatest(step - 1, 1)), 0, (a, k) -> a + {letter_bit.format('k')}))")
    rows = rows.withColumn("_bit", F.expr(letter_bit.format("step"))).withColumn("_before", SETS - 1 - used)  # masks that are left before the step
    rows = rows.withColumn("_after", F.col("_before") - F.col("_bit"))
    lost = lambda c: F.get(c, F.col("_before")) - F.get(c, F.col("_after"))
    failing = F.get("docs", F.lit(SETS - 1)) - F.get("docs", SETS - 1 - F.col("_bit"))
    # a filter's removals after a set of k others: k! orders of those before it, (4 - k)! of those after it
    ways = F.array(*(F.lit(factorial(bin(s).count("1")) * factorial(max(0, len(LETTERS) - 1 - bin(s).count("1")))).cast("long") for s in range(SETS)))
    rows = rows.withColumn("_ways", ways)
    shapley = F.expr(f"aggregate(filter(sequence(0, {SETS - 1}), s -> (s & _bit) = 0), 0L, (a, s) -> a + get(_ways, s) * (get(docs, {SETS - 1} - s) - get(docs, {SETS - 1} - s - _bit)))")
    return rows.select(
        "part", "filter_order", "step", F.get("docs", F.col("_after")).alias("kept"), lost("docs").alias("removed"), (failing - lost("docs")).alias("redundant"),
        (F.get("docs", F.col("_bit")) - F.get("docs", F.lit(0))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    steps = Shared(spark)
    counts = Shared(spark).written(mask_counts(ledger(docs, labels, steps)), "mask-counts")  # 32 rows a part
    steps.drop()
    return audit(counts)


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT a.doc_id, part, len(ws) < 200 AS A, 100 * len(list_distinct(ws)) < 50 * len(ws) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS C,
  regexp_matches(t, '[#$%&*|]') AS D, coalesce(a.doc_id > min(a.doc_id) OVER (PARTITION BY t), false) AS E FROM t a),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM (SELECT doc_id, CAST(quality = 1 AS INT) AS quality, CAST(toxic = 1 AS INT) AS toxic FROM labels) GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [A, B, C, D, E] AS fails FROM f LEFT JOIN l USING (doc_id)),
n AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM n a, n b, n c, n d, n e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT ks, array_to_string(list_transform(ks, lambda k: chr(CAST(64 + k AS INT))), '') AS filter_order, k AS step, ks[k] AS filter FROM o, n),
c AS (SELECT part, fails, good, toxic, count(*) AS docs FROM m GROUP BY ALL),
e AS (SELECT part, filter_order, step, filter, docs, good, toxic, fails[filter] AS failing, len(list_filter(ks[1:step-1], lambda k: fails[k])) > 0 AS gone,
  len(list_filter(fails, lambda x: x)) = 1 AS alone FROM c, s),
r AS (SELECT part, filter_order, step, filter, coalesce(sum(docs) FILTER (WHERE NOT gone AND NOT failing), 0) AS kept, coalesce(sum(docs) FILTER (WHERE NOT gone AND failing), 0) AS removed,
  coalesce(sum(docs) FILTER (WHERE gone AND failing), 0) AS redundant, coalesce(sum(docs) FILTER (WHERE failing AND alone), 0) AS unique_fails,
  coalesce(sum(docs) FILTER (WHERE NOT gone AND failing AND good), 0) AS good_lost, coalesce(sum(docs) FILTER (WHERE NOT gone AND failing AND toxic), 0) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""
