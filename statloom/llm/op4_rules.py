"""Quality rules with a bitmask ledger.

Every rule is evaluated once for each document: the ledger has the measurements
and a number whose bit i says that rule i failed. A policy is a versioned mask of
the rules that count; applying one, or comparing many, only reads the ledger.
Ablations count documents by ledger number and combine the numbers bitwise.
All on DataFrame functions; nothing is shuffled for the ledger.

Edge cases: a null text has no words, as an empty one; repeated rows are rows of
their own; an empty table gives an empty ledger; other columns don't matter.
Windows of five words are compared by 64-bit hashes of their words' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = "[ \\t-\\r]+"

#: Rules in the order of their bits: (name, SQL condition of failure on the measurements).
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("many_words", "n_words > 10000000"),
    ("bullet_lines", "10 * n_bullet_lines > 9 * n_lines and n_lines > 3"),
    ("ellipsis_lines", "10 * n_ellipsis_lines > 5 * n_lines and n_lines > 3"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Versioned policies: masks of the rules that reject.
POLICIES = {
    "base-1": BASE,
    "web-1": BASE | BIT["symbols"],
    "web-2": BASE | BIT["symbols"] | BIT["short_words"] | BIT["long_words"] | BIT["repeated_lines"] | BIT["many_words"] | BIT["bullet_lines"] | BIT["ellipsis_lines"],
}


def measured(docs: DataFrame, kept: Column | str = "doc_id", text_column: str = "text") -> DataFrame:
    """`kept`, with n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_bullet_lines, n_ellipsis_lines and n_repeat_words. To keep a whole row,
    give it as a struct: so no name clashes."""
    kept = F.col(kept) if isinstance(kept, str) else kept
    name = docs.select(kept).columns[0]
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    out = docs.select(kept, text.alias("_text"))
    kept = [F.col(f"`{name}`")]
    words = F.filter(F.split("_text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    out = out.select(
        *kept, F.transform(words, lambda w: F.xxhash64(w)).alias("_words"), lines.alias("_lines"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    windows = F.expr(
        "if(size(_words) < 5, array(), transform(sequence(0, size(_words) - 5),"
        " i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2), get(_words, i + 3), get(_words, i + 4))))"
    )
    bullets = F.filter("_lines", lambda x: x.rlike("^[ \\t-\\r]*[-*•]"))
    dots = F.filter("_lines", lambda x: x.rlike("(\\.\\.\\.|…)[ \\t-\\r]*$"))
    out = out.select(
        *kept, "word_chars", "n_symbols", F.size("_words").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(bullets).cast("long").alias("n_bullet_lines"), F.size(dots).cast("long").alias("n_ellipsis_lines"), windows.alias("_windows"),
    )
    # Only where a window repeats: its places, by sorting (hash, place); each covers five words or as many as reach to the next.
    ordered = "sort_array(transform(_windows, (h, i) -> struct(h, i)))"
    again = f"transform(array({ordered}), s -> filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false)))[0]"
    places = f"array_sort(transform({again}, x -> x.i))"
    covered = f"transform(array({places}), p -> aggregate(transform(p, (x, k) -> least(5, coalesce(get(p, k + 1) - x, 5))), 0, (a, b) -> a + b))[0]"
    repeats = F.expr(f"cast(if(size(array_distinct(_windows)) = size(_windows), 0, {covered}) as long)")
    out = out.withColumn("n_repeat_words", repeats).drop("_windows")
    # Generated columns: a filter on them isn't pushed below, where it would compute each measurement anew for every use.
    return out.select(*kept, F.inline(F.array(F.struct(*(c for c in out.columns if c != name)))))


def ledger(docs: DataFrame, kept: Column | str = "doc_id", text_column: str = "text") -> DataFrame:
    """`kept` with the measurements and `failed`, the number of failure bits."""
    out = measured(docs, kept, text_column)
    bits = " | ".join(f"if({condition}, {BIT[name]}, 0)" for name, condition in RULES)
    return out.withColumn("failed", F.expr(bits))


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with `kept`: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(POLICIES[policy]) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: how many documents it rejects, rejects alone,
    and how many the policy keeps without it; from the counts of each number."""
    mask = POLICIES[policy]
    counts = rows.groupBy(F.col("failed").bitwiseAND(mask).alias("failed")).count()
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in BIT.items() if b & mask))
    each = counts.select("failed", "count", F.explode(rules).alias("r")).select("failed", "count", "r.rule", "r.bit")
    total = lambda condition: F.sum(F.when(F.expr(condition), F.col("count")).otherwise(0))
    return each.groupBy("rule", "bit").agg(total("failed & bit != 0").alias("rejected"), total("failed = bit").alias("rejected_alone"), total("failed & ~bit = 0").alias("kept_without"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = apply_policy(ledger(docs), "web-2")
    base = F.col("failed").bitwiseAND(BASE) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", F.col("failed").cast("long").alias("failed_rules"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM d),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM w),
r AS (SELECT doc_id, sum(step) AS n_repeat_words FROM (
  SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 5) - i) AS step FROM c WHERE n > 1) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
  + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END
  + CASE WHEN n_words > 10000000 THEN 64 ELSE 0 END + CASE WHEN 10 * n_bullet_lines > 9 * n_lines AND n_lines > 3 THEN 128 ELSE 0 END
  + CASE WHEN 10 * n_ellipsis_lines > 5 * n_lines AND n_lines > 3 THEN 256 ELSE 0 END AS failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed_rules
FROM f
"""


def ablation_query(spark, sf_dir: str) -> DataFrame:
    """Of a stored ledger: what each rule of two policies does, from the counts of each number."""
    table = written(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "failed"), "ledger")
    each = [ablations(table, policy).select(F.lit(policy).alias("policy"), "rule", "bit", "rejected", "rejected_alone", "kept_without") for policy in ("base-1", "web-2")]
    return each[0].union(each[1])


ABLATION_SQL = (
    f"WITH l AS ({SQL}), p(policy, mask) AS (VALUES " + ", ".join(f"('{x}', {POLICIES[x]})" for x in ("base-1", "web-2")) + "), u(rule, bit) AS (VALUES " + ", ".join(f"('{n}', {b})" for n, b in BIT.items()) + ")"
    " SELECT policy, rule, bit, count(*) FILTER (WHERE failed_rules & mask & bit <> 0) AS rejected, count(*) FILTER (WHERE failed_rules & mask = bit) AS rejected_alone,"
    " count(*) FILTER (WHERE failed_rules & mask & ~bit = 0) AS kept_without FROM l, p, u WHERE mask & bit <> 0 GROUP BY ALL"
)
