"""Fill-in-middle transformation in native SQL functions.

regexp_extract_all makes the array of a text's units (code points); four 32-bit
numbers of the document's sha2 give two cuts and the form; slice and array_join build
the arrangement; parsing the sentinels of the output, and nothing else, gives the text back.
A map over rows: nothing is shuffled, no Python.

Edge cases: a null text is an empty one; an empty text, and one that holds a
sentinel, stays plain; a null id counts as no digits; the same id gives the same cuts
for the same number of units, so repeated rows are transformed alike; an empty
table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are rearranged, and of these, that have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
UNIT = "(?s)."


def drawn(id_column: Column, number: int, seed: str = "1") -> Column:
    """The number-th (from 0) unsigned 32-bit number of a document's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 8 * number, 8), 16, 10).cast("long")


def cuts(docs: DataFrame, kept: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`kept`, _text, _units (the code points), n, _first and _second (units before the
    middle and before the suffix) and form."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    doc = F.col(f"`{id_column}`")
    out = docs.select(kept, text.alias("_text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("_units"), *(drawn(doc, k).alias(f"_h{k + 1}") for k in range(4)))
    name = out.columns[0]
    n = F.size("_units").cast("long")
    whole = (n == 0) | F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE)) | (F.col("_h3") % 100 >= RATE)
    form = F.when(whole, "plain").when(F.col("_h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    a, b = F.col("_h1") % (n + 1), F.col("_h2") % (n + 1)
    return out.select(f"`{name}`", "_text", "_units", n.alias("n"), F.least(a, b).alias("_first"), F.greatest(a, b).alias("_second"), form.alias("form"))


def arranged(docs: DataFrame, kept: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`kept`, n, form, prefix_chars and middle_chars (null if plain), and output."""
    out = cuts(docs, kept, id_column, text_column)
    name = out.columns[0]
    part = lambda start, length: F.array_join(F.slice("_units", (start + 1).cast("int"), length.cast("int")), "")
    first, second, n = F.col("_first"), F.col("_second"), F.col("n")
    prefix, middle, suffix = part(F.lit(0), first), part(first, second - first), part(second, n - second)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "psm", psm).otherwise(spm)
    moved = F.col("form") != "plain"
    return out.select(f"`{name}`", "n", "form", F.when(moved, first).alias("prefix_chars"), F.when(moved, second - first).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output of that form. A sentinel can't arise across a joint, as none
    begins as another ends, so the first of each kind is the one that was put in."""
    between = lambda left, right: F.substring_index(F.substring_index(output, right, 1), left, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def transformed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with their texts rearranged (a null one is empty then), form and, where they have
    it, n_chars of the new text. A column called form gives way."""
    made = arranged(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), id_column, text_column)
    new = {text_column: F.col("output")} | ({"n_chars": F.length("output").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return made.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c != "form"), "form")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = arranged(docs, F.col("doc_id"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
    WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, t, n, form, least(a, b) AS i, greatest(a, b) - least(a, b) AS k, substring(t, 1, least(a, b)) AS pre, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS mid,
  substring(t, greatest(a, b) + 1) AS suf FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN k END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
