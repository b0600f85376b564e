"""Rows that stopped an operator once."""

from pyspark.sql import functions as F

from statloom.llm import near_texts, op10_pii


def test_long_runs_of_zeros(spark):
    texts = ["x 1.1.1." + "0" * 5000, "y " + "0" * 6000 + "7.0.0.255 z", "1.1.1." + "9" * 6000, "0" * 20_000, "+" + "1" * 6000 + " 4" * 3000]
    got = {r["doc_id"]: r for r in op10_pii.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k]["n_ip"] for k in range(5)] == [1, 1, 0, 0, 0]
    assert got[0]["spans"].startswith("ip:2:") and op10_pii.redacted(spark.createDataFrame([(texts[0],)], "text string")).first()[0] == "x [IP]"


def test_map_columns_and_equal_rows(spark):
    """Rows that share id and text come down to one, whatever their other columns can do."""
    words = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, words), (1, words), (1, words), (2, words + " more"), (3, "another text of its own kind"), (None, None)], "doc_id long, text string")
    number = F.monotonically_increasing_id() % 7
    docs = docs.withColumn("tags", F.create_map(F.lit("k"), number)).withColumn("root", F.lit("x")).withColumn("nested", F.array(F.struct(F.create_map(F.lit(1), number))))
    left = near_texts.first_of_groups(docs, near_texts.near_texts(docs.select("doc_id", "text")))
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["tags"] is not None) for r in left.collect()) == [(0, True), (1, True), (3, True)]
