"""Scans and sinks on the order table: what is written, sealed and read again must be what SQL finds in the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.numbering import checkpoint_folder
from ..sources import files, lineage
from .registry import query

#: Orders of one payload file.
LOT = 5000


def folder(t, name: str) -> str:
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS id, printf('%.10g', o_totalprice / 7.0::DOUBLE) AS a, printf('%.10g', o_totalprice * 12345.678::DOUBLE) AS b, printf('%.10g', (o_orderkey + 0.5::DOUBLE) / 1048576.0::DOUBLE) AS c,
 printf('%.4g', -o_totalprice::DOUBLE) AS d, true AS same FROM orders""")
def csv_round_trip(t):
    """Numbers of ten significant digits and zero-padded ids through a CSV, and held against what was written."""
    x = t.orders.select(S.padded_id(F.col("o_orderkey")).alias("id"), (F.col("o_totalprice") / 7.0).alias("a"), (F.col("o_totalprice") * 12345.678).alias("b"), ((F.col("o_orderkey") + 0.5) / 1048576.0).alias("c"), (-F.col("o_totalprice")).alias("d"))
    texts = x.select("id", *(S.significant(F.col(c)).alias(c) for c in "abc"), S.significant(F.col("d"), 4).alias("d"))
    path = folder(t, "csv")
    texts.write.csv(path, header=True)
    read = files.text_ids_csv(t.spark, path, "id string, a string, b string, c string, d string")
    near = lambda c, share: F.abs(F.col(f"r.{c}").cast("double") - F.col(f"x.{c}")) <= share * F.abs(F.col(f"x.{c}"))
    both = read.alias("r").join(x.alias("x"), "id")
    return both.select("id", *(F.col(f"r.{c}").alias(c) for c in "abcd"), (near("a", 1e-9) & near("b", 1e-9) & near("c", 1e-9) & near("d", 1e-3)).alias("same"))


STORED = """WITH o AS (SELECT o_orderkey AS k, year(o_orderdate) AS season, CAST(o_totalprice AS DECIMAL(18,4)) AS x FROM orders), p AS (SELECT CAST(k // 5000 AS VARCHAR) AS name, count(*) AS n, sum(x) AS x FROM o GROUP BY 1)
 SELECT item, name, CAST(n AS BIGINT) AS n, CAST(x AS DOUBLE) AS total FROM (SELECT 'payload' AS item, * FROM p UNION ALL SELECT 'sealed', * FROM p UNION ALL SELECT 'season', '2000', count(*), sum(x) FROM o WHERE season = 2000
 UNION ALL SELECT 'season', 'none', 0, NULL UNION ALL SELECT 'status', 'here:PRESENT', count(*), NULL FROM o UNION ALL SELECT 'status', 'there:SOURCE_MISSING', NULL, NULL UNION ALL SELECT 'bound', 'above', count(*), NULL FROM o WHERE x > 100000
 UNION ALL SELECT 'whole', 'merged', count(*), sum(CASE WHEN k % 2 = 0 THEN 1 ELSE x END) FROM o UNION ALL SELECT 'run', 'verified', count(DISTINCT season), sum(x) FROM o UNION ALL SELECT 'run', 'stale', 0, NULL)"""


def by_season(spark, inputs: dict[str, str]) -> dict[str, DataFrame]:
    """A stage: orders and their sum by season."""
    rows = spark.read.parquet(f"{inputs['orders']}/*.parquet")
    return {"seasons": rows.groupBy("season").agg(F.count("*").alias("n"), F.sum("x").alias("x"))}


@query(STORED)
def stores_round_trip(t):
    """Payloads in gzip, payloads sealed by their hashes, a season of a partitioned table and one that isn't there, tables that may be missing,
    a text over a folder with a bound value, a table merged back by a pointer, and a run that is made once, verified and not stale."""
    spark, root = t.spark, folder(t, "stores")
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("season"), F.col("o_totalprice").cast("decimal(18,4)").alias("x"))
    lots = o.groupBy(F.floor(F.col("k") / LOT).alias("lot")).agg(F.collect_list(F.struct("k", F.col("x").cast("string").alias("x"))).alias("data"))  # at most LOT rows of different keys
    texts = lots.select(F.to_json(F.struct("data")).alias("value"))
    row, total = "k bigint, x string", F.sum(F.col("x").cast("decimal(18,4)")).cast("double").alias("total")
    texts.write.option("maxRecordsPerFile", 1).text(f"{root}/gz", compression="gzip")
    texts.write.option("maxRecordsPerFile", 1).text(f"{root}/plain")
    named = lambda df, item: df.groupBy(F.floor(F.col("k") / LOT).cast("string").alias("name")).agg(F.count("*").alias("n"), total).select(F.lit(item).alias("item"), "name", "n", "total")
    out = [named(files.payload_rows(spark, f"{root}/gz/*.gz", row), "payload"), named(files.sealed_rows(spark, f"{root}/plain/*.txt", row, files.hashes_by_name(spark, f"{root}/plain/*.txt")), "sealed")]
    line = lambda df, item, name: df.select(F.lit(item).alias("item"), F.lit(name).alias("name"), "n", "total")
    counted = lambda df: df.agg(F.count("*").alias("n"), total)
    o.write.partitionBy("season").parquet(f"{root}/seasons/orders")
    only = files.exactly_one(spark, f"{root}/seasons/*")
    out.append(line(counted(files.season_table(spark, only, "2000")), "season", "2000"))
    try:
        files.season_table(spark, only, "1900")
    except FileNotFoundError:
        out.append(line(spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("total")), "season", "none"))
    status = files.with_status(spark, {"here": only, "there": f"{root}/nothing"})
    out.append(status.select(F.lit("status").alias("item"), F.concat_ws(":", "name", "status").alias("name"), F.col("rows").alias("n"), F.lit(None).cast("double").alias("total")))
    above = files.over_parquet(spark, "select count(*) as n, cast(null as double) as total from {source} where x > :least", only, least=100000)
    out.append(line(above, "bound", "above"))
    files.write_whole(o, f"{root}/whole")
    files.merge_back(spark, f"{root}/whole", o.where("k % 2 = 0").select("k", F.lit(1).cast("decimal(18,4)").alias("x")), ["k"])
    out.append(line(counted(files.read_whole(spark, f"{root}/whole")), "whole", "merged"))
    o.write.parquet(f"{root}/rows")
    stage = lineage.Stage("by_season", {"orders": f"{root}/rows"}, by_season)
    run = lineage.run_stage(spark, stage, f"{root}/runs")
    if lineage.run_stage(spark, stage, f"{root}/runs") != run:
        raise AssertionError("equal work made another run")
    files.verify_run(spark, run)
    out.append(line(spark.read.parquet(f"{run}/seasons.parquet").agg(F.count("*").alias("n"), F.sum("x").cast("double").alias("total")), "run", "verified"))
    out.append(line(spark.range(1).select(F.lit(len(lineage.stale(spark, run))).cast("long").alias("n"), F.lit(None).cast("double").alias("total")), "run", "stale"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
