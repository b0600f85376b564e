"""Gapless numbers of all rows in an order, without one task that sees them all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bits of a row's number within its partition, in what monotonically_increasing_id() gives.
ROW_BITS = 33


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; on one machine (as in tests) one is made."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder that the session names for checkpoints."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Whether Spark deletes the files of a query's shuffles when it ends, not when the driver happens to collect garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def put(df: DataFrame, path: str) -> None:
    """Writes df, and leaves no shuffle's files behind."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, None)
    conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANED) if before is None else conf.set(CLEANED, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in that folder: Spark knows its size, and broadcasts it if it is small."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    put(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables between the steps of one job, until drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{checkpoint_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        put(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Deletes all tables but the last `keep`; what was made of them must be written by now."""
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for path in gone:
            there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df in ranges of `order`, with _range, and _at, which rises along ranges and rows. Rows
    equal in `order` follow a hash of all their columns (but for those that hold maps), so that a range may end among them; a written table."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.withColumn("_tie", F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString())))
    rows = hashed.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    return checkpointed(rows).withColumn("_range", F.shiftright("_at", ROW_BITS))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place in `order`, from 0: a range shuffle, the rows of each
    range counted in their order, and the sums of earlier ranges' counts (a row for each range).
    Rows equal in `order` are placed by the hash of all their columns; nulls come first."""
    rows = ranged(df, order)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_range", before.alias("_base"))
    return rows.join(F.broadcast(bases), "_range").withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)).drop("_range", "_at", "_base")
