"""Scans and sinks: declared CSV, JSON payloads, sealed files, discovery, content-addressed runs."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store_of(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def text_ids_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header under a declared schema: ids keep their zeros."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def payload_rows(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Rows of {"data": [...]} files (gzip too), each with its file and its place in it."""
    files = spark.read.schema(f"data array<struct<{row_schema}>>").json(path, multiLine=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.posexplode("data").alias("ingest_ord", "row")).select("file", "ingest_ord", "row.*")


def json_document(spark: SparkSession, path: str) -> dict:
    """A small control file (manifest, parameters)."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def hashes_by_name(spark: SparkSession, path: str) -> dict[str, str]:
    """sha256 by file name, of a run's few files."""
    return {r.path.rsplit("/", 1)[-1]: r.sha256 for r in file_hashes(spark, path).collect()}


def sealed_rows(spark: SparkSession, path: str, row_schema: str, expected: dict[str, str]) -> DataFrame:
    """Rows of JSON payload files, parsed from the very bytes that were hashed; a file whose hash
    isn't the expected one fails the read."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.decode("content", "utf-8").alias("text"))
    want = spark.createDataFrame(list(expected.items()), "file string, want string")
    checked = files.join(F.broadcast(want), "file", "left")  # control file: a row a file
    same = F.coalesce(F.col("sha256") == F.col("want"), F.lit(False))
    text = F.when(same, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("changed or unknown file: "), F.col("file"))))
    return checked.select("file", F.posexplode(F.from_json(text, f"data array<struct<{row_schema}>>")["data"]).alias("ingest_ord", "row")).select("file", "ingest_ord", "row.*")


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in order of their names."""
    store, path = store_of(spark, pattern)
    return sorted(x.getPath().toString() for x in (store.globStatus(path) or []))


def exactly_one(spark: SparkSession, pattern: str) -> str:
    """The only path that matches."""
    paths = found(spark, pattern)
    if len(paths) != 1:
        raise FileNotFoundError(f"{len(paths)} paths match {pattern}: {paths[:5]}")
    return paths[0]


def newest(spark: SparkSession, pattern: str) -> str:
    """The path that was changed last; of one time, the last name."""
    store, path = store_of(spark, pattern)
    states = [(x.getModificationTime(), x.getPath().toString()) for x in (store.globStatus(path) or [])]
    if not states:
        raise FileNotFoundError(f"nothing matches {pattern}")
    return max(states)[1]


def season_table(spark: SparkSession, root: str, season: str) -> DataFrame:
    """One season's rows of a table that is partitioned by season; a season without any is an error."""
    rows = spark.read.parquet(root).where(F.col("season") == season)
    if rows.isEmpty():
        raise FileNotFoundError(f"{root} has no season {season}")
    return rows


def with_status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, status, rows: of tables that may be missing, which is a status and no failure."""
    out = None
    for name, path in sorted(paths.items()):
        store, there = store_of(spark, path)
        if store.exists(there):
            row = spark.read.parquet(path).agg(F.lit(name).alias("name"), F.lit("PRESENT").alias("status"), F.count("*").alias("rows"))
        else:
            row = spark.range(1).select(F.lit(name).alias("name"), F.lit("SOURCE_MISSING").alias("status"), F.lit(None).cast("long").alias("rows"))
        out = row if out is None else out.union(row)
    return out


def over_parquet(spark: SparkSession, text: str, path: str, **values) -> DataFrame:
    """A SQL text over a parquet folder, bound as the table `source`, with bound values."""
    return spark.sql(text, args=values or None, source=spark.read.parquet(path))


def run_id(inputs: dict[str, str], parameters: dict) -> str:
    """16 hex digits that name a run by its inputs' hashes and its parameters."""
    return hashlib.sha256(json.dumps([inputs, parameters], sort_keys=True).encode()).hexdigest()[:16]


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file, whole or not at all: written beside, then renamed; one that is there is an error."""
    store, final = store_of(spark, path)
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{final.getParent()}/.{final.getName()}-{uuid.uuid4().hex}")
    _put(store, own, text)
    if store.exists(final) or not store.rename(own, final):
        store.delete(own, False)
        raise FileExistsError(path)


def _put(store, path, text: str) -> None:
    """Creates a file that isn't there, exclusively."""
    stream = store.create(path, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


#: The folder of a versioned table's pointers: files with rising numbers, each naming a version and ending in a newline.
POINTERS = "_pointers"


def pointers(spark: SparkSession, path: str) -> list[tuple[int, str | None]]:
    """The numbers of a table's pointers in order, and the version that each names; null if its
    writer didn't end, or its version isn't there."""
    store, folder = store_of(spark, f"{path}/{POINTERS}")
    if not store.exists(folder):
        return []
    out = []
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if name.isdigit():
            text = "".join(r.value for r in spark.read.text(status.getPath().toString(), wholetext=True).collect()) if status.getLen() else ""
            version = text[:-1] if text.endswith("\n") else None
            whole = version and store.exists(store_of(spark, f"{path}/{version}/_SUCCESS")[1])
            out.append((int(name), version if whole else None))
    return sorted(out)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of a table's newest whole version, if there is any."""
    named = [version for _, version in pointers(spark, path) if version]
    return f"{path}/{named[-1]}" if named else None


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a table that write_whole() made."""
    there = current(spark, path)
    if there is None:
        raise FileNotFoundError(f"{path} has no whole version")
    return spark.read.parquet(there)


def write_whole(df: DataFrame, path: str, before: Callable[[str], None] = lambda step: None, after: int | None = None) -> str:
    """A new version of a table, whole or not at all: the rows go to a folder of their own, and one
    small pointer, created exclusively, makes them the table. Readers have the old version until then, and keep
    what they opened, as nothing is renamed or deleted. With `after`, the number of the pointer that the writer has read, a
    pointer by somebody else since is an error and no overwrite. before is called ahead of each step (for tests)."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    before("rows")
    df.write.parquet(f"{path}/{version}")
    before("pointer")
    while True:
        seen = [n for n, _ in pointers(spark, path)]
        number = max(seen, default=0) + 1
        if after is not None and any(n > after for n in seen):
            raise OSError(f"{path} was changed meanwhile")
        store, there = store_of(spark, f"{path}/{POINTERS}/{number:012d}")
        try:
            stream = store.create(there, False)
        except Exception:
            if after is None and store.exists(there):  # somebody was first: the next number
                continue
            raise
        try:
            before("name")
            stream.write(bytearray(f"{version}\n".encode()))
        finally:
            stream.close()
        return f"{path}/{version}"


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes the versions that none of the newest `keep` whole pointers names; how many. For a time when
    no writer is at work: a version without a pointer may be one that is being written."""
    named = [version for _, version in pointers(spark, path) if version][-keep:]
    store, folder = store_of(spark, path)
    gone = [x.getPath() for x in store.listStatus(folder) if x.getPath().getName().startswith("v-") and x.getPath().getName() not in named]
    for there in gone:
        store.delete(there, True)
    return len(gone)


def copy_whole(spark: SparkSession, source: str, target: str) -> None:
    """A file, copied whole or not at all."""
    (store, a), (to_store, b) = store_of(spark, source), store_of(spark, target)
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{b.getParent()}/.{b.getName()}-{uuid.uuid4().hex}")
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store, a, to_store, own, False, spark._jsc.hadoopConfiguration()) or not to_store.rename(own, b):
        raise OSError(f"{source} can't be copied to {target}")


def write_run(tables: dict[str, DataFrame], root: str, inputs: dict[str, str], parameters: dict, last: Callable[[], None] = lambda: None) -> str:
    """Writes a run once, under a name made of its inputs and parameters: all tables and then a
    manifest with their files' hashes, in a folder of its own that is renamed. A run that is
    there is verified and kept; one that isn't whole or was changed is an error. last is called
    ahead of the rename, and may refuse."""
    spark = next(iter(tables.values())).sparkSession
    name = run_id(inputs, parameters)
    store, final = store_of(spark, f"{root}/{name}")
    if store.exists(final):
        verify_run(spark, f"{root}/{name}")
        return f"{root}/{name}"
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{own}/{table}.parquet")
    files = run_files(spark, own, list(tables))
    put_text(spark, f"{own}/manifest.json", json.dumps({"run_id": name, "inputs": inputs, "parameters": parameters, "tables": sorted(tables), "files": files}, sort_keys=True))
    try:
        last()
    except Exception:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(own), True)
        raise
    if not store.rename(spark._jvm.org.apache.hadoop.fs.Path(own), final):
        if store.exists(final):  # somebody else made the same run
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(own), True)
            verify_run(spark, f"{root}/{name}")
            return f"{root}/{name}"
        raise OSError(f"{final} can't be written")
    return f"{root}/{name}"


def run_files(spark: SparkSession, folder: str, tables: list[str]) -> dict[str, str]:
    """sha256 of each part of each table, by table and part."""
    return {f"{table}/{name}": sha for table in tables for name, sha in hashes_by_name(spark, f"{folder}/{table}.parquet/*.parquet").items()}


def verify_run(spark: SparkSession, folder: str) -> dict:
    """The manifest of a run whose files are all there and unchanged."""
    store, path = store_of(spark, f"{folder}/manifest.json")
    if not store.exists(path):
        raise OSError(f"{folder} is there but isn't whole")
    manifest = json_document(spark, f"{folder}/manifest.json")
    if folder.rstrip("/").rsplit("/", 1)[-1] != manifest["run_id"] or run_files(spark, folder, manifest["tables"]) != manifest["files"]:
        raise OSError(f"{folder} was changed")
    return manifest


def merged(table: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """table with the columns of update where its keys are; rows of table stay, null keys
    match nothing, keys of update must be unique."""
    news = [c for c in update.columns if c not in keys]
    joined = table.drop(*news).join(update, keys, "left")
    old = [c for c in table.columns if c in news]
    if old:
        seen = table.select(*keys, *(F.col(c).alias(f"_{c}") for c in old))
        joined = joined.join(seen, keys, "left").select(*keys, *(c for c in joined.columns if c not in (*keys, *old)), *(F.coalesce(c, f"_{c}").alias(c) for c in old))
    return joined


def merge_back(spark: SparkSession, path: str, update: DataFrame, keys: list[str]) -> str:
    """A new version of the table at path with the columns of update; a writer that came in between is an error."""
    seen = pointers(spark, path)
    return write_whole(merged(read_whole(spark, path), update, keys), path, after=max((n for n, _ in seen), default=0))
