"""Token ids in flat binary files with 64-bit document offsets.

Documents are range-partitioned by id and sorted; each task streams its ids to a
file of unsigned integers, its documents' offsets (signed 64 bits, one more than
documents) and their ids to two files beside it, each under a name of its own
attempt, and renames them when whole. Offsets count from the partition's first
id; the partitions' bases are prefix sums of their counts, kept as a small table.
Readers map the files into memory where the store is a local path.

Layout of a folder: part-00000.ids, .offsets, .docs for each partition, bases.parquet.

Edge cases: a null or empty text is the end id alone; documents of one id stand
together, in the order of their texts; a null id comes first and is kept as the
least 64-bit integer; an empty table gives empty files; other columns don't matter.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import piece_ids, shared_dir, small_batches

NO_ID = -(2**63)
#: Ids read at once where a file can't be mapped, and documents given at once.
CHUNK_DOCS = 5000


def file_system(folder: str):
    """The store of a folder and the folder's path in it."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[5:])
    return fs.LocalFileSystem(), folder


#: UTF-8 bytes of the texts of a file, or so.
PART_BYTES = 1 << 30


def id_type(size: int) -> str:
    """The narrowest unsigned type for a vocabulary."""
    return "<u2" if size <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the files and returns the bases: part, base_doc, base_token, docs, tokens."""
    spark = docs.sparkSession
    if not parts:  # as many as a shuffle has, more where files would be over PART_BYTES of text
        text_bytes = docs.agg(F.sum(F.octet_length(F.col(text_column)))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // PART_BYTES))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        encoder = piece_ids(tokenizer, 1_300_000)
        kind = id_type(max(end_id + 1, encoder.tokenizer.get_vocab_size(with_added_tokens=True)))
        end = np.uint32(end_id).tobytes()
        name = f"{path}/part-{context.partitionId():05d}"
        own = f"{path}/.attempt-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        n = tokens = 0
        with store.open_output_stream(own + ".ids") as ids_file, store.open_output_stream(own + ".offsets") as offsets_file, store.open_output_stream(own + ".docs") as docs_file:
            offsets_file.write(np.array([0], "<i8").tobytes())
            for frame in frames:
                lengths = []
                for raw in encoder.raw([x or "" for x in frame["text"]]):
                    ids = np.frombuffer(b"".join(raw) + end, np.uint32).astype(kind)
                    ids_file.write(ids.tobytes())
                    lengths.append(len(ids))
                offsets = tokens + np.cumsum(lengths)
                offsets_file.write(offsets.astype("<i8").tobytes())
                docs_file.write(frame["id"].to_numpy().astype("<i8").tobytes())
                n, tokens = n + len(lengths), int(offsets[-1]) if lengths else tokens
        for suffix in (".ids", ".offsets", ".docs"):
            store.move(own + suffix, name + suffix)
        yield pd.DataFrame({"part": [context.partitionId()], "docs": [n], "tokens": [tokens], "kind": [kind]})

    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))  # one id may have many rows
    rows = rows.repartitionByRange(parts, "id", "text_hash").sortWithinPartitions("id", "text_hash", "text")
    wrote = sorted(rows.mapInPandas(write, "part int, docs long, tokens long, kind string").collect())  # a row for each partition
    from pyarrow.fs import FileSelector

    store, path = file_system(folder)
    for left in store.get_file_info(FileSelector(path, allow_not_found=True)):  # of attempts that failed
        if left.base_name.startswith(".attempt-"):
            store.delete_file(left.path)
    docs_before = [0, *accumulate(x["docs"] for x in wrote)]
    tokens_before = [0, *accumulate(x["tokens"] for x in wrote)]
    bases = [(x["part"], a, b, x["docs"], x["tokens"], x["kind"]) for x, a, b in zip(wrote, docs_before, tokens_before)]
    table = spark.createDataFrame(bases, "part int, base_doc long, base_token long, docs long, tokens long, kind string")
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/bases.parquet")
    return table


def mapped(store, path: str, kind: str):
    """A file's numbers as an array, mapped where the store is local."""
    if store.type_name == "local":
        return np.memmap(path, kind, "r") if store.get_file_info(path).size else np.empty(0, kind)
    return RangeFile(store, path, kind)


class RangeFile:
    """Slices of a file of numbers by ranged reads."""

    def __init__(self, store, path: str, kind: str):
        self.file, self.kind = store.open_input_file(path), np.dtype(kind)

    def __len__(self) -> int:
        return self.file.size() // self.kind.itemsize

    def __getitem__(self, at: slice) -> np.ndarray:
        start, stop, _ = at.indices(len(self))
        return np.frombuffer(self.file.read_at((stop - start) * self.kind.itemsize, start * self.kind.itemsize), self.kind)


def read_token_files(spark, folder: str, id_column: str = "doc_id") -> DataFrame:
    """A row for each document of the files: id, start, n_tokens, ids_crc32 (of its
    ids as unsigned 32-bit integers), in tasks of a partition each."""
    bases = spark.read.parquet(f"{folder}/bases.parquet")
    bases = bases.repartition(max(1, bases.count()), "part")  # as many tasks as files

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = file_system(folder)
        for frame in frames:
            for part, base, n, kind in zip(frame["part"], frame["base_token"], frame["docs"], frame["kind"]):
                name = f"{path}/part-{part:05d}"
                ids, offsets, doc_ids = mapped(store, name + ".ids", kind), mapped(store, name + ".offsets", "<i8"), mapped(store, name + ".docs", "<i8")
                for at in range(0, n, CHUNK_DOCS):
                    to = min(n, at + CHUNK_DOCS)
                    bounds = np.asarray(offsets[at : to + 1])
                    crcs = [zlib.crc32(np.asarray(ids[a:b]).astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                    own = pd.Series(np.asarray(doc_ids[at:to]), dtype="Int64")
                    yield pd.DataFrame({id_column: own.mask(own == NO_ID), "start": base + bounds[:-1], "n_tokens": np.diff(bounds), "ids_crc32": crcs})

    return bases.mapInPandas(read, f"`{id_column}` long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return read_token_files(spark, folder)
