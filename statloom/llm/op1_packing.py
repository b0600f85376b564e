"""Hierarchical multi-length packing.

Each document's tokens end with an end id. Windows of the longest context size
that a document fills alone are cut off; what is left of it is routed to the
smallest context size that holds it. The tiers are packed from the longest to
the shortest: a piece opens a window of its tier, and the gap is filled with the
best fitting pieces of shorter tiers, the last of them cut to fit. Every window
so comes to hold exactly its context size. What a partition has left at its end
goes to windows of falling powers of two. Windows in order of falling size are
dealt to step groups of about equal tokens.

Nothing is shuffled: a task packs its own documents, in pools of bounded size,
and a sequence's id has the partition's number in its upper bits, so that a task
that runs again gives the same rows.

Edge cases: a null or empty text is the end id alone; repeated rows and ids are
packed each for itself; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import piece_ids, small_batches

#: Context sizes.
TIERS = (512, 1024, 2048, 4096)
#: Tokens of documents that are packed together.
POOL = 500_000
#: Tokens of a step group.
STEP = 8 * 4096

Piece = tuple[int, int, int]  # length, document, start


def take(pieces: list[Piece], size: int) -> list[Piece]:
    """Pieces of exactly `size` tokens from pieces sorted by length, that have
    as many: the largest that fits, again and again; where none fits, the
    smallest is cut and its rest goes back."""
    out, gap = [], size
    while gap:
        at = bisect_right(pieces, (gap, np.inf, 0)) - 1
        if at >= 0:
            piece = pieces.pop(at)
        else:
            length, doc, start = pieces.pop(0)
            insort(pieces, (length - gap, doc, start + gap))
            piece = (gap, doc, start)
        out.append(piece)
        gap -= piece[0]
    return out


def pack(pieces: list[Piece], tiers: tuple[int, ...] = TIERS, last: bool = False) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces that are left. last: leaves none."""
    pieces.sort()
    total, windows = sum(x[0] for x in pieces), []
    while pieces:
        largest = pieces[-1][0]
        size = next(x for x in tiers if x >= largest)
        if size > total:
            if not last:
                break
            size = 1 << (total.bit_length() - 1)
        if size >= largest:
            first = pieces.pop()
            windows.append([first, *take(pieces, size - largest)])
        else:
            windows.append(take(pieces, size))
        total -= size
    return windows, pieces


class Packer:
    """Packs one partition's documents. Windows wait until a step group of exactly STEP tokens
    can be made of them, the longest first; only a partition's last group may be shorter."""

    def __init__(self, tiers: tuple[int, ...], first_id: int):
        self.tiers, self.sequence, self.group = tiers, first_id, first_id
        #: Of each document with pieces left: its id, its ids from a place on, that place, its tokens.
        self.docs: dict[int, tuple] = {}
        self.pieces: list[Piece] = []
        self.tokens = self.n = self.held = 0
        self.ready: list[tuple[int, list[tuple]]] = []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        longest = self.tiers[-1]
        full = len(ids) // longest * longest
        for start in range(0, full, longest):
            self._wait([(doc_id, start, longest, zlib.crc32(ids[start : start + longest].tobytes()), len(ids))])
        if full < len(ids):
            self.docs[self.n] = (doc_id, ids[full:].copy(), full, len(ids))
            self.pieces.append((len(ids) - full, self.n, full))
            self.tokens += len(ids) - full
        self.n += 1
        if self.tokens >= POOL:
            self.flush(False)
        elif self.held >= STEP:
            self._write(False)

    def flush(self, last: bool) -> None:
        windows, self.pieces = pack(self.pieces, self.tiers, last)
        for window in windows:
            made = []
            for length, doc, start in window:
                doc_id, ids, first, total = self.docs[doc]
                made.append((doc_id, start, length, zlib.crc32(ids[start - first : start - first + length].tobytes()), total))
            self._wait(made)
        self.tokens = sum(x[0] for x in self.pieces)
        still = {doc for _, doc, _ in self.pieces}
        self.docs = {doc: self.docs[doc] for doc in still}
        self._write(last)

    def _wait(self, window: list[tuple]) -> None:
        size = sum(x[2] for x in window)
        self.ready.append((size, window))
        self.held += size

    def _write(self, last: bool) -> None:
        """Sizes are powers of two, so windows from the longest on fill a group exactly."""
        self.ready.sort(key=lambda x: -x[0])
        at = 0
        while at < len(self.ready) and (self.held >= STEP or last):
            filled = 0
            while at < len(self.ready) and filled < STEP:
                size, window = self.ready[at]
                offset = 0
                for doc_id, start, length, crc, total in window:
                    self.rows.append((doc_id, start, length, crc, total, self.sequence, offset, size, self.group))
                    offset += length
                self.sequence, filled, at = self.sequence + 1, filled + size, at + 1
            self.group, self.held = self.group + 1, self.held - filled
        self.ready = self.ready[at:]


COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context_size", "step_group"]


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece: the document's id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, context_size, step_group."""
    kind = docs.schema[id_column].dataType.simpleString()

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = piece_ids(tokenizer, 800_000), np.uint32(end_id).tobytes()
        packer = Packer(tiers, TaskContext.get().partitionId() << 40)

        def rows() -> pd.DataFrame:
            got, packer.rows = packer.rows, []
            out = pd.DataFrame(got, columns=[id_column, *COLUMNS])
            if kind in ("bigint", "int"):
                out[id_column] = out[id_column].astype("Int64")
            return out

        for frame in frames:
            texts = [x or "" for x in frame["text"]]
            ids = [None if pd.isna(x) else x for x in frame["id"].tolist()]
            for doc_id, raw in zip(ids, encoder.raw(texts)):
                packer.add(doc_id, np.frombuffer(b"".join(raw) + end, "<u4"))
            if packer.rows:
                yield rows()
        packer.flush(True)
        if packer.rows:
            yield rows()

    small_batches(docs.sparkSession)
    schema = f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context_size int, step_group long"
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInPandas(compute, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
