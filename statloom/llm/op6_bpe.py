"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct new words of a block of documents are laid out as one array of
symbols. An inverted index leads from the rank of an adjacent pair to the
positions where it stands; the ranks are replayed in order, each applied to all
its positions at once, and only the touched neighbours are looked up again and
entered in the index. The ids of words are remembered (a bounded number) between
blocks. A pair's rank is that of its joined bytes, as the rank files mean it.

Edge cases: a null or empty text has no ids and decodes to nothing; repeated rows
are rows of their own; words of any length are replayed whole; an empty table
gives no rows; other columns don't matter.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, small_batches

#: Characters of a block's texts; words remembered between blocks.
BLOCK, REMEMBERED = 12_000_000, 400_000
NONE = np.int64(1 << 40)


def distinct(places: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    places = np.sort(places)
    return places[np.append(True, places[1:] != places[:-1])]


class Merges:
    """The ranks of a rank file, with every pair of tokens that makes a token."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.bytes_of}
        self.start = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        pairs = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], rank[order]
        #: Tokens of which a pair may have a lower rank than they have: after such a merge that pair comes first.
        self.turning = set(left[rank < left].tolist()) | set(right[rank < right].tolist())

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where each word's ids end."""
        sizes = np.array([len(x) for x in words], np.int64)
        ends = np.cumsum(sizes)
        symbols = self.start[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        word = np.repeat(np.arange(len(words)), sizes)
        following, previous = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends[sizes > 0] - 1] = -1
        previous[(ends - sizes)[sizes > 0]] = -1
        rank_at, alive = np.full(n, NONE), np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Looks up the pairs that begin at places and enters them in the index."""
            to = following[places]
            ranks = np.full(len(places), NONE)
            inner = to >= 0
            ranks[inner] = self.pair_ranks(symbols[places[inner]], symbols[to[inner]])
            rank_at[places] = ranks
            places, ranks = places[ranks != NONE], ranks[ranks != NONE]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            bounds = np.flatnonzero(np.diff(ranks)) + 1
            cuts = [0, *bounds.tolist(), len(ranks)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                rank, lot = int(ranks[a]), places[a:b]
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(waiting, rank)
                index[rank].append(lot)

        if n:
            enter(np.arange(n))
        while waiting:
            rank = heapq.heappop(waiting)
            places = index.pop(rank)
            places = distinct(np.concatenate(places)) if len(places) > 1 else np.sort(places[0])
            places = places[(rank_at[places] == rank) & alive[places]]
            if not len(places):
                continue
            if rank in self.turning:  # the first of each word, the rest later
                first = np.ones(len(places), bool)
                first[1:] = word[places[1:]] != word[places[:-1]]
                if not first.all():
                    index[rank] = [places[~first]]
                    heapq.heappush(waiting, rank)
                places = places[first]
            elif len(places) > 1:  # of places that overlap, every second one from the left
                overlaps = np.append(False, following[places[:-1]] == places[1:])
                if overlaps.any():
                    at = np.arange(len(places))
                    begun = np.maximum.accumulate(np.where(overlaps, 0, at))
                    places = places[(at - begun) % 2 == 0]
            gone = following[places]
            symbols[places] = rank
            alive[gone] = False
            rank_at[gone] = NONE
            after = following[gone]
            following[places] = after
            previous[after[after >= 0]] = places[after >= 0]
            before = previous[places]
            enter(distinct(np.concatenate([places, before[before >= 0]])))
        return symbols[alive], np.cumsum(np.bincount(word[alive], minlength=len(words)))


class Codec:
    """Encodes texts by replaying merges over their distinct words."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.merges, self.pattern, self.remembered = Merges(path), regex.compile(pattern), remembered
        self.known: dict[str, tuple[str, bytes]] = {}

    def learn(self, pieces: set[str]) -> None:
        """Of each piece: its ids in decimal with a space between, and the bytes that they decode to."""
        split = [(piece, self.pattern.findall(piece)) for piece in pieces]
        words = list({w for _, own in split for w in own})
        ids, ends = self.merges.replay([w.encode("utf-8", "surrogatepass") for w in words])
        ids, ends = ids.tolist(), ends.tolist()
        decimal, decoded = [self.merges.decimal[x] for x in ids], [self.merges.bytes_of[x] for x in ids]
        coded = {w: (" ".join(decimal[a:b]), b"".join(decoded[a:b])) for w, a, b in zip(words, [0, *ends], ends)}
        for piece, own in split:
            got = [coded[w] for w in own]
            self.known[piece] = got[0] if len(got) == 1 else (" ".join([a for a, _ in got]), b"".join([b for _, b in got]))

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each text's ids in decimal, and its decoded bytes. Pieces end where every text has a word's end."""
        new: set[str] = set()
        for text in texts:
            new.update(pieces_of(text))
        old = new.intersection(self.known)
        new -= old
        if len(self.known) + len(new) > self.remembered:  # forget what this block doesn't use, the oldest first
            excess = len(self.known) + len(new) - self.remembered
            for piece in [x for x in self.known if x not in old][:excess]:
                del self.known[piece]
        if new:
            self.learn(new)
        for text in texts:
            got = [self.known[x] for x in pieces_of(text)]
            yield " ".join([a for a, _ in got]), b"".join([b for _, b in got])


_MADE: dict = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = Codec(path, pattern)
    return _MADE[path, pattern]


def coded(docs: DataFrame, path: str, pattern: str, digests: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: id, n_tokens, and digests of the ids and of the
    decoded bytes, or, without digests, ids (array<int>) and decoded (binary)."""
    kind = docs.schema[id_column].dataType.simpleString()

    def block(own: Codec, frames: list[pd.DataFrame]) -> pd.DataFrame:
        rows = []
        for ids, decoded in own.encode([x or "" for frame in frames for x in frame["text"]]):
            n = ids.count(" ") + 1 if ids else 0
            rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()) if digests else (n, [int(x) for x in ids.split()], decoded))
        out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"])
        out.insert(0, id_column, pd.concat([frame["id"] for frame in frames], ignore_index=True))
        return out

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # what is remembered has no cycles, and is large
        own, held, size = codec(path, pattern), [], 0
        for frame in frames:
            held.append(frame)
            size += sum(len(x or "") for x in frame["text"])
            if size >= BLOCK:
                yield block(own, held)
                held, size = [], 0
        if held:
            yield block(own, held)

    small_batches(docs.sparkSession)
    columns = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInPandas(compute, f"`{id_column}` {kind}, n_tokens long, {columns}")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return coded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
