"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What may stand between words: space and the control characters 9 to 13.
SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the
    session. Where it is unset, a session of one machine (as in tests) gets a temporary folder."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read again: cuts the
    lineage so that a lost executor costs a reread and no recomputation."""
    return Shared(df.sparkSession).written(df, name, **options)


class Shared:
    """Tables between the steps of one job, in the shared folder until drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes the tables; what was made of them must be written by now."""
        for path in self.paths:
            there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)
        self.paths = []


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the Arrow batches that go to Python: documents may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Gives memory that isn't used back to the system: Python workers stay between stages, and
    keep the most that any of them needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over a task's frames that gives its memory back at the end."""

    def run(frames: Iterator) -> Iterator:
        try:
            yield from work(frames)
        finally:
            give_back()

    return run


def key_runs(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """From frames sorted by keys: frames in which every run of equal keys is
    whole, each with the runs' bounds (first row of each run, then the length)."""
    rest = None
    for frame in frames:
        if rest is not None and len(rest):
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        bounds = _bounds(frame, keys)
        rest = frame.iloc[bounds[-2] :].reset_index(drop=True)
        if len(bounds) > 2:
            yield frame.iloc[: bounds[-2]], bounds[:-1]
    if rest is not None and len(rest):
        yield rest, _bounds(rest, keys)


def _bounds(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.ones(len(frame), bool)
    same = np.ones(len(frame) - 1, bool)
    for key in keys:
        values = frame[key].to_numpy()
        same &= values[1:] == values[:-1]
    new[1:] = ~same
    return np.append(np.flatnonzero(new), len(frame))


#: White space as the tokenizers' regular expressions know it (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pieces whose ends are ends of pre-tokens in any text: white space, then
#: anything else; only the last piece of a text may be white space alone.
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


#: White space but space and newline, and the mark that pieces_of() uses.
RARE = re.compile("[\\0\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def pieces_of(text: str) -> list[str]:
    """The pieces of a text; by a plain split where spaces and newlines are its
    only white space and stand alone."""
    if text and not RARE.search(text):
        found = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        if " " not in found and "\n" not in found:
            return found if found[0] else found[1:]
    return PIECE.findall(text)


#: ASCII punctuation that ends a piece; the apostrophe isn't in it, as it starts contractions.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: A single pre-token of Latin letters, which no normalizer but for lower case changes.
LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[ A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff][A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*")


class PieceIds:
    """Token ids of texts, by a tokenizers file. A text is cut where every
    context gives a token's end, and the ids of pieces of at most LONGEST characters are
    remembered, about `remembered` of them: some 150 bytes each, so 150 MB or so.
    encode_batch() gives what the tokenizer gives."""

    LONGEST = 64

    def __init__(self, path: str, remembered: int = 1_000_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        said = self.tokenizer.normalizer
        self.lower = said is not None and "Lowercase" in repr(said)
        #: The same vocabulary without the search for pre-tokens, for pieces that are one.
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.whole.normalizer = normalizers.Sequence([])
        self.whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.remembered, self.known = remembered, {}

    def _encode(self, parts: list[str], tokenizer) -> dict[str, bytes]:
        out = {}
        for at in range(0, len(parts), 20_000):
            lot = parts[at : at + 20_000]
            got = tokenizer.encode(lot, is_pretokenized=True, add_special_tokens=False)
            words = np.array([-1 if x is None else x for x in got.word_ids], np.int64)
            ends = (4 * np.searchsorted(words, np.arange(len(lot)), side="right")).tolist()
            raw, start = np.array(got.ids, np.uint32).tobytes(), 0
            for part, end in zip(lot, ends):
                out[part] = raw[start:end]
                start = end
        return out

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Each new piece's ids: those of the piece without its last punctuation, and
        of that, or of its first newline and the rest; a token ends between a letter or
        digit and punctuation."""
        known = self.known
        if len(known) + len(pieces) > self.remembered:  # forget the oldest
            for piece in list(known)[: len(known) // 2]:
                del known[piece]
        cut, parts = [], {}
        for piece in pieces:
            if piece[0] == "\n" and len(piece) > 1 and not piece[1].isspace():  # before anything but white space a newline is a token's end
                cut.append((piece, "\n", piece[1:]))
                if piece[1:] not in pieces:
                    parts[piece[1:]] = known.get(piece[1:])
                parts["\n"] = known.get("\n")
                continue
            core = piece.rstrip(TAIL)
            if len(core) == len(piece) or not core or not core[-1].isalnum() or core[-1] >= "\u0250":
                parts[piece] = None
            else:
                tail = piece[len(core) :]
                cut.append((piece, core, tail))
                if core not in pieces:
                    parts[core] = known.get(core)
                parts[tail] = known.get(tail)
        todo = [x for x, ids in parts.items() if ids is None]
        single = LETTERS.fullmatch
        plain = [x for x in todo if single(x) and (not self.lower or x[0] != " " and x.islower())]
        parts.update(self._encode(plain, self.whole))
        left = [x for x in todo if parts[x] is None]
        parts.update(self._encode(left, self.tokenizer))
        for piece, core, tail in sorted(cut, key=lambda x: x[1] == "\n"):  # a newline's other part may be cut itself
            parts[piece] = parts[core] + parts[tail]
        known.update((k, v) for k, v in parts.items() if len(k) <= self.LONGEST)
        return parts

    def _split(self, text: str) -> list[str]:
        if not self.lower:
            return pieces_of(text)
        # Without white space tokens a plain split does, but for four controls that str.split() takes as space.
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return PIECE.findall(text) if CONTROLS.search(text) else text.split()

    def raw(self, texts: list[str]) -> Iterator[list[bytes]]:
        """For each text, the ids of its pieces as bytes of uint32."""
        split = [self._split(x) for x in texts]
        get = self.known.get
        found = [list(map(get, x)) for x in split]
        gaps, new = [], set()
        for pieces, ids in zip(split, found):
            own, at = [], -1
            try:
                while True:
                    at = ids.index(None, at + 1)
                    own.append(at)
            except ValueError:
                pass
            new.update([pieces[x] for x in own])
            gaps.append(own)
        fresh = self.learn(new) if new else {}
        for pieces, ids, own in zip(split, found, gaps):
            for at in own:
                ids[at] = fresh[pieces[at]]
            yield ids

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        return [np.frombuffer(b"".join(x), np.uint32) for x in self.raw(texts)]


CONTROLS = re.compile("[\x1c-\x1f]")


_MADE: dict = {}


def piece_ids(path: str, remembered: int = 1_000_000) -> PieceIds:
    """One PieceIds for each Python worker and file."""
    gc.disable()  # what it remembers has no cycles, and is large to walk through
    if path not in _MADE:
        _MADE.clear()
        _MADE[path] = PieceIds(path, remembered)
    return _MADE[path]
