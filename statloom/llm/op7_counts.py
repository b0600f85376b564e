"""Edit-aware token counts.

A document's text is kept as the leaves of a segment tree: pieces at whose ends
every context has a token's end, each with its characters and tokens; a few dozen
leaves stand in a block, and the tree has the blocks' sums. An edit goes down the
tree to the leaves that it touches, takes one more on either side as boundary
context, cuts their edited text into leaves again, counts only those, and updates
the sums above them. A block that grows too long is split, and the sums are then
laid out anew, so that an edit stays cheap after any number of edits. The counts of
pieces are remembered (a bounded number).

Edge cases: a null or empty text has no tokens, and edits can insert into it; null
or no edits leave a text as it is; edits are in the original text's code points and
are clipped to the text; of edits that overlap, the one that begins first ends where
the next begins; insertions at one place stand in the order of the edits; a null
replacement removes; repeated rows are rows of their own; an empty table gives no
rows; other columns don't matter.
"""

from __future__ import annotations

import base64
import gc
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, small_batches


class Counter:
    """Token counts of pieces by a rank file, with a bounded memory."""

    def __init__(self, path: str, pattern: str, remembered: int = 500_000):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.remembered, self.known = remembered, {}

    def counts(self, pieces: list[str]) -> list[int]:
        found = list(map(self.known.get, pieces))
        if None in found:
            if len(self.known) > self.remembered:
                for piece in list(islice(self.known, self.remembered // 2)):
                    del self.known[piece]
            encode = self.encoding.encode_ordinary
            for at, piece in enumerate(pieces):
                if found[at] is None:
                    found[at] = self.known[piece] = len(encode(piece))
        return found


class SegmentTree:
    """Leaves of text in blocks, with sums of characters and tokens above them, level by level."""

    #: Leaves of a new block; a block with over twice as many is split.
    BLOCK = 64

    def __init__(self, text: str, counter: Counter):
        self.counter, self.recounted = counter, 0
        self.blocks: list[list[tuple[str, int]]] = self._cut(self._counted(text))
        self._lay_out()

    def _counted(self, text: str) -> list[tuple[str, int]]:
        pieces = pieces_of(text) if text else []
        return list(zip(pieces, self.counter.counts(pieces)))

    def _cut(self, leaves: list[tuple[str, int]]) -> list[list[tuple[str, int]]]:
        return [leaves[at : at + self.BLOCK] for at in range(0, len(leaves), self.BLOCK)] or [[]]

    def _lay_out(self) -> None:
        sums = [self._sums(x) for x in self.blocks]
        self.chars, self.tokens = (self._levels(np.array(x, np.int64)) for x in zip(*sums))

    @staticmethod
    def _sums(block: list[tuple[str, int]]) -> tuple[int, int]:
        return sum(len(x) for x, _ in block), sum(n for _, n in block)

    @staticmethod
    def _levels(values: np.ndarray) -> list[np.ndarray]:
        levels = [values]
        while len(levels[-1]) > 1:
            last = levels[-1]
            if len(last) % 2:
                last = levels[-1] = np.append(last, 0)
            levels.append(last[0::2] + last[1::2])
        return levels

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[-1][0])

    @property
    def n_chars(self) -> int:
        return int(self.chars[-1][0])

    @property
    def n_leaves(self) -> int:
        return sum(map(len, self.blocks))

    def find(self, place: int) -> tuple[int, int, int]:
        """The block and leaf that hold the code point at a place, and where the leaf begins."""
        node, before = 0, 0
        for level in reversed(self.chars[:-1]):
            node *= 2
            left = int(level[node])
            if place - before >= left and node + 1 < len(level):
                before += left
                node += 1
        node = min(node, len(self.blocks) - 1)
        for leaf, (text, _) in enumerate(self.blocks[node]):
            if place - before < len(text) or leaf == len(self.blocks[node]) - 1:
                return node, leaf, before
            before += len(text)
        return node, 0, before

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces the code points from start to before end."""
        n = self.n_chars
        start, end = min(max(start, 0), n), min(max(end, start, 0), n)
        # a leaf more on either side is context
        _, _, begins = self.find(max(start - 1, 0))
        first, leaf, begins = self.find(max(begins - 1, 0))
        last, end_leaf, ends = self.find(min(end, max(n - 1, 0)))
        if self.blocks[last]:
            last, end_leaf, _ = self.find(min(ends + len(self.blocks[last][end_leaf][0]), max(n - 1, 0)))
        before, after = self.blocks[first][:leaf], self.blocks[last][end_leaf + 1 :]
        text = "".join(x for block in self.blocks[first : last + 1] for x, _ in block)
        skip, rest = sum(len(x) for x, _ in before), sum(len(x) for x, _ in after)
        text = text[skip : len(text) - rest]
        edited = self._counted(text[: start - begins] + replacement + text[end - begins :])
        self.recounted += len(edited)
        leaves = before + edited + after
        new = [leaves] if len(leaves) <= 2 * self.BLOCK and (leaves or len(self.blocks) == last - first + 1) else self._cut(leaves) if leaves else []
        self.blocks[first : last + 1] = new
        if len(new) != last - first + 1:
            self._lay_out()
            return
        for at, block in enumerate(new, first):
            self.chars[0][at], self.tokens[0][at] = self._sums(block)
            for levels in (self.chars, self.tokens):
                node = at
                for below, level in zip(levels[:-1], levels[1:]):
                    node //= 2
                    level[node] = below[2 * node] + below[2 * node + 1]

    @property
    def text(self) -> str:
        return "".join(x for block in self.blocks for x, _ in block)


_MADE: dict = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = Counter(path, pattern)
    return _MADE[path, pattern]


def recounted(docs: DataFrame, path: str, pattern: str, edits_column: str = "edits", id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """A row for each document with its edits, array<struct<start,end,text>>: id,
    n_tokens, n_edits, edited_tokens, edited_chars, n_pieces, recounted_pieces
    and, with_text, the edited text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # what is remembered has no cycles, and is large
        own = counter(path, pattern)
        for frame in frames:
            rows = []
            for text, edits in zip(frame["text"], frame["edits"]):
                tree = SegmentTree(text or "", own)
                before, pieces, n, limit = tree.n_tokens, tree.n_leaves, 0, math.inf
                # from the last to the first, so that places stay what they are
                for e in reversed(sorted([] if edits is None else edits, key=lambda e: e["start"])):
                    tree.edit(e["start"], min(e["end"], limit), e["text"] or "")
                    n, limit = n + 1, e["start"]
                rows.append((before, n, tree.n_tokens, tree.n_chars, pieces, tree.recounted, tree.text if with_text else None))
            made = pd.DataFrame(rows, columns=["n_tokens", "n_edits", "edited_tokens", "edited_chars", "n_pieces", "recounted_pieces", "edited_text"])
            made.insert(0, id_column, frame["id"])
            yield made if with_text else made.drop(columns="edited_text")

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(edits_column).alias("edits"))
    schema = f"`{id_column}` {kind}, n_tokens long, n_edits long, edited_tokens long, edited_chars long, n_pieces long, recounted_pieces long"
    return rows.mapInPandas(compute, schema + ", edited_text string" * with_text)


#: The query's edits: an opening is replaced, a note inserted in the middle, an ending removed.
EDITS = """transform(array(char_length(coalesce(text, ''))), n -> array(
  named_struct('start', 0, 'end', least(5, n div 4), 'text', 'Edited'),
  named_struct('start', n div 2, 'end', n div 2 + least(3, n div 8), 'text', ' [edit]\\n'),
  named_struct('start', n - least(7, n div 8), 'end', n, 'text', '')))[0]"""


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("edits", F.expr(EDITS))
    return recounted(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
