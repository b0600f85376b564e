"""Bootstrap draws that never move: each task makes its own rows' multiplicities.

A draw of n out of n cases is the multinomial count of each case. Cases are numbered, and blocks of
them are the leaves of a tree: a node's count goes to its halves by a binomial whose random numbers come from the
seed and the node alone, so that every task finds the counts of its own blocks, for all draws at once, on the way down from
the root, and all tasks agree. Only sums by draw leave a task. A block that lies in two tasks is made in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered, stored

#: Cases of a block, and draws that are held at once: a matrix of 16 MB.
BLOCK, LOT = 4096, 512


def _random(seed: int, first: int, last: int) -> np.random.Generator:
    """The random numbers of a node, by counters."""
    return np.random.Generator(np.random.Philox(key=np.array([seed, (first << 32) | last], np.uint64)))


def block_counts(number: int, n: int, draws: int, seed: int, block: int = BLOCK) -> np.ndarray:
    """How many of each draw's n picks fall into a block."""
    first, last = 0, -(-n // block)
    count = np.full(draws, n, np.int64)
    while last - first > 1:
        middle = (first + last) // 2
        left, both = min(middle * block, n) - first * block, min(last * block, n) - first * block
        to_left = _random(seed, first, last).binomial(count, left / both)
        if number < middle:
            count, last = to_left, middle
        else:
            count, first = count - to_left, middle
    return count


def multiplicities(number: int, n: int, draws: int, seed: int, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """(first draw, counts by draw and case) of a block, some draws at a time."""
    size = min((number + 1) * block, n) - number * block
    counts = block_counts(number, n, draws, seed, block)
    for at in range(0, draws, LOT):
        lot = counts[at : at + LOT]
        yield at, _random(seed, number + (1 << 31), at).multinomial(lot, np.full(size, 1.0 / size))


def split_draws(losses: DataFrame, draws: int, seed: int, order: list[str], models: list[str], block: int = BLOCK) -> DataFrame:
    """Of a paired bootstrap over rows: draw and each model's RMSE, as paired_draws() gives, whose picks are counted and moved. losses has
    a row for each case of a fixed cohort, numbered in order, and a column of squared losses, none of them null, for each model; an empty cohort has no draws."""
    cases = stored(numbered(losses.select(*order, *models), order, "place").select("place", *models), "cases")
    n = cases.count()

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((draws, len(models)))
        held: dict[int, list[pd.DataFrame]] = {}

        def use(number: int) -> None:
            rows = pd.concat(held.pop(number))
            at, values = rows["place"].to_numpy() - number * block, rows[models].to_numpy(float)
            for first, counts in multiplicities(number, n, draws, seed, block):
                totals[first : first + len(counts)] += counts[:, at] @ values

        seen = False
        for frame in frames:
            for number, part in frame.groupby(frame["place"] // block):
                seen = True
                held.setdefault(int(number), []).append(part)
                while len(held) > 2:  # places mostly rise; a block met again is made again
                    use(next(iter(held)))
        for number in list(held):
            use(number)
        if seen:
            yield pd.DataFrame(totals, columns=models).assign(draw=np.arange(draws))

    parts = cases.mapInPandas(summed, ", ".join(f"`{m}` double" for m in models) + ", draw long")
    return parts.groupBy("draw").agg(*(F.sqrt(F.sum(m) / n).alias(m) for m in models))
