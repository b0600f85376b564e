"""Draws by splitting against the whole tree walked in plain Python."""

import numpy as np
from pyspark.sql import functions as F

from statloom.operators import resampling as B


def whole_tree(n, draws, seed, block):
    """All multiplicities, by walking down the tree once."""
    out = np.zeros((draws, n), np.int64)

    def walk(first, last, count):
        if last - first == 1:
            size = min(last * block, n) - first * block
            for at in range(0, draws, B.LOT):
                out[at : at + B.LOT, first * block : first * block + size] = B._random(seed, first + (1 << 31), at).multinomial(count[at : at + B.LOT], np.full(size, 1 / size))
            return
        middle = (first + last) // 2
        left = B._random(seed, first, last).binomial(count, (middle * block - first * block) / (min(last * block, n) - first * block))
        walk(first, middle, left)
        walk(middle, last, count - left)

    walk(0, -(-n // block), np.full(draws, n, np.int64))
    return out


def test_against_the_whole_tree(spark):
    n, draws, block = 700, 600, 64
    counts = whole_tree(n, draws, 5, block)
    assert (counts.sum(axis=1) == n).all()
    assert abs(counts.mean() - 1) < 1e-12 and abs(counts.var() - (1 - 1 / n)) < 0.01 and abs(np.corrcoef(counts[:, 3], counts[:, 650])[0, 1]) < 0.15
    df = spark.range(n).select("id", (F.col("id") * 7 % 100).cast("double").alias("a"), F.lit(1.0).alias("one"))
    a = np.arange(n) * 7 % 100
    want = np.sqrt(counts @ a / n)
    for parts in (1, 5):
        got = B.split_draws(df.repartition(parts), draws, 5, ["id"], ["a", "one"], block).orderBy("draw").toPandas()
        assert np.allclose(got["a"], want) and np.allclose(got["one"], 1) and got["draw"].tolist() == list(range(draws))
    assert B.split_draws(df.limit(0), draws, 5, ["id"], ["a", "one"], block).count() == 0


def test_plan_joins_no_draws(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("a"))
    plan = B.split_draws(df, 20, 1, ["id"], ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_paired_draws_by_counts(spark):
    """Against md5 in plain Python: lots of slots, blocks of cases, a draw count that isn't a multiple of four, null losses, a case picked often; no join of picks."""
    import hashlib

    from statloom.operators import forecasts as E

    for n in (700, 1):
        draws, df = 6, spark.range(n).select("id", (F.col("id") * 7 % 100).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("b"))
        a, b = np.arange(n) * 7.0 % 100, np.where(np.arange(n) % 3 == 0, np.arange(n), np.nan)
        got = {r["draw"]: r for r in E.paired_draws(df, draws, "s", ["id"], ["a", "b"], 300, 64).collect()}
        assert set(got) == set(range(draws))
        for draw, r in got.items():
            picks = [int(hashlib.md5(f"s|{draw // 4}|{k}".encode()).hexdigest()[8 * (draw % 4) :][:8], 16) % n for k in range(n)]
            assert np.allclose([r["a"], r["b"]], [np.sqrt(a[picks].mean()), np.sqrt(np.nanmean(b[picks]))])
    often = [len(x) for x in E.counted(0, 600, 0, 2, 4, "s")]
    assert often == [2] * 4  # more than 255 picks of either case in one block, by two rows
    assert E.paired_draws(df.limit(0), 4, "s", ["id"], ["a"]).count() == 0
    plan = E.paired_draws(df, 4, "s", ["id"], ["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan
