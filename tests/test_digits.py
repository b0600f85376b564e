"""Ten significant digits against the C library's own."""

import random
import struct

from pyspark.sql import functions as F

from statloom.functions.scalars import significant


def test_ten_digits(spark):
    draw = random.Random(9)
    values = [0.0, -0.0, 1.0, -1.5, 1e10, 9999999999.5, 99999999995.0, 9999999999.49, 1e-4, 9.99999999995e-5, 1e-5, 123456789.0, 1234567890.5, 1234567891.5, 12345678.125, 12345678.375, 0.12345678905, 0.12345678915, 1e22, 1e300, 2.5, 1e23, 100.0, 0.1, float("inf"), float("-inf"), float("nan")]
    values += [draw.uniform(-1, 1) * 10 ** draw.randint(-14, 20) for _ in range(3000)]
    values += [(10**10 + draw.randrange(9 * 10**10)) * 10 + 5 for _ in range(500)]  # whole numbers: no ties
    values += [float(f"{draw.randrange(10**9, 10**10)}5e{draw.randint(-18, 9)}") for _ in range(4000)]  # ties of the text, most of them none of the double
    values += [draw.randrange(10**9, 10**10) + 0.5 for _ in range(500)] + [draw.randrange(10**7, 10**8) + draw.choice([0.125, 0.375, 0.625, 0.875]) for _ in range(500)]  # exact ties
    values += [struct.unpack("<d", struct.pack("<Q", draw.getrandbits(64)))[0] for _ in range(2000)]
    values = [float(v) for v in values if not 0 < abs(v) < 2.3e-308]
    df = spark.createDataFrame([*enumerate(values), (-1, None)], "k int, v double")
    got = {r["k"]: r["s"] for r in df.select("k", significant(F.col("v")).alias("s")).collect()}
    assert got[-1] is None
    wrong = [(v, got[k], "%.10g" % v) for k, v in enumerate(values) if got[k] != "%.10g" % v]
    assert wrong == []
    few = {r["v"]: r["s"] for r in df.where("k between 28 and 400").select("v", significant(F.col("v"), 4).alias("s")).collect()}
    assert all(s == "%.4g" % v for v, s in few.items())
