"""Text functions on values that the test tables rarely have."""

from pyspark.sql import functions as F

from colloquy.functions import text as T


def test_hundredths_round_as_printf(spark):
    values = [i / 1000 for i in range(1001)] + [i / 10**6 for i in range(4990, 5011)] + [0.1449995, 0.145, 2**-40]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.hundredths(F.col("v")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["%.2f" % r["v"] for r in rows]
