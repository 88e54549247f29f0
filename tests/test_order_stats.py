"""Order statistics against NumPy and against Spark's own percentile."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierloom.operators import order_stats

SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("buckets", [32, 1024])
def test_percentiles_of_any_spread(spark, buckets):
    r = random.Random(6)
    groups = {"even": [i / 8 for i in range(300)], "same": [4.5] * 50, "one": [-3.0], "two": [1.0, 1.0 + 2**-40], "wide": [10.0 ** r.randint(-9, 12) for _ in range(99)], "skewed": [0.0] * 400 + [r.random() for _ in range(30)], None: [r.gauss(0, 5) for _ in range(77)], "none": [None]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("even", None), ("even", float("nan")), ("even", float("inf"))]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {x["g"]: x["percentiles"] for x in order_stats.percentiles(frame, ["g"], "x", SHARES, buckets=buckets).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, values in got.items():
        assert values == pytest.approx(np.percentile(groups[g], [100 * s for s in SHARES]).tolist(), rel=1e-12)


def test_equal_to_the_buffered_percentile(spark):
    frame = spark.range(2000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 7).alias("b"), (F.hash("id") % 1000).alias("x"))
    want = {(r["a"], r["b"]): r["p"] for r in frame.groupBy("a", "b").agg(F.percentile("x", F.array(*map(F.lit, SHARES))).alias("p")).collect()}
    assert {(r["a"], r["b"]): r["percentiles"] for r in order_stats.percentiles(frame, ["a", "b"], "x", SHARES).collect()} == want
    assert order_stats.percentiles(frame.where("false"), ["a"], "x", [0.5]).count() == 0
