"""Exact order statistics of groups of any size.

Values are first counted, so a repeated value is one row. Then every wanted rank is located by halving, many parts at a time:
a group's range is cut into buckets of equal width, the counts of the buckets tell which one holds the rank, and only that
bucket's values go on to the next round, until it holds one value. No task sees the values of a group, and a round sends
one row for each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relations import _cut

#: Buckets of a range in each round.
BUCKETS = 1024


def _same(keys: Sequence[str], left: str, right: str):
    """Equality of all keys of two aliased frames, nulls included."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def values_at_ranks(counted: DataFrame, ranks: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(keys, rank, value): the value at each rank (from 0) of each group.

    counted has the keys, v (double, one row for each value) and c (how often); ranks has the keys and rank, each once.
    """
    keys = list(keys)
    bounds = counted.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    open_ = _cut(ranks.alias("r").join(bounds.alias("b"), _same(keys, "r", "b")).select(*[F.col(f"r.{k}").alias(k) for k in keys], "rank", "low", "high", F.lit(0).cast("long").alias("before")))
    done = open_.where("low = high").select(*keys, "rank", F.col("low").alias("value"))
    open_ = open_.where("low < high")
    while not open_.isEmpty():
        ranges = open_.select(*keys, "low", "high").distinct()
        held = counted.alias("c").join(ranges.alias("g"), _same(keys, "c", "g") & (F.col("c.v") >= F.col("g.low")) & (F.col("c.v") <= F.col("g.high")))
        place = F.least(F.lit(buckets - 1), F.floor((F.col("c.v") - F.col("g.low")) / (F.col("g.high") - F.col("g.low")) * buckets))
        parts = held.groupBy(*[F.col(f"c.{k}").alias(k) for k in keys], "low", "high", place.alias("bucket")).agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        order = Window.partitionBy(*keys, "low", "high").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("earlier", F.coalesce(F.sum("n").over(order), F.lit(0)))
        inside = (F.col("o.rank") >= F.col("o.before") + F.col("p.earlier")) & (F.col("o.rank") < F.col("o.before") + F.col("p.earlier") + F.col("p.n"))
        met = open_.alias("o").join(parts.alias("p"), _same([*keys, "low", "high"], "o", "p") & inside)
        found = _cut(met.select(*[F.col(f"o.{k}").alias(k) for k in keys], "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("before") + F.col("earlier")).alias("before")))
        done = done.unionByName(found.where("low = high").select(*keys, "rank", F.col("low").alias("value")))
        open_ = found.where("low < high")
    return done


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], column: str = "percentiles", buckets: int = BUCKETS) -> DataFrame:
    """The keys and an array of exact, linearly interpolated percentiles, in the order of the shares (0 to 1).

    Nulls, NaN and infinite values are no values; groups without a value have no row.
    """
    keys = list(keys)
    finite = rows.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & (F.abs("v") < float("inf")) & ~F.isnan("v"))
    counted = _cut(finite.groupBy(*keys, "v").agg(F.count("*").alias("c")))
    sizes = counted.groupBy(*keys).agg(F.sum("c").alias("n"))
    wanted = sizes.select(*keys, F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("i", "share"), "n").withColumn("at", F.col("share") * (F.col("n") - 1))
    wanted = wanted.withColumns({"down": F.floor("at"), "up": F.ceil("at")})
    ranks = wanted.select(*keys, F.explode(F.array("down", "up")).alias("rank")).distinct()
    values = values_at_ranks(counted, ranks, keys, buckets)
    low = wanted.alias("w").join(values.alias("v"), _same(keys, "w", "v") & (F.col("w.down") == F.col("v.rank"))).select("w.*", F.col("v.value").alias("first"))
    both = low.alias("w").join(values.alias("v"), _same(keys, "w", "v") & (F.col("w.up") == F.col("v.rank"))).select("w.*", F.col("v.value").alias("second"))
    between = F.when(F.col("first") == F.col("second"), F.col("first")).otherwise((F.col("up") - F.col("at")) * F.col("first") + (F.col("at") - F.col("down")) * F.col("second"))
    told = both.select(*keys, F.struct("i", between.alias("p")).alias("s"))
    return told.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["p"]).alias(column))
