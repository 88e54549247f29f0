"""Numbers and names that are unique: dense numbers over a whole table, free numbers of documents, names with suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relations import _cut


def dense_numbers(rows: DataFrame, order: list[str], column: str = "number", start: int = 1) -> DataFrame:
    """Rows with their place in an order, from ``start`` on without gaps.

    Rows are dealt by ranges of the order and sorted within them; a row's number is its place there and the sum of the
    ranges before, of which there is one row for each partition. Rows of equal order columns are numbered one after
    another in any order; a null stands first.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = _cut(placed.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(column, F.col("__before") + F.col("__at") + F.lit(start)).drop("__part", "__at", "__before")


def free_ids(requests: DataFrame, taken: DataFrame, scope: str, order: list[str], prefix: str = "pa", column: str = "id") -> DataFrame:
    """Requests with the next ids of their scope: the prefix and a number above every number that the scope has taken.

    taken has the scope and id; ids of other forms do not count. A scope is a document and bounded.
    """
    number = F.regexp_extract(F.col("id"), f"^{prefix}([0-9]+)$", 1)
    highest = taken.where(number != "").groupBy(F.col(scope).alias("__scope")).agg(F.max(number.cast("long")).alias("__highest"))
    place = F.row_number().over(Window.partitionBy(scope).orderBy(*order))
    joined = requests.join(highest, F.col(scope).eqNullSafe(F.col("__scope")), "left")
    return joined.withColumn(column, F.concat(F.lit(prefix), (F.coalesce("__highest", F.lit(0)) + place).cast("string"))).drop("__scope", "__highest")


def unique_names(requests: DataFrame, taken: DataFrame, scope: str, key: str, name: str, column: str = "unique_name") -> DataFrame:
    """Requests with a name of their own: the wanted one where it is free in its scope, else with the next free suffix _2, _3 ...

    requests have scope, key (unique, their order) and name; taken has scope and name. All requests for one name are served
    in one round, in the order of their keys; only where a suffixed name is another's wish do rounds repeat, and the smaller
    key has it.
    """
    held = _cut(taken.select(F.col(scope).alias("__scope"), F.col(name).alias("__name")).distinct())
    open_ = _cut(requests.select(F.col(scope).alias("__scope"), F.col(key).alias("__key"), F.col(name).alias("__wish")))
    served = None
    while True:
        wishes = open_.groupBy("__scope", "__wish").agg(F.count("*").alias("__n"))
        # As many numbers as there are requests and names of that form: so many are free at least.
        forms = held.select("__scope", F.regexp_replace("__name", "_[0-9]+$", "").alias("__wish"), "__name").unionByName(held.select("__scope", F.col("__name").alias("__wish"), "__name")).distinct()
        used = forms.groupBy("__scope", "__wish").agg(F.count("*").alias("__used"))
        asked = wishes.join(used, ["__scope", "__wish"], "left").select("__scope", "__wish", F.explode(F.sequence(F.lit(1), (F.col("__n") + F.coalesce("__used", F.lit(0))).cast("int"))).alias("__number"))
        named = asked.withColumn("__name", F.when(F.col("__number") == 1, F.col("__wish")).otherwise(F.concat("__wish", F.lit("_"), F.col("__number").cast("string"))))
        free = named.join(held, ["__scope", "__name"], "left_anti").withColumn("__place", F.row_number().over(Window.partitionBy("__scope", "__wish").orderBy("__number")))
        placed = open_.withColumn("__place", F.row_number().over(Window.partitionBy("__scope", "__wish").orderBy("__key")))
        offers = placed.join(free, ["__scope", "__wish", "__place"]).select("__scope", "__key", "__wish", "__name")
        winner = F.row_number().over(Window.partitionBy("__scope", "__name").orderBy("__key"))
        ranked = _cut(offers.withColumn("__rank", winner))
        won = ranked.where("__rank = 1").select("__scope", "__key", "__name")
        served = won if served is None else served.unionByName(won)
        open_ = _cut(ranked.where("__rank > 1").select("__scope", "__key", "__wish"))
        if open_.isEmpty():
            break
        held = _cut(held.unionByName(won.select("__scope", "__name")))
    names = served.select(F.col("__key").alias(key), F.col("__name").alias(column))
    return requests.join(names, key)
