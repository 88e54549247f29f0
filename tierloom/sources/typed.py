"""Earlier output read back with its types, whatever it was written as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from ..functions.text import strip

# The words that say yes in a text column.
TRUE_WORDS = ("true", "1", "yes")


def typed(frame: DataFrame, schema: StructType | str, misfit: str = "misfit") -> DataFrame:
    """A frame in a declared schema, with a map of the texts that did not fit by column; other columns come after.

    Columns that lack are null (text: empty). Text that holds no value of its type is null and told in the map; blanks are
    no values and are not told. Booleans are true for true, 1 and yes in any case and else false, as text has them. Names
    are compared without regard to case, blanks and a byte order mark.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    plain = lambda n: n.lstrip("﻿").strip().lower()
    have = {plain(f.name): f for f in frame.schema.fields}
    columns: list[Column] = []
    misfits: list[Column] = []
    for field in schema.fields:
        found = have.pop(plain(field.name), None)
        if found is None:
            columns.append(F.lit("" if isinstance(field.dataType, StringType) else None).cast(field.dataType).alias(field.name))
            continue
        value = F.col(f"`{found.name}`")
        if isinstance(field.dataType, StringType):
            columns.append(F.coalesce(value.cast("string"), F.lit("")).alias(field.name))
        elif not isinstance(found.dataType, StringType):
            columns.append(value.try_cast(field.dataType).alias(field.name))
        else:
            text = strip(value)
            cast = F.lower(text).isin(*TRUE_WORDS) if isinstance(field.dataType, BooleanType) else F.nullif(text, F.lit("")).try_cast(field.dataType)
            columns.append(cast.alias(field.name))
            misfits.append(F.when((text != "") & cast.isNull(), F.struct(F.lit(field.name).alias("key"), value.alias("value"))))
    told = F.map_from_entries(F.array_compact(F.array(*misfits))) if misfits else F.create_map().cast("map<string,string>")
    return frame.select(*columns, *[F.col(f"`{f.name}`") for f in have.values()], told.alias(misfit))


def load_typed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tables below a path as Parquet, or as CSV where the path ends so or holds such files, in a declared schema."""
    if path.lower().rstrip("/").endswith((".csv", ".csv.gz")):
        options = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}
        return typed(spark.read.options(**options).csv(path), schema)
    return typed(spark.read.parquet(path), schema)
