"""Queries of numbers, names, typed loads and masks, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, numbering, order_stats
from ..sources import typed as ty
from .adapters import read


def numbered_documents(spark, sf_dir):
    """Documents by language and id, numbered from 1 without a gap."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return numbering.dense_numbers(d, ["lang", "doc_id"])


def free_annotation_ids(spark, sf_dir):
    """Orders of a customer ask for the ids after those that the customer's line items stand for."""
    asked = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("n"))
    taken = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.concat(F.when(F.col("c_custkey") % 3 == 0, "pa").otherwise("x"), (F.col("c_custkey") % 50).cast("string")).alias("id"))
    return numbering.free_ids(asked, taken, "doc", ["n"])


def unique_tier_names(spark, sf_dir):
    """Events of a user ask for a tier of their type; some types have one already."""
    asked = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("k"), F.col("event_type").alias("name"))
    taken = asked.select("doc").distinct().where("doc % 2 = 0").select("doc", F.explode(F.array(F.lit("click"), F.lit("view_3"))).alias("name"))
    return numbering.unique_names(asked, taken, "doc", "k", "name").select("k", "unique_name")


def typed_orders(spark, sf_dir):
    """Orders as text, some of it broken, in their types again."""
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = o.select(key.cast("string").alias("Key"), F.when(key % 7 == 0, "n/a").when(key % 11 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("cust"), F.element_at(F.array(*map(F.lit, ("True", "1", "no", "YES", ""))), (key % 5 + 1).cast("int")).alias("done"))
    found = ty.typed(text, "key long, cust int, done boolean, missing string")
    return found.select("key", "cust", "done", "missing", F.coalesce(F.try_element_at("misfit", F.lit("cust")), F.lit("")).alias("misfit_cust"))


def masked_points(spark, sf_dir):
    """Points of each vector on a mask whose rows are runs that its label shifts."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((F.col("embedding")[2 * i].cast("double") * 2 + 0.5).alias("x"), (F.col("embedding")[2 * i + 1].cast("double") * 2 + 0.5).alias("y")))
    points = e.select("vec_id", F.explode(pairs).alias("p")).select("vec_id", "p.x", "p.y", F.lit(64).alias("width"), F.lit(48).alias("height"))
    rows = e.select("vec_id", F.col("label").cast("int").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(47), F.lit(2))).alias("row"))
    runs = rows.select("vec_id", F.col("row").cast("int").alias("row"), F.explode(F.array(F.struct((F.col("label") % 8).alias("first"), (F.col("label") % 8 + 20).alias("last")), F.struct(F.lit(40).alias("first"), F.lit(60).alias("last")))).alias("r")).select("vec_id", "row", "r.*")
    return geometry.on_target(points, runs, ["vec_id"], min_fraction=0.25)


def exact_percentiles(spark, sf_dir):
    """Percentiles of a continuous value by flag and status, without a buffer of a group's values."""
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    found = order_stats.percentiles(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.05, 0.5, 0.95])
    return found.select("l_returnflag", "l_linestatus", *[F.floor(F.col("percentiles")[i] * 1e4 + 0.5).alias(f"p{p}_e4") for i, p in enumerate((5, 50, 95))])


QUERIES = {f.__name__: f for f in (exact_percentiles, numbered_documents, free_annotation_ids, unique_tier_names, typed_orders, masked_points)}

ORACLE_SQL = {
    "exact_percentiles": f"""SELECT l_returnflag, l_linestatus, {", ".join(f"CAST(floor(quantile_cont(CAST(l_extendedprice AS DOUBLE), {p / 100}) * 1e4 + 0.5) AS BIGINT) AS p{p}_e4" for p in (5, 50, 95))} FROM lineitem GROUP BY ALL""",
    "numbered_documents": "SELECT doc_id, lang, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST) AS number FROM documents",
    "free_annotation_ids": """SELECT o_custkey AS doc, o_orderkey AS n, 'pa' || (coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 END, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS id
      FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "unique_tier_names": """WITH a AS (SELECT event_id AS k, user_id AS doc, event_type AS name, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events),
      b AS (SELECT *, i + CASE WHEN doc % 2 = 0 AND name = 'click' THEN 1 WHEN doc % 2 = 0 AND name = 'view' AND i >= 3 THEN 1 ELSE 0 END AS number FROM a)
      SELECT k, name || CASE WHEN number = 1 THEN '' ELSE '_' || number END AS unique_name FROM b""",
    "typed_orders": """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(o_custkey AS INTEGER) END AS cust, o_orderkey % 5 IN (0, 1, 3) AS done, '' AS missing,
      CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE '' END AS misfit_cust FROM orders""",
    "masked_points": """WITH p AS (SELECT vec_id, CAST(label AS INTEGER) AS label, greatest(0, least(63, CAST(round_even((CAST(embedding[2 * i + 1] AS DOUBLE) * 2 + 0.5e0) * 64, 0) AS INTEGER))) AS x,
        greatest(0, least(47, CAST(round_even((CAST(embedding[2 * i + 2] AS DOUBLE) * 2 + 0.5e0) * 48, 0) AS INTEGER))) AS y FROM embeddings, (SELECT unnest(range(0, 32)) AS i)),
      h AS (SELECT vec_id, y % 2 = 0 AND (x BETWEEN label % 8 AND label % 8 + 20 OR x BETWEEN 40 AND 60) AS hit FROM p)
      SELECT vec_id, count(*) AS n_points, count(*) FILTER (WHERE hit) / count(*)::DOUBLE AS inside, count(*) FILTER (WHERE hit) / count(*)::DOUBLE >= 0.25 AS on_target FROM h GROUP BY vec_id""",
}
