"""The driver's tables seen as annotation tables, once for Spark and once as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that a task cuts into words, about.
TASK_BYTES = 32_000_000


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as lexical items, dealt to all cores."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # By recording, so that its words are counted where they are; about 32 MB of text a task, however much there is.
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    d = d.withColumn("doc_id", F.col("doc_id").cast("string")).repartition(parts, "doc_id")
    return tokens_of(d)


def tokens_of(documents: DataFrame) -> DataFrame:
    """One row per space-separated word: the source is who speaks, the language where, the document the recording."""
    word = F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), " ")).alias("lexical_item")
    rows = documents.select(F.col("doc_id").cast("string").alias("source_file"), F.col("source").alias("speaker_id"), F.col("lang").alias("region_code"), word).where("lexical_item <> ''")
    return rows.select("*", F.col("lexical_item").alias("annotation"), F.lit("").alias("compound"), F.lit("").alias("ambiguous"))


TOKENS = """tokens AS (
  SELECT source_file, speaker_id, region_code, lexical_item FROM (
    SELECT CAST(doc_id AS VARCHAR) AS source_file, source AS speaker_id, lang AS region_code,
      unnest(string_split(lower(coalesce(text, '')), ' ')) AS lexical_item FROM documents)
  WHERE lexical_item <> '')"""

# The predicates that stand for markers in lineitem.
MARKER_RULES = {
    "pt": "l_returnflag = 'R'",
    "cl": "l_returnflag = 'A'",
    "m": "l_discount > 0.05",
    "rep": "l_quantity > 40",
    "nmm": "l_tax > 0.06",
    "qm": "l_linestatus = 'F'",
    "d": "l_quantity = 13 AND l_tax = 0.0",
}


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as annotations with markers; the order's customer's nation gives the region."""
    line, orders, customer, nation = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    # Orders get their place first, so that lines, the largest table by far, are dealt for one join only.
    placed = orders.select("o_orderkey", "o_custkey").join(places, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_regionkey")
    rows = line.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    text = lambda c: F.col(c).cast("string")
    flag = lambda rule: F.when(F.expr(rule), "1").otherwise("")
    return rows.select(
        text("l_orderkey").alias("source_file"), text("l_suppkey").alias("speaker_id"), text("n_regionkey").alias("region_code"),
        F.concat(text("l_partkey"), F.lit("/"), F.col("l_returnflag")).alias("annotation"), F.when(F.col("l_linenumber") == 6, "").otherwise(text("l_partkey")).alias("lexical_item"),
        flag("month(l_shipdate) = 1").alias("compound"), flag("l_linenumber = 7").alias("ambiguous"),
        *[flag(rule).alias(k) for k, rule in MARKER_RULES.items()],
        start.cast("string").alias("time_start"), (start + F.col("l_quantity").cast("long") * 100).cast("string").alias("time_end"), "l_linenumber",
    )


_FLAGGED = ", ".join(f"CASE WHEN {rule} THEN '1' ELSE '' END AS {k}" for k, rule in MARKER_RULES.items())
_N_KEYS = " + ".join(f"CAST({rule} AS INT)" for rule in MARKER_RULES.values())
MARKED = f"""marked AS (
  SELECT *, NOT is_compound AND NOT is_ambiguous AS is_parsed, is_ok AND has_lexical AND n_keys = 0 AS lexical_only, is_ok AND has_lexical AND n_keys > 0 AS lexical_with_key,
    is_ok AND NOT has_lexical AND n_keys > 0 AS key_only, is_ok AND NOT has_lexical AND n_keys = 0 AS empty_row FROM (
  SELECT *, NOT is_compound AND NOT is_ambiguous AS is_ok FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS source_file, CAST(l_suppkey AS VARCHAR) AS speaker_id, CAST(n_regionkey AS VARCHAR) AS region_code,
    CAST(l_partkey AS VARCHAR) || '/' || l_returnflag AS annotation, CASE WHEN l_linenumber = 6 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS lexical_item,
    month(l_shipdate) = 1 AS is_compound, l_linenumber = 7 AS is_ambiguous, l_linenumber <> 6 AS has_lexical,
    {_FLAGGED}, CAST({_N_KEYS} AS BIGINT) AS n_keys, l_quantity = 13 AND l_tax = 0.0 AS has_blocking_key,
    epoch_ms(l_shipdate) AS start_ms, epoch_ms(l_shipdate) + CAST(l_quantity AS BIGINT) * 100 AS end_ms, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)))"""

# What an event type stands for among mouth categories.
CATEGORIES = {"click": "Mouthing", "view": "Mouthing", "purchase": "MouthGesture", "signup": "MouthGesture"}


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as labelled intervals on tiers; a day is one recording."""
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    category = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("annotation_id"), F.date_format("ts", "yyyy-MM-dd").alias("file_key"), F.col("event_type").alias("tier_id"), F.col("user_id").cast("string").alias("speaker_id"), (F.col("user_id") % 7).cast("string").alias("region_code"),
        start.alias("start_ms"), (start + F.floor(F.col("value") * 1000).cast("long")).alias("end_ms"), F.coalesce(F.try_element_at(category, "event_type"), F.lit("Others")).alias("category"),
    )


INTERVALS = """intervals AS (
  SELECT event_id AS annotation_id, strftime(ts, '%Y-%m-%d') AS file_key, event_type AS tier_id, CAST(user_id AS VARCHAR) AS speaker_id,
    CAST(user_id % 7 AS VARCHAR) AS region_code, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) AS end_ms,
    CASE WHEN event_type IN ('click', 'view') THEN 'Mouthing' WHEN event_type IN ('purchase', 'signup') THEN 'MouthGesture' ELSE 'Others' END AS category
  FROM events)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as clips of a hand role with a count of regions used."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("clip_id"), F.col("event_type").alias("keyword"), F.col("user_id").cast("string").alias("signer_id"), F.concat(F.lit("R"), (F.col("user_id") % 7).cast("string")).alias("region_code"),
        F.when(F.col("user_id") % 10 == 0, "left").otherwise("right").alias("handedness"), (F.lit(20) + F.col("user_id") % 60).cast("long").alias("age"), F.when(F.col("user_id") % 2 == 0, "female").otherwise("male").alias("gender"),
        F.when(F.col("event_id") % 2 == 0, "dominant").otherwise("non_dominant").alias("hand_role"), (F.floor("value").cast("long") % 9).alias("regions_used"), (F.col("event_id") % 5 != 0).alias("hand_present"),
    )


CLIPS = """clips AS (
  SELECT event_id AS clip_id, event_type AS keyword, CAST(user_id AS VARCHAR) AS signer_id, 'R' || CAST(user_id % 7 AS VARCHAR) AS region_code,
    CASE WHEN user_id % 10 = 0 THEN 'left' ELSE 'right' END AS handedness, CAST(20 + user_id % 60 AS BIGINT) AS age,
    CASE WHEN user_id % 2 = 0 THEN 'female' ELSE 'male' END AS gender, CASE WHEN event_id % 2 = 0 THEN 'dominant' ELSE 'non_dominant' END AS hand_role,
    CAST(floor(value) AS BIGINT) % 9 AS regions_used, event_id % 5 <> 0 AS hand_present FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as normalised points: 32 pairs scaled to reach every zone."""
    e = read(spark, sf_dir, "embeddings")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("point"), (F.col("embedding")[2 * i].cast("double") * 6.0).alias("x"), (F.col("embedding")[2 * i + 1].cast("double") * 6.0).alias("y")))
    return e.select(F.col("vec_id").alias("clip_id"), F.col("label").cast("string").alias("keyword"), F.explode(pairs).alias("p")).select("clip_id", "keyword", "p.*")


POINTS = """points AS (
  SELECT vec_id AS clip_id, CAST(label AS VARCHAR) AS keyword, i AS point, CAST(embedding[2 * i + 1] AS DOUBLE) * 6e0 AS x, CAST(embedding[2 * i + 2] AS DOUBLE) * 6e0 AS y
  FROM embeddings, (SELECT unnest(range(0, 32)) AS i))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a value series per user, missing where the event is an error."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), F.row_number().over(_by_user()).alias("frame"), F.when(F.col("event_type") != "error", F.floor(F.col("value") * 8)).alias("value"))


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


SERIES = """series AS (
  SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame,
    CASE WHEN event_type <> 'error' THEN CAST(floor(value * 8) AS BIGINT) END AS value FROM events)"""
