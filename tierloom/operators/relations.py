"""Joins, recursion, set operations and audit rules over annotation documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip_key, signer_key
from ..scratch import shared_dir


def _cut(df: DataFrame) -> DataFrame:
    """Materialised below spark.checkpoint.dir; without it an error, but in local mode, where all share a disk."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def inherited_times(annotations: DataFrame) -> DataFrame:
    """Times of annotations that refer to others, by pointer doubling.

    Annotations have doc, id, ref (null for own times), start_ms and end_ms. Every round follows each
    pending reference twice as far, so a chain of length n takes log2 n equi-joins. What is still pending
    when the rounds exceed log2 of the pending rows runs in a circle, or into one, and gets null.
    """
    state = _cut(annotations.select("doc", "id", F.when(F.col("start_ms").isNull(), F.col("ref")).alias("next"), "start_ms", "end_ms"))
    waiting = state.where("start_ms IS NULL AND next IS NOT NULL")
    for _ in range(waiting.count().bit_length()):
        other = state.select(F.col("doc").alias("o_doc"), F.col("id").alias("o_id"), F.col("next").alias("o_next"), F.col("start_ms").alias("o_start"), F.col("end_ms").alias("o_end"))
        joined = state.join(other, (F.col("doc") == F.col("o_doc")) & (F.col("next") == F.col("o_id")), "left")
        pending = F.col("start_ms").isNull()
        state = _cut(joined.select("doc", "id", F.when(pending & F.col("o_start").isNull(), F.col("o_next")).alias("next"), F.coalesce("start_ms", "o_start").alias("start_ms"), F.coalesce("end_ms", "o_end").alias("end_ms")))
        if state.where("start_ms IS NULL AND next IS NOT NULL").isEmpty():
            break
    return state.select("doc", "id", "start_ms", "end_ms")


def tier_closure(tiers: DataFrame, seed: Column) -> DataFrame:
    """Tiers that meet a condition, and all below them; tiers have doc, tier_id and parent.

    Each round looks below the tiers that the last one added, until it adds none.
    """
    found = added = _cut(tiers.where(seed).select("doc", "tier_id").distinct())
    links = _cut(tiers.select("doc", "tier_id", "parent"))
    while not added.isEmpty():
        above = added.select("doc", F.col("tier_id").alias("parent"))
        below = links.join(above, ["doc", "parent"], "left_semi").select("doc", "tier_id").distinct()
        added = _cut(below.join(found, ["doc", "tier_id"], "left_anti"))
        found = _cut(found.union(added))
    return found


def broken_references(annotations: DataFrame) -> DataFrame:
    """Annotations whose reference no annotation of the document has."""
    known = annotations.select("doc", F.col("id").alias("ref"))
    return annotations.where("ref IS NOT NULL").join(known, ["doc", "ref"], "left_anti").select("doc", "id", "ref")


def broken_parents(tiers: DataFrame) -> DataFrame:
    """Tiers whose parent the document does not have; tiers have doc, tier_id and parent."""
    known = tiers.select("doc", F.col("tier_id").alias("parent")).distinct()
    return tiers.where(F.col("parent").isNotNull() & (F.col("parent") != "")).join(known, ["doc", "parent"], "left_anti").select("doc", "tier_id", "parent")


def match_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys both sides have, and how many one side alone."""
    both = left.select(key).distinct().withColumn("l", F.lit(True)).join(right.select(key).distinct().withColumn("r", F.lit(True)), key, "full_outer")
    side = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), "matched").when(F.col("l").isNotNull(), "left_only").otherwise("right_only")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def match_signers(names: DataFrame, roster: DataFrame) -> DataFrame:
    """The roster entry of each name: equal key, equal without underscores, or the longest leading part.

    names has name; roster has signer_id. A leading part ends at an underscore, or anywhere but inside a
    number. Every leading part of a name that is as long as some entry is a key of its own, so the join is on the whole entry.
    """
    compact = lambda c: F.replace(c, F.lit("_"), F.lit(""))
    n = names.select("name", signer_key(F.col("name")).alias("key")).withColumn("ck", compact(F.col("key")))
    r = roster.select("signer_id", signer_key(F.col("signer_id")).alias("rk")).withColumn("rck", compact(F.col("rk"))).where("rck <> ''")
    lengths = r.agg(F.collect_set(F.length("rck")).alias("lengths"))  # one row of as many numbers as entries have lengths
    parts = F.explode(F.transform(F.filter("lengths", lambda x: x <= F.length("ck")), lambda x: F.substr(F.col("ck"), F.lit(1), x)))
    pairs = n.crossJoin(F.broadcast(lengths)).select("name", "key", "ck", parts.alias("part")).join(r, F.col("part") == F.col("rck"))
    after = F.substr(F.col("ck"), F.length("rck") + 1, F.lit(1))
    guard = ~(F.substr(F.col("rck"), F.length("rck"), F.lit(1)).rlike("[0-9]") & after.rlike("[0-9]"))
    tier = F.when(F.col("key") == F.col("rk"), 0).when(F.col("ck") == F.col("rck"), 1).when(F.col("key").startswith(F.concat("rk", F.lit("_"))) | (F.col("ck").startswith(F.col("rck")) & guard), 2)
    best = pairs.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("name").agg(F.min_by("signer_id", F.struct("tier", -F.length("rck"), "signer_id")).alias("signer_id"), F.min("tier").alias("tier"))
    return names.select("name").distinct().join(best, "name", "left")


def excluded(clips: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """Clips with the first exclusion entry that covers them: the whole, its end, its start or a folder in it.

    entries has entry and number. An entry covers a path where it stands between slashes, so every run of a
    path's parts is a candidate and the match is an equi-join.
    """
    parts = F.split(clip_key(F.col(column)), "/")
    runs = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(F.sequence(i, F.size(parts)), lambda j: F.array_join(F.slice(parts, i, j - i + 1), "/")))))
    keyed = entries.select(clip_key(F.col("entry")).alias("run"), "number").where("run <> ''").groupBy("run").agg(F.min("number").alias("number"))
    hits = clips.select(column, runs.alias("run")).join(keyed, "run").groupBy(column).agg(F.min("number").alias("number"))
    return clips.join(hits, column, "left")


def carry_down(rows: DataFrame, column: str, block: str, order: str) -> DataFrame:
    """Blanks take the last value above them within a block."""
    w = Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(F.nullif(F.col(column), F.lit("")), True).over(w))


def fullest_tier(tiers: DataFrame) -> DataFrame:
    """One tier per document and signer: most annotations, then the greater id; empty tiers go."""
    return tiers.where("n > 0").groupBy("doc", "signer").agg(F.max_by("tier_id", F.struct("n", "tier_id")).alias("tier_id"), F.max("n").alias("n"), (F.count("*") - 1).alias("dropped"))


def merge_cells(values: DataFrame) -> DataFrame:
    """Distinct values of a parent and column in their order, joined with a bar; values has parent, column, ordinal, value."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"])
    return values.where("value <> ''").groupBy("parent", "column").agg(F.array_join(F.array_distinct(ordered), " | ").alias("cell"))


def copies(files: DataFrame, recording: str, path: str) -> DataFrame:
    """Files of recordings that exist more than once."""
    n = F.count("*").over(Window.partitionBy(recording))
    return files.select(recording, path).withColumn("copies", n).where("copies > 1")


def spellings(tiers: DataFrame) -> DataFrame:
    """Signers whose labels are spelt in several ways, with a stable number for each label."""
    labels = tiers.groupBy("signer", "label").agg(F.count("*").alias("n_tiers"), F.count_distinct("doc").alias("n_files"))
    w = Window.partitionBy("signer")
    return labels.withColumns({"n_spellings": F.count("*").over(w), "label_number": F.dense_rank().over(w.orderBy("label")).cast("long")}).where("n_spellings > 1")


def findings(*rules: tuple[str, DataFrame]) -> DataFrame:
    """Findings of several rules (doc, detail) in one table with the name of the problem."""
    out = None
    for problem, frame in rules:
        part = frame.select("doc", F.lit(problem).alias("problem"), "detail")
        out = part if out is None else out.unionByName(part)
    return out


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Changed cells of two tables: key, column, old and new value; nulls compare as equal."""
    a = old.select(key, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("column", "old"))
    b = new.select(key, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("column", "new"))
    return a.join(b, [key, "column"]).where(~F.col("old").eqNullSafe(F.col("new")))
