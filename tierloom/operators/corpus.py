"""Corpus statistics: flags, summaries, vocabularies, coverage and readiness.

Every function takes and returns DataFrames. An annotation table has the columns source_file,
speaker_id, region_code, annotation, lexical_item, compound, ambiguous, the marker columns, and
time_start and time_end in milliseconds; all but the times are text, blank where there is no value.
Per-region tables come from grouping sets, not from repeated passes. Percentages are not rounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nonempty

# Marker columns in the order of the parser, the blocking ones, and the tables' grids.
MARKERS = ("pt", "dw", "fs", "aw", "lh", "rh", "d", "cl", "m", "ges", "nmm", "rep", "stop", "hold", "index", "keep", "fal", "un", "qm", "past", "neg")
BLOCKING = ("d", "fal", "un")
COVERAGE_SPECS = (("Top 100", 100, 5), ("Top 200", 200, 5), ("Top 500", 500, 5), ("Top 900", 900, 3), ("All glosses", 0, 2))
COVERAGE_CUTOFFS = (50, 100, 200, 500, 900, 1000, 2000)
CLASS_SIZES = (1, 20, 50, 100, 200, 500, 900)
SIGNER_FLOORS = (1, 3, 5, 8)
DURATION_PERCENTILES = (5, 25, 50, 75, 95, 99)
OCCURRENCE_CAP = 500
TEST_FRACTION = 0.2
GLOBAL = "GLOBAL"


def percent(part: Column, whole: Column) -> Column:
    """Share in percent; of nothing, 0."""
    return F.lit(100.0) * part / F.greatest(whole, F.lit(1))


def _marker_flags(frame: DataFrame) -> dict[str, Column]:
    return {k: nonempty(F.col(k)) if k in frame.columns else F.lit(False) for k in MARKERS}


def add_flags(annotations: DataFrame) -> DataFrame:
    """The booleans all counts depend on, in one projection."""
    has = _marker_flags(annotations)
    absent = [c for c in ("compound", "ambiguous", "lexical_item") if c not in annotations.columns]
    frame = annotations.withColumns({c: F.lit("") for c in absent}) if absent else annotations
    n_keys = sum((f.cast("int") for f in has.values()), F.lit(0))
    frame = frame.select("*", nonempty(F.col("compound")).alias("is_compound"), nonempty(F.col("ambiguous")).alias("is_ambiguous"), nonempty(F.col("lexical_item")).alias("has_lexical"), n_keys.alias("n_keys"), F.greatest(*[has[k] for k in BLOCKING]).alias("has_blocking_key"))
    frame = frame.withColumns({"is_parsed": ~(F.col("is_compound") | F.col("is_ambiguous")), "has_any_key": F.col("n_keys") > 0})
    parsed, lexical, key = F.col("is_parsed"), F.col("has_lexical"), F.col("has_any_key")
    return frame.withColumns({"lexical_only": parsed & lexical & ~key, "lexical_with_key": parsed & lexical & key, "key_only": parsed & ~lexical & key, "empty_row": parsed & ~lexical & ~key})


def scope(region: str = "region_code") -> Column:
    """Tag of a grouping-set row: the region, or GLOBAL for the whole."""
    return F.when(F.grouping(region) == 1, F.lit(GLOBAL)).otherwise(F.col(region)).alias("tag")


def by_scope(frame: DataFrame, *aggregates: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates for the whole corpus and for every region in one pass."""
    cols = [F.col(k) for k in (*keys, "region_code")]
    sets = [[F.col(k) for k in keys], cols]
    return frame.groupingSets(sets, *cols).agg(scope(), *aggregates).drop("region_code")


def flag_counts(flagged: DataFrame) -> DataFrame:
    """Rows by shape of annotation."""
    shape = F.when(F.col("is_compound"), "compound").when(F.col("is_ambiguous"), "ambiguous").when(F.col("lexical_only"), "lexical_only").when(F.col("lexical_with_key"), "lexical_with_key").when(F.col("key_only"), "key_only").otherwise("empty_row")
    return flagged.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"), F.sum("n_keys").cast("long").alias("n_keys"), F.count_if("has_blocking_key").alias("n_blocking"))


def facts(*kinds: Column) -> Column:
    """A row as one fact a column: its kind, the column's place from 0, and its value; null values are no facts.

    Distinct counts are then counts of cells of (kind, value) after one grouping with slim rows, where several distinct counts in
    one aggregate would copy every row with all aggregates' buffers for each of them.
    """
    known = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(i).cast("tinyint").alias("kind"), c.cast("string").alias("value"))) for i, c in enumerate(kinds)])
    return F.explode(F.array_compact(known))


def summary(flagged: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One row of headline counts for the corpus and for each region.

    ``index`` has region_code and duration_ms, one row per recording.
    """
    parsed, lexical = F.col("is_parsed"), F.col("has_lexical")
    shapes = {"n_parsed": parsed, "n_ambiguous": F.col("is_ambiguous"), "n_compound": F.col("is_compound"), "n_with_lexical": parsed & lexical, "n_lexical_only": F.col("lexical_only"), "n_key_only": F.col("key_only"), "n_lexical_with_key": F.col("lexical_with_key"), "n_empty": F.col("empty_row")}
    bits = {name: 1 << i for i, name in enumerate(shapes)}
    shape = sum((F.when(c, bits[name]).otherwise(0) for name, c in shapes.items()), F.lit(0))
    fact = facts(shape, F.col("source_file"), F.col("speaker_id"), F.when(parsed, F.col("annotation")), F.when(parsed & lexical, F.col("lexical_item")))
    cells = flagged.select("region_code", fact.alias("f")).groupBy("region_code", "f.kind", "f.value").agg(F.count("*").alias("n"))
    kind, n = F.col("kind"), F.col("n")
    rows = {name: F.coalesce(F.sum(F.when((kind == 0) & (F.col("value").try_cast("int").bitwiseAND(bit) != 0), n)), F.lit(0)).alias(name) for name, bit in bits.items()}
    distinct = lambda i, name: F.count_if(kind == i).alias(name)
    counts = [
        distinct(1, "n_files_parsed"), distinct(2, "n_signers"), F.coalesce(F.sum(F.when(kind == 0, n)), F.lit(0)).alias("n_annotations"), rows["n_parsed"], rows["n_ambiguous"], rows["n_compound"],
        distinct(3, "n_unique_annotation_strings"), rows["n_with_lexical"], rows["n_lexical_only"], rows["n_key_only"], rows["n_lexical_with_key"], rows["n_empty"],
        distinct(4, "n_unique_lexical_items"), F.count_if((kind == 4) & (n == 1)).alias("n_lexical_items_occurring_once"),
    ]
    whole = cells.groupBy("kind", "value").agg(F.sum("n").alias("n"))
    out = whole.groupBy(F.lit(GLOBAL).alias("tag")).agg(*counts).unionByName(cells.groupBy(F.col("region_code").alias("tag")).agg(*counts))
    if index is not None:
        out = out.join(by_scope(index, F.count("*").alias("n_files_elan_matched"), F.sum("duration_ms").alias("total_recording_ms")), "tag", "left").na.fill(0, ["n_files_elan_matched", "total_recording_ms"])
        out = out.withColumn("annotations_per_minute", F.when(F.col("total_recording_ms") > 0, F.col("n_annotations") / (F.col("total_recording_ms") / F.lit(60000.0))))
    shares = {"parsed_percent": ("n_parsed", "n_annotations"), "ambiguous_percent": ("n_ambiguous", "n_annotations"), "compound_percent": ("n_compound", "n_annotations"), "lexical_only_percent": ("n_lexical_only", "n_parsed"), "key_only_percent": ("n_key_only", "n_parsed"), "hapax_percent_of_vocabulary": ("n_lexical_items_occurring_once", "n_unique_lexical_items")}
    return out.withColumns({name: percent(F.col(a), F.col(b)) for name, (a, b) in shares.items()})


def key_counts(flagged: DataFrame) -> DataFrame:
    """How often each marker occurs among parsed rows, for the corpus and for each region."""
    parsed = flagged.where("is_parsed")
    present = [k for k in MARKERS if k in flagged.columns]
    marks = F.explode(F.array_compact(F.array(*[F.when(nonempty(F.col(k)), F.struct(F.lit(k).alias("key"), F.col(k).alias("value"))) for k in present])))
    long = parsed.select("region_code", "speaker_id", marks.alias("m")).select("region_code", "speaker_id", "m.key", "m.value")
    counted = by_scope(long, F.count("*").alias("n_annotations"), F.count_distinct("speaker_id").alias("n_signers"), F.count_distinct("value").alias("n_unique_values"), keys=["key"])
    totals = by_scope(parsed, F.count("*").alias("n_total"))
    grid = totals.crossJoin(parsed.sparkSession.createDataFrame([(k, "blocking" if k in BLOCKING else "linguistic") for k in present], "key string, kind string"))
    out = grid.join(counted, ["tag", "key"], "left").na.fill(0)
    return out.select("tag", "key", "kind", "n_annotations", percent(F.col("n_annotations"), F.col("n_total")).alias("percent_of_parsed"), "n_signers", "n_unique_values")


def per_file(flagged: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """One row per source file; ``durations`` (source_file, duration_ms, ordinal) keeps the last of duplicates."""
    # Rows are dealt by recording once; all grouping is by recording and more, so it happens where they are.
    slim = flagged.select("source_file", "region_code", "speaker_id", "is_parsed", "is_ambiguous", "is_compound", F.when(F.col("is_parsed") & F.col("has_lexical"), F.col("lexical_item")).alias("item")).repartition("source_file")
    some = lambda flag: F.count_if((F.col("f.kind") == 0) & F.col(flag))
    cells = slim.select("*", facts(F.lit(""), F.col("speaker_id"), F.col("item")).alias("f")).groupBy("source_file", "f.kind", "f.value").agg(
        F.min("region_code").alias("region_code"), F.count("*").alias("n"), some("is_parsed").alias("n_parsed"), some("is_ambiguous").alias("n_ambiguous"), some("is_compound").alias("n_compound")
    )
    out = cells.groupBy("source_file").agg(
        F.min("region_code").alias("region_code"),
        F.count_if(F.col("kind") == 1).alias("n_signers"),
        F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.lit(0)).alias("n_annotations"),
        F.sum("n_parsed").alias("n_parsed"),
        F.sum("n_ambiguous").alias("n_ambiguous"),
        F.sum("n_compound").alias("n_compound"),
        F.count_if(F.col("kind") == 2).alias("n_unique_lexical_items"),
    )
    out = out.withColumn("ambiguous_percent", percent(F.col("n_ambiguous"), F.col("n_annotations")))
    if durations is not None:
        last = durations.groupBy("source_file").agg(F.max_by("duration_ms", "ordinal").alias("duration_ms"))
        out = out.join(last, "source_file", "left").na.fill(0, ["duration_ms"])
    return out


def _lexical(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col("is_parsed") & F.col("has_lexical"))


def gloss_cells(flagged: DataFrame) -> DataFrame:
    """Occurrences of each lexical item of parsed rows by region, speaker and recording: what every other count is a sum of."""
    return _lexical(flagged).groupBy("region_code", F.col("lexical_item").alias("gloss"), "speaker_id", "source_file").agg(F.count("*").alias("occurrences"))


def gloss_totals(counts: DataFrame, signers: DataFrame) -> DataFrame:
    """One row per scope and lexical item from partial counts.

    counts have region_code, gloss, occurrences and n_files, of recordings that are in one part only; signers have region_code,
    gloss and speaker_id, once or more. Distinct speakers are counted by grouping twice, so nothing is expanded.
    """
    main = by_scope(counts, F.sum("occurrences").alias("occurrences"), F.sum("n_files").alias("n_files"), keys=["gloss"])
    who = by_scope(signers, F.count("*").alias("times"), keys=["gloss", "speaker_id"]).groupBy(F.col("tag").alias("who_tag"), F.col("gloss").alias("who_gloss")).agg(F.count("speaker_id").alias("n_signers"))
    totals = main.groupBy(F.col("tag").alias("all_tag")).agg(F.sum("occurrences").alias("all"))
    joined = main.join(who, (F.col("gloss") == F.col("who_gloss")) & F.col("tag").eqNullSafe(F.col("who_tag")), "left").join(totals, F.col("tag").eqNullSafe(F.col("all_tag")))
    return joined.select("tag", "gloss", "occurrences", "n_files", F.coalesce("n_signers", F.lit(0)).alias("n_signers"), percent(F.col("occurrences"), F.col("all")).alias("percent_of_tokens"))


def top_by_scope(totals: DataFrame, top_n: int = 100, min_signers: int = 2) -> DataFrame:
    """The most frequent glosses of every scope among those with signers enough, with their rank; ties by signers, then gloss.

    totals are those of ``gloss_totals``. Only top_n rows of a scope leave a task, so no task sorts a scope's vocabulary.
    """
    order = Window.partitionBy("tag").orderBy(F.desc("occurrences"), F.desc("n_signers"), "gloss")
    return totals.where(F.col("n_signers") >= min_signers).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def gloss_statistics(flagged: DataFrame, regions: Sequence[str] | None = None) -> DataFrame:
    """One row per lexical item of parsed rows; regions are filtered before anything is counted."""
    rows = flagged.where(F.upper("region_code").isin(*[r.upper() for r in regions])) if regions else flagged
    # A recording's first cell of a gloss counts the recording, so that recordings are summed and no
    # distinct count copies every cell; what is left for each gloss, region and speaker is little.
    first = F.row_number().over(Window.partitionBy("source_file", "gloss").orderBy("region_code", "speaker_id")) == 1
    cells = gloss_cells(rows).withColumn("__file", (first & F.col("source_file").isNotNull()).cast("int"))
    small = cells.groupBy("gloss", "region_code", "speaker_id").agg(F.sum("occurrences").alias("occurrences"), F.sum("__file").alias("n_files"))
    out = small.groupBy("gloss").agg(
        F.sum("occurrences").alias("occurrences"), F.count_distinct("speaker_id").alias("n_signers"), F.sum("n_files").alias("n_files"), F.array_join(F.array_sort(F.collect_set("region_code")), ";").alias("regions"), F.count_distinct("region_code").alias("n_regions")
    )
    return out.withColumn("occurrences_per_signer", F.col("occurrences") / F.col("n_signers"))


def top_glosses(stats: DataFrame, top_n: int = 100, min_signers: int = 2, min_occurrences: int = 1) -> DataFrame:
    """The most frequent glosses among those that clear both floors; 0 keeps all."""
    kept = stats.where((F.col("n_signers") >= min_signers) & (F.col("occurrences") >= min_occurrences))
    order = [F.desc("occurrences"), F.desc("n_signers"), F.asc("gloss")]
    if top_n:
        kept = kept.orderBy(*order).limit(top_n)
        return kept.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ordered_prefix(kept, "occurrences", "gloss", ties=["n_signers"]).drop("before")


def ordered_prefix(frame: DataFrame, count: str, key: str, descending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """``rank`` and the sum of ``count`` ``before`` each row, by count, ties (both descending) and key.

    No task sorts the whole: rows are ranked within (count, ties, key's first three characters), and those
    cells, whose number does not grow with the rows of a cell, are summed in two short windows.
    """
    cell = [count, *ties]
    up = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    frame = frame.withColumn("__prefix", F.substring(F.col(key).cast("string"), 1, 3))
    cells = frame.groupBy(*cell, "__prefix").agg(F.count("*").alias("__n"))
    groups = cells.groupBy(*cell).agg(F.sum("__n").alias("__n"))
    earlier = Window.orderBy(up(count), *[F.desc(t) for t in ties]).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*cell, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__r0"), F.coalesce(F.sum(F.col("__n") * F.col(count)).over(earlier), F.lit(0)).alias("__s0"))
    within = Window.partitionBy(*cell).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*cell, "__prefix", F.coalesce(F.sum("__n").over(within), F.lit(0)).alias("__r1")).join(groups, cell)
    numbered = frame.withColumn("__r2", F.row_number().over(Window.partitionBy(*cell, "__prefix").orderBy(key)))
    joined = numbered.join(offsets, [*cell, "__prefix"])
    place = F.col("__r1") + F.col("__r2")
    return joined.withColumns({"rank": (F.col("__r0") + place).cast("long"), "before": (F.col("__s0") + (place - 1) * F.col(count)).cast("long")}).drop("__prefix", "__r0", "__s0", "__r1", "__r2")


def coverage_table(flagged: DataFrame, specs: Sequence[tuple[str, int, int]] = COVERAGE_SPECS, cap: int = OCCURRENCE_CAP) -> DataFrame:
    """The shape of each candidate vocabulary, for the corpus and for each region."""
    by_speaker = _lexical(flagged).groupBy("region_code", F.col("lexical_item").alias("gloss"), "speaker_id").agg(F.count("*").alias("n"))
    stats = by_scope(by_speaker, F.sum("n").alias("occurrences"), F.count_distinct("speaker_id").alias("n_signers"), keys=["gloss"])
    totals = stats.groupBy("tag").agg(F.sum("occurrences").alias("corpus_tokens"))
    parts = []
    for label, top_n, floor in specs:
        kept = stats.where(F.col("n_signers") >= floor)
        if top_n:
            rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("occurrences"), F.desc("n_signers"), "gloss"))
            kept = kept.withColumn("rank", rank).where(F.col("rank") <= top_n)
        capped = F.least(F.col("occurrences"), F.lit(cap))
        shape = kept.groupBy("tag").agg(
            F.count("*").alias("n_glosses"), F.min("occurrences").alias("occurrences_min"), F.max("occurrences").alias("occurrences_max"), F.max(capped).alias("occurrences_max_capped"), F.sum("occurrences").alias("total_occurrences"), F.sum(capped).alias("total_occurrences_capped"), F.min("n_signers").alias("signers_min"), F.max("n_signers").alias("signers_max")
        )
        parts.append(totals.join(shape, "tag", "left").na.fill(0).select(F.col("tag").alias("scope"), F.lit(label).alias("group"), F.lit(floor).cast("long").alias("min_signers"), F.lit(cap).cast("long").alias("cap"), *shape.columns[1:], percent(F.col("total_occurrences"), F.col("corpus_tokens")).alias("percent_of_corpus_tokens")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_sizes(stats: DataFrame, cap: int = OCCURRENCE_CAP) -> DataFrame:
    """Glosses and tokens that survive each pair of floors, in one pass over the vocabulary."""
    grid = [(s, t) for s in SIGNER_FLOORS for t in CLASS_SIZES]
    capped = F.least(F.col("occurrences"), F.lit(cap))
    aggs = [F.sum("occurrences").alias("all"), F.sum(capped).alias("all_capped")]
    for i, (s, t) in enumerate(grid):
        kept = (F.col("occurrences") >= t) & (F.col("n_signers") >= s)
        aggs += [F.count_if(kept).alias(f"g{i}"), F.coalesce(F.sum(F.when(kept, F.col("occurrences"))), F.lit(0)).alias(f"t{i}"), F.coalesce(F.sum(F.when(kept, capped)), F.lit(0)).alias(f"c{i}")]
    cell = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("min_examples"), F.lit(s).cast("long").alias("min_signers"), F.col(f"g{i}").alias("n_glosses"), F.col(f"t{i}").alias("n_tokens"), F.col(f"c{i}").alias("n_tokens_capped")) for i, (s, t) in enumerate(grid)]))
    return stats.agg(*aggs).where("all IS NOT NULL").select("all", "all_capped", cell.alias("x")).select("x.*", percent(F.col("x.n_tokens"), F.col("all")).alias("percent_of_tokens"), percent(F.col("x.n_tokens_capped"), F.col("all_capped")).alias("percent_of_tokens_capped"))


def coverage_curve_full(stats: DataFrame) -> DataFrame:
    """Rank against cumulative share, one row per gloss; ties by gloss."""
    total = stats.agg(F.sum("occurrences").alias("total"))
    out = ordered_prefix(stats.select("gloss", "occurrences", "n_signers"), "occurrences", "gloss").withColumn("cumulative_tokens", F.col("before") + F.col("occurrences"))
    return out.crossJoin(F.broadcast(total)).select("rank", "gloss", "occurrences", "n_signers", "cumulative_tokens", percent(F.col("cumulative_tokens"), F.col("total")).alias("cumulative_percent"))


def coverage_curve(stats: DataFrame, cutoffs: Sequence[int] = COVERAGE_CUTOFFS) -> DataFrame:
    """Token share of the n most frequent glosses, at each cutoff and at the end."""
    full = coverage_curve_full(stats)
    size = stats.agg(F.count("*").alias("n"), F.sum("occurrences").alias("total"))
    picked = size.select("n", "total", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(c).cast("long") for c in cutoffs], F.col("n")), lambda c: F.least(c, F.col("n"))))).alias("rank"))
    out = full.join(F.broadcast(picked), "rank")
    return out.select(F.col("rank").alias("vocabulary_size"), F.col("cumulative_tokens").alias("n_tokens_covered"), F.col("cumulative_percent").alias("percent_covered"), percent(F.col("total") - F.col("cumulative_tokens"), F.col("total")).alias("oov_percent"), F.col("occurrences").alias("min_occurrences_at_cutoff"))


def signer_balance(flagged: DataFrame) -> DataFrame:
    """Token share per signer, cumulated from the largest."""
    counts = flagged.where("is_parsed").groupBy("speaker_id").agg(F.count("*").alias("n_tokens"))
    total = counts.agg(F.sum("n_tokens").alias("total"))
    out = ordered_prefix(counts, "n_tokens", "speaker_id").crossJoin(F.broadcast(total))
    return out.select("rank", "speaker_id", "n_tokens", percent(F.col("n_tokens"), F.col("total")).alias("percent_of_tokens"), percent(F.col("before") + F.col("n_tokens"), F.col("total")).alias("cumulative_percent"))


def duration_ms() -> Column:
    """End minus start where both are numbers and the difference is positive; otherwise null."""
    start, end = F.expr("try_cast(time_start AS DOUBLE)"), F.expr("try_cast(time_end AS DOUBLE)")
    d = end - start
    return F.when(~F.isnan(d) & (d > 0), d)


def units(frame: DataFrame, lexical: str = "lexical_item (no marker)", everything: str = "all parsed") -> Column:
    """The units a row counts for: all rows, bare lexical items, and each marker."""
    marks = [F.when(nonempty(F.col(k)), F.lit(k)) for k in MARKERS if k in frame.columns]
    return F.array_compact(F.array(F.lit(everything), F.when(F.col("lexical_only"), F.lit(lexical)), *marks))


def duration_distribution(flagged: DataFrame) -> DataFrame:
    """Exact, linearly interpolated duration percentiles of each unit."""
    rows = flagged.where("is_parsed").select(F.explode(units(flagged)).alias("unit"), duration_ms().alias("d")).where("d IS NOT NULL")
    shares = F.array(*[F.lit(p / 100) for p in DURATION_PERCENTILES])
    out = rows.groupBy("unit").agg(F.count("*").alias("n"), F.sum("d").alias("total_ms"), F.percentile("d", shares).alias("p"))
    return out.select("unit", "n", (F.col("total_ms") / F.col("n")).alias("mean_ms"), *[F.col("p")[i].alias(f"p{p}_ms") for i, p in enumerate(DURATION_PERCENTILES)], "total_ms")


def signing_rate(flagged: DataFrame) -> DataFrame:
    """Annotations per minute of each signer's own annotated span."""
    start, end = F.expr("try_cast(time_start AS DOUBLE)"), F.expr("try_cast(time_end AS DOUBLE)")
    out = flagged.groupBy(F.col("speaker_id").alias("signer")).agg(
        F.min("region_code").alias("region_code"),
        F.count_distinct("source_file").alias("n_files"),
        F.count("*").alias("n_annotations"),
        F.count_if("is_parsed").alias("n_parsed"),
        F.coalesce(F.max(end) - F.min(start), F.lit(0.0)).alias("signing_span_ms"),
        F.coalesce(F.sum(duration_ms()), F.lit(0.0)).alias("annotated_ms"),
        F.percentile(duration_ms(), 0.5).alias("median_duration_ms"),
        F.count_distinct(F.when(F.col("is_parsed") & F.col("has_lexical"), F.col("lexical_item"))).alias("n_unique_lexical_items"),
    )
    return out.withColumn("annotations_per_minute", F.when(F.col("signing_span_ms") > 0, F.col("n_annotations") / (F.col("signing_span_ms") / F.lit(60000.0))))


def split_feasibility(flagged: DataFrame, test_fraction: float = TEST_FRACTION, min_examples: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """What a signer-disjoint split would cost: signers move to the test set smallest first, ties by name."""
    rows = _lexical(flagged).select("speaker_id", "lexical_item")
    counts = rows.groupBy("speaker_id").agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("signers"))
    placed = ordered_prefix(counts, "n", "speaker_id", descending=False).crossJoin(F.broadcast(totals))
    held = placed.withColumn("is_test", (F.col("before") < F.col("total") * test_fraction) & (F.col("rank") <= F.col("signers") - 1))
    words = rows.join(held.select("speaker_id", "is_test"), "speaker_id").groupBy("lexical_item").agg(F.count_if("is_test").alias("test"), F.count_if(~F.col("is_test")).alias("train"))
    signers = held.agg(F.count_if("is_test").alias("n_test_signers"), F.count_if(~F.col("is_test")).alias("n_train_signers"), F.coalesce(F.sum(F.when(F.col("is_test"), F.col("n"))), F.lit(0)).alias("n_test"), F.max("total").alias("total"))
    aggs = [F.count_if(F.col("test") > 0).alias("n_test_glosses")]
    for t in min_examples:
        aggs += [F.count_if(F.col("train") >= t).alias(f"v{t}"), F.count_if((F.col("train") >= t) & (F.col("test") > 0)).alias(f"s{t}"), F.coalesce(F.sum(F.when(F.col("train") < t, F.col("test"))), F.lit(0)).alias(f"o{t}")]
    cell = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("min_examples"), F.col(f"v{t}").alias("n_train_glosses"), F.col(f"s{t}").alias("n_shared_glosses"), F.col(f"o{t}").alias("oov")) for t in min_examples]))
    one = signers.crossJoin(words.agg(*aggs)).where("n_test_signers + n_train_signers >= 2").select("*", cell.alias("x"))
    return one.select(
        "x.min_examples", "n_test_signers", "n_train_signers", percent(F.col("n_test"), F.col("total")).alias("test_token_percent"), "x.n_train_glosses", "n_test_glosses", "x.n_shared_glosses",
        percent(F.col("n_test_glosses") - F.col("x.n_shared_glosses"), F.col("n_test_glosses")).alias("oov_gloss_percent"), percent(F.col("x.oov"), F.col("n_test")).alias("oov_token_percent"),
    )


def examples_per_signer(flagged: DataFrame, top_n: int = 200) -> DataFrame:
    """How the examples of the most frequent glosses spread over signers."""
    stats = gloss_statistics(flagged).orderBy(F.desc("occurrences"), F.desc("n_signers"), "gloss").limit(top_n)
    wanted = F.broadcast(stats.select("gloss", "occurrences", "n_signers", "n_regions"))  # at most top_n rows
    each = _lexical(flagged).join(wanted, F.col("lexical_item") == F.col("gloss")).groupBy("gloss", "occurrences", "n_signers", "n_regions", "speaker_id").agg(F.count("*").alias("n"))
    out = each.groupBy("gloss", "occurrences", "n_signers", "n_regions").agg(F.min("n").alias("min_per_signer"), F.percentile("n", 0.5).alias("median_per_signer"), F.max("n").alias("max_per_signer"), F.sum("n").alias("all"))
    return out.withColumn("max_signer_share", F.col("max_per_signer") / F.col("all")).drop("all")


def marker_cooccurrence(flagged: DataFrame) -> DataFrame:
    """Unordered pairs of markers on one row, counted in a single pass."""
    has = {k: nonempty(F.col(k)) for k in MARKERS if k in flagged.columns}
    names = list(has)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = flagged.where("is_parsed").select(*[f.alias(k) for k, f in has.items()]).agg(*[F.count_if(k).alias(f"n_{k}") for k in names], *[F.count_if(F.col(a) & F.col(b)).alias(f"n_{a}__{b}") for a, b in pairs])
    cell = F.explode(F.array(*[F.struct(F.lit(a).alias("key_a"), F.lit(b).alias("key_b"), F.col(f"n_{a}__{b}").alias("n_both"), F.col(f"n_{a}").alias("n_a"), F.col(f"n_{b}").alias("n_b")) for a, b in pairs]))
    return one.select(cell.alias("x")).select("x.*").where("n_both > 0").withColumns({"percent_of_a": percent(F.col("n_both"), F.col("n_a")), "percent_of_b": percent(F.col("n_both"), F.col("n_b"))})
