"""Whole runs: documents to parsed tables, parsed tables to statistics, region counts to summaries.

A step that fails stops a run before what needs it; a step whose output exists is skipped unless
``overwrite`` is set, so a run can be taken up again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.gloss_parser import Rules, parse_rows
from ..operators import corpus, intervals, relations, space
from ..sources import documents as dx
from ..sources import files as fx


@dataclass
class Report:
    """What a run wrote, what it skipped and what failed."""

    written: list[str]
    skipped: list[str]
    failed: dict[str, str]
    totals: dict[str, dict] = field(default_factory=dict)

    @property
    def resolved_percent(self) -> float:
        """Share of parsed rows that need no review, over all steps that observed them; of nothing, 0."""
        rows, ambiguous = (sum(t.get(k, 0) for t in self.totals.values()) for k in ("rows", "ambiguous"))
        return 100.0 * (rows - ambiguous) / rows if rows else 0.0

    @property
    def exit_code(self) -> int:
        """0: all done, 2: some steps failed, 1: nothing was done."""
        if not self.failed:
            return 0
        return 2 if self.written or self.skipped else 1


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def run_steps(spark: SparkSession, out: str, steps: dict[str, Callable[[], DataFrame]], only: Sequence[str] = (), overwrite: bool = False, totals: dict[str, dict[str, Column]] | None = None) -> Report:
    """Write each step's table below ``out`` as Parquet; ``totals`` names aggregates that are observed in the pass that writes a step."""
    report = Report([], [], {})
    for name, step in steps.items():
        if only and name not in only:
            continue
        path = f"{out}/{name}"
        if not overwrite and _exists(spark, path):
            report.skipped.append(name)
            continue
        try:
            wanted = {k: v.alias(k) for k, v in (totals or {}).get(name, {}).items()}
            seen = Observation(name) if wanted else None
            (step().observe(seen, *wanted.values()) if seen else step()).write.mode("overwrite").parquet(path)
            report.written.append(name)
            if seen:
                report.totals[name] = seen.get
        except Exception as e:  # reported, and the exit code tells
            report.failed[name] = str(e)[:500]
    return report


def parsing(spark: SparkSession, folder: str, out: str, rules: Rules = Rules(), overwrite: bool = False) -> Report:
    """Annotation documents to extracted words, parsed rows, an index and what could not be read."""
    docs = dx.read_documents(spark, folder)

    def words() -> DataFrame:
        rows = dx.word_annotations(docs)
        order = F.coalesce(F.expr("try_cast(start_ms AS DOUBLE)"), F.lit(-1.0))
        return rows.select(F.col("file_id").alias("doc"), "tier_id", order.alias("at"), F.col("start_ms").alias("time_start"), F.col("end_ms").alias("time_end"), "annotation")

    def parsed() -> DataFrame:
        return parse_rows(spark.read.parquet(f"{out}/words"), "doc", ["tier_id", "at"], rules)

    def ambiguous() -> DataFrame:
        return spark.read.parquet(f"{out}/parsed").where("ambiguous <> ''")

    return run_steps(spark, out, {"index": lambda: dx.index(docs), "unreadable": lambda: dx.unreadable(docs), "words": words, "parsed": parsed, "ambiguous": ambiguous}, overwrite=overwrite, totals={"parsed": {"rows": F.count("*"), "ambiguous": F.count_if(F.col("ambiguous") != "")}})


def statistics(spark: SparkSession, annotations: DataFrame, index: DataFrame, out: str, labels: DataFrame | None = None, only: Sequence[str] = (), overwrite: bool = False) -> Report:
    """All corpus tables of an annotation table and its index, for the whole and for each region.

    Labels, if given, add the tables on overlaps; annotations then also have row_id and file_key.
    """
    flagged = corpus.add_flags(annotations)
    glosses = corpus.gloss_statistics(flagged)
    steps: dict[str, Callable[[], DataFrame]] = {
        "summary": lambda: corpus.summary(flagged, index),
        "key_counts": lambda: corpus.key_counts(flagged),
        "per_file": lambda: corpus.per_file(flagged),
        "gloss_statistics": lambda: glosses,
        "top_glosses": lambda: corpus.top_glosses(glosses, 100, 5),
        "coverage": lambda: corpus.coverage_table(flagged),
        "class_sizes": lambda: corpus.class_sizes(glosses),
        "coverage_curve": lambda: corpus.coverage_curve(glosses),
        "durations": lambda: corpus.duration_distribution(flagged),
        "signing_rate": lambda: corpus.signing_rate(flagged),
        "signer_balance": lambda: corpus.signer_balance(flagged),
        "split_feasibility": lambda: corpus.split_feasibility(flagged),
        "examples_per_signer": lambda: corpus.examples_per_signer(flagged),
        "marker_cooccurrence": lambda: corpus.marker_cooccurrence(flagged),
        "matching": lambda: relations.match_report(flagged, index, "source_file"),
    }
    if labels is not None:
        labelled, status = intervals.annotate_with_labels(flagged, labels), intervals.label_status(labels)
        steps |= {
            "label_status": lambda: status,
            "mouth_categories": lambda: intervals.category_counts(status),
            "key_category": lambda: intervals.key_category_table(labelled, status),
            "overlap": lambda: intervals.overlap_table(labelled),
            "disagreements": lambda: intervals.disagreements(labelled),
        }
    return run_steps(spark, out, steps, only, overwrite)


def signing_space(spark: SparkSession, clips: DataFrame, counts: DataFrame, out: str, overwrite: bool = False) -> Report:
    """Summaries, shares, spreads and intervals of a clip table and its region counts."""
    keys = ["keyword", "region_code", "hand_role"]
    shares = space.region_distribution(counts, keys)
    sets = [["region_code", "keyword"], ["age_group", "keyword"], ["age_band", "keyword"], ["gender", "keyword"], ["region_code", "age_band", "gender", "keyword"]]
    steps = {
        "summary": lambda: space.summarise(clips, sets),
        "regions": lambda: shares,
        "region_groups": lambda: space.region_groups(shares, keys),
        "central_periphery": lambda: space.central_periphery(shares, keys),
        "intervals": lambda: space.bootstrap_ci(clips, keys),
        **{f"spread_{g}": (lambda g=g: space.effect_spread(clips, g)) for g in ("region_code", "age_band", "gender")},
        **{f"pairs_{g}": (lambda g=g: space.bootstrap_difference(clips, g)) for g in ("region_code", "age_band", "gender")},
    }
    return run_steps(spark, out, steps, overwrite=overwrite)


def exceptions_from(spark: SparkSession, path: str | None) -> Rules:
    """Parser rules with the exceptions that a list names, if there is one."""
    if not path:
        return Rules()
    return Rules(exceptions=frozenset(Rules.key(r["line"]) for r in fx.read_text_list(spark, path).collect()))
