from pyspark.sql import functions as F

from tierloom.__main__ import main
from tierloom.functions.gloss_parser import Rules
from tierloom.plans import adapters, interval_queries, pipelines, space_queries

from test_sources import EAF

FOLDER = "/root/testdata/sf0.001"


def test_parsing_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "FO_01_Task.eaf").write_text(EAF, encoding="utf-8")
    out = str(tmp_path / "out")
    first = pipelines.parsing(spark, str(tmp_path / "in"), out, Rules())
    assert first.totals == {"parsed": {"rows": 2, "ambiguous": 0}} and first.resolved_percent == 100.0
    assert first.exit_code == 0 and first.written == ["index", "unreadable", "words", "parsed", "ambiguous"]
    assert [r["lexical_item"] for r in spark.read.parquet(f"{out}/parsed").orderBy("time_start").collect()] == ["猫", "犬"]
    assert pipelines.parsing(spark, str(tmp_path / "in"), out).skipped == first.written


def test_statistics_run(spark, tmp_path):
    rows = interval_queries._annotations(spark, FOLDER).select("row_id", "file_key", "speaker_id", "region_code", "lexical_item", "time_start", "time_end", "pt", "cl", "m", "compound", "ambiguous", F.col("file_key").alias("source_file"), F.col("lexical_item").alias("annotation"))
    index = rows.select("source_file", "region_code").distinct().withColumn("duration_ms", F.lit(1000.0))
    labels = interval_queries._mouth(spark, FOLDER)
    report = pipelines.statistics(spark, rows, index, str(tmp_path), labels)
    assert report.failed == {} and len(report.written) == 20


def test_space_run(spark, tmp_path):
    report = pipelines.signing_space(spark, space_queries._clips(spark, FOLDER), space_queries._counts(spark, FOLDER), str(tmp_path))
    assert report.failed == {} and len(report.written) == 11


def test_failures_are_reported(spark, tmp_path):
    def broken():
        raise ValueError("no")

    report = pipelines.run_steps(spark, str(tmp_path), {"a": broken, "b": lambda: spark.range(2)})
    assert report.exit_code == 2 and report.written == ["b"] and "no" in report.failed["a"]
    assert pipelines.run_steps(spark, str(tmp_path), {"a": broken}).exit_code == 1


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "top_glosses" in capsys.readouterr().out
    assert main(["query", FOLDER, str(tmp_path), "nothing_such"]) == 1 and main(["nonsense"]) == 1
    assert main(["query", FOLDER, str(tmp_path), "match_report"]) == 0 and spark.read.parquet(f"{tmp_path}/match_report").count() == 3
    assert adapters.tokens(spark, FOLDER).columns[0] == "source_file"
