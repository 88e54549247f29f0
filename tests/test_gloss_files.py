"""Recordings of a gloss are summed, not counted as distinct ones of all cells."""

from tierloom.operators import corpus


def test_files_of_several_regions_and_speakers(spark):
    rows = [("f1", "a", "R1", "x"), ("f1", "b", "R2", "x"), ("f1", "b", "R2", "x"), ("f2", "a", "R1", "x"), (None, "a", "R1", "x"), ("f2", "c", None, "y")]
    flagged = corpus.add_flags(spark.createDataFrame(rows, "source_file string, speaker_id string, region_code string, lexical_item string"))
    out = corpus.gloss_statistics(flagged)
    got = sorted((r["gloss"], r["occurrences"], r["n_signers"], r["n_files"], r["regions"], r["n_regions"]) for r in out.collect())
    assert got == [("x", 5, 2, 2, "R1;R2", 2), ("y", 1, 1, 1, "", 0)]
    assert "count(distinct source_file" not in out._jdf.queryExecution().analyzed().toString()
