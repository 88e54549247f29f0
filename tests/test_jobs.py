"""The jobs: two runs over growing copies, runs again, and their command lines' configuration."""

import inspect
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import audit_tiers, gloss_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "a b a", "en", "s1", 5), (2, "b c", "en", "s2", 3), (3, None, "fr", "s1", 0), (4, "A  z", "fr", "s2", 4), (None, "lost", "en", "s1", 4),
    (5, "a none b", None, "s3", 8), (6, "", "en", "s1", 0),
]
LATER = [(7, "a a q", "fr", "s1", 5), (1, "told again", "en", "s1", 10), (8, "b", "en", None, 1)]


def rows(frame):
    return sorted(map(tuple, frame.select("tag", "gloss", "occurrences", "n_files", "n_signers", F.round("percent_of_tokens", 6)).collect()), key=str)


def want(documents):
    tokens = [(i, s, t, g) for i, x, t, s, _ in documents for g in (x or "").lower().split(" ") if g.strip() and g != "none"]
    out = []
    for tag in {"GLOBAL", *(t for _, _, t, _ in tokens)}:
        some = [x for x in tokens if tag == "GLOBAL" or x[2] == tag]
        for gloss in {x[3] for x in some}:
            hits = [x for x in some if x[3] == gloss]
            out.append((tag, gloss, len(hits), len({x[0] for x in hits}), len({x[1] for x in hits if x[1]}), round(100 * len(hits) / len(some), 6)))
    return sorted(out, key=str)


def files_of(path):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


def test_gloss_counts_over_growing_input(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("documents.parquet", "out", "mark"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(2).write.parquet(source)
    assert gloss_counts.run(spark, source, out, mark)["read"] == len(ROWS)
    first = want([r for r in ROWS if r[0] is not None])
    assert rows(gloss_counts.published(spark, out)) == first
    state = {n: files_of(f"{out}/state/{n}") for n in gloss_counts.STATE}

    assert gloss_counts.run(spark, source, out, mark)["read"] == 0  # nothing new, and the same again
    assert rows(gloss_counts.published(spark, out)) == first
    assert {n: files_of(f"{out}/state/{n}") for n in gloss_counts.STATE} == state

    spark.createDataFrame(LATER, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert gloss_counts.run(spark, source, out, mark, files_per_batch=1)["read"] == len(LATER)  # the old files are not read again
    both = want([r for r in ROWS if r[0] is not None] + [LATER[0], LATER[2]])
    assert rows(gloss_counts.published(spark, out)) == both
    whole = str(tmp_path / "whole")
    gloss_counts.run(spark, source, whole, f"{whole}-mark")
    assert len(rows(gloss_counts.published(spark, whole))) >= len(both)  # which of two rows of an id comes first is open

    only_known = [(1, "told again", "en", "s1", 10)]
    spark.createDataFrame(only_known, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    gloss_counts.run(spark, source, out, mark)
    assert rows(gloss_counts.published(spark, out)) == both


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    frame = spark.createDataFrame(ROWS, SCHEMA).select("doc_id", "text", "lang", "source")
    for _ in range(2):
        gloss_counts.count_batch(frame, 0, out)
        totals = {n: gloss_counts.state(spark, out, n).count() for n in gloss_counts.STATE}
    assert totals["documents"] == 6
    gloss_counts.count_batch(frame, 1, out)  # all known by now
    assert {n: gloss_counts.state(spark, out, n).count() for n in gloss_counts.STATE} == totals


def test_a_single_file_and_an_empty_table(spark, tmp_path):
    source = str(tmp_path / "d.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    assert gloss_counts.run(spark, source, str(tmp_path / "o"), str(tmp_path / "m")) == {"read": 0, "written": 0, "top": 0}
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "one"))
    single = files_of(str(tmp_path / "one"))[0]
    assert gloss_counts.run(spark, single, str(tmp_path / "o1"), str(tmp_path / "m1"))["read"] == len(ROWS)


def test_audit_runs_again(spark, tmp_path):
    orders, customers, out = (str(tmp_path / n) for n in ("orders", "customers", "out"))
    spark.range(400).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 97).alias("o_custkey"), F.when(F.col("id") % 3 == 0, "F").otherwise("O").alias("o_orderstatus")).write.parquet(orders)
    spark.range(90).select(F.col("id").alias("c_custkey")).write.parquet(customers)
    first = audit_tiers.run(spark, orders, customers, out)
    read = lambda n: sorted(map(str, spark.read.parquet(f"{out}/{n}").collect()))
    held = {n: read(n) for n in ("findings", "to_do", "problems")}
    assert audit_tiers.run(spark, orders, customers, out) == first
    assert {n: read(n) for n in held} == held
    assert first["findings"]["rows"] == len(held["findings"]) == first["problems"]["findings"]
    assert len({r for r in os.listdir(f"{out}/to_do") if r.startswith("category=")}) >= 4


def test_top_of_every_scope(spark, tmp_path):
    source, out = str(tmp_path / "d"), str(tmp_path / "out")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(source)
    gloss_counts.run(spark, source, out, str(tmp_path / "mark"), top_n=2, min_signers=2)
    got = {(r["tag"], r["rank"], r["gloss"]) for r in spark.read.parquet(f"{out}/top").collect()}
    assert got == {("GLOBAL", 1, "a"), ("GLOBAL", 2, "b"), ("en", 1, "b")}


def test_words_are_counted_where_their_documents_are(spark, tmp_path):
    """The words of a document are not dealt anew: one exchange of documents, none of words."""
    from tierloom.operators import corpus
    from tierloom.plans.adapters import tokens_of

    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "d"))
    documents = spark.read.parquet(str(tmp_path / "d")).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source").dropDuplicates(["doc_id"])
    plan = corpus.gloss_cells(corpus.add_flags(tokens_of(documents)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_task_cuts_a_bounded_share_of_the_text(spark, tmp_path, monkeypatch):
    """Documents are dealt by the bytes of their text, so that a batch of any size has small tasks."""
    monkeypatch.setattr(gloss_counts, "TASK_BYTES", 1000, raising=False)
    documents = [(n, f"w{n % 7} a a " + "b " * 50, "en" if n % 2 else "fr", f"s{n % 3}", 0) for n in range(400)]
    frame = spark.createDataFrame(documents + documents[:9], SCHEMA).select("doc_id", "text", "lang", "source")
    out = str(tmp_path / "out")
    gloss_counts.count_batch(frame, 0, out)
    assert len(files_of(f"{out}/state/documents")) > 30  # 43 kB of text; joined into one part before
    assert gloss_counts.state(spark, out, "counts").where("region_code = 'fr' AND gloss = 'a'").select("occurrences", "n_files").collect() == [(400, 200)]
    counts = {(r["region_code"], r["gloss"]): (r["occurrences"], r["n_files"]) for r in gloss_counts.state(spark, out, "counts").collect()}
    assert counts[("en", "b")] == (10_000, 200) and sum(n for n, _ in counts.values()) == 400 * 53


def test_a_run_that_dies_is_taken_up(spark, tmp_path, monkeypatch):
    source, out, mark = (str(tmp_path / n) for n in ("d", "out", "mark"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(source)
    count, calls = gloss_counts.count_batch, []

    def dying(frame, number, where):
        calls.append(number)
        read = count(frame, number, where)
        if len(calls) == 2:
            raise RuntimeError("the driver is lost after it wrote")
        return read

    monkeypatch.setattr(gloss_counts, "count_batch", dying)
    with pytest.raises(Exception, match="the driver is lost"):
        gloss_counts.run(spark, source, out, mark, files_per_batch=1)
    gloss_counts.run(spark, source, out, mark, files_per_batch=1)
    assert calls == [0, 1, 1, 2]  # the batch that was not committed runs again
    assert rows(gloss_counts.published(spark, out)) == want([r for r in ROWS if r[0] is not None])


@pytest.mark.parametrize(("job", "tables"), [("gloss_counts", {"documents": "documents"}), ("audit_tiers", {"orders": "orders", "customers": "customer"})])
def test_command_line(job, tables, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(gloss_counts.__file__)))
    paths = [x for k, t in tables.items() for x in (f"--{k}", f"/root/testdata/sf0.001/{t}.parquet")] + ["--out", str(tmp_path / "out")]
    paths += ["--checkpoint", str(tmp_path / "mark")] if job == "gloss_counts" else []
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", f"jobs/{job}.json", *paths], cwd=root, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": root})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and "_SUCCESS" in os.listdir(tmp_path / "out" / ("glosses" if job == "gloss_counts" else "to_do"))


@pytest.mark.parametrize("job", [gloss_counts, audit_tiers])
def test_configuration_names_what_the_command_line_needs(job):
    name = job.__name__.split(".")[-1]
    with open(os.path.join(os.path.dirname(job.__file__), f"{name}.json"), encoding="utf-8") as file:
        config = json.load(file)
    assert "out" in config and set(config) <= set(inspect.signature(job.run).parameters)
