"""Job: audit of word tiers, and the list of what people should do about it.

    python -m jobs.audit_tiers jobs/audit_tiers.json [--orders PATH] [--customers PATH] [--out PATH]

Reads the tables that stand for tiers and for the roster of signers, applies all rules in one scan and writes

    out/findings    everything that is wrong, one folder for each problem
    out/to_do       one row for each decision, one folder for each category
    out/problems    how many findings, signers and documents each problem has

Every table is written whole in place of its former state, the later ones from the findings as written, so a run that
stops can be run again, and a second run leaves the same rows. Totals are observed in the passes that write.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tierloom.operators import rules
from tierloom.plans.audit_queries import TO_DO_SQL, roster_of_customers, tiers_of_orders
from tierloom.scratch import fresh_path

log = logging.getLogger("jobs.audit_tiers")

FINDINGS = "recording string, path string, signer string, detail string, tiers string, problem string"
TO_DO = "rank int, signer string, recording string, tier string, problem string, spreadsheet string, in_selection string, action string, category string"


def _write(frame: DataFrame, path: str, by: str | None, *totals) -> dict:
    """Write a table and return what was observed on the way."""
    seen = Observation(path.rsplit("/", 1)[-1])
    writer = frame.observe(seen, F.count("*").alias("rows"), *totals).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    log.info("wrote %s: %s", path, seen.get)
    return seen.get


def run(spark: SparkSession, orders: str, customers: str, out: str) -> dict[str, dict]:
    """Audit, list and count; returns the totals of each table."""
    tiers, roster = tiers_of_orders(spark.read.parquet(orders)), roster_of_customers(spark.read.parquet(customers))
    log.info("reading tiers from %s and the roster from %s", orders, customers)
    problem = F.col("problem")
    done = {"findings": _write(rules.findings(tiers, roster), f"{out}/findings", "problem", F.count_if(problem.isin(*rules.PER_TIER)).alias("to settle by tier"), F.count_if(problem.isin(*rules.PER_SIGNER)).alias("to settle by signer"))}
    found = spark.read.schema(FINDINGS).parquet(f"{out}/findings")
    selected = tiers.where("in_use").select("recording").distinct()
    rows = rules.to_do_list(found, rules.unread_files(tiers), roster, selected)
    done["to_do"] = _write(rows, f"{out}/to_do", "category", F.count_if(F.col("in_selection") == "yes").alias("in the selection"))
    done["problems"] = _write(rules.problem_totals(found), f"{out}/problems", None, F.sum("n_findings").alias("findings"))
    return done


def job2_audit_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over all tiers into one new folder; the list of what to do as it stands after the second."""
    out = fresh_path(spark, "job2")
    for _ in range(2):
        run(spark, f"{sf_dir}/orders.parquet", f"{sf_dir}/customer.parquet", out)
    return spark.read.schema(TO_DO).parquet(f"{out}/to_do")


ORACLE_SQL = f"WITH {TO_DO_SQL}"


def main(arguments: list[str] | None = None) -> int:
    """The command line; 0 when all is written."""
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("config")
    for name in ("orders", "customers", "out"):
        parser.add_argument(f"--{name}")
    options = parser.parse_args(arguments)
    with open(options.config, encoding="utf-8") as file:
        config = json.load(file)
    config |= {k: v for k, v in vars(options).items() if v and k != "config"}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("audit-tiers").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **config)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
