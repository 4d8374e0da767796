"""Command line: score, report, check, compare, review and publish."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import ratio
from ledgerlark.operators import joins
from ledgerlark.operators.joins import violations
from ledgerlark.plans import paired, records, report, retrieval, review, scoring
from ledgerlark.sources import files, runs

POLICIES = {"baseline": scoring.BASELINE, "target": scoring.TARGET}


def scored(spark: SparkSession, path: str, policy: scoring.Policy) -> DataFrame:
    return scoring.rank(scoring.score(files.entities(spark, path), policy), "input_pos", policy)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m ledgerlark")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("score", "score entities and write the ranking"), ("report", "write the Markdown report"), ("rules", "check stored scores against a recomputation")):
        s = sub.add_parser(name, help=text)
        s.add_argument("--input", required=True)
        s.add_argument("--policy", choices=POLICIES, default="baseline")
        s.add_argument("--output")
    s = sub.add_parser("compare", help="pair two runs' metric tables (Parquet)")
    s.add_argument("--before", required=True)
    s.add_argument("--after", required=True)
    s.add_argument("--keys", required=True, nargs="+")
    s.add_argument("--metrics", required=True, nargs="+")
    s.add_argument("--output", required=True)
    s = sub.add_parser("chunk", help="cut a Markdown corpus into chunks")
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    s = sub.add_parser("diff", help="compare two folders by file hash")
    s.add_argument("--before", required=True)
    s.add_argument("--after", required=True)
    for name, text in (("records", "check records (Parquet, named after their kind) against their rules"), ("parse", "check that all files of a folder are what their names say"), ("archive", "check an archive against its manifest")):
        s = sub.add_parser(name, help=text)
        s.add_argument("--input", required=True)
        if name == "records":
            s.add_argument("--kind", required=True, choices=sorted(records.RULES))
            s.add_argument("--id", default="id")
    s = sub.add_parser("review", help="draw targets (Parquet) for review")
    s.add_argument("--input", required=True)
    s.add_argument("--seed", required=True)
    s.add_argument("--per-stratum", type=int, default=5)
    s.add_argument("--output", required=True)
    s = sub.add_parser("labels", help="compare two label tables (Parquet: unit_id, label)")
    s.add_argument("--expected", required=True)
    s.add_argument("--found", required=True)
    s = sub.add_parser("publish", help="move a staged archive to its place if it is whole")
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("ledgerlark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "score":
        out = scored(spark, a.input, POLICIES[a.policy])
        if a.output:
            files.write_once(out, a.output)
        else:
            out.orderBy("rank").select("rank", "name", "stage", "final_score", "grade", "top").show(50, truncate=False)
    elif a.command == "report":
        text = report.top_report(scored(spark, a.input, POLICIES[a.policy]), "name", POLICIES[a.policy].k)
        if a.output:
            with open(a.output, "x", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
    elif a.command == "rules":
        checks = scoring.rule_checks(scoring.score(files.entities(spark, a.input), POLICIES[a.policy]), "name", POLICIES[a.policy])
        counts = {r.result: r["count"] for r in checks.groupBy("result").count().collect()}
        print(counts)
        return 2 if counts.get("error") else 1 if counts.get("fail") else 0
    elif a.command == "compare":
        before, after = (paired.assert_unique(spark.read.parquet(x), a.keys) for x in (a.before, a.after))
        r = paired.report(before, after, a.keys, a.metrics, [not m.endswith(("errors", "missing_count", "incorrect_count")) for m in a.metrics])
        files.write_once(r, f"{a.output}/report")
        files.write_csv(paired.long(r, a.keys, a.metrics), f"{a.output}/long")
    elif a.command == "chunk":
        files.write_once(retrieval.chunks(files.corpus(spark, a.input), "content"), a.output)
    elif a.command == "diff":
        d = joins.table_diff(files.inventory(spark, a.before), files.inventory(spark, a.after), "file", "sha256")
        rows = d.select("file", "change").orderBy("file")
        rows.show(1000, truncate=False)
        return int(not rows.filter(F.lit(True)).isEmpty())
    elif a.command == "records":
        bad = violations(spark.read.parquet(a.input), a.kind, a.id, records.RULES[a.kind])
        bad.groupBy("rule").count().orderBy("rule").show(100, truncate=False)
        return int(not bad.isEmpty())
    elif a.command == "parse":
        bad = runs.parseable(spark, a.input).filter("not ok")
        bad.orderBy("file").show(1000, truncate=False)
        return int(not bad.isEmpty())
    elif a.command == "archive":
        bad = runs.archive_problems(spark, a.input)
        bad.orderBy("file").show(1000, truncate=False)
        return int(not bad.isEmpty())
    elif a.command == "review":
        targets = spark.read.parquet(a.input).withColumn("stratum", F.explode("strata"))
        drawn = review.plan(targets, ["review_group"], "stratum", "target_id", a.per_stratum, a.seed, "critical")
        files.write_once(drawn.dropDuplicates(["target_id"]).drop("stratum"), a.output)
    elif a.command == "labels":
        both = joins.multiset(spark.read.parquet(a.expected), spark.read.parquet(a.found), ["unit_id"], "label")
        common, want, got = (F.sum(c).alias(c) for c in ("n_common", "n_left", "n_right"))
        both.agg(common, want, got).select("*", ratio(F.col("n_common"), F.col("n_right")).alias("precision"), ratio(F.col("n_common"), F.col("n_left")).alias("recall")).show(truncate=False)
    elif a.command == "publish":
        runs.publish(spark, a.input, a.output, runs.archive_problems(spark, a.input))
    return 0


if __name__ == "__main__":
    sys.exit(main())
