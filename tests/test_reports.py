"""Reports, run integrity, providers and the command line."""

import hashlib
import json

from pyspark.sql import functions as F

from ledgerlark.__main__ import main
from ledgerlark.plans import report, scoring, workflow
from ledgerlark.sources import providers

ORDER = ("team", "market", "technology", "traction", "competition", "risk")


def entity_file(tmp_path, rows):
    path = tmp_path / "companies.json"
    path.write_text(json.dumps({"companies": [{"name": n, "stage": s, **{f"{x}_signal": v for x, v in zip(ORDER, sig, strict=True)}} for n, s, sig in rows]}))
    return str(path)


ROWS = [("Alpha|One", "Series A", (5, 5, 4, 4, 4, 3)), ("Beta", "Seed", (3, 4, 2, 1, 2, 1)), ("Gamma", "Series C+", (5, 5, 4, 5, 4, 3))]


def test_report_reads_back(spark, tmp_path):
    from ledgerlark.sources import files

    ranked = scoring.rank(scoring.score(files.entities(spark, entity_file(tmp_path, ROWS))), "input_pos")
    text = report.top_report(ranked, "name")
    assert text.index("Gamma") < text.index("Alpha")
    assert "## Beta" not in text
    frame = spark.createDataFrame([(1, text), (2, text.replace("| 88 |", "| 89 |")), (3, text.replace("Gamma", "Nobody"))], "r int, t string")
    got = {(r.r, r.company): r.result for r in report.check_tables(frame, "r", "t", ranked, "name").collect()}
    assert got == {(1, "Gamma"): "pass", (1, "Alpha|One"): "pass", (2, "Gamma"): "fail", (2, "Alpha|One"): "pass", (3, "Nobody"): "unknown", (3, "Alpha|One"): "pass"}
    hold = scoring.rank(scoring.score(files.entities(spark, entity_file(tmp_path, ROWS[1:2]))), "input_pos")
    assert report.top_report(hold, "name").startswith("# Hold")


def run_tables(spark):
    body = "evidence text here"
    sha = hashlib.sha256(body.encode()).hexdigest()
    eid = hashlib.sha256(b"src\ntext").hexdigest()
    return {
        "invocations": ([("r", None), ("n", "r"), ("l", "n")], "invocation_id string, parent_id string"),
        "evidence": ([(eid, "src", "text")], "evidence_id string, source string, text string"),
        "retrievals": ([("n", 0, 1, eid), ("n", 1, 2, eid)], "invocation_id string, pos int, rank int, evidence_id string"),
        "contexts": ([("c", "l", body, "p", 9, 13, "text")], "context_id string, invocation_id string, text string, path string, start int, end int, quote string"),
        "blobs": ([("p", sha, bytearray(body.encode()))], "path string, sha256 string, content binary"),
    }


def test_each_mutation_gives_one_violation(spark):
    def check(**changed):
        tables = {k: spark.createDataFrame(changed.get(k, rows), schema) for k, (rows, schema) in run_tables(spark).items()}
        return [r.rule for r in workflow.validate_run(**tables).collect()]

    base = {k: v[0] for k, v in run_tables(spark).items()}
    eid = base["evidence"][0][0]
    assert check() == []
    assert check(invocations=[("r", None), ("n", "gone"), ("l", "n")]) == ["parent"]
    assert check(retrievals=[("n", 0, 1, eid), ("n", 1, 2, "x")]) == ["evidence"]
    assert check(retrievals=[("n", 0, 2, eid), ("n", 1, 1, eid)]) == ["rank order"]
    assert check(blobs=[("p", "0" * 64, base["blobs"][0][2])]) == ["snapshot hash"]
    assert check(contexts=[("c", "l", "", "p", 8, 12, "text")]) == ["quote"]
    assert check(contexts=[("c", "zz", "", "p", 9, 13, "text")]) == ["context"]
    assert set(check(invocations=[("r", "l"), ("n", "r"), ("l", "n")])) == {"cycle"}


def test_roles_steps_and_limits(spark):
    calls = spark.createDataFrame([("a", None, "plan.x"), ("b", "a", "llm"), ("c", "b", "stop.y"), ("d", "c", "llm"), ("e", None, "llm")], "invocation_id string, parent_id string, operation string")
    got = {r.invocation_id: r.role for r in workflow.nearest_role(calls, {"plan": "planner", "stop": None}).collect()}
    assert got == {"a": "planner", "b": "planner", "c": None, "d": None, "e": None}
    ents, steps, done = (spark.createDataFrame(x, s) for x, s in (([("x",), ("y",)], "e string"), ([("s1",), ("s2",)], "s string"), ([("x", "s1"), ("x", "s1")], "e string, s string")))
    assert {(r.e, r.s): r.covered for r in workflow.step_coverage(ents, steps, done, "e", "s").collect()} == {("x", "s1"): True, ("x", "s2"): False, ("y", "s1"): False, ("y", "s2"): False}
    assert workflow.over_limit(done, "e", "s", 1).count() == 1


def test_providers_never_lose_rows(spark):
    asked = spark.createDataFrame([("known",), ("unknown",)], "q string")
    got = {r.q: (r.reply, r.status, r.attempts) for r in providers.ask(asked, "q", providers.Recorded({"known": "yes"}), retries=1).collect()}
    assert got == {"known": ("yes", "ok", 1), "unknown": (None, "error", 2)}


def test_command_line(spark, tmp_path, capsys):
    path = entity_file(tmp_path, ROWS)
    assert main(["score", "--input", path, "--output", f"{tmp_path}/out/ranking"]) == 0
    assert [r.name for r in spark.read.parquet(f"{tmp_path}/out/ranking").orderBy("rank").collect()][0] == "Gamma"
    assert main(["rules", "--input", path]) == 0
    assert main(["report", "--input", path, "--output", f"{tmp_path}/r.md"]) == 0
    assert (tmp_path / "r.md").read_text().startswith("# Recommendation")
    for side, v in (("a", 0.5), ("b", 0.75)):
        spark.createDataFrame([("k", v)], "k string, m double").write.parquet(f"{tmp_path}/{side}")
    assert main(["compare", "--before", f"{tmp_path}/a", "--after", f"{tmp_path}/b", "--keys", "k", "--metrics", "m", "--output", f"{tmp_path}/cmp"]) == 0
    assert spark.read.parquet(f"{tmp_path}/cmp/report").first().delta_m == 25.0
    assert spark.read.csv(f"{tmp_path}/cmp/long", header=True).select(F.col("metric")).first()[0] == "m"
