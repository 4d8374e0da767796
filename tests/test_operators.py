"""Joins, aggregates, ordered operators, retrieval, sources and streams."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerlark.operators import aggregates, joins, ordered
from ledgerlark.plans import paired, quality, retrieval, review
from ledgerlark.sources import files


def test_pair_null_keys_and_unpaired(spark):
    a = spark.createDataFrame([("x", None, 1.0), ("y", "s", 2.0)], "c string, s string, v double")
    b = spark.createDataFrame([("x", None, 3.0), ("z", "s", 4.0)], "c string, s string, v double")
    got = {r.c: (r.pair_status, r.delta_v, r.verdict) for r in paired.report(a, b, ["c", "s"], ["v"], [True]).collect()}
    assert got == {"x": ("paired", 200.0, "improved"), "y": ("unpaired", None, "incomplete"), "z": ("unpaired", None, "incomplete")}
    with pytest.raises(ValueError, match="duplicate"):
        paired.assert_unique(a.unionByName(a), ["c", "s"])


def test_macro_is_not_micro(spark):
    rows = [("g", "A", 1.0, 1, 1, True)] * 100 + [("g", "B", 0.0, 0, 1, True)]
    frame = lambda r: spark.createDataFrame(r, "g string, u string, score double, part int, whole int, ok boolean")
    r = aggregates.macro_micro(frame(rows), ["g"], ["u"], "score", "part", "whole", "ok").first()
    assert (r.macro, round(r.micro, 6), r.concentrated) == (0.5, round(100 / 101, 6), True)
    rows[-1] = ("g", "B", 0.0, 0, 1, False)
    assert aggregates.macro_micro(frame(rows), ["g"], ["u"], "score", "part", "whole", "ok").first().micro is None


def test_runtime_statistics(spark):
    from ledgerlark.functions import numeric

    f = spark.createDataFrame([(float(i), None if i == 3 else 1.0) for i in range(1, 21)], "d double, c double")
    r = f.agg(numeric.median_known(F.col("d")).alias("m"), aggregates.known_sum(F.col("c"), F.lit("USD")).alias("c"), numeric.median_known(F.col("c")).alias("mc")).first()
    assert tuple(r) == (10.5, None, None)
    runs = f.select(*[F.lit(None if k == "currency" else k).alias(k) for k in paired.RUNTIME], F.col("d").alias("duration_seconds"), F.col("c").alias("cost"))
    got = paired.runtime_groups(runs).first()
    assert (got.repetitions, got.observed_duration_count, got.median_seconds, got.p95_seconds, got.known_cost_count, got.median_cost) == (20, 20, 10.5, 19.0, 19, None)
    got = paired.runtime_groups(runs.filter("duration_seconds > 3.5 and duration_seconds < 20")).first()
    assert (got.repetitions, got.median_seconds, got.p95_seconds, got.known_cost_count, got.median_cost) == (16, 11.5, None, 16, 1.0)
    assert paired.runtime_groups(runs.limit(0)).collect() == []


def test_order_statistics_against_sorting(spark):
    import math
    import random

    from ledgerlark.functions.numeric import nearest_rank
    from ledgerlark.operators.ordered import order_statistics

    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.choice([1, 2]), rng.choice([None, 5.0, rng.uniform(-9, 9), float(rng.randrange(4))])) for _ in range(3000)] + [("none", 1, None)]
    frame = spark.createDataFrame(rows, "g string, h int, x double").repartition(6)
    got = order_statistics(frame, ["g", "h"], "x", {"low": lambda n: F.lit(1), "p95": nearest_rank(0.95), "high": lambda n: n, "beyond": lambda n: n + 1}).collect()
    want = {}
    for g, h, x in rows:
        if x is not None:
            want.setdefault((g, h), []).append(x)
    assert {(r.g, r.h): (r.n, r.low, r.p95, r.high, r.beyond) for r in got} == {k: (len(v), min(v), sorted(v)[math.ceil(0.95 * len(v) - 1e-9) - 1], max(v), None) for k, v in want.items()}


def test_claim_counts_and_rollup(spark):
    c = spark.createDataFrame([("s", "a", "verified", True, "1"), ("s", None, "contradicted", True, "2"), ("t", "a", None, False, "3")], "stage string, company string, verdict string, critical boolean, claim_id string")
    out = aggregates.rollup(c, [("stage", "company"), ("stage",)], aggregates.claim_counts(), ["company", "stage"]).collect()
    stage = {r.stage: r for r in out if r.scope == "stage"}
    assert (stage["s"].n_claims, stage["s"].rate_verified, stage["s"].ids_critical_contradicted) == (2, 0.5, ["2"])
    assert (stage["t"].n_pending, stage["t"].rate_verified) == (1, None)
    assert sum(r.scope == "company" and r.company is None for r in out) == 1


def test_confusion_with_empty_cells(spark):
    f = spark.createDataFrame([("v", "v"), ("v", "c")], "h string, a string")
    got = {(r.h, r.a): (r.n, r.recall, r.precision) for r in aggregates.confusion(f, "h", "a", ["v", "c", "u"]).collect()}
    assert len(got) == 9
    assert got["v", "v"] == (1, 0.5, 1.0)
    assert got["u", "u"] == (0, None, None)


def test_folds(spark):
    rows = [(1, False, "completed", None), (2, True, "pending", None), (2, True, "completed", "fulfilled"), (3, True, "completed", "incorrect"), (3, True, "completed", "fulfilled"), (4, True, "completed", "fulfilled"), (4, True, "completed", "missing"), (5, True, "completed", "missing")]
    f = spark.createDataFrame(rows, "k int, applicable boolean, status string, verdict string").groupBy("k").agg(aggregates.item_state().alias("s"))
    assert {r.k: r.s for r in f.collect()} == {1: "not_applicable", 2: "unjudged", 3: "incorrect", 4: "fulfilled", 5: "missing"}
    h = aggregates.histogram(spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "b")], "k string, s string"), ["k"], "s").first()
    assert h.counts == {"a": 2, "b": 1}


def test_latest_before_and_first_per(spark):
    a = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t int")
    b = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, 3, "z")], "k int, u int, v string")
    got = {(r.k, r.t): r.v for r in ordered.latest_before(a, b, ["k"], "t", "u", ["v"]).collect()}
    assert got == {(1, 5): "x", (1, 10): "y", (2, 1): None}
    split = ordered.latest_before(a, b, ["k"], "t", "u", ["v"], bucket=lambda t: F.floor(t / 3))
    assert {(r.k, r.t): r.v for r in split.collect()} == got
    strict = {(r.k, r.t): r.v for r in ordered.latest_before(a, b, ["k"], "t", "u", ["v"], strict=True).collect()}
    assert strict[1, 5] is None
    assert [(r.k, r.v) for r in ordered.first_per(b, ["k"], [F.col("u")]).orderBy("k").collect()] == [(1, "x"), (2, "z")]


def test_global_rank_over_many_partitions(spark):
    f = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("s")).repartition(9)
    got = ordered.global_rank(f, [F.desc("s"), F.col("id")]).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 1001))
    assert [(r.s, r.id) for r in got] == sorted(((r.s, r.id) for r in got), key=lambda x: (-x[0], x[1]))


def test_integrity_and_lineage(spark):
    inv = spark.createDataFrame([("r", None), ("n", "r"), ("l", "n"), ("o", "gone")], "id string, parent string")
    assert [tuple(r) for r in joins.missing(inv, inv, "parent", "id", "parent", "id").collect()] == [("parent", "o", "gone")]
    up = {(r.node, r.ancestor): r.depth for r in joins.ancestors(inv, "id", "parent").collect()}
    assert up == {("n", "r"): 1, ("l", "n"): 1, ("l", "r"): 2, ("o", "gone"): 1}
    bad = joins.violations(spark.createDataFrame([(1, 5, 3), (2, 1, None)], "id int, a int, b int"), "t", "id", {"order": "a <= b", "positive": "a > 0"})
    assert {(r.row, r.rule) for r in bad.collect()} == {("1", "order"), ("2", "order")}


def test_containment_finds_inner_and_short_needles(spark):
    n = spark.createDataFrame([(1, "two three four five six seven eight"), (2, "ee"), (3, "absent words are not here at all ever")], "n int, needle string")
    h = spark.createDataFrame([(1, "one two three  four five six seven eight nine"), (2, "xone two three four five six seven eightx"), (3, "")], "d int, t string")
    got = {(r.d, r.n) for r in joins.contained(n, h, "needle", "t").collect()}
    assert got == {(2, 1), (1, 2), (2, 2)}


def test_judgement_policy(spark):
    cols = "claim_id int, fact_id string, proposal string, gates boolean, event_date_error boolean, claim_quote string, fact_quote string, claim string, fact string, fact_is_number boolean"
    rows = [
        (1, "a", "supports", True, False, "2%", "2%", "is 2%", "2%", True),
        (2, "a", "supports", True, False, "3%", "2%", "is 3%", "2%", True),
        (3, "a", "supports", True, False, None, None, "is 3", "2%", True),
        (4, "a", "supports", False, False, None, None, "x", "y", False),
        (5, "a", "supports", True, False, None, None, "x", "y", False),
        (5, "b", "contradicts", True, False, None, None, "x", "z", False),
        (6, "a", "supports", True, True, None, None, "x", "y", False),
        (7, "a", "supports", True, False, "9%", "2%", "is 3%", "2%", True),
    ]
    got = {r.claim_id: (r.verdict, r.status) for r in quality.verdicts(quality.judged(spark.createDataFrame(rows, cols))).collect()}
    assert got == {1: ("verified", "completed"), 2: ("contradicted", "completed"), 3: (None, "error"), 4: ("unverifiable", "completed"), 5: ("unverifiable", "completed"), 6: ("contradicted", "completed"), 7: (None, "error")}


def test_coverage_verdicts(spark):
    flags = ("contradicted", "mentioned", "accurate", "invented", "has_facts", "all_verified", "rules_met", "uncertainty_explicit")
    cases = [((1, 1, 1, 0, 1, 1, 1, 0), "incorrect"), ((0, 0, 1, 0, 1, 1, 1, 0), "missing"), ((0, 1, 0, 0, 1, 1, 1, 0), "incorrect"), ((0, 1, 1, 0, 1, 1, 1, 0), "fulfilled"), ((0, 1, 1, 0, 1, 0, 1, 0), "missing"), ((0, 1, 1, 0, 0, 0, 1, 1), "fulfilled")]
    f = spark.createDataFrame([tuple(map(bool, c)) for c, _ in cases], ", ".join(f"{x} boolean" for x in flags)).select(quality.coverage_verdict().alias("v"))
    assert [r.v for r in f.collect()] == [v for _, v in cases]


def test_reviews(spark):
    rows = [(1, 1, "a", "confirmed", "x"), (1, 2, "b", "confirmed", "y"), (2, 1, "a", "confirmed", "x"), (2, 2, "a", "proposed", "y"), (3, 1, "a", "confirmed", "x"), (3, 2, "c", "adjudicated", "z"), (4, 1, "c", "adjudicated", "z"), (4, 2, "a", "confirmed", "x")]
    got = {r.target_id: (r.state, r.label) for r in review.final_opinions(spark.createDataFrame(rows, "target_id int, seq int, reviewer string, kind string, label string")).collect()}
    assert got == {1: ("conflict", None), 2: ("pending", None), 3: ("adjudicated", "z"), 4: ("confirmed", "x")}


def test_chunks(spark):
    text = "# T\n" + "\n".join(f"line {i} " + "x" * 50 for i in range(60)) + "\n## Next\n" + "y" * 3000
    out = retrieval.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "d int, t string"), "t", size=500, overlap=80).collect()
    assert all(0 < len(r.content) <= 500 for r in out)
    assert [r.page for r in out] == list(range(1, len(out) + 1))
    joined = " ".join(r.content for r in out)
    assert all(f"line {i} " in joined for i in range(60))
    with pytest.raises(ValueError, match="overlap"):
        retrieval.chunks(spark.createDataFrame([(1, "")], "d int, t string"), "t", 10, 10)


def test_markdown_units(spark):
    t = "# A\ntext\n| h |\n|---|\n| 1 |\n\n## B\n| k |"
    rows = retrieval.markdown_units(spark.createDataFrame([(1, t)], "d int, t string"), "d", "t").orderBy("line").collect()
    assert [r.kind for r in rows] == ["heading", "text", "table", "separator", "table", "blank", "heading", "table"]
    assert [r.heading for r in rows] == ["A"] * 6 + ["B"] * 2
    assert [r.header for r in rows] == [None, None, "| h |", "| h |", "| h |", None, None, "| k |"]
    assert all(t[r.start : r.end] == r.content for r in rows)


def test_sources_and_sinks(spark, tmp_path):
    assert files.json_lines(spark, f"{tmp_path}/none.jsonl", "a int").collect() == []
    (tmp_path / "x.jsonl").write_text('{"a": 1, "z": 2}\n')
    assert [r.a for r in files.json_lines(spark, f"{tmp_path}/x.jsonl", "a int").collect()] == [1]
    assert files.unknown_fields(spark, f"{tmp_path}/x.jsonl", ["a"]).first().unknown == ["z"]
    folder = tmp_path / "md"
    folder.mkdir()
    (folder / "a.md").write_text("A")
    (folder / "README.md").write_text("R")
    assert [(r.file_name, r.content) for r in files.corpus(spark, str(folder)).collect()] == [("a.md", "A")]
    expected = spark.createDataFrame([("a.md", hashlib.sha256(b"A").hexdigest()), ("README.md", "0"), ("gone.md", "0")], "file string, sha256 string")
    assert {r.file: (r.status, r.text) for r in files.verified_texts(spark, str(folder), expected).collect()} == {"a.md": ("ok", "A"), "README.md": ("mismatch", None), "gone.md": ("missing", None)}
    assert files.inventory(spark, str(folder)).count() == 2
    files.write_once(spark.range(3), f"{tmp_path}/run/t")
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_once(spark.range(3), f"{tmp_path}/run/t")
    files.freeze(spark, f"{tmp_path}/run")
    with pytest.raises(PermissionError):
        files.write_once(spark.range(3), f"{tmp_path}/run/u")
    req, rec = spark.createDataFrame([("k",)], "q string"), spark.createDataFrame([("k", "v")], "q string, r string")
    assert files.replay(req, rec, "q").first().r == "v"
    with pytest.raises(KeyError):
        files.replay(spark.createDataFrame([("other",)], "q string"), rec, "q")
    files.append_lines(spark.range(1), f"{tmp_path}/log")
    files.append_lines(spark.range(1), f"{tmp_path}/log")
    assert files.json_lines(spark, f"{tmp_path}/log", "id long").count() == 2


@pytest.mark.parametrize("name", ["score_rank_top3", "three_state_rollup", "dense_topk", "quantity_relation"])
def test_queries_run(spark, name):
    out = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert out.columns
    out.collect()


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
