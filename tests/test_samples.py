"""Metric inputs, values and completeness."""

from ledgerlark.plans import samples

SCHEMA = "sample_id string, user_input string, response string, reference string, retrieved_contexts array<string>, invocation_id string, evaluation_status string, supported array<string>, company_id string"
ALL = list(samples.REQUIRED)


def rows(spark):
    return spark.createDataFrame(
        [
            ("ok", "q", "r", "f", ["c"], "i", "pending", ALL, "x"),
            ("blank", "q", " ", None, [" "], None, "pending", ALL, "y"),
            ("part", "q", "r", "f", None, "i", "pending", ["faithfulness"], "x"),
            ("bad", "q", "r", "f", ["c"], "i", "error", ALL, "x"),
        ],
        SCHEMA,
    )


def test_metric_inputs(spark):
    got = {(r.sample_id, r.metric_name): r.status for r in samples.metric_inputs(rows(spark)).collect()}
    assert len(got) == 15
    assert {got["ok", m] for m in ALL} == {"pending"}
    assert [got["blank", m] for m in ALL] == ["not_applicable", "not_applicable", "not_applicable", "missing", "missing"]
    assert [got["part", m] for m in ALL] == ["unsupported", "unsupported", "missing", "unsupported", "unsupported"]


def test_zero_and_null_are_apart(spark):
    results = spark.createDataFrame([("ok", "faithfulness", "completed", 0.0), ("ok", "factual_recall", "error", 0.7), ("ok", "context_recall", "completed", 0.1)], "sample_id string, metric_name string, status string, value double")
    searches = spark.createDataFrame([("ok", "context_recall", "completed", 0.2), ("ok", "context_recall", "completed", 0.4), ("blank", "context_recall", "completed", 1.0), ("blank", "context_recall", "error", None)], "sample_id string, metric_name string, status string, value double")
    wide = samples.values(rows(spark), results, searches)
    got = {(r.sample_id, r.metric_name): (r.value if r.value is None else round(r.value, 6), r.status) for r in samples.long_values(wide).collect()}
    assert got["ok", "faithfulness"] == (0.0, "completed")
    assert got["ok", "factual_recall"] == (None, "error")
    assert got["ok", "context_recall"] == (0.3, "completed")
    assert got["blank", "context_recall"] == (None, "partial")
    assert got["ok", "factual_precision"] == (None, "missing")
    assert got["part", "factual_precision"] == (None, "unsupported")


def test_completeness_and_status(spark):
    part = lambda r: spark.createDataFrame(r, "sample_id string, status string")
    got = samples.completeness(rows(spark), [part([("ok", "completed"), ("blank", "not_applicable")]), part([("blank", "error"), ("part", None)])])
    assert {r.sample_id: r.complete for r in got.collect()} == {"ok": True, "blank": False, "part": False, "bad": True}
    assert tuple(samples.run_status(got).first()) == (4, 2, "partial")
    assert samples.run_status(got.limit(0)).first().status == "failed"


def test_rule_values(spark):
    checks = spark.createDataFrame([("rule:a", "x", "pass"), ("rule:b", "x", "fail"), ("rule:c", None, "pass"), ("other", "x", "fail"), ("rule:d", "y", "error"), ("rule:e", "x", "not_applicable")], "check_id string, company_id string, status string")
    got = {r.sample_id: (r.rule_conformance and round(r.rule_conformance, 6), r.rule_error_count) for r in samples.rule_values(checks, rows(spark)).collect()}
    assert got == {"ok": (0.666667, 1), "part": (0.666667, 1), "bad": (0.666667, 1), "blank": (None, None)}
