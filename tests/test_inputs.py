"""Inputs of metrics by search, and diagnostics: orders, empty lists, unknown ids."""

from ledgerlark.plans import inputs

S = "sample_id string, invocation_id string, evaluation_status string, supported array<string>, user_input string, response string, reference string, reference_ids array<string>, evidence_ids array<string>, context_ids array<string>, retrieval_ids array<string>"
ALL = ["factual_recall", "faithfulness", "context_recall"]


def tables(spark, samples):
    return (
        spark.createDataFrame(samples, S),
        spark.createDataFrame([("c1", "one"), ("c2", "two")], "context_id string, text string"),
        spark.createDataFrame([("r1", "q1"), ("r2", "q2")], "retrieval_id string, query string"),
        spark.createDataFrame([("r1", 2, "x", "tx", "e"), ("r1", 1, "y", "ty", "e")], "retrieval_id string, rank int, context_id string, text string, evidence_id string"),
    )


def test_inputs_and_diagnostics(spark):
    samples = [("a", "ia", "pending", ALL, "u", "resp", "ref", ["f"], None, ["c2", "gone", "c1"], ["r2", "r1", "gone"]), ("b", "ib", "pending", ALL, "u", "resp", "ref", None, None, None, None), ("c", "ic", "error", ALL, "u", "resp", "ref", None, None, None, ["r1"])]
    t = tables(spark, samples)
    got = {(r.origin_id, r.metric_name): r for r in inputs.metric_inputs(*t).collect()}
    assert set(got) == {("ia", "factual_recall"), ("ia", "faithfulness"), ("ib", "factual_recall"), ("ib", "faithfulness"), ("r1", "context_recall"), ("r2", "context_recall")}
    assert got["ia", "faithfulness"].contexts == ["two", "one"] and got["ia", "faithfulness"].reference is None
    assert (got["ib", "faithfulness"].context_ids, got["ib", "faithfulness"].contexts) == (["received_ib"], ["u"])
    assert (got["r1", "context_recall"].contexts, got["r1", "context_recall"].user_input) == (["ty", "tx"], "q1")
    assert got["r2", "context_recall"].contexts == []
    results = spark.createDataFrame([("a", "faithfulness", "completed", 0.75), (got["r1", "context_recall"].sample_id, "context_recall", "failed", None)], "sample_id string, metric_name string, status string, value double")
    rows = {r.sample_id: r for r in inputs.diagnostics(t[0], t[2], t[3], results).collect()}
    assert [x.retrieval_id for x in rows["a"].searches] == ["r2", "r1"]
    assert (rows["a"].non_support, rows["a"].searches[1].context_recall.status, rows["a"].searches[0].context_recall) == (0.25, "failed", None)
    assert (rows["b"].faithfulness, rows["b"].searches) == (None, [])
    empty = tables(spark, [])
    assert inputs.metric_inputs(*empty).count() == 0 and inputs.diagnostics(empty[0], empty[2], empty[3], results).count() == 0


def test_lists_of_candidates_are_moved_once(spark):
    t = tables(spark, [("a", "ia", "pending", ALL, "u", "resp", "ref", None, None, ["c1"], ["r1", "r1"])])
    results = spark.createDataFrame([("a", "faithfulness", "completed", 0.75)], "sample_id string, metric_name string, status string, value double")
    got = inputs.diagnostics(t[0], t[2], t[3], results)
    assert [[c.context_id for c in x.candidates] for x in got.first().searches] == [["y", "x"], ["y", "x"]]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # Once for the candidates, once for the searches of a sample; no join has the lists between them but that which brings them.
    after = plan[: plan.index("collect_list(struct(rank")]
    assert plan.count("collect_list(") == 2 and "Python" not in plan and "context_recall" not in after[after.index("Join Inner") :].split("Aggregate")[-1]


def test_judged_searches_bring_their_sample_along(spark):
    both = ["context_recall", "faithfulness", "context_precision"]
    rows = [("a", "ia", "pending", both, "u", "resp", "ref", ["f"], ["e1"], ["c1"], ["r1"]), ("b", "ib", "pending", ["factual_recall"], "u", "resp", "ref", None, None, ["c1"], ["r1"]), ("c", "ic", "pending", None, "u", None, None, None, None, None, ["r1"])]
    t = tables(spark, rows)
    got = inputs.metric_inputs(*t)
    assert sorted((r.metric_name, r.origin_id, r.reference, r.reference_ids, r.evidence_ids, r.contexts) for r in got.collect()) == [
        ("context_precision", "r1", "ref", ["f"], ["e", "e"], ["ty", "tx"]), ("context_recall", "r1", "ref", ["f"], ["e", "e"], ["ty", "tx"]),
        ("factual_recall", "ib", "ref", [], [], []), ("faithfulness", "ia", None, [], ["e1"], ["one"]),
    ]
    # Texts to ids, those to samples, lists to searches, searches to those asked: no list of candidates is joined again.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 4
