import json

from pyspark.sql import functions as F

from ledgerlark import evaluation_queries
from ledgerlark.plans import grounding, paired, quality, research, review, scoring, support

CLAIM = "claim_id int, claim string, company_id string"
DOC = "claim_id int, document_id string, text string, company_ids array<string>"
CMP = "claim_id int, document_id string, relation string, quote string, start int, end int, same_entity boolean, same_time boolean, same_conditions boolean, claim_quantity string, document_quantity string"


def test_support_of_claims(spark):
    claims = [(i, "share is 12%" if i in (6, 7, 8, 9) else "sales grew", "c1") for i in range(1, 14)]
    docs = [(i, "a", "ab cd 12%", None) for i in range(1, 12)] + [(4, "b", "ab", []), (5, "b", "ab", ["c2"]), (12, "a", None, None)]
    fine = ("supported", "cd", 3, 5, True, True, True, None, None)
    rows = {
        (1, "a"): fine, (2, "a"): ("supported", "xx", 3, 5, True, True, True, None, None), (3, "a"): ("supported", "cd", 3, 5, True, False, True, None, None),
        (4, "a"): fine, (4, "b"): ("contradicted", "ab", 0, 2, True, True, True, None, None), (5, "a"): fine, (5, "b"): ("contradicted", "ab", 0, 2, True, True, True, None, None),
        (6, "a"): ("supported", "12%", 6, 9, True, True, True, "12%", "12%"), (7, "a"): ("contradicted", "12%", 6, 9, True, True, True, "12%", "12%"), (8, "a"): fine, (9, "a"): ("supported", "12%", 6, 9, True, True, True, "13%", "12%"),
        (10, "z"): fine, (11, "a"): ("unsupported", None, None, None, None, None, None, None, None), (12, "a"): fine,
    }
    c = support.compared(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(docs, DOC), spark.createDataFrame([(*k, *v) for k, v in rows.items()], CMP)).cache()
    got = {r.claim_id: r for r in support.support(spark.createDataFrame(claims, CLAIM), c).collect()}
    want = {1: "supported", 2: None, 3: "unsupported", 4: "unsupported", 5: "supported", 6: "supported", 7: "contradicted", 8: None, 9: None, 10: None, 11: "unsupported", 12: None, 13: "unsupported"}
    assert {k: r.support for k, r in got.items()} == want
    assert got[4].conflict == ["a", "b"] and got[5].supporting == ["a"] and got[4].supporting == [] and got[13].status == "completed"
    why = {(r.claim_id, r.document_id): r.problem for r in c.filter("problem is not null").collect()}
    assert why == {(2, "a"): "quote is not at its offsets", (8, "a"): "quantities are not quoted", (9, "a"): "quantities are not in the quotes", (10, "a"): "not compared", (10, "z"): "not a document of the claim", (12, "a"): "quote is not at its offsets"}
    assert {(r.claim_id, r.start) for r in support.proofs(c).filter("claim_id in (4, 11)").collect()} == {(4, 3), (4, 0)}


def test_support_of_nothing(spark):
    claims = spark.createDataFrame([], CLAIM)
    c = support.compared(claims, spark.createDataFrame([], DOC), spark.createDataFrame([], CMP))
    assert support.support(claims, c).count() == 0
    twice = [(1, "a", "supported", "[1]", 0, 3, True, True, True, None, None)] * 2
    one = spark.createDataFrame([(1, "x", None)], CLAIM)
    docs = spark.createDataFrame([(1, "a", "[1] is", None)], DOC)
    assert [r.problem for r in support.compared(one, docs, spark.createDataFrame(twice, CMP)).collect()] == ["compared twice"]
    assert [r.problem for r in support.compared(one, docs, spark.createDataFrame(twice[:1], CMP)).collect()] == ["a marker supports nothing"]


LEDGER = "target_id string, seq long, review_id string, previous_id string, reviewer string, status string, human string, resolves array<string>, provenance string, reviewed_at long, evaluation_id string, target_kind string, source_sha256 string, automatic string"
TARGET = "target_id string, evaluation_id string, target_kind string, source_sha256 string, automatic string, label_space array<string>"


def entry(seq, human='"yes"', target="t", review=None, previous=None, by=None, status="confirmed", resolves=(), kind="claim", source="h", provenance="human"):
    return (target, seq, review or f"v{seq}", previous, by or f"r{seq}", status, human, list(resolves), provenance, seq, "e", kind, source, "{}")


def decided(spark, rows, targets=(("t", "claim", ['"yes"', '"no"']), ("m", "metric", None), ("x", "extraction", []))):
    t = [(i, "e", k, "h", "{}", s) for i, k, s in targets]
    got = review.decision_problems(spark.createDataFrame(rows, LEDGER), spark.createDataFrame(t, TARGET)).collect()
    return {r.seq: r.problem for r in got}


def test_reviews_fit_their_targets(spark):
    rows = [entry(1, '"maybe"'), entry(2, '"yes"', target="none"), entry(3, '{"error": true}', "m", kind="metric"), entry(4, '{"error": false, "score": true}', "m", previous="v3", kind="metric"), entry(5, "nonsense", "m", previous="v4", kind="metric"), entry(6, None, "m", previous="v5", kind="metric")]
    rows += [entry(7, '{"facts": [], "kinds": []}', "x", kind="extraction"), entry(8, '{"facts": ["a"], "kinds": ["rumour"]}', "x", previous="v7", kind="extraction"), entry(9, "[]", "x", previous="v8", kind="extraction", source="other"), entry(10, '"yes"', "t", "v3", previous="v1")]
    assert decided(spark, rows) == {1: "label outside the label space", 2: "unknown target", 4: "score outside 0 to 1", 5: "no error flag", 6: "no error flag", 8: "invalid facts or kinds", 9: "another automatic result or source", 10: "review id taken"}
    assert decided(spark, []) == {}


def test_adjudications(spark):
    rows = [entry(1, by="a"), entry(2, '"no"', by="b", previous="v1"), entry(3, '"no"', by="a", previous="v2")]
    final = lambda *ids, by="c": entry(4, '"no"', previous="v3", by=by, status="adjudicated", resolves=ids)
    assert decided(spark, [*rows, final("v1", "v2")]) == {4: "current opinion not resolved"}
    assert decided(spark, [*rows, final("v2", "v3")]) == {4: "no disagreement"}
    assert decided(spark, [*rows, final("v1", "v2", "v3")]) == {}
    assert decided(spark, [*rows, final("v1", "v2", "v3", "v9")]) == {4: "too few independent reviewers"}
    assert decided(spark, [*rows, final("v1", "v2", "v3", by="a")]) == {4: "adjudicator is a reviewer"}
    after = entry(5, by="a", previous="v4")
    assert decided(spark, [*rows, final("v1", "v2", "v3"), after]) == {}
    draft = [entry(1, by="a", status="proposed"), entry(2, '"no"', by="b", previous="v1"), entry(3, by="d", previous="v2")]
    assert decided(spark, [*draft, final("v2", "v3")]) == {} and decided(spark, [*draft, final("v1", "v2", "v3")]) == {4: "resolves a proposal"}


def test_ledger_against_a_plain_fold(spark):
    """Random ledgers, judged row by row by a plain reading of the rules."""
    import random

    rng = random.Random(7)
    rows = []
    for t in range(40):
        last = None
        for i in range(rng.randint(1, 7)):
            seq = t * 10 + i
            status = rng.choice(["proposed", "confirmed", "confirmed", "adjudicated"])
            past = [f"v{t * 10 + j}" for j in range(i)]
            resolves = rng.sample(past, rng.randint(max(0, len(past) - 2), len(past))) if status == "adjudicated" or rng.random() < 0.1 else []
            rows.append(entry(seq, rng.choice(['"yes"', '"no"']), f"t{t}", previous=last if rng.random() < 0.9 else "v?", by=rng.choice("abcd"), status=status, resolves=resolves, provenance="human" if rng.random() < 0.95 else "synthetic"))
            last = f"v{seq}"
    want = {}
    for t in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == t), key=lambda r: r[1])
        for i, r in enumerate(mine):
            past = mine[:i]
            votes = {p[4]: p[2] for p in past if p[5] != "proposed"}
            took = [p for p in past if p[2] in r[7]]
            if r[8] != mine[0][8]:
                p = "mixed provenance"
            elif r[3] != (past[-1][2] if past else None):
                p = "not linked to the latest revision"
            elif r[5] != "adjudicated":
                p = "only adjudications resolve" if r[7] else None
            elif set(votes.values()) - set(r[7]):
                p = "current opinion not resolved"
            elif len({x[4] for x in took}) < 2:
                p = "too few independent reviewers"
            elif len({x[6] for x in took}) < 2:
                p = "no disagreement"
            elif r[4] in {x[4] for x in took}:
                p = "adjudicator is a reviewer"
            else:
                p = "resolves a proposal" if any(x[5] == "proposed" for x in took) else None
            if p:
                want[r[1]] = p
    got = review.append_problems(spark.createDataFrame(rows, LEDGER).withColumnRenamed("human", "label")).collect()
    assert {r.seq: r.problem for r in got} == want and len(set(want.values())) > 5


SIDE = "evaluation_id string, run_id string, mode string, dataset string, references string, evaluator string, frozen boolean, inputs string, evidence string, content string, intact boolean, status string, package boolean, package_mode string, factual_configuration string, grounding_configuration string, coverage_configuration string"


def pairs(spark, *rows):
    names = [c.split() for c in SIDE.split(", ")]
    plain = {"mode": "live", "dataset": "d", "references": "r", "evaluator": "v", "frozen": True, "inputs": "i", "evidence": "x", "content": "c", "intact": True, "status": "completed", "package": True, "package_mode": "live"}
    out = []
    for i, change in enumerate(rows):
        row = [i]
        for s in ("before", "after"):
            values = plain | {"evaluation_id": f"{s}{i}", "run_id": f"{s}{i}"} | {k.removeprefix(s + "_"): v for k, v in change.items() if k.startswith(s)}
            row += [values.get(n) for n, _ in names]
        out.append(tuple(row))
    return spark.createDataFrame(out, "pair_id int, " + ", ".join(f"{s}_{n} {k}" for s in ("before", "after") for n, k in names))


def test_comparisons(spark):
    apart = {"before_mode": "isolated", "after_mode": "isolated", "after_evidence": "y"}
    p = pairs(spark, {}, {"after_run_id": "before1"}, {"after_dataset": None}, {"after_frozen": None}, apart, apart | {"after_content": "z"}, apart | {"before_intact": False}, {"after_inputs": "j", "after_status": "partial"})
    got = {r.pair_id: (r.problem, r.changed, r.complete) for r in paired.comparisons(p).collect()}
    assert got == {0: (None, False, True), 1: ("same run", None, None), 2: ("another dataset", None, None), 3: ("not frozen", None, None), 4: (None, True, True), 5: ("isolated content differs", None, None), 6: ("isolated run not intact", None, None), 7: (None, True, False)}


def test_reevaluation(spark):
    p = pairs(spark, {"after_evaluator": "w"}, {"before_grounding_configuration": "g"}, {"after_package": None}, {"after_package_mode": "isolated"}, {"after_evaluation_id": "empty"})
    problems = lambda reason, judges: {r.pair_id: r.problem for r in paired.reevaluation_problems(p, reason, judges).collect()}
    assert set(problems(" ", ()).values()) == {"no reason"}
    assert problems("new", ("factual",)) == {0: None, 1: "before: grounding judge dropped", 2: "after: no package kept", 3: "after: isolated package", 4: None}
    samples = spark.createDataFrame([(f"{s}{i}", 0.5) for s in ("before", "after") for i in range(4)] + [("before4", 0.1)], "evaluation_id string, x double")
    scorer = lambda s: s.select("evaluation_id", "previous_evaluation_id", F.lit("m").alias("metric_name"), F.lit("completed").alias("status"), F.col("x").alias("value"))
    out, results, refused = paired.reevaluate(p, samples, scorer, "v9", "new", ("factual",))
    rows = {r.pair_id: r for r in out.collect()}
    assert {r.pair_id for r in refused.collect()} == {1, 2, 3} and set(rows) == {0, 4}
    assert rows[0].before_previous_evaluation_id == "before0" and rows[0].before_evaluation_id != "before0" and rows[4].after_status == "missing"
    assert {r.evaluation_id for r in results.collect()} == {rows[0].before_evaluation_id, rows[0].after_evaluation_id, rows[4].before_evaluation_id}
    assert {r.pair_id: (r.problem, r.complete) for r in paired.comparisons(out).collect()} == {0: (None, True), 4: (None, False)}


def test_settings_of_one_side(spark):
    a = spark.createDataFrame([("k", "x", 1), ("only", "y", None)], "k string, f string, g int")
    b = spark.createDataFrame([("k", "x", "new"), ("late", None, None)], "k string, f string, h string")
    got = {(r.k, r.field): (json.loads(r.before), json.loads(r.after)) for r in paired.changed_settings(a, b, "k").collect()}
    assert got == {("k", "g"): ({"g": 1}, {}), ("k", "h"): ({}, {"h": "new"}), ("only", "f"): ({"f": "y"}, {})}


def test_coverage_beside_recall(spark):
    samples = spark.createDataFrame([("s1", "c1", "final"), ("s2", "c2", "final"), ("s3", None, None)], "sample_id string, case_id string, stage string")
    results = spark.createDataFrame([("s1", "factual_recall", 1, "completed", 0.5), ("s1", "factual_recall", 2, "error", None), ("s2", "other", 1, "completed", 1.0)], "sample_id string, metric_name string, position int, status string, value double")
    rows = spark.createDataFrame([("s1", "c1", "o", "p", "final", "i1", True, "completed", "fulfilled")], "sample_id string, case_id string, company_id string, section_id string, stage string, item_id string, applicable boolean, status string, verdict string")
    items = rows.select("item_id", "company_id", "section_id", "applicable")
    cases = spark.createDataFrame([("c1", ["i1"])], "case_id string, required_item_ids array<string>")
    got = {r.sample_id: r for r in quality.beside_recall(samples, results, quality.coverage_scopes(rows, items), cases).collect()}
    assert got["s1"].factual_recall.status == "error" and got["s1"].required_information.coverage == 1.0 and got["s1"].required_item_ids == ["i1"]
    assert got["s2"].factual_recall is None and got["s2"].required_information is None and got["s3"].required_item_ids == []


def test_company_research(spark):
    own = sorted({c for _, c in research.COMPANY_SUMMARIES.values() if c})
    text = "창업팀은 충분한 경험을 갖추고 있으며 양산을 준비하고 있고 고객과의 계약도 여러 건 진행하고 있다."
    profiles = spark.createDataFrame([("a", "Seed", None, None, None, ["r"], *[text] * len(own)), ("b", None, "칩", "p", "q", None, *[None] * len(own))], "name string, stage string, industry string, product_summary string, customer_focus string, references array<string>, " + ", ".join(f"{c} string" for c in own))
    first, second = "시장은 빠르게 성장하고 있고 투자도 함께 늘어나고 있는 상황으로 확인되었다.", "제품은 양산 단계에 있고 고객 검증도 여러 건 마친 상태로 확인되었다."
    evidence = spark.createDataFrame([("a", 0, "Market Attractiveness", "t", "u", first), ("a", 1, "Technology & Product", "t", "u", ""), ("a", 2, "Technology & Product", "t", "u", second), ("a", 3, None, None, None, None)], "name string, pos int, category string, title string, url string, content string")
    got = {r.name: r for r in research.company_research(profiles, evidence, "name").collect()}
    assert got["a"].company_overview == second and got["a"].product_and_technology == second and got["a"].team_summary == text and got["a"].references[0] == "t - u"
    assert got["b"].team_summary == "" and got["b"].references == [] and "p" in got["b"].company_overview


def test_companies_that_share_evidence(spark):
    own = sorted({c for _, c in research.COMPANY_SUMMARIES.values() if c})
    text = "창업팀은 충분한 경험을 갖추고 있으며 양산을 준비하고 있고 고객과의 계약도 여러 건 진행하고 있다."
    profiles = spark.createDataFrame([(n, k, "Seed", None, None, None, ["r"], *[text] * len(own)) for n, k in (("a", 1), ("b", 1), ("c", None), ("d", 2))], "name string, market int, stage string, industry string, product_summary string, customer_focus string, references array<string>, " + ", ".join(f"{c} string" for c in own))
    evidence = spark.createDataFrame([(1, i, "Team & Founders", f"t{i % 3}", "u", text.replace("창업팀", f"창업팀{i}")) for i in range(9)], "market int, pos int, category string, title string, url string, content string")
    listed = {r.name: r for r in research.company_research(profiles, evidence, "name", by="market").collect()}
    assert listed["a"].team_summary == listed["b"].team_summary == text.replace("창업팀", "창업팀0") and listed["c"].team_summary == text
    assert {k: r.references for k, r in listed.items()} == {"a": ["t0 - u", "t1 - u", "t2 - u"], "b": ["t0 - u", "t1 - u", "t2 - u"], "c": ["r"], "d": ["r"]}
    counted = {r.name: r.n_references for r in research.company_research(profiles, evidence, "name", by="market", counted=True).collect()}
    assert counted == {"a": 3, "b": 3, "c": 1, "d": 1}


def test_dimensions(spark):
    c = spark.createDataFrame([("d", "a", "{company}", 1), ("d", "b", None, 2), ("d", "c", "z", 3)], "domain string, company string, context string, pos int")
    asked = scoring.dimension_requests(c, dict.fromkeys(scoring.DIMENSIONS, "{domain} {company} {context}"))
    assert {r.request for r in asked.collect()} == {"d a {company}", "d b ", "d c z"} and asked.count() == 18
    replies = asked.filter("not (company = 'c' and dimension = 'risk')").select("company", "dimension", F.when(F.col("company") == "b", 5).otherwise(3).alias("score"))
    got = {r.company: (r["rank"], r.total_score, r.problem) for r in scoring.rank_companies(c, replies, "pos").collect()}
    assert got == {"a": (2, 18, None), "b": (1, 30, None), "c": (None, None, "no score: risk")}
    again = replies.unionByName(replies.filter("company = 'a'"))
    assert scoring.rank_companies(c, again, "pos").filter("company = 'a'").first().problem.startswith("repeated: technology")


def test_samples_are_folded_in_tasks_of_a_fixed_size(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 500).alias("sample_id"), (F.col("id") % 500 % 7).alias("case_id"), (F.col("id") % 3).alias("company_id"), F.lit("x").alias("section_id"), F.lit("s").alias("stage"), (F.col("id") % 3).cast("string").alias("item_id"), F.lit(True).alias("applicable"), F.lit("completed").alias("status"), F.when(F.col("id") % 2 == 0, "fulfilled").otherwise("missing").alias("verdict"))
    items = rows.select("item_id", "company_id", "section_id", "applicable").distinct()
    asked = []
    monkeypatch.setattr(quality, "tasks_of", lambda frame: asked.append(frame.count()) or 7)
    out = quality.coverage_scopes(rows, items)
    assert asked == [3000]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [sample_id" in plan and ", 7" in plan
    assert {r.scope: r["count"] for r in out.groupBy("scope").count().collect()} == {"sample": 500, "case": 7, "company": 3, "section": 1, "company_section": 3, "report": 1}


def test_grounding_of_samples_in_tasks_of_a_fixed_size(spark, monkeypatch):
    samples = spark.createDataFrame([("a", "pending"), ("b", "error"), ("c", "pending")], "sample_id string, evaluation_status string")
    results = spark.createDataFrame([("a", b, "completed", b == "source_evidence") for b in grounding.BASES] + [("b", "source_evidence", "missing", None)], "sample_id string, basis string, status string, grounded boolean")
    citations = spark.createDataFrame([("k1", "a", "completed", "supported")], "claim_id string, sample_id string, status string, verdict string")
    claims = spark.createDataFrame([("k1", "a"), ("k2", "a"), ("k3", "b")], "claim_id string, sample_id string")
    monkeypatch.setattr(grounding, "tasks_of", lambda frame, rows: 5)
    out = grounding.grounding_summary(samples, results, citations, claims)
    assert {(r.sample_id, r.basis, r.total, r.grounded, r.n_supported, r.n_uncited, r.grounding_status, r.citation_status) for r in out.collect()} == {
        ("a", "source_evidence", 1, 1, 1, 1, "completed", "completed"), ("a", "delivered_context", 1, 0, 1, 1, "completed", "completed"),
        ("b", "source_evidence", 1, 0, 0, 1, "partial", "partial"), ("b", "delivered_context", 0, 0, 0, 1, "partial", "partial"),
        ("c", "source_evidence", 0, 0, 0, 0, "not_applicable", "not_applicable"), ("c", "delivered_context", 0, 0, 0, 0, "not_applicable", "not_applicable"),
    }
    assert ", 5" in out._jdf.queryExecution().optimizedPlan().toString()


def test_dataset_tables_are_made_once(spark):
    got = evaluation_queries.dataset_violations(spark, "/root/testdata/sf0.001")
    assert not [f for f in got.inputFiles() if "lineitem" in f]
