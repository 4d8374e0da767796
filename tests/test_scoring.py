"""Golden values of the scoring path."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlark.plans import scoring
from ledgerlark.sources import files

ORDER = ("team", "market", "technology", "traction", "competition", "risk")
# name, stage, signals, market score, risk score, baseline, target, grade
GOLDEN = [
    ("NeuroSilicon", "Series A", (5, 5, 4, 4, 4, 3), 4, 3, 84, 88, "High Priority DD"),
    ("TensorForge", "Series A", (4, 4, 4, 3, 4, 3), 4, 3, 79, 76, "Selective DD"),
    ("PhotonCore", "Seed", (4, 4, 3, 2, 4, 2), 3, 4, 69, 73, "Selective DD"),
    ("AxiomChip", "Series B", (4, 5, 4, 5, 3, 3), 5, 3, 86, 86, "High Priority DD"),
    ("SynthexAI", "Seed", (3, 4, 2, 1, 2, 1), 2, 5, 49, 58, "No DD"),
    ("HelioMatrix", "Series A", (4, 4, 3, 3, 3, 3), 4, 3, 72, 69, "Selective DD"),
    ("QuantEdge", "Series B", (4, 4, 4, 4, 3, 3), 4, 3, 77, 77, "Selective DD"),
    ("NanoFabric", "Seed", (3, 3, 3, 1, 3, 2), 2, 4, 55, 59, "Watchlist"),
    ("VectorPulse", "Series A", (4, 3, 3, 3, 3, 3), 3, 3, 65, 65, "Selective DD"),
    ("CoreWeaveX", "Series C+", (5, 5, 4, 5, 4, 3), 5, 3, 88, 88, "High Priority DD"),
]


@pytest.fixture(scope="module")
def companies(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "companies.json"
    path.write_text(json.dumps({"companies": [{"name": n, "stage": s, **{f"{x}_signal": v for x, v in zip(ORDER, sig, strict=True)}} for n, s, sig, *_ in GOLDEN]}))
    return files.entities(spark, str(path))


def test_golden_scores(companies):
    rows = scoring.score(companies).orderBy("input_pos").collect()
    assert [(r.name, r.market_score, r.risk_score, r.final_score, r.grade) for r in rows] == [(g[0], g[3], g[4], g[5], g[7]) for g in GOLDEN]
    target = scoring.score(companies, scoring.TARGET).orderBy("input_pos").collect()
    assert [r.final_score for r in target] == [g[6] for g in GOLDEN]


def test_ranking_is_stable_and_branches(companies):
    ranked = scoring.rank(scoring.score(companies), "input_pos").orderBy("rank").collect()
    assert [r.name for r in ranked if r.passed] == ["CoreWeaveX", "AxiomChip", "NeuroSilicon", "TensorForge", "QuantEdge", "HelioMatrix", "PhotonCore", "VectorPulse"]
    assert [r.name for r in ranked if r.top] == ["CoreWeaveX", "AxiomChip", "NeuroSilicon"]
    assert [r.name for r in ranked if r.watchlist] == ["NanoFabric"]
    assert {r.branch for r in ranked} == {"top3"}
    hold = scoring.rank(scoring.score(companies).filter("final_score < 65"), "input_pos").collect()
    assert {r.branch for r in hold} == {"hold"}


def test_ties_keep_input_order(spark):
    e = spark.createDataFrame([(i, n, "Seed", 3, 3, 3, 3, 3, 3) for i, n in enumerate("ZACB")], "pos int, name string, stage string, technology_signal int, market_signal int, traction_signal int, team_signal int, competition_signal int, risk_signal int")
    policy = scoring.Policy(threshold=60)
    assert [r.name for r in scoring.top(scoring.score(e, policy), "pos", policy).orderBy("rank").collect()] == ["Z", "A", "C"]


@pytest.mark.parametrize(("stage", "baseline", "target"), [("Seed", 60, 68), ("Series A", 60, 62), ("Series B", 60, 58), ("Series C+", 60, 56)])
def test_stage_cases(spark, stage, baseline, target):
    e = spark.createDataFrame([(1, stage, 3, 5, 1, 3, 3, 3)], "pos int, stage string, technology_signal int, market_signal int, traction_signal int, team_signal int, competition_signal int, risk_signal int")
    assert scoring.score(e).first().final_score == baseline
    assert scoring.score(e, scoring.TARGET).first().final_score == target


def test_extremes_grades_and_unknown_stage(spark):
    rows = [(i, s, v, v, v, v, v, 6 - v) for i, s in enumerate(scoring.STAGE_WEIGHTS) for v in (1, 3, 5)] + [(9, "Series Z", 3, 3, 3, 3, 3, 3)]
    e = spark.createDataFrame(rows, "pos int, stage string, technology_signal int, market_signal int, traction_signal int, team_signal int, competition_signal int, risk_signal int")
    got = scoring.score(e).collect()
    assert {(r.technology_signal, r.final_score) for r in got if r.stage != "Series Z"} == {(1, 20), (3, 60), (5, 100)}
    assert [r.final_score for r in got if r.stage == "Series Z"] == [None]
    from ledgerlark.functions.numeric import grade

    g = spark.createDataFrame([(x,) for x in (49, 50, 64, 65, 79, 80)], "s int").select(grade(F.col("s")).alias("g"))
    assert [r.g for r in g.collect()] == ["No DD", "Watchlist", "Watchlist", "Selective DD", "Selective DD", "High Priority DD"]


def test_weights_must_sum_to_one(spark):
    bad = scoring.Policy(weights={"Seed": dict.fromkeys(scoring.SIGNALS, 0.2)})
    with pytest.raises(ValueError, match="sum"):
        scoring.weight_table(spark, bad)


def test_rule_checks_find_a_changed_value(companies):
    scored = scoring.score(companies).withColumn("final_score", F.when(F.col("name") == "QuantEdge", 90).otherwise(F.col("final_score")))
    bad = scoring.rule_checks(scored, "name").filter("result <> 'pass'").collect()
    assert [(r.name, r.check_id) for r in bad] == [("QuantEdge", "score_formula")]
    missing = scoring.rule_checks(scoring.score(companies.withColumn("risk_signal", F.lit(None).cast("int"))), "name")
    assert {r.conformance for r in scoring.conformance(missing, ["name"]).collect()} == {None}


def test_sum_scale(spark):
    e = spark.createDataFrame([(1, 19, 0), (2, 20, 0), (3, 25, 0), (4, 25, 0), (5, 30, 0)], "pos int, a int, b int")
    got = {r.pos: (r.rank, r.decision) for r in scoring.sum_scale(e, ["a", "b"], "pos").collect()}
    assert got == {1: (None, "hold: below the threshold"), 2: (None, "hold: outside the top"), 3: (2, "selected"), 4: (3, "selected"), 5: (1, "selected")}


def test_evidence_signal(spark):
    ents = spark.createDataFrame([("a", 3), ("b", 4), ("c", 1), ("d", 5)], "k string, fallback int")
    ev = spark.createDataFrame([("a", "Pilot customer"), ("a", "new funding"), ("b", "short"), ("c", "x" * 90), ("c", "y" * 81)], "k string, text string")
    got = {r.k: r.signal for r in scoring.evidence_signal(ents, ev, ["k"], "text", "fallback").collect()}
    assert got == {"a": 4, "b": 3, "c": 3, "d": 5}


def test_research_notes(companies):
    got = {r.name: r.research for r in scoring.research_notes(scoring.score(companies)).collect()}
    assert got["NeuroSilicon"] == []
    assert got["SynthexAI"] == ["technology", "market"]
