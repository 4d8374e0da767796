"""Rule checks: a clean run passes whole, and each altered record changes its own checks."""

import pytest

from ledgerlark.plans import rules, scoring

SIGNALS = {"A": ("Seed", 5, 5, 4, 5, 4, 1), "B": ("Series A", 4, 4, 4, 4, 4, 2), "C": ("Seed", 3, 3, 3, 3, 3, 3)}
REPORT = """# Report
| Rank | Company | DD Score |
| --- | --- | --- |
| 1 | A | {a} |
| 2 | B | {b} |

|Company|Stage|Final Score|Recommendation|Risk|
|:-|-|-|-|-|
| A | Seed | {a} | High Priority DD | 5 |
| B | Series A | {b} | High Priority DD | 4 |
| C | Seed | {c} | Watchlist | 3 |
Company | Final Score, `65`점 이상
| D | 3 |
"""


@pytest.fixture(scope="module")
def base(spark):
    rows = [(n, s, i, *v) for i, (n, (s, *v)) in enumerate(SIGNALS.items())]
    scored = scoring.score(spark.createDataFrame(rows, "company string, stage string, pos long, " + ", ".join(f"{x}_signal int" for x in scoring.SIGNALS)))
    d = {r.company: r.asDict() for r in scored.collect()}
    decisions = [(1, n, r["stage"], *[r[c] for x in rules.EVALUATED for c in (f"{x}_score" if x in ("market", "risk") else f"{x}_signal", f"{x}_part")], r["final_score"], r["grade"]) for n, r in d.items()]
    report = REPORT.format(**{n.lower(): r["final_score"] for n, r in d.items()})
    return {
        "runs": [(1, 65, 80, 3, "top3", "top3", 65, 80, report)],
        "decisions": decisions,
        "profiles": [(1, *r) for r in rows],
        "observed": [(1, s, *[w[x] for x in scoring.SIGNALS]) for s, w in scoring.STAGE_WEIGHTS.items()],
        "lists": [(1, "passed_companies", 0, "A"), (1, "passed_companies", 1, "B"), (1, "top_companies", 0, "A"), (1, "top_companies", 1, "B"), (1, "watchlist_companies", 0, "C")],
    }


SCHEMAS = {
    "runs": "run_id long, threshold int, high int, top_k int, branch string, ranking_branch string, ranking_threshold int, ranking_high int, report string",
    "decisions": "run_id long, company string, stage string, " + ", ".join(f"{x}_score int, {x}_weighted double" for x in rules.EVALUATED) + ", final_score int, recommendation string",
    "profiles": "run_id long, company string, stage string, pos long, " + ", ".join(f"{x}_signal int" for x in scoring.SIGNALS),
    "observed": "run_id long, stage string, " + ", ".join(f"w_{x} double" for x in scoring.SIGNALS),
    "lists": "run_id long, field string, pos long, company string",
}


def checked(spark, base, **changed):
    t = {k: spark.createDataFrame(changed.get(k, base[k]), SCHEMAS[k]) for k in SCHEMAS}
    out = rules.check_runs(t["runs"], t["decisions"], t["lists"], scoring.BASELINE, t["profiles"], t["observed"]).collect()
    assert len({(r.run_id, r.company, r.check_id) for r in out}) == len(out)
    return out


def bad(rows):
    return {(r.company, r.check_id, r.result) for r in rows if r.result not in ("pass", "not_applicable")}


def put(rows, i, at, value):
    return [tuple(value if (j, k) == (i, at) else v for k, v in enumerate(r)) for j, r in enumerate(rows)]


def test_a_clean_run_passes(spark, base):
    rows = checked(spark, base)
    assert bad(rows) == set()
    ids = {(r.company, r.check_id) for r in rows}
    assert {("A", "report_score_2"), ("C", "report_score_1"), ("A", "report_rank_1"), ("B", "report_dimension_Risk_2"), (None, "report_top3_order")} <= ids
    assert ("C", "report_score_2") not in ids and ("A", "report_rank_2") not in ids


def test_each_altered_record(spark, base):
    """Every alteration is a run of its own; all are checked at once."""
    text = base["runs"][0][-1]
    report = lambda t: put(base["runs"], 0, 8, t)
    fields = SCHEMAS["decisions"].split(", ")
    score, grade = fields.index("final_score int"), fields.index("recommendation string")
    cases = [
        (dict(decisions=put(base["decisions"], 1, score, 70)), {("B", "score_formula", "fail")}),
        (dict(decisions=put(base["decisions"], 1, score, 101)), {("B", "score_formula", "fail"), ("B", "total_range", "fail")}),
        (dict(decisions=put(base["decisions"], 0, grade, "x")), {("A", "grade", "fail")}),
        (dict(decisions=put(base["decisions"], 2, 3, 6)), {("C", "dimension_range", "fail"), ("C", "decision_input", "error"), (None, "ranking_input", "error")}),
        (dict(decisions=put(base["decisions"], 2, 3, None)), {("C", "decision_input", "error"), (None, "ranking_input", "error")}),
        (dict(decisions=put(base["decisions"], 2, 2, "Seed B")), {("C", "decision_input", "error"), (None, "ranking_input", "error")}),
        (dict(decisions=base["decisions"] + base["decisions"][:1]), {(None, "input", "error")}),
        (dict(decisions=[]), {(None, "input", "error")}),
        (dict(runs=put(base["runs"], 0, 1, 19)), {(None, "input", "error")}),
        (dict(runs=put(base["runs"], 0, 3, None)), {(None, "input", "error")}),
        (dict(profiles=base["profiles"] + [(1, "D", "Seed", 3, 1, 1, 1, 1, 1, 1)]), {(None, "candidate_order", "error")}),
        (dict(observed=[]), {(n, "stage_weights", "error") for n in "ABC"}),
        (dict(observed=base["observed"][1:]), {(n, x, "fail") for n in "AC" for x in ("stage_weights", "weight_sum")}),
        (dict(lists=base["lists"][:-1]), {(None, "ranking_watchlist_companies", "fail")}),
        (dict(lists=base["lists"] + [(1, "top_companies", 2, "C")]), {(None, "ranking_top_companies", "fail")}),
        (dict(runs=put(base["runs"], 0, 4, None)), {(None, "recommendation_route", "fail")}),
        (dict(runs=report(" \n")), {(None, "report_numeric", "error")}),
        (dict(runs=report(None)), {(None, "report_numeric", "error")}),
        (dict(runs=report(text.replace("| 2 | B", "| 1 | B"))), {("B", "report_rank_1", "fail")}),
        (dict(runs=report(text.replace("`65`", "`60`"))), {(None, "report_threshold", "fail")}),
        (dict(runs=report(text.replace("| Watchlist | 3 |", "| No DD | 2 |"))), {("C", "report_grade_1", "fail"), ("C", "report_dimension_Risk_1", "fail")}),
        (dict(runs=report(text.replace("| C |", "| E |"))), {(None, "report_unknown_company", "fail"), ("C", "report_numeric_coverage", "error")}),
        (dict(runs=report(text.replace("| 1 | A", "| 1 | C"))), {("C", "report_score_1", "fail"), (None, "report_top3_order", "fail")}),
    ]
    tables = {k: [(i, *r[1:]) for i, (changed, _) in enumerate(cases) for r in changed.get(k, base[k])] for k in SCHEMAS}
    rows = checked(spark, tables)
    for i, (changed, wanted) in enumerate(cases):
        assert bad(r for r in rows if r.run_id == i) == wanted, list(changed)


def test_empty_tables(spark, base):
    assert checked(spark, base, **{k: [] for k in SCHEMAS}) == []
