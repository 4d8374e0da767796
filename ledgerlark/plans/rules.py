"""Rule checks of recorded runs: stored decisions, rankings and reports against an independent recomputation.

Many runs are checked at once; every check is a row (run_id, company, check_id,
result, expected, actual) whose result is pass, fail, error (an observation is
missing) or not_applicable.  A run whose input is invalid has one error; a run with
an incomplete decision has no ranking and report checks, but an error for them.

Rankings and lists are compared as long tables, place by place, so that no list of
a run is held as a whole; ``expected`` and ``actual`` of a list give its first
difference.  Only the lines of one report are sorted together.

Tables (further columns are ignored):

* runs: run_id, threshold, high, top_k, branch, ranking_branch, ranking_threshold, ranking_high, report
* decisions: run_id, company, pos, stage, five ``*_score`` and ``*_weighted``, final_score, recommendation;
  on the sum scale six ``*_score`` and total_score
* profiles: run_id, company, pos, stage, six ``*_signal``: the inputs that the decisions had
* observed: run_id, stage, six ``w_*``: the weights in force
* lists: run_id, field, pos (from 0), company: the stored lists; one without rows is empty
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import grade, half_even
from ledgerlark.operators.ordered import global_rank
from ledgerlark.plans.scoring import SIGNALS, Policy
from ledgerlark.session import kept

EVALUATED = ("technology", "market", "team", "risk", "competition")
SIX = ("technology", "market", "business", "team", "risk", "competition")
TOLERANCE = 1e-9
#: The grades of the baseline are fixed; the target's follow the run's own thresholds.
BASELINE_HIGH, BASELINE_MIDDLE = 80, 65
WEIGHTED_RANGE, SUM_RANGE = (20, 100), (6, 30)
OUT = ["run_id", "company", "check_id", "result", "expected", "actual"]


def _check(name: str | Column, result: Column, expected: Column | None = None, actual: Column | None = None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("check_id"), result.alias("result"), text(expected).alias("expected"), text(actual).alias("actual"))


def _same(name: str | Column, expected: Column, actual: Column) -> Column:
    return _check(name, F.when(expected.eqNullSafe(actual), "pass").otherwise("fail"), expected, actual)


def _near(name: str, expected: Column, actual: Column) -> Column:
    return _check(name, F.when(F.coalesce(F.abs(expected - actual) <= TOLERANCE, F.lit(False)), "pass").otherwise("fail"), expected, actual)


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def _rows(frame: DataFrame, checks: Column, company: Column | None = None) -> DataFrame:
    """One row for each check of the array that is not null."""
    who = (F.col("company") if company is None else company).cast("string").alias("company")
    return frame.select("run_id", who, F.explode(F.array_compact(checks)).alias("c")).select("run_id", "company", "c.*")


def valid_runs(runs: DataFrame, decisions: DataFrame, policy: Policy, scale: tuple[int, int]) -> DataFrame:
    """Runs with ``problem``: null if their settings and company names can be checked, and ``n`` decisions."""
    names = decisions.groupBy("run_id", "company").agg(F.count(F.lit(1)).alias("c"))
    names = names.groupBy("run_id").agg(F.sum("c").alias("n"), F.max((F.col("c") > 1) | F.col("company").isNull() | (F.col("company") == "")).alias("unclear"))
    t, high = F.col("threshold"), F.col("high")
    problem = F.when(~F.coalesce(t.between(*scale), F.lit(False)), "threshold outside the scale").when(~F.coalesce(F.col("top_k") >= 1, F.lit(False)), "no positive number of places")
    if policy.separate_market:
        problem = problem.when(~F.coalesce((t >= 50) & (t <= high) & (high <= 100), F.lit(False)), "grade thresholds out of order")
    problem = problem.when(F.col("n").isNull(), "no decisions to check").when(F.col("unclear"), "company names empty or repeated")
    return runs.join(names, "run_id", "left").withColumn("problem", problem)


def weighted_decisions(decisions: DataFrame, profiles: DataFrame, observed: DataFrame, runs: DataFrame, policy: Policy) -> DataFrame:
    """Each decision with its checks, ``complete`` and, where it is, the recomputed score and grade and the company's input position."""
    stages = list(policy.weights)
    numbers = [f"{d}_{x}" for d in EVALUATED for x in ("score", "weighted")]
    kept_weights = observed.groupBy("run_id").agg(
        F.lit(True).alias("has_weights"), *[F.max(F.when(F.col("stage") == s, F.array(*[F.col(f"w_{x}") for x in SIGNALS]))).alias(f"o{i}") for i, s in enumerate(stages)]
    )
    p = profiles.select("run_id", "company", F.col("stage").alias("p_stage"), "pos", *[f"{x}_signal" for x in SIGNALS], F.lit(True).alias("has_profile"))
    d = decisions.select("run_id", "company", "stage", *numbers, "final_score", "recommendation").join(p, ["run_id", "company"], "left")
    d = d.join(runs.filter("problem is null").select("run_id", "threshold", "high"), "run_id").join(kept_weights, "run_id", "left")
    table = F.create_map(*[x for s in stages for x in (F.lit(s), F.array(*[F.lit(float(policy.weights[s][k])) for k in SIGNALS]))])
    d = d.withColumns({"w": table[F.col("stage")], "o": F.coalesce(*[F.when(F.col("stage") == s, F.col(f"o{i}")) for i, s in enumerate(stages)])})
    raw, w = (lambda x: F.col(f"{x}_signal")), (lambda x: F.col("w")[SIGNALS.index(x)])
    scores = [F.col(f"{x}_score") for x in EVALUATED]
    have = _all([c.isNotNull() for c in scores])
    inside = _all([c.between(1, 5) for c in scores])
    weighed = F.coalesce(have & inside & F.col("w").isNotNull(), F.lit(False))
    profiled = weighed & F.col("has_profile").isNotNull()
    complete = F.coalesce(profiled & _all([raw(x).between(1, 5) for x in SIGNALS]), F.lit(False))
    d = d.withColumns({"weighed": weighed, "profiled": profiled, "complete": complete})
    both = half_even((raw("market") + raw("traction")) / 2)
    if policy.separate_market:
        market = raw("market") / 5 * w("market") * 100 + raw("traction") / 5 * w("traction") * 100
        high, middle = F.col("high"), F.col("threshold")
    else:
        market = both / 5 * (w("market") + w("traction")) * 100
        high, middle = F.lit(BASELINE_HIGH), F.lit(BASELINE_MIDDLE)
    d = d.withColumns({f"x_{k}": raw(k) / 5 * w(k) * 100 for k in ("technology", "team", "competition")} | {"x_risk": (6 - raw("risk")) / 5 * w("risk") * 100, "x_market": market, "x_both": both})
    total = half_even(sum((F.col(f"x_{k}") for k in ("team", "competition", "risk", "market")), F.col("x_technology"))).cast("int")
    d = d.withColumn("x_score", F.when(F.col("complete"), total))
    d = d.withColumn("x_grade", F.when(F.col("complete"), grade(F.col("x_score"), high, middle, policy.low)))
    seen = F.coalesce(F.col("has_weights"), F.lit(False))
    show = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    summed = F.aggregate(F.coalesce(F.col("o"), F.array().cast("array<double>")), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    final = [
        _near("risk_direction", 6 - raw("risk"), F.col("risk_score")),
        *[_near(f"signal_{k}", raw(k), F.col(f"{k}_score")) for k in ("technology", "team", "competition")],
        _near("signal_market", F.col("x_both"), F.col("market_score")),
        *[_near(f"contribution_{k}", F.col(f"x_{k}"), F.col(f"{k}_weighted")) for k in EVALUATED],
        _same("grade", F.col("x_grade"), F.col("recommendation")),
        _same("total_range", F.lit(True), F.coalesce(F.col("final_score").between(*WEIGHTED_RANGE), F.lit(False))),
        _near("score_formula", F.col("x_score"), F.col("final_score")),
        _check("risk_evidence_semantics", F.lit("not_applicable")),
    ]
    checks = F.array(
        F.when(have, _same("dimension_range", F.lit(True), inside)),
        F.when(F.col("weighed"), F.when(seen, _same("stage_weights", show(F.col("w")), show(F.col("o")))).otherwise(_check("stage_weights", F.lit("error"), show(F.col("w"))))),
        F.when(F.col("weighed") & seen, _near("weight_sum", F.lit(1.0), summed)),
        F.when(F.col("profiled"), _same("stage", F.col("stage"), F.col("p_stage"))),
        *[F.when(F.col("complete"), c) for c in final],
        F.when(~F.col("complete"), _check("decision_input", F.lit("error"), F.lit("complete decision and effective signals"))),
    )
    return d.select("run_id", "company", "pos", "stage", *[f"{x}_score" for x in EVALUATED], "complete", "x_score", "x_grade", checks.alias("checks"))


def summed_decisions(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """The same on the scale of six dimensions summed, which has neither weights nor grades."""
    scores = [F.col(f"{x}_score") for x in SIX]
    have, inside = _all([c.isNotNull() for c in scores]), _all([c.between(1, 5) for c in scores])
    d = decisions.select("run_id", "company", "pos", "stage", *[f"{x}_score" for x in SIX], "total_score").join(runs.filter("problem is null").select("run_id"), "run_id")
    d = d.withColumns({"complete": F.coalesce(have & inside, F.lit(False)), "x_score": F.when(have & inside, sum(scores[1:], scores[0]).cast("int")), "x_grade": F.lit(None).cast("string")})
    final = [
        _check("stage_weights", F.lit("not_applicable")),
        _check("risk_direction", F.lit("pass"), F.lit("higher_is_more_manageable"), F.lit("higher_is_more_manageable")),
        _check("grade", F.lit("not_applicable")),
        _same("total_range", F.lit(True), F.coalesce(F.col("total_score").between(*SUM_RANGE), F.lit(False))),
        _near("score_formula", F.col("x_score"), F.col("total_score")),
        _check("risk_evidence_semantics", F.lit("not_applicable")),
    ]
    checks = F.array(
        F.when(have, _same("dimension_range", F.lit(True), inside)),
        *[F.when(F.col("complete"), c) for c in final],
        F.when(~F.col("complete"), _check("decision_input", F.lit("error"), F.lit("complete decision and effective signals"))),
    )
    return d.select("run_id", "company", "pos", "stage", "complete", "x_score", "x_grade", checks.alias("checks"))


def places(judged: DataFrame, runs: DataFrame) -> DataFrame:
    """Rank of each company within its run by recomputed score, ties by input position; ``passed`` and ``top``.

    One order over all runs, cut into ranges, gives the ranks, so a large run is not sorted in one task.
    """
    every = global_rank(judged.select("run_id", "company", "pos", "x_score", "x_grade"), [F.col("run_id"), F.desc("x_score"), F.col("pos"), F.col("company")], "place")
    starts = every.groupBy("run_id").agg(F.min("place").alias("start"))
    r = every.join(starts, "run_id").withColumn("place", F.col("place") - F.col("start")).join(runs.select("run_id", "threshold", "top_k"), "run_id")
    passed = F.col("x_score") >= F.col("threshold")
    return r.select("run_id", "company", "pos", "place", "x_grade", passed.alias("passed"), (passed & (F.col("place") < F.col("top_k"))).alias("top"))


def compared_lists(wanted: DataFrame, stored: DataFrame, fields: DataFrame) -> DataFrame:
    """Lists as rows (run_id, field, pos, company): each of ``fields`` (run_id, field) passes if both have the same companies in the same places."""
    keys = ["run_id", "field", "pos"]
    both = wanted.select(*keys, F.col("company").alias("a")).join(stored.select(*keys, F.col("company").alias("b")), keys, "full_outer")
    first = F.min(F.struct("pos", "a", "b"))
    wrong = both.filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy("run_id", "field").agg(first.alias("first"))
    out = fields.join(wrong, ["run_id", "field"], "left")
    return out.select("run_id", F.lit(None).cast("string").alias("company"), F.col("field").alias("check_id"), F.when(F.col("first").isNull(), "pass").otherwise("fail").alias("result"), F.col("first.a").alias("expected"), F.col("first.b").alias("actual"))


def report_rows(reports: DataFrame) -> DataFrame:
    """(run_id, line, headers, cells) of each body row of the score tables in ``report``.

    A score table has the columns Company and Final Score or DD Score; its header
    holds until the next header or the next line outside a table.
    """
    lines = reports.select("run_id", F.posexplode(F.split("report", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")).alias("line", "content"))
    row = F.regexp_replace(F.regexp_replace(F.trim("content"), r"^\|+", ""), r"(?<!\\)\|+$", "")
    cells = F.transform(F.split(row, r"(?<!\\)\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))
    lines = lines.withColumn("cells", F.when(F.startswith(F.trim("content"), F.lit("|")), cells)).drop("content")
    head = F.array_contains("cells", "Company") & (F.array_contains("cells", "Final Score") | F.array_contains("cells", "DD Score"))
    lines = lines.withColumn("is_head", F.coalesce(head, F.lit(False)))
    mark = F.when(F.col("cells").isNull(), F.array().cast("array<string>")).when(F.col("is_head"), F.col("cells"))
    above = Window.partitionBy("run_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("headers", F.last(mark, ignorenulls=True).over(above))
    ruler = F.forall("cells", lambda c: F.regexp_like(c, F.lit("^[-: ]*$")))
    return lines.filter(F.col("cells").isNotNull() & ~F.col("is_head") & (F.size("headers") > 0) & (F.size("headers") == F.size("cells")) & ~ruler).select("run_id", "line", "headers", "cells")


def cell(title: str) -> Column:
    """The cell under ``title``, of equal titles the last; null without such a column."""
    at = F.array_position(F.reverse("headers"), title)
    return F.when(at > 0, F.get("cells", F.size("cells") - at.cast("int")))


def report_checks(reports: DataFrame, judged: DataFrame, summed: bool) -> tuple[DataFrame, DataFrame]:
    """Checks of the n-th row of each company in the score tables, and the companies of the rows with ranks, in order."""
    score = F.coalesce(cell("Final Score"), cell("DD Score"))
    found = report_rows(reports).select("run_id", "line", cell("Company").alias("company"), score.alias("score"), *[cell(t).alias(f"c_{t.lower()}") for t in ("Rank", "Stage", "Recommendation", *[x.title() for x in EVALUATED])])
    known = judged.drop("checks", "pos", "complete").withColumn("known", F.lit(True))
    rows = found.join(known, ["run_id", "company"], "left")
    unknown = _rows(rows.filter("known is null"), F.array(_check("report_unknown_company", F.lit("fail"), None, F.col("company"))), F.lit(None))
    rows = rows.filter("known").withColumn("nth", F.row_number().over(Window.partitionBy("run_id", "company").orderBy("line")))
    ranked = F.count("c_rank").over(Window.partitionBy("run_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("shown", F.when(F.col("c_rank").isNotNull(), ranked))
    name = lambda what: F.concat(F.lit(f"report_{what}_"), F.col("nth").cast("string"))
    given = lambda title, check: F.when(F.col(f"c_{title}").isNotNull(), check)
    text = lambda c: F.col(c).cast("string")
    checks = [
        _same(name("score"), text("x_score"), F.col("score")),
        given("rank", _same(name("rank"), text("shown"), F.col("c_rank"))),
        given("stage", _same(name("stage"), F.col("stage"), F.col("c_stage"))),
        given("recommendation", F.when(F.col("x_grade").isNotNull(), _same(name("grade"), F.col("x_grade"), F.col("c_recommendation")))),
    ]
    if not summed:
        checks += [given(x, _same(name(f"dimension_{x.title()}"), text(f"{x}_score"), F.col(f"c_{x}"))) for x in EVALUATED]
    counts = rows.groupBy("run_id", "company").agg(F.lit(True).alias("shown_once"))
    covered = judged.join(reports.select("run_id"), "run_id", "left_semi").select("run_id", "company").join(counts, ["run_id", "company"], "left")
    none = "not_applicable" if summed else "error"
    cover = _rows(covered, F.array(_check("report_numeric_coverage", F.when(F.col("shown_once"), "pass").otherwise(none))))
    selected = rows.filter("shown is not null").select("run_id", F.lit("report_top3_order").alias("field"), (F.col("shown") - 1).cast("long").alias("pos"), "company")
    return unknown.unionByName(_rows(rows, F.array(*checks))).unionByName(cover), selected


def check_runs(runs: DataFrame, decisions: DataFrame, lists: DataFrame, policy: Policy, profiles: DataFrame | None = None, observed: DataFrame | None = None) -> DataFrame:
    """All checks of all runs.  Without ``profiles`` and ``observed`` the runs are of the sum scale."""
    summed = profiles is None
    runs = kept(valid_runs(runs, decisions, policy, SUM_RANGE if summed else WEIGHTED_RANGE))
    judged = kept(summed_decisions(decisions, runs) if summed else weighted_decisions(decisions, profiles, observed, runs, policy))
    out = [
        _rows(runs.filter("problem is not null"), F.array(_check("input", F.lit("error"), F.lit("valid complete policy input"), F.col("problem"))), F.lit(None)),
        _rows(judged, F.col("checks")),
    ]
    whole = judged.groupBy("run_id").agg(F.min("complete").alias("all_complete"))
    state = runs.filter("problem is null").join(whole, "run_id")
    if not summed:
        state = state.join(profiles.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_profiles")), "run_id", "left")
    else:
        state = state.withColumn("n_profiles", F.col("n"))
    out.append(_rows(state, F.array(F.when(~F.col("all_complete"), _check("ranking_input", F.lit("error"), F.lit("all scores independently recalculated"))).when(~F.col("n_profiles").eqNullSafe(F.col("n")), _check("candidate_order", F.lit("error")))), F.lit(None)))
    ready = kept(state.filter("all_complete and n_profiles = n").drop("all_complete", "n_profiles", "n", "unclear", "problem"))
    good = judged.join(ready.select("run_id"), "run_id", "left_semi")
    place = kept(places(good, ready))
    sums = place.groupBy("run_id").agg(F.count_if("top").alias("n_top"), F.min(F.when(F.col("x_grade") == "Watchlist", F.col("place"))).alias("watch"))
    place = place.join(sums, "run_id")
    at, item = F.col("place"), lambda field, pos: F.struct(F.lit(field).alias("field"), pos.cast("long").alias("pos"))
    if summed:
        entries = [item("decision_order", at), F.when(F.col("top"), item("selected_companies", at)), F.when(~F.col("top"), item("hold_companies", at - F.col("n_top")))]
        own = decisions.select("run_id", F.lit("decision_order").alias("field"), F.col("pos").cast("long").alias("pos"), "company")
        stored, fields = lists.select("run_id", "field", "pos", "company").unionByName(own), ["decision_order", "selected_companies", "hold_companies"]
    else:
        entries = [F.when(F.col("passed"), item("ranking_passed_companies", at)), F.when(F.col("top"), item("ranking_top_companies", at)), F.when(F.col("x_grade") == "Watchlist", item("ranking_watchlist_companies", at - F.col("watch")))]
        entries.append(F.when(F.col("top"), item("report_top3_order", at)))
        stored, fields = lists.select("run_id", F.concat(F.lit("ranking_"), "field").alias("field"), "pos", "company"), ["ranking_passed_companies", "ranking_top_companies", "ranking_watchlist_companies"]
    wanted = place.select("run_id", "company", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("run_id", "e.*", "company")
    reported = ready.withColumn("blank", F.coalesce(F.trim(F.regexp_replace("report", r"\s", " ")) == "", F.lit(True)))
    out.append(_rows(reported.filter("blank"), F.array(_check("report_numeric", F.lit("error"), F.lit("nonempty report"))), F.lit(None)))
    reported = reported.filter("not blank").select("run_id", "report", "threshold")
    checks, selected = report_checks(reported, good, summed)
    out.append(checks)
    asked = ready.select("run_id", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    if not summed:
        asked = asked.unionByName(reported.select("run_id", F.lit("report_top3_order").alias("field")))
        stored = stored.unionByName(selected)
        marks = F.regexp_extract_all("report", F.lit("`(\\d+)`점 이상"), F.lit(1))
        said = F.when(F.size(marks) == 0, "not_applicable").when(F.forall(marks, lambda m: m == F.col("threshold").cast("string")), "pass").otherwise("fail")
        out.append(_rows(reported, F.array(_check("report_threshold", said, F.col("threshold"), F.array_join(marks, ","))), F.lit(None)))
    out.append(compared_lists(wanted, stored, asked))
    final = ready.join(sums, "run_id", "left")
    branch = F.when(F.col("n_top") > 0, "top3").otherwise("hold")
    routes = [_same("recommendation_route", branch, F.col("branch"))]
    if not summed:
        routes += [_same("ranking_score_threshold", F.col("threshold"), F.col("ranking_threshold")), _same("ranking_high_priority_threshold", F.coalesce("high", F.lit(BASELINE_HIGH)), F.col("ranking_high")), _same("ranking_branch", branch, F.col("ranking_branch"))]
    out.append(_rows(final, F.array(*routes), F.lit(None)))
    return reduce(DataFrame.unionByName, [o.select(*OUT) for o in out])
