"""Rule checks of runs made of the customers, forty a run, with altered records, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import ordered
from ledgerlark.plans import report, rules, scoring
from ledgerlark.queries import query
from ledgerlark.session import table

FACTORS = {"technology": 3, "market": 7, "traction": 2, "team": 1, "competition": 4, "risk": 1}
SHIFTS = {"team": 2, "risk": 1}
RUN = 40


def _companies(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as companies: run, name, position, stage and signals 1 to 5."""
    k = F.col("c_custkey")
    stages = F.array(*map(F.lit, scoring.STAGE_WEIGHTS))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey").filter("c_custkey is not null")
    signals = [((k * f + SHIFTS.get(x, 0)) % 5 + 1).cast("int").alias(f"{x}_signal") for x, f in FACTORS.items()]
    return c.select(F.floor(k / RUN).alias("run_id"), F.concat(F.lit("C"), k.cast("string")).alias("company"), k, (k % RUN).alias("pos"), F.get(stages, (F.col("c_nationkey") % 4).cast("int")).alias("stage"), *signals)


def _swapped(frame: DataFrame, pos: str) -> Column:
    """The first two places change in every sixth run, if it has two."""
    both = (F.col("run_id") % 6 == 1) & (F.col("n_top") >= 2)
    return F.when(both & (F.col(pos) == 0), 1).when(both & (F.col(pos) == 1), 0).otherwise(F.col(pos)).cast("long").alias("pos")


def _weighted_run(spark: SparkSession, sf: str, policy: scoring.Policy) -> DataFrame:
    k, r = F.col("c_custkey"), F.col("run_id")
    scored = scoring.score(_companies(spark, sf))
    placed = ordered.ranked(scored, ["run_id"], [F.desc("final_score"), F.col("pos")], "place").withColumn("place", F.col("place") - 1)
    flag = {"passed": F.col("final_score") >= 65, "watch": F.col("grade") == "Watchlist"}
    placed = placed.withColumns(flag)
    shown = F.col("final_score") + F.when(k % 9 == 4, 1).otherwise(0)
    tops = placed.filter("passed and place < 3")
    top_rows = tops.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_top"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", report.row_line([F.col("place") + 1, F.col("company"), F.col("final_score")]).alias("line")))), lambda x: x["line"]), "\n").alias("first"))
    line = report.row_line([F.col("company"), F.col("stage"), shown, F.col("grade"), F.col("technology_signal"), F.col("risk_score")])
    all_rows = placed.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("second"))
    text = F.concat(F.lit("# Report\n\n| Rank | Company | DD Score |\n| --- | --- | --- |\n"), F.coalesce("first", F.lit("")), F.lit("\n\nfrom `65`점 이상\n\n| Company | Stage | Final Score | Recommendation | Technology | Risk |\n|---|---|---|---|---|---|\n"), F.col("second"))
    branch = F.when(F.col("n_top") > 0, "top3").otherwise("hold")
    runs = all_rows.join(top_rows, "run_id", "left").withColumn("n_top", F.coalesce("n_top", F.lit(0)))
    counts = runs.select("run_id", "n_top")
    runs = runs.select("run_id", F.when(r % 13 == 6, 101).otherwise(65).alias("threshold"), F.lit(80).alias("high"), F.lit(3).alias("top_k"), F.when(r % 7 == 3, "none").otherwise(branch).alias("branch"), branch.alias("ranking_branch"), F.lit(65).alias("ranking_threshold"), F.when(r % 5 != 4, 80).alias("ranking_high"), F.when(r % 8 != 2, text).alias("report"))
    parts = [F.col(f"{x}_part").alias(f"{x}_weighted") for x in rules.EVALUATED]
    decisions = scored.select("run_id", "company", "stage", *[F.col(f"{x}_signal").alias(f"{x}_score") for x in ("technology", "team", "competition")], F.when(k % 31 == 7, 6).otherwise(F.col("market_score")).alias("market_score"), "risk_score", *parts, (F.col("final_score") + F.when(k % 10 == 3, 1).otherwise(0)).alias("final_score"), F.when(k % 20 == 4, "Other").otherwise(F.col("grade")).alias("recommendation"))
    # Only every third run may have a score out of range, so that most runs are whole.
    decisions = decisions.withColumn("market_score", F.when((F.col("market_score") == 6) & (r % 3 != 0), 3).otherwise(F.col("market_score")))
    profiles = scored.filter((k % 997 != 0)).select("run_id", "company", "pos", "stage", *[f"{x}_signal" for x in scoring.SIGNALS])
    observed = scored.filter(r % 11 != 5).select("run_id", "stage").distinct().join(F.broadcast(scoring.weight_table(spark, policy)), "stage")
    lists = placed.join(counts, "run_id")
    entries = F.array(*[F.when(c, F.lit(n)) for n, c in (("passed_companies", F.col("passed")), ("top_companies", F.col("passed") & (F.col("place") < 3)))])
    stored = lists.select("run_id", "company", _swapped(lists, "place"), F.explode(F.array_compact(entries)).alias("field"))
    watch = ordered.ranked(placed.filter("watch"), ["run_id"], [F.col("place")], "n").select("run_id", "company", (F.col("n") - 1).cast("long").alias("pos"), F.lit("watchlist_companies").alias("field"))
    out = rules.check_runs(runs, decisions, stored.unionByName(watch), policy, profiles, observed)
    return out.select("run_id", "company", "check_id", "result")


_WEIGHTS = ", ".join(f"({i}, '{s}', {', '.join(f'{w[x]}::DOUBLE' for x in scoring.SIGNALS)})" for i, (s, w) in enumerate(scoring.STAGE_WEIGHTS.items()))
_COMPANIES = f"""w(n, stage, {', '.join(f'w_{x}' for x in scoring.SIGNALS)}) AS (VALUES {_WEIGHTS}),
c AS (SELECT c_custkey AS k, c_custkey // {RUN} AS run_id, 'C' || c_custkey AS company, c_custkey % {RUN} AS pos, w.*, {', '.join(f'(c_custkey * {f} + {SHIFTS.get(x, 0)}) % 5 + 1 AS {x}' for x, f in FACTORS.items())} FROM customer JOIN w ON n = c_nationkey % 4)"""


def _weighted_sql(separate: bool) -> str:
    market = "market / 5::DOUBLE * w_market * 100 + traction / 5::DOUBLE * w_traction * 100"
    both = "round_even((market + traction) / 2, 0)"
    joint = f"{both} / 5 * (w_market + w_traction) * 100"
    score = "round_even(technology / 5::DOUBLE * w_technology * 100 + team / 5::DOUBLE * w_team * 100 + competition / 5::DOUBLE * w_competition * 100 + (6 - risk) / 5::DOUBLE * w_risk * 100 + ({}), 0)::INT"
    grade = "CASE WHEN {0} >= 80 THEN 'High Priority DD' WHEN {0} >= 65 THEN 'Selective DD' WHEN {0} >= 50 THEN 'Watchlist' ELSE 'No DD' END"
    ok = lambda x: f"CASE WHEN {x} THEN 'pass' ELSE 'fail' END"
    of = lambda name, result, where="": f"SELECT run_id, company, {name}, {result} FROM full_rows {where}"
    run = lambda name, result, where="": f"SELECT run_id, NULL, {name}, {result} FROM ready {where}"
    rows = [
        "SELECT run_id, NULL, 'input', 'error' FROM c WHERE run_id % 13 = 6 GROUP BY run_id",
        f"SELECT run_id, company, 'dimension_range', {ok('NOT spoilt')} FROM d",
        "SELECT run_id, company, 'decision_input', 'error' FROM d WHERE spoilt OR gone",
        "SELECT run_id, company, 'stage_weights', CASE WHEN run_id % 11 = 5 THEN 'error' ELSE 'pass' END FROM d WHERE NOT spoilt",
        "SELECT run_id, company, 'weight_sum', 'pass' FROM d WHERE NOT spoilt AND run_id % 11 <> 5",
        "SELECT run_id, company, 'stage', 'pass' FROM d WHERE NOT spoilt AND NOT gone",
        *[of(f"'{x}'", "'pass'") for x in ("risk_direction", "signal_technology", "signal_team", "signal_competition", "total_range", *[f"contribution_{x}" for x in ("technology", "team", "competition", "risk")])],
        of("'signal_market'", ok(f"{both} = shown_market")),
        of("'contribution_market'", ok(f"abs(({market if separate else joint}) - ({joint})) <= 1e-9")),
        of("'grade'", ok("g = CASE WHEN k % 20 = 4 THEN 'Other' ELSE old_g END")),
        of("'score_formula'", ok("score = old + CASE WHEN k % 10 = 3 THEN 1 ELSE 0 END")),
        of("'risk_evidence_semantics'", "'not_applicable'"),
        "SELECT run_id, NULL, 'ranking_input', 'error' FROM d GROUP BY run_id HAVING bool_or(spoilt OR gone)",
        run("'recommendation_route'", ok("run_id % 7 <> 3 AND (n_top > 0) = (old_n > 0)")),
        run("'ranking_branch'", ok("(n_top > 0) = (old_n > 0)")),
        run("'ranking_score_threshold'", "'pass'"),
        run("'ranking_high_priority_threshold'", ok("run_id % 5 <> 4")),
        *[run(f"'ranking_{f}_companies'", ok(f"{f} = old_{f}" + ("" if f == "watchlist" else " AND NOT (run_id % 6 = 1 AND old_n >= 2)"))) for f in ("passed", "top", "watchlist")],
        run("'report_numeric'", "'error'", "WHERE run_id % 8 = 2"),
        run("'report_threshold'", "'pass'", "WHERE run_id % 8 <> 2"),
        run("'report_top3_order'", ok("top = old_top"), "WHERE run_id % 8 <> 2"),
    ]
    seen = "p JOIN ready USING (run_id) WHERE run_id % 8 <> 2"
    twice = "(old_place <= 3 AND old >= 65)::INT"
    rows += [
        f"SELECT run_id, company, 'report_numeric_coverage', 'pass' FROM {seen}",
        f"SELECT run_id, company, 'report_rank_1', 'pass' FROM {seen} AND {twice} = 1",
        f"SELECT run_id, company, 'report_score_1', {ok('score = old')} FROM {seen} AND {twice} = 1",
        f"SELECT run_id, company, 'report_score_' || (1 + {twice}), {ok('score = old + (k % 9 = 4)::INT')} FROM {seen}",
        f"SELECT run_id, company, 'report_stage_' || (1 + {twice}), 'pass' FROM {seen}",
        f"SELECT run_id, company, 'report_grade_' || (1 + {twice}), {ok('g = old_g')} FROM {seen}",
        f"SELECT run_id, company, 'report_dimension_Technology_' || (1 + {twice}), 'pass' FROM {seen}",
        f"SELECT run_id, company, 'report_dimension_Risk_' || (1 + {twice}), 'pass' FROM {seen}",
    ]
    some = lambda what, order, name: f"coalesce(string_agg(company, ',' ORDER BY {order}) FILTER (WHERE {what}), '') AS {name}"
    return f"""WITH {_COMPANIES},
s AS (SELECT *, {score.format(market if separate else joint)} AS score, {score.format(joint)} AS old, k % 997 = 0 AS gone, k % 31 = 7 AND run_id % 3 = 0 AS spoilt, CASE WHEN k % 31 = 7 THEN 3 ELSE {both} END AS shown_market FROM c),
d AS (SELECT *, {grade.format('score')} AS g, {grade.format('old')} AS old_g FROM s WHERE run_id % 13 <> 6),
full_rows AS (SELECT * FROM d WHERE NOT spoilt AND NOT gone),
p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, pos) AS place, row_number() OVER (PARTITION BY run_id ORDER BY old DESC, pos) AS old_place FROM d),
ready AS (SELECT run_id, count(*) FILTER (WHERE score >= 65 AND place <= 3) AS n_top, count(*) FILTER (WHERE old >= 65 AND old_place <= 3) AS old_n,
    {some('score >= 65', 'place', 'passed')}, {some('old >= 65', 'old_place', 'old_passed')}, {some('score >= 65 AND place <= 3', 'place', 'top')}, {some('old >= 65 AND old_place <= 3', 'old_place', 'old_top')},
    {some("g = 'Watchlist'", 'place', 'watchlist')}, {some("old_g = 'Watchlist'", 'old_place', 'old_watchlist')} FROM p GROUP BY run_id HAVING NOT bool_or(spoilt OR gone))
SELECT run_id, company, check_id, result FROM ({' UNION ALL '.join(rows)}) x(run_id, company, check_id, result)"""


@query(_weighted_sql(False))
def rule_checks_baseline(spark, sf):
    """Decisions, rankings and reports of all runs under the policy they were made with."""
    return _weighted_run(spark, sf, scoring.BASELINE)


@query(_weighted_sql(True))
def rule_checks_target(spark, sf):
    """The same records under the policy that weighs market and traction apart."""
    return _weighted_run(spark, sf, scoring.TARGET)


_SUM = " + ".join(("technology", "market", "traction", "team", "competition", "risk"))


@query(f"""WITH {_COMPANIES},
s AS (SELECT *, {_SUM} AS score FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, pos) AS place FROM s),
ready AS (SELECT run_id, count(*) FILTER (WHERE score >= 20 AND place <= 3) AS n_top, string_agg(company, ',' ORDER BY pos) AS given, string_agg(company, ',' ORDER BY place) AS wanted FROM p GROUP BY run_id HAVING NOT bool_or(k % 601 = 0))
SELECT run_id, company, check_id, result FROM (
    SELECT run_id, company, unnest(['dimension_range', 'risk_direction', 'total_range']), 'pass' FROM p WHERE k % 601 <> 0
    UNION ALL SELECT run_id, company, unnest(['stage_weights', 'grade', 'risk_evidence_semantics']), 'not_applicable' FROM p WHERE k % 601 <> 0
    UNION ALL SELECT run_id, company, 'score_formula', CASE WHEN k % 10 = 3 THEN 'fail' ELSE 'pass' END FROM p WHERE k % 601 <> 0
    UNION ALL SELECT run_id, company, 'decision_input', 'error' FROM p WHERE k % 601 = 0
    UNION ALL SELECT run_id, NULL, 'ranking_input', 'error' FROM p GROUP BY run_id HAVING bool_or(k % 601 = 0)
    UNION ALL SELECT run_id, NULL, 'decision_order', CASE WHEN given = wanted THEN 'pass' ELSE 'fail' END FROM ready
    UNION ALL SELECT run_id, NULL, 'selected_companies', CASE WHEN run_id % 6 = 1 AND n_top >= 2 THEN 'fail' ELSE 'pass' END FROM ready
    UNION ALL SELECT run_id, NULL, 'hold_companies', 'pass' FROM ready
    UNION ALL SELECT run_id, NULL, 'recommendation_route', CASE WHEN run_id % 7 = 3 THEN 'fail' ELSE 'pass' END FROM ready
    UNION ALL SELECT run_id, company, 'report_score_1', 'pass' FROM p JOIN ready USING (run_id) WHERE k % 2 = 0
    UNION ALL SELECT run_id, company, 'report_numeric_coverage', CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'not_applicable' END FROM p JOIN ready USING (run_id)
    UNION ALL SELECT run_id, NULL, 'report_unknown_company', 'fail' FROM ready
) x(run_id, company, check_id, result)""")
def rule_checks_sum(spark, sf):
    """Runs on the scale of six dimensions summed."""
    k, r = F.col("c_custkey"), F.col("run_id")
    named = dict(zip(rules.SIX, ("technology", "market", "traction", "team", "competition", "risk"), strict=True))
    c = _companies(spark, sf)
    c = c.withColumn("total", sum((F.col(f"{x}_signal") for x in list(named.values())[1:]), F.col("technology_signal")))
    placed = ordered.ranked(c, ["run_id"], [F.desc("total"), F.col("pos")], "place").withColumns({"place": F.col("place") - 1})
    placed = placed.withColumn("top", (F.col("total") >= 20) & (F.col("place") < 3))
    lines = F.concat(F.lit("| "), F.col("company"), F.lit(" | "), F.col("total").cast("string"), F.lit(" |"))
    body = placed.groupBy("run_id").agg(F.count_if("top").alias("n_top"), F.array_join(F.array_sort(F.collect_list(F.when(k % 2 == 0, lines))), "\n").alias("body"))
    text = F.concat(F.lit("|Company|Final Score|\n|-|-|\n| Nobody | 1 |\n"), F.col("body"))
    branch = F.when(F.col("n_top") > 0, "top3").otherwise("hold")
    runs = body.select("run_id", F.lit(20).alias("threshold"), F.lit(None).cast("int").alias("high"), F.lit(3).alias("top_k"), F.when(r % 7 == 3, "none").otherwise(branch).alias("branch"), text.alias("report"))
    scores = [F.when(k % 601 != 0, F.col(f"{s}_signal")).alias(f"{d}_score") for d, s in named.items()]
    decisions = c.select("run_id", "company", "pos", "stage", *scores, (F.col("total") + F.when(k % 10 == 3, 1).otherwise(0)).alias("total_score"))
    both = placed.join(body.select("run_id", "n_top"), "run_id")
    top = both.filter("top").select("run_id", "company", _swapped(both, "place"), F.lit("selected_companies").alias("field"))
    hold = both.filter("not top").select("run_id", "company", (F.col("place") - F.col("n_top")).cast("long").alias("pos"), F.lit("hold_companies").alias("field"))
    return rules.check_runs(runs, decisions, top.unionByName(hold), scoring.Policy(threshold=20)).select("run_id", "company", "check_id", "result")
