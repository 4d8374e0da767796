"""Before/after comparison of two runs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import delta, nearest_rank
from ledgerlark.operators.aggregates import axis_verdict
from ledgerlark.operators.joins import duplicate_keys, pair
from ledgerlark.operators.ordered import global_rank, order_statistics, printed
from ledgerlark.plans.report import row_line


def is_rate(metric: str) -> bool:
    return not metric.endswith(("count", "errors"))


def report(before: DataFrame, after: DataFrame, keys: list[str], metrics: list[str], better: list[bool]) -> DataFrame:
    """Paired rows with deltas (rates in points, null unless paired and known) and a verdict."""
    p = pair(before, after, keys, metrics)
    paired = F.col("pair_status") == "paired"
    p = p.withColumns({f"delta_{m}": F.when(paired, delta(F.col(f"before_{m}"), F.col(f"after_{m}"), is_rate(m))) for m in metrics})
    return p.withColumn("verdict", axis_verdict([F.col(f"delta_{m}") for m in metrics], better))


def long(report_: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each key and metric."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"before_{m}").cast("double").alias("before"), F.col(f"after_{m}").cast("double").alias("after"), F.col(f"delta_{m}").cast("double").alias("delta")) for m in metrics])
    return report_.select(*keys, "pair_status", F.explode(rows).alias("m")).select(*keys, "pair_status", "m.*")


def assert_unique(frame: DataFrame, keys: list[str]) -> DataFrame:
    """``frame``; a duplicate key fails the job when it runs."""
    bad = duplicate_keys(frame, keys)
    if not bad.isEmpty():
        raise ValueError(f"duplicate keys: {bad.limit(3).collect()}")
    return frame


def campaign(attempts: DataFrame) -> DataFrame:
    """Success over all attempts by data mode; attempts without an evaluation count."""
    ok = F.coalesce(F.col("succeeded"), F.lit(False))
    return attempts.groupBy("data_mode").agg(F.count(F.lit(1)).alias("n_attempts"), F.count_if(ok).alias("n_succeeded"), F.avg(ok.cast("int")).alias("success_rate"))


def regressions(report_: DataFrame, keys: list[str], metrics: list[str], better: list[bool]) -> DataFrame:
    """Keys with a worse metric, and which ones, in the order of ``metrics``."""
    worse = F.array_compact(F.array(*[F.when(F.col(f"delta_{m}") * (1 if up else -1) < 0, m) for m, up in zip(metrics, better, strict=True)]))
    return report_.select(*keys, worse.alias("worse")).filter(F.size("worse") > 0)


def overall(report_: DataFrame, primary: list[str], metrics: list[str], better: list[bool]) -> DataFrame:
    """One row: whether all is paired and known, how many samples are worse, and the verdict."""
    known = [F.col(f"{s}_{m}").isNotNull() for m in primary for s in ("before", "after")]
    whole = F.coalesce((F.col("pair_status") == "paired") & F.forall(F.array(*known), lambda x: x), F.lit(False))
    worse = F.exists(F.array(*[F.coalesce(F.col(f"delta_{m}") * (1 if up else -1) < 0, F.lit(False)) for m, up in zip(metrics, better, strict=True)]), lambda x: x)
    n, bad = F.count(F.lit(1)), F.count_if(worse)
    complete = (n > 0) & (F.count_if(whole) == n)
    return report_.agg(n.alias("n_samples"), complete.alias("complete"), bad.alias("n_regressions"), F.when(~complete, "incomplete").when(bad > 0, "regressed").otherwise("no_detected_regression").alias("verdict"))


def changed_settings(before: DataFrame, after: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, before, after): fields of two manifests that differ, null-safe, as text.

    A manifest, or a field, of one side only differs where the other side has a value; nulls are equal to nothing there.
    """
    fields = sorted({*before.columns, *after.columns} - {key, *ignore})
    long_ = lambda f, name: f.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.to_json(F.struct(c)).alias("v")) for c in fields if c in f.columns])).alias("x")).select(key, "x.field", F.col("x.v").alias(name))
    both = long_(before, "before").join(long_(after, "after"), [key, "field"], "full_outer")
    both = both.withColumns({s: F.coalesce(s, F.lit("{}")) for s in ("before", "after")})
    return both.filter(F.col("before") != F.col("after"))


def gate_problems(pairs: DataFrame) -> DataFrame:
    """(pair_id, problem): why two runs may not be compared.

    Columns: pair_id, mode (frozen, live, isolated), and before_ and after_
    of: run_id, frozen, data_mode, dataset, references, evaluator, inputs.
    """
    differ = lambda c: ~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    checks = {
        "same run": ~differ("run_id"),
        "not frozen": ~(F.coalesce("before_frozen", F.lit(False)) & F.coalesce("after_frozen", F.lit(False))),
        "another data mode": differ("data_mode"),
        "another dataset": differ("dataset"),
        "other references": differ("references"),
        "another evaluator": differ("evaluator"),
        "inputs changed": F.col("mode").isin("isolated", "frozen") & differ("inputs"),
    }
    return pairs.select("pair_id", F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))).alias("problem"))


def first_problem(checks: dict[str, Column]) -> Column:
    """The name of the first check that is true, else null."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items()])


def _differ(c: str) -> Column:
    return ~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def comparisons(pairs: DataFrame) -> DataFrame:
    """One row a pair of evaluations: pair_id, problem, changed, complete (the last two null with a problem).

    Columns: pair_id, and before_ and after_ of: run_id, mode, dataset,
    references, evaluator, frozen, inputs, evidence (hashes), content (of the
    evidence), intact (an isolated run's own check), status.  Isolated runs may
    only differ in their snapshots' hashes if both are intact and their inputs
    and evidence's content are the same.
    """
    changed = _differ("inputs") | _differ("evidence")
    apart = changed & (F.col("before_mode") == "isolated")
    problem = first_problem({
        "same run": ~_differ("run_id"),
        "another mode": _differ("mode"),
        "another dataset": _differ("dataset"),
        "other references": _differ("references"),
        "another evaluator": _differ("evaluator"),
        "not frozen": ~(_flag("before_frozen") & _flag("after_frozen")),
        "isolated run not intact": apart & ~(_flag("before_intact") & _flag("after_intact")),
        "isolated content differs": apart & (_differ("inputs") | _differ("content")),
    })
    whole = F.coalesce((F.col("before_status") == "completed") & (F.col("after_status") == "completed"), F.lit(False))
    return pairs.withColumn("problem", problem).select("pair_id", "problem", F.when(F.col("problem").isNull(), changed).alias("changed"), F.when(F.col("problem").isNull(), whole).alias("complete"))


JUDGES = ("factual", "grounding", "coverage")


def reevaluation_problems(pairs: DataFrame, reason: str | None, judges: tuple[str, ...] = ()) -> DataFrame:
    """(pair_id, problem): the first reason why a pair may not be evaluated again; null if it may.

    Columns: pair_id, and before_ and after_ of: run_id, mode, dataset,
    references, frozen, package (kept samples and claims), package_mode, and
    <judge>_configuration of JUDGES.  ``judges`` are those at hand: none that an
    evaluation had may be dropped, and those of claims need a kept package.
    """
    checks = {"no reason": F.lit(not (reason or "").strip()), "same run": ~_differ("run_id"), "another mode": _differ("mode"), "another dataset": _differ("dataset"), "other references": _differ("references")}
    for side in ("before", "after"):
        checks[f"{side}: not frozen"] = ~_flag(f"{side}_frozen")
        for judge in JUDGES:
            if judge not in judges:
                checks[f"{side}: {judge} judge dropped"] = F.col(f"{side}_{judge}_configuration").isNotNull()
        checks[f"{side}: isolated package"] = _flag(f"{side}_package") & (F.col(f"{side}_package_mode") == "isolated")
        if {"factual", "grounding"} & set(judges):
            checks[f"{side}: no package kept"] = ~_flag(f"{side}_package")
    return pairs.select("pair_id", first_problem(checks).alias("problem"))


def reevaluate(pairs: DataFrame, samples: DataFrame, scorer: Callable[[DataFrame], DataFrame], evaluator: str, reason: str, judges: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides of each admitted pair scored by one scorer: (pairs as evaluated, results, refused).

    pairs as for :func:`reevaluation_problems` and :func:`comparisons`, with
    before_ and after_evaluation_id; samples(evaluation_id, ...).  ``scorer``
    takes samples and gives their rows with metric_name, status and value; it
    sees both sides at once, so none can be scored by another version.  Old
    evaluations stay: new ids are a hash of the old one, the reason and the
    evaluator, so a repeated run gives the same ids.  An evaluation is
    completed if it has results and all are.  refused: (pair_id, problem).
    """
    checked = pairs.join(reevaluation_problems(pairs, reason, judges), "pair_id")
    refused = checked.filter("problem is not null").select("pair_id", "problem")
    old = lambda s: F.col(f"{s}_evaluation_id")
    new = lambda s: F.sha2(F.concat_ws("\n", old(s), F.lit(reason), F.lit(evaluator)), 256)
    fine = checked.filter("problem is null").drop("problem")
    ids = fine.select(F.explode(F.array(*[F.struct(old(s).alias("evaluation_id"), new(s).alias("new_id")) for s in ("before", "after")])).alias("x")).select("x.*").distinct()
    results = scorer(samples.join(ids, "evaluation_id").withColumnRenamed("evaluation_id", "previous_evaluation_id").withColumnRenamed("new_id", "evaluation_id"))
    status = results.groupBy("evaluation_id").agg(F.when(F.bool_and(F.coalesce(F.col("status") == "completed", F.lit(False))), "completed").otherwise("partial").alias("status"))
    out = fine
    for s in ("before", "after"):
        mine = status.select(F.col("evaluation_id").alias("__id"), F.col("status").alias("__status"))
        out = out.withColumns({f"{s}_previous_evaluation_id": old(s), f"{s}_evaluation_id": new(s)}).join(mine, F.col(f"{s}_evaluation_id") == F.col("__id"), "left")
        out = out.withColumns({f"{s}_status": F.coalesce("__status", F.lit("missing")), f"{s}_evaluator": F.lit(evaluator), f"{s}_frozen": F.lit(True)}).drop("__id", "__status")
    return out.withColumn("reason", F.lit(reason)), results, refused


def workflow_success(checks: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, succeeded): the run ended well and all its checks passed or do not apply."""
    per = checks.groupBy("run_id").agg(F.bool_and(F.coalesce(F.col("result").isin("pass", "not_applicable"), F.lit(False))).alias("__ok"))
    return runs.join(per, "run_id", "left").select("run_id", ((F.col("status") == "succeeded") & F.coalesce("__ok", F.lit(False))).alias("succeeded"))


def markdown(report_: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(line_no, line): the paired table as Markdown, numbered by key; unknown values as a dash."""
    head = ["Key", "Status", *[f"{m} {x}" for m in metrics for x in ("before", "after", "change")]]
    name = F.concat_ws(" / ", *[printed(F.col(k)) for k in keys])
    cells = [name, F.col("pair_status"), *[F.format_string("%.4f", F.col(f"{x}_{m}").cast("double")) for m in metrics for x in ("before", "after", "delta")]]
    shown = [F.when(F.col(f"{x}_{m}").isNotNull(), c) for c, (m, x) in zip(cells[2:], [(m, x) for m in metrics for x in ("before", "after", "delta")], strict=True)]
    body = global_rank(report_.select(name.alias("__k"), row_line([name, F.col("pair_status"), *shown]).alias("line")), [F.col("__k"), F.col("line")], "line_no").select("line_no", "line")
    top = report_.sparkSession.createDataFrame([(-1, "| " + " | ".join(head) + " |"), (0, "|" + " --- |" * len(head))], "line_no long, line string")
    return top.unionByName(body)


#: What runs must share to be timed together.
RUNTIME = ["purpose", "status", "cache_state", "fallback_used", "currency", "price_version", "commit_sha", "settings_sha256", "execution_path", "evaluator_sha256"]
#: Observations from which a 95th percentile is published.
P95_LEAST = 20


def runtime_groups(runs: DataFrame) -> DataFrame:
    """Times and costs of runs that share all of RUNTIME (nulls are equal).

    Medians are the mean of the two middle values; the 95th percentile is the
    nearest rank, from 20 observed times on; costs have a median only if every
    run's cost is known.
    """
    sizes = runs.groupBy(*RUNTIME).agg(F.count(F.lit(1)).alias("repetitions"))
    low, high = (lambda n: F.floor((n + 1) / 2)), (lambda n: F.floor((n + 2) / 2))
    times = order_statistics(runs, RUNTIME, "duration_seconds", {"t_low": low, "t_high": high, "p95": nearest_rank(0.95)}).withColumnRenamed("n", "n_times")
    costs = order_statistics(runs, RUNTIME, "cost", {"c_low": low, "c_high": high}).withColumnRenamed("n", "n_costs")
    out = sizes
    for i, part in enumerate((times, costs)):
        part = part.withColumnsRenamed({k: f"__{i}_{k}" for k in RUNTIME})
        out = out.join(part, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{i}_{k}")) for k in RUNTIME]), "left")
    known = F.coalesce("n_costs", F.lit(0))
    return out.select(
        *RUNTIME,
        "repetitions",
        F.coalesce("n_times", F.lit(0)).alias("observed_duration_count"),
        ((F.col("t_low") + F.col("t_high")) / 2).alias("median_seconds"),
        F.when(F.col("n_times") >= P95_LEAST, F.col("p95")).alias("p95_seconds"),
        known.alias("known_cost_count"),
        F.when(known == F.col("repetitions"), (F.col("c_low") + F.col("c_high")) / 2).alias("median_cost"),
    )
