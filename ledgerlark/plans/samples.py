"""Samples and their metrics: what can be measured, what was, and whether that is all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import ratio

# The inputs that each metric needs.
REQUIRED = {
    "factual_precision": ("response", "reference"),
    "factual_recall": ("response", "reference"),
    "faithfulness": ("user_input", "response", "retrieved_contexts"),
    "context_recall": ("user_input", "reference", "retrieved_contexts"),
    "context_precision": ("user_input", "reference", "retrieved_contexts"),
}
FINISHED = ("completed", "not_applicable")


def problem(metric: str, lists: tuple[str, ...] = ("retrieved_contexts",)) -> Column:
    """missing (a null input), not_applicable (a blank one), or null: the first problem in the order of the inputs."""
    out = F.lit(None).cast("string")
    if metric.startswith("context_"):
        out = F.when(F.coalesce(F.col("invocation_id"), F.lit("")) == "", "missing")
    for name in reversed(REQUIRED[metric]):
        blank = ~F.exists(name, lambda v: F.trim(v) != "") if name in lists else F.trim(name) == ""
        out = F.when(F.col(name).isNull(), "missing").when(F.coalesce(blank, F.lit(True)), "not_applicable").otherwise(out)
    return out


def metric_inputs(samples: DataFrame, supported: str = "supported") -> DataFrame:
    """One row for each pending sample and metric: pending, missing, not_applicable or unsupported.

    The metrics are a fixed list, so the rows come from an explode.
    """
    rows = F.array(*[F.struct(F.lit(m).alias("metric_name"), F.when(~F.array_contains(supported, m), "unsupported").otherwise(F.coalesce(problem(m), F.lit("pending"))).alias("status")) for m in REQUIRED])
    return samples.filter("evaluation_status = 'pending'").select("sample_id", F.explode(rows).alias("m")).select("sample_id", "m.*")


def values(samples: DataFrame, results: DataFrame, searches: DataFrame | None = None) -> DataFrame:
    """One row a sample: value and status of each metric; a value only if completed.

    ``searches`` (sample_id, metric_name, status, value), one row a search,
    overrides: the mean if all are completed, else partial without a value.
    """
    r = results.select("sample_id", "metric_name", F.col("status"), F.when(F.col("status") == "completed", F.col("value")).alias("value"))
    if searches is not None:
        done = (F.col("status") == "completed") & F.col("value").isNotNull()
        per = searches.groupBy("sample_id", "metric_name").agg(F.when(F.bool_and(done), "completed").otherwise("partial").alias("status"), F.when(F.bool_and(done), F.avg("value")).alias("value"))
        r = r.join(per.select("sample_id", "metric_name"), ["sample_id", "metric_name"], "left_anti").unionByName(per)
    wide = r.groupBy("sample_id").pivot("metric_name", list(REQUIRED)).agg(F.first("value").alias("value"), F.first("status").alias("status"))
    out = samples.select("sample_id", "supported").join(wide, "sample_id", "left")
    return out.select("sample_id", *[c for m in REQUIRED for c in (F.col(f"{m}_value").alias(m), F.coalesce(f"{m}_status", F.when(F.array_contains("supported", m), "missing").otherwise("unsupported")).alias(f"{m}_status"))])


def long_values(wide: DataFrame) -> DataFrame:
    return wide.select("sample_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric_name"), F.col(m).alias("value"), F.col(f"{m}_status").alias("status")) for m in REQUIRED])).alias("m")).select("sample_id", "m.*")


def completeness(samples: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """(sample_id, complete): every row of every part (sample_id, status) is finished; a part without rows is no hindrance."""
    every = None
    for p in parts:
        x = p.select("sample_id", F.col("status").isin(*FINISHED).alias("ok"))
        every = x if every is None else every.unionByName(x)
    per = every.groupBy("sample_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("complete"))
    return samples.select("sample_id").join(per, "sample_id", "left").select("sample_id", F.coalesce("complete", F.lit(True)).alias("complete"))


def run_status(complete: DataFrame) -> DataFrame:
    n, done = F.count(F.lit(1)), F.count_if(F.col("complete"))
    return complete.agg(n.alias("n_samples"), done.alias("n_complete"), F.when((n > 0) & (n == done), "completed").when(done > 0, "partial").otherwise("failed").alias("status"))


def rule_values(checks: DataFrame, samples: DataFrame) -> DataFrame:
    """Rule conformance and failures of each sample's company, with the checks that concern all; null unless finished."""
    rules = checks.filter(F.startswith("check_id", F.lit("rule:"))).filter("status <> 'not_applicable'")
    measures = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "pass").alias("p"), F.count_if(F.col("status") == "fail").alias("f")]
    own = rules.filter("company_id is not null").groupBy("company_id").agg(*measures)
    every = rules.filter("company_id is null").agg(*[m.alias(f"g{k}") for m, k in zip(measures, "npf", strict=True)])
    j = samples.select("sample_id", "company_id").join(own, "company_id", "left").crossJoin(F.broadcast(every)).fillna(0, ["n", "p", "f"])
    n, p, f = (F.col(x) + F.col(f"g{x}") for x in "npf")
    finished = (n > 0) & (n == p + f)
    return j.select("sample_id", ratio(p, n, finished).alias("rule_conformance"), F.when(finished, f).alias("rule_error_count"))
