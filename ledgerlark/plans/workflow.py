"""Run logs: roles, required steps, limits and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.functions.hashing import sha256
from ledgerlark.operators.chains import nearest_above
from ledgerlark.operators.joins import ancestors, duplicate_keys, missing, sized
from ledgerlark.operators.ordered import first_after, first_per


def nearest_role(invocations: DataFrame, roles: dict[str, str | None], ident: str = "invocation_id", parent: str = "parent_id", operation: str = "operation") -> DataFrame:
    """(ident, role): the role of the nearest invocation upwards, itself first, whose operation is mapped.

    An operation counts by what stands before its first dot.  A mapping to null
    stops the walk without a role.
    """
    known = F.create_map(*[F.lit(x) for k, v in roles.items() for x in (k, v or "")])
    found = nearest_above(invocations, ident, parent, F.element_at(known, F.substring_index(operation, ".", 1)))
    return found.select(ident, F.nullif("value", F.lit("")).alias("role"))


def step_coverage(entities: DataFrame, steps: DataFrame, done: DataFrame, entity: str, step: str) -> DataFrame:
    """Each entity and required step (a fixed small table), and whether it was done."""
    have = done.select(entity, step).distinct().withColumn("__done", F.lit(True))
    return entities.select(entity).distinct().crossJoin(sized(steps.select(step).distinct())).join(have, [entity, step], "left").select(entity, step, F.coalesce("__done", F.lit(False)).alias("covered"))


def over_limit(events: DataFrame, entity: str, node: str, most: int = 25) -> DataFrame:
    return events.groupBy(entity, node).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def cycles(invocations: DataFrame, ident: str, parent: str) -> DataFrame:
    """Invocations that are their own ancestor."""
    return ancestors(invocations, ident, parent).filter("node = ancestor").select(F.lit("cycle").alias("rule"), F.col("node").alias("row"), F.col("ancestor").alias("value")).distinct()


def validate_run(invocations: DataFrame, evidence: DataFrame, retrievals: DataFrame, contexts: DataFrame, blobs: DataFrame) -> DataFrame:
    """(rule, row, value): every broken reference, hash, order or quote of a run.

    invocations(invocation_id, parent_id); evidence(evidence_id, source, text);
    retrievals(invocation_id, rank, evidence_id); contexts(context_id,
    invocation_id, text, path, start, end, quote); blobs(path, sha256, content).
    """
    w = Window.partitionBy("invocation_id").orderBy("pos")
    row = lambda f, rule, ident, value: f.select(F.lit(rule).alias("rule"), F.col(ident).cast("string").alias("row"), F.col(value).cast("string").alias("value"))
    order = retrievals.withColumn("before", F.lag("rank").over(w)).filter("rank <= before")
    quotes = contexts.join(blobs.select("path", F.decode("content", "UTF-8").alias("body")), "path").filter(~F.col("quote").eqNullSafe(F.substr("body", F.col("start") + 1, F.col("end") - F.col("start"))))
    found = [
        missing(invocations, invocations, "parent_id", "invocation_id", "parent", "invocation_id"),
        cycles(invocations, "invocation_id", "parent_id"),
        missing(retrievals, evidence, "evidence_id", "evidence_id", "evidence", "invocation_id"),
        missing(contexts, invocations, "invocation_id", "invocation_id", "context", "context_id"),
        missing(contexts, blobs, "path", "path", "snapshot", "context_id"),
        row(evidence.filter(F.col("evidence_id") != sha256(F.concat("source", F.lit("\n"), "text"))), "evidence hash", "evidence_id", "source"),
        row(blobs.filter(F.col("sha256") != F.sha2("content", 256)), "snapshot hash", "path", "sha256"),
        row(order, "rank order", "invocation_id", "rank"),
        row(quotes, "quote", "context_id", "quote"),
        row(duplicate_keys(invocations, ["invocation_id"]), "duplicate invocation", "invocation_id", "n"),
    ]
    return reduce(DataFrame.unionByName, found)


def enrich(entities: DataFrame, evidence: DataFrame, entity: str, categories: dict[str, str]) -> DataFrame:
    """Entities with a signal and a summary for each category of evidence.

    ``categories`` maps a category to the signal it gives.  The summary is the
    first non-empty evidence text by position, else the entity's own.
    """
    from ledgerlark.plans.scoring import evidence_signal

    out = entities
    for category, signal in categories.items():
        own = evidence.filter(F.col("category") == category)
        first = own.filter("trim(content) <> ''").groupBy(entity).agg(F.min_by("content", "pos").alias("__first"))
        scored = evidence_signal(out, own, [entity], "content", f"{signal}_signal").drop("n_strong", "n_medium")
        scored = scored.withColumn(f"{signal}_signal", F.greatest(F.lit(1), F.least(F.lit(5), "signal")).cast("int")).drop("signal")
        out = scored.join(first, entity, "left").withColumn(f"{signal}_summary", F.coalesce("__first", F.col(f"{signal}_summary"))).drop("__first")
    return out


# The steps of a run, those of each company, and the routes that a step may take.
RUN_STEPS = ("load_companies", "market_research", "ranking", "branch_selector")
COMPANY_STEPS = ("company_research", "technical_eval", "market_eval", "team_eval", "risk_eval", "competition_eval", "investment_decision")


def steps(spark: SparkSession, run: tuple[str, ...] = RUN_STEPS, company: tuple[str, ...] = COMPANY_STEPS, optional: tuple[str, ...] = ()) -> DataFrame:
    """The workflow as a table: step, per_company, required."""
    return spark.createDataFrame([(s, False, s not in optional) for s in run] + [(s, True, s not in optional) for s in company], "step string, per_company boolean, required boolean")


def checks(steps_: DataFrame, candidates: DataFrame, calls: DataFrame, routes: DataFrame, most: int = 25, looping: str = "investment_supervisor") -> DataFrame:
    """(check_id, company_id, result): coverage of required steps, allowed routes, failed calls, known companies, iterations.

    candidates(company_id); calls(invocation_id, operation, company_id, status,
    route); routes(operation, route), the allowed ones.
    """
    good = calls.filter("status = 'succeeded'").select("operation", "company_id").distinct()
    result = lambda c: F.when(c, "pass").otherwise("fail")
    need = steps_.filter("required")
    each = candidates.select("company_id").distinct().crossJoin(F.broadcast(need.filter("per_company").select("step")))
    met = each.join(good.withColumn("__d", F.lit(True)), (F.col("step") == F.col("operation")) & (each["company_id"] == good["company_id"]), "left")
    out = met.select(F.concat(F.lit("coverage_"), "step").alias("check_id"), each["company_id"], result(F.col("__d").isNotNull()).alias("result"))
    once = good.select(F.col("operation").alias("step")).distinct().withColumn("__d", F.lit(True))
    nobody = F.lit(None).cast(candidates.schema["company_id"].dataType).alias("company_id")
    out = out.unionByName(need.filter("not per_company").join(once, "step", "left").select(F.concat(F.lit("coverage_"), "step").alias("check_id"), nobody, result(F.col("__d").isNotNull()).alias("result")))
    known = routes.select("operation", "route").distinct().withColumn("__d", F.lit(True))
    out = out.unionByName(calls.filter("route is not null").join(F.broadcast(known), ["operation", "route"], "left").select(F.concat(F.lit("route_"), "invocation_id").alias("check_id"), "company_id", result(F.col("__d").isNotNull()).alias("result")))
    out = out.unionByName(calls.filter("status = 'failed'").select(F.concat(F.lit("call_"), "invocation_id").alias("check_id"), "company_id", F.lit("fail").alias("result")))
    strange = calls.filter("company_id is not null").join(candidates.select("company_id").distinct(), "company_id", "left_anti")
    out = out.unionByName(strange.select(F.concat(F.lit("unknown_company_"), "invocation_id").alias("check_id"), "company_id", F.lit("fail").alias("result")))
    many = over_limit(calls.filter(F.col("operation") == looping), "company_id", "operation", most).select("company_id", F.lit(True).alias("__d"))
    return out.unionByName(candidates.select("company_id").distinct().join(many, "company_id", "left").select(F.lit("iteration_limit").alias("check_id"), "company_id", result(F.col("__d").isNull()).alias("result")))


def rechecks(research: DataFrame, calls: DataFrame) -> DataFrame:
    """(invocation_id, reevaluation_id): the first successful re-evaluation of the company after each research, or null.

    research(invocation_id, company_id, operation, ended_at); calls(invocation_id, company_id, operation, status, started_at).
    """
    again = calls.filter("status = 'succeeded'").select("company_id", "operation", "started_at", F.col("invocation_id").alias("reevaluation_id"))
    again = first_per(again, ["company_id", "operation", "started_at"], [F.col("reevaluation_id")])
    return first_after(research, again, ["company_id", "operation"], "ended_at", "started_at", ["reevaluation_id"]).select("invocation_id", "reevaluation_id")


def previous_calls(calls: DataFrame) -> DataFrame:
    """(invocation_id, previous_id): the latest earlier successful call of the same operation and company."""
    w = Window.partitionBy("operation", "company_id").orderBy("started_at", "invocation_id").rowsBetween(Window.unboundedPreceding, -1)
    return calls.select("invocation_id", F.last(F.when(F.col("status") == "succeeded", F.col("invocation_id")), ignorenulls=True).over(w).alias("previous_id"))


def nested(events: DataFrame, by: list[str], order: str, kind: str, start: str, end: str, ident: str) -> DataFrame:
    """(ident, parent): the call that was open when each call of a stack started.

    A call's depth is the starts before it less the ends; its parent is the last
    start one level up.
    """
    step = F.when(F.col(kind) == start, 1).when(F.col(kind) == end, -1).otherwise(0)
    w = Window.partitionBy(*by).orderBy(order)
    depth = events.withColumn("__d", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col(kind) == start)
    # Among starts of this level and the one above, the last of the level above.
    level_ = depth.select(*by, order, ident, "__d").withColumn("__l", F.explode(F.array("__d", F.col("__d") + 1)))
    up = F.last(F.when(F.col("__d") == F.col("__l") - 1, F.col(ident)), ignorenulls=True).over(Window.partitionBy(*by, "__l").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return level_.withColumn("parent", up).filter(F.col("__d") == F.col("__l")).select(*by, ident, "parent")
