"""Claims against facts: eligibility, verdicts, conflicts, and the same claims under two extractors or modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.text import normal_statement
from ledgerlark.plans.quality import verdicts


def only_facts(atoms: DataFrame, by: list[str]) -> DataFrame:
    """Per key the claims that state facts (as a list) and how many other atoms were left out."""
    fact = F.col("kind") == "fact"
    return atoms.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(fact, F.col("claim_id")))).alias("claims"), F.count_if(~F.coalesce(fact, F.lit(False))).alias("n_excluded"))


def conflicts(facts: DataFrame, by: list[str]) -> DataFrame:
    """Groups of comparable facts with different values: the key, the ids, and the number of conflicting pairs.

    Facts compare if category, date, unit and the sorted conditions are equal;
    facts without a value do not.  The pairs are counted from the value counts,
    never formed.
    """
    key = [*by, "category", "as_of_date", "unit", "conditions"]
    known = facts.filter(F.col("value").isNotNull()).withColumn("conditions", F.array_sort("conditions"))
    per = known.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"), F.collect_list("fact_id").alias("ids"))
    n, square = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    out = per.groupBy(*key).agg(F.count(F.lit(1)).alias("n_values"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("fact_ids"), ((n * n - square) / 2).cast("long").alias("n_pairs"))
    return out.filter("n_values > 1")


def assess(claims: DataFrame, facts: DataFrame, comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """One row a claim: status, verdict, the facts that could decide, and those that did.

    claims(claim_id, sample_status, as_of_date, critical, keys); facts(fact_id,
    review_status, fact_date, source_date, keys); comparisons(claim_id, fact_id,
    relation).  A sample that is neither pending nor completed is missing; a
    claim without eligible facts is unverifiable; a comparison set that is not
    exactly the eligible facts is an error.
    """
    dated = (F.col("fact_date") == F.col("as_of_date")) & (F.col("source_date") <= F.col("as_of_date"))
    ok = F.coalesce((F.col("review_status") == "verified") & dated, F.lit(False))
    near = claims.join(facts, keys, "left")
    could = near.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.when(ok, F.col("fact_id")))).alias("considered"), F.array_sort(F.collect_list(F.when(~ok, F.col("fact_id")))).alias("excluded"))
    judged = comparisons.groupBy("claim_id").agg(F.array_sort(F.collect_list("fact_id")).alias("compared"))
    folded = verdicts(comparisons).select("claim_id", F.col("verdict").alias("__v"), F.col("status").alias("__s"), "selected", "conflict")
    out = claims.select("claim_id", "sample_status", "critical", *keys).join(could, "claim_id").join(judged, "claim_id", "left").join(folded, "claim_id", "left")
    whole = F.coalesce("compared", F.array().cast("array<bigint>")) == F.col("considered")
    status = F.when(~F.col("sample_status").isin("pending", "completed"), "missing").when(F.size("considered") == 0, "completed").when(~whole, "error").otherwise(F.col("__s"))
    verdict = F.when(status != "completed", None).when(F.size("considered") == 0, "unverifiable").otherwise(F.col("__v"))
    picked = F.when(verdict.isin("verified", "contradicted"), F.col("selected")).when(verdict == "unverifiable", F.col("considered"))
    return out.select("claim_id", *keys, "critical", status.alias("status"), verdict.alias("verdict"), "considered", "excluded", picked.alias("selected"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def group_status(complete: Column, pending: Column, total: Column) -> Column:
    """Status of a group: completed, not_applicable without claims, else partial."""
    return F.when(complete & (pending == 0), F.when(total > 0, "completed").otherwise("not_applicable")).otherwise("partial")


def same_statements(native: DataFrame, custom: DataFrame, keys: list[str], statement: str) -> DataFrame:
    """Native claims with the custom claims of the same normalised statement; unmatched ones of both sides stay."""
    norm = normal_statement(F.col(statement))
    a = native.select(*keys, F.col("native_id"), norm.alias("__n"))
    b = custom.select(*keys, F.col("claim_id"), norm.alias("__n"))
    return a.join(b, [*keys, "__n"], "full_outer").select(*keys, "native_id", "claim_id", F.when(F.col("claim_id").isNull(), "native only").when(F.col("native_id").isNull(), "custom only").otherwise("both").alias("match"))


def paired_calls(events: DataFrame, by: list[str], kind: str, start: str, end: str) -> DataFrame:
    """One row a call key: start and end times of callbacks, and whether both came."""
    t = lambda k: F.min(F.when(F.col(kind) == k, F.col("at")))
    out = events.groupBy(*by).agg(t(start).alias("started"), t(end).alias("ended"))
    return out.withColumn("status", F.when(F.col("started").isNull(), "no start").when(F.col("ended").isNull(), "no end").when(F.col("ended") < F.col("started"), "out of order").otherwise("paired"))


def two_modes(rows: DataFrame, key: str, mode: str, modes: tuple[str, str], score: str, shared: list[str]) -> DataFrame:
    """The scores of two modes side by side; a key whose modes saw different inputs is an error, one with a mode absent is missing."""
    wide = rows.groupBy(key).agg(
        *[F.max(F.when(F.col(mode) == m, F.col(score))).alias(m) for m in modes],
        *[F.count_if(F.col(mode) == m).alias(f"__n{i}") for i, m in enumerate(modes)],
        F.max(F.struct(*shared)).alias("__hi"),
        F.min(F.struct(*shared)).alias("__lo"),
    )
    status = F.when((F.col("__n0") > 1) | (F.col("__n1") > 1), "duplicate").when((F.col("__n0") == 0) | (F.col("__n1") == 0), "missing").when(F.col("__hi") != F.col("__lo"), "error").otherwise("completed")
    return wide.select(key, *[F.when(status == "completed", F.col(m)).alias(m) for m in modes], status.alias("status"))
