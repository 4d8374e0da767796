"""A fixed evaluation dataset: its cross references, its cases' references, and what samples take from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.dates import future
from ledgerlark.operators.joins import duplicate_keys, missing, subset


def _broken(frame: DataFrame, bad, rule: str, ident: str) -> DataFrame:
    return frame.filter(F.coalesce(bad, F.lit(True))).select(F.lit(rule).alias("rule"), F.col(ident).cast("string").alias("row"))


def violations(sources: DataFrame, facts: DataFrame, items: DataFrame, cases: DataFrame, reviews: DataFrame, version: str) -> DataFrame:
    """(rule, row): every broken key, scope, date or back reference.

    sources(source_id, company_ids, published_date); facts(fact_id,
    reference_id, company_id, section_id, as_of_date, source_as_of_date,
    source_ids, required_item_ids, review_status, review_kind);
    items(required_item_id, version, company_id, section_id, reference_ids);
    cases(case_id, company_id, section_id, reference_ids, required_item_ids);
    reviews(case_id).
    """
    out = []
    for frame, key in ((sources, "source_id"), (facts, "fact_id"), (facts, "reference_id"), (items, "required_item_id"), (cases, "case_id"), (reviews, "case_id")):
        out.append(duplicate_keys(frame, [key]).select(F.lit(f"duplicate {key}").alias("rule"), F.col(key).cast("string").alias("row")))
    gone = lambda child, parent, key, rule: missing(child, parent, key, key, rule, key).select("rule", "row")
    out += [gone(cases, reviews, "case_id", "case without review"), gone(reviews, cases, "case_id", "review without case")]
    # Facts and their sources.
    out.append(_broken(facts, F.col("company_id").isNull() | (F.size("source_ids") < 1), "fact without company or source", "fact_id"))
    out.append(_broken(facts, F.size("source_ids") != F.size(F.array_distinct("source_ids")), "repeated fact source", "fact_id"))
    each = facts.select("fact_id", "company_id", "as_of_date", "source_as_of_date", F.explode(F.array_distinct("source_ids")).alias("source_id"))
    met = each.join(sources.select("source_id", "company_ids", "published_date").withColumn("__s", F.lit(True)), "source_id", "left")
    out.append(_broken(met, F.col("__s").isNull(), "unknown fact source", "fact_id"))
    known = met.filter("__s")
    out.append(_broken(known, ~F.array_contains("company_ids", F.col("company_id")), "source of another company", "fact_id"))
    out.append(_broken(known, future(F.col("published_date"), F.col("source_as_of_date"), F.col("as_of_date")), "future source or fact", "fact_id"))
    out.append(_broken(facts, (F.col("review_status") == "verified") & ~F.coalesce(F.col("review_kind") == "human", F.lit(False)), "verified without human review", "fact_id"))
    # Facts and required items, in both directions.
    wanted = facts.select("fact_id", "reference_id", F.explode("required_item_ids").alias("required_item_id"))
    listed = items.select("required_item_id", F.explode("reference_ids").alias("reference_id"))
    out.append(wanted.join(listed, ["required_item_id", "reference_id"], "left_anti").select(F.lit("fact not listed by its item").alias("rule"), F.col("fact_id").cast("string").alias("row")))
    scope = items.select("required_item_id", F.col("company_id").alias("__c"), F.col("section_id").alias("__x"), F.explode("reference_ids").alias("reference_id"))
    own = facts.select("reference_id", "company_id", "section_id", F.col("required_item_ids").alias("__items"))
    back = scope.join(own, "reference_id", "left")
    same = F.col("company_id").eqNullSafe(F.col("__c")) & F.col("section_id").eqNullSafe(F.col("__x")) & F.col("__items").isNotNull()
    out.append(_broken(back, ~same, "item reference of another scope", "required_item_id"))
    out.append(_broken(back.filter(same), ~F.array_contains("__items", F.col("required_item_id")), "item not listed by its fact", "required_item_id"))
    out.append(_broken(items, F.col("version") != version, "item of another version", "required_item_id"))
    # Cases hold what their items need.
    need = cases.select("case_id", "reference_ids", F.explode("required_item_ids").alias("required_item_id")).join(items.select("required_item_id", F.col("reference_ids").alias("__need")), "required_item_id", "left")
    out.append(_broken(need, F.col("__need").isNull() | ~subset(F.col("__need"), F.col("reference_ids")), "case lacks its items' references", "case_id"))
    return reduce(DataFrame.unionByName, out).distinct()


def verified_references(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, reference text, excluded ids): the verified facts' statements in the case's order, a line each; null without any."""
    each = cases.select("case_id", F.posexplode("reference_ids").alias("pos", "reference_id")).join(facts.select("reference_id", "statement", "review_status"), "reference_id", "left")
    fine = F.coalesce(F.col("review_status") == "verified", F.lit(False))
    lines = F.transform(F.array_sort(F.collect_list(F.when(fine, F.struct("pos", "statement")))), lambda x: x["statement"])
    per = each.groupBy("case_id").agg(lines.alias("__l"), F.array_sort(F.collect_list(F.when(~fine, F.col("reference_id")))).alias("excluded"))
    return per.select("case_id", F.when(F.size("__l") > 0, F.array_join("__l", "\n")).alias("reference"), "excluded")


def bound_samples(samples: DataFrame, cases: DataFrame, references: DataFrame) -> DataFrame:
    """Samples with their case's reference; binding says unbound (no case) or mismatch (another company, section or date)."""
    c = cases.select("case_id", F.struct("company_id", "section_id", "as_of_date").alias("__c"))
    j = samples.join(c, "case_id", "left").join(references.select("case_id", "reference"), "case_id", "left")
    same = F.struct("company_id", "section_id", "as_of_date").eqNullSafe(F.col("__c"))
    binding = F.when(F.col("__c").isNull(), "unbound").when(~same, "mismatch").otherwise("bound")
    return j.select(*samples.columns, binding.alias("binding"), F.when(binding == "bound", F.col("reference")).alias("reference"))


def evidence_of_sources(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source_id, evidence_id): recorded evidence with a source's exact content, of one of its companies."""
    s = sources.select("source_id", "company_ids", F.col("sha256").alias("__h"))
    return evidence.join(s, evidence["sha256"] == F.col("__h")).filter(F.array_contains("company_ids", F.col("company_id"))).select("source_id", "evidence_id").distinct()


def delivered_in_order(samples: DataFrame, recorded: DataFrame) -> DataFrame:
    """(sample_id, same): whether a sample's contexts are exactly the recorded ones, in their order.

    samples(sample_id, invocation_id, contexts); recorded(invocation_id, pos, text).
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    per = recorded.groupBy("invocation_id").agg(texts.alias("__t"))
    j = samples.join(per, "invocation_id", "left")
    empty = F.array().cast("array<string>")
    return j.select("sample_id", (F.coalesce("contexts", empty) == F.coalesce("__t", empty)).alias("same"))
