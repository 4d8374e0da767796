"""Invariants of the records as predicates, one table of rules for all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.joins import violations

ASSESSED = "(evaluation_status = 'completed') = (verdict is not null)"
REASON = "evaluation_status not in ('missing', 'error', 'not_applicable') or trim(coalesce(reason, '')) <> ''"
#: Predicates that must hold, by record and rule; null counts as broken.
RULES: dict[str, dict[str, str]] = {
    "assessment": {"verdict iff completed": ASSESSED, "reason": REASON},
    "metric_result": {"value only if completed": "value is null or evaluation_status = 'completed'", "empty completed needs a reason": "not (evaluation_status = 'completed' and value is null) or trim(coalesce(reason, '')) <> ''", "range": "value is null or value between 0 and 1"},
    "source_location": {"offsets": "start_offset >= 0 and end_offset >= start_offset"},
    "timing": {"order": "ended_at is null or (started_at is not null and started_at <= ended_at)", "duration needs a start": "duration is null or started_at is not null"},
    "retrieval_settings": {"overlap": "overlap < chunk_size"},
    "artifact": {"saved": "status <> 'saved' or (sha256 is not null and size > 0 and parseable)", "error": "status <> 'error' or error is not null"},
    "run_manifest": {"fallback iff reasons": "fallback_used = (size(coalesce(fallback_reasons, array())) > 0)", "terminal has ended": "status not in ('succeeded', 'failed', 'cancelled') or ended_at is not null", "formats saved": "status <> 'succeeded' or size(array_except(requested_formats, saved_formats)) = 0"},
    "evaluation_manifest": {"counts": "completed <= total", "previous": "previous_id is null or (previous_id <> evaluation_id and trim(coalesce(reason, '')) <> '')", "terminal has ended": "status not in ('completed', 'partial', 'failed') or ended_at is not null", "completed is whole": "status <> 'completed' or completed = total"},
    "retrieval": {"ranks ascend": "size(ranks) < 2 or forall(sequence(1, size(ranks) - 1), i -> ranks[i] > ranks[i - 1])"},
    "invocation": {
        "not its own parent": "not (parent_id <=> invocation_id)",
        "not its own previous": "not (previous_id <=> invocation_id)",
        "previous iff link reason": "(previous_id is not null) = (link_reason is not null)",
        "attempt iff retry": "(attempt > 1) = coalesce(link_reason = 'retry', false)",
        "fallback iff reason": "fallback_used = (fallback_reason is not null)",
        "ended": "status = 'running' or ended_at is not null",
        "failed has error": "status <> 'failed' or error is not null",
        "succeeded has snapshots": "status <> 'succeeded' or (input_sha256 is not null and output_sha256 is not null)",
    },
    "sample": {"reason": REASON},
    "metric_input": {"context kind": "context_kind is null or context_kind = 'retrieved' or (metric_name = 'faithfulness' and context_kind = 'received_input')"},
    "metric_trace": {"counts together": "(numerator is null) = (denominator is null)", "numerator": "numerator is null or numerator <= denominator", "count source": "numerator is null or count_source is not null", "reason": "status = 'available' or reason is not null"},
    "workflow_manifest": {"unique steps": "size(step_ids) = size(array_distinct(step_ids))", "unique candidates": "size(candidates) = size(array_distinct(candidates))"},
    "additional_research": {"new is not duplicate": "not arrays_overlap(new_evidence_ids, duplicate_evidence_ids)", "outcome": "(outcome = 'new_evidence') = (size(new_evidence_ids) > 0)"},
    "reference_fact": {"reviewed": "review_status = 'pending' or (reviewer is not null and reviewed_at is not null)", "verified has sources": "review_status <> 'verified' or (size(source_ids) > 0 and size(source_locations) > 0)"},
    "grounding": {"grounded iff completed": "(evaluation_status = 'completed') = (grounded is not null)", "true has ids": "not coalesce(grounded, false) or size(evidence_ids) > 0"},
    "citation": {"verdict iff completed": ASSESSED, "supported has a location": "not coalesce(verdict = 'supported', false) or (size(source_locations) > 0 and size(evidence_ids) > 0)"},
    "claim_counts": {"verdicts": "n_verified + n_contradicted + n_unverifiable = n_judged", "judged": "n_judged + n_pending = n_claims", "critical": "n_critical_contradicted <= n_contradicted and n_critical_unverifiable <= n_unverifiable"},
    "check_counts": {"parts": "n_pass + n_fail + n_error + n_missing + n_pending = n_applicable"},
    "usage": {"cached": "cached is null or cached <= input", "cost": "cost is null or (currency is not null and price_version is not null and price_date is not null and method is not null)", "no cost has a reason": "cost is not null or reason is not null"},
    "runtime": {"null has a reason": "seconds is not null or reason is not null", "cost has a currency": "cost is null or currency is not null"},
    "comparison_pair": {"distinct runs": "before_run <> after_run", "input change": "not input_changed or (mode = 'end_to_end' and reason is not null)"},
    "atom": {"offsets": "end_offset > start_offset"},
    "dataset_fact": {"verified has a review kind": "review_status <> 'verified' or review_kind is not null", "critical": "category = 'market' or critical"},
    "required_item": {"not applicable has a reason": "applicability <> 'not_applicable' or trim(coalesce(not_applicable_reason, '')) <> ''"},
    "case_review": {"reviewed": "completeness = 'pending' or (reviewer is not null and reviewed_at is not null and review_kind is not null)", "route": "expected_route is null or route_reason is not null"},
    "fact_assessment": {"decided has references": "not coalesce(verdict in ('verified', 'contradicted'), false) or (size(reference_ids) > 0 and size(source_locations) > 0)"},
    "coverage_assessment": {"not applicable": "(evaluation_status = 'not_applicable') = (applicability = 'not_applicable')", "fulfilled": "not coalesce(verdict = 'fulfilled', false) or size(failures) = 0"},
    "review_decision": {"adjudicated": "(status = 'adjudicated') = (size(array_distinct(resolves)) >= 2)", "others resolve none": "status = 'adjudicated' or size(resolves) = 0"},
    "context": {"hash": "sha256 = sha2(text, 256)"},
}


def rules(spark: SparkSession) -> DataFrame:
    """The catalogue as a table: record, rule, predicate."""
    return spark.createDataFrame([(t, r, p) for t, of in RULES.items() for r, p in of.items()], "record string, rule string, predicate string")


def broken(tables: dict[str, DataFrame], ident: str = "id") -> DataFrame:
    """(table, row, rule): every row of the given records that breaks a rule of its record."""
    parts = [violations(frame, name, ident, RULES[name]) for name, frame in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def one_value(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """Keys whose rows do not all have the same value, with the number of values (null is one)."""
    return frame.groupBy(*by).agg((F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))).alias("n_values")).filter("n_values > 1")
