"""Claims and the claims they came from, within what was really delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.text import normal_statement
from ledgerlark.plans.review import lineage_class
from ledgerlark.session import kept


def upstream_samples(samples: DataFrame, invocations: DataFrame, contexts: DataFrame) -> DataFrame:
    """(sample_id, upstream_id, basis, failed): the intermediate samples of a sample's company and section whose calls it built on.

    Those are the calls upstream of its delivered contexts, the call it repeats, and for
    a final sample its own; a sample is not upstream of itself.  samples(sample_id,
    invocation_id, stage, company_id, section_id, context_ids, status);
    invocations(invocation_id, previous_id); contexts(context_id, upstream_ids).
    """
    own = samples.select("sample_id", "invocation_id", "stage", "company_id", "section_id", "context_ids").join(invocations.select("invocation_id", "previous_id"), "invocation_id")
    given = contexts.select(F.col("context_id").alias("c"), "upstream_ids")
    delivered = own.select("sample_id", F.explode("context_ids").alias("c")).join(given, "c").select("sample_id", F.explode("upstream_ids").alias("call"))
    again = own.filter("previous_id is not null").select("sample_id", F.col("previous_id").alias("call"))
    final = own.filter("stage = 'final'").select("sample_id", F.col("invocation_id").alias("call"))
    calls = delivered.unionByName(again).unionByName(final).distinct().join(own.drop("context_ids"), "sample_id")
    up = samples.filter("stage = 'intermediate'").select(F.col("sample_id").alias("upstream_id"), F.col("invocation_id").alias("u_call"), F.col("company_id").alias("u_company"), F.col("section_id").alias("u_section"), (F.col("status") == "error").alias("failed"))
    same = (F.col("call") == F.col("u_call")) & F.col("company_id").eqNullSafe(F.col("u_company")) & F.col("section_id").eqNullSafe(F.col("u_section")) & (F.col("sample_id") != F.col("upstream_id"))
    basis = F.when(F.col("u_call").eqNullSafe(F.col("previous_id")), "reevaluation").when(F.col("stage") == "final", "report_artifact").otherwise("actual_delivered_context")
    return calls.join(up, same).select("sample_id", "upstream_id", basis.alias("basis"), "failed")


def connect(samples: DataFrame, claims: DataFrame, invocations: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claim_id, upstream_claim_id, relation, basis, candidate) and (claim_id, lineage).

    claims(claim_id, sample_id, position, relation_key, text); samples also have
    reference_lines (null without a reference).  Claims are linked if they state the same
    relation and their samples are; candidates of several links are folded in the order of the
    upstream claims (``review.lineage_class``).  Without a link a claim is new if its sample
    has upstream samples and none of them failed.

    All that concerns a claim's sample is met by the sample, upstream claims by sample and
    relation; claims are folded where they have met, so none is moved for its id.
    """
    up = kept(upstream_samples(samples, invocations, contexts))
    state = up.groupBy("sample_id").agg((~F.bool_or("failed")).alias("has_upstream"))
    said = claims.select("claim_id", "sample_id", "position", "relation_key", normal_statement(F.col("text")).alias("said"))
    lines = samples.select(F.col("sample_id").alias("r_sample"), F.explode("reference_lines").alias("line")).filter(F.trim("line") != "")
    lines = lines.groupBy("r_sample").agg(F.collect_set(normal_statement(F.col("line"))).alias("r_lines"))
    said = said.join(lines, F.col("sample_id") == F.col("r_sample"), "left").withColumn("is_reference", F.coalesce(F.array_contains("r_lines", F.col("said")), F.lit(False))).drop("r_sample", "r_lines")
    said = kept(said.join(state, "sample_id", "left"))
    theirs = said.select(F.col("claim_id").alias("upstream_claim_id"), F.col("sample_id").alias("upstream_id"), F.col("relation_key").alias("u_key"), F.col("said").alias("upstream_text"), F.col("position").alias("place"))
    offered = theirs.join(up.select(F.col("sample_id").alias("for"), "upstream_id", "basis"), "upstream_id").drop("upstream_id").withColumn("linked", F.lit(True))
    same = (F.col("sample_id") == F.col("for")) & (F.col("relation_key") == F.col("u_key"))
    repeated = F.col("said") == F.col("upstream_text")
    candidate = F.when(repeated, "inherited").when(F.col("is_reference"), "corrected").otherwise("unknown")
    links = said.drop("position").join(offered, same).select("claim_id", "upstream_claim_id", F.when(repeated, "repeated").otherwise("changed").alias("relation"), "basis", candidate.alias("candidate"))
    pairs = said.drop("position").join(offered, same, "left").select("sample_id", "relation_key", "claim_id", F.col("place").alias("position"), F.col("said").alias("text"), "upstream_text", "is_reference", F.coalesce("linked", "has_upstream", F.lit(False)).alias("has_upstream"))
    return links, lineage_class(pairs, "sample_id", "relation_key")
