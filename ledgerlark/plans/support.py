"""Whether documents support a claim: quotes, scope and quantities of each comparison, and what they come to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import numeric_relation, quantity
from ledgerlark.plans.grounding import MARKER

COMPARISON = ("relation", "quote", "start", "end", "same_entity", "same_time", "same_conditions", "claim_quantity", "document_quantity")


def compared(claims: DataFrame, documents: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row a claim and document: claim_id, document_id, relation, final, problem, quote, start, end.

    claims(claim_id, claim, company_id); documents(claim_id, document_id, text,
    company_ids): what may ground a claim; comparisons: claim_id, document_id
    and COMPARISON, offsets in code points.  ``final`` is supported,
    contradicted, unsupported or, with a problem, error: each document must be
    compared once and no other one; a relation needs a quote that stands at its
    offsets and is more than a marker; scope or another company makes it
    unsupported; quantities must be quoted where the claim has digits, and
    decide against the proposal.  A null flag is false, a null list of
    companies is open to all.
    """
    keys = ["claim_id", "document_id"]
    one = comparisons.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*COMPARISON)).alias("__c"))
    given = documents.select(*keys, "text", "company_ids", F.lit(True).alias("__given"))
    j = given.join(one, keys, "full_outer").select(*keys, "text", "company_ids", "__given", "__n", "__c.*").join(claims.select("claim_id", "claim", "company_id"), "claim_id")
    yes = lambda c: F.coalesce(c, F.lit(False))
    at = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("text")) & (F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote"))
    j = j.withColumns({
        "__open": F.col("relation") != "unsupported",
        "__at": yes(at),
        "__bare": F.col("quote").rlike(rf"(?U)^\s*(?:{MARKER})?\s*$"),
        "__scope": yes(F.col("same_entity")) & yes(F.col("same_time")) & yes(F.col("same_conditions")) & ~yes(F.col("company_id").isNotNull() & (F.size("company_ids") > 0) & ~F.array_contains("company_ids", F.col("company_id"))),
        "__numbers": F.col("claim_quantity").isNotNull() | F.col("document_quantity").isNotNull(),
        "__quoted": yes((F.col("claim_quantity") != "") & (F.col("document_quantity") != "") & F.contains("claim", "claim_quantity") & F.contains("quote", "document_quantity")),
    })
    problem = (
        F.when(F.col("__given").isNull(), "not a document of the claim")
        .when(F.col("__n").isNull(), "not compared")
        .when(F.col("__n") > 1, "compared twice")
        .when(F.col("relation").isNull() | ~F.col("relation").isin("supported", "contradicted", "unsupported"), "unknown relation")
        .when(F.col("__open") & ~F.col("__at"), "quote is not at its offsets")
        .when(F.col("__open") & F.col("__bare"), "a marker supports nothing")
        .when(F.col("__open") & F.col("__scope") & F.col("__numbers") & ~F.col("__quoted"), "quantities are not in the quotes")
        .when(F.col("__open") & F.col("__scope") & ~F.col("__numbers") & F.col("claim").rlike(r"(?U)\d"), "quantities are not quoted")
    )
    j = j.withColumns({"problem": problem, "__cq": quantity(F.col("claim_quantity")), "__dq": quantity(F.col("document_quantity"))})
    j = j.withColumn("__numeric", numeric_relation(F.col("__cq"), F.col("__dq")))
    final = (
        F.when(F.col("problem").isNotNull(), "error")
        .when(~F.col("__open"), F.col("relation"))
        .when(~F.col("__scope"), "unsupported")
        .when(F.col("__numbers") & (F.col("__numeric") == "contradicts"), "contradicted")
        .when(F.col("__numbers") & (F.col("__numeric") == "insufficient"), "unsupported")
        .otherwise(F.col("relation"))
    )
    return j.select(*keys, "relation", final.alias("final"), "problem", "quote", "start", "end")


def support(claims: DataFrame, compared_: DataFrame) -> DataFrame:
    """One row a claim: claim_id, status, support, grounded, supporting, conflict (document ids, sorted).

    ``compared_`` as from :func:`compared`.  Any error leaves the claim
    unjudged; support and contradiction together are a conflict and leave it
    unsupported; a claim without documents is unsupported.
    """
    is_ = lambda x: F.col("final") == x
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("document_id"))))
    per = compared_.groupBy("claim_id").agg(F.bool_or(is_("error")).alias("__e"), ids(is_("supported")).alias("__s"), ids(is_("contradicted")).alias("__c"))
    j = claims.select("claim_id").join(per, "claim_id", "left")
    none = F.array().cast(per.schema["__s"].dataType)
    s, c = F.coalesce("__s", none), F.coalesce("__c", none)
    bad, both = F.coalesce("__e", F.lit(False)), (F.size(s) > 0) & (F.size(c) > 0)
    verdict = F.when(~bad, F.when(both, "unsupported").when(F.size(s) > 0, "supported").when(F.size(c) > 0, "contradicted").otherwise("unsupported"))
    return j.select(
        "claim_id", F.when(bad, "error").otherwise("completed").alias("status"), verdict.alias("support"), (verdict == "supported").alias("grounded"),
        F.when(verdict == "supported", s).otherwise(none).alias("supporting"), F.when(~bad & both, F.array_sort(F.concat(s, c))).otherwise(none).alias("conflict"),
    )


def proofs(compared_: DataFrame) -> DataFrame:
    """(claim_id, document_id, start, end, quote): where the quotes of relations stand, whatever they came to."""
    return compared_.filter((F.col("relation") != "unsupported") & F.col("quote").isNotNull()).select("claim_id", "document_id", "start", "end", "quote")
