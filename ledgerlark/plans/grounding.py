"""Grounding and citations: bindings of markers, the ladder of results, and rates that need all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import ratio
from ledgerlark.session import dealt, tasks_of

# Fixed value: what counts as a citation marker.
MARKER = r"\[SOURCE:[^\]]+\]|\[\d+\]|https?://[^\s)\]]+"
#: Samples whose counts one task holds.
SAMPLES_A_TASK = 100_000
BASES = ("source_evidence", "delivered_context")


def bindings(claims: DataFrame) -> DataFrame:
    """(claim_id, marker, binding) of each marker of a claim's unit.

    Columns: claim_id, unit (text), quote, quote_end (in the unit), declared
    (markers the extractor named).  explicit: declared, or inside the quote;
    adjacent: in the run of markers right after the quote; else ambiguous.
    """
    found = lambda c: F.regexp_extract_all(c, F.lit(f"({MARKER})"), F.lit(1))
    rest = F.substr("unit", F.col("quote_end") + 1)
    tail = F.regexp_extract(rest, rf"^[\s.,;。]*((?:(?:{MARKER})[\s,;]*)+)", 1)
    explicit = F.array_union(F.coalesce("declared", F.array().cast("array<string>")), found(F.col("quote")))
    each = claims.withColumns({"__e": explicit, "__a": found(tail)}).withColumn("marker", F.explode(F.array_union(F.array_union("__e", "__a"), found(F.col("unit")))))
    binding = F.when(F.array_contains("__e", F.col("marker")), "explicit").when(F.array_contains("__a", F.col("marker")), "adjacent").otherwise("ambiguous")
    return each.select("claim_id", "marker", binding.alias("binding"))


def citation_targets(bound: DataFrame, footnotes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, source_id, markers, binding, has_text): markers resolved to sources, equal sources merged.

    footnotes(number, url); evidence(source_id, url, text).  A marker names a
    source by id, URL or ``[SOURCE:id]``; none: unresolved:<marker>.  A source
    bound explicitly or adjacently by any marker is not ambiguous.
    """
    number = F.regexp_extract("marker", r"^\[(\d+)\]$", 1)
    named = bound.withColumn("__k", number).join(footnotes.select(F.col("number").cast("string").alias("__k"), F.col("url").alias("__u")), "__k", "left")
    named = named.withColumn("alias", F.regexp_replace(F.coalesce("__u", "marker"), "[.,;。]+$", ""))
    forms = F.array_compact(F.array("source_id", "url", F.concat(F.lit("[SOURCE:"), "source_id", F.lit("]"))))
    known = evidence.select("source_id", (F.trim("text") != "").alias("__t"), F.explode(forms).alias("alias")).groupBy("alias", "source_id").agg(F.bool_or("__t").alias("__t"))
    hit = named.join(known, "alias", "left").withColumn("source_id", F.coalesce("source_id", F.concat(F.lit("unresolved:"), "marker")))
    rank = F.when(F.col("binding") == "explicit", 0).when(F.col("binding") == "adjacent", 1).otherwise(2)
    per = hit.groupBy("claim_id", "source_id").agg(F.array_sort(F.collect_set("marker")).alias("markers"), F.min(rank).alias("__r"), F.coalesce(F.bool_or("__t"), F.lit(False)).alias("has_text"))
    return per.withColumn("binding", F.element_at(F.array(*map(F.lit, ("explicit", "adjacent", "ambiguous"))), F.col("__r") + 1)).drop("__r")


def citation_results(targets: DataFrame) -> DataFrame:
    """``targets`` with sample_status and support (of the judged documents) as status and verdict."""
    missing = F.col("sample_status").isin("error", "missing") | (F.col("binding") == "ambiguous")
    status = F.when(missing, "missing").when(~F.col("has_text"), "completed").when(F.coalesce(F.col("support"), F.lit("error")) == "error", "error").otherwise("completed")
    verdict = F.when(status != "completed", None).when(~F.col("has_text"), "inaccessible").otherwise(F.col("support"))
    return targets.withColumns({"status": status, "verdict": verdict})


def grounding_results(claims: DataFrame) -> DataFrame:
    """One row a claim and basis.

    Columns: claim_id, sample_id, sample_status, and for each basis
    <basis>_observed and <basis>_support (null without a judgement).
    """
    rows = F.array(*[F.struct(F.lit(b).alias("basis"), F.col(f"{b}_observed").alias("observed"), F.col(f"{b}_support").alias("support")) for b in BASES])
    each = claims.select("claim_id", "sample_id", "sample_status", F.explode(rows).alias("b")).select("claim_id", "sample_id", "sample_status", "b.*")
    status = F.when(F.col("sample_status").isin("error", "missing") | ~F.coalesce("observed", F.lit(False)), "missing").when(F.coalesce(F.col("support"), F.lit("error")) == "error", "error").otherwise("completed")
    return each.withColumn("status", status).withColumn("grounded", F.when(F.col("status") == "completed", F.col("support") == "supported"))


def grounding_summary(samples: DataFrame, grounding: DataFrame, citations: DataFrame, claims: DataFrame) -> DataFrame:
    """One row a sample and basis, with the sample's citation counts; rates only of complete rows.

    samples(sample_id, evaluation_status); citations(claim_id, sample_id,
    status, verdict); claims(claim_id, sample_id).  A sample is one row until its
    bases are made rows; samples are dealt to tasks of a fixed size.
    """
    tasks = tasks_of(samples, SAMPLES_A_TASK)
    fine = ~F.col("evaluation_status").isin("error", "missing")
    done, yes = F.col("status") == "completed", F.col("grounded")
    mine = lambda b, name: F.count_if((F.col("basis") == b) & {"total": F.lit(True), "judged": done, "grounded": F.coalesce(yes, F.lit(False))}[name]).alias(f"{b}_{name}")
    of_basis = ("total", "judged", "grounded")
    g = dealt(grounding.select("sample_id", "basis", "status", "grounded"), tasks, "sample_id").groupBy("sample_id").agg(*[mine(b, n) for b in BASES for n in of_basis])
    c = dealt(citations.select("sample_id", "status", "verdict"), tasks, "sample_id").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_citations"), F.count_if(done).alias("n_cited_judged"), *[F.count_if(done & (F.col("verdict") == v)).alias(f"n_{v}") for v in ("supported", "unsupported", "contradicted", "inaccessible")])
    bare = dealt(claims, tasks, "claim_id").join(dealt(citations.select("claim_id"), tasks, "claim_id"), "claim_id", "left_anti")
    bare = dealt(bare.select("sample_id"), tasks, "sample_id").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_uncited"))
    counts = ["total", "judged", "grounded", "n_citations", "n_cited_judged", "n_supported", "n_unsupported", "n_contradicted", "n_inaccessible", "n_uncited"]
    j = dealt(samples.select("sample_id", fine.alias("fine")), tasks, "sample_id").join(g, "sample_id", "left").join(c, "sample_id", "left").join(bare, "sample_id", "left")
    rows = F.array(*[F.struct(F.lit(b).alias("basis"), *[F.col(f"{b}_{n}").alias(n) for n in of_basis]) for b in BASES])
    j = j.select("sample_id", "fine", *counts[3:], F.explode(rows).alias("b")).select("sample_id", "fine", "b.*", *counts[3:]).fillna(0, counts)
    whole, cited = F.col("fine") & (F.col("total") == F.col("judged")), F.col("fine") & (F.col("n_citations") == F.col("n_cited_judged"))
    state = lambda ok, n: F.when(ok, F.when(n > 0, "completed").otherwise("not_applicable")).otherwise("partial")
    return j.select(
        "sample_id", "basis", *counts,
        ratio(F.col("grounded"), F.col("total"), whole).alias("grounded_rate"), state(whole, F.col("total")).alias("grounding_status"),
        ratio(F.col("n_supported"), F.col("n_citations"), cited).alias("support_rate"), state(cited, F.col("n_citations")).alias("citation_status"),
    )


def lineage_problems(contexts: DataFrame, invocations: DataFrame) -> DataFrame:
    """Contexts from upstream calls that ended only after the context was delivered: (context_id, upstream_id).

    contexts(context_id, invocation_id, upstream_ids); invocations(invocation_id, started_at, ended_at).
    """
    own = invocations.select("invocation_id", F.col("started_at").alias("__at"))
    up = invocations.select(F.col("invocation_id").alias("upstream_id"), F.col("ended_at").alias("__end"))
    each = contexts.join(own, "invocation_id").withColumn("upstream_id", F.explode(F.array_distinct("upstream_ids"))).join(up, "upstream_id")
    return each.filter(F.col("__end").isNull() | (F.col("__end") > F.col("__at"))).select("context_id", "upstream_id")
