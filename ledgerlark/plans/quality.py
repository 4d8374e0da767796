"""Judgements as data: policies over proposals, and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import numeric_relation, quantity, ratio
from ledgerlark.operators.aggregates import item_state
from ledgerlark.operators.joins import by_member, sized
from ledgerlark.session import dealt, tasks_of


def eligible_facts(samples: DataFrame, facts: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """Samples with their facts as of the sample's date, and the ids of those that are not eligible.

    ``exact``: the fact's date must equal the sample's; otherwise it may be
    earlier.  The source's date is never later in the exact form.  A sample
    without facts keeps empty lists.
    """
    j = samples.join(facts, keys, "left")
    dated = (F.col("fact_date") == F.col("as_of_date")) & (F.col("source_date") <= F.col("as_of_date")) if exact else F.col("fact_date") <= F.col("as_of_date")
    ok = F.coalesce((F.col("review_status") == "verified") & dated, F.lit(False))
    return j.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.when(ok, F.col("fact_id")))).alias("facts"), F.array_sort(F.collect_list(F.when(~ok, F.col("fact_id")))).alias("excluded"))


def judged(comparisons: DataFrame) -> DataFrame:
    """Final relation of each compared fact.

    Columns: claim_id, fact_id, proposal, gates (all of same entity, attribute,
    event, conditions and time), event_date_error, claim_quote, fact_quote,
    claim, fact (texts), fact_is_number.
    """
    p = F.col("proposal")
    both = F.col("claim_quote").isNotNull() & F.col("fact_quote").isNotNull()
    half = F.col("claim_quote").isNotNull() != F.col("fact_quote").isNotNull()
    inside = F.contains("claim", "claim_quote") & F.contains("fact", "fact_quote") & (F.trim("claim_quote") != "") & (F.trim("fact_quote") != "")
    relation = numeric_relation(quantity(F.col("claim_quote")), quantity(F.col("fact_quote")))
    strong = p.isin("supports", "contradicts")
    out = (
        F.when(~F.col("gates") & (p != "unrelated"), "insufficient")
        .when(strong & F.col("event_date_error"), "contradicts")
        .when(half, "error")
        .when(both & ~inside, "error")
        .when(both & ~((relation == "supports") & (p != "supports")), relation)
        .when(strong & F.col("fact_is_number") & ~both & F.col("claim").rlike(r"\d"), "error")
        .otherwise(p)
    )
    return comparisons.withColumn("relation", out)


def fold_verdict(relation: Column) -> Column:
    """error, then conflict or neither: unverifiable, supported: verified, else contradicted."""
    yes, no = F.bool_or(relation == "supports"), F.bool_or(relation == "contradicts")
    return F.when(F.bool_or(relation == "error"), None).when(yes == no, "unverifiable").when(yes, "verified").otherwise("contradicted")


def verdicts(comparisons: DataFrame) -> DataFrame:
    r = F.col("relation")
    selected = F.array_sort(F.collect_list(F.when(r.isin("supports", "contradicts"), F.col("fact_id"))))
    return comparisons.groupBy("claim_id").agg(fold_verdict(r).alias("verdict"), F.when(F.bool_or(r == "error"), "error").otherwise("completed").alias("status"), selected.alias("selected"), (F.bool_or(r == "supports") & F.bool_or(r == "contradicts")).alias("conflict"))


def coverage_verdict() -> Column:
    """fulfilled / missing / incorrect of a required item; columns as booleans."""
    c = F.col
    return (
        F.when(c("contradicted"), "incorrect")
        .when(~c("mentioned"), "missing")
        .when(~c("accurate") | c("invented"), "incorrect")
        .when(c("has_facts"), F.when(c("all_verified") & c("rules_met"), "fulfilled").otherwise("missing"))
        .otherwise(F.when(c("uncertainty_explicit") & c("rules_met"), "fulfilled").otherwise("missing"))
    )


def coverage(items: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Coverage of folded items, and of the expected items that no row has: these keep the rate unknown."""
    absent = expected.join(items.select(*by, "item_id").distinct(), [*by, "item_id"], "left_anti").withColumn("state", F.when(F.col("applicable"), "unjudged").otherwise("not_applicable"))
    both = items.select(*by, "item_id", "state").unionByName(absent.select(*by, "item_id", "state"))
    s = F.col("state")
    n = F.count_if(s != "not_applicable")
    return both.groupBy(*by).agg(n.alias("n_items"), *[F.count_if(s == x).alias(f"n_{x}") for x in ("fulfilled", "missing", "incorrect", "unjudged")], ratio(F.count_if(s == "fulfilled"), n, F.count_if(s == "unjudged") == 0).alias("coverage"))


#: The scopes of a coverage report and the columns that make each; those with fixed items get what no sample has.
SCOPES = {"sample": ("sample_id",), "case": ("case_id",), "company": ("company_id",), "section": ("section_id",), "company_section": ("company_id", "section_id"), "report": ()}
FIXED = ("company", "section", "company_section", "report")


def coverage_scopes(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Coverage of every scope and stage.

    rows: one a sample and item: sample_id, case_id, company_id, section_id,
    stage, item_id, applicable, status, verdict.  items (the dataset's):
    item_id, company_id, section_id, applicable; an applicable one that no row
    of a broad scope has enlarges its denominator and keeps its rate unknown.

    One pass groups by the broad scopes and item, a second folds the items.  Samples are
    as many as the rows are; they are dealt to tasks of a fixed size and folded there.
    """
    keys = ["sample_id", "case_id", "company_id", "section_id"]
    state = item_state()
    sets = [[F.col(c) for c in (*of, "stage", "item_id")] for name, of in SCOPES.items() if name != "sample"]
    every = [*keys, "stage", "item_id"]
    folded = rows.groupingSets(sets, *[F.col(c) for c in every]).agg(F.grouping_id(*every).alias("g"), state.alias("state"))
    bits = {name: sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c in keys and c not in of) for name, of in SCOPES.items()}
    scope = F.lit(None).cast("string")
    for name, b in bits.items():
        scope = F.when(F.col("g") == b, name).otherwise(scope)
    folded = folded.withColumn("scope", scope).drop("g")
    # What the fixed items add: each key of a broad scope wants all items of its scope.
    broad = folded.filter(F.col("scope").isin(*FIXED))
    groups = broad.select("scope", "company_id", "section_id", "stage").distinct()
    wants = lambda c, of: F.col(c).isNull() | ~F.col("scope").isin(*of)
    i = items.select("item_id", F.col("company_id").alias("ic"), F.col("section_id").alias("ix"), F.col("applicable").alias("ia"))
    on = (wants("company_id", ("company", "company_section")) | (F.col("company_id") == F.col("ic"))) & (wants("section_id", ("section", "company_section")) | (F.col("section_id") == F.col("ix")))
    # A group per company and section at most, and the dataset's fixed items: sized on the item side.
    expected = groups.join(sized(i), on)
    match = [F.col(f"e.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("scope", "company_id", "section_id", "stage", "item_id")]
    absent = expected.alias("e").join(broad.alias("b"), match, "left_anti").select("scope", "company_id", "section_id", "stage", "item_id", "ia")
    absent = absent.select(F.lit(None).cast(rows.schema["sample_id"].dataType).alias("sample_id"), F.lit(None).cast(rows.schema["case_id"].dataType).alias("case_id"), "company_id", "section_id", "stage", "item_id", F.when(F.col("ia"), "unrepresented").otherwise("not_applicable").alias("state"), "scope")
    s = F.col("state")
    n = F.count_if(s != "not_applicable")
    whole = (F.count_if(s.isin("unjudged", "unrepresented")) == 0) & (n > 0)
    counts = [n.alias("n_items"), *[F.count_if(s == x).alias(f"n_{x}") for x in ("fulfilled", "missing", "incorrect", "unjudged", "unrepresented")], ratio(F.count_if(s == "fulfilled"), n, whole).alias("coverage")]
    each = dealt(rows, tasks_of(rows), "sample_id").groupBy("sample_id", "stage", "item_id").agg(state.alias("state")).groupBy("sample_id", "stage").agg(*counts)
    out = folded.unionByName(absent).groupBy("scope", *keys, "stage").agg(*counts)
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in keys[1:]]
    return out.unionByName(each.select(F.lit("sample").alias("scope"), "sample_id", *none, *each.columns[1:]))


def item_facts(items: DataFrame, facts: DataFrame) -> DataFrame:
    """(item_id, facts): the verified facts that an item names and that are no later than its date."""
    each = by_member(items.select("item_id", "as_of_date", "reference_ids"), "reference_ids", facts.select("reference_id", "fact_id", "review_status", "fact_date"), "reference_id", "left")
    fine = F.coalesce((F.col("review_status") == "verified") & (F.col("fact_date") <= F.col("as_of_date")), F.lit(False))
    return each.groupBy("item_id").agg(F.array_sort(F.collect_list(F.when(fine, F.col("fact_id")))).alias("facts"))


def beside_recall(samples: DataFrame, results: DataFrame, summaries: DataFrame, cases: DataFrame) -> DataFrame:
    """One row a sample: its coverage beside its factual recall, two measures that are never mixed.

    samples(sample_id, case_id, stage); results(sample_id, metric_name,
    position, status, value), the last of a sample counts; summaries as from
    :func:`coverage_scopes`; cases(case_id, required_item_ids).  A sample without
    a result, a summary or a case keeps nulls, or an empty list of items.
    """
    recall = results.filter("metric_name = 'factual_recall'").groupBy("sample_id").agg(F.max_by(F.struct("status", "value"), "position").alias("factual_recall"))
    counts = [c for c in summaries.columns if c.startswith("n_")]
    own = summaries.filter("scope = 'sample'").select("sample_id", "stage", F.struct(*counts, "coverage").alias("required_information"))
    items = cases.select("case_id", "required_item_ids")
    out = samples.select("sample_id", "case_id", "stage").join(recall, "sample_id", "left").join(own, ["sample_id", "stage"], "left").join(items, "case_id", "left")
    none = F.array().cast(items.schema["required_item_ids"].dataType)
    return out.select("sample_id", "case_id", "stage", F.coalesce("required_item_ids", none).alias("required_item_ids"), "factual_recall", "required_information")
