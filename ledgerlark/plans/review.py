"""Review sampling and reconciliation; claim lineage; run integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.hashing import sha256
from ledgerlark.functions.numeric import ratio
from ledgerlark.functions.text import strata


def plan(targets: DataFrame, group: list[str], stratum: str, ident: str, n: int, seed: str, critical: str | None = None) -> DataFrame:
    """The first n of each group and stratum in the order of sha256(seed + id), and all critical ones."""
    order = sha256(F.concat(F.lit(seed), F.col(ident).cast("string")))
    w = Window.partitionBy(*group, stratum).orderBy(order, ident)
    drawn = targets.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
    if critical is None:
        return drawn
    return drawn.unionByName(targets.filter(critical)).dropDuplicates([ident, stratum])


def final_opinions(reviews: DataFrame) -> DataFrame:
    """State of each target: the last adjudication if it is the last row; else the confirmed latest opinions since it.

    Columns: target_id, seq, reviewer, kind (proposed, confirmed, adjudicated), label.
    """
    last = reviews.groupBy("target_id").agg(F.max(F.when(F.col("kind") == "adjudicated", F.col("seq"))).alias("adj"), F.max("seq").alias("end"))
    r = reviews.join(last, "target_id")
    settled = r.filter(F.col("adj") == F.col("end")).filter(F.col("seq") == F.col("end")).select("target_id", F.lit("adjudicated").alias("state"), "label", F.lit(1).alias("n_opinions"))
    since = r.filter(F.col("adj").isNull() | (F.col("adj") < F.col("end"))).filter(F.col("adj").isNull() | (F.col("seq") > F.col("adj")))
    last = since.groupBy("target_id", "reviewer").agg(F.max_by(F.struct("kind", "label"), "seq").alias("x")).filter("x.kind = 'confirmed'")
    per = last.groupBy("target_id").agg(F.count_distinct("x.label").alias("n"), F.min("x.label").alias("label"), F.count(F.lit(1)).alias("n_opinions"))
    open_ = since.select("target_id").distinct().join(per, "target_id", "left")
    state = F.when(F.col("n").isNull(), "pending").when(F.col("n") > 1, "conflict").otherwise("confirmed")
    return settled.unionByName(open_.select("target_id", state.alias("state"), F.when(state == "confirmed", F.col("label")).alias("label"), F.coalesce("n_opinions", F.lit(0)).cast("int").alias("n_opinions")))


def lineage_class(pairs: DataFrame, *within: str) -> DataFrame:
    """inherited / corrected / unknown / new of each downstream claim from its ordered upstream candidates.

    Columns: claim_id, position, text, upstream_text (null without a candidate),
    is_reference, has_upstream.  Candidates are folded in order, starting at
    unknown: unknown takes the next, an equal one keeps it, another resets it.  ``within``
    names columns that a claim has one value of and that ``pairs`` is already dealt by.
    """
    kind = F.when(F.col("upstream_text") == F.col("text"), "inherited").when(F.col("is_reference"), "corrected").otherwise("unknown")
    c = pairs.withColumn("kind", kind)
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("upstream_text").isNotNull(), F.struct("position", "kind")))), lambda x: x["kind"])
    per = c.groupBy(*within, "claim_id").agg(listed.alias("kinds"), F.bool_or("has_upstream").alias("has_upstream"))
    fold = F.aggregate("kinds", F.lit("unknown"), lambda a, k: F.when((a == "unknown") | (a == k), k).otherwise("unknown"))
    return per.select("claim_id", F.when(F.size("kinds") > 0, fold).when(F.col("has_upstream"), "new").otherwise("unknown").alias("lineage"))


def inventory(facts: DataFrame, grounding: DataFrame, metrics: DataFrame, extractions: DataFrame) -> DataFrame:
    """What may be reviewed: target_id, kind, review group, automatic label, critical, text and its strata.

    facts(claim_id, verdict, critical, text); grounding(claim_id, basis,
    grounded, critical, text); metrics(sample_id, metric_name, text);
    extractions(unit_id, text).  Target ids are unique if the inputs' keys are.
    """
    row = lambda f, ident, kind, group, label, critical: f.select(F.concat_ws(".", ident, group).alias("target_id"), F.lit(kind).alias("kind"), group.alias("review_group"), label.cast("string").alias("label"), F.coalesce(critical, F.lit(False)).alias("critical"), "text")
    none = F.lit(None)
    out = row(facts, F.col("claim_id"), "claim", F.lit("custom_factual"), F.col("verdict"), F.col("critical"))
    out = out.unionByName(row(grounding, F.col("claim_id"), "claim", F.col("basis"), F.col("grounded"), F.col("critical")))
    out = out.unionByName(row(metrics, F.col("sample_id"), "metric", F.col("metric_name"), none, F.lit(False)))
    out = out.unionByName(row(extractions, F.col("unit_id"), "extraction", F.lit("extraction"), none, F.lit(False)).withColumn("review_group", F.lit("custom_extraction")))
    return out.withColumn("strata", strata(F.coalesce("text", F.lit(""))))


def stratum_coverage(targets: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Per review group and stratum: targets, and those that were reviewed."""
    done = reviewed.select("target_id").distinct().withColumn("__d", F.lit(True))
    each = targets.join(done, "target_id", "left").select("review_group", F.explode("strata").alias("stratum"), "__d")
    return each.groupBy("review_group", "stratum").agg(F.count(F.lit(1)).alias("n_targets"), F.count("__d").alias("n_reviewed"))


def append_problems(ledger: DataFrame) -> DataFrame:
    """(target_id, seq, problem): ledger rows that could not have been appended in their order.

    Columns: target_id, seq, review_id, previous_id, reviewer, status
    (proposed, confirmed, adjudicated), label, provenance, reviewed_at,
    resolves (review ids).

    No row carries its past.  Before an adjudication as many opinions are
    current as reviewers have voted; those that it resolves are joined by their
    id, and one is current if its reviewer's next vote is not earlier.
    """
    w = Window.partitionBy("target_id").orderBy("seq")
    vote = F.coalesce(F.col("status") != "proposed", F.lit(False))
    own = Window.partitionBy("target_id", "reviewer", "__vote").orderBy("seq")
    r = ledger.withColumns({"__last": F.lag("review_id").over(w), "__time": F.lag("reviewed_at").over(w), "__origin": F.first("provenance").over(w), "__vote": vote})
    r = r.withColumns({"__next": F.lead("seq").over(own), "__voter": F.col("__vote") & (F.row_number().over(own) == 1)})
    r = r.withColumn("__voters", F.coalesce(F.sum(F.col("__voter").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    adjudicated = F.col("status") == "adjudicated"
    asked = r.filter(adjudicated).select(F.col("target_id").alias("__t"), F.col("seq").alias("__s"), F.col("reviewer").alias("__by"), F.explode(F.array_distinct("resolves")).alias("__id"))
    held = r.select("target_id", "review_id", "seq", "reviewer", "label", "status", "__vote", "__next")
    found = asked.join(held, (F.col("__t") == F.col("target_id")) & (F.col("__id") == F.col("review_id")) & (F.col("seq") < F.col("__s")))
    several = lambda c: ~F.min(F.struct(c)).eqNullSafe(F.max(F.struct(c)))
    settled = found.groupBy("__t", "__s").agg(
        F.count(F.lit(1)).alias("__n"), several("reviewer").alias("__reviewers"), several("label").alias("__labels"), F.count_if(F.col("__vote") & (F.col("__next").isNull() | (F.col("__next") >= F.col("__s")))).alias("__current"),
        F.bool_or(F.col("reviewer") == F.col("__by")).alias("__self"), F.bool_or(F.col("status") == "proposed").alias("__proposal"),
    )
    r = r.join(settled, (F.col("target_id") == F.col("__t")) & (F.col("seq") == F.col("__s")), "left").fillna({"__n": 0, "__current": 0, "__reviewers": False, "__labels": False, "__self": False, "__proposal": False})
    problem = (
        F.when(F.col("provenance") != F.col("__origin"), "mixed provenance")
        .when(~F.col("previous_id").eqNullSafe(F.col("__last")), "not linked to the latest revision")
        .when(F.col("reviewed_at") < F.col("__time"), "time moves backwards")
        .when(adjudicated & (F.col("__current") < F.col("__voters")), "current opinion not resolved")
        .when(adjudicated & ((F.col("__n") != F.size(F.array_distinct("resolves"))) | ~F.col("__reviewers")), "too few independent reviewers")
        .when(adjudicated & ~F.col("__labels"), "no disagreement")
        .when(adjudicated & F.col("__self"), "adjudicator is a reviewer")
        .when(adjudicated & F.col("__proposal"), "resolves a proposal")
        .when(~adjudicated & (F.size("resolves") > 0), "only adjudications resolve")
    )
    return r.select("target_id", "seq", problem.alias("problem")).filter("problem is not null")


# Kinds that a reviewer may give to the facts of a text.
KINDS = ("fact", "opinion", "mixed", "score", "decision")


def target_problems(ledger: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, seq, problem): reviews that do not fit what they review, or whose id is taken.

    ledger: target_id, seq (place in the ledger), review_id, evaluation_id,
    target_kind, source_sha256, automatic and human (JSON texts).  targets, one
    row each: target_id, evaluation_id, target_kind, source_sha256, automatic,
    label_space (JSON texts; null or empty: none).  A label must be one of the
    label space, with its type; an extraction lists its facts and kinds; a
    metric says whether it is an error, with a score of 0 to 1 or none.
    """
    t = targets.select("target_id", F.struct("evaluation_id", "target_kind", "source_sha256", "automatic", "label_space").alias("__t"))
    taken = ledger.groupBy("review_id").agg(F.count(F.lit(1)).alias("__n"), F.min("seq").alias("__first")).filter("__n > 1")
    r = ledger.join(t, "target_id", "left").join(taken.select(F.col("review_id").alias("__id"), "__first"), F.col("review_id").eqNullSafe(F.col("__id")), "left")
    h = F.try_parse_json(F.col("human"))
    part = lambda path: F.try_variant_get(h, path, "variant")
    kind = lambda path: F.coalesce(F.schema_of_variant(part(path)), F.lit("VOID"))
    words = lambda path: F.try_variant_get(h, path, "array<string>")
    listed = lambda path: kind(path).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(F.coalesce(words(path), F.array().cast("array<string>")), lambda x: x.isNotNull())
    fine = lambda c: F.coalesce(c, F.lit(False))
    shape = fine(listed("$.facts") & listed("$.kinds"))
    content = fine(F.forall(words("$.facts"), lambda x: x.rlike(r"(?U)\S"))) & fine(F.forall(words("$.kinds"), lambda x: x.isin(*KINDS)))
    score = F.try_variant_get(h, "$.score", "double")
    scored = kind("$.score").rlike("^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & ((kind("$.score") == "VOID") | fine(score.between(0, 1)))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"__t.{c}"))
    labels = F.coalesce("__t.label_space", F.array().cast("array<string>"))
    free, extraction = F.size(labels) == 0, F.col("target_kind") == "extraction"
    problem = (
        F.when(F.col("__t").isNull() | ~same("evaluation_id") | ~same("target_kind"), "unknown target")
        .when(~same("source_sha256") | ~same("automatic"), "another automatic result or source")
        .when(~free & ~fine(F.array_contains(labels, F.col("human"))), "label outside the label space")
        .when(free & extraction & ~shape, "no lists of facts and kinds")
        .when(free & extraction & ~content, "invalid facts or kinds")
        .when(free & ~extraction & (kind("$.error") != "BOOLEAN"), "no error flag")
        .when(free & ~extraction & ~scored, "score outside 0 to 1")
        .when(F.col("seq") > F.col("__first"), "review id taken")
    )
    return r.select("target_id", "seq", problem.alias("problem")).filter("problem is not null")


def decision_problems(ledger: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, seq, problem): the first reason against each row of a ledger: its target, then the order of its reviews.

    Columns as of :func:`target_problems` and :func:`append_problems`; the label is the human result.
    """
    fit = target_problems(ledger, targets).withColumnRenamed("problem", "__fit")
    order = append_problems(ledger.withColumn("label", F.col("human"))).withColumnRenamed("problem", "__order")
    return fit.join(order, ["target_id", "seq"], "full_outer").select("target_id", "seq", F.coalesce("__fit", "__order").alias("problem"))


def reliability(targets: DataFrame, opinions: DataFrame) -> DataFrame:
    """Per review group: targets, settled human labels, conflicts, agreement with the automatic label; human and synthetic apart.

    opinions(target_id, state, label, provenance), one row a target.
    """
    j = targets.join(opinions.select("target_id", "state", F.col("label").cast("string").alias("__h"), "provenance"), "target_id", "left")
    settled = F.col("state").isin("confirmed", "adjudicated") & F.col("__h").isNotNull() & F.col("label").isNotNull()
    human = settled & (F.col("provenance") == "human")
    same = human & (F.col("__h") == F.col("label"))
    return j.groupBy("review_group").agg(
        F.count(F.lit(1)).alias("n_targets"), F.count_if(human).alias("n_human"), F.count_if(settled & (F.col("provenance") != "human")).alias("n_synthetic"),
        F.count_if(F.coalesce(F.col("state") == "conflict", F.lit(False))).alias("n_conflicts"), ratio(F.count_if(same), F.count_if(human)).alias("agreement"),
    )
