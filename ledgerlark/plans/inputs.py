"""What each metric of a sample is scored on, and what its searches brought, in order.

Lists are made once a sample or search, of the texts that it had: a search's
candidates once for all samples that used it.  Orders are those of the records (the
position in the sample's list, the rank in the search).

samples(sample_id, invocation_id, evaluation_status, supported, user_input, response,
reference, reference_ids, evidence_ids, context_ids, retrieval_ids), contexts(context_id,
text), retrievals(retrieval_id, query), candidates(retrieval_id, rank, context_id, text,
evidence_id).  A null list is empty; a listed context or search that is not there
leaves no entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.hashing import stable_id
from ledgerlark.functions.numeric import non_support

PLAIN = ("factual_precision", "factual_recall")
BY_SEARCH = ("context_recall", "context_precision")
OUT = ["sample_id", "metric_name", "user_input", "response", "reference", "reference_ids", "evidence_ids", "origin_id", "context_kind", "context_ids", "contexts"]


def _texts(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def gathered(rows: DataFrame, key: str, item: Column, name: str) -> DataFrame:
    """(key, name): the sorted items of each key.  Rows are moved first: lists begun before that would hold one row each."""
    return rows.repartition(key).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))


def listed(candidates: DataFrame) -> DataFrame:
    """(retrieval_id, candidates): each search's candidates by rank, ties by context."""
    rows = candidates.select(F.col("retrieval_id").cast("string").alias("retrieval_id"), "rank", F.col("context_id").cast("string").alias("context_id"), F.col("text").alias("text"), F.col("evidence_id").cast("string").alias("evidence_id"))
    return gathered(rows, "retrieval_id", F.struct("rank", "context_id", "text", "evidence_id"), "candidates")


def search_sample(sample: Column, retrieval: Column) -> Column:
    return stable_id("retrieval_sample", sample, retrieval)


def asked(samples: DataFrame, *others: str | Column) -> DataFrame:
    """(sample_id, others, pos, retrieval_id): a row for each search that a sample lists."""
    return samples.select("sample_id", *others, F.posexplode(_texts("retrieval_ids")).alias("pos", "retrieval_id"))


def brought(asks: DataFrame, retrievals: DataFrame, candidates: DataFrame) -> DataFrame:
    """``asks`` with query and candidates of their searches; those of unknown searches leave."""
    known = retrievals.select(F.col("retrieval_id").cast("string").alias("retrieval_id"), "query").join(listed(candidates), "retrieval_id", "left")
    return asks.join(known, "retrieval_id")


def searches(samples: DataFrame, retrievals: DataFrame, candidates: DataFrame) -> DataFrame:
    """(sample_id, pos, retrieval_id, retrieval_sample_id, query, candidates): a row for each search of each sample."""
    found = brought(asked(samples), retrievals, candidates)
    return found.withColumn("retrieval_sample_id", search_sample(F.col("sample_id"), F.col("retrieval_id")))


def metric_inputs(samples: DataFrame, contexts: DataFrame, retrievals: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row for each supported metric of a pending sample, and for each search of those that judge searches.

    Faithfulness is held against the delivered contexts, or, without any, what the
    call received; it has no reference.  Contexts of searches are never put together.
    """
    s = samples.filter("evaluation_status = 'pending'")
    none = F.array().cast("array<string>")
    name = F.col("metric_name")

    # Given texts meet their sample before its metrics part, and only those of samples that are judged by them.
    faithful = F.array_contains("supported", "faithfulness")
    own = s.select("sample_id", "invocation_id", "supported", "user_input", "response", "reference", *[_texts(c).alias(c) for c in ("reference_ids", "evidence_ids", "context_ids")])
    given = own.filter(faithful).select(F.col("sample_id").alias("s"), F.posexplode("context_ids").alias("pos", "id")).join(contexts.select(F.col("context_id").cast("string").alias("id"), F.col("text").alias("text")), "id")
    got = F.coalesce("given", F.array().cast("array<struct<pos: int, id: string, text: string>>"))
    has = F.size("context_ids") > 0
    metric = own.join(gathered(given, "s", F.struct("pos", "id", "text"), "given"), F.col("sample_id") == F.col("s"), "left")
    metric = metric.withColumn("metric_name", F.explode("supported")).filter(name.isin(*PLAIN, "faithfulness"))
    faith = name == "faithfulness"
    metric = metric.withColumn("context_kind", F.when(~faith, "none").when(has, "delivered").otherwise("received_input"))
    metric = metric.withColumn("contexts", F.when(~faith, none).when(has, F.transform(got, lambda x: x["text"])).otherwise(F.array("user_input")))
    metric = metric.withColumn("context_ids", F.when(~faith, none).when(has, F.transform(got, lambda x: x["id"])).otherwise(F.array(F.concat(F.lit("received_"), "invocation_id"))))
    metric = metric.withColumns({"reference": F.when(~faith, F.col("reference")), "reference_ids": F.when(faith, none).otherwise(F.col("reference_ids")), "origin_id": F.col("invocation_id")}).select(OUT)

    # What a judge of searches reads of the sample goes with each search, so that no list of candidates is moved to it.
    judges = F.filter("supported", lambda m: m.isin(*BY_SEARCH))
    asks = asked(s.withColumn("judges", judges).filter(F.size("judges") > 0), "judges", "response", "reference", _texts("reference_ids").alias("reference_ids"))
    listed_of = lambda field: F.coalesce(F.transform("candidates", lambda x: x[field]), none)
    found = brought(asks, retrievals, candidates).withColumn("metric_name", F.explode("judges")).select(
        search_sample(F.col("sample_id"), F.col("retrieval_id")).alias("sample_id"), "metric_name", F.col("query").alias("user_input"), "response", "reference", "reference_ids", listed_of("evidence_id").alias("evidence_ids"),
        F.col("retrieval_id").alias("origin_id"), F.lit("retrieved").alias("context_kind"), listed_of("context_id").alias("context_ids"), listed_of("text").alias("contexts"),
    )
    return metric.unionByName(found)


def diagnostics(samples: DataFrame, retrievals: DataFrame, candidates: DataFrame, results: DataFrame) -> DataFrame:
    """(sample_id, faithfulness, faithfulness_status, non_support, searches): results of a sample, its searches nested in their order.

    results(sample_id, metric_name, status, value); a search's are under its retrieval sample.
    """
    def of(*metrics: str) -> DataFrame:
        best = [F.max(F.when(F.col("metric_name") == m, F.struct("status", "value"))).alias(m) for m in metrics]
        return results.filter(F.col("metric_name").isin(*metrics)).groupBy(F.col("sample_id").cast("string").alias("of")).agg(*best)

    # Results meet the searches before these have their candidates, whose lists are moved but once.
    asks = asked(samples).withColumn("retrieval_sample_id", search_sample(F.col("sample_id"), F.col("retrieval_id")))
    asks = asks.join(of(*BY_SEARCH), F.col("retrieval_sample_id") == F.col("of"), "left").drop("of").withColumnRenamed("sample_id", "s")
    nested = gathered(brought(asks, retrievals, candidates), "s", F.struct("pos", "retrieval_sample_id", "retrieval_id", "query", "candidates", *BY_SEARCH), "searches")
    out = samples.select("sample_id").join(of("faithfulness"), F.col("sample_id").cast("string") == F.col("of"), "left").join(nested, F.col("sample_id") == F.col("s"), "left")
    value, status = F.col("faithfulness.value"), F.col("faithfulness.status")
    empty = F.from_json(F.lit("[]"), nested.schema["searches"].dataType)
    return out.select("sample_id", value.alias("faithfulness"), status.alias("faithfulness_status"), non_support(value, status).alias("non_support"), F.coalesce("searches", empty).alias("searches"))
