"""Inputs of metrics and results of searches over the orders and their lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.plans import inputs
from ledgerlark.queries import query
from ledgerlark.session import table

METRICS = ("factual_precision", "faithfulness", "context_recall")


def _tables(spark, sf, contexts=True):
    """Orders as samples, with or without their contexts; each order is also a search whose candidates are its lines, and uses its own and its customer's first."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    key = F.col("l_orderkey").cast("string")
    ident = F.concat_ws("-", key, "l_linenumber", "l_partkey", "l_suppkey")
    lines = li.select(key.alias("retrieval_id"), (-F.col("l_linenumber")).alias("rank"), ident.alias("context_id"), F.col("l_returnflag").alias("text"), F.col("l_suppkey").alias("evidence_id"), "l_orderkey", "l_linenumber")
    # A window, not a join: it costs nothing where the searches of a sample are not read.
    s = o.select("o_orderkey", "o_orderpriority", "o_orderstatus", F.min("o_orderkey").over(Window.partitionBy("o_custkey")).alias("first"))
    given = lines.filter("l_linenumber % 2 = 1 and l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("context_id")).alias("context_ids"))
    k = F.col("o_orderkey")
    s = s.join(given, "o_orderkey", "left") if contexts else s.withColumn("context_ids", F.lit(None).cast("array<string>"))
    other = F.when(F.col("first") != k, F.array(k.cast("string"), F.col("first").cast("string"))).otherwise(F.array(k.cast("string")))
    samples = s.select(
        k.cast("string").alias("sample_id"), F.concat(F.lit("i"), k.cast("string")).alias("invocation_id"), F.when(k % 5 == 1, "error").otherwise("pending").alias("evaluation_status"),
        F.array(*map(F.lit, METRICS)).alias("supported"), F.col("o_orderpriority").alias("user_input"), F.col("o_orderstatus").alias("response"), F.lit("ref").alias("reference"), F.array(F.lit("f")).alias("reference_ids"),
        F.array().cast("array<string>").alias("evidence_ids"), "context_ids", F.when(k % 4 != 0, other).alias("retrieval_ids"),
    )
    retrievals = o.select(k.cast("string").alias("retrieval_id"), F.col("o_orderpriority").alias("query"))
    return samples, lines.select("context_id", "text"), retrievals, lines


_S = """o AS (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders),
li AS (SELECT l_orderkey, l_linenumber, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag, l_suppkey FROM lineitem),
found AS (SELECT l_orderkey, string_agg(id, '|' ORDER BY -l_linenumber, id) AS ids, string_agg(l_returnflag, '|' ORDER BY -l_linenumber, id) AS texts FROM li GROUP BY 1),
given AS (SELECT l_orderkey, string_agg(id, '|' ORDER BY id) AS ids, string_agg(l_returnflag, '|' ORDER BY id) AS texts FROM li WHERE l_linenumber % 2 = 1 AND l_orderkey % 3 <> 0 GROUP BY 1),
used AS (SELECT o_orderkey, 0 AS pos, o_orderkey AS r FROM o WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 1, first FROM o WHERE o_orderkey % 4 <> 0 AND first <> o_orderkey)"""


@query(f"""WITH {_S}
SELECT o_orderkey::VARCHAR AS sample, 'factual_precision' AS metric_name, 'none' AS context_kind, o_orderpriority AS user_input, 'ref' AS reference, 'i' || o_orderkey AS origin_id, '' AS context_ids, '' AS contexts FROM o WHERE o_orderkey % 5 <> 1
UNION ALL SELECT o_orderkey::VARCHAR, 'faithfulness', CASE WHEN g.ids IS NULL THEN 'received_input' ELSE 'delivered' END, o_orderpriority, NULL, 'i' || o_orderkey, coalesce(g.ids, 'received_i' || o_orderkey), coalesce(g.texts, o_orderpriority) FROM o LEFT JOIN given g ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 1
UNION ALL SELECT NULL, 'context_recall', 'retrieved', q.o_orderpriority, 'ref', r::VARCHAR, coalesce(ids, ''), coalesce(texts, '') FROM used JOIN o q ON q.o_orderkey = r LEFT JOIN found ON l_orderkey = r WHERE used.o_orderkey % 5 <> 1""")
def inputs_by_search(spark, sf):
    """What each metric is scored on; rows of searches have an id of their own, which is left out here."""
    got = inputs.metric_inputs(*_tables(spark, sf))
    sample = F.when(F.col("context_kind") != "retrieved", F.col("sample_id"))
    return got.select(sample.alias("sample"), "metric_name", "context_kind", "user_input", "reference", "origin_id", F.array_join("context_ids", "|").alias("context_ids"), F.array_join("contexts", "|").alias("contexts"))


@query(f"""WITH {_S}, n AS (SELECT used.o_orderkey, string_agg(concat(r, '=', ids, CASE WHEN used.o_orderkey % 6 = 2 THEN '' ELSE ':completed' END), ';' ORDER BY pos) AS searches FROM used LEFT JOIN found ON l_orderkey = r GROUP BY 1)
SELECT o.o_orderkey::VARCHAR AS sample_id, CASE WHEN o.o_orderkey % 3 = 1 THEN 0.25 END AS faithfulness, CASE WHEN o.o_orderkey % 3 = 1 THEN 0.75 END AS non_support, coalesce(searches, '') AS searches FROM o LEFT JOIN n USING (o_orderkey)""")
def search_diagnostics(spark, sf):
    """Each sample's results with its searches nested in order."""
    samples, _, retrievals, candidates = _tables(spark, sf, contexts=False)
    k = F.col("sample_id").cast("long")
    faith = samples.filter(k % 3 == 1).select("sample_id", F.lit("faithfulness").alias("metric_name"))
    recall = inputs.asked(samples).filter(k % 6 != 2).select(inputs.search_sample(F.col("sample_id"), F.col("retrieval_id")).alias("sample_id"), F.lit("context_recall").alias("metric_name"))
    results = faith.unionByName(recall).withColumns({"status": F.lit("completed"), "value": F.lit(0.25)})
    got = inputs.diagnostics(samples, retrievals, candidates, results)
    one = lambda x: F.concat(x["retrieval_id"], F.lit("="), F.array_join(F.transform(F.coalesce(x["candidates"], F.array().cast("array<struct<rank: int, context_id: string, text: string, evidence_id: string>>")), lambda c: c["context_id"]), "|"), F.coalesce(F.concat(F.lit(":"), x["context_recall"]["status"]), F.lit("")))
    return got.select("sample_id", "faithfulness", "non_support", F.array_join(F.transform("searches", one), ";").alias("searches"))
