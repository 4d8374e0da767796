"""Records, searches, contexts, tolerant values and decisions over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import numeric
from ledgerlark.operators import joins, ordered
from ledgerlark.plans import research, scoring, workflow
from ledgerlark.queries import ORACLES, QUERIES, query
from ledgerlark.session import table
from ledgerlark.sources import files


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RECORDS = "r AS (SELECT l_linenumber = 1 AS chosen, l_suppkey % 40 AS supp, CASE WHEN l_quantity < 45 THEN l_quantity END AS quantity, l_returnflag AS flag FROM lineitem)"


def _records(spark, sf):
    r = table(spark, sf, "lineitem").select((F.col("l_linenumber") == 1).alias("chosen"), (F.col("l_suppkey") % 40).alias("supp"), F.when(F.col("l_quantity") < 45, F.col("l_quantity")).alias("quantity"), F.col("l_returnflag").alias("flag"))
    return r.filter("not chosen").drop("chosen"), r.filter("chosen").drop("chosen")


@query(f"""WITH {_RECORDS} SELECT supp, quantity, flag FROM r a WHERE NOT chosen AND NOT EXISTS (SELECT 1 FROM r b WHERE b.chosen AND b.supp = a.supp AND b.flag = a.flag AND b.quantity IS NOT DISTINCT FROM a.quantity)""")
def records_not_selected(spark, sf):
    return joins.record_difference(*_records(spark, sf))


@query(f"""WITH {_RECORDS} SELECT supp, quantity, flag FROM r WHERE NOT chosen EXCEPT ALL SELECT supp, quantity, flag FROM r WHERE chosen""")
def records_left_over(spark, sf):
    return joins.record_difference(*_records(spark, sf), every=False)


_M = ", ".join(f"({i}, {_quote('Framework' if 'framework' in t else 'Industry')}, {_quote(t)})" for i, t in enumerate(research.MARKET_QUERIES))


@query(f"""WITH q AS (SELECT p_name AS domain, pos, category, replace(t, '{{}}', p_name) AS query FROM part CROSS JOIN (VALUES {_M}) v(pos, category, t))
SELECT domain, pos, category, query, left(translate(concat(category, '__', query), '/ ', '__'), 180) AS cache_key FROM q""")
def market_searches(spark, sf):
    """The searches of each market and the key under which their results are kept."""
    q = research.market_queries(table(spark, sf, "part").select(F.col("p_name").alias("domain")), "domain")
    return q.withColumn("cache_key", files.cache_key(F.col("category"), F.col("query")))


@query("""WITH e AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS content, o_orderkey FROM orders)
SELECT o_custkey, string_agg('[Source: order ' || o_orderkey || ', page ' || page || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY page) AS context FROM e WHERE content <> '' GROUP BY 1""")
def formatted_contexts(spark, sf):
    k = F.col("o_orderkey")
    o = ordered.ranked(table(spark, sf, "orders"), ["o_custkey"], [k], "n")
    title = F.concat(F.lit("order "), k.cast("string"))
    e = o.select("o_custkey", (F.col("n") - 1).alias("pos"), F.when(k % 7 == 0, "").when(k % 11 != 0, F.col("o_orderpriority")).alias("content"), title.alias("title"), F.lit("u").alias("url"), F.lit("c").alias("category"))
    return research.formatted_documents(research.evidence_documents(e, ["o_custkey"]), ["o_custkey"])


@query("""SELECT l_orderkey, l_linenumber, l_quantity, a, b, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL ELSE abs(a - b) <= 1e-9 END AS same_number, false AS same_kind, CASE WHEN l_linestatus = 'F' THEN 1 - l_discount END AS non_support FROM
    (SELECT *, CASE WHEN l_linenumber <> 2 THEN l_tax END AS a, CASE WHEN l_linenumber <> 2 THEN l_tax + CASE WHEN l_suppkey % 3 = 0 THEN 1e-12 WHEN l_suppkey % 3 = 1 THEN 1e-3 ELSE 0 END END AS b FROM lineitem)""")
def tolerant_values(spark, sf):
    other, c = F.col("l_linenumber") != 2, F.col("l_suppkey") % 3
    li = table(spark, sf, "lineitem").withColumns({"a": F.when(other, F.col("l_tax")), "b": F.when(other, F.col("l_tax") + F.when(c == 0, 1e-12).when(c == 1, 1e-3).otherwise(0.0))})
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity", "a", "b",
        numeric.tolerant_equal(F.col("a"), F.col("b"), "double", "double").alias("same_number"),
        numeric.tolerant_equal(F.col("l_linenumber") > 0, F.col("l_linenumber"), "boolean", "bigint").alias("same_kind"),
        numeric.non_support(F.col("l_discount"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("failed")).alias("non_support"),
    )


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error' AND value > 20) WHERE n = 1""")
def last_matching_call(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    late = [F.struct(-F.unix_micros(F.col("ts").cast("timestamp"))), -F.col("event_id")]
    return ordered.last_matching(e, ["user_id"], (F.col("event_type") == "error") & (F.col("value") > 20), late).select("user_id", "event_id", "ts")


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts, min(event_id) AS id FROM events WHERE event_type = 'purchase' AND value > 10 GROUP BY ALL)
SELECT a.event_id AS invocation_id, p.id AS reevaluation_id FROM a ASOF LEFT JOIN p ON a.user_id = p.user_id AND a.ts <= p.ts""")
def reevaluations(spark, sf):
    """The first success of a company after each research."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("invocation_id"), F.col("user_id").alias("company_id"), F.lit("judge").alias("operation"), F.col("ts").alias("started_at"), F.col("ts").alias("ended_at"), F.when(F.col("value") > 10, "succeeded").otherwise("failed").alias("status"), "event_type")
    return workflow.rechecks(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"))


@query(f"""WITH ev AS ({ORACLES["evaluation_table"]}),
w AS (SELECT s_suppkey, max(summary) FILTER (WHERE dimension = 'technology') AS t, max(summary) FILTER (WHERE dimension = 'market') AS m, max(summary) FILTER (WHERE dimension = 'team') AS e, max(summary) FILTER (WHERE dimension = 'risk') AS r FROM ev GROUP BY 1),
s AS (SELECT *, s_suppkey % 60 + 40 AS score, CASE s_suppkey % 4 WHEN 0 THEN 'It provides compilers.' WHEN 1 THEN '' WHEN 2 THEN '회사는 성장하고 있다.' END AS overview FROM w)
SELECT s_suppkey, [t, m, e] AS strengths, CASE s_suppkey % 3 WHEN 0 THEN [r] WHEN 1 THEN [r, 'a'] ELSE [r, 'a', 'b'] END AS weaknesses,
    CASE WHEN s_suppkey % 4 = 0 THEN format({_quote(research.DECISION_NOTE.replace("%s", "{}").replace("%d", "{}"))}, s_suppkey, 'Series A', score, 'B') WHEN s_suppkey % 4 = 2 THEN overview ELSE format({_quote(research.DECISION.replace("%s", "{}").replace("%d", "{}"))}, s_suppkey, 'Series A', score, 'B') END AS summary FROM s""")
def company_decisions(spark, sf):
    """What speaks for and against each company, and its summary."""
    k = F.col("s_suppkey")
    words = [F.lit(x) for x in "abc"]
    scored = table(spark, sf, "supplier").select(
        k, F.lit("Series A").alias("stage"), (k % 60 + 40).alias("final_score"), F.lit("B").alias("grade"),
        F.when(k % 4 == 0, "It provides compilers.").when(k % 4 == 1, "").when(k % 4 == 2, "회사는 성장하고 있다.").alias("overview"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(words[0])).otherwise(F.array(*words)).alias("risks"),
    )
    return research.decisions(QUERIES["evaluation_table"](spark, sf), scored, "s_suppkey")


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 6 = 0 THEN 'Series Z' END AS stage FROM supplier WHERE s_nationkey % 6 = 0 OR s_nationkey % 6 = 5")
def unknown_stages(spark, sf):
    """Companies that no score may be published for: their stage has no weights."""
    n = F.col("s_nationkey") % 6
    known = F.element_at(F.array(*map(F.lit, scoring.STAGE_WEIGHTS)), 1)
    return scoring.unknown_stages(table(spark, sf, "supplier").select("s_suppkey", F.when(n == 0, "Series Z").when(n != 5, known).alias("stage"))).select("s_suppkey", "stage")
