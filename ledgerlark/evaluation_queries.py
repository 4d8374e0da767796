"""The evaluation operators applied to the whole test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import dates, hashing, nested, numeric
from ledgerlark.operators import aggregates, joins, ordered
from ledgerlark.plans import claims, dataset, grounding, paired, quality, records, research, retrieval, review, workflow
from ledgerlark.queries import query
from ledgerlark.session import dealt, kept, table, tasks_of

_LINE = "l_orderkey * 10 + l_linenumber"


_ONCE = f"once AS (SELECT l_orderkey, l_linenumber, {_LINE} AS id, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_shipdate) AS l_shipdate, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"


def _once(spark, sf):
    """One row an order and line number, which the tables repeat."""
    return _lines(spark, sf).groupBy("l_orderkey", "l_linenumber", "id").agg(*[F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_shipdate", "l_returnflag")])


def _lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("id", F.expr(_LINE))


# --- claims ---------------------------------------------------------------------

_ASSESS = f"""WITH c AS (SELECT o_orderkey AS claim_id, o_custkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'pending' END AS st FROM orders),
f AS (SELECT l_orderkey AS claim_id, {_LINE} AS fact_id, l_returnflag <> 'N' AND l_quantity < 40 AND l_shipdate::DATE <= DATE '1996-01-01' AS ok, l_linenumber = 1 AND l_orderkey % 17 = 0 AS skipped,
    CASE WHEN l_discount > 0.09 THEN 'error' WHEN l_returnflag = 'A' THEN 'supports' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'contradicts' ELSE 'insufficient' END AS r FROM lineitem),
g AS (SELECT claim_id, list_sort(coalesce(list(fact_id) FILTER (WHERE ok), [])) AS considered, list_sort(coalesce(list(fact_id) FILTER (WHERE NOT ok), [])) AS excluded, list_sort(coalesce(list(fact_id) FILTER (WHERE ok AND NOT skipped), [])) AS compared,
    coalesce(bool_or(r = 'error') FILTER (WHERE ok AND NOT skipped), false) AS e, coalesce(bool_or(r = 'supports') FILTER (WHERE ok AND NOT skipped), false) AS s, coalesce(bool_or(r = 'contradicts') FILTER (WHERE ok AND NOT skipped), false) AS x,
    list_sort(coalesce(list(fact_id) FILTER (WHERE ok AND NOT skipped AND r IN ('supports', 'contradicts')), [])) AS deciding FROM f GROUP BY claim_id),
h AS (SELECT c.claim_id, c.st, coalesce(considered, []) AS considered, coalesce(excluded, []) AS excluded, coalesce(compared, []) AS compared, coalesce(e, false) AS e, coalesce(s, false) AS s, coalesce(x, false) AS x, coalesce(deciding, []) AS deciding FROM c LEFT JOIN g USING (claim_id)),
v AS (SELECT *, CASE WHEN st = 'error' THEN 'missing' WHEN len(considered) = 0 THEN 'completed' WHEN compared <> considered THEN 'error' WHEN e THEN 'error' ELSE 'completed' END AS status FROM h),
w AS (SELECT *, CASE WHEN status = 'completed' THEN CASE WHEN len(considered) = 0 OR s = x THEN 'unverifiable' WHEN s THEN 'verified' ELSE 'contradicted' END END AS verdict FROM v)
"""


def _assessed(spark, sf):
    day = F.lit("1996-01-01").cast("date")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("pending").alias("sample_status"), day.alias("as_of_date"), (F.col("o_orderkey") % 3 == 0).alias("critical"))
    li = _lines(spark, sf)
    fact_date = F.when(F.col("l_quantity") < 40, day).otherwise(F.date_add(day, -1))
    facts = li.select(F.col("l_orderkey").alias("k"), F.col("id").alias("fact_id"), F.when(F.col("l_returnflag") == "N", "pending").otherwise("verified").alias("review_status"), fact_date.alias("fact_date"), F.to_date("l_shipdate").alias("source_date"))
    relation = F.when(F.col("l_discount") > 0.09, "error").when(F.col("l_returnflag") == "A", "supports").when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "contradicts").otherwise("insufficient")
    compared = li.filter("l_returnflag <> 'N' and l_quantity < 40 and cast(l_shipdate as date) <= date'1996-01-01' and not (l_linenumber = 1 and l_orderkey % 17 = 0)")
    return claims.assess(o, facts, compared.select(F.col("l_orderkey").alias("claim_id"), F.col("id").alias("fact_id"), relation.alias("relation")), ["k"])


@query(_ASSESS + "SELECT claim_id, status, verdict, considered, excluded, CASE WHEN verdict = 'unverifiable' THEN considered WHEN verdict IS NOT NULL THEN deciding END AS selected FROM w")
def claim_assessment(spark, sf):
    return _assessed(spark, sf).select("claim_id", "status", "verdict", "considered", "excluded", "selected")


@query(_ASSESS + """SELECT claim_id % 7 AS section, count(*) AS n_claims, count(verdict) AS n_judged, count(*) - count(verdict) AS n_pending, list_sort(coalesce(list(claim_id) FILTER (WHERE verdict = 'contradicted' AND claim_id % 3 = 0), [])) AS ids_critical_contradicted,
    list_sort(coalesce(list(claim_id) FILTER (WHERE verdict = 'unverifiable' AND claim_id % 3 = 0), [])) AS ids_critical_unverifiable, CASE WHEN bool_and(status <> 'missing') AND count(verdict) = count(*) THEN 'completed' ELSE 'partial' END AS status FROM w GROUP BY 1""")
def critical_claims(spark, sf):
    pending = F.count_if(F.col("verdict").isNull())
    out = _assessed(spark, sf).withColumn("section", F.col("claim_id") % 7).groupBy("section").agg(*aggregates.claim_counts(), claims.group_status(F.bool_and(F.col("status") != "missing"), pending, F.count(F.lit(1))).alias("status"))
    return out.select("section", "n_claims", "n_judged", "n_pending", "ids_critical_contradicted", "ids_critical_unverifiable", "status")


@query(f"""WITH f AS (SELECT l_partkey, l_returnflag AS c, l_linestatus AS u, l_quantity AS v, {_LINE} AS id, row_number() OVER () AS rid FROM lineitem WHERE l_linenumber <> 3),
p AS (SELECT a.l_partkey, a.c, a.u, count(*) AS n_pairs FROM f a JOIN f b ON a.l_partkey = b.l_partkey AND a.c = b.c AND a.u = b.u AND a.rid < b.rid AND a.v <> b.v GROUP BY ALL)
SELECT l_partkey, c AS category, u AS unit, count(DISTINCT v) AS n_values, list(id ORDER BY id) AS fact_ids, max(n_pairs) AS n_pairs FROM f JOIN p USING (l_partkey, c, u) GROUP BY ALL""")
def fact_conflicts(spark, sf):
    odd = F.col("l_orderkey") % 2 == 0
    facts = _lines(spark, sf).select("l_partkey", F.col("l_returnflag").alias("category"), F.lit("1996-01-01").cast("date").alias("as_of_date"), F.col("l_linestatus").alias("unit"), F.when(odd, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("y"), F.lit("x"))).alias("conditions"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("value"), F.col("id").alias("fact_id"))
    return claims.conflicts(facts, ["l_partkey"]).select("l_partkey", "category", "unit", "n_values", "fact_ids", "n_pairs")


@query(f"SELECT l_orderkey, coalesce(list({_LINE} ORDER BY {_LINE}) FILTER (WHERE l_returnflag = 'A'), []) AS claims, count(*) FILTER (WHERE l_returnflag <> 'A') AS n_excluded FROM lineitem GROUP BY 1")
def fact_only_claims(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "fact").when(F.col("l_returnflag") == "R", "opinion")
    return claims.only_facts(_lines(spark, sf).select("l_orderkey", F.col("id").alias("claim_id"), kind.alias("kind")), ["l_orderkey"])


@query("""WITH n AS (SELECT p_size, p_partkey AS native_id, p_name AS s FROM part WHERE p_partkey % 2 = 0), c AS (SELECT p_size, p_partkey AS claim_id, p_name AS s FROM part WHERE p_partkey % 3 <> 1)
SELECT p_size, native_id, claim_id, CASE WHEN claim_id IS NULL THEN 'native only' WHEN native_id IS NULL THEN 'custom only' ELSE 'both' END AS match FROM n FULL JOIN c USING (p_size, s)""")
def statement_match(spark, sf):
    p = table(spark, sf, "part")
    native = p.filter("p_partkey % 2 = 0").select("p_size", F.col("p_partkey").alias("native_id"), F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" 　")), F.lit("。")).alias("text"))
    custom = p.filter("p_partkey % 3 <> 1").select("p_size", F.col("p_partkey").alias("claim_id"), F.concat("p_name", F.lit("..")).alias("text"))
    return claims.same_statements(native, custom, ["p_size"], "text")


@query("""WITH c AS (SELECT user_id, (event_id // 50) AS call, min(ts) FILTER (WHERE event_type = 'view') AS started, min(ts) FILTER (WHERE event_type = 'click') AS ended FROM events GROUP BY ALL)
SELECT *, CASE WHEN started IS NULL THEN 'no start' WHEN ended IS NULL THEN 'no end' WHEN ended < started THEN 'out of order' ELSE 'paired' END AS status FROM c""")
def callback_pairs(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.floor(F.col("event_id") / 50).cast("long").alias("call"), "event_type", F.col("ts").alias("at"))
    return claims.paired_calls(e, ["user_id", "call"], "event_type", "view", "click")


@query("""WITH m AS (SELECT l_orderkey, l_linestatus AS mode, l_discount AS s, l_shipdate::DATE < DATE '1994-01-01' AS x FROM lineitem WHERE l_linenumber <= 2)
SELECT l_orderkey, CASE WHEN st = 'completed' THEN o END AS "O", CASE WHEN st = 'completed' THEN f END AS "F", st AS status FROM (SELECT l_orderkey, max(s) FILTER (WHERE mode = 'O') AS o, max(s) FILTER (WHERE mode = 'F') AS f,
    CASE WHEN count(*) FILTER (WHERE mode = 'O') > 1 OR count(*) FILTER (WHERE mode = 'F') > 1 THEN 'duplicate' WHEN count(DISTINCT mode) < 2 THEN 'missing' WHEN count(DISTINCT x) > 1 THEN 'error' ELSE 'completed' END AS st FROM m GROUP BY 1)""")
def two_mode_scores(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_linenumber <= 2").withColumn("early", F.to_date("l_shipdate") < F.lit("1994-01-01").cast("date"))
    return claims.two_modes(li, "l_orderkey", "l_linestatus", ("O", "F"), "l_discount", ["early"])


# --- grounding --------------------------------------------------------------------

_GROUND = f"""WITH c AS (SELECT l_orderkey AS s, {_LINE} AS claim_id, l_linenumber AS n, l_linestatus = 'O' AS seen, CASE WHEN l_discount > 0.09 THEN 'error' WHEN l_returnflag = 'A' THEN 'supported' WHEN l_returnflag = 'R' THEN 'contradicted' ELSE 'unsupported' END AS sup,
    l_tax > 0.07 AS vague, l_quantity > 45 AS blank, o_orderstatus = 'P' AS bad FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT s, claim_id, b.basis, CASE WHEN bad OR NOT (b.basis = 'delivered_context' OR seen) THEN 'missing' WHEN sup = 'error' THEN 'error' ELSE 'completed' END AS st, sup = 'supported' AS yes FROM c, (VALUES ('source_evidence'), ('delivered_context')) b(basis)),
t AS (SELECT s, claim_id, CASE WHEN bad OR vague THEN 'missing' WHEN blank THEN 'completed' WHEN sup = 'error' THEN 'error' ELSE 'completed' END AS st, CASE WHEN bad OR vague THEN NULL WHEN blank THEN 'inaccessible' WHEN sup = 'error' THEN NULL ELSE sup END AS v FROM c WHERE n % 2 = 0),
gs AS (SELECT s, basis, count(*) AS total, count(*) FILTER (WHERE st = 'completed') AS judged, count(*) FILTER (WHERE st = 'completed' AND yes) AS grounded FROM g GROUP BY ALL),
ts AS (SELECT s, count(*) AS n, count(*) FILTER (WHERE st = 'completed') AS j, count(*) FILTER (WHERE v = 'supported') AS su, count(*) FILTER (WHERE v = 'inaccessible') AS ina FROM t GROUP BY 1),
un AS (SELECT s, count(*) AS u FROM c WHERE n % 2 = 1 GROUP BY 1)
"""


def _cited(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("pending").alias("sample_status"))
    tasks = tasks_of(orders, grounding.SAMPLES_A_TASK)
    li = dealt(_lines(spark, sf), tasks, "l_orderkey").join(dealt(orders, tasks, "l_orderkey"), "l_orderkey")
    support = F.when(F.col("l_discount") > 0.09, "error").when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "R", "contradicted").otherwise("unsupported")
    return li.withColumns({"support": support, "claim_id": F.col("id"), "sample_id": F.col("l_orderkey")})


@query(_GROUND + """SELECT o_orderkey AS sample_id, b.basis, coalesce(total, 0) AS total, coalesce(judged, 0) AS judged, coalesce(grounded, 0) AS grounded, coalesce(n, 0) AS n_citations, coalesce(su, 0) AS n_supported, coalesce(ina, 0) AS n_inaccessible, coalesce(u, 0) AS n_uncited,
    CASE WHEN o_orderstatus <> 'P' AND total = judged THEN round(grounded / total, 9) END AS grounded_rate, CASE WHEN o_orderstatus <> 'P' AND coalesce(total, 0) = coalesce(judged, 0) THEN CASE WHEN total > 0 THEN 'completed' ELSE 'not_applicable' END ELSE 'partial' END AS grounding_status,
    CASE WHEN o_orderstatus <> 'P' AND n = j THEN round(su / n, 9) END AS support_rate, CASE WHEN o_orderstatus <> 'P' AND coalesce(n, 0) = coalesce(j, 0) THEN CASE WHEN n > 0 THEN 'completed' ELSE 'not_applicable' END ELSE 'partial' END AS citation_status
FROM orders CROSS JOIN (VALUES ('source_evidence'), ('delivered_context')) b(basis) LEFT JOIN gs ON gs.s = o_orderkey AND gs.basis = b.basis LEFT JOIN ts ON ts.s = o_orderkey LEFT JOIN un ON un.s = o_orderkey""")
def grounding_rates(spark, sf):
    c = _cited(spark, sf)
    rows = c.select("claim_id", "sample_id", "sample_status", (F.col("l_linestatus") == "O").alias("source_evidence_observed"), F.lit(True).alias("delivered_context_observed"), F.col("support").alias("source_evidence_support"), F.col("support").alias("delivered_context_support"))
    targets = c.filter("l_linenumber % 2 = 0").select("claim_id", "sample_id", "sample_status", "support", F.when(F.col("l_tax") > 0.07, "ambiguous").otherwise("adjacent").alias("binding"), (F.col("l_quantity") <= 45).alias("has_text"))
    samples = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("pending").alias("evaluation_status"))
    out = grounding.grounding_summary(samples, grounding.grounding_results(rows), grounding.citation_results(targets), c.select("claim_id", "sample_id"))
    return out.select("sample_id", "basis", "total", "judged", "grounded", "n_citations", "n_supported", "n_inaccessible", "n_uncited", F.round("grounded_rate", 9).alias("grounded_rate"), "grounding_status", F.round("support_rate", 9).alias("support_rate"), "citation_status")


# The unit is: quote, run of markers, words, and a last marker; so each marker's binding is known by construction.
@query("""WITH c AS (SELECT conv_id * 1000 + turn AS claim_id, conv_id AS c, turn AS t FROM conversations)
SELECT claim_id, concat('[SOURCE:q', c, ']') AS marker, 'explicit' AS binding FROM c WHERE t % 3 = 0
UNION ALL SELECT claim_id, concat('[', t + 1, ']'), 'adjacent' FROM c WHERE t % 2 = 0 UNION ALL SELECT claim_id, 'https://x.org/a', 'adjacent' FROM c WHERE t % 2 = 0
UNION ALL SELECT claim_id, concat('[', t + 1, ']'), 'ambiguous' FROM c WHERE t % 2 = 1
UNION ALL SELECT claim_id, '[SOURCE:end]', CASE WHEN t % 5 = 0 THEN 'explicit' ELSE 'ambiguous' END FROM c""")
def citation_bindings(spark, sf):
    t, c = F.col("turn"), F.col("conv_id")
    quote = F.concat(F.lit("A claim"), F.when(t % 3 == 0, F.format_string(" of [SOURCE:q%d]", c)).otherwise(""), F.lit(" here"))
    note = F.format_string("[%d]", t + 1)
    tail = F.when(t % 2 == 0, F.concat(F.lit(". "), note, F.lit(", https://x.org/a ; and"))).otherwise(F.concat(F.lit(" as "), note))
    rows = table(spark, sf, "conversations").select((c * 1000 + t).alias("claim_id"), quote.alias("quote"), F.concat(F.lit("x "), quote, tail, F.lit(" more [SOURCE:end]")).alias("unit"), (F.length(quote) + 2).alias("quote_end"), F.when(t % 5 == 0, F.array(F.lit("[SOURCE:end]"))).alias("declared"))
    return grounding.bindings(rows)


@query("""WITH e AS (SELECT concat('p', page_id % 100) AS source_id, concat('https://s.org/', page_id % 100) AS url, bool_or(page_id % 100 % 5 <> 0) AS has_text FROM pages GROUP BY ALL),
b AS (SELECT conv_id AS c, turn % 4 AS k, (conv_id + turn % 2) % 130 AS p, CASE turn % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS r FROM conversations),
m AS (SELECT c, r, CASE k WHEN 0 THEN concat('[SOURCE:p', p, ']') WHEN 1 THEN concat('https://s.org/', p, '.') WHEN 2 THEN concat('[', p, ']') ELSE concat('https://nowhere.org/', p) END AS marker, CASE WHEN k < 3 THEN concat('p', p) END AS want FROM b),
j AS (SELECT c, r, marker, coalesce(e.source_id, concat('unresolved:', marker)) AS source_id, has_text FROM m LEFT JOIN e ON e.source_id = want)
SELECT c AS claim_id, source_id, list_sort(list(DISTINCT marker)) AS markers, coalesce(bool_or(has_text), false) AS has_text, (['explicit', 'adjacent', 'ambiguous'])[min(r) + 1] AS binding FROM j GROUP BY ALL""")
def citation_sources(spark, sf):
    t, p = F.col("turn"), (F.col("conv_id") + F.col("turn") % 2) % 130
    k = t % 4
    marker = F.when(k == 0, F.format_string("[SOURCE:p%d]", p)).when(k == 1, F.format_string("https://s.org/%d.", p)).when(k == 2, F.format_string("[%d]", p)).otherwise(F.format_string("https://nowhere.org/%d", p))
    bound = table(spark, sf, "conversations").select(F.col("conv_id").alias("claim_id"), marker.alias("marker"), F.when(t % 3 == 1, "explicit").when(t % 3 == 2, "adjacent").otherwise("ambiguous").alias("binding"))
    n = F.col("page_id") % 100
    pages = table(spark, sf, "pages").select(n.alias("n")).distinct()
    notes = spark.range(130).select(F.col("id").alias("number"), F.format_string("https://s.org/%d", "id").alias("url"))
    evidence = pages.select(F.format_string("p%d", "n").alias("source_id"), F.format_string("https://s.org/%d", "n").alias("url"), F.when(F.col("n") % 5 == 0, " ").otherwise("text").alias("text"))
    return grounding.citation_targets(bound, notes, evidence)


@query("""WITH i AS (SELECT event_id AS id, ts AS s, ts + INTERVAL 1 HOUR * (event_id % 5) AS e FROM events) SELECT c.id AS context_id, u.id AS upstream_id FROM i c JOIN i u ON u.id IN (c.id - 1, c.id - 7) WHERE u.e > c.s""")
def lineage_time_order(spark, sf):
    e = table(spark, sf, "events")
    i = e.select(F.col("event_id").alias("invocation_id"), F.col("ts").alias("started_at"), (F.col("ts") + F.make_interval(hours=(F.col("event_id") % 5).cast("int"))).alias("ended_at"))
    contexts = e.select(F.col("event_id").alias("context_id"), F.col("event_id").alias("invocation_id"), F.array(F.col("event_id") - 1, F.col("event_id") - 7, F.col("event_id") - 1).alias("upstream_ids"))
    return grounding.lineage_problems(contexts, i)


# --- coverage ---------------------------------------------------------------------

_SCOPES = """WITH r AS (SELECT l_orderkey AS sample_id, l_orderkey % 40 AS case_id, l_suppkey % 7 AS company_id, l_returnflag AS section_id, l_linestatus AS stage, concat(l_suppkey % 7, '/', l_returnflag, '/', l_linenumber % 2) AS item_id,
    NOT (l_returnflag = 'N' AND l_suppkey % 7 = 3) AS applicable, l_discount < 0.1 OR l_orderkey % 40 < 20 AS done, CASE WHEN l_tax > 0.07 THEN 'incorrect' WHEN l_tax > 0.02 THEN 'fulfilled' ELSE 'missing' END AS v FROM lineitem),
items AS (SELECT concat(c, '/', s, '/', k) AS item_id, c AS company_id, s AS section_id, NOT (s = 'N' AND c = 3) AND (k < 2 OR c % 2 = 0) AS applicable FROM range(9) c(c), (VALUES ('A'), ('N'), ('R')) s(s), range(3) k(k)),
x AS (SELECT *, unnest(['sample', 'case', 'company', 'section', 'company_section', 'report']) AS scope FROM r),
k AS (SELECT scope, CASE WHEN scope = 'sample' THEN sample_id END AS sample_id, CASE WHEN scope = 'case' THEN case_id END AS case_id, CASE WHEN scope IN ('company', 'company_section') THEN company_id END AS company_id, CASE WHEN scope IN ('section', 'company_section') THEN section_id END AS section_id, stage, item_id, applicable, done, v FROM x),
f AS (SELECT scope, sample_id, case_id, company_id, section_id, stage, item_id, CASE WHEN bool_and(NOT applicable) THEN 'not_applicable' WHEN bool_or(NOT done) THEN 'unjudged' WHEN bool_or(v = 'incorrect') THEN 'incorrect' WHEN bool_or(v = 'fulfilled') THEN 'fulfilled' ELSE 'missing' END AS state FROM k GROUP BY ALL),
g AS (SELECT DISTINCT scope, company_id, section_id, stage FROM f WHERE scope IN ('company', 'section', 'company_section', 'report')),
a AS (SELECT g.scope, NULL::BIGINT AS sample_id, NULL::BIGINT AS case_id, g.company_id, g.section_id, g.stage, i.item_id, CASE WHEN i.applicable THEN 'unrepresented' ELSE 'not_applicable' END AS state FROM g JOIN items i ON (g.company_id IS NULL OR g.company_id = i.company_id) AND (g.section_id IS NULL OR g.section_id = i.section_id)
    WHERE NOT EXISTS (FROM f WHERE f.scope = g.scope AND f.company_id IS NOT DISTINCT FROM g.company_id AND f.section_id IS NOT DISTINCT FROM g.section_id AND f.stage = g.stage AND f.item_id = i.item_id))
SELECT scope, sample_id, case_id, company_id, section_id, stage, count(*) FILTER (WHERE state <> 'not_applicable') AS n_items, count(*) FILTER (WHERE state = 'fulfilled') AS n_fulfilled, count(*) FILTER (WHERE state = 'incorrect') AS n_incorrect, count(*) FILTER (WHERE state = 'unjudged') AS n_unjudged, count(*) FILTER (WHERE state = 'unrepresented') AS n_unrepresented,
    CASE WHEN count(*) FILTER (WHERE state IN ('unjudged', 'unrepresented')) = 0 AND count(*) FILTER (WHERE state <> 'not_applicable') > 0 THEN round(count(*) FILTER (WHERE state = 'fulfilled') / count(*) FILTER (WHERE state <> 'not_applicable'), 9) END AS coverage
FROM (FROM f UNION ALL FROM a) GROUP BY ALL"""


@query(_SCOPES)
def coverage_scopes(spark, sf):
    company = F.col("l_suppkey") % 7
    away = (F.col("l_returnflag") == "N") & (company == 3)
    verdict = F.when(F.col("l_tax") > 0.07, "incorrect").when(F.col("l_tax") > 0.02, "fulfilled").otherwise("missing")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_orderkey") % 40).alias("case_id"), company.alias("company_id"), F.col("l_returnflag").alias("section_id"), F.col("l_linestatus").alias("stage"), F.format_string("%d/%s/%d", company, "l_returnflag", F.col("l_linenumber") % 2).alias("item_id"), (~away).alias("applicable"), F.when((F.col("l_discount") < 0.1) | (F.col("l_orderkey") % 40 < 20), "completed").otherwise("pending").alias("status"), verdict.alias("verdict"))
    i = spark.range(9).select(F.col("id").alias("company_id"), F.explode(F.array(*map(F.lit, "ANR"))).alias("section_id")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    c = F.col("company_id")
    fine = ~((F.col("section_id") == "N") & (c == 3)) & ((F.col("k") < 2) | (c % 2 == 0))
    items = i.select(F.format_string("%d/%s/%d", c, "section_id", "k").alias("item_id"), "company_id", "section_id", fine.alias("applicable"))
    out = quality.coverage_scopes(rows, items)
    return out.select("scope", "sample_id", "case_id", "company_id", "section_id", "stage", "n_items", "n_fulfilled", "n_incorrect", "n_unjudged", "n_unrepresented", F.round("coverage", 9).alias("coverage"))


@query("""SELECT c_custkey AS item_id, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F' AND o_orderdate::DATE <= DATE '1995-06-01' + (c_custkey % 300)::INT), []) AS facts FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def required_item_facts(spark, sf):
    o = table(spark, sf, "orders")
    of = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.flatten(F.collect_list(F.array("o_orderkey", "o_orderkey"))).alias("reference_ids"))
    items = table(spark, sf, "customer").join(of, "c_custkey", "left").select(F.col("c_custkey").alias("item_id"), F.expr("date_add(date'1995-06-01', cast(c_custkey % 300 as int))").alias("as_of_date"), "reference_ids")
    facts = o.select(F.col("o_orderkey").alias("reference_id"), F.col("o_orderkey").alias("fact_id"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("pending").alias("review_status"), F.to_date("o_orderdate").alias("fact_date"))
    return quality.item_facts(items, facts)


# --- dataset ------------------------------------------------------------------------

_DATASET = f"""WITH {_ONCE}, s AS (SELECT s_suppkey AS id, s_nationkey AS c, DATE '1993-01-01' + (s_suppkey % 1000)::INT AS d FROM supplier WHERE s_suppkey % 19 <> 0),
f AS (SELECT id, l_suppkey AS src, l_linenumber AS n, l_orderkey AS o, l_partkey AS p, CASE WHEN l_orderkey % 11 = 0 THEN 99 ELSE n.s_nationkey END AS c, l_shipdate::DATE AS d, l_returnflag AS x FROM once JOIN supplier n ON n.s_suppkey = l_suppkey),
i AS (SELECT p_partkey AS id, p_partkey % 23 = 0 AS old FROM part)
SELECT DISTINCT rule, row FROM (
SELECT 'review without case' AS rule, o_orderkey::VARCHAR AS row FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT 'case without review', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 13 = 1
UNION ALL SELECT 'duplicate case_id', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 13 = 2
UNION ALL SELECT 'repeated fact source', id::VARCHAR FROM f WHERE n = 7 UNION ALL SELECT 'unknown fact source', id::VARCHAR FROM f WHERE src % 19 = 0
UNION ALL SELECT 'source of another company', f.id::VARCHAR FROM f JOIN s ON s.id = src WHERE s.c <> f.c UNION ALL SELECT 'future source or fact', f.id::VARCHAR FROM f JOIN s ON s.id = src WHERE s.d > f.d
UNION ALL SELECT 'verified without human review', id::VARCHAR FROM f WHERE x = 'R' AND n = 2
UNION ALL SELECT 'fact not listed by its item', id::VARCHAR FROM f WHERE n > 5 UNION ALL SELECT 'item of another version', id::VARCHAR FROM i WHERE old
UNION ALL SELECT 'item not listed by its fact', p::VARCHAR FROM f WHERE n = 4 AND c IS NOT DISTINCT FROM 5 UNION ALL SELECT 'item reference of another scope', p::VARCHAR FROM f WHERE n <= 5 AND c <> 5
UNION ALL SELECT 'case lacks its items'' references', o::VARCHAR FROM f WHERE o % 13 <> 0 AND n = 1 AND EXISTS (FROM f g WHERE g.p = f.p AND g.n <= 5 AND g.o <> f.o))"""


@query(_DATASET)
def dataset_violations(spark, sf):
    sup = table(spark, sf, "supplier")
    sources = sup.filter("s_suppkey % 19 <> 0").select(F.col("s_suppkey").alias("source_id"), F.array("s_nationkey").alias("company_ids"), F.expr("date_add(date'1993-01-01', cast(s_suppkey % 1000 as int))").alias("published_date"))
    li = _once(spark, sf).join(sup.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    # Many rules read the tables: each is made once.
    li = kept(li)
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    facts = li.select(
        F.col("id").alias("fact_id"), F.col("id").alias("reference_id"), F.when(F.col("l_orderkey") % 11 == 0, 99).otherwise(F.col("s_nationkey")).alias("company_id"), F.lit("s").alias("section_id"), F.to_date("l_shipdate").alias("as_of_date"), F.to_date("l_shipdate").alias("source_as_of_date"),
        F.when(n == 7, F.array("l_suppkey", "l_suppkey")).otherwise(F.array("l_suppkey")).alias("source_ids"), F.when(n == 4, F.array().cast("array<bigint>")).otherwise(F.array(part)).alias("required_item_ids"), F.when(F.col("l_returnflag") == "R", "verified").otherwise("pending").alias("review_status"), F.when(n != 2, "human").alias("review_kind"),
    )
    listed = li.filter("l_linenumber <= 5").groupBy("l_partkey").agg(F.collect_list("id").alias("reference_ids"))
    items = table(spark, sf, "part").join(listed, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("required_item_id"), F.when(F.col("p_partkey") % 23 == 0, "0").otherwise("1").alias("version"), F.lit(5).alias("company_id"), F.lit("s").alias("section_id"), F.coalesce("reference_ids", F.array().cast("array<bigint>")).alias("reference_ids"))
    own = li.groupBy("l_orderkey").agg(F.collect_list("id").alias("reference_ids"), F.collect_list(F.when(n == 1, part)).alias("required_item_ids"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    cases = orders.filter("case_id % 13 <> 0").join(own, F.col("case_id") == F.col("l_orderkey"), "left").select("case_id", F.lit(5).alias("company_id"), F.lit("s").alias("section_id"), "reference_ids", "required_item_ids")
    reviews = orders.filter("case_id % 13 <> 1").unionByName(orders.filter("case_id % 13 = 2"))
    return dataset.violations(sources, facts, kept(items), kept(cases), reviews, "1")


@query(f"""WITH {_ONCE} SELECT o_orderkey AS case_id, string_agg(concat('line ', l_linenumber), chr(10) ORDER BY l_linenumber DESC) FILTER (WHERE l_returnflag = 'A') AS reference, coalesce(list(id ORDER BY id) FILTER (WHERE l_returnflag <> 'A'), []) AS excluded FROM orders JOIN once ON l_orderkey = o_orderkey GROUP BY 1""")
def verified_references(spark, sf):
    li = _once(spark, sf)
    refs = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "id")), asc=False), lambda x: x["id"])
    cases = li.groupBy(F.col("l_orderkey").alias("case_id")).agg(refs.alias("reference_ids"))
    facts = li.select(F.col("id").alias("reference_id"), F.format_string("line %d", "l_linenumber").alias("statement"), F.when(F.col("l_returnflag") == "A", "verified").otherwise("rejected").alias("review_status"))
    return dataset.verified_references(cases, facts)


@query("""SELECT event_id AS sample_id, CASE WHEN user_id % 10 = 0 THEN 'unbound' WHEN event_type = 'error' THEN 'mismatch' ELSE 'bound' END AS binding, CASE WHEN user_id % 10 <> 0 AND event_type <> 'error' THEN concat('r', user_id) END AS reference FROM events""")
def bound_samples(spark, sf):
    e, day = table(spark, sf, "events"), F.lit("2024-01-01").cast("date")
    samples = e.select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("case_id"), F.col("user_id").alias("company_id"), F.when(F.col("event_type") == "error", F.lit(None).cast("string")).otherwise("s").alias("section_id"), day.alias("as_of_date"))
    cases = e.select(F.col("user_id").alias("case_id")).distinct().filter("case_id % 10 <> 0").select("case_id", F.col("case_id").alias("company_id"), F.lit("s").alias("section_id"), day.alias("as_of_date"))
    return dataset.bound_samples(samples, cases, cases.select("case_id", F.format_string("r%d", "case_id").alias("reference"))).select("sample_id", "binding", "reference")


@query("SELECT DISTINCT a.doc_id AS source_id, b.doc_id AS evidence_id FROM documents a JOIN documents b ON a.text = b.text AND b.lang IN (a.lang, 'en') WHERE a.doc_id % 3 = 0")
def evidence_by_content(spark, sf):
    d = table(spark, sf, "documents").withColumn("sha256", F.sha2("text", 256))
    sources = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("source_id"), F.array("lang", F.lit("en")).alias("company_ids"), "sha256")
    return dataset.evidence_of_sources(sources, d.select(F.col("doc_id").alias("evidence_id"), F.col("lang").alias("company_id"), "sha256"))


@query("SELECT conv_id AS sample_id, conv_id % 4 <> 0 OR count(*) = 1 AS same FROM conversations GROUP BY 1")
def ordered_contexts(spark, sf):
    c = table(spark, sf, "conversations").withColumn("text", F.concat("text", F.col("turn").cast("string")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    samples = c.groupBy("conv_id").agg(texts.alias("t")).select(F.col("conv_id").alias("sample_id"), F.col("conv_id").alias("invocation_id"), F.when(F.col("conv_id") % 4 == 0, F.reverse("t")).otherwise(F.col("t")).alias("contexts"))
    return dataset.delivered_in_order(samples, c.select(F.col("conv_id").alias("invocation_id"), F.col("turn").alias("pos"), "text"))


# --- records --------------------------------------------------------------------------

_RECORDS = """WITH o AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS id FROM orders)
SELECT * FROM (
SELECT 'timing' AS "table", id AS row, 'order' AS rule FROM o WHERE k % 7 = 0 UNION ALL SELECT 'timing', id, 'duration needs a start' FROM o WHERE k % 7 = 0 AND k % 2 = 0
UNION ALL SELECT 'metric_result', id, 'range' FROM o WHERE k % 5 = 4 UNION ALL SELECT 'metric_result', id, 'value only if completed' FROM o WHERE k % 5 > 0 AND k % 3 = 0 UNION ALL SELECT 'metric_result', id, 'empty completed needs a reason' FROM o WHERE k % 5 = 0 AND k % 3 > 0
UNION ALL SELECT 'retrieval', id, 'ranks ascend' FROM o WHERE k % 11 < 2
UNION ALL SELECT 'invocation', id, 'not its own parent' FROM o WHERE k % 9 = 0 UNION ALL SELECT 'invocation', id, 'attempt iff retry' FROM o WHERE k % 4 = 1 UNION ALL SELECT 'invocation', id, 'previous iff link reason' FROM o WHERE k % 4 = 2
UNION ALL SELECT 'invocation', id, 'failed has error' FROM o WHERE k % 6 = 1 UNION ALL SELECT 'invocation', id, 'succeeded has snapshots' FROM o WHERE k % 6 <> 1 AND k % 8 = 0
UNION ALL SELECT 'claim_counts', id, 'verdicts' FROM o WHERE k % 10 = 3 UNION ALL SELECT 'claim_counts', id, 'judged' FROM o WHERE k % 10 = 4 UNION ALL SELECT 'claim_counts', id, 'critical' FROM o WHERE k % 10 = 5
UNION ALL SELECT 'review_decision', id, 'adjudicated' FROM o WHERE k % 3 = 1 UNION ALL SELECT 'review_decision', id, 'others resolve none' FROM o WHERE k % 3 = 2
UNION ALL SELECT 'additional_research', id, 'new is not duplicate' FROM o WHERE k % 12 = 0 UNION ALL SELECT 'additional_research', id, 'outcome' FROM o WHERE k % 12 = 1)"""


@query(_RECORDS)
def record_rules(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("id"))
    e = lambda **c: o.select("id", *[F.expr(x).alias(n) for n, x in c.items()])
    tables = {
        "timing": e(started_at="if(k % 7 = 0, null, timestamp'2024-01-01')", ended_at="timestamp'2024-01-02'", duration="if(k % 2 = 0, 1.0, null)"),
        "metric_result": e(value="if(k % 5 = 0, null, (k % 5) / 3.5)", evaluation_status="if(k % 3 = 0, 'error', 'completed')", reason="cast(null as string)"),
        "retrieval": e(ranks="case k % 11 when 0 then array(1, 1, 2) when 1 then array(2, 1) when 2 then array(1) when 3 then cast(array() as array<int>) else array(1, 2, 5) end"),
        "invocation": e(
            invocation_id="id", parent_id="if(k % 9 = 0, id, 'p')", previous_id="if(k % 4 in (2, 3), 'q', null)", link_reason="if(k % 4 = 3, 'repeat', null)", attempt="if(k % 4 = 1, 2, 1)", fallback_used="false", fallback_reason="cast(null as string)", status="if(k % 6 = 1, 'failed', 'succeeded')", ended_at="timestamp'2024-01-01'", error="cast(null as string)", input_sha256="if(k % 8 = 0, null, 'x')", output_sha256="'y'"
        ),
        "claim_counts": e(n_verified="if(k % 10 = 3, 2, 1)", n_contradicted="1", n_unverifiable="1", n_judged="3", n_pending="if(k % 10 = 4, 1, 0)", n_claims="3", n_critical_contradicted="if(k % 10 = 5, 2, 0)", n_critical_unverifiable="0"),
        "review_decision": e(status="if(k % 3 = 0, 'adjudicated', if(k % 3 = 1, 'adjudicated', 'confirmed'))", resolves="case k % 3 when 0 then array('a', 'b') when 1 then array('a', 'a') else array('c') end"),
        "additional_research": e(new_evidence_ids="array('a')", duplicate_evidence_ids="if(k % 12 = 0, array('a', 'b'), array('b'))", outcome="if(k % 12 = 1, 'no_new_evidence', 'new_evidence')"),
    }
    return records.broken(tables)


@query("SELECT l_suppkey, count(DISTINCT l_tax) + 1 AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_tax) > 0")
def unequal_groups(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select("l_suppkey", F.col("l_tax").alias("v")).unionByName(li.select("l_suppkey", F.lit(None).cast("double").alias("v")))
    return records.one_value(rows, ["l_suppkey"], "v")


@query("""WITH a AS (SELECT l_suppkey, l_returnflag AS i, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 30 GROUP BY ALL), b AS (SELECT l_suppkey, l_returnflag AS i, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45 GROUP BY ALL),
j AS (SELECT l_suppkey, i, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (l_suppkey, i)), g AS (SELECT l_suppkey, coalesce(list(i ORDER BY i) FILTER (WHERE y = 0), []) AS missing, coalesce(list(i ORDER BY i) FILTER (WHERE x = 0), []) AS extra, coalesce(list(i ORDER BY i) FILTER (WHERE x > 1 OR y > 1), []) AS repeated FROM j GROUP BY 1)
SELECT *, len(missing) + len(extra) + len(repeated) = 0 AS same FROM g""")
def set_equality(spark, sf):
    li = table(spark, sf, "lineitem")
    return joins.set_gap(li.filter("l_linestatus = 'O' and l_quantity > 30"), li.filter("l_linestatus = 'F' and l_quantity > 45"), ["l_suppkey"], "l_returnflag")


# --- review -----------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT concat({_LINE}, '.custom_factual') AS target_id, 'claim' AS kind, 'custom_factual' AS review_group, l_returnflag AS label, l_linenumber = 1 AS critical FROM lineitem UNION ALL SELECT concat({_LINE}, '.delivered_context'), 'claim', 'delivered_context', (l_linestatus = 'O')::VARCHAR, l_linenumber = 1 FROM lineitem
UNION ALL SELECT concat(o_orderkey, '.faithfulness'), 'metric', 'faithfulness', NULL, false FROM orders UNION ALL SELECT concat('u', p_partkey, '.extraction'), 'extraction', 'custom_extraction', NULL, false FROM part) SELECT * FROM t""")
def review_inventory(spark, sf):
    li = _lines(spark, sf).select(F.col("id").alias("claim_id"), F.col("l_returnflag").alias("verdict"), F.lit("delivered_context").alias("basis"), (F.col("l_linestatus") == "O").alias("grounded"), (F.col("l_linenumber") == 1).alias("critical"), F.lit("5 TOPS").alias("text"))
    metrics = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit("faithfulness").alias("metric_name"), F.lit(None).cast("string").alias("text"))
    units = table(spark, sf, "part").select(F.format_string("u%d", "p_partkey").alias("unit_id"), F.col("p_name").alias("text"))
    return review.inventory(li, li, metrics, units).select("target_id", "kind", "review_group", "label", "critical")


@query("""WITH t AS (SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN ['number', 'unit', 'technology'] WHEN 1 THEN ['commercial_status'] ELSE ['other'] END) AS stratum FROM part) SELECT 'custom_extraction' AS review_group, stratum, count(*) AS n_targets, count(*) FILTER (WHERE p_partkey % 4 = 0) AS n_reviewed FROM t GROUP BY 2""")
def review_strata(spark, sf):
    p = table(spark, sf, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, "5 TOPS").when(F.col("p_partkey") % 3 == 1, "PoC").otherwise("plain")
    units = p.select(F.col("p_partkey").cast("string").alias("unit_id"), text.alias("text"))
    none = table(spark, sf, "lineitem").limit(0).select(F.lit("").alias("claim_id"), F.lit("").alias("verdict"), F.lit("").alias("basis"), F.lit(True).alias("grounded"), F.lit(True).alias("critical"), F.lit("").alias("text"), F.lit("").alias("sample_id"), F.lit("").alias("metric_name"))
    targets = review.inventory(none, none, none, units)
    return review.stratum_coverage(targets, p.filter("p_partkey % 4 = 0").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".extraction")).alias("target_id")))


_LEDGER = """WITH e AS (SELECT event_id // 6 AS t, event_id AS s, event_id % 6 AS p, event_id // 6 % 8 AS k, min(event_id) OVER (PARTITION BY event_id // 6) AS first FROM events),
r AS (SELECT *, CASE WHEN p = 3 THEN 'adjudicated' WHEN p = 0 AND k = 6 THEN 'proposed' ELSE 'confirmed' END AS st FROM e)
SELECT t AS target_id, s AS seq, CASE
    WHEN k = 1 AND p = 2 THEN 'mixed provenance' WHEN k = 2 AND p = 1 THEN 'not linked to the latest revision' WHEN k = 3 AND p = 2 THEN 'time moves backwards'
    WHEN p = 3 AND k = 4 THEN 'current opinion not resolved' WHEN p = 3 AND k = 5 THEN 'too few independent reviewers' WHEN p = 3 AND k = 6 THEN 'resolves a proposal' WHEN p = 3 AND k = 7 THEN 'adjudicator is a reviewer' WHEN p = 3 AND k = 0 THEN 'no disagreement' WHEN p = 4 AND k = 0 THEN 'only adjudications resolve' END AS problem
FROM r WHERE (k = 1 AND p = 2) OR (k = 2 AND p = 1) OR (k = 3 AND p = 2) OR (p = 3 AND k IN (4, 5, 6, 7, 0)) OR (p = 4 AND k = 0)"""


@query(_LEDGER)
def review_ledger(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") / 6).cast("long").alias("target_id"), F.col("event_id").alias("seq"))
    p, k = F.col("seq") % 6, F.col("target_id") % 8
    first = F.col("target_id") * 6
    at = lambda i: first + i
    none = F.array().cast("array<bigint>")
    reviewer = F.when(p == 3, F.when(k == 7, "r1").otherwise("judge")).when(k == 5, "r0").otherwise(F.concat(F.lit("r"), p.cast("string")))
    resolves = F.when(p == 3, F.when(k == 4, F.array(at(0), at(1))).when(k == 5, F.array(at(2))).otherwise(F.array(at(0), at(1), at(2)))).when((p == 4) & (k == 0), F.array(at(3))).otherwise(none)
    return review.append_problems(e.select(
        "target_id", "seq", F.col("seq").alias("review_id"), F.when(p > 0, F.col("seq") - F.when((k == 2) & (p == 1), 9).otherwise(1)).alias("previous_id"), reviewer.alias("reviewer"),
        F.when(p == 3, "adjudicated").when((p == 0) & (k == 6), "proposed").otherwise("confirmed").alias("status"), F.when(k == 0, "same").otherwise(F.concat(F.lit("l"), p.cast("string"))).alias("label"),
        F.when((k == 1) & (p == 2), "synthetic").otherwise("human").alias("provenance"), (F.when((k == 3) & (p == 2), -5).otherwise(0) + F.col("seq")).alias("reviewed_at"), resolves.alias("resolves"),
    ))


@query("""SELECT event_type AS review_group, count(*) AS n_targets, count(*) FILTER (WHERE st IN ('confirmed', 'adjudicated') AND human) AS n_human, count(*) FILTER (WHERE st IN ('confirmed', 'adjudicated') AND NOT human) AS n_synthetic, count(*) FILTER (WHERE st = 'conflict') AS n_conflicts,
    round(count(*) FILTER (WHERE st IN ('confirmed', 'adjudicated') AND human AND event_id % 5 < 3) / nullif(count(*) FILTER (WHERE st IN ('confirmed', 'adjudicated') AND human), 0), 9) AS agreement
FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'adjudicated' WHEN 2 THEN 'conflict' END AS st, event_id % 7 <> 0 AS human FROM events) GROUP BY 1""")
def review_reliability(spark, sf):
    i = F.col("event_id")
    e = table(spark, sf, "events")
    targets = e.select(i.alias("target_id"), F.col("event_type").alias("review_group"), F.lit("a").alias("label"))
    opinions = e.filter("event_id % 4 < 3").select(i.alias("target_id"), F.when(i % 4 == 0, "confirmed").when(i % 4 == 1, "adjudicated").otherwise("conflict").alias("state"), F.when(i % 5 < 3, "a").otherwise("b").alias("label"), F.when(i % 7 != 0, "human").otherwise("synthetic").alias("provenance"))
    return review.reliability(targets, opinions).withColumn("agreement", F.round("agreement", 9))


# --- paired -------------------------------------------------------------------------------

_SIDES = """WITH g AS (SELECT event_id % 2 AS side, user_id, event_type, count(*) AS n, avg(value) AS v FROM events GROUP BY ALL), b AS (SELECT * FROM g WHERE side = 0), a AS (SELECT * FROM g WHERE side = 1),
p AS (SELECT user_id, event_type, b.n AS bn, a.n AS an, b.v AS bv, a.v AS av FROM b FULL JOIN a USING (user_id, event_type))
"""


def _sides(spark, sf):
    e = table(spark, sf, "events")
    side = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("value"))
    return paired.report(side(0), side(1), ["user_id", "event_type"], ["count", "value"], [False, True])


@query(_SIDES + "SELECT user_id, event_type, list_filter([CASE WHEN an > bn THEN 'count' END, CASE WHEN av < bv THEN 'value' END], lambda x: x IS NOT NULL) AS worse FROM p WHERE an > bn OR av < bv")
def regression_samples(spark, sf):
    return paired.regressions(_sides(spark, sf), ["user_id", "event_type"], ["count", "value"], [False, True])


@query(_SIDES + "SELECT count(*) AS n_samples, bool_and(av IS NOT NULL AND bv IS NOT NULL) AS complete, count(*) FILTER (WHERE an > bn OR av < bv) AS n_regressions, CASE WHEN NOT bool_and(av IS NOT NULL AND bv IS NOT NULL) THEN 'incomplete' WHEN count(*) FILTER (WHERE an > bn OR av < bv) > 0 THEN 'regressed' ELSE 'no_detected_regression' END AS verdict FROM p")
def paired_verdict(spark, sf):
    return paired.overall(_sides(spark, sf), ["value"], ["count", "value"], [False, True])


@query("""SELECT n_nationkey, 'n_name' AS field, to_json({n_name: n_name})::VARCHAR AS before, to_json({n_name: lower(n_name)})::VARCHAR AS after FROM nation WHERE n_regionkey = 1
UNION ALL SELECT n_nationkey, 'extra', '{}', '{"extra":1}' FROM nation WHERE n_nationkey % 5 = 0""")
def changed_settings(spark, sf):
    n = table(spark, sf, "nation").withColumn("commit", F.lit("x"))
    before = n.select("n_nationkey", "n_name", F.lit(None).cast("int").alias("extra"), "commit")
    after = n.select("n_nationkey", F.when(F.col("n_regionkey") == 1, F.lower("n_name")).otherwise(F.col("n_name")).alias("n_name"), F.when(F.col("n_nationkey") % 5 == 0, 1).alias("extra"), F.lit("y").alias("commit"))
    return paired.changed_settings(before, after, "n_nationkey", ("commit",))


@query("""SELECT o_orderkey AS pair_id, unnest(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'same run' END, CASE WHEN o_orderkey % 5 = 0 THEN 'not frozen' END, CASE WHEN o_orderkey % 4 = 0 THEN 'another evaluator' END, CASE WHEN o_orderstatus IN ('F', 'O') AND o_orderkey % 3 = 0 THEN 'inputs changed' END], lambda x: x IS NOT NULL)) AS problem FROM orders""")
def comparison_gates(spark, sf):
    k = F.col("o_orderkey")
    same = {f"{s}_{c}": F.lit("x") for s in ("before", "after") for c in ("data_mode", "dataset", "references")}
    pairs = table(spark, sf, "orders").withColumns(same).withColumns({"pair_id": k, "mode": F.when(F.col("o_orderstatus") == "F", "frozen").when(F.col("o_orderstatus") == "O", "isolated").otherwise("live"), "before_run_id": k, "after_run_id": F.when(k % 7 == 0, k).otherwise(-k), "before_frozen": F.lit(True), "after_frozen": F.when(k % 5 != 0, True), "before_evaluator": F.lit("e"), "after_evaluator": F.when(k % 4 != 0, "e"), "before_inputs": k, "after_inputs": F.when(k % 3 == 0, k + 1).otherwise(k)})
    return paired.gate_problems(pairs)


@query("SELECT o_orderkey AS run_id, o_orderstatus <> 'P' AND coalesce(ok, false) AS succeeded FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def run_success(spark, sf):
    checks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "not_applicable").otherwise("pass").alias("result"))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded").alias("status"))
    return paired.workflow_success(checks, runs)


# --- run logs --------------------------------------------------------------------------------


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), v AS (SELECT user_id, ts AS buy_ts, max(event_id) AS buy_id FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT p.event_id, p.user_id, p.ts, v.buy_ts, v.buy_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.buy_ts""")
def first_after_event(spark, sf):
    e = table(spark, sf, "events")
    buys = e.filter("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("buy_ts")).agg(F.max("event_id").alias("buy_id"))
    return ordered.first_after(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), buys, ["user_id"], "ts", "buy_ts", ["buy_id"])


@query("""SELECT event_id AS invocation_id, last_value(CASE WHEN value > 40 THEN event_id END IGNORE NULLS) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_id FROM events""")
def previous_call(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("invocation_id"), F.col("event_type").alias("operation"), F.col("user_id").alias("company_id"), F.col("ts").alias("started_at"), F.when(F.col("value") > 40, "succeeded").otherwise("failed").alias("status"))
    return workflow.previous_calls(e)


# A conversation's turns nest in threes: turn 3n opens, 3n + 1 opens within, 3n + 2 closes; what stays open is the parent of the next three.
@query("""SELECT conv_id, turn AS call, CASE WHEN turn > 0 THEN CASE WHEN turn % 3 = 1 THEN turn - 1 ELSE turn - 3 END END AS parent FROM conversations WHERE turn % 3 < 2""")
def span_nesting(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("turn").alias("call"), F.when(F.col("turn") % 3 < 2, "start").otherwise("end").alias("kind"))
    return workflow.nested(c, ["conv_id"], "turn", "kind", "start", "end", "call")


@query("""WITH c AS (SELECT c_custkey AS company_id FROM customer), k AS (SELECT o_orderkey AS id, o_custkey AS company_id, CASE o_orderkey % 3 WHEN 0 THEN 'load' WHEN 1 THEN 'score' ELSE 'loop' END AS op, o_orderstatus <> 'P' AS ok, CASE o_orderkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS route FROM orders)
SELECT 'coverage_score' AS check_id, company_id, CASE WHEN EXISTS (FROM k WHERE k.company_id = c.company_id AND op = 'score' AND ok) THEN 'pass' ELSE 'fail' END AS result FROM c
UNION ALL SELECT 'coverage_load', NULL, CASE WHEN EXISTS (FROM k WHERE op = 'load' AND ok) THEN 'pass' ELSE 'fail' END
UNION ALL SELECT concat('route_', id), company_id, CASE WHEN op <> 'loop' AND route = 'a' THEN 'pass' ELSE 'fail' END FROM k WHERE route IS NOT NULL
UNION ALL SELECT concat('call_', id), company_id, 'fail' FROM k WHERE NOT ok UNION ALL SELECT concat('unknown_company_', id), company_id, 'fail' FROM k WHERE company_id NOT IN (SELECT company_id FROM c)
UNION ALL SELECT 'iteration_limit', company_id, CASE WHEN (SELECT count(*) FROM k WHERE k.company_id = c.company_id AND op = 'loop') <= 4 THEN 'pass' ELSE 'fail' END FROM c""")
def workflow_checks(spark, sf):
    k = F.col("o_orderkey")
    calls = table(spark, sf, "orders").select(k.cast("string").alias("invocation_id"), F.when(k % 3 == 0, "load").when(k % 3 == 1, "score").otherwise("loop").alias("operation"), F.col("o_custkey").alias("company_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded").alias("status"), F.when(k % 5 == 0, "a").when(k % 5 == 1, "b").alias("route"))
    routes = spark.createDataFrame([("load", "a"), ("score", "a")], "operation string, route string")
    return workflow.checks(workflow.steps(spark, ("load",), ("score", "note"), ("note",)), table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id")), calls, routes, 4, "loop")


# --- numbers, times, JSON ----------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE user_id END AS "input", CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN user_id + 1 END AS output, CASE event_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN 9 END AS cached FROM events""")
def token_usage(spark, sf):
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"input_tokens": '), u, F.lit(', "output_tokens": 0, "input_token_details": {"cache_read": 7}}')))
        .when(k == 1, F.concat(F.lit('{"prompt_tokens": '), u, F.lit(', "completion_tokens": '), (F.col("user_id") + 1).cast("string"), F.lit(', "prompt_tokens_details": {"cached_tokens": 8}}')))
        .when(k == 2, F.concat(F.lit('{"input_tokens": '), u, F.lit(', "prompt_tokens": 5, "prompt_tokens_details": {"cache_read": 9, "cached_tokens": 1}}')))
        .otherwise("{}")
    )
    return table(spark, sf, "events").select("event_id", numeric.token_counts(raw).alias("t")).select("event_id", "t.*")


@query("""SELECT p_partkey, CASE WHEN p_size < 20 THEN 'threshold outside policy scale' WHEN p_partkey % 4 = 0 THEN 'top_k must be a positive integer' WHEN p_size < 50 OR p_partkey % 60 + 45 < p_size OR p_partkey % 60 + 45 > 100 THEN 'target grade thresholds must be ordered' END AS problem FROM part""")
def policy_settings(spark, sf):
    p = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", numeric.threshold_problem(F.col("p_size"), (p % 4).cast("int"), 20, 100, (p % 60 + 45).cast("int")).alias("problem"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 9 HOUR END AS at, CASE WHEN event_id % 5 = 1 THEN 'end before start' WHEN event_id % 5 = 2 THEN 'end without start' WHEN event_id % 5 = 3 THEN 'duration without start' END AS problem FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def utc_times(spark, sf):
    i, k = F.col("event_id"), F.col("event_id") % 5
    e = table(spark, sf, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(i % 3 == 0, "Z").when(i % 3 == 1, "+0900").otherwise(""))
    start = F.when(~k.isin(2, 3), F.col("ts"))
    end = F.when(k == 1, F.timestamp_add("SECOND", F.lit(-1), F.col("ts"))).when(k != 3, F.col("ts"))
    return e.select("event_id", dates.utc(text).alias("at"), dates.timing_problem(start, end, F.lit(1.0)).alias("problem"))


# The text's form is fixed, so pointers and offsets are known: {"company_name": "c<user>", "team": {"note": "t<id>"}, "url": "x", "references": ["r"], "l": [1, "m/n"]}
@query("""WITH e AS (SELECT event_id, user_id, length(concat('c', user_id)) AS a, length(concat('t', event_id)) AS b FROM events)
SELECT event_id, u.p AS pointer, u.t AS text, u.s::INT AS start_at, u.e::INT AS end_at, CASE WHEN user_id % 2 = 0 THEN concat('c', user_id) END AS company_id, u.x AS section_id, u.r AS exclusion_reason FROM (SELECT *, unnest([
    {p: '/company_name', t: concat('c', user_id), s: 18, e: 18 + a, x: 'report', r: 'routing_or_metadata'}, {p: '/team/note', t: concat('t', event_id), s: 39 + a, e: 39 + a + b, x: 'team', r: NULL}, {p: '/url', t: 'x', s: 51 + a + b, e: 52 + a + b, x: 'report', r: 'routing_or_metadata'},
    {p: '/references/0', t: 'r', s: 71 + a + b, e: 72 + a + b, x: 'report', r: 'source_listing_or_provider_metadata'}, {p: '/l~11/1', t: 'm/n', s: 90 + a + b, e: 93 + a + b, x: 'report', r: NULL}]) AS u FROM e)""")
def json_text_units(spark, sf):
    e = table(spark, sf, "events")
    raw = F.concat(F.lit('{"company_name": "c'), F.col("user_id").cast("string"), F.lit('", "team": {"note": "t'), F.col("event_id").cast("string"), F.lit('"}, "url": "x", "references": ["r"], "l/1": [1.5, "m/n"]}'))
    users = e.filter("user_id % 2 = 0").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("company")).distinct()
    return nested.scoped_units(e.select("event_id", raw.alias("raw")), "raw", users).drop("entity")


@query("""SELECT event_id, [{pointer: '/a/score', value: event_id::DOUBLE}, {pointer: '/b/0/rating', value: -0.5}] AS scores, [concat('c', user_id), 'z'] AS companies, CASE WHEN event_id % 2 = 0 THEN 'n' ELSE concat('c', user_id) END AS first FROM events""")
def json_scores(spark, sf):
    i = F.col("event_id")
    raw = F.concat(F.lit('{"a": {"score": '), i.cast("string"), F.lit(', "x": 3, "company_name": "c'), F.col("user_id").cast("string"), F.lit('"}, "b": [{"rating": -5e-1, "final_score": true, "score_raw": "7"}, {"company_name": "z"}]}'))
    top = F.when(i % 2 == 0, F.lit('{"name": "n"}')).otherwise(F.concat(F.lit('{"name": "n", "company_name": "c'), F.col("user_id").cast("string"), F.lit('"}')))
    return table(spark, sf, "events").select("event_id", nested.numeric_scores(raw).alias("scores"), nested.company_names(raw).alias("companies"), nested.first_present(top, "company_name", "name").alias("first"))


@query("SELECT lang, sha256(string_agg(sha256(text), chr(10) ORDER BY sha256(text))) AS identity FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_identity(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").groupBy("lang").agg(hashing.content_identity(F.sha2("text", 256)).alias("identity"))


# --- research -------------------------------------------------------------------------------------

_Q = ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(research.COMPANY_QUERIES.items()))


@query(f"SELECT s_name, pos, category, replace(t, '{{}}', s_name) AS query FROM supplier CROSS JOIN (VALUES {_Q}) q(pos, category, t)")
def company_queries(spark, sf):
    return research.company_queries(table(spark, sf, "supplier"), "s_name")


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CASES = " ".join(f"WHEN category = '{c}' THEN {_quote(t)}" for c, t in research.SUMMARIES.items())
_WORDS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in research.LEVELS.items())


@query(f"""WITH s AS (SELECT s_suppkey, s_suppkey * 3 % 5 + 1 AS te, s_suppkey * 7 % 5 + 1 AS ma, s_suppkey * 2 % 5 + 1 AS tr, (s_suppkey + 2) % 5 + 1 AS tm, s_suppkey * 4 % 5 + 1 AS co, (s_suppkey + 1) % 5 + 1 AS ri FROM supplier),
e AS (SELECT s_suppkey, unnest([{{d: 'technology', category: 'Technology & Product', score: te, w: 0.25, g: te}}, {{d: 'market', category: 'Market & Traction', score: round_even((ma + tr) / 2, 0)::BIGINT, w: 0.35, g: ma}}, {{d: 'team', category: 'Team & Founders', score: tm, w: 0.25, g: tm}}, {{d: 'competition', category: 'Competitive Advantage', score: co, w: 0.1, g: co}}, {{d: 'risk', category: 'Execution & Financing Risk', score: 6 - ri, w: 0.05, g: 6 - ri}}], recursive := true) FROM s)
SELECT s_suppkey, d AS dimension, score::INT AS score, round(score * w * 20, 1)::DOUBLE AS weighted_score, CASE WHEN d = 'team' AND s_suppkey % 2 = 0 THEN '창업팀은 충분한 경험을 갖추고 있으며 양산을 준비하고 있고 고객과의 계약도 여러 건 진행하고 있다.' ELSE replace(CASE {_CASES} END, '{{}}', CASE score {_WORDS} END) END AS summary,
    replace(CASE WHEN g >= 4 THEN {_quote(research.FOLLOW_UPS['high'])} WHEN g = 3 THEN {_quote(research.FOLLOW_UPS['middle'])} ELSE {_quote(research.FOLLOW_UPS['low'])} END, '{{}}', category) AS follow_up FROM e""")
def evaluation_table(spark, sf):
    k = F.col("s_suppkey")
    signals = {"technology": k * 3, "market": k * 7, "traction": k * 2, "team": k + 2, "competition": k * 4, "risk": k + 1}
    own = {"technology": F.lit("The product provides a new architecture for inference in large data centers."), "market": F.lit(None).cast("string"), "team": F.when(k % 2 == 0, "창업팀은 충분한 경험을 갖추고 있으며 양산을 준비하고 있고 고객과의 계약도 여러 건 진행하고 있다."), "competition": F.lit(""), "risk": F.lit("Risk.")}
    s = table(spark, sf, "supplier").select("s_suppkey", F.lit("Series A").alias("stage"), *[(x % 5 + 1).cast("int").alias(f"{n}_signal") for n, x in signals.items()], *[x.alias(f"{n}_summary") for n, x in own.items()])
    return research.evaluations(s, "s_suppkey").select("s_suppkey", "dimension", "score", "weighted_score", "summary", "follow_up")


_D = research.DRIVERS


@query(f"""WITH e AS (SELECT c_nationkey AS domain, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, c_name, c_custkey FROM customer),
t AS (SELECT domain, string_agg(concat(c_name, ' - https://x.org/', c_custkey), '|' ORDER BY pos) AS refs, count(*) AS n FROM e GROUP BY 1)
SELECT n_nationkey AS domain, CASE WHEN n >= 2 THEN '반도체 시장은 데이터센터 수요가 늘면서 빠르게 성장하고 있고 투자도 함께 늘어나고 있는 상황이다.' ELSE '{research.MARKET_SIZE}' END AS market_size,
    '{_D[0]}' AS driver_0, CASE WHEN n >= 2 THEN '반도체 시장은 데이터센터 수요가 늘면서 빠르게 성장하고 있고 투자도 함께 늘어나고 있는 상황이다.' ELSE '{_D[1]}' END AS driver_1, '{_D[2]}' AS driver_2, coalesce(refs, '') AS refs FROM nation LEFT JOIN t ON domain = n_nationkey""")
def market_notes(spark, sf):
    c = ordered.ranked(table(spark, sf, "customer"), ["c_nationkey"], [F.col("c_custkey")], "pos")
    pos = F.col("pos") - 1
    text = F.when(pos == 1, "반도체 시장은 데이터센터 수요가 늘면서 빠르게 성장하고 있고 투자도 함께 늘어나고 있는 상황이다.").when(pos == 0, "").otherwise("English text only, which the offline path does not translate.")
    evidence = c.select(F.col("c_nationkey").alias("domain"), pos.alias("pos"), F.when(pos < 2, "Industry").otherwise("Framework").alias("category"), F.col("c_name").alias("title"), F.format_string("https://x.org/%d", "c_custkey").alias("url"), text.alias("content"))
    out = research.market_research(table(spark, sf, "nation").select(F.col("n_nationkey").alias("domain")), evidence, "domain")
    return out.select("domain", "market_size", "driver_0", "driver_1", "driver_2", F.array_join("references", "|").alias("refs"))


@query("""SELECT conv_id, turn + 1 AS page, text AS page_content FROM conversations WHERE turn % 3 <> 1 AND text <> ''""")
def evidence_pages(spark, sf):
    c = table(spark, sf, "conversations")
    e = c.select("conv_id", F.col("turn").alias("pos"), F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text")).alias("content"), F.col("role").alias("title"), F.lit("u").alias("url"), F.lit("c").alias("category"))
    return research.evidence_documents(e, ["conv_id"]).select("conv_id", "page", "page_content")


@query("""WITH l AS (SELECT s_nationkey AS k, list(s_name ORDER BY s_suppkey) AS a FROM supplier GROUP BY 1) SELECT n_nationkey, array_to_string(list_concat(CASE WHEN list_contains(coalesce(a, []), n_name) THEN [] ELSE [] END, list_concat(coalesce(a, []), [n_name])), '|') AS refs FROM nation LEFT JOIN l ON k = n_nationkey""")
def reference_merge(spark, sf):
    names = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"])
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(names.alias("a"))
    n = table(spark, sf, "nation").join(s, "n_nationkey", "left")
    return n.select("n_nationkey", F.array_join(research.merged_references(F.col("a"), F.slice("a", 1, 2), F.array("n_name")), "|").alias("refs"))


# A report of fixed form for each part, so that the scope, section and reason of each line are known.
@query("""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'AlphaX' WHEN 1 THEN 'BetaY' END AS c FROM part)
SELECT k AS p_partkey, u.l AS line, u.c AS company_id, u.s AS section_id, u.r AS exclusion_reason FROM (SELECT k, unnest([
    {l: 0, c: NULL, s: 'report', r: 'heading_or_table_header'}, {l: 1, c: NULL, s: 'report', r: NULL}, {l: 3, c: c, s: 'technology', r: 'heading_or_table_header'}, {l: 4, c: c, s: 'technology', r: NULL}, {l: 5, c: c, s: 'team', r: 'heading_or_table_header'}, {l: 6, c: c, s: 'team', r: NULL},
    {l: 7, c: c, s: 'team', r: 'heading_or_table_header'}, {l: 8, c: c, s: 'team', r: 'heading_or_table_header'}, {l: 9, c: 'BetaY', s: 'team', r: NULL}, {l: 10, c: NULL, s: 'team', r: 'reference_listing'}, {l: 11, c: NULL, s: 'team', r: 'reference_listing'}]) AS u FROM p)""")
def report_scopes(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "AlphaX").when(k % 3 == 1, "BetaY").otherwise("AlphaXL")
    text = F.concat(F.lit("# Report\nIntro\n\n## "), name, F.lit(": Technology Assessment\nGood.\n### Team\nFive.\n| Company | Score |\n|---|---|\n| BetaY | 5 |\n## References\n[1]: https://x.org"))
    out = retrieval.scoped_markdown_units(table(spark, sf, "part").select("p_partkey", text.alias("text")), "p_partkey", "text", ["AlphaX", "BetaY"])
    return out.select("p_partkey", "line", "company_id", "section_id", "exclusion_reason")
