"""Every operator applied to the whole test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.functions import hashing, numeric, text
from ledgerlark.operators import aggregates, joins, ordered
from ledgerlark.plans import paired, quality, report, retrieval, review, samples, scoring, workflow
from ledgerlark.session import table
from ledgerlark.streaming import spans as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- scoring ----------------------------------------------------------------


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    stage = F.element_at(F.array(*map(F.lit, scoring.STAGE_WEIGHTS)), (F.col("s_nationkey") % 4 + 1).cast("int"))
    signals = {"technology": k * 3, "market": k * 7, "traction": k * 2, "team": k + 2, "competition": k * 4, "risk": k + 1}
    return table(spark, sf, "supplier").select("s_suppkey", stage.alias("stage"), *[(x % 5 + 1).cast("int").alias(f"{s}_signal") for s, x in signals.items()])


_WEIGHTS = ", ".join(f"('{s}', {', '.join(str(w[x]) for x in scoring.SIGNALS)})" for s, w in scoring.STAGE_WEIGHTS.items())
_ENTITY = f"""
WITH weights(stage, w_technology, w_market, w_traction, w_team, w_competition, w_risk) AS (VALUES {_WEIGHTS}),
e AS (SELECT s_suppkey, (['Seed', 'Series A', 'Series B', 'Series C+'])[s_nationkey % 4 + 1] AS stage, s_suppkey * 3 % 5 + 1 AS technology, s_suppkey * 7 % 5 + 1 AS market,
    s_suppkey * 2 % 5 + 1 AS traction, (s_suppkey + 2) % 5 + 1 AS team, s_suppkey * 4 % 5 + 1 AS competition, (s_suppkey + 1) % 5 + 1 AS risk FROM supplier),
p AS (SELECT e.*, greatest(1, least(5, 6 - risk)) AS risk_score, round_even((market + traction) / 2, 0) AS market_score, w.* EXCLUDE (stage) FROM e JOIN weights w USING (stage)),
parts AS (SELECT *, round(technology * w_technology * 20, 1) AS pt, round(market_score * (w_market + w_traction) * 20, 1) AS pm, round(market * w_market * 20 + traction * w_traction * 20, 1) AS pm2,
    round(team * w_team * 20, 1) AS pe, round(competition * w_competition * 20, 1) AS pc, round(risk_score * w_risk * 20, 1) AS pr FROM p),
scored AS (SELECT *, round_even(pt + pm + pe + pc + pr, 0)::INT AS final_score, round_even(pt + pm2 + pe + pc + pr, 0)::INT AS target_score FROM parts),
graded AS (SELECT *, CASE WHEN final_score >= 80 THEN 'High Priority DD' WHEN final_score >= 65 THEN 'Selective DD' WHEN final_score >= 50 THEN 'Watchlist' ELSE 'No DD' END AS grade FROM scored)
"""


@query(_ENTITY + """SELECT s_suppkey, final_score, grade, row_number() OVER (ORDER BY final_score DESC, s_suppkey) AS rank, final_score >= 65 AS passed, grade = 'Watchlist' AS watchlist,
    final_score >= 65 AND row_number() OVER (ORDER BY final_score DESC, s_suppkey) <= 3 AS top, CASE WHEN max(final_score) OVER () >= 65 THEN 'top3' ELSE 'hold' END AS branch FROM graded""")
def score_rank_top3(spark, sf):
    return scoring.rank(scoring.score(suppliers(spark, sf)), "s_suppkey").select("s_suppkey", "final_score", "grade", "rank", "passed", "watchlist", "top", "branch")


@query(_ENTITY + "SELECT s_suppkey, final_score AS baseline, target_score AS target, target_score - final_score AS change FROM graded")
def score_target_policy(spark, sf):
    e = suppliers(spark, sf)
    a, b = scoring.score(e).select("s_suppkey", F.col("final_score").alias("baseline")), scoring.score(e, scoring.TARGET).select("s_suppkey", F.col("final_score").alias("target"))
    return a.join(b, "s_suppkey").withColumn("change", F.col("target") - F.col("baseline"))


_CHECKS = ("dimension_range", "total_range", "signal_market", "risk_direction", "score_formula", "grade", *(f"contribution_{d}" for d in ("technology", "market", "team", "competition", "risk")))


# A tenth of the stored scores is one too high, a few grades and contributions are altered, and one supplier in 25 has lost its team signal.
@query(f"""WITH c AS (SELECT s_suppkey % 5 AS part, s_suppkey AS k, unnest({list(_CHECKS)}) AS check_id FROM supplier),
r AS (SELECT part, check_id, CASE WHEN check_id <> 'total_range' AND k % 25 = 7 THEN 'error' WHEN check_id = 'score_formula' AND k % 10 = 3 THEN 'fail' WHEN check_id = 'grade' AND k % 20 = 4 THEN 'fail' WHEN check_id = 'contribution_team' AND k % 15 = 0 THEN 'fail' WHEN check_id = 'risk_direction' AND k % 10 = 1 THEN 'fail' ELSE 'pass' END AS r FROM c)
SELECT part, check_id, count(*) AS n_applicable, count(*) FILTER (WHERE r = 'pass') AS n_pass, CASE WHEN count(*) FILTER (WHERE r = 'error') = 0 THEN count(*) FILTER (WHERE r = 'pass') / count(*) END AS conformance FROM r GROUP BY ALL""")
def rule_conformance(spark, sf):
    k = F.col("s_suppkey")
    stored = scoring.score(suppliers(spark, sf)).withColumns({
        "final_score": F.col("final_score") + F.when(k % 10 == 3, 1).otherwise(0),
        "grade": F.when(k % 20 == 4, "Other").otherwise(F.col("grade")),
        "team_part": F.col("team_part") + F.when(k % 15 == 0, 0.1).otherwise(0.0),
        "risk_score": F.col("risk_score") + F.when(k % 10 == 1, 1).otherwise(0),
        "team_signal": F.when(k % 25 != 7, F.col("team_signal")),
    })
    return scoring.conformance(scoring.rule_checks(stored, "s_suppkey").withColumn("part", k % 5), ["part", "check_id"])


@query("""WITH e AS (SELECT s_suppkey, (s_suppkey * 3 % 5 + s_suppkey * 7 % 5 + s_suppkey * 2 % 5 + (s_suppkey + 2) % 5 + s_suppkey * 4 % 5 + (s_suppkey + 1) % 5 + 6)::INT AS total_score FROM supplier),
r AS (SELECT s_suppkey, row_number() OVER (ORDER BY total_score DESC, s_suppkey) AS rank FROM e WHERE total_score >= 20)
SELECT e.s_suppkey, total_score, CASE WHEN rank <= 3 THEN rank END::INT AS rank, CASE WHEN rank <= 3 THEN 'selected' WHEN total_score >= 20 THEN 'hold: outside the top' ELSE 'hold: below the threshold' END AS decision FROM e LEFT JOIN r USING (s_suppkey)""")
def sum_scale_policy(spark, sf):
    return scoring.sum_scale(suppliers(spark, sf), [f"{s}_signal" for s in scoring.SIGNALS], "s_suppkey").select("s_suppkey", "total_score", "rank", "decision")


_STRONG = ("license", "token", "example.com", "with the")


@query(f"""WITH n AS (SELECT source, lang, count(*) FILTER (WHERE s) AS n_strong, count(*) FILTER (WHERE NOT s AND length(text) > 80) AS n_medium
    FROM (SELECT *, {" OR ".join(f"contains(lower(text), '{w}')" for w in _STRONG)} AS s FROM documents) GROUP BY source, lang)
SELECT source, lang, n_strong, n_medium, (CASE WHEN n_strong >= 4 THEN 5 WHEN n_strong >= 2 OR n_medium >= 4 THEN 4 WHEN n_strong >= 1 OR n_medium >= 2 THEN 3 ELSE 2 END)::INT AS signal FROM n""")
def evidence_keyword_score(spark, sf):
    docs = table(spark, sf, "documents")
    entities = docs.select("source", "lang").distinct().withColumn("fallback", F.lit(3))
    return scoring.evidence_signal(entities, docs, ["source", "lang"], "text", "fallback", _STRONG).select("source", "lang", "n_strong", "n_medium", "signal")


@query(f"""WITH e AS (SELECT DISTINCT source FROM documents), {", ".join(f"{x}_n AS (SELECT source, count(*) FILTER (WHERE s) AS a, count(*) FILTER (WHERE NOT s AND length(text) > 80) AS b, arg_min(text, doc_id) FILTER (WHERE trim(text) <> '') AS t FROM (SELECT *, {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in scoring.STRONG)} AS s FROM documents WHERE lang = '{l}') GROUP BY source)" for l, x in (("en", "team"), ("de", "market"), ("fr", "technology"), ("es", "traction")))}
SELECT source, {", ".join(f"CASE WHEN {x}_n.a IS NULL THEN 3 WHEN {x}_n.a >= 4 THEN 5 WHEN {x}_n.a >= 2 OR {x}_n.b >= 4 THEN 4 WHEN {x}_n.a >= 1 OR {x}_n.b >= 2 THEN 3 ELSE 2 END::INT AS {x}_signal, coalesce(sha256({x}_n.t), '') AS {x}_summary" for x in ("team", "market", "technology", "traction"))}
FROM e LEFT JOIN team_n USING (source) LEFT JOIN market_n USING (source) LEFT JOIN technology_n USING (source) LEFT JOIN traction_n USING (source)""")
def enrich_profile(spark, sf):
    docs = table(spark, sf, "documents").select("source", F.col("lang").alias("category"), F.col("doc_id").alias("pos"), F.col("text").alias("content"))
    signals = {"en": "team", "de": "market", "fr": "technology", "es": "traction"}
    none = {c: v for x in signals.values() for c, v in ((f"{x}_signal", F.lit(3)), (f"{x}_summary", F.lit(None).cast("string")))}
    out = workflow.enrich(docs.select("source").distinct().withColumns(none), docs, "source", signals)
    digest = lambda c: F.coalesce(F.sha2(c, 256), F.lit("")).alias(c)
    return out.select("source", *[c for x in signals.values() for c in (f"{x}_signal", digest(f"{x}_summary"))])


@query("SELECT source, lang, arg_min(text, doc_id) AS text, min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY source, lang")
def first_evidence_per_category(spark, sf):
    docs = table(spark, sf, "documents").select("source", "lang", "text", "doc_id").filter("trim(text) <> ''")
    return ordered.first_per(docs, ["source", "lang"], [F.col("doc_id")])


@query(_ENTITY + "SELECT s_suppkey::VARCHAR AS company, CASE WHEN s_suppkey % 10 = 3 THEN 'fail' ELSE 'pass' END AS result FROM graded")
def report_table_check(spark, sf):
    """Every supplier's ranking row in a Markdown report of its nation, a tenth of them altered, read back and checked."""
    ranked = scoring.rank(scoring.score(suppliers(spark, sf)), "s_suppkey").join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    shown = F.col("final_score") + F.when(F.col("s_suppkey") % 10 == 3, 1).otherwise(0)
    line = report.row_line([F.col("rank"), F.col("s_suppkey"), F.col("stage"), shown, F.col("grade")])
    head = "| " + " | ".join(report.HEADER) + " |\n|" + " --- |" * len(report.HEADER) + "\n"
    lines = ranked.select("s_nationkey", F.struct("rank", line.alias("line")).alias("x")).groupBy("s_nationkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    reports = lines.select("s_nationkey", F.concat(F.lit("# Report\n\n" + head), F.array_join(F.transform("xs", lambda x: x["line"]), "\n")).alias("text"))
    return report.check_tables(reports, "s_nationkey", "text", ranked, "s_suppkey").select("company", "result")


# --- references and sources ---------------------------------------------------

_HOST = "replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'www.', '')"
_TITLE = "concat('Report ', page_id % 40, ' of ', 2000 + page_id % 25)"


@query(f"""WITH r AS (SELECT page_id, url, {_TITLE} AS title, {_HOST} AS h FROM pages),
o AS (SELECT *, array_to_string(list_transform(string_split(replace(string_split(h, '.')[1], '-', ' '), ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') AS org,
    CASE WHEN regexp_matches(title, '20\\d\\d') THEN regexp_extract(title || ' ' || url, '20\\d\\d') ELSE coalesce(nullif(regexp_extract(title || ' ' || url, '20\\d\\d'), ''), 'n.d.') END AS y FROM r),
f AS (SELECT page_id, concat('- ', org, '(', y, '). ', title, '. ', org, '. ', url) AS formatted FROM o)
SELECT formatted, min(page_id) AS page_id, '기관 보고서' AS kind FROM f GROUP BY formatted""")
def reference_dedup_format(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.expr(_TITLE).alias("title"))
    formatted = pages.select("page_id", text.format_reference(F.concat_ws(" - ", "title", "url")).alias("formatted"), text.reference_kind(F.col("title"), F.col("url")).alias("kind"))
    return ordered.first_per(formatted, ["formatted"], [F.col("page_id")]).select("formatted", "page_id", "kind")


_BLOCKED = ("example.net", "medium.com")


@query(f"SELECT {_HOST} AS host, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM pages WHERE url <> '' AND NOT ({' OR '.join(f'ends_with({_HOST}, {chr(39)}{b}{chr(39)})' for b in _BLOCKED)}) GROUP BY 1")
def blocked_domain_filter(spark, sf):
    p = table(spark, sf, "pages").filter("url <> ''").select(text.host(F.col("url")).alias("host"), "page_id", "url")
    p = p.filter(~F.exists(F.array(*map(F.lit, _BLOCKED)), lambda d: F.endswith("host", d)))
    return ordered.first_per(p, ["host"], [F.col("page_id")])


@query(r"SELECT page_id, len(regexp_extract_all(html, '(\[SOURCE:[^\]]+\]|\[\d+\]|https?://[^\s)\]]+)'))::INT AS n_markers, len(list_distinct(regexp_extract_all(html, '(\[SOURCE:[^\]]+\]|\[\d+\]|https?://[^\s)\]]+)')))::INT AS n_distinct FROM pages")
def citation_markers(spark, sf):
    m = text.markers(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(m).alias("n_markers"), F.size(F.array_distinct(m)).alias("n_distinct"))


@query("""WITH a AS (SELECT page_id, url AS alias FROM pages UNION SELECT page_id, concat('[SOURCE:', page_id, ']') FROM pages),
c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat('[SOURCE:', conv_id, ']') ELSE concat('[SOURCE:x', conv_id, ']') END AS marker FROM conversations)
SELECT conv_id, turn, coalesce(page_id::VARCHAR, concat('unresolved:', marker)) AS source FROM c LEFT JOIN a ON alias = marker""")
def citation_resolution(spark, sf):
    pages = table(spark, sf, "pages").withColumn("cite", F.format_string("[SOURCE:%d]", "page_id"))
    known = joins.aliases(pages, ["url", "cite"], "page_id")
    marker = F.when(F.col("turn") % 2 == 0, F.format_string("[SOURCE:%d]", "conv_id")).otherwise(F.format_string("[SOURCE:x%d]", "conv_id"))
    cited = table(spark, sf, "conversations").select("conv_id", "turn", marker.alias("marker"))
    return cited.join(known, F.col("alias") == F.col("marker"), "left").select("conv_id", "turn", F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("unresolved:"), "marker")).alias("source"))


# --- joins --------------------------------------------------------------------

# A fact is dated a day before, on, or a day after the sample's date, so the two rules tell them apart.
_AS_OF = "DATE '1996-06-30' + (c_custkey % 500)::INT"
_ASOF = f"""WITH j AS (SELECT c_custkey AS sample_id, o_orderkey AS f, coalesce(o_orderstatus = 'F' AND {{0}}, false) AS ok FROM customer LEFT JOIN orders ON o_custkey = c_custkey)
SELECT sample_id, list_sort(coalesce(list(f) FILTER (WHERE ok), [])) AS facts, list_sort(coalesce(list(f) FILTER (WHERE NOT ok AND f IS NOT NULL), [])) AS excluded FROM j GROUP BY sample_id"""


def _facts(spark, sf, exact):
    as_of = lambda c: f"date_add(DATE '1996-06-30', cast({c} % 500 as int))"
    samples = table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_custkey").alias("k"), F.expr(as_of("c_custkey")).alias("as_of_date"))
    dated = F.expr(f"date_add({as_of('o_custkey')}, cast(o_orderkey % 3 - 1 as int))")
    facts = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("fact_id"), dated.alias("fact_date"), F.to_date("o_orderdate").alias("source_date"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("pending").alias("review_status"))
    return quality.eligible_facts(samples, facts, ["k"], exact)


@query(_ASOF.format("o_orderkey % 3 <= 1"))
def asof_fact_join(spark, sf):
    return _facts(spark, sf, False)


@query(_ASOF.format(f"o_orderkey % 3 = 1 AND o_orderdate::DATE <= {_AS_OF}"))
def exact_date_fact_join(spark, sf):
    return _facts(spark, sf, True)


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts AS view_ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT p.event_id, p.user_id, p.ts, v.view_ts, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.view_ts""")
def asof_latest_before(spark, sf):
    e = table(spark, sf, "events")
    views = e.filter("event_type = 'view'").groupBy("user_id", F.col("ts").alias("view_ts")).agg(F.max("event_id").alias("view_id"))
    return ordered.latest_before(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "view_ts", ["view_id"], bucket=lambda t: F.date_trunc("day", t))


@query("""WITH g AS (SELECT event_id % 2 AS side, user_id, event_type, count(*) AS n, avg(value) AS v FROM events GROUP BY ALL), b AS (SELECT * FROM g WHERE side = 0), a AS (SELECT * FROM g WHERE side = 1)
SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type, CASE WHEN b.n IS NOT NULL AND a.n IS NOT NULL THEN 'paired' ELSE 'unpaired' END AS pair_status,
    a.n - b.n AS d_count, round((a.v - b.v) * 100, 6) AS d_value, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'incomplete' WHEN a.n < b.n OR a.v < b.v THEN 'regressed' WHEN a.n > b.n OR a.v > b.v THEN 'improved' ELSE 'unchanged' END AS verdict
FROM b FULL JOIN a ON b.user_id IS NOT DISTINCT FROM a.user_id AND b.event_type IS NOT DISTINCT FROM a.event_type""")
def paired_full_outer(spark, sf):
    r = _report(spark, sf)
    return r.select("user_id", "event_type", "pair_status", F.col("delta_count").cast("long").alias("d_count"), F.round("delta_value", 6).alias("d_value"), "verdict")


def _report(spark, sf):
    e = table(spark, sf, "events")
    side = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("value"))
    return paired.report(side(0), side(1), ["user_id", "event_type"], ["count", "value"], [True, True])


@query("""WITH g AS (SELECT event_id % 2 AS side, user_id, event_type, count(*)::DOUBLE AS n, avg(value) AS v FROM events GROUP BY ALL), b AS (SELECT * FROM g WHERE side = 0), a AS (SELECT * FROM g WHERE side = 1),
p AS (SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type, b.n AS bn, a.n AS an, b.v AS bv, a.v AS av FROM b FULL JOIN a USING (user_id, event_type))
SELECT user_id, event_type, 'count' AS metric, bn AS before, an AS after FROM p UNION ALL SELECT user_id, event_type, 'value', round(bv, 6), round(av, 6) FROM p""")
def paired_long(spark, sf):
    return paired.long(_report(spark, sf), ["user_id", "event_type"], ["count", "value"]).select("user_id", "event_type", "metric", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query("""WITH m AS (SELECT 'order' AS rule, l_orderkey::VARCHAR AS row, l_orderkey::VARCHAR AS value FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'customer', o_orderkey::VARCHAR, o_custkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'document', doc_id::VARCHAR, doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'nation', s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)) SELECT * FROM m""")
def referential_violations(spark, sf):
    t = lambda n: table(spark, sf, n)
    out = joins.missing(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey", "order", "l_orderkey")
    for child, parent, ck, pk, rule, ident in (("orders", "customer", "o_custkey", "c_custkey", "customer", "o_orderkey"), ("documents", "labels", "doc_id", "doc_id", "document", "doc_id"), ("supplier", "nation", "s_nationkey", "n_nationkey", "nation", "s_suppkey")):
        out = out.unionByName(joins.missing(t(child), t(parent), ck, pk, rule, ident))
    return out


@query("""SELECT 'lineitem' AS "table", concat(l_orderkey, '/', l_linenumber) AS row, unnest(list_filter([CASE WHEN NOT coalesce(l_discount <= 0.05, false) THEN 'discount' END, CASE WHEN NOT coalesce(l_quantity BETWEEN 1 AND 40, false) THEN 'quantity' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem""")
def invariant_violations(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("id", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    return joins.violations(li, "lineitem", "id", {"discount": "l_discount <= 0.05", "quantity": "l_quantity between 1 and 40"})


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def substring_lineage(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("needle"))
    return joins.contained(b, table(spark, sf, "documents").select("doc_id", "text"), "needle", "text").select("doc_id", "item_id")


@query("""WITH RECURSIVE up(c, t, a, depth) AS (SELECT conv_id, turn, turn - 1, 1 FROM conversations WHERE turn > 0 UNION ALL SELECT u.c, u.t, u.a - 1, u.depth + 1 FROM up u WHERE u.a > 0)
SELECT concat(c, '/', t) AS node, count(*) AS n_ancestors, max(depth) AS depth FROM up GROUP BY 1""")
def lineage_recursive(spark, sf):
    node = lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    edges = table(spark, sf, "conversations").select(node(F.col("turn")).alias("c"), F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("p"))
    return joins.ancestors(edges, "c", "p").groupBy("node").agg(F.count(F.lit(1)).alias("n_ancestors"), F.max("depth").alias("depth"))


@query("""WITH RECURSIVE up(c, t, a) AS (SELECT conv_id, turn, turn FROM conversations UNION ALL SELECT c, t, a - 1 FROM up WHERE a > 0),
r AS (SELECT u.c, u.t, u.a, CASE WHEN x.turn % 5 = 4 THEN '' WHEN x.turn % 3 = 0 THEN 'planner' END AS role FROM up u JOIN conversations x ON x.conv_id = u.c AND x.turn = u.a)
SELECT concat(c, '/', t) AS node, nullif(arg_max(role, a) FILTER (WHERE role IS NOT NULL), '') AS role FROM r GROUP BY c, t""")
def nearest_role(spark, sf):
    node = lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    operation = F.when(F.col("turn") % 5 == 4, "stop.x").when(F.col("turn") % 3 == 0, "plan.start").otherwise("other.y")
    calls = table(spark, sf, "conversations").select(node(F.col("turn")).alias("node"), F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("parent_id"), operation.alias("operation"))
    return workflow.nearest_role(calls.withColumnRenamed("node", "invocation_id"), {"plan": "planner", "stop": None}).withColumnRenamed("invocation_id", "node")


@query("""SELECT l_suppkey, l_returnflag, n_left, n_right, least(n_left, n_right) AS n_common, greatest(n_left - n_right, 0) AS n_missing, greatest(n_right - n_left, 0) AS n_extra FROM
    (SELECT l_suppkey, l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS n_left, count(*) FILTER (WHERE l_linestatus = 'F') AS n_right FROM lineitem GROUP BY ALL) WHERE n_left + n_right > 0""")
def multiset_compare(spark, sf):
    li = table(spark, sf, "lineitem")
    return joins.multiset(li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'F'"), ["l_suppkey"], "l_returnflag")


@query("""WITH b AS (SELECT n_nationkey AS k, sha256(n_name) AS h FROM nation WHERE n_nationkey <> 4), a AS (SELECT n_nationkey AS k, sha256(CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END) AS h FROM nation WHERE n_nationkey <> 7)
SELECT coalesce(b.k, a.k) AS n_nationkey, b.h AS before_hash, a.h AS after_hash, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (k) WHERE b.h IS DISTINCT FROM a.h""")
def inventory_diff(spark, sf):
    n = table(spark, sf, "nation")
    before = n.filter("n_nationkey <> 4").select("n_nationkey", hashing.sha256(F.col("n_name")).alias("hash"))
    after = n.filter("n_nationkey <> 7").select("n_nationkey", hashing.sha256(F.when(F.col("n_regionkey") == 1, F.lower("n_name")).otherwise(F.col("n_name"))).alias("hash"))
    return joins.table_diff(before, after, "n_nationkey", "hash")


@query("""SELECT c.conv_id, r.role, count(x.role) AS n_turns, count(x.role) > 0 AS covered FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (VALUES ('system'), ('user'), ('assistant')) r(role)
LEFT JOIN conversations x ON x.conv_id = c.conv_id AND x.role = r.role GROUP BY c.conv_id, r.role""")
def required_step_cover(spark, sf):
    c = table(spark, sf, "conversations")
    steps = spark.createDataFrame([("system",), ("user",), ("assistant",)], "role string")
    n = c.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    out = workflow.step_coverage(c, steps, c, "conv_id", "role").join(n, ["conv_id", "role"], "left")
    return out.select("conv_id", "role", F.coalesce("n", F.lit(0)).alias("n_turns"), "covered")


# --- aggregates ---------------------------------------------------------------


def _claims(spark, sf):
    v = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "R", "contradicted").when(F.col("l_quantity") > 2, "unverifiable")
    return table(spark, sf, "lineitem").select("l_suppkey", "l_linestatus", v.alias("verdict"), (F.col("l_linenumber") == 1).alias("critical"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("claim_id"))


@query("""WITH c AS (SELECT l_suppkey, l_linestatus, CASE WHEN l_returnflag = 'A' THEN 'verified' WHEN l_returnflag = 'R' THEN 'contradicted' WHEN l_quantity > 2 THEN 'unverifiable' END AS v, l_linenumber = 1 AS crit, concat(l_orderkey, '/', l_linenumber) AS id FROM lineitem)
SELECT CASE grouping_id(l_suppkey, l_linestatus) WHEN 0 THEN 'supplier and status' WHEN 1 THEN 'supplier' WHEN 2 THEN 'status' ELSE 'all' END AS scope, l_suppkey, l_linestatus, count(*) AS n_claims, count(v) AS n_judged, count(*) - count(v) AS n_pending,
    count(*) FILTER (WHERE v = 'verified') AS n_verified, count(*) FILTER (WHERE v = 'contradicted') AS n_contradicted, count(*) FILTER (WHERE v = 'contradicted' AND crit) AS n_critical_contradicted,
    CASE WHEN count(v) = count(*) THEN round(count(*) FILTER (WHERE v = 'verified') / count(*), 9) END AS rate_verified,
    sha256(coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE v = 'unverifiable' AND crit), '')) AS ids_critical_unverifiable
FROM c GROUP BY GROUPING SETS ((l_suppkey, l_linestatus), (l_suppkey), (l_linestatus), ())""")
def three_state_rollup(spark, sf):
    out = aggregates.three_state_rollup(_claims(spark, sf), [("l_suppkey", "l_linestatus"), ("l_suppkey",), ("l_linestatus",), ()], ["supplier and status", "supplier", "status", "all"])
    return out.select("scope", "l_suppkey", "l_linestatus", "n_claims", "n_judged", "n_pending", "n_verified", "n_contradicted", "n_critical_contradicted", F.round("rate_verified", 9).alias("rate_verified"), F.sha2(F.array_join("ids_critical_unverifiable", ","), 256).alias("ids_critical_unverifiable"))


_ITEMS = """WITH s AS (SELECT conv_id, role, role <> 'system' AS applicable, CASE WHEN length(text) > 10 THEN 'completed' ELSE 'pending' END AS status,
    CASE length(text) % 3 WHEN 0 THEN 'fulfilled' WHEN 1 THEN 'missing' ELSE CASE WHEN length(text) > 600 THEN 'incorrect' ELSE 'missing' END END AS verdict FROM conversations),
f AS (SELECT conv_id, role, CASE WHEN bool_and(NOT applicable) THEN 'not_applicable' WHEN bool_or(status <> 'completed') THEN 'unjudged' WHEN bool_or(verdict = 'incorrect') THEN 'incorrect' WHEN bool_or(verdict = 'fulfilled') THEN 'fulfilled' ELSE 'missing' END AS state FROM s GROUP BY ALL)
"""


def _items(spark, sf):
    n = F.length("text")
    verdict = F.when(n % 3 == 0, "fulfilled").when((n % 3 == 2) & (n > 600), "incorrect").otherwise("missing")
    s = table(spark, sf, "conversations").select("conv_id", "role", (F.col("role") != "system").alias("applicable"), F.when(n > 10, "completed").otherwise("pending").alias("status"), verdict.alias("verdict"))
    return s.groupBy("conv_id", "role").agg(aggregates.item_state().alias("state"))


@query(_ITEMS + "SELECT * FROM f")
def coverage_state_fold(spark, sf):
    return _items(spark, sf)


@query(_ITEMS + """, e AS (SELECT DISTINCT conv_id, r.role, r.role <> 'system' AS applicable FROM conversations, (VALUES ('system'), ('user'), ('assistant')) r(role)),
a AS (SELECT conv_id, role, state FROM f UNION ALL SELECT conv_id, role, CASE WHEN applicable THEN 'unjudged' ELSE 'not_applicable' END FROM e ANTI JOIN f USING (conv_id, role))
SELECT conv_id, count(*) FILTER (WHERE state <> 'not_applicable') AS n_items, count(*) FILTER (WHERE state = 'fulfilled') AS n_fulfilled, count(*) FILTER (WHERE state = 'missing') AS n_missing, count(*) FILTER (WHERE state = 'incorrect') AS n_incorrect,
    count(*) FILTER (WHERE state = 'unjudged') AS n_unjudged, CASE WHEN count(*) FILTER (WHERE state = 'unjudged') = 0 AND count(*) FILTER (WHERE state <> 'not_applicable') > 0 THEN round(count(*) FILTER (WHERE state = 'fulfilled') / count(*) FILTER (WHERE state <> 'not_applicable'), 9) END AS coverage FROM a GROUP BY conv_id""")
def coverage_rollup(spark, sf):
    items = _items(spark, sf).withColumnRenamed("role", "item_id")
    expected = table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(*map(F.lit, ("system", "user", "assistant")))).alias("item_id")).withColumn("applicable", F.col("item_id") != "system")
    return quality.coverage(items, expected, ["conv_id"]).withColumn("coverage", F.round("coverage", 9))


@query("""WITH u AS (SELECT l_linestatus, l_suppkey, avg((l_returnflag = 'R')::INT) AS m, count(*) FILTER (WHERE l_returnflag = 'R') AS p, count(*) AS w, bool_and(l_quantity > 0) AS ok FROM lineitem GROUP BY ALL)
SELECT l_linestatus, round(avg(m), 9) AS macro, CASE WHEN bool_and(ok) THEN round(sum(p) / sum(w), 9) END AS micro, count(*) AS n_units, round(max(w) / sum(w), 9) AS share_max, max(w) / sum(w) > 0.5 AND count(*) > 1 AS concentrated FROM u GROUP BY 1""")
def macro_micro(spark, sf):
    r = (F.col("l_returnflag") == "R").cast("int")
    li = table(spark, sf, "lineitem").select("l_linestatus", "l_suppkey", r.alias("score"), r.alias("part"), F.lit(1).alias("whole"), (F.col("l_quantity") > 0).alias("ok"))
    out = aggregates.macro_micro(li, ["l_linestatus"], ["l_suppkey"], "score", "part", "whole", "ok")
    return out.withColumns({c: F.round(c, 9) for c in ("macro", "micro", "share_max")})


@query("""WITH r AS (SELECT event_type AS purpose, CASE WHEN value > 30 THEN 'completed' ELSE 'error' END AS status, CASE user_id % 3 WHEN 0 THEN 'warm' WHEN 1 THEN 'cold' ELSE 'unknown' END AS cache_state, user_id % 2 = 0 AS fallback_used,
    CASE WHEN user_id % 7 <> 0 THEN 'USD' END AS currency, CASE WHEN user_id % 7 = 0 THEN 'unknown' ELSE 'v1' END AS price_version, sha256((user_id % 2)::VARCHAR) AS commit_sha, CASE WHEN user_id % 2 = 0 THEN sha256('s') END AS settings_sha256,
    CASE WHEN event_type = 'view' THEN 'replay' ELSE 'live' END AS execution_path, NULL::VARCHAR AS evaluator_sha256, CASE WHEN event_id % 17 <> 0 THEN value END AS duration_seconds, CASE WHEN user_id % 7 <> 0 THEN value * 2 END AS cost FROM events)
SELECT purpose, status, cache_state, fallback_used, currency, price_version, commit_sha, settings_sha256, execution_path, evaluator_sha256, count(*) AS repetitions, count(duration_seconds) AS observed_duration_count, median(duration_seconds) AS median_seconds,
    CASE WHEN count(duration_seconds) >= 20 THEN list_sort(list(duration_seconds) FILTER (WHERE duration_seconds IS NOT NULL))[(count(duration_seconds) * 95 + 99) // 100] END AS p95_seconds, count(cost) AS known_cost_count, CASE WHEN count(cost) = count(*) THEN median(cost) END AS median_cost FROM r GROUP BY ALL""")
def runtime_groups(spark, sf):
    u = F.col("user_id")
    priced = u % 7 != 0
    runs = table(spark, sf, "events").select(
        F.col("event_type").alias("purpose"),
        F.when(F.col("value") > 30, "completed").otherwise("error").alias("status"),
        F.when(u % 3 == 0, "warm").when(u % 3 == 1, "cold").otherwise("unknown").alias("cache_state"),
        (u % 2 == 0).alias("fallback_used"),
        F.when(priced, "USD").alias("currency"),
        F.when(priced, "v1").otherwise("unknown").alias("price_version"),
        hashing.sha256((u % 2).cast("string")).alias("commit_sha"),
        F.when(u % 2 == 0, hashing.sha256(F.lit("s"))).alias("settings_sha256"),
        F.when(F.col("event_type") == "view", "replay").otherwise("live").alias("execution_path"),
        F.lit(None).cast("string").alias("evaluator_sha256"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("duration_seconds"),
        F.when(priced, F.col("value") * 2).alias("cost"),
    )
    return paired.runtime_groups(runs)


@query("""WITH c AS (SELECT q.x AS quality, t.x AS toxic, count(l.doc_id) AS n FROM (VALUES (0), (1)) q(x) CROSS JOIN (VALUES (0), (1)) t(x) LEFT JOIN labels l ON l.quality = q.x AND l.toxic = t.x GROUP BY ALL)
SELECT quality, toxic, n, (sum(n) OVER (PARTITION BY quality))::BIGINT AS support, CASE WHEN quality = toxic THEN n / nullif(sum(n) OVER (PARTITION BY quality), 0) END AS recall, CASE WHEN quality = toxic THEN n / nullif(sum(n) OVER (PARTITION BY toxic), 0) END AS precision FROM c""")
def confusion_matrix(spark, sf):
    return aggregates.confusion(table(spark, sf, "labels").select(F.col("quality").cast("int"), F.col("toxic").cast("int")), "quality", "toxic", [0, 1])


@query("""WITH t AS (SELECT event_type, user_id, value, (props->>'$.k')::INT AS k FROM events), c AS (SELECT event_type, CASE WHEN k % 5 = 0 THEN true WHEN k % 5 < 3 THEN false END AS hit,
    CASE WHEN k % 5 = 0 THEN 0.0 WHEN event_type = 'view' THEN 0.01 WHEN event_type = 'error' THEN NULL ELSE ((100 * k - k) * 2.0 + k * 0.5 + 10 * k * 8.0) / 1e6 END AS cost FROM t)
SELECT event_type, count(*) AS n, count(cost) AS n_known, CASE WHEN count(cost) = count(*) THEN round(sum(cost), 6) END AS total, CASE WHEN bool_or(hit) AND NOT bool_and(hit) THEN 'mixed' WHEN bool_and(hit) THEN 'warm' WHEN NOT bool_or(hit) THEN 'cold' ELSE 'unknown' END AS cache_state FROM c GROUP BY 1""")
def cost_rollup(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").withColumn("k", k)
    k = F.col("k")
    kind = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") != "error", "llm")
    lit = F.lit
    c = numeric.cost(k % 5 == 0, lit("remote"), kind, lit(True), lit(0.01), k * 100, k, k * 10, lit(2.0), lit(0.5), lit(8.0))
    e = e.select("event_type", c.alias("cost"), F.when(k % 5 == 0, True).when(k % 5 < 3, False).alias("hit"))
    return e.groupBy("event_type").agg(F.count(lit(1)).alias("n"), F.count("cost").alias("n_known"), F.round(aggregates.known_sum(F.col("cost"), lit("USD")), 6).alias("total"), aggregates.cache_state(F.col("hit")).alias("cache_state"))


@query("""SELECT event_type AS data_mode, count(*) AS n_attempts, count(*) FILTER (WHERE value > 50) AS n_succeeded, round(avg(coalesce(value > 50, false)::INT), 9) AS success_rate FROM events GROUP BY 1""")
def campaign_success(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("data_mode"), (F.col("value") > 50).alias("succeeded"))
    return paired.campaign(e).withColumn("success_rate", F.round("success_rate", 9))


@query("""WITH c AS (SELECT l_orderkey AS claim_id, l_linenumber AS f, CASE WHEN l_discount > 0.09 THEN 'error' WHEN l_returnflag = 'A' THEN 'supports' WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'insufficient' END AS r FROM lineitem)
SELECT claim_id, CASE WHEN bool_or(r = 'error') THEN NULL WHEN bool_or(r = 'supports') = bool_or(r = 'contradicts') THEN 'unverifiable' WHEN bool_or(r = 'supports') THEN 'verified' ELSE 'contradicted' END AS verdict,
    CASE WHEN bool_or(r = 'error') THEN 'error' ELSE 'completed' END AS status, list_sort(coalesce(list(f) FILTER (WHERE r IN ('supports', 'contradicts')), [])) AS selected, bool_or(r = 'supports') AND bool_or(r = 'contradicts') AS conflict FROM c GROUP BY 1""")
def verdict_policy(spark, sf):
    r = F.when(F.col("l_discount") > 0.09, "error").when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "contradicts").otherwise("insufficient")
    return quality.verdicts(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("fact_id"), r.alias("relation")))


_SAMPLES = """s AS (SELECT concat(conv_id, '/', turn) AS sample_id, role AS user_input, text AS response, CASE turn % 4 WHEN 1 THEN '' WHEN 2 THEN text WHEN 3 THEN concat(text, '.') END AS reference,
    CASE turn % 3 WHEN 0 THEN [text] WHEN 1 THEN [' '] END AS ctx, CASE WHEN turn % 2 = 0 THEN 'i' END AS inv, CASE WHEN role = 'system' THEN ['faithfulness'] ELSE ['factual_precision', 'factual_recall', 'faithfulness', 'context_recall', 'context_precision'] END AS sup FROM conversations WHERE length(text) > 5)"""


def _samples(spark, sf):
    t = F.col("turn")
    every = F.array(*map(F.lit, samples.REQUIRED))
    return table(spark, sf, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string")).alias("sample_id"), F.col("role").alias("user_input"), F.col("text").alias("response"), F.when(t % 4 == 1, "").when(t % 4 == 2, F.col("text")).when(t % 4 == 3, F.concat("text", F.lit("."))).alias("reference"),
        F.when(t % 3 == 0, F.array("text")).when(t % 3 == 1, F.array(F.lit(" "))).alias("retrieved_contexts"), F.when(t % 2 == 0, "i").alias("invocation_id"), F.when(F.length("text") > 5, "pending").otherwise("error").alias("evaluation_status"), F.when(F.col("role") == "system", F.array(F.lit("faithfulness"))).otherwise(every).alias("supported"),
    )


@query(f"""WITH {_SAMPLES}, c AS (SELECT *, CASE WHEN user_input IS NULL THEN 'missing' WHEN trim(user_input) = '' THEN 'not_applicable' END AS pu, CASE WHEN response IS NULL THEN 'missing' WHEN trim(response) = '' THEN 'not_applicable' END AS pr,
    CASE WHEN reference IS NULL THEN 'missing' WHEN trim(reference) = '' THEN 'not_applicable' END AS pf, CASE WHEN ctx IS NULL THEN 'missing' WHEN len(list_filter(ctx, lambda x: trim(x) <> '')) = 0 THEN 'not_applicable' END AS pc, CASE WHEN inv IS NULL THEN 'missing' END AS pi FROM s),
m AS (SELECT sample_id, sup, unnest([{{'n': 'factual_precision', 'p': coalesce(pr, pf)}}, {{'n': 'factual_recall', 'p': coalesce(pr, pf)}}, {{'n': 'faithfulness', 'p': coalesce(pu, pr, pc)}}, {{'n': 'context_recall', 'p': coalesce(pu, pf, pc, pi)}}, {{'n': 'context_precision', 'p': coalesce(pu, pf, pc, pi)}}]) AS x FROM c)
SELECT sample_id, x.n AS metric_name, CASE WHEN NOT list_contains(sup, x.n) THEN 'unsupported' ELSE coalesce(x.p, 'pending') END AS status FROM m""")
def metric_inputs(spark, sf):
    return samples.metric_inputs(_samples(spark, sf))


@query("""WITH p AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' AND l_discount > 0.08 THEN 'error' WHEN l_returnflag = 'A' THEN 'not_applicable' ELSE 'completed' END AS st FROM lineitem)
SELECT o_orderkey AS sample_id, coalesce(c, true) AS complete FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(st <> 'error') AS c FROM p GROUP BY 1) ON l_orderkey = o_orderkey""")
def sample_completeness(spark, sf):
    status = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08), "error").when(F.col("l_returnflag") == "A", "not_applicable").otherwise("completed")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), "l_linenumber", status.alias("status"))
    return samples.completeness(table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id")), [li.filter("l_linenumber <= 3"), li.filter("l_linenumber > 3")])


# --- ordered ------------------------------------------------------------------


@query("""SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(concat('seed-7', doc_id)), doc_id) AS n FROM documents) WHERE n <= 5""")
def stratified_hash_sample(spark, sf):
    return review.plan(table(spark, sf, "documents").select("lang", "source", "doc_id"), ["lang"], "source", "doc_id", 5, "seed-7")


def _reviews(spark, sf):
    kind = F.when(F.col("value") > 110, "adjudicated").when(F.col("value") > 30, "confirmed").otherwise("proposed")
    return table(spark, sf, "events").select(F.col("user_id").alias("target_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("reviewer"), kind.alias("kind"), F.floor(F.col("value") / 40).cast("int").alias("label"))


@query("""WITH r AS (SELECT user_id AS t, event_id AS s, event_type AS v, CASE WHEN value > 110 THEN 'adjudicated' WHEN value > 30 THEN 'confirmed' ELSE 'proposed' END AS k, floor(value / 40)::INT AS l FROM events),
m AS (SELECT *, max(s) FILTER (WHERE k = 'adjudicated') OVER (PARTITION BY t) AS adj, max(s) OVER (PARTITION BY t) AS fin FROM r),
o AS (SELECT t, v, arg_max(k, s) AS k, arg_max(l, s) AS l FROM m WHERE (adj IS NULL OR adj < fin) AND (adj IS NULL OR s > adj) GROUP BY t, v),
p AS (SELECT t, count(DISTINCT l) FILTER (WHERE k = 'confirmed') AS n, min(l) FILTER (WHERE k = 'confirmed') AS l, count(*) FILTER (WHERE k = 'confirmed') AS c FROM o GROUP BY t)
SELECT t AS target_id, 'adjudicated' AS state, l AS label, 1 AS n_opinions FROM m WHERE adj = fin AND s = fin
UNION ALL SELECT t, CASE WHEN n = 0 THEN 'pending' WHEN n > 1 THEN 'conflict' ELSE 'confirmed' END, CASE WHEN n = 1 THEN l END, c::INT FROM p""")
def latest_per_reviewer(spark, sf):
    return review.final_opinions(_reviews(spark, sf))


@query("""WITH l AS (SELECT doc_id, unnest(ls) AS content, generate_subscripts(ls, 1) - 1 AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT *, regexp_matches(content, '^\\s*\\|') AS tab, CASE WHEN regexp_matches(content, '^#{1,6}\\s') THEN 'heading' WHEN regexp_matches(content, '^\\s*\\|[\\s:|-]+$') THEN 'separator' WHEN regexp_matches(content, '^\\s*\\|') THEN 'table' WHEN trim(content) = '' THEN 'blank' ELSE 'text' END AS kind,
    coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT doc_id, line::INT AS line, kind, start::BIGINT AS start, (start + length(content))::BIGINT AS "end", sha256(content) AS content, last_value(CASE WHEN kind = 'heading' THEN regexp_replace(content, '^#{1,6}\\s+', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS heading FROM k""".replace("\\\\", "\\"))
def markdown_heading_carry(spark, sf):
    u = retrieval.markdown_units(table(spark, sf, "documents"), "doc_id", "text")
    return u.select("doc_id", "line", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.sha2("content", 256).alias("content"), "heading")


@query("""SELECT sha256(concat(source, chr(10), text)) AS evidence_id, min(doc_id) AS doc_id, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs, count(*) AS n FROM documents GROUP BY 1""")
def content_dedup(spark, sf):
    out = ordered.same_content(table(spark, sf, "documents"), hashing.evidence_id(F.col("source"), F.col("text")), "evidence_id", "doc_id", "lang")
    return out.select("evidence_id", "doc_id", F.array_join("langs", ",").alias("langs"), "n")


@query(r"""SELECT role, rtrim(regexp_replace(trim(text), '\s+', ' ', 'g'), '.。') AS statement, arg_min(text, conv_id * 1000 + turn) AS text, list(conv_id ORDER BY conv_id * 1000 + turn) AS places, bool_or(turn = 0) AS critical FROM conversations GROUP BY 1, 2""")
def claim_dedup(spark, sf):
    c = table(spark, sf, "conversations").select("role", text.normal_statement(F.col("text")).alias("statement"), "text", "conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), (F.col("turn") == 0).alias("critical"))
    return ordered.merge_occurrences(c, ["role", "statement"], "pos", "text", "conv_id", "critical")


@query("""SELECT conv_id, turn, prev, lag(turn) OVER w AS expected FROM (SELECT *, CASE WHEN turn % 7 = 3 THEN turn - 2 WHEN turn > 0 THEN turn - 1 END AS prev FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY prev IS DISTINCT FROM lag(turn) OVER w""")
def revision_chain(spark, sf):
    t = F.col("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(t % 7 == 3, t - 2).when(t > 0, t - 1).alias("prev"))
    c = c.withColumn("expected", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    return ordered.chain_breaks(c, ["conv_id"], "turn", "turn", "prev", "turn")


@query("""SELECT claim_id, CASE WHEN len(ks) > 0 THEN list_reduce(list_prepend('unknown', ks), lambda a, k: CASE WHEN a = 'unknown' OR a = k THEN k ELSE 'unknown' END) WHEN up THEN 'new' ELSE 'unknown' END AS lineage FROM
    (SELECT l_orderkey AS claim_id, coalesce(list(CASE WHEN l_returnflag = 'A' THEN 'inherited' WHEN l_linestatus = 'O' THEN 'corrected' ELSE 'unknown' END ORDER BY l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'inherited' WHEN l_linestatus = 'O' THEN 'corrected' ELSE 'unknown' END) FILTER (WHERE l_quantity > 10), []) AS ks, bool_or(l_quantity > 5) AS up FROM lineitem GROUP BY 1)""")
def claim_lineage(spark, sf):
    upstream = F.when(F.col("l_quantity") > 10, F.when(F.col("l_returnflag") == "A", "x").otherwise("y"))
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("position"), F.lit("x").alias("text"), upstream.alias("upstream_text"), (F.col("l_linestatus") == "O").alias("is_reference"), (F.col("l_quantity") > 5).alias("has_upstream"))
    return review.lineage_class(p)


# --- text ---------------------------------------------------------------------


@query(r"""SELECT doc_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)\d') THEN 'number' END, CASE WHEN regexp_matches(text, '(?i)원|억|달러|USD|KRW|\$|€') THEN 'currency' END, CASE WHEN regexp_matches(text, '(?i)TOPS|TFLOPS|\bW\b|와트|nm|나노|배|%') THEN 'unit' END,
    CASE WHEN regexp_matches(text, '(?i)\d{4}년|\d{4}-\d{2}|\d+월|분기') THEN 'date' END, CASE WHEN regexp_matches(text, '(?i)INT8|FP16|NPU|GPU|HBM|ResNet|TOPS|TFLOPS|공정|반도체') THEN 'technology' END, CASE WHEN regexp_matches(text, '(?i)PoC|계약|양산|검증|유료|고객') THEN 'commercial_status' END], lambda x: x IS NOT NULL), ','), ''), 'other') AS strata FROM documents""")
def strata_tagging(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.strata(F.col("text")), ",").alias("strata"))


@query(r"""SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::INT AS n_latin FROM documents""")
def slug_and_script(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"), text.letters(F.col("text"), "latin").alias("n_latin"))


_PHRASES = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN concat('USD ', p_size, ' million') WHEN 1 THEN concat(p_size, '%') WHEN 2 THEN concat('약 ', p_size, '배') WHEN 3 THEN concat('USD ', p_size, ' million 이상') WHEN 4 THEN concat(p_size, '억 4천만 원')
    WHEN 5 THEN concat(p_size, ' TOPS') WHEN 6 THEN concat('at most ', p_size, '%') ELSE concat(p_size, '명 초과') END AS claim,
    CASE p_partkey % 8 WHEN 0 THEN concat('USD ', p_partkey % 50 + 1, ',000,000') WHEN 1 THEN concat(p_partkey % 50 + 1, '.0 %') WHEN 2 THEN concat(p_size, '배') WHEN 3 THEN concat('USD ', p_partkey % 50 + 1, ' million 초과') WHEN 4 THEN concat('USD ', p_size, ' million')
    WHEN 5 THEN concat(p_size, '배') WHEN 6 THEN concat('less than ', p_partkey % 50 + 1, ' %') ELSE concat(p_partkey % 50 + 1, ' 명') END AS reference FROM part"""


def _parse(c: str) -> str:
    """DuckDB expression of a quantity struct; mirrors the phrase grammar."""
    num = r"'(?i)(\d[\d,]*(?:\.\d+)?)\s*(billion|million|천만|백만|억|만|천)?'"
    scale = "CASE lower(s) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in numeric.SCALES.items() if k) + " ELSE 1 END"
    cur = rf"CASE WHEN regexp_matches({c}, '(?i)USD|달러|\$') THEN 'USD' WHEN regexp_matches({c}, 'KRW|원') THEN 'KRW' END"
    unit = "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{u}'" for p, u in numeric.UNITS) + f" ELSE {cur} END"
    op = "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{o}'" for p, o in numeric.OPERATORS) + " ELSE 'eq' END"
    ns, ss = f"regexp_extract_all({c}, {num}, 1)", f"regexp_extract_all({c}, {num}, 2)"
    value = f"list_sum(list_transform(list_zip({ns}, {ss}), lambda z: replace(z[1], ',', '')::DOUBLE * ({scale.replace('lower(s)', 'lower(z[2])')})))"
    ok = rf"NOT regexp_matches({c}, '(?i)약|대략|approximately|about|~') AND len({ns}) > 0 AND NOT (len({ns}) > 1 AND (({cur}) IS NULL OR list_contains({ss}, '')))"
    return f"CASE WHEN {ok} THEN {value} END AS {c[0]}v, CASE WHEN {ok} THEN {unit} END AS {c[0]}u, {op} AS {c[0]}o"


@query(f"""WITH p AS ({_PHRASES}), q AS (SELECT *, {_parse("claim")}, {_parse("reference")} FROM p),
i AS (SELECT *, CASE WHEN co IN ('eq', 'gt', 'ge') THEN cv ELSE '-inf'::DOUBLE END AS cl, CASE WHEN co IN ('eq', 'lt', 'le') THEN cv ELSE 'inf'::DOUBLE END AS ch, CASE WHEN ro IN ('eq', 'gt', 'ge') THEN rv ELSE '-inf'::DOUBLE END AS rl, CASE WHEN ro IN ('eq', 'lt', 'le') THEN rv ELSE 'inf'::DOUBLE END AS rh, co IN ('eq', 'ge', 'le') AS ci, ro IN ('eq', 'ge', 'le') AS ri FROM q)
SELECT p_partkey, claim, reference, CASE WHEN cu IS NULL OR ru IS NULL OR cv IS NULL OR rv IS NULL THEN 'insufficient' WHEN cu <> ru THEN CASE WHEN cu IN ('USD', 'KRW') AND ru IN ('USD', 'KRW') THEN 'contradicts' ELSE 'insufficient' END
    WHEN co = 'eq' AND ro = 'eq' THEN CASE WHEN cv = rv THEN 'supports' ELSE 'contradicts' END WHEN ch < rl OR rh < cl OR (ch = rl AND NOT (ci AND ri)) OR (rh = cl AND NOT (ri AND ci)) THEN 'contradicts'
    WHEN (cl < rl OR (cl = rl AND (ci OR NOT ri))) AND (ch > rh OR (ch = rh AND (ci OR NOT ri))) THEN 'supports' ELSE 'insufficient' END AS relation FROM i""")
def quantity_relation(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    p = spark.sql(_PHRASES)
    return p.withColumn("relation", numeric.numeric_relation(numeric.quantity(F.col("claim")), numeric.quantity(F.col("reference"))))


@query("""SELECT event_id, concat('event_', left(sha256(concat('["', event_id, '","', event_type, '"]')), 24)) AS id, sha256(concat('{"k":', props->>'$.k', '}')) AS props_sha256 FROM events""")
def canonical_json_hash(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", hashing.stable_id("event", F.col("event_id"), F.col("event_type")).alias("id"), hashing.sha256(hashing.canonical_json(F.col("props"))).alias("props_sha256"))


# --- retrieval ----------------------------------------------------------------


@query()
def chunk_documents(spark, sf):
    return retrieval.chunks(table(spark, sf, "documents").select("doc_id", "text"), "text")


def _dense(spark, sf, k):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return retrieval.dense_top(e, e.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding", k)


def _sparse(spark, sf, k):
    return retrieval.tfidf_top(table(spark, sf, "documents"), "doc_id", "text", F.col("doc_id") % 20 == 0, k)


_DENSE = """dense AS (SELECT query, vec_id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id)::INT AS rank FROM (SELECT q.vec_id AS query, e.vec_id,
    round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 9) AS similarity FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id))"""
_SPARSE = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_]+') AS w FROM documents), g AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), vocab AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 50000), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
wt AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN vocab USING (term), n), nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY 1), f AS (SELECT doc_id, term, w / norm AS w FROM wt JOIN nm USING (doc_id)),
sparse AS (SELECT query, doc_id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc_id)::INT AS rank FROM (SELECT q.doc_id AS query, f.doc_id, round(sum(f.w * q.w), 9) AS similarity FROM f JOIN f q USING (term) WHERE q.doc_id % 20 = 0 AND q.doc_id <> f.doc_id GROUP BY ALL))"""


@query(f"WITH {_DENSE} SELECT query, vec_id, round(similarity, 6) AS similarity, rank FROM dense WHERE rank <= 5")
def dense_topk(spark, sf):
    return _dense(spark, sf, 5).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_SPARSE} SELECT query, doc_id, round(similarity, 6) AS similarity, rank FROM sparse WHERE rank <= 5")
def tfidf_topk(spark, sf):
    return _sparse(spark, sf, 5).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_DENSE}, {_SPARSE}, u AS (SELECT query, vec_id AS id, rank FROM dense WHERE rank <= 15 UNION ALL SELECT query, doc_id, rank FROM sparse WHERE rank <= 15), s AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL)
SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM s) WHERE rank <= 5""")
def rrf_fusion(spark, sf):
    dense, sparse = _dense(spark, sf, 15).withColumnRenamed("vec_id", "id"), _sparse(spark, sf, 15).withColumnRenamed("doc_id", "id")
    return retrieval.fuse([dense, sparse], "id", 5)


# --- streaming ----------------------------------------------------------------


@query("""WITH e AS (SELECT user_id::VARCHAR AS key, ts AS t, event_id AS o, event_type AS k FROM events WHERE event_type IN ('signup', 'purchase', 'error')), n AS (SELECT *, sum((k = 'signup')::INT) OVER (PARTITION BY key ORDER BY t, o ROWS UNBOUNDED PRECEDING) AS n FROM e),
s AS (SELECT key, n, min(t) FILTER (WHERE k = 'signup') AS started, min({'t': t, 'o': o}) FILTER (WHERE k = 'purchase') AS e FROM n WHERE n > 0 GROUP BY ALL)
SELECT s.key, started, e.t AS ended, count(*) FILTER (WHERE k = 'error' AND (e IS NULL OR {'t': n.t, 'o': n.o} < e))::INT AS retries, CASE WHEN e IS NULL THEN 'failed' ELSE 'succeeded' END AS status FROM s JOIN n USING (key, n) GROUP BY ALL""")
def span_pairing(spark, sf):
    return streaming.spans(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id", "signup", "purchase", "error")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_counts(spark, sf):
    return streaming.windowed_counts(table(spark, sf, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))
