"""Scalar functions."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import hashing, nested, numeric, text

RELATIONS = [
    ("6억 4천만 달러", "USD 640,000,000", "supports"),
    ("6,400만 달러", "USD 640,000,000", "contradicts"),
    ("6억 4천만 원", "USD 640,000,000", "contradicts"),
    ("2 TOPS", "2배", "insufficient"),
    ("2명", "2곳", "insufficient"),
    ("약 2배", "2배", "insufficient"),
    ("USD 693,000,000", "USD 693,000,000 초과", "contradicts"),
    ("USD 700,000,000", "USD 693,000,000 초과", "insufficient"),
    ("USD 600,000,000 이상", "USD 693,000,000 초과", "supports"),
    ("USD 700,000,000 초과", "USD 693,000,000 초과", "insufficient"),
    ("", "2배", "insufficient"),
    (None, "2배", "insufficient"),
]


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first().x


def test_numeric_relations(spark):
    frame = spark.createDataFrame(RELATIONS, "c string, r string, want string")
    got = frame.select("want", numeric.numeric_relation(numeric.quantity(F.col("c")), numeric.quantity(F.col("r"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_lower_bound_reads_reference_as_more(spark):
    c, r = numeric.quantity(F.lit("USD 700,000,000")), numeric.quantity(F.lit("USD 693,000,000"))
    assert spark.range(1).select(numeric.numeric_relation(c, r, F.lit(True)).alias("x")).first().x == "insufficient"


def test_quantity_parts(spark):
    got = spark.createDataFrame([("6억 4천만 미국 달러",), ("2 3 %",), ("3 million users",), ("at least 5 W",)], "s string").select(numeric.quantity(F.col("s")).alias("q")).collect()
    assert [(int(r.q.value), r.q.unit, r.q.op) if r.q else None for r in got] == [(640000000, "USD", "eq"), None, None, (5, "W", "ge")]


def test_null_is_not_zero(spark):
    r = spark.range(1).select(numeric.ratio(F.lit(1), F.lit(0)).alias("a"), numeric.ratio(F.lit(1), F.lit(2), F.lit(False)).alias("b"), numeric.delta(F.lit(None).cast("double"), F.lit(1.0), True).alias("c"), numeric.delta(F.lit(0.25), F.lit(0.5), True).alias("d"), numeric.half_even(F.lit(2.5)).alias("e")).first()
    assert tuple(r) == (None, None, None, 25.0, 2.0)


def test_cost(spark):
    lit = F.lit
    c = lambda *a: numeric.cost(*[x if x is not None else lit(None).cast("double") for x in a])
    none = None
    r = spark.range(1).select(
        c(lit(True), lit("x"), lit("llm"), lit(True), none, none, none, none, none, none, none).alias("a"),
        c(lit(False), lit("local"), lit("llm"), lit(True), none, none, none, none, none, none, none).alias("b"),
        c(lit(False), lit("x"), lit("search"), lit(True), lit(0.5), none, none, none, none, none, none).alias("c"),
        c(lit(False), lit("x"), lit("llm"), lit(True), none, lit(100.0), none, lit(10.0), lit(2.0), lit(1.0), lit(8.0)).alias("d"),
        c(lit(False), lit("x"), lit("llm"), lit(True), none, lit(100.0), lit(20.0), lit(10.0), lit(2.0), lit(1.0), lit(8.0)).alias("e"),
    ).first()
    assert tuple(r) == (0, 0, 0.5, None, 260 / 1e6)


@pytest.mark.parametrize(("raw", "title", "url"), [("A - B - http://x.org/a", "A - B", "http://x.org/a"), ("See http://x.org", "See", "http://x.org"), (" plain ", "plain", "")])
def test_split_reference(spark, raw, title, url):
    assert tuple(one(spark, text.split_reference(F.col("s")), s=raw)) == (title, url)


def test_reference_formatting(spark):
    assert one(spark, text.format_reference(F.col("s")), s="Outlook 2024 - https://www.iea.org/reports/2024.05.01") == "- IEA(2024-05-01). Outlook 2024. IEA. https://www.iea.org/reports/2024.05.01"
    assert one(spark, text.organisation(F.lit("https://ai-news.example.com/x")), s="") == "Ai News"
    assert one(spark, text.organisation(F.lit("")), s="") == "출처 미상"
    assert one(spark, text.year(F.lit("none")), s="") == "n.d."
    assert one(spark, text.reference_kind(F.lit("Journal of X"), F.lit("")), s="") == "학술 논문"


def test_text_cleaning(spark):
    assert one(spark, text.compact(F.col("s"), 5), s="a　　b  cdefg") == "a b c..."
    assert one(spark, text.clean_source(F.col("s")), s="# Skip to content | Hello https://x.y/z world -") == "Hello world"
    long = "This sentence is long enough to be kept as it is. Short one. Another sentence that is also long enough to be kept!"
    assert one(spark, text.meaningful(F.col("s")), s=long) == "This sentence is long enough to be kept as it is. Another sentence that is also long enough to be kept!"
    assert one(spark, text.slug(F.col("s")), s="Neuro Silicon (A)!") == "neuro_silicon_a"
    assert one(spark, text.letters(F.col("s"), "hangul"), s="abc 한글") == 2
    assert one(spark, text.normal_statement(F.col("s")), s="ＡＢ  c.。") == "AB c"


def test_markers_names_and_redaction(spark):
    assert one(spark, text.markers(F.col("s")), s="a [1] b [SOURCE:x] http://u.v/w)") == ["[1]", "[SOURCE:x]", "http://u.v/w"]
    assert one(spark, text.footnotes(F.col("s")), s="[1]: http://a\n[2]: http://b\n[1]: http://c") == {"2": "http://b", "1": "http://c"}
    assert one(spark, text.names(F.col("s")), s="NVDA/x ABC MIT OpenAi ABC") == ["NVDA", "ABC", "OpenAi"]
    assert one(spark, text.redact(F.col("s")), s="Bearer abc.def sk-0123456789abcdef01") == "Bearer [REDACTED] [REDACTED]"
    assert one(spark, text.strata(F.col("s")), s="USD 3") == ["number", "currency"]
    assert one(spark, text.strata(F.col("s")), s="none") == ["other"]
    assert one(spark, text.numbers_kept(F.lit("3 and 4.5"), F.lit("4.5, 3")), s="")
    assert not one(spark, text.numbers_kept(F.lit("3"), F.lit("4")), s="")
    assert one(spark, text.quoted_at(F.lit("a😀bc"), F.lit(2), F.lit(4), F.lit("bc")), s="")


def test_hashes(spark):
    a, b = one(spark, hashing.canonical_json(F.col("s")), s='{"b": 1.0, "a": "é"}'), one(spark, hashing.canonical_json(F.col("s")), s="{bad")
    assert (a, b) == ('{"a":"é","b":1.0}', None)
    assert one(spark, hashing.stable_id("x", F.col("s")), s="v").startswith("x_")


def test_texts_are_canonical_without_python(spark):
    texts = [*map(chr, range(0x300)), "\u2028", "😀", "", None, "\\u001F", "\\\x1f", "\x1f\\u000B\"", "\x01\\", "\\\\\x0b"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in ("\\", "\x1e", "u001F")], "a string, b string").select(F.array("a", "b").alias("x"))
    both = pairs.select(hashing.canonical_texts(F.col("x")).alias("own"), hashing.canonical_json(F.to_json("x")).alias("python"))
    assert both.filter("not (own <=> python)").collect() == []
    plan = pairs.select(hashing.stable_id("x", F.col("x")[0], F.col("x")[1]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert one(spark, hashing.fingerprint(F.array(F.lit("b"), F.lit("a"))), s="") == one(spark, hashing.fingerprint(F.array(F.lit("a"), F.lit("b"))), s="")


def test_json_walk_offsets(spark):
    raw = json.dumps({"company_name": "X", "a": [{"t": "q\"é", "n": 1}, "s"], "b/c": {"name": "Y", "z~": "w"}})
    units = list(nested.walk(raw))
    assert [(u[0], u[1], u[4]) for u in units] == [("/company_name", "X", "X"), ("/a/0/t", 'q"é', "X"), ("/a/1", "s", "X"), ("/b~1c/name", "Y", "Y"), ("/b~1c/z~0", "w", "Y")]
    assert all(json.loads('"' + raw[u[2] : u[3]] + '"') == u[1] for u in units)
    frame = spark.createDataFrame([(1, raw), (2, "bad"), (3, None)], "k int, j string")
    assert nested.json_units(frame, "j").filter("k = 1").count() == 5
    assert nested.json_units(frame, "j").count() == 5
    assert one(spark, nested.text_leaves(F.col("s")), s=raw) == ["X", 'q"é', "s", "Y", "w"]
    assert one(spark, nested.unwrapped(F.col("s"), "a"), s='{"data":{"a":"1"}}') == "1"
    assert one(spark, nested.redact_json(F.col("s")), s='{"api_key":"k","x":["Bearer abc"]}') == '{"api_key":"[REDACTED]","x":["Bearer [REDACTED]"]}'
    assert one(spark, nested.secret_key(F.col("s")), s="X-Api-Key")


def test_units_of_companies_in_a_table(spark):
    raw = json.dumps({"acme": {"note": "one", "b/c": {"name": "zeta", "x": "two"}}, "company_name": "zeta", "last": "three", "acme2": "four", "p": {"q": {"r": {"s": "five"}}}})
    frame = spark.createDataFrame([(1, raw)], "k int, j string")
    names = ["zeta", "p/q", "acme", "acme2", "s", "q/r"]
    old = {u[1]: next((c for c in names if f"/{c}/" in u[0]), u[4] if u[4] in names else None) for u in nested.walk(raw)}
    assert {r.text: r.company_id for r in nested.scoped_units(frame, "j", names).collect()} == old
    # Of several names in a path the first of the list holds, and the least of a table.
    several = nested.scoped_units(frame, "j", ["q/r", "p/q"]).filter("text = 'five'").first().company_id, nested.scoped_units(frame, "j", spark.createDataFrame([("q/r",), ("p/q",), (None,), ("p/q",)], "c string")).filter("text = 'five'").first().company_id
    assert several == ("q/r", "p/q")
    # Names are a table in the plan: many of them make no longer expression, and no unit is doubled by a repeated one.
    many = spark.range(200_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("c")).unionByName(spark.createDataFrame([("zeta",), ("zeta",)], "c string"))
    assert {r.text: r.company_id for r in nested.scoped_units(frame, "j", many).collect()} == {"one": "zeta", "zeta": "zeta", "two": "zeta", "three": "zeta", "four": "zeta", "five": "zeta"}
