"""Stage packages: written and read back, and held against their run; each altered record gives its own finding."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlark import package_queries
from ledgerlark.plans import packages

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
OUTPUT, INPUT = 'Fact one. Say "\\u00e9". Opinion.', "what is known?"
LOC = packages.LOCATION
SCHEMAS = {
    "samples": f"sample_id string, run_id string, evaluation_id string, mode string, stage string, invocation_id string, attempt int, input_path string, input_sha256 string, user_input string, response string, response_sha256 string, evaluation_status string, case_id string, company_id string, section_id string, as_of_date string, reference string, reference_ids array<string>, reference_sha256 string, claim_ids array<string>, locations array<{LOC}>",
    "claims": f"claim_id string, run_id string, evaluation_id string, sample_id string, invocation_id string, atomic_statement string, company_id string, section_id string, occurrences array<{LOC}>",
    "atoms": f"atom_id string, unit_id string, sample_id string, claim_id string, kind string, statement string, company_id string, section_id string, location {LOC}",
    "units": f"unit_id string, text string, format string, fragment boolean, location {LOC}",
    "invocations": "invocation_id string, attempt int, input_path string, input_sha256 string, output_path string, output_sha256 string",
    "texts": "path string, sha256 string, text string",
    "artifacts": "path string, sha256 string",
    "cases": "case_id string, company_id string, section_id string, as_of_date string, reference string, reference_ids array<string>",
}
SCOPE = {"run_id": "r", "evaluation_id": "e", "mode": "end_to_end"}


def loc(start, end, quote=None):
    return ("out", sha(OUTPUT), start, end, OUTPUT[start:end] if quote is None else quote)


def row(name, values):
    return dict(zip([f.split(" ")[0] for f in split(SCHEMAS[name])], values, strict=True))


def split(schema):
    parts, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return [p.strip() for p in parts]


A, B = loc(0, 8), loc(14, 22)
BASE = {
    "samples": [row("samples", ("s", "r", "e", "end_to_end", "intermediate", "i", 1, "in", sha(INPUT), INPUT, "Fact one\nsecond", sha("Fact one\nsecond"), "pending", "k", "co", "sec", "2024-01-01", "ref", ["f"], "d", ["c1", "c2"], [A, B]))],
    "claims": [row("claims", ("c1", "r", "e", "s", "i", "Fact one", "co", "sec", [A])), row("claims", ("c2", "r", "e", "s", "i", "second", "co", "sec", [B]))],
    "atoms": [row("atoms", ("a1", "u1", "s", "c1", "fact", "Fact  one.", "co", "sec", A)), row("atoms", ("a2", "u2", "s", "c2", "fact", "second", "co", "sec", B)), row("atoms", ("a3", "u1", "s", None, "opinion", "x", "co", "sec", A))],
    "units": [row("units", ("u1", "Fact one", "markdown", False, A)), row("units", ("u2", "é", "json_string", False, B))],
    "invocations": [row("invocations", ("i", 1, "in", sha(INPUT), "out", sha(OUTPUT)))],
    "texts": [row("texts", ("in", sha(INPUT), INPUT)), row("texts", ("out", sha(OUTPUT), OUTPUT))],
    "artifacts": [row("artifacts", ("report", "h"))],
    "cases": [row("cases", ("k", "co", "sec", "2024-01-01", "ref", ["f"]))],
}


def frames(spark, tables):
    made = {k: spark.createDataFrame([tuple(r.values()) for r in tables[k]], SCHEMAS[k]) for k in SCHEMAS}
    return {k: made[k] for k in ("samples", "claims", "atoms", "units")}, {k: made[k] for k in ("invocations", "texts", "artifacts", "cases")}


def audited(spark, tables):
    return {(r.rule, r.row) for r in packages.audit(*frames(spark, tables), SCOPE, "d").collect()}


CASES = [
    ("claims", 0, {"evaluation_id": "x"}, {("claim scope", "c1")}),
    ("samples", 0, {"mode": "isolated"}, {("sample scope", "s")}),
    ("atoms", 0, {"kind": "opinion"}, {("atom is no fact of its claim", "a1")}),
    ("atoms", 0, {"statement": "fact two"}, {("claim statement", "a1")}),
    ("atoms", 1, {"section_id": "other"}, {("claim statement", "a2")}),
    ("atoms", 2, {"location": loc(1, 9, "Fact one")}, {("atom position", "a3")}),
    ("atoms", 2, {"unit_id": "gone"}, {("atom unit", "a3")}),
    ("atoms", 2, {"claim_id": "gone"}, {("atom claim", "a3")}),
    ("claims", 1, {"occurrences": [A, B]}, {("occurrence of no atom", "c2")}),
    ("claims", 1, {"occurrences": []}, {("occurrence missing", "c2")}),
    ("units", 1, {"text": "e"}, {("unit text", "u2")}),
    ("units", 0, {"text": "Fact"}, {("unit text", "u1")}),
    ("samples", 0, {"attempt": 2}, {("sample attempt", "s")}),
    ("samples", 0, {"user_input": "other"}, {("sample request", "s")}),
    ("samples", 0, {"input_sha256": None}, {("sample input", "s"), ("sample request", "s")}),
    ("samples", 0, {"stage": "final"}, {("sample source", "s")}),
    ("samples", 0, {"response": "Fact one"}, {("response", "s")}),
    ("samples", 0, {"claim_ids": ["c2", "c1"]}, {("response", "s")}),
    ("samples", 0, {"as_of_date": None}, {("reference scope", "s")}),
    ("samples", 0, {"reference": "other"}, {("reference text", "s")}),
    ("samples", 0, {"case_id": "gone"}, {("reference case", "s")}),
    ("samples", 0, {"invocation_id": "gone"}, {("sample invocation", "s"), ("claim lineage", "s")}),
    ("samples", 0, {"locations": [("out", sha(OUTPUT), 0, 4, "fact")]}, {("sample position", "s")}),
]


def test_a_good_package_has_no_findings(spark):
    assert audited(spark, BASE) == set()
    assert audited(spark, {k: [] for k in SCHEMAS}) == set()


def test_each_altered_record(spark):
    """Each alteration is a package of its own under other ids; all are audited at once."""
    everything = {k: [] for k in SCHEMAS}
    ids = {"sample_id", "invocation_id", "claim_id", "atom_id", "unit_id", "case_id"}
    for n, (name, at, change, _) in enumerate(CASES):
        for k, rows in BASE.items():
            for i, r in enumerate(rows):
                new = r | (change if (k, i) == (name, at) else {})
                new = {c: f"{n}/{v}" if c in ids and v is not None else [f"{n}/{x}" for x in v] if c == "claim_ids" else v for c, v in new.items()}
                everything[k].append(new)
    found = audited(spark, everything)
    for n, (*what, wanted) in enumerate(CASES):
        assert {(rule, row.split("/")[1]) for rule, row in found if row.startswith(f"{n}/")} == wanted, what


def test_saved_and_checked(spark, tmp_path):
    folder = f"{tmp_path}/package"
    tables, run = frames(spark, BASE)
    packages.save(folder, tables, {"version": 1})
    assert packages.file_problems(spark, folder).collect() == []
    back = {k: spark.read.schema(SCHEMAS[k]).json(f"{folder}/{k}") for k in tables}
    assert packages.audit(back, run, SCOPE, "d").collect() == []
    with pytest.raises(Exception, match="(?i)exist"):
        packages.save(folder, tables, {"version": 1})
    path = next(p for p in (tmp_path / "package" / "claims").glob("*.json") if "second" in p.read_text())
    path.write_text(path.read_text().replace("second", "third"))
    path.with_name(f".{path.name}.crc").unlink()
    assert [(r.file.split("/")[0], r.problem) for r in packages.file_problems(spark, folder).collect()] == [("claims", "changed")]


def test_lines_start_where_the_text_says(spark):
    texts = ["", "\n", "a", "ab\n\nc\n", "\n".join("x" * (i % 7) for i in range(1000))]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("each", F.split("text", "\n")).withColumn("lengths", F.transform("each", F.length))
    for r in frame.select("text", "each", package_queries.line_starts(F.col("lengths")).alias("starts")).collect():
        assert len(r.starts) == r.text.count("\n") + 1
        assert [r.text[a : a + len(x)] for a, x in zip(r.starts, r.each)] == r.text.split("\n")
        assert all(a == 0 or r.text[a - 1] == "\n" for a in r.starts)


def test_documents_with_one_id_keep_their_own_lines(spark, tmp_path):
    docs = [(2, "one\ntwo\nthree", "s"), (2, "four and more\nfive", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    rules = {(r.rule, r.row, r.value) for r in package_queries.package_audit(spark, str(tmp_path)).collect()}
    assert not [r for r in rules if r[0] == "atom position"]
