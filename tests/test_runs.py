"""Run folders, rules of records, JSON by name, closures and ledgers on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlark import __main__ as cli
from ledgerlark.functions import nested
from ledgerlark.operators import joins
from ledgerlark.plans import paired, quality, records, retrieval, workflow
from ledgerlark.sources import files, providers, runs


def test_small_files_manifest_and_freeze(spark, tmp_path):
    run = f"file://{tmp_path}/run-1"
    digest = runs.write_json(spark, f"{run}/run.json", {"run_id": "run-1", "status": "running", "api_key": "x", "note": "Bearer abc.def"}, {"run_id": "run-1"})
    assert len(digest) == 64
    kept = json.loads(runs.read_text(spark, f"{run}/run.json"))
    assert (kept["api_key"], kept["note"]) == ("[REDACTED]", "Bearer [REDACTED]")
    with pytest.raises(FileExistsError):
        runs.write_json(spark, f"{run}/run.json", {"run_id": "run-1"})
    with pytest.raises(ValueError, match="folder"):
        runs.write_json(spark, f"{run}/other.json", {"run_id": "run-2"}, {"run_id": "run-1"})
    with pytest.raises(ValueError, match="cannot change"):
        runs.update_manifest(spark, f"{run}/run.json", ("run_id",), run_id="run-2")
    with pytest.raises(PermissionError):
        runs.end_run(spark, run)
    runs.update_manifest(spark, f"{run}/run.json", ("run_id",), status="succeeded")
    with pytest.raises(PermissionError):
        runs.update_manifest(spark, f"{run}/run.json", (), status="running")
    runs.end_run(spark, run)
    rows = spark.range(2)
    for write in (lambda: files.append_lines(rows, f"{run}/deep/log"), lambda: files.write_csv(rows, f"{run}/deep/csv"), lambda: files.write_once(rows, f"{run}/t"), lambda: runs.write_text(spark, f"{run}/x.md", "x")):
        with pytest.raises(PermissionError):
            write()


def test_one_writer(spark, tmp_path):
    folder = f"file://{tmp_path}"
    with runs.writer(spark, folder):
        with pytest.raises(BlockingIOError), runs.writer(spark, folder):
            pass
    with runs.writer(spark, folder):
        pass


def test_archives_and_publishing(spark, tmp_path):
    staged, target = f"file://{tmp_path}/staged", f"file://{tmp_path}/target"
    runs.archive(spark, staged, {"claims": spark.range(3), "atoms": spark.range(2).coalesce(1)}, {"version": "1"})
    assert runs.archive_problems(spark, staged).collect() == []
    assert runs.parseable(spark, staged).filter("file like '%manifest.json' and not ok").collect() == []
    part = next((tmp_path / "staged" / "atoms").glob("*.json"))
    whole = part.read_text()
    part.write_text(whole + '{"id":9}\n')
    for f in part.parent.glob(".*.crc"):
        f.unlink()
    assert [r.problem for r in runs.archive_problems(spark, staged).collect()] == ["changed"]
    assert cli.main(["archive", "--input", staged]) == 1
    with pytest.raises(ValueError, match="not published"):
        cli.main(["publish", "--input", staged, "--output", target])
    part.write_text(whole)
    runs.publish(spark, staged, target, runs.archive_problems(spark, staged))
    assert (tmp_path / "target" / "manifest.json").exists()
    runs.archive(spark, staged, {"claims": spark.range(1)}, {})
    with pytest.raises(FileExistsError):
        runs.publish(spark, staged, target, runs.archive_problems(spark, staged))


def test_paths_of_equal_names(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / "x" / d).mkdir(parents=True)
        (tmp_path / "x" / d / "f.txt").write_text(d)
    root = f"file://{tmp_path}/x"
    found = {r.file: r.sha256 for r in files.inventory(spark, root).collect()}
    assert set(found) == {"a/f.txt", "b/f.txt"}
    assert joins.table_diff(files.inventory(spark, root), files.inventory(spark, str(tmp_path / "x")), "file", "sha256").collect() == []
    want = spark.createDataFrame([("a/f.txt", found["a/f.txt"]), ("b/f.txt", "0"), ("c", "0"), ("../x/a/f.txt", found["a/f.txt"]), ("/a/f.txt", "0")], "file string, sha256 string")
    got = {r.file: (r.status, r.text) for r in files.verified_texts(spark, root, want).collect()}
    assert got == {"a/f.txt": ("ok", "a"), "b/f.txt": ("mismatch", None), "c": ("missing", None), "../x/a/f.txt": ("outside", None), "/a/f.txt": ("outside", None)}
    (tmp_path / "link").symlink_to(tmp_path / "x")
    (tmp_path / "x" / "l.jsonl").write_text('{"a": 1}\n')
    assert runs.plain_lines(spark, f"{tmp_path}/x/l.jsonl", "a int").collect()[0].a == 1
    with pytest.raises(ValueError, match="symbolic"):
        runs.plain_lines(spark, f"{tmp_path}/link/l.jsonl", "a int")
    with pytest.raises(ValueError, match="positive"):
        runs.checked_lines(spark, f"{tmp_path}/x/l.jsonl", "a int", "t", "a", {"positive": "a > 1"})


def test_roots_prompts_prices_policies_settings(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "README.md").write_text("x")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "doc.md").write_text(" body \n\nmore\n")
    assert [(r.file_name, r.content, r.metadata.file_name) for r in files.corpus(spark, f"{tmp_path}/two").collect()] == [("doc.md", " body \n\nmore\n", "doc.md")]
    assert runs.corpus_root(spark, [f"{tmp_path}/one", f"{tmp_path}/two"]) == f"{tmp_path}/two"
    assert runs.prompt(spark, f"{tmp_path}/two", "doc") == "body \n\nmore"
    with pytest.raises(FileNotFoundError):
        files.corpus(spark, f"{tmp_path}/one")
    with pytest.raises(FileNotFoundError):
        runs.corpus_root(spark, [f"{tmp_path}/one"])
    assert runs.prices(spark)[0].count() == 0
    (tmp_path / "p.json").write_text(json.dumps({"version": "v", "currency": "USD", "prices": [{"provider": "x", "kind": "llm", "model": "m", "input": 2.0, "cached": 1.0, "output": 4.0}]}))
    table, about = runs.prices(spark, f"{tmp_path}/p.json")
    calls = spark.createDataFrame([("x", "llm", "m", False, True, '{"input_tokens": 10, "output_tokens": 5, "input_token_details": {"cache_read": 4}}'), ("x", "llm", "m", False, True, "{}"), ("y", "llm", "m", False, True, "{}"), ("y", "llm", "m", True, True, "{}")], "provider string, kind string, model string, cached boolean, ok boolean, usage string")
    got = [(r.provider, r.cost if r.cost is None else round(r.cost * 1e6, 6), r.cost_reason) for r in providers.usage_records(calls, table).collect()]
    assert about["version"] == "v"
    assert sorted(g for g in got if g[1] is not None) == [("x", 36.0, None), ("y", 0.0, None)]
    assert {g[2] for g in got if g[1] is None} == {"token counts unknown", "no price"}
    (tmp_path / "w.json").write_text(json.dumps({"weights": {"Seed": {"team": 0.5, "risk": 0.4}}}))
    with pytest.raises(ValueError, match="sum"):
        runs.policy(spark, f"{tmp_path}/w.json")
    assert runs.settings({"TOP_K": "4", "LIVE": "yes", "KEY": "z"}, {"top_k": 3, "live": False, "key_name": None}, {"key_name": ("KEY",)}) == {"top_k": 4, "live": True, "key_name": "z"}


def test_searches_and_replies(spark):
    calls = spark.createDataFrame([("q", "r", "succeeded"), ("q", "r", "succeeded"), ("p", "s", "succeeded")], "request string, result string, status string")
    assert runs.export_replay(calls).count() == 2
    for bad in (("q", "x", "succeeded"), ("z", None, "failed")):
        with pytest.raises(ValueError):
            runs.export_replay(calls.unionByName(spark.createDataFrame([bad], calls.schema)))
    reply = json.dumps({"results": [{"url": "https://a.org/x", "content": "c"}, {"title": "t"}, {}, {"title": "fourth"}]})
    got = runs.search_results(spark.createDataFrame([("q", "k", reply)], "query string, category string, reply string")).orderBy("pos").collect()
    assert [(r.title, r.url, r.source) for r in got] == [("q", "https://a.org/x", "a.org"), ("t", "", "unknown"), ("q", "", "unknown")]
    replies = spark.createDataFrame([("ok", '{"a": 1}'), ("ok", "no json"), ("error", None)], "status string, reply string")
    assert [(r.value.a if r.value else None, r.status) for r in providers.structured(replies, "reply", "a int").collect()] == [(1, "ok"), (None, "error"), (None, "error")]
    scores = spark.createDataFrame([("ok", 0.5, None), ("ok", float("nan"), None), ("ok", 1.5, None), ("error", None, "late")], "status string, score double, reason string")
    assert [(r.score, r.error) for r in providers.measured(scores, "score").collect()] == [(0.5, None), (None, "not a number"), (None, "out of range"), (None, "late")]


def test_every_rule_breaks_on_a_row_of_nulls_or_a_planted_one(spark):
    """Each rule is an SQL predicate over its record's columns; the catalogue names each once."""
    table = records.rules(spark)
    assert table.count() == sum(map(len, records.RULES.values()))
    frame = spark.createDataFrame([(1, 3, 2), (2, 0, 5), (3, -1, 5)], "id int, start_offset int, end_offset int")
    assert {(r.row, r.rule) for r in records.broken({"source_location": frame}).collect()} == {("1", "offsets"), ("3", "offsets")}
    ranks = spark.createDataFrame([(1, [1, 2, 4]), (2, [1, 1]), (3, []), (4, [2, 1])], "id int, ranks array<int>")
    assert {r.row for r in records.broken({"retrieval": ranks}).collect()} == {"2", "4"}


def test_closure_beyond_any_depth_and_over_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "id int, parent int")
    found = joins.ancestors(chain, "id", "parent")
    assert found.count() == 150 * 149 // 2
    assert found.filter("depth <> node - ancestor").count() == 0
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("r", None)], "invocation_id string, parent_id string")
    assert {r.row for r in workflow.cycles(ring, "invocation_id", "parent_id").collect()} == {"a", "b", "c"}
    assert {(r.node, r.ancestor) for r in joins.ancestors(ring, "invocation_id", "parent_id").collect()} == {(x, y) for x in "abcx" for y in "abc"}


def test_containment_by_automaton_and_by_grams(spark):
    hay = spark.createDataFrame([(i, f"some {i} words stand before the quick brown fox number {i % 3} jumps and after it too") for i in range(30)] + [(30, None), (31, "")], "doc int, text string")
    needles = spark.createDataFrame([(1, "quick brown fox number 1 jumps and after"), (2, "umber 2 j"), (3, "absent"), (4, ""), (5, None), (6, "9"), (7, "9")], "n int, needle string")
    want = {(d.doc, n.n) for d in hay.collect() for n in needles.collect() if d.text and n.needle and n.needle in d.text}
    for size in (1 << 20, 20):
        assert {(r.doc, r.n) for r in joins.contained(needles, hay, "needle", "text", block_bytes=size).collect()} == want


def test_redaction_keeps_form(spark):
    raw = '{"a": "sk-abcdefghijklmnopqrstuv", "Api-Key": {"x": [1, "y"]}, "b": [ "Bearer a.b", {"password": 12, "ok": "\\u00e9 hidden1234"} ], "c": null}'
    out = spark.createDataFrame([(raw,), ("not json sk-abcdefghijklmnopqrstuv",), (None,)], "j string").select(nested.redact_json(F.col("j"), ("hidden1234",)).alias("j")).collect()
    assert out[0].j == '{"a": "[REDACTED]", "Api-Key": "[REDACTED]", "b": [ "Bearer [REDACTED]", {"password": "[REDACTED]", "ok": "é [REDACTED]"} ], "c": null}'
    assert (out[1].j, out[2].j) == ("not json [REDACTED]", None)
    assert nested.environment_secrets({"OPENAI_API_KEY": "longsecret", "HOME": "/root/xxxxxx", "X_PASSWORD": "short"}) == ("longsecret",)
    for inside in ("abc", "a\\u00e9b", "\\ud83d\\ude00x", 'q\\"w\\\\', "\\ud83dx"):
        assert len(nested.raw_offsets(inside)) == len(json.loads(f'"{inside}"')) + 1


def test_samples_without_facts_stay(spark):
    samples = spark.createDataFrame([("s1", 1), ("s2", 2)], "sample_id string, k int").withColumn("as_of_date", F.lit("2024-01-01").cast("date"))
    facts = spark.createDataFrame([(1, 7, "verified")], "k int, fact_id int, review_status string").withColumns({"fact_date": F.lit("2024-01-01").cast("date"), "source_date": F.lit("2023-01-01").cast("date")})
    assert {r.sample_id: r.facts for r in quality.eligible_facts(samples, facts, ["k"]).collect()} == {"s1": [7], "s2": []}


def test_index_is_built_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three", "m"), (2, "two three four", "m")], "doc int, content string, meta string")
    build = lambda d: retrieval.vocabulary(d, "doc", "content")
    first, made = retrieval.index_once(docs, "content", "meta", f"file://{tmp_path}", build)
    again, made2 = retrieval.index_once(docs.repartition(3), "content", "meta", f"file://{tmp_path}", build)
    _, made3 = retrieval.index_once(docs.filter("doc = 1"), "content", "meta", f"file://{tmp_path}", build)
    assert (made, made2, made3) == (True, False, True)
    own = {(r.doc, r.term): round(r.weight, 9) for r in retrieval.transformed(docs.select("doc", "content"), "doc", "content", again).collect()}
    assert own == {(r.doc, r.term): round(r.weight, 9) for r in retrieval.tfidf(docs.select("doc", "content"), "doc", "content").collect()}
    assert first.count() == again.count()


def test_paired_markdown(spark):
    side = lambda rows: spark.createDataFrame(rows, "k string, f1 double")
    r = paired.report(side([("a", 0.5), ("b", 0.25)]), side([("a", 0.75), ("c", None)]), ["k"], ["f1"], [True])
    lines = [x.line for x in paired.markdown(r, ["k"], ["f1"]).orderBy("line_no").collect()]
    assert lines == ["| Key | Status | f1 before | f1 after | f1 change |", "| --- | --- | --- | --- | --- |", "| a | paired | 0.5000 | 0.7500 | 25.0000 |", "| b | unpaired | 0.2500 | - | - |", "| c | unpaired | - | - | - |"]


def test_record_review_and_label_commands(spark, tmp_path):
    spark.createDataFrame([(1, 5, 2)], "id int, start_offset int, end_offset int").write.parquet(f"{tmp_path}/loc")
    assert cli.main(["records", "--input", f"{tmp_path}/loc", "--kind", "source_location"]) == 1
    spark.createDataFrame([(f"t{i}", "g", ["number"], i == 9) for i in range(10)], "target_id string, review_group string, strata array<string>, critical boolean").write.parquet(f"{tmp_path}/targets")
    assert cli.main(["review", "--input", f"{tmp_path}/targets", "--seed", "s", "--per-stratum", "3", "--output", f"file://{tmp_path}/plan"]) == 0
    plan = {r.target_id for r in spark.read.parquet(f"{tmp_path}/plan").collect()}
    assert "t9" in plan
    assert len(plan) in (3, 4)
