"""Journals and the check of lines before an append."""

import pytest

from ledgerlark.sources import journal
from ledgerlark.sources.runs import read_text


def test_a_journal_goes_on_where_it_stopped(spark, tmp_path):
    path, calls = f"{tmp_path}/journal.json", []

    def step(name, fails=False):
        def run():
            calls.append(name)
            if fails:
                raise RuntimeError(f"{name} broke")
            return f"out/{name}"
        return run

    plan = {"dataset": "v1", "runs": ["a", "b"]}
    with pytest.raises(RuntimeError):
        journal.Journal(spark, path, plan).run({"before": step("before"), "after": step("after", fails=True)})
    assert '"failed"' in read_text(spark, path) and "after broke" in read_text(spark, path)
    with pytest.raises(ValueError, match="reason"):
        journal.Journal(spark, path, plan)
    with pytest.raises(ValueError, match="dataset"):
        journal.Journal(spark, path, plan | {"dataset": "v2"}, "again")
    with pytest.raises(ValueError, match="before"):
        journal.Journal(spark, path, plan, "again").run({"other": step("other")})
    done = journal.Journal(spark, path, plan, "again").run({"before": step("before"), "after": step("after")})
    assert done == {"before": "out/before", "after": "out/after"}
    assert calls == ["before", "after", "after"]
    with pytest.raises(FileExistsError):
        journal.Journal(spark, path, plan, "again")


def test_lines_are_checked_before_an_append(spark, tmp_path):
    log = tmp_path / "log"
    rows = spark.createDataFrame([(1, "é"), (2, None)], "k int, v string")
    journal.append_checked(rows, str(log))
    journal.append_checked(rows, str(log))
    assert spark.read.json(str(log)).count() == 4
    (log / "cut.json").write_text('{"k": 3}\n{"k": 4')
    (log / "bad.json").write_text('{"k": 3}\r\n{"k": \n')
    (log / "fine.json").write_text('{"k": 3, "v": "日本"}\r\n')
    (log / "empty.json").write_text("")
    assert {(r.file.split("/")[-1], r.problem) for r in journal.line_problems(spark, str(log)).collect()} == {("cut.json", "last line not ended"), ("bad.json", "line is no JSON")}
    with pytest.raises(ValueError, match=r"cut\.json|bad\.json"):
        journal.append_checked(rows, str(log))
    assert spark.read.schema("k int").json(str(log)).filter("k < 3").count() == 4
