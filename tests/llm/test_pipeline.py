"""The pipeline's stages on planted cases, an empty table, and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_and_planted_cases(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item = text(30)
    docs = [(i, text(80) + "\n" + text(10), "en", "s", 0) for i in range(40)]
    docs += [(100, docs[3][1], "en", "s", 0), (101, docs[4][1] + " tail", "en", "s", 0)]
    docs += [(110, text(40) + " " + item + " " + text(20), "en", "s", 0), (120, "123 456", "en", "s", 0), (121, None, "en", "s", 0)]
    docs += [(130 + i, text(60) + "\nthe common line", "en", "s", 0) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids == {*range(40), *range(130, 142)}
    assert all(r.parity and r.decoded == r.text and r.n_tokens == len(r.ids) for r in out)
    assert not any("common line" in r.text for r in out)
    assert len(out) == len(ids)


CLASH = ["__lang", "__score", "__letter", "__row", "__k", "__h", "__i", "__r", "__bits", "__many", "__text", "__leaks", "ids", "key"]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_with_clashing_names_and_without_rows(spark, tmp_path, empty):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, text(60), "en") for i in range(30)]
    rows += [rows[0], (None, rows[1][1], "en"), (40, None, None), (41, "", "en")]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in CLASH})
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == docs.columns
        else:
            assert set(docs.columns) - {"ids"} < set(out.columns)
        docs = out
    assert sorted(r.doc_id for r in docs.collect()) == ([] if empty else list(range(30)))
    assert empty or docs.select(*[c for c in CLASH if c != "ids"]).distinct().count() == 1
