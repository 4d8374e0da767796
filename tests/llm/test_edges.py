"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import bwt_dedup, decontaminate, langid, license_scan, line_dedup, media, near_dedup, pii, spm, substring_dedup

LONG = "the quick brown fox jumps over the lazy dog and runs away from 4111 1111 1111 1111 people " * 4000
ROWS = [
    (1, "Hello there, this is a small text about nothing.\nline two", "en"),
    (1, "Hello there, this is a small text about nothing.\nline two", "en"),
    (2, None, "en"),
    (3, "", None),
    (None, "A text without an id, in English words.", "en"),
    (None, None, None),
    (4, LONG, "en"),
    (5, LONG + "tail", "en"),
    (6, " \n\t\n ", "de"),
    (7, "日本語のテキスト 😀 \u0000 ünï", "ja"),
    (8, "12345", "en"),
]
CLASH = ["n_values", "kinds", "pos", "bits", "i", "r", "a", "b", "anchor", "content", "ids", "decoded", "score", "lang_pred", "key", "label", "m", "doc_text"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (None, None), (2, ""), (3, "one two")], "item_id long, text string")


OPERATORS = {
    "pii": lambda d, b: pii.pseudonyms(d, b"k"),
    "decontaminate": lambda d, b: decontaminate.find_leaks(d, b),
    "license": lambda d, b: license_scan.label_documents(d),
    "spm": lambda d, b: spm.encode(d),
    "spm digest": lambda d, b: spm.encode(d, digest=True),
    "langid": lambda d, b: langid.predict(d, langid.learn(d)),
    "bwt": lambda d, b: bwt_dedup.dedup_bytes(d),
    "lines": lambda d, b: line_dedup.dedup_lines(d),
    "lines repeat": lambda d, b: line_dedup.dedup_lines(d, rule="repeat"),
    "substring": lambda d, b: substring_dedup.dedup_substrings(d),
    "media": lambda d, b: media.media_columns(d),
    "near": lambda d, b: near_dedup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(name, docs, bench):
    out = OPERATORS[name](docs, bench)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out.select("doc_id").collect())
    assert ids == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, docs, bench):
    assert OPERATORS[name](docs.limit(0), bench).collect() == []


@pytest.mark.parametrize("name", ["pii", "decontaminate", "lines", "spm"])
def test_extra_columns_stay(name, docs, bench):
    out = OPERATORS[name](docs, bench)
    assert {"pos", "i", "a", "key"} <= set(out.columns)
    assert out.select("pos", "i", "a", "key").distinct().collect() == [(7, 7, 7, 7)]


def test_without_near_duplicates_keeps_one_of_each(docs):
    out = near_dedup.without_near_duplicates(docs)
    assert out.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
    assert len(rows) == 9  # one of the equal rows and one of the two long texts are gone
    assert sum(t is not None and t.startswith("Hello") for _, t in rows) == 1
    assert [i for i, t in rows if t and t.startswith("the quick")] == [4]


def test_null_text_results(docs):
    kept = {(r.doc_id, r.n_removed) for r in bwt_dedup.dedup_bytes(docs).collect()}
    assert (2, 0) in kept
    got = [r for r in langid.predict(docs, langid.learn(docs)).collect() if r.doc_id in (2, 3, 6, 8)]
    assert len(got) == 4
    assert all(r.lang_pred == "und" and r.score == 0 for r in got)
    empty = hashlib.sha256(bytes(64)).hexdigest()
    assert {r.payload_sha256 for r in media.media_columns(docs).collect() if r.doc_id in (2, 3)} == {empty}
    assert {(r.text, r.n_values) for r in pii.pseudonyms(docs, b"k").collect() if r.doc_id == 2} == {(None, 0)}


def test_long_texts_whole(docs, bench):
    leaks = {r.doc_id: len(r["__leaks"]) for r in decontaminate.find_leaks(docs, bench).collect() if r.doc_id in (4, 5)}
    assert leaks == {4: 1, 5: 1}
    found = {r.doc_id: r.n_values for r in pii.pseudonyms(docs, b"k").collect() if r.doc_id in (4, 5)}
    assert found == {4: 4000, 5: 4000}
    words = {r.doc_id: r.n_words for r in license_scan.label_documents(docs).collect() if r.doc_id == 4}
    assert words == {4: len(re.findall(r"\w+", LONG))}


@pytest.mark.parametrize("name", ["bwt", "lines", "substring", "near"])
def test_ids_that_are_no_integers_are_refused(name, docs, bench):
    with pytest.raises(TypeError, match="integer"):
        OPERATORS[name](docs.withColumn("doc_id", F.col("doc_id").cast("string")), bench)
