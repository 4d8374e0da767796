"""The corpus pipeline: documents in, encoded clean documents out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; ``run`` writes each stage's result as Parquet to the folder that
all machines share and reads it again for the next one.

Defined results, for every stage: an empty table gives an empty one of the same
columns; extra columns of any name pass through; the last stage's own columns
replace equal names.  A null or blank text goes at the first stage.  Of rows
that are equal in all columns the near-duplicate stage keeps one; ties between
copies go to the least id, null ids last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import decontaminate, langid, line_dedup, near_dedup, spm
from ledgerlark.llm.rows import unused
from ledgerlark.llm.shared import stored

#: A document whose language is predicted with less is rejected; guessing among four gives 0.25.
MIN_SCORE = 0.3
MIN_LINE_DOCS = 10


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters (null, empty) or with an undecided prediction go.

    Equal texts get equal decisions; a table without any labelled row rejects all.
    """
    net = langid.learn(docs)
    lang, score = unused(docs, "__lang"), unused(docs, "__score")
    found = langid.predict(docs, net, out=(lang, score))
    return found.filter((F.col(lang) != "und") & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share; a document left without text goes.

    Repeated rows count as documents of their own; ``n_chars`` follows the text.
    """
    out = line_dedup.dedup_lines(docs, min_chars=1, min_docs=MIN_LINE_DOCS).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return _counted(out.select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the least id, null ids last; a text without words is a class of its own."""
    return near_dedup.without_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty items match nothing."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, token count, decoded text and parity, which replace columns of these names."""
    return spm.encode(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars after the text has changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("sentencepiece", encoded),
]

#: Trained and sampled stages have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
