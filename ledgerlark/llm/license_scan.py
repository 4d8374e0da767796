"""License scan by diagonal voting.

All rolling word k-gram hashes of a document are joined to the positions of
the same k-grams in the templates.  A hit votes for the diagonal (position in
the document minus position in the template).  A diagonal may hold several
copies, or the two ends of one, so its votes are split into runs of
neighbouring places.  Runs of one template are chained: a run may follow one
that ends before it in the document and in the template and whose diagonal
differs by at most ``drift``, up (inserted words) or down (lost words); what
overlaps counts once.  The best chain is the span, and it is verified by the
share of the template's k-grams that it holds in order.

Phrases are templates that must stand whole: a run with every k-gram of the
phrase is one exact place.

The template table is broadcast after a check of its size (``BROADCAST_GRAMS``
rows); larger template sets use a shuffled join.  Documents are never joined
with each other or with themselves: after the join only hits are shuffled, by
document.  Runs that are too far apart to follow each other are parted before
any list is made, and lists without enough votes are not chained.

Defined results: null text counts as empty; repeated rows each get their own
row; null ids pass through; documents without words have n_words 0, no labels
and score 0; other columns of ``docs`` are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.batches import bounded
from ledgerlark.llm import kernels as K

GRAM = 3
DRIFT = 4
MIN_SHARE = 0.6
BROADCAST_GRAMS = 1_000_000
SEED = 3

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Customary notice sentences and the labels that the scan adds.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}


def grams(words: list[str], seed: int = SEED) -> list[int]:
    """The k-gram hashes that documents with the same words have."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return [int(x) for x in _grams(data, np.array([0, len(data)]), seed)[1].view(np.int64)]


def _grams(data, offsets, seed=SEED):
    """Word offsets of the rows; k-gram hashes by first word (some cross rows)."""
    data = np.where((data >= ord("A")) & (data <= ord("Z")), data | 32, data).astype(np.uint8)
    start, end, at = K.words(data, offsets, K.WORD)
    if len(start) < GRAM:
        return at, np.zeros(0, np.uint64)
    return at, K.rolling_hash(K.running(K.strong_hashes(data, start, end, seed)), GRAM)


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(gram, tid, tpos, tlen, label, exact) for each k-gram of each template."""
    rows = []
    for tid, (text, label, exact) in enumerate([(t, x, True) for t, x in phrases.items()] + [(t, x, False) for t, x in notices.items()]):
        words = text.split()
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {text!r}")
        rows += [(g, tid, i, len(words), label, exact) for i, g in enumerate(grams(words))]
    out = spark.createDataFrame(rows, "gram long, tid int, tpos int, tlen int, label string, exact boolean")
    return F.broadcast(out) if len(rows) <= BROADCAST_GRAMS else out


def best_chain(runs: Column, reach: Column, drift: int) -> Column:
    """Votes of the best chain of ``runs``, structs (lo, hi, tlo, thi) sorted by place; only runs within ``reach`` places are kept open."""

    def follow(state: Column, run: Column) -> Column:
        diagonal, size = run["lo"] - run["tlo"], run["hi"] - run["lo"] + 1
        over = lambda o: F.greatest(F.lit(0), o["hi"] - run["lo"] + 1, o["thi"] - run["tlo"] + 1)
        before = F.filter(state["open"], lambda o: (F.abs(o["diagonal"] - diagonal) <= drift) & (over(o) < size) & (o["hi"] < run["hi"]) & (o["thi"] < run["thi"]))
        votes = F.greatest(size, size + F.coalesce(F.array_max(F.transform(before, lambda o: o["votes"] - over(o))), F.lit(0)))
        still = F.filter(state["open"], lambda o: o["hi"] + reach >= run["lo"])
        ended = F.struct(run["hi"].alias("hi"), run["thi"].alias("thi"), diagonal.alias("diagonal"), votes.alias("votes"))
        return F.struct(F.greatest(state["best"], votes).alias("best"), F.concat(still, F.array(ended)).alias("open"))

    none = F.from_json(F.lit('{"best": 0, "open": []}'), "best int, open array<struct<hi: int, thi: int, diagonal: int, votes: int>>")
    start = F.struct(F.coalesce(none["best"], F.lit(0)).alias("best"), none["open"].alias("open"))
    return F.aggregate(runs, start, follow, lambda state: state["best"])


def joined_labels(column: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(column)), ",")


def label_documents(docs: DataFrame, phrases: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, text: str = "text", doc_id: str = "doc_id", drift: int = DRIFT, min_share: float = MIN_SHARE) -> DataFrame:
    """One row for each row of ``docs``: counts, places, labels and score.

    The row of a document's first k-gram (or its empty row) runs along with the
    hits, so the totals need no join back to the documents.
    """
    spark = docs.sparkSession
    source = docs.select(F.monotonically_increasing_id().alias("__uid"), docs[doc_id].alias("__id"), docs[text].alias("__text"))

    def run(batches):
        for batch in batches:
            column = batch.column("__text")
            for i, j in K.slices(column):
                data, offsets = K.columns_bytes(column.slice(i, j - i))
                at, hashes = _grams(data, offsets)
                n = np.diff(at)
                inner = np.maximum(n - GRAM + 1, 0)
                to = np.append(0, np.cumsum(inner))
                pick = np.repeat(at[:-1] - to[:-1], inner) + np.arange(to[-1])
                lists = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(hashes[pick].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("__uid").slice(i, j - i), batch.column("__id").slice(i, j - i), pa.array(n, pa.int64()), lists], names=["__uid", "doc_id", "n_words", "grams"])

    kind = source.schema["__id"].dataType.simpleString()
    rows = bounded(source).mapInArrow(run, f"__uid long, doc_id {kind}, n_words long, grams array<long>")
    table = templates(spark, phrases, notices)
    exploded = rows.select("__uid", "doc_id", "n_words", F.posexplode_outer("grams").alias("pos", "gram"))
    # The first k-gram's row (or the empty row) stands for the document itself.
    head = F.coalesce(F.col("pos"), F.lit(0)) == 0
    hits = exploded.join(table, "gram", "left").filter(F.col("tid").isNotNull() | head)
    keys = ["__uid", "doc_id", "n_words", "tid"]
    votes = hits.groupBy("__uid", "doc_id", "n_words", F.coalesce("tid", F.lit(-1)).alias("tid"), F.coalesce(F.col("pos") - F.col("tpos"), F.lit(0)).alias("diagonal")).agg(
        F.collect_set("tpos").alias("at"), F.max("tlen").alias("tlen"), F.max("label").alias("label"), F.max("exact").alias("exact")
    )
    # A diagonal's places lie within the template, so these arrays are no longer than it.
    at = F.array_sort("at")
    first = F.filter(at, lambda x: ~F.array_contains("at", x - 1))
    last = F.filter(at, lambda x: ~F.array_contains("at", x + 1))
    runs = votes.select(*keys, "diagonal", "tlen", "label", "exact", F.inline_outer(F.arrays_zip(first.alias("tlo"), last.alias("thi"))))
    runs = runs.withColumns({"lo": F.col("diagonal") + F.col("tlo"), "hi": F.col("diagonal") + F.col("thi")})
    ordered = Window.partitionBy(*keys).orderBy("lo", "tlo")
    reached = F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    reach = F.col("tlen") + drift
    apart = F.coalesce(F.col("exact") | (F.col("lo") - reached > reach), F.lit(True)).cast("int")
    part = F.sum("apart").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    size = F.col("thi") - F.col("tlo") + 1
    spans = runs.withColumn("apart", apart).withColumn("part", part).groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.when(F.col("lo").isNotNull(), F.struct("lo", "tlo", "hi", "thi")))).alias("runs"), F.sum(size).alias("votes"), F.min("diagonal").alias("diagonal"), F.max("tlen").alias("tlen"), F.max("label").alias("label"), F.max("exact").alias("exact")
    )
    whole = F.col("tlen") - GRAM + 1
    chained = F.when(F.col("exact"), F.col("votes")).when(F.col("votes") >= whole * min_share, best_chain(F.col("runs"), reach, drift)).otherwise(0)
    merged = spans.withColumn("share", F.least(F.lit(1.0), chained / whole))
    place = F.col("exact") & (F.col("share") == 1.0)
    good = place | (~F.col("exact") & (F.col("share") >= min_share))
    return (
        merged.groupBy("__uid", "doc_id", "n_words")
        .agg(
            F.count(F.when(place, 1)).alias("n_base"),
            F.min(F.when(place, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(place, F.col("diagonal"))).cast("long").alias("last_word"),
            joined_labels(F.collect_set(F.when(place, F.col("label")))).alias("base_labels"),
            joined_labels(F.collect_set(F.when(good, F.col("label")))).alias("labels"),
            F.coalesce(F.max(F.when(good, F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .drop("__uid")
    )
