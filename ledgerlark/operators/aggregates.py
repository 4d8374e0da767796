"""Roll-ups that keep missing apart from zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import ratio

STATES = ("verified", "contradicted", "unverifiable")


def claim_counts(verdict: str = "verdict", critical: str = "critical", ident: str = "claim_id") -> list[Column]:
    """Counts, rates (null unless every claim is judged) and lists of three-state verdicts."""
    v = F.col(verdict)
    done, total = F.count(v), F.count(F.lit(1))
    out = [total.alias("n_claims"), done.alias("n_judged"), (total - done).alias("n_pending")]
    for s in STATES:
        hit = v == s
        out += [F.count_if(hit).alias(f"n_{s}"), ratio(F.count_if(hit), total, done == total).alias(f"rate_{s}")]
    out += [F.count_if((v == s) & F.col(critical)).alias(f"n_critical_{s}") for s in STATES[1:]]
    return out + [F.array_sort(F.collect_list(F.when((v == s) & F.col(critical), F.col(ident)))).alias(f"ids_critical_{s}") for s in STATES[1:]]


def rollup(frame: DataFrame, sets: list[tuple[str, ...]], measures: list[Column], names: list[str]) -> DataFrame:
    """GROUPING SETS with a ``scope`` column, so a null key is told from a level without the key."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    scope = F.lit(None).cast("string")
    grouped = frame.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    out = grouped.agg(F.grouping_id(*keys).alias("__g"), *measures)
    for s, name in zip(sets, names, strict=True):
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        scope = F.when(F.col("__g") == bits, name).otherwise(scope)
    return out.withColumn("scope", scope).drop("__g")


def three_state_rollup(frame: DataFrame, sets: list[tuple[str, ...]], names: list[str], verdict: str = "verdict", critical: str = "critical", ident: str = "claim_id") -> DataFrame:
    """:func:`rollup` of :func:`claim_counts`.

    Counts are summed over the finest keys first, so that only those rows are
    repeated for each set; lists are made of the few rows that they hold.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    v, listed = F.col(verdict), [f"ids_critical_{s}" for s in STATES[1:]]
    counts = [F.count(F.lit(1)).alias("n_claims"), F.count(v).alias("n_judged"), *[F.count_if(v == s).alias(f"n_{s}") for s in STATES], *[F.count_if((v == s) & F.col(critical)).alias(f"n_critical_{s}") for s in STATES[1:]]]
    finest = frame.groupBy(*keys).agg(*counts)
    sums = rollup(finest, sets, [F.sum(c).alias(c) for c in finest.columns if c not in keys], names)
    some = frame.filter(v.isin(*STATES[1:]) & F.col(critical)).select(*keys, verdict, ident)
    lists = rollup(some, sets, [F.sort_array(F.collect_list(F.when(v == s, F.col(ident)))).alias(f"ids_critical_{s}") for s in STATES[1:]], names)
    lists = lists.withColumnsRenamed({k: f"__{k}" for k in [*keys, "scope"]})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in [*keys, "scope"]])
    done, total = F.col("n_judged"), F.col("n_claims")
    return sums.join(lists, same, "left").select(
        "scope", *keys, "n_claims", "n_judged", (total - done).alias("n_pending"), *[x for s in STATES for x in (F.col(f"n_{s}"), ratio(F.col(f"n_{s}"), total, done == total).alias(f"rate_{s}"))],
        *[f"n_critical_{s}" for s in STATES[1:]], *[F.coalesce(c, F.array().cast(lists.schema[c].dataType)).alias(c) for c in listed],
    )


def macro_micro(frame: DataFrame, group: list[str], unit: list[str], score: str, part: str, whole: str, complete: str) -> DataFrame:
    """Per group: the mean of the units' means, and sum(part)/sum(whole) if all rows are complete.

    share_max and concentrated tell whether one unit holds more than half of
    the denominator (of two units or more).
    """
    per = frame.groupBy(*group, *unit).agg(F.avg(score).alias("__mean"), F.sum(part).alias("__part"), F.sum(whole).alias("__whole"), F.bool_and(complete).alias("__ok"))
    whole_ = F.sum("__whole")
    return per.groupBy(*group).agg(
        F.avg("__mean").alias("macro"), ratio(F.sum("__part"), whole_, F.bool_and("__ok")).alias("micro"), F.count(F.lit(1)).alias("n_units"), F.try_divide(F.max("__whole").cast("double"), whole_.cast("double")).alias("share_max")
    ).withColumn("concentrated", (F.col("share_max") > 0.5) & (F.col("n_units") > 1))


def confusion(frame: DataFrame, human: str, automatic: str, labels: list) -> DataFrame:
    """All cells, zero ones too, with the row's recall and the column's precision."""
    spark = frame.sparkSession
    kind = frame.schema[human].dataType.simpleString()
    cells = spark.createDataFrame([(a, b) for a in labels for b in labels], f"{human} {kind}, {automatic} {kind}")
    counts = frame.groupBy(human, automatic).agg(F.count(F.lit(1)).alias("n"))
    full = cells.join(counts, [human, automatic], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row, column = F.sum("n").over(Window.partitionBy(human)), F.sum("n").over(Window.partitionBy(automatic))
    hit = F.col(human) == F.col(automatic)
    return full.select(human, automatic, "n", row.alias("support"), F.when(hit, ratio(F.col("n"), row)).alias("recall"), F.when(hit, ratio(F.col("n"), column)).alias("precision"))


def known_sum(x: Column, currency: Column) -> Column:
    """Sum if every row is known and there is one currency at most."""
    return F.when((F.count(x) == F.count(F.lit(1))) & (F.count_distinct(currency) <= 1), F.sum(x))


def cache_state(hit: Column) -> Column:
    return F.when(F.bool_or(hit) & ~F.bool_and(hit), "mixed").when(F.bool_and(hit), "warm").when(~F.bool_or(hit), "cold").otherwise("unknown")


def all_equal(value: Column) -> Column:
    """Whether a group has one value only (null is a value)."""
    return F.min(F.struct(value.isNull(), value)) == F.max(F.struct(value.isNull(), value))


def histogram(frame: DataFrame, keys: list[str], status: str) -> DataFrame:
    per = frame.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("counts"))


def item_state() -> Column:
    """State of an item over repeats: not applicable, unjudged, incorrect, fulfilled, missing, in this precedence."""
    return F.when(F.bool_and(~F.col("applicable")), "not_applicable").when(F.bool_or(F.col("status") != "completed"), "unjudged").when(F.bool_or(F.col("verdict") == "incorrect"), "incorrect").when(F.bool_or(F.col("verdict") == "fulfilled"), "fulfilled").otherwise("missing")


def axis_verdict(deltas: list[Column], higher_is_better: list[bool]) -> Column:
    signed = [d if up else -d for d, up in zip(deltas, higher_is_better, strict=True)]
    any_of = lambda cs: F.exists(F.array(*cs), lambda x: x)
    return F.when(any_of([s.isNull() for s in signed]), "incomplete").when(any_of([s < 0 for s in signed]), "regressed").when(any_of([s > 0 for s in signed]), "improved").otherwise("unchanged")
