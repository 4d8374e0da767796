"""Entity scoring: signals to contributions, score, grade, ranking and branch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import grade, half_even, invert_risk, weighted
from ledgerlark.operators.ordered import global_rank, top_k

SIGNALS = ("technology", "market", "traction", "team", "competition", "risk")
# Weights by stage.
STAGE_WEIGHTS = {
    "Seed": {"team": 0.30, "market": 0.25, "technology": 0.25, "traction": 0.05, "competition": 0.10, "risk": 0.05},
    "Series A": {"team": 0.25, "market": 0.20, "technology": 0.25, "traction": 0.15, "competition": 0.10, "risk": 0.05},
    "Series B": {"team": 0.20, "market": 0.20, "technology": 0.20, "traction": 0.25, "competition": 0.10, "risk": 0.05},
    "Series C+": {"team": 0.15, "market": 0.15, "technology": 0.15, "traction": 0.25, "competition": 0.15, "risk": 0.15},
}
# Words that make a piece of evidence strong.
STRONG = ("customer", "partner", "founder", "patent", "benchmark", "funding", "pilot", "design partner", "foundry", "revenue")


@dataclass(frozen=True)
class Policy:
    """``separate_market``: market and traction contribute with their own weights, not averaged first."""

    separate_market: bool = False
    threshold: int = 65
    high: int = 80
    low: int = 50
    k: int = 3
    weights: dict = field(default_factory=lambda: STAGE_WEIGHTS)


BASELINE, TARGET = Policy(), Policy(separate_market=True)


def weight_table(spark: SparkSession, policy: Policy) -> DataFrame:
    """One row a stage, of fixed size; the weights must sum to one."""
    for stage, w in policy.weights.items():
        if abs(sum(w.values()) - 1) > 1e-9:
            raise ValueError(f"weights of {stage} do not sum to 1")
    return spark.createDataFrame([(s, *(w[x] for x in SIGNALS)) for s, w in policy.weights.items()], "stage string, " + ", ".join(f"w_{x} double" for x in SIGNALS))


def score(entities: DataFrame, policy: Policy = BASELINE) -> DataFrame:
    """Entities (stage and one signal a column) with display scores, contributions, final score and grade.

    A stage without weights leaves the score null.
    """
    s = lambda x: F.col(f"{x}_signal")
    w = lambda x: F.col(f"w_{x}")
    market = half_even((s("market") + s("traction")) / 2)
    risk = invert_risk(s("risk"))
    if policy.separate_market:
        part = F.bround((s("market") / 5 * w("market") * 100 + s("traction") / 5 * w("traction") * 100).cast("decimal(20,8)"), 1).cast("double")
    else:
        part = weighted(market, w("market") + w("traction"))
    parts = {"technology": weighted(s("technology"), w("technology")), "market": part, "team": weighted(s("team"), w("team")), "competition": weighted(s("competition"), w("competition")), "risk": weighted(risk, w("risk"))}
    joined = entities.join(F.broadcast(weight_table(entities.sparkSession, policy)), "stage", "left")
    total = half_even(sum(parts.values(), F.lit(0.0))).cast("int")
    out = joined.select(*entities.columns, market.cast("int").alias("market_score"), risk.cast("int").alias("risk_score"), *[c.alias(f"{x}_part") for x, c in parts.items()], total.alias("final_score"))
    return out.withColumn("grade", grade(F.col("final_score"), policy.high, policy.threshold, policy.low))


def unknown_stages(entities: DataFrame, policy: Policy = BASELINE) -> DataFrame:
    """Entities whose stage has no weights; must be empty before their scores are used."""
    return entities.join(F.broadcast(weight_table(entities.sparkSession, policy)), "stage", "left_anti")


def rank(scored: DataFrame, position: str, policy: Policy = BASELINE) -> DataFrame:
    """Stable ranking: rank by score, ties by input position; passed, top and watchlist flags; branch."""
    out = global_rank(scored, [F.desc("final_score"), F.col(position)])
    passed = F.col("final_score") >= policy.threshold
    any_passed = scored.agg(F.coalesce(F.max(passed), F.lit(False)).alias("__any"))
    out = out.withColumns({"passed": passed, "watchlist": F.col("grade") == "Watchlist"}).withColumn("top", F.col("passed") & (F.col("rank") <= policy.k))
    return out.crossJoin(F.broadcast(any_passed)).withColumn("branch", F.when(F.col("__any"), "top3").otherwise("hold")).drop("__any")


def top(scored: DataFrame, position: str, policy: Policy = BASELINE) -> DataFrame:
    """The top of the passing rows; without a global sort."""
    return top_k(scored.filter(F.col("final_score") >= policy.threshold), [F.desc("final_score"), F.col(position)], policy.k)


def sum_scale(entities: DataFrame, dimensions: list[str], position: str, threshold: int = 20, k: int = 3) -> DataFrame:
    """Sum of 1..5 dimensions; selected: the k best at or above the threshold; hold: all others."""
    total = sum((F.col(d) for d in dimensions), F.lit(0)).cast("int")
    scored = entities.withColumn("total_score", total)
    best = top_k(scored.filter(F.col("total_score") >= threshold), [F.desc("total_score"), F.col(position)], k).select(F.col(position).alias("__p"), "rank")
    out = scored.join(F.broadcast(best), F.col(position) == F.col("__p"), "left").drop("__p")
    return out.withColumn("decision", F.when(F.col("rank").isNotNull(), "selected").when(F.col("total_score") >= threshold, "hold: outside the top").otherwise("hold: below the threshold"))


#: The six dimensions of the sum scale, in the order in which they are asked.
DIMENSIONS = ("technology", "market", "business", "team", "risk", "competition")


def dimension_requests(companies: DataFrame, templates: dict[str, str]) -> DataFrame:
    """One row a company and dimension: the columns of ``companies``, dimension, request.

    companies(domain, company, context); a template has {domain}, {company} and
    {context}, each replaced as text, a null one by nothing.
    """
    filled = []
    for name in DIMENSIONS:
        text = F.lit(templates[name])
        # The context goes last: braces in it are text.
        for part in ("domain", "company", "context"):
            text = F.replace(text, F.lit("{" + part + "}"), F.coalesce(F.col(part).cast("string"), F.lit("")))
        filled.append(F.struct(F.lit(name).alias("dimension"), text.alias("request")))
    return companies.withColumn("__d", F.explode(F.array(*filled))).select("*", "__d.*").drop("__d")


def rank_companies(companies: DataFrame, replies: DataFrame, position: str) -> DataFrame:
    """``companies`` with a score a dimension, total_score, rank and problem.

    replies(company, dimension, score): one a dimension, 1 to 5.  A company with
    a missing, repeated or impossible score has no total and no rank, and its
    problem; the others are ranked by total, ties by ``position``.
    """
    fine = F.when(F.col("score").between(1, 5), F.col("score"))
    cells = [c for d in DIMENSIONS for c in (F.count_if(F.col("dimension") == d).alias(f"__{d}"), F.max(F.when(F.col("dimension") == d, fine)).cast("int").alias(f"{d}_score"))]
    j = companies.join(replies.groupBy("company").agg(*cells), "company", "left")
    each = lambda make: F.array_compact(F.array(*[F.when(make(d), d) for d in DIMENSIONS]))
    repeated = each(lambda d: F.col(f"__{d}") > 1)
    absent = each(lambda d: F.col(f"{d}_score").isNull())
    problem = F.when(F.size(repeated) > 0, F.concat(F.lit("repeated: "), F.array_join(repeated, ", "))).when(F.size(absent) > 0, F.concat(F.lit("no score: "), F.array_join(absent, ", ")))
    j = j.withColumn("problem", problem).withColumn("total_score", F.when(F.col("problem").isNull(), sum((F.col(f"{d}_score") for d in DIMENSIONS), F.lit(0)))).drop(*[f"__{d}" for d in DIMENSIONS])
    whole = global_rank(j.filter("problem is null"), [F.desc("total_score"), F.col(position)])
    return whole.unionByName(j.filter("problem is not null").withColumn("rank", F.lit(None).cast("long")))


def evidence_signal(entities: DataFrame, evidence: DataFrame, keys: list[str], text: str, fallback: str, words: tuple = STRONG) -> DataFrame:
    """Signal 2..5 of each entity from its evidence; ``fallback`` column where there is none."""
    low = F.lower(text)
    strong = F.exists(F.array(*map(F.lit, words)), lambda x: F.contains(low, x))
    n = evidence.groupBy(*keys).agg(F.count_if(strong).alias("n_strong"), F.count_if(~strong & (F.length(text) > 80)).alias("n_medium"))
    joined = entities.join(n, keys, "left")
    s, m = F.col("n_strong"), F.col("n_medium")
    signal = F.when(s.isNull(), F.col(fallback)).when(s >= 4, 5).when((s >= 2) | (m >= 4), 4).when((s >= 1) | (m >= 2), 3).otherwise(F.greatest(F.lit(2), F.col(fallback) - 1))
    return joined.withColumn("signal", signal.cast("int")).fillna(0, ["n_strong", "n_medium"])


def research_notes(scored: DataFrame, floor: int = 4) -> DataFrame:
    """Which dimensions get one round of more research; the scores stay."""
    need = F.array_compact(F.array(F.when(F.col("technology_signal") < floor, "technology"), F.when(F.col("market_score") < floor, "market")))
    return scored.withColumn("research", need)


def rule_checks(scored: DataFrame, ident: str, policy: Policy = BASELINE) -> DataFrame:
    """Long table of checks: each stored value against an independent recomputation."""
    inputs = [*(f"{x}_signal" for x in SIGNALS), "stage", ident]
    again = score(scored.select(*inputs), policy).select(F.col(ident).alias("__i"), *[F.col(c).alias(f"x_{c}") for c in ("market_score", "risk_score", "final_score", "grade", *(f"{d}_part" for d in ("technology", "market", "team", "competition", "risk")))])
    both = scored.join(again, F.col(ident) == F.col("__i"))
    absent = F.exists(F.array(*[F.col(c).isNull() for c in inputs]), lambda x: x)
    same = lambda c: F.when(absent, "error").when(F.col(c).eqNullSafe(F.col(f"x_{c}")), "pass").otherwise("fail")
    near = lambda c: F.when(absent, "error").when(F.abs(F.col(c) - F.col(f"x_{c}")) <= 1e-9, "pass").otherwise("fail")
    inside = F.when(absent, "error").when(F.forall(F.array(*[F.col(f"{x}_signal") for x in SIGNALS]), lambda v: v.between(1, 5)), "pass").otherwise("fail")
    checks: dict[str, Column] = {"dimension_range": inside, "total_range": F.when(F.col("final_score").between(20, 100), "pass").otherwise("fail"), "signal_market": same("market_score"), "risk_direction": same("risk_score"), "score_formula": same("final_score"), "grade": same("grade")}
    checks |= {f"contribution_{d}": near(f"{d}_part") for d in ("technology", "market", "team", "competition", "risk")}
    pairs = F.array(*[F.struct(F.lit(k).alias("check_id"), v.alias("result")) for k, v in checks.items()])
    return both.select(ident, F.explode(pairs).alias("c")).select(ident, "c.*")


def conformance(checks: DataFrame, by: list[str]) -> DataFrame:
    """pass / applicable; null with any error or missing check."""
    from ledgerlark.functions.numeric import ratio

    r = F.col("result")
    applicable = F.count_if(r != "not_applicable")
    return checks.groupBy(*by).agg(applicable.alias("n_applicable"), F.count_if(r == "pass").alias("n_pass"), ratio(F.count_if(r == "pass"), applicable, F.count_if(r.isin("error", "missing", "pending")) == 0).alias("conformance"))
