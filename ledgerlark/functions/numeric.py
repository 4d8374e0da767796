"""Numeric and decision expressions.  Unknown stays null; rounding is half-to-even."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, complete: Column | None = None) -> Column:
    """part / whole; null if undefined or, with ``complete``, if the denominator is not complete."""
    r = F.try_divide(part.cast("double"), whole.cast("double"))
    return r if complete is None else F.when(complete, r)


def delta(before: Column, after: Column, rate: bool) -> Column:
    """after - before; rates in percentage points; null if either is null."""
    return (after - before) * F.lit(100.0 if rate else 1.0)


def half_even(x: Column) -> Column:
    return F.rint(x)


def weighted(signal: Column, weight: Column) -> Column:
    """Contribution of a 1..5 signal, to one decimal."""
    return F.bround((signal / F.lit(5) * weight * F.lit(100)).cast("decimal(20,8)"), 1).cast("double")


def invert_risk(raw: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(5), F.lit(6) - raw))


def grade(score: Column, high: float = 80, mid: float = 65, low: float = 50) -> Column:
    return F.when(score >= high, "High Priority DD").when(score >= mid, "Selective DD").when(score >= low, "Watchlist").otherwise("No DD")


def level(score: Column) -> Column:
    """Follow-up level of a display score."""
    return F.when(score >= 4, "high").when(score == 3, "middle").otherwise("low")


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Equal within the tolerance, nulls equal to each other."""
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


def median_known(x: Column) -> Column:
    """Median, only if every row knows the value."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.median(x))


def nearest_rank(share: float) -> Callable[[Column], Column]:
    """The rank (from 1) of a nearest-rank percentile among n values."""
    return lambda n: F.ceil(F.lit(share).cast("decimal(9,6)") * n)


# --- quantities -------------------------------------------------------------

# Scale words, units and operators of quantity phrases.
SCALES = {"billion": 10**9, "million": 10**6, "억": 10**8, "천만": 10**7, "백만": 10**6, "만": 10**4, "천": 10**3, "": 1}
VAGUE = "(?i)약|대략|approximately|about|~"
DOLLAR, WON = "(?i)USD|미국\\s*달러|달러|\\$", "(?i)KRW|원"
UNITS = [("(?i)TOPS", "TOPS"), ("(?i)배|ratio", "ratio"), ("(?i)곳|companies", "companies"), ("명", "people"), ("개", "items"), ("%", "percent"), ("(?i)W\\b", "W")]
OPERATORS = [("(?i)이상|at least|>=", "ge"), ("(?i)이하|at most|<=", "le"), ("(?i)초과|over|more than|>", "gt"), ("(?i)미만|less than|<", "lt")]
NUMBER = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*(billion|million|천만|백만|억|만|천)?"


def _first(text: Column, table: list[tuple[str, str]], other: Column) -> Column:
    out = None
    for pattern, name in table:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def quantity(text: Column) -> Column:
    """STRUCT<value DECIMAL(38,6), unit, op> of an explicit quantity phrase, else null.

    Vague phrases, phrases without a unit, and several numbers that are not
    parts of one amount (a currency, every part with a scale word) are null.
    """
    numbers = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    scales = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(2)), F.lower)
    factor = F.create_map(*[F.lit(x) for k, v in SCALES.items() for x in (k, v)])
    parts = F.zip_with(numbers, scales, lambda n, s: (F.replace(n, F.lit(","), F.lit("")).cast("decimal(24,6)") * F.element_at(factor, s).cast("decimal(12,0)")).cast("decimal(38,6)"))
    value = F.aggregate(parts, F.lit(0).cast("decimal(38,6)"), lambda a, b: (a + b).cast("decimal(38,6)"))
    currency = F.when(text.rlike(DOLLAR), "USD").when(text.rlike(WON), "KRW")
    unit = _first(text, UNITS, currency)
    loose = (F.size(numbers) > 1) & (currency.isNull() | F.exists(scales, lambda s: s == ""))
    known = text.isNotNull() & (text != "") & ~text.rlike(VAGUE) & (F.size(numbers) > 0) & ~loose & unit.isNotNull()
    return F.when(known, F.struct(value.alias("value"), unit.alias("unit"), _first(text, OPERATORS, F.lit("eq")).alias("op")))


def numeric_relation(claim: Column, reference: Column, lower_bound: Column | None = None) -> Column:
    """supports / contradicts / insufficient for two :func:`quantity` structs.

    ``lower_bound`` reads the reference as "more than".
    """
    cv, cu, co = claim["value"], claim["unit"], claim["op"]
    rv, ru, ro = reference["value"], reference["unit"], reference["op"]
    if lower_bound is not None:
        ro = F.when(lower_bound, "gt").otherwise(ro)
    # A null end is unbounded.
    lo = lambda v, o: F.when(o.isin("eq", "gt", "ge"), v)
    hi = lambda v, o: F.when(o.isin("eq", "lt", "le"), v)
    cl, ch, rl, rh = lo(cv, co), hi(cv, co), lo(rv, ro), hi(rv, ro)
    ci, ri = co.isin("eq", "ge", "le"), ro.isin("eq", "ge", "le")
    off = lambda a, b, closed: F.coalesce((a < b) | ((a == b) & ~closed), F.lit(False))
    apart = off(ch, rl, ci & ri) | off(rh, cl, ri & ci)
    low_in = cl.isNull() | F.coalesce((cl < rl) | ((cl == rl) & (ci | ~ri)), F.lit(False))
    high_in = ch.isNull() | F.coalesce((ch > rh) | ((ch == rh) & (ci | ~ri)), F.lit(False))
    money = cu.isin("USD", "KRW") & ru.isin("USD", "KRW")
    return (
        F.when(claim.isNull() | reference.isNull(), "insufficient")
        .when(cu != ru, F.when(money, "contradicts").otherwise("insufficient"))
        .when((co == "eq") & (ro == "eq"), F.when(cv == rv, "supports").otherwise("contradicts"))
        .when(apart, "contradicts")
        .when(low_in & high_in, "supports")
        .otherwise("insufficient")
    )


# --- cost -------------------------------------------------------------------


def cost(cached: Column, provider: Column, kind: Column, ok: Column, per_call: Column, tokens_in: Column, tokens_cached: Column, tokens_out: Column, price_in: Column, price_cached: Column, price_out: Column) -> Column:
    """Cost of one call; null where a part is unknown."""
    per_token = ((tokens_in - tokens_cached) * price_in + tokens_cached * price_cached + tokens_out * price_out) / F.lit(1e6)
    return F.when(F.coalesce(cached, F.lit(False)) | (provider == "local"), F.lit(0.0)).when((kind == "search") & ok, per_call).when(kind == "llm", per_token)


def tolerant_equal(a: Column, b: Column, a_kind: str, b_kind: str, tolerance: float = 1e-9) -> Column:
    """Equal numbers within the tolerance, other values exactly; a boolean never equals a number."""
    number = lambda k: k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal")
    if number(a_kind) and number(b_kind):
        return close(a, b, tolerance)
    return a.eqNullSafe(b) if a_kind == b_kind else F.lit(False)


def non_support(faithfulness: Column, status: Column) -> Column:
    """1 - faithfulness of a completed measurement."""
    return F.when(status == "completed", 1 - faithfulness)


def token_counts(usage: Column) -> Column:
    """STRUCT<input, output, cached> of a provider's usage JSON; the first name that is there counts, null is not zero."""
    first = lambda *paths: F.coalesce(*[F.get_json_object(usage, f"$.{p}") for p in paths]).cast("long")
    return F.struct(
        first("input_tokens", "prompt_tokens").alias("input"),
        first("output_tokens", "completion_tokens").alias("output"),
        first("input_token_details.cache_read", "prompt_tokens_details.cache_read", "prompt_tokens_details.cached_tokens").alias("cached"),
    )


def threshold_problem(threshold: Column, top_k: Column, low: int, high: int, grade_high: Column | None = None) -> Column:
    """What is wrong with a policy's settings; null if they make sense."""
    out = F.when(threshold.isNull() | ~threshold.between(low, high), "threshold outside policy scale").when(top_k.isNull() | (top_k < 1), "top_k must be a positive integer")
    if grade_high is not None:
        ordered = (threshold >= 50) & (threshold <= grade_high) & (grade_high <= 100)
        out = out.when(~F.coalesce(ordered, F.lit(False)), "target grade thresholds must be ordered")
    return out
