"""Research set-wise: queries, notes from evidence, evaluations and their texts, references.

The offline path: what a model would rewrite falls back to the fixed texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import half_even, invert_risk, level, weighted
from ledgerlark.functions.text import clean_source, compact, letters, meaningful, once
from ledgerlark.operators.ordered import first_per
from ledgerlark.plans.scoring import STAGE_WEIGHTS

# Search queries of a company, by category, and of a market.
COMPANY_QUERIES = {
    "Team & Founders": "{} founders executives semiconductor startup",
    "Market Attractiveness": "{} ai semiconductor customers target market",
    "Technology & Product": "{} AI accelerator architecture patent benchmark",
    "Traction & Commercialization": "{} design partner pilot customers funding partnership",
    "Competitive Advantage": "{} proprietary architecture patent moat",
    "Execution & Financing Risk": "{} foundry manufacturing funding risk",
}
MARKET_QUERIES = ("{} market size growth report", "{} data center accelerator demand report", "{} venture capital evaluation framework deep tech")
# Texts of a market without usable evidence.
MARKET_SIZE = "AI semiconductor 시장은 생성형 AI 인프라 확장과 데이터센터 수요 증가에 힘입어 구조적 성장세를 보인다."
DRIVERS = ("생성형 AI 추론 수요가 확대되고 있다.", "데이터센터 전력 효율 개선 압력이 커지고 있다.", "GPU 대체형 가속기 수요가 확대되고 있다.")
# Texts of an evaluation by score, its templates by category, and follow-ups by level.
LEVELS = {5: "매우 우수한 편이다", 4: "상대적으로 우수한 편이다", 3: "보통 수준으로 판단된다", 2: "보수적으로 접근할 필요가 있다", 1: "핵심 리스크로 관리해야 한다"}
SUMMARIES = {
    "Technology & Product": "기술 완성도와 제품 차별성은 {}. 추가 벤치마크와 제품 검증 자료 확인이 중요하다.",
    "Market & Traction": "시장 진입 가능성과 초기 트랙션은 {}. 고객 전환과 상용 매출 검증이 필요하다.",
    "Team & Founders": "창업팀과 핵심 인력의 실행 역량은 {}. 핵심 채용과 조직 확장 계획을 추가 확인할 필요가 있다.",
    "Execution & Financing Risk": "실행 및 자금 조달 리스크는 {}. 양산 일정과 자금 소진 계획 점검이 필요하다.",
    "Competitive Advantage": "경쟁 우위와 차별화 요소는 {}. 기술 모방 가능성과 포지셔닝 지속성을 확인해야 한다.",
}
OTHER_SUMMARY = "{0} 평가는 {1}."
FOLLOW_UPS = {"high": "{} 관련 강점을 검증할 수 있는 실제 고객 또는 기술 증빙을 추가 확인한다.", "middle": "{} 관련 불확실성을 해소할 추가 데이터와 인터뷰가 필요하다.", "low": "{}는 핵심 리스크 영역이므로 정밀 실사 이전에 보강 증거 확보가 필요하다."}
EVIDENCE_NOTE = "{} 관련 정성 근거가 확인되며, 세부 검증은 추가 실사가 필요하다."
# Words that show a summary is still the page's own, and the text in its place.
PAGE_WORDS = (" provides ", "receiving a ", " and is currently ")
# The overview of a company without evidence, and what stands for its empty parts.
OVERVIEW = "{0}는 {1}을 중심으로 {2}을 겨냥하는 {3} 스타트업이다."
OVERVIEW_PRODUCT, OVERVIEW_CUSTOMERS = "AI semiconductor 제품", "목표 고객"
DECISION = "%s는 %s 단계에서 DD-Worthiness Score %d점을 기록했으며, %s 의견을 받았다."
DECISION_NOTE = "%s는 %s 단계에서 DD-Worthiness Score %d점을 기록했으며, %s 의견을 받은 투자 검토 대상이다."


def fill(template: str, *values: Column) -> Column:
    """A template with {} places as an expression."""
    return F.format_string(template.replace("%", "%%").replace("{}", "%s").replace("{0}", "%1$s").replace("{1}", "%2$s").replace("{2}", "%3$s").replace("{3}", "%4$s"), *values)


def company_queries(entities: DataFrame, name: str) -> DataFrame:
    """One row a company and category: pos, category, query."""
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("category"), fill(t, F.col(name)).alias("query")) for i, (c, t) in enumerate(COMPANY_QUERIES.items())])
    return entities.select(name, F.explode(rows).alias("q")).select(name, "q.*")


def market_queries(markets: DataFrame, domain: str) -> DataFrame:
    """One row a market and query; a query about a framework has its own category."""
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit("Framework" if "framework" in t else "Industry").alias("category"), fill(t, F.col(domain)).alias("query")) for i, t in enumerate(MARKET_QUERIES)])
    return markets.select(domain, F.explode(rows).alias("q")).select(domain, "q.*")


def latin_dominant(text: Column) -> Column:
    return letters(text, "latin") > letters(text, "hangul")


def localized(text: Column, fallback: Column, limit: int = 320) -> Column:
    """The meaningful part of a text, or the fallback where that is empty or mainly Latin."""
    clean = once(meaningful(text), lambda m: F.coalesce(F.nullif(m, F.lit("")), fallback))
    return compact(once(clean, lambda c: F.when(latin_dominant(c), fallback).otherwise(c)), limit)


def notes(evidence: Column, category: Column, limit: int = 180) -> Column:
    """Evidence texts as short notes: cleaned, mainly Latin ones as the fixed note, each once, in order."""
    clean = F.filter(F.transform(evidence, clean_source), lambda x: x != "")
    return F.array_distinct(F.transform(clean, lambda x: compact(F.when(latin_dominant(x), fill(EVIDENCE_NOTE, category)).otherwise(x), limit)))


def pick(evidence: DataFrame, by: list[str], slot: Column, fallback: Column) -> DataFrame:
    """(by, summary): the first non-empty content of the rows that ``slot`` takes, localised."""
    got = first_per(evidence.filter(slot).filter("content <> ''"), by, [F.col("pos")])
    return got.select(*by, localized(F.col("content"), fallback).alias("summary"))


def market_research(markets: DataFrame, evidence: DataFrame, domain: str) -> DataFrame:
    """One row a market: its size from the first industry evidence, a driver from each of the first three, and references.

    evidence(domain, pos, category, title, url, content), pos from 0.
    """
    out = markets.select(domain).distinct()
    parts = {"market_size": (F.col("category") == "Industry", MARKET_SIZE)} | {f"driver_{i}": (F.col("pos") == i, t) for i, t in enumerate(DRIVERS)}
    for name, (slot, text) in parts.items():
        got = pick(evidence, [domain], slot, F.lit(text)).withColumnRenamed("summary", name)
        out = out.join(got, domain, "left").withColumn(name, F.coalesce(name, F.lit(text)))
    return out.join(references(evidence, domain), domain, "left").fillna({}).withColumn("references", F.coalesce("references", F.array().cast("array<string>")))


#: The summaries of a company: the categories whose evidence makes each, best first, and the profile's column that stands in.
COMPANY_SUMMARIES = {
    "company_overview": (("Technology & Product", "Market Attractiveness"), None),
    "business_model_status": (("Traction & Commercialization",), "business_model"),
    "product_and_technology": (("Technology & Product",), "technology_summary"),
    "traction_summary": (("Traction & Commercialization",), "traction_summary"),
    "team_summary": (("Team & Founders",), "team_summary"),
    "competition_summary": (("Competitive Advantage",), "competition_summary"),
    "risk_summary": (("Execution & Financing Risk",), "risk_summary"),
}


def company_research(profiles: DataFrame, evidence: DataFrame, name: str, by: str | None = None, counted: bool = False) -> DataFrame:
    """One row a company: its stage, seven summaries and references.

    profiles(name, stage, industry, product_summary, customer_focus,
    references and the columns of COMPANY_SUMMARIES); evidence(name, pos,
    category, title, url, content).  A summary is the localised first non-empty
    content of its categories, else the profile's own text; references are the
    evidence's, else the profile's.  The first of each
    category is found once, for all seven.

    Companies that share evidence name its key in the profiles' column ``by``
    (null: none), which ``evidence`` then has in place of the name: each key's
    evidence is read once, however many companies share it.  ``counted`` gives
    n_references in place of the lists, which then are formed nowhere.
    """
    by = by or name
    some = F.col("content") != ""
    found = []
    for out, (categories, _) in COMPANY_SUMMARIES.items():
        place = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
        found.append(F.min_by("content", F.when(some & F.col("category").isin(*categories), F.struct(place, "pos", "content"))).alias(f"__{out}"))
    cited = reference_counts(evidence, by) if counted else references(evidence, by)
    # Dealt by company, into a stated number of parts: a few small ones of many texts would be slow.
    parts = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = evidence.filter(some).groupBy(by, "category").agg(F.min_by("content", F.struct("pos", "content")).alias("content"), F.min("pos").alias("pos"))
    j = profiles.repartition(parts, name).join(best.groupBy(by).agg(*found), by, "left").join(cited.withColumnRenamed(cited.columns[1], "__refs"), by, "left")
    some_text = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    overview = fill(OVERVIEW, F.col(name).cast("string"), some_text("product_summary", OVERVIEW_PRODUCT), some_text("customer_focus", OVERVIEW_CUSTOMERS), F.col("industry"))
    # One expression over a list: seven copies of it would be slow to compile.
    texts = []
    for out, (_, own) in COMPANY_SUMMARIES.items():
        fallback = overview if own is None else F.coalesce(own, F.lit(""))
        texts.append(F.struct(F.coalesce(f"__{out}", fallback).alias("text"), fallback.alias("fallback")))
    j = j.withColumn("__s", F.transform(F.array(*texts), lambda x: localized(x["text"], x["fallback"])))
    cells = [F.col("__s")[i].alias(out) for i, out in enumerate(COMPANY_SUMMARIES)]
    listed = F.coalesce("references", F.array().cast("array<string>"))
    refs = F.coalesce("__refs", F.size(listed).cast("long")).alias("n_references") if counted else F.coalesce("__refs", listed).alias("references")
    return j.select(name, "stage", *cells, refs)


def _cited(evidence: DataFrame, by: str) -> DataFrame:
    """(by, ref, pos): each reference of a key once, at its first place."""
    line = F.concat(F.col("title"), F.lit(" - "), F.col("url"))
    return evidence.groupBy(by, line.alias("ref")).agg(F.min("pos").alias("pos"))


def references(evidence: DataFrame, by: str) -> DataFrame:
    """(by, references): ``title - url`` of each row, each once, in order."""
    return _cited(evidence, by).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("references"))


def reference_counts(evidence: DataFrame, by: str) -> DataFrame:
    """(by, n_references): the lengths of the lists of :func:`references`, without the lists."""
    return _cited(evidence, by).groupBy(by).agg(F.count(F.lit(1)).alias("n_references"))


def merged_references(*lists: Column) -> Column:
    """Lists of references one after another, each reference once."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(x, empty) for x in lists]))


def evaluation_summary(category: Column, score: Column) -> Column:
    """The fixed text of a category and a score of 1 to 5."""
    words = F.element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), score)
    out = F
    for name, template in SUMMARIES.items():
        out = out.when(category == name, fill(template, words))
    return out.otherwise(fill(OTHER_SUMMARY, category, words))


def follow_up(category: Column, score: Column) -> Column:
    grade = level(score)
    out = F
    for name, template in FOLLOW_UPS.items():
        out = out.when(grade == name, fill(template, category))
    return out.otherwise(F.lit(None).cast("string"))


def evaluations(entities: DataFrame, name: str) -> DataFrame:
    """One row a company and dimension: category, score, weighted score, summary, follow-up.

    Columns: stage, the six signals, and <dimension>_summary.  The market's
    score is the mean with traction and its follow-up goes by the raw signal;
    the risk's score is inverted.
    """
    s = lambda x: F.col(f"{x}_signal")
    weight = lambda *parts: F.element_at(F.create_map(*[x for stage, w in STAGE_WEIGHTS.items() for x in (F.lit(stage), F.lit(float(sum(w[p] for p in parts))))]), F.col("stage"))
    risk = invert_risk(s("risk"))
    rows = [
        ("technology", "Technology & Product", s("technology"), weight("technology"), s("technology")),
        ("market", "Market & Traction", half_even((s("market") + s("traction")) / 2).cast("int"), weight("market", "traction"), s("market")),
        ("team", "Team & Founders", s("team"), weight("team"), s("team")),
        ("competition", "Competitive Advantage", s("competition"), weight("competition"), s("competition")),
        ("risk", "Execution & Financing Risk", risk, weight("risk"), risk),
    ]
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(c).alias("category"), x.cast("int").alias("score"), weighted(x, w).alias("weighted_score"), F.coalesce(f"{d}_summary", F.lit("")).alias("own"), follow_up(F.lit(c), g).alias("follow_up")) for d, c, x, w, g in rows])
    out = entities.select(name, F.explode(each).alias("e")).select(name, "e.*")
    text = localized(F.col("own"), F.col("own"))
    summary = F.when(latin_dominant(text) | (text == ""), evaluation_summary(F.col("category"), F.col("score"))).otherwise(text)
    return out.withColumn("summary", summary).drop("own")


def decisions(evaluations_: DataFrame, scored: DataFrame, name: str) -> DataFrame:
    """One row a company: strengths, weaknesses and a summary.

    ``evaluations_`` as from :func:`evaluations`; scored(name, stage,
    final_score, grade, overview, risks).  Strengths are the non-empty summaries
    of technology, market and team; weaknesses the risk's summary and two risks.
    """
    wide = evaluations_.groupBy(name).pivot("dimension", ["technology", "market", "team", "risk"]).agg(F.first("summary"))
    j = scored.join(wide, name)
    shown = lambda t: F.format_string(t, F.col(name).cast("string"), F.col("stage"), F.col("final_score"), F.col("grade"))
    summary = F.coalesce(F.nullif(F.col("overview"), F.lit("")), shown(DECISION))
    page = F.exists(F.array(*map(F.lit, PAGE_WORDS)), lambda w: F.contains(summary, w))
    strengths = F.slice(F.filter(F.array("technology", "market", "team"), lambda x: x != ""), 1, 3)
    return j.select(name, strengths.alias("strengths"), F.concat(F.array("risk"), F.slice("risks", 1, 2)).alias("weaknesses"), F.when(page, shown(DECISION_NOTE)).otherwise(summary).alias("summary"))


def evidence_documents(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Evidence with text as documents: page is the place among all rows of its key, from 1, so gaps stay."""
    return evidence.withColumn("page", F.col("pos") + 1).filter("content <> ''").select(*by, "page", F.col("content").alias("page_content"), F.struct("title", "url", "category").alias("metadata"))


def formatted_documents(documents: DataFrame, by: list[str]) -> DataFrame:
    """(by, context): the documents in order, each under its source."""
    line = F.concat(F.lit("[Source: "), "metadata.title", F.lit(", page "), F.col("page").cast("string"), F.lit("]\n"), "page_content")
    return documents.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))
