"""Reports: Markdown from scored rows, and rows back from Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.plans.retrieval import markdown_units

HEADER = ("Rank", "Company", "Stage", "Final Score", "Grade")


def cell(x: Column) -> Column:
    """Text of a table cell: no line ends, pipes escaped, null as a dash."""
    return F.coalesce(F.replace(F.regexp_replace(x.cast("string"), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|")), F.lit("-"))


def row_line(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in cells]), F.lit(" |"))


def ranking_table(ranked: DataFrame, name: str) -> DataFrame:
    """(line_no, line) of the ranking table; rows of a bounded top, or distributed for a whole table."""
    body = ranked.select(F.col("rank").alias("line_no"), row_line([F.col("rank"), F.col(name), F.col("stage"), F.col("final_score"), F.col("grade")]).alias("line"))
    head = ranked.sparkSession.createDataFrame([(-1, "| " + " | ".join(HEADER) + " |"), (0, "|" + " --- |" * len(HEADER))], "line_no long, line string")
    return head.unionByName(body)


def scorecard(scored: DataFrame, name: str) -> DataFrame:
    """One Markdown section for each entity: contributions, narrative and gaps."""
    parts = ("technology", "market", "team", "competition", "risk")
    tech = F.when(F.col("technology_signal") >= 4, "The technology is a clear strength.").otherwise("The technology needs more proof.")
    market = F.when(F.col("market_score") >= 4, "The market is open and growing.").otherwise("Access to the market is still to be shown.")
    risk = F.when(F.col("risk_score") <= 2, "The risks are hard to manage.").otherwise("The risks look manageable.")
    table = F.concat_ws("\n", F.lit("| Dimension | Contribution |"), F.lit("| --- | --- |"), *[row_line([F.lit(p), F.col(f"{p}_part")]) for p in parts])
    head = F.format_string("## %s (%s)\n\nFinal Score %d, %s", F.col(name).cast("string"), F.col("stage"), F.col("final_score"), F.col("grade"))
    return scored.select(name, F.concat_ws("\n\n", head, table, F.concat_ws(" ", tech, market, risk)).alias("section"))


def top_report(ranked: DataFrame, name: str, k: int = 3) -> str:
    """The report of the k best, or the hold report if none passed; what is collected is bounded by k."""
    best = ranked.filter("top").orderBy("rank").limit(k)
    sections = [r.section for r in scorecard(best, name).join(best.select(F.col(name).alias("__n"), "rank"), F.col(name) == F.col("__n")).orderBy("rank").collect()]
    if not sections:
        closest = ranked.orderBy("rank").limit(k).select(name, "final_score").collect()
        return "# Hold\n\nNo entity reached the threshold. Closest:\n\n" + "\n".join(f"- {r[0]}: {r[1]}" for r in closest)
    table = "\n".join(r.line for r in ranking_table(best, name).orderBy("line_no").collect())
    return "# Recommendation\n\n" + table + "\n\n" + "\n\n".join(sections)


def table_rows(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, line, cells): each body row of each Markdown table, as a map from header to cell."""
    split = lambda c: F.transform(F.split(F.regexp_replace(F.regexp_replace(c, r"^\s*\|", ""), r"\|\s*$", ""), r"(?<!\\)\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))
    rows = markdown_units(docs, ident, text).filter((F.col("kind") == "table") & (F.col("content") != F.col("header")))
    head, cells = split(F.col("header")), split(F.col("content"))
    return rows.filter(F.size(head) == F.size(cells)).select(ident, "line", F.map_from_arrays(F.transform(head, lambda h, i: F.when(F.array_position(head, h) == i + 1, h).otherwise(F.concat(h, F.lit(" "), i.cast("string")))), cells).alias("cells"))


def check_tables(reports: DataFrame, ident: str, text: str, scored: DataFrame, name: str) -> DataFrame:
    """Each ranking row of the reports against the scored rows: pass, fail, or unknown entity."""
    rows = table_rows(reports, ident, text).filter("cells['Company'] is not null and cells['Final Score'] is not null")
    want = scored.select(F.col(name).cast("string").alias("__n"), F.col("final_score").cast("string").alias("__s"), "rank", "stage", "grade")
    same = (F.expr("cells['Final Score']") == F.col("__s")) & F.coalesce(F.expr("cells['Rank']") == F.col("rank").cast("string"), F.lit(True)) & F.coalesce(F.expr("cells['Stage']") == F.col("stage"), F.lit(True)) & F.coalesce(F.expr("cells['Grade']") == F.col("grade"), F.lit(True))
    joined = rows.join(want, F.expr("cells['Company']") == F.col("__n"), "left")
    return joined.select(ident, "line", F.expr("cells['Company']").alias("company"), F.when(F.col("__n").isNull(), "unknown").when(same, "pass").otherwise("fail").alias("result"))
