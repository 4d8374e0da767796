"""A stage package of all documents, with altered records, audited; and its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.plans import packages
from ledgerlark.queries import query
from ledgerlark.session import kept, table

#: Lines that one sum of :func:`line_starts` runs over.
RUN = 256


def line_starts(lengths: Column) -> Column:
    """Where each line of a text starts, by the lines' lengths: in the row itself, sums of whole runs and of the lines before in the own run."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / RUN).cast("int")), lambda b: total(F.slice(lengths, b * RUN + 1, F.lit(RUN))))
    upto = F.transform(runs, lambda _, b: total(F.slice(runs, F.lit(1), b)))
    return F.transform(lengths, lambda _, i: F.get(upto, F.floor(i / RUN).cast("int")) + total(F.slice(lengths, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN)) + i)


@query("""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, text, string_split(text, chr(10))[1] AS line FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
f AS (SELECT *, doc_id || '/0' AS id FROM d WHERE trim(line) <> '')
SELECT 'sample attempt' AS rule, doc_id::VARCHAR AS row, NULL AS value FROM d WHERE doc_id % 11 = 3
UNION ALL SELECT 'sample request', doc_id::VARCHAR, NULL FROM d WHERE doc_id % 23 = 7
UNION ALL SELECT 'sample position', doc_id::VARCHAR, line FROM d WHERE doc_id % 29 = 8
UNION ALL SELECT 'sample source', doc_id::VARCHAR, NULL FROM d WHERE doc_id % 29 = 8
UNION ALL SELECT 'claim statement', id, NULL FROM f WHERE doc_id % 13 = 4
UNION ALL SELECT 'response', doc_id::VARCHAR, NULL FROM f WHERE doc_id % 13 = 4
UNION ALL SELECT 'unit text', id, NULL FROM f WHERE doc_id % 7 = 2
UNION ALL SELECT 'atom position', id, 'Q' || line FROM f WHERE doc_id % 17 = 5
UNION ALL SELECT 'occurrence missing', id, 'Q' || line FROM f WHERE doc_id % 17 = 5
UNION ALL SELECT 'occurrence of no atom', id, line FROM f WHERE doc_id % 17 = 5""")
def package_audit(spark, sf):
    """Each document is the output of a call; its lines that are not blank are units and atoms, every other of them a claim."""
    k, name = F.col("doc_id"), F.col("doc_id").cast("string")
    docs = table(spark, sf, "documents").filter("doc_id is not null and text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("request"), "text")
    docs = docs.withColumns({"out": F.concat(F.lit("out/"), name), "sha": F.sha2("text", 256), "in": F.concat(F.lit("in/"), name), "in_sha": F.sha2("request", 256)})
    # Lines are made in the row of their document: no exchange, and ids may repeat.
    docs = docs.withColumn("each", F.split("text", "\n"))
    starts = line_starts(F.col("lengths"))
    lines = docs.withColumn("lengths", F.transform("each", F.length)).select("doc_id", "out", "sha", F.posexplode(F.arrays_zip(F.col("each").alias("line"), starts.alias("start"))).alias("i", "l")).select("doc_id", "out", "sha", "i", "l.line", "l.start").filter(F.trim("line") != "")
    place = lambda quote, start, path: F.struct(path.alias("path"), F.col("sha").alias("sha256"), start.alias("start"), (start + F.length("line")).cast("int").alias("end"), quote.alias("quote"))
    first = lambda n, rest: (F.col("i") == 0) & (k % n == rest)
    ident, fact = F.concat(name, F.lit("/"), F.col("i").cast("string")), F.col("i") % 2 == 0
    own = place(F.col("line"), F.col("start"), F.col("out"))

    def scoped(*columns: Column) -> list[Column]:
        return [F.lit("r").alias("run_id"), F.lit("e").alias("evaluation_id"), *columns]

    company = [F.lit("co").alias("company_id"), F.lit("sec").alias("section_id")]
    units = lines.select(ident.alias("unit_id"), F.when(first(7, 2), F.concat("line", F.lit("."))).otherwise(F.col("line")).alias("text"), F.lit("markdown").alias("format"), F.lit(False).alias("fragment"), own.alias("location"))
    quote = F.when(first(17, 5), F.concat(F.lit("Q"), "line")).otherwise(F.col("line"))
    atoms = lines.select(ident.alias("atom_id"), ident.alias("unit_id"), name.alias("sample_id"), F.when(fact, ident).alias("claim_id"), F.when(fact, "fact").otherwise("opinion").alias("kind"), F.col("line").alias("statement"), *company, place(quote, F.col("start"), F.col("out")).alias("location"))
    stated = F.when(first(13, 4), F.concat("line", F.lit(" x"))).otherwise(F.col("line"))
    facts = lines.filter(fact)
    claims = facts.select(ident.alias("claim_id"), *scoped(name.alias("sample_id"), name.alias("invocation_id"), stated.alias("atomic_statement"), *company), F.array(own).alias("occurrences"))
    counted = F.transform("each", lambda x, i: F.struct(i.alias("i"), F.concat(name, F.lit("/"), i.cast("string")).alias("claim"), x.alias("line")))
    s = docs.withColumn("told", F.filter(counted, lambda x: (x["i"] % 2 == 0) & (F.trim(x["line"]) != "")))
    s = s.withColumns({"response": F.array_join(F.transform("told", lambda x: x["line"]), "\n"), "line": F.get("each", 0)})
    none = F.lit(None).cast("string")
    there = place(F.col("line"), F.lit(0), F.when(k % 29 == 8, "other").otherwise(F.col("out")))
    samples = s.select(
        name.alias("sample_id"), *scoped(F.lit("end_to_end").alias("mode"), F.lit("intermediate").alias("stage"), name.alias("invocation_id")), F.when(k % 11 == 3, 2).otherwise(1).alias("attempt"),
        F.col("in").alias("input_path"), F.col("in_sha").alias("input_sha256"), F.when(k % 23 == 7, F.concat("request", F.lit("?"))).otherwise(F.col("request")).alias("user_input"),
        "response", F.sha2("response", 256).alias("response_sha256"), F.lit("pending").alias("evaluation_status"), F.lit("unbound").alias("case_id"), *company, none.alias("as_of_date"), none.alias("reference"), F.array().cast("array<string>").alias("reference_ids"), none.alias("reference_sha256"),
        F.transform("told", lambda x: x["claim"]).alias("claim_ids"), F.array(there).alias("locations"),
    )
    calls = docs.select(name.alias("invocation_id"), F.lit(1).alias("attempt"), F.col("in").alias("input_path"), F.col("in_sha").alias("input_sha256"), F.col("out").alias("output_path"), F.col("sha").alias("output_sha256"))
    texts = docs.select(F.col("out").alias("path"), F.col("sha").alias("sha256"), "text").unionByName(docs.select(F.col("in").alias("path"), F.col("in_sha").alias("sha256"), F.col("request").alias("text")))
    nothing = spark.createDataFrame([], "path string, sha256 string")
    cases = spark.createDataFrame([], "case_id string, company_id string, section_id string, as_of_date string, reference string, reference_ids array<string>")
    # Of the package only the samples are written; the other tables are rows of the documents, read again by each rule.
    package = {"samples": kept(samples), "claims": claims, "atoms": atoms, "units": units}
    return packages.audit(package, {"invocations": calls, "texts": texts, "artifacts": nothing, "cases": cases}, {"run_id": "r", "evaluation_id": "e", "mode": "end_to_end"})
