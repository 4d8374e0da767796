"""Stage packages: the samples of a run, their claims, and where each came from.

A package is a folder of tables.  The hashes of its files are formed by the tasks
that read them and kept as a table; the manifest holds only a hash of that table, so
nothing of the size of the package passes the driver.

``audit`` holds a package against its run in one pass a question: keys by
``integrity.broken``, quotes by one join of all locations with the texts they point
into, occurrences as marks of (claim, location).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.text import normal_statement
from ledgerlark.plans.integrity import Keys, Refers, broken
from ledgerlark.sources.files import inventory, not_frozen
from ledgerlark.sources.runs import read_text, write_json

ROWS_A_FILE = 100_000
FILES_A_PART = 1_000_000
LOCATION = "struct<path: string, sha256: string, start: int, end: int, quote: string>"


def _root(spark: SparkSession, folder: str) -> str:
    """A hash of the table of file hashes; it has a part for each million files."""
    parts = inventory(spark, f"{folder}/files").filter("file like '%.json'")
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), " "), 256)).first()[0]


def _hashes(spark: SparkSession, folder: str) -> DataFrame:
    return inventory(spark, folder).filter("file like '%/%.json' and file not like 'files/%'")


def save(folder: str, tables: dict[str, DataFrame], about: dict) -> None:
    """Writes the tables once, then their hashes, then the manifest: a package without a manifest is not done."""
    spark = next(iter(tables.values())).sparkSession
    not_frozen(spark, folder)
    for name, frame in tables.items():
        frame.write.mode("errorifexists").option("maxRecordsPerFile", ROWS_A_FILE).option("ignoreNullFields", False).json(f"{folder}/{name}")
    found = _hashes(spark, folder)
    found.repartitionByRange(1 + found.count() // FILES_A_PART, "file").write.mode("errorifexists").json(f"{folder}/files")
    write_json(spark, f"{folder}/manifest.json", about | {"tables": sorted(tables), "files_sha256": _root(spark, folder)})


def file_problems(spark: SparkSession, folder: str) -> DataFrame:
    """(file, problem): files missing, changed or unlisted; ``files`` itself if the list was changed."""
    said = json.loads(read_text(spark, f"{folder}/manifest.json"))
    listed = spark.read.schema("file string, sha256 string").json(f"{folder}/files").select("file", F.col("sha256").alias("want"))
    both = listed.join(_hashes(spark, folder).withColumnRenamed("sha256", "have"), "file", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") != F.col("want"), "changed")
    bad = both.select("file", problem.alias("problem")).filter("problem is not null")
    if _root(spark, folder) != said["files_sha256"]:
        bad = bad.unionByName(spark.createDataFrame([("files", "changed")], "file string, problem string"))
    return bad


def _found(rule: str, frame: DataFrame, wrong: Column, row: str, value: Column | None = None) -> DataFrame:
    """Rows where ``wrong`` holds; a null counts as wrong."""
    return frame.filter(F.coalesce(wrong, F.lit(True))).select(F.lit(rule).alias("rule"), F.col(row).cast("string").alias("row"), (F.lit(None) if value is None else value).cast("string").alias("value"))


def _differs(a: str | Column, b: str | Column) -> Column:
    one = lambda x: F.col(x) if isinstance(x, str) else x
    return ~one(a).eqNullSafe(one(b))


def _prefixed(frame: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return frame.select(*[F.col(c).alias(prefix + c) for c in columns])


def audit(package: dict[str, DataFrame], run: dict[str, DataFrame], scope: dict[str, str], dataset_sha256: str | None = None) -> DataFrame:
    """(rule, row, value): all in which a package differs from its run; empty for a good one.

    Package: samples(sample_id, run_id, evaluation_id, mode, stage, invocation_id,
    attempt, input_path, input_sha256, user_input, response, response_sha256,
    evaluation_status, case_id, company_id, section_id, as_of_date, reference,
    reference_ids, reference_sha256, claim_ids, locations), claims(claim_id, run_id,
    evaluation_id, sample_id, invocation_id, atomic_statement, company_id,
    section_id, occurrences), atoms(atom_id, unit_id, sample_id, claim_id, kind,
    statement, company_id, section_id, location), units(unit_id, text, format,
    fragment, location).  Run: invocations(invocation_id, attempt, input_path,
    input_sha256, output_path, output_sha256), texts(path, sha256, text),
    artifacts(path, sha256), cases(case_id, company_id, section_id, as_of_date,
    reference, reference_ids).  ``scope``: run_id, evaluation_id, mode.

    A reference to nothing is one row of its own rule and of no other.
    """
    samples, claims, atoms, units = (package[k] for k in ("samples", "claims", "atoms", "units"))
    calls, texts, cases = run["invocations"], run["texts"].dropDuplicates(["path", "sha256"]), run["cases"]
    referred = samples.withColumn("bound", F.when(F.col("reference").isNotNull(), F.col("case_id")))
    out = [broken(
        [Keys("claim", claims, "claim_id"), Keys("unit", units, "unit_id"), Keys("sample", samples, "sample_id"), Keys("invocation", calls, "invocation_id"), Keys("case", cases, "case_id")],
        [Refers("atom unit", "unit", atoms, "atom_id", "unit_id"), Refers("atom claim", "claim", atoms, "atom_id", "claim_id"), Refers("claim sample", "sample", claims, "claim_id", "sample_id"),
         Refers("sample invocation", "invocation", samples, "sample_id", "invocation_id"), Refers("sample claim", "claim", samples, "sample_id", "claim_ids"), Refers("reference case", "case", referred, "sample_id", "bound")],
    )]
    outside = lambda keys: reduce(lambda a, b: a | b, [_differs(k, F.lit(scope[k])) for k in keys])
    out += [_found("claim scope", claims, outside(("run_id", "evaluation_id")), "claim_id"), _found("sample scope", samples, outside(("run_id", "evaluation_id", "mode")), "sample_id")]

    # Every location of samples and atoms against the text that it points into.
    places = samples.select(F.lit("sample position").alias("rule"), F.col("sample_id").cast("string").alias("row"), F.explode("locations").alias("l"))
    places = places.unionByName(atoms.select(F.lit("atom position").alias("rule"), F.col("atom_id").cast("string").alias("row"), F.col("location").alias("l"))).select("rule", "row", "l.*")
    at = places.join(texts, ["path", "sha256"], "left")
    out.append(at.filter(_differs(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), "quote")).select("rule", "row", F.col("quote").alias("value")))

    token = F.when(F.col("fragment"), F.concat(F.lit('"'), F.col("location.quote"), F.lit('"'))).otherwise(F.col("location.quote"))
    decoded = F.from_json(F.concat(F.lit('{"v":'), token, F.lit("}")), "v string")["v"]
    out.append(_found("unit text", units, _differs("text", F.when(F.col("format") == "json_string", decoded).otherwise(F.col("location.quote"))), "unit_id"))

    # Facts against the claims made of them.
    # Equal texts are told by their digests, so that no statement is exchanged for it.
    digest = lambda text: F.unhex(F.sha2(text, 256))
    stated = claims.select(F.col("claim_id").alias("c_claim_id"), F.col("sample_id").alias("c_sample_id"), F.col("company_id").alias("c_company_id"), F.col("section_id").alias("c_section_id"), digest(normal_statement(F.col("atomic_statement"))).alias("c_said"))
    own = atoms.select("atom_id", "claim_id", "kind", "sample_id", "company_id", "section_id", digest(normal_statement(F.col("statement"))).alias("said")).join(stated, F.col("claim_id") == F.col("c_claim_id"))
    other = _differs("said", "c_said") | _differs("company_id", "c_company_id") | _differs("section_id", "c_section_id")
    # Both rules in one pass, so that the statements are exchanged once.
    broken_by = F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(True)), F.lit(rule)) for rule, wrong in (("atom is no fact of its claim", (F.col("kind") != "fact") | _differs("sample_id", "c_sample_id")), ("claim statement", other))]))
    out.append(own.select(F.explode(broken_by).alias("rule"), F.col("atom_id").cast("string").alias("row"), F.lit(None).cast("string").alias("value")))
    mark = lambda f, col, bit: f.select("claim_id", col.alias("l")).select("claim_id", F.col("l").cast(LOCATION).alias("l"), F.lit(bit).alias("bit"))
    seen = mark(atoms.filter("claim_id is not null"), F.col("location"), 1).unionByName(mark(claims, F.explode("occurrences"), 2))
    halves = seen.groupBy("claim_id", "l").agg(F.bit_or("bit").alias("bits")).join(claims.select("claim_id").distinct(), "claim_id", "left_semi")
    out.append(halves.filter("bits <> 3").select(F.when(F.col("bits") == 1, "occurrence missing").otherwise("occurrence of no atom").alias("rule"), F.col("claim_id").cast("string").alias("row"), F.col("l.quote").alias("value")))

    # Samples against their calls.
    i = _prefixed(calls.dropDuplicates(["invocation_id"]), "i_", "invocation_id", "attempt", "input_path", "input_sha256", "output_path", "output_sha256")
    called = samples.join(i, F.col("invocation_id") == F.col("i_invocation_id"))
    out.append(_found("sample attempt", called, _differs("attempt", "i_attempt"), "sample_id"))
    out.append(_found("sample input", called, _differs("input_path", "i_input_path") | _differs("input_sha256", "i_input_sha256"), "sample_id"))
    asked = samples.filter("user_input is not null").select("sample_id", "user_input", F.col("input_path").alias("path"), F.col("input_sha256").alias("sha256"))
    out.append(_found("sample request", asked.join(texts, ["path", "sha256"], "left"), _differs("user_input", "text"), "sample_id"))
    sources = called.select("sample_id", "stage", "i_output_path", "i_output_sha256", F.explode("locations").alias("l")).select("sample_id", "stage", "i_output_path", "i_output_sha256", "l.path", "l.sha256")
    allowed = run["artifacts"].select("path", "sha256", F.lit(True).alias("artifact")).distinct()
    of_call = (F.col("path") == F.col("i_output_path")) & (F.col("sha256") == F.col("i_output_sha256"))
    permitted = F.when(F.col("stage") == "intermediate", of_call).otherwise(F.col("artifact"))
    out.append(_found("sample source", sources.join(allowed, ["path", "sha256"], "left"), ~F.coalesce(permitted, F.lit(False)), "sample_id").distinct())

    # Samples against their claims: lineage, and the response that they make up.
    c = _prefixed(claims, "c_", "claim_id", "sample_id", "invocation_id", "atomic_statement")
    owned = samples.select("sample_id", "invocation_id", F.posexplode("claim_ids").alias("pos", "claim")).join(c, F.col("claim") == F.col("c_claim_id"))
    out.append(_found("claim lineage", owned, _differs("sample_id", "c_sample_id") | _differs("invocation_id", "c_invocation_id"), "sample_id", F.col("claim")))
    told = owned.groupBy(F.col("sample_id").alias("s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c_atomic_statement"))), lambda x: x["c_atomic_statement"]), "\n").alias("expected"))
    told = told.select("s", F.sha2("expected", 256).alias("expected"))
    pending = samples.filter("evaluation_status = 'pending'").select("sample_id", F.sha2("response", 256).alias("response"), "response_sha256").join(told, F.col("sample_id") == F.col("s"), "left").withColumn("expected", F.coalesce("expected", F.sha2(F.lit(""), 256)))
    out.append(_found("response", pending, _differs("response", "expected") | _differs("response_sha256", "expected"), "sample_id"))

    # References against the dataset's cases.
    k = _prefixed(cases.dropDuplicates(["case_id"]), "k_", "case_id", "company_id", "section_id", "as_of_date", "reference", "reference_ids")
    bound = samples.filter("reference is not null").join(k, F.col("case_id") == F.col("k_case_id"))
    out.append(_found("reference scope", bound, reduce(lambda a, b: a | b, [_differs(x, f"k_{x}") for x in ("company_id", "section_id", "as_of_date")]), "sample_id"))
    out.append(_found("reference text", bound, _differs("reference", "k_reference") | _differs("reference_ids", "k_reference_ids") | _differs("reference_sha256", F.lit(dataset_sha256)), "sample_id"))
    return reduce(DataFrame.unionByName, out)
