"""Sources and sinks: entity JSON, JSON lines, text corpora, hash-verified files, create-once tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTITY = (
    "name string, stage string, industry string, headquarters string, business_model string, product_summary string, customer_focus string, moat string,"
    " risks array<string>, references array<string>, tags array<string>, team_signal int, market_signal int, technology_signal int, traction_signal int, competition_signal int, risk_signal int,"
    " team_summary string, market_summary string, technology_summary string, traction_summary string, competition_summary string, risk_summary string"
)
SIGNALS = [f"{x}_signal" for x in ("team", "market", "technology", "traction", "competition", "risk")]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def entities(spark: SparkSession, path: str) -> DataFrame:
    """Companies of an entity file, with defaults and their input position."""
    raw = spark.read.schema(f"companies array<struct<{', '.join(_typed(ENTITY))}>>").option("multiLine", True).json(path)
    e = raw.select(F.posexplode("companies").alias("input_pos", "c")).select("input_pos", "c.*")
    blank = [f.name for f in e.schema if f.dataType.simpleString() == "string" and f.name not in ("name", "stage", "headquarters", "industry")]
    empty = F.array().cast("array<string>")
    return e.fillna(3, SIGNALS).fillna("", blank).fillna("Semiconductor (반도체)", ["industry"]).withColumns({c: F.coalesce(c, empty) for c in ("risks", "references", "tags")})


def _typed(fields: str) -> list[str]:
    return [f"`{n}`: {t}" for n, t in (x.split() for x in fields.split(", "))] if ", " in fields else []


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed rows; a missing file is an empty table, a malformed line fails."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def unknown_fields(spark: SparkSession, path: str, expected: list[str]) -> DataFrame:
    """(value, unknown): lines with fields that the schema does not have."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    return lines.withColumn("unknown", F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, expected)))).filter(F.size("unknown") > 0)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files but README.md, whole: file_name, source, content, metadata; a folder without one is an error."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("content"))
    out = files.withColumn("file_name", F.element_at(F.split("source", "/"), -1)).filter("file_name <> 'README.md'")
    if out.isEmpty():
        raise FileNotFoundError(f"no Markdown files in {path}")
    return out.withColumn("metadata", F.struct("source", "file_name"))


def blobs(spark: SparkSession, root: str) -> DataFrame:
    """(file, content) of all files under ``root``, ``file`` relative to it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    # file:/x and file:///x name the same place.
    bare = lambda c: F.regexp_replace(c, "^([a-z]+):/+", "$1:/")
    at = F.length(bare(F.lit(whole.rstrip("/")))) + 2
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.substr(bare(F.col("path")), at).alias("file"), "content")


def verified_texts(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(file relative to the path, sha256 expected) with status outside / missing / mismatch / ok, and the text where it is ok."""
    blobs_ = blobs(spark, path)
    found = expected.join(blobs_, "file", "left")
    outside = F.col("file").startswith("/") | F.col("file").rlike(r"(^|/)\.\.(/|$)") | F.contains("file", F.lit(":/"))
    status = F.when(outside, "outside").when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) == F.col("sha256"), "ok").otherwise("mismatch")
    return found.select("file", status.alias("status"), F.when(status == "ok", F.decode("content", "UTF-8")).alias("text"))


def replay(requests: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Recorded results of requests by exact key; a miss raises, nothing falls through."""
    missed = requests.join(recorded, key, "left_anti")
    if not missed.isEmpty():
        raise KeyError(f"not recorded: {missed.first()[key]!r}")
    return requests.join(recorded.dropDuplicates([key]), key)


def cache_key(category, query):
    return F.left(F.translate(F.concat(category, F.lit("__"), query), "/ ", "__"), F.lit(180))


def not_frozen(spark: SparkSession, path: str, frozen: str = "_FROZEN") -> None:
    """Raises if a folder on the way to ``path`` is frozen."""
    scheme, _, rest = path.rstrip("/").rpartition("://")
    parts = rest.split("/")
    for i in range(len(parts), 1, -1):
        folder = (scheme + "://" if scheme else "") + "/".join(parts[:i])
        if exists(spark, f"{folder}/{frozen}"):
            raise PermissionError(f"{folder} is frozen")


def write_once(frame: DataFrame, path: str, frozen: str = "_FROZEN") -> None:
    """Creates a table; fails if it exists or its folder is frozen."""
    not_frozen(frame.sparkSession, path, frozen)
    frame.write.mode("errorifexists").parquet(path)


def append_lines(frame: DataFrame, path: str) -> None:
    """Appends JSON lines; nulls stay as fields.  Each append is a set of new files, so no old line can be cut."""
    not_frozen(frame.sparkSession, path)
    frame.write.mode("append").option("ignoreNullFields", False).json(path)


def freeze(spark: SparkSession, folder: str, frozen: str = "_FROZEN") -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{frozen}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, False).close()


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(file relative to the folder, sha256) of a folder's files."""
    return blobs(spark, folder).select("file", F.sha2("content", 256).alias("sha256"))


def write_csv(frame: DataFrame, path: str) -> None:
    not_frozen(frame.sparkSession, path)
    frame.write.mode("errorifexists").option("header", True).csv(path)
