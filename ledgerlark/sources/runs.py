"""Run folders: identity, manifests, packages, publishing, and the small files beside the tables.

Tables are written by Spark; what is one small document (a manifest, a marker,
a price table) is read and written by the driver through Hadoop's file systems,
so any store works.  One driver writes a run; its lock is a file that only one
can create.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.nested import redacted_json
from ledgerlark.operators.joins import violations
from ledgerlark.sources.files import blobs, exists, inventory, json_lines, not_frozen

#: States after which a run changes no more.
TERMINAL = ("succeeded", "failed", "cancelled", "completed", "partial")


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def _rename_over(spark: SparkSession, near, p) -> None:
    """A rename that takes an existing file's place in one step."""
    jvm = spark._jvm
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(near, p, options)


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> str:
    """Writes a small file whole and returns the SHA-256 of its bytes; an existing one is only replaced if asked.

    The bytes go to a neighbour first and get their name by a rename, over the
    old file if that is replaced, so no reader sees half a file or none.
    """
    not_frozen(spark, path)
    body = text.encode()
    p, fs = _store(spark, path)
    if not replace and fs.exists(p):
        raise FileExistsError(path)
    near, _ = _store(spark, f"{path}.{hashlib.sha256(body).hexdigest()[:12]}.tmp")
    out = fs.create(near, True)
    out.write(bytearray(body))
    out.close()
    if replace:
        _rename_over(spark, near, p)
    elif not fs.rename(near, p):
        fs.delete(near, False)
        raise FileExistsError(path)
    return hashlib.sha256(body).hexdigest()


def write_json(spark: SparkSession, path: str, document: dict, identity: dict[str, str] | None = None, replace: bool = False) -> str:
    """Writes a document; ``identity`` names fields that must equal the folders above (run_id, evaluation_id).  NaN is refused."""
    for name, want in (identity or {}).items():
        if document.get(name) != want:
            raise ValueError(f"{name} is {document.get(name)!r}, the folder is {want!r}")
    return write_text(spark, path, redacted_json(json.dumps(document, ensure_ascii=False, allow_nan=False, indent=2)) + "\n", replace)


def update_manifest(spark: SparkSession, path: str, fixed: tuple[str, ...], **changes: object) -> dict:
    """Changes fields of a manifest; ``fixed`` ones and those of an ended run stay."""
    old = json.loads(read_text(spark, path))
    if old.get("status") in TERMINAL:
        raise PermissionError(f"{path} has ended: {old['status']}")
    if bad := [f for f in fixed if f in changes and changes[f] != old.get(f)]:
        raise ValueError(f"fields that cannot change: {bad}")
    write_json(spark, path, old | changes, replace=True)
    return old | changes


@contextlib.contextmanager
def writer(spark: SparkSession, folder: str) -> Iterator[None]:
    """The only writer of a folder: another one fails at once."""
    p, fs = _store(spark, f"{folder}/_WRITER")
    if not fs.createNewFile(p):
        raise BlockingIOError(f"{folder} has a writer")
    try:
        yield
    finally:
        fs.delete(p, False)


def end_run(spark: SparkSession, folder: str) -> None:
    """Freezes a folder whose manifest has ended."""
    status = json.loads(read_text(spark, f"{folder}/run.json")).get("status")
    if status not in TERMINAL:
        raise PermissionError(f"{folder} has not ended: {status}")
    from ledgerlark.sources.files import freeze

    freeze(spark, folder)


def archive(spark: SparkSession, folder: str, tables: dict[str, DataFrame], about: dict) -> DataFrame:
    """Writes tables as JSON lines with a manifest of all files' hashes; returns the inventory."""
    not_frozen(spark, folder)
    if exists(spark, folder):
        raise FileExistsError(folder)
    for name, frame in tables.items():
        frame.write.option("ignoreNullFields", False).json(f"{folder}/{name}")
    found = inventory(spark, folder).filter("file like '%.json'")
    write_json(spark, f"{folder}/manifest.json", about | {"files": {r.file: r.sha256 for r in found.orderBy("file").collect()}})
    return found


def archive_problems(spark: SparkSession, folder: str) -> DataFrame:
    """(file, problem): files of an archive that are missing, changed, or not in its manifest."""
    files = json.loads(read_text(spark, f"{folder}/manifest.json"))["files"]
    want = spark.createDataFrame(list(files.items()) or [], "file string, want string")
    have = inventory(spark, folder).filter("file like '%/%.json'").withColumnRenamed("sha256", "have")
    j = want.join(have, "file", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") != F.col("want"), "changed")
    return j.select("file", problem.alias("problem")).filter("problem is not null")


def publish(spark: SparkSession, staged: str, target: str, problems: DataFrame) -> None:
    """Moves a staged folder to its place if it has no problems; a taken place is an error."""
    if not problems.isEmpty():
        raise ValueError(f"not published: {[tuple(r) for r in problems.limit(5).collect()]}")
    (a, fs), (b, _) = _store(spark, staged), _store(spark, target)
    if fs.exists(b):
        raise FileExistsError(target)
    if not fs.rename(a, b):
        raise OSError(f"cannot move {staged} to {target}")


def parseable(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ok): whether each file is non-empty and what its name says (json, jsonl, md, pdf)."""
    text = F.decode("content", "UTF-8")
    kind = F.lower(F.element_at(F.split("file", r"\."), -1))
    json_ok = F.try_parse_json(text).isNotNull()
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    ok = F.when(kind == "json", json_ok).when(kind == "jsonl", F.forall(lines, lambda x: F.try_parse_json(x).isNotNull())).when(kind == "pdf", F.substring("content", 1, 5) == F.lit(b"%PDF-")).otherwise(F.trim(text) != "")
    return blobs(spark, folder).select("file", ((F.length("content") > 0) & F.coalesce(ok, F.lit(False))).alias("ok"))


def checked_lines(spark: SparkSession, path: str, schema: T.StructType | str, table: str, ident: str, rules: dict[str, str]) -> DataFrame:
    """Typed lines that meet their record's rules; a row that does not is an error that names it."""
    rows = json_lines(spark, path, schema)
    bad = violations(rows, table, ident, rules)
    if not bad.isEmpty():
        raise ValueError(f"{path}: {[tuple(r) for r in bad.limit(5).collect()]}")
    return rows


def plain_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """:func:`json_lines` of a path without symbolic links on its way."""
    p, fs = _store(spark, path)
    while p is not None and p.getParent() is not None:
        if fs.exists(p) and fs.getFileLinkStatus(p).isSymlink():
            raise ValueError(f"{p.toString()} is a symbolic link")
        p = p.getParent()
    return json_lines(spark, path, schema)


def corpus_root(spark: SparkSession, candidates: list[str]) -> str:
    """The first folder that holds a Markdown file other than README.md."""
    for folder in candidates:
        p, fs = _store(spark, f"{folder.rstrip('/')}/*.md")
        found = fs.globStatus(p)
        if found and any(s.getPath().getName() != "README.md" for s in found):
            return folder
    raise FileNotFoundError(f"no Markdown corpus in {candidates}")


def prompt(spark: SparkSession, folder: str, name: str) -> str:
    return read_text(spark, f"{folder.rstrip('/')}/{name}.md").strip()


PRICES = "provider string, kind string, model string, per_call double, input double, cached double, output double"


def prices(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, dict]:
    """(price rows, version, date, currency) of a price file; without one nothing has a price."""
    about = json.loads(read_text(spark, path)) if path else {"version": "unpriced", "as_of_date": None, "currency": "USD", "prices": []}
    rows = about.pop("prices", [])
    names = [c.split()[0] for c in PRICES.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], PRICES), about


def policy(spark: SparkSession, path: str) -> DataFrame:
    """(stage, dimension, weight) of a policy file; each stage's weights must sum to one."""
    weights = json.loads(read_text(spark, path))["weights"]
    for stage, w in weights.items():
        if abs(sum(w.values()) - 1) > 1e-9:
            raise ValueError(f"weights of {stage} do not sum to 1")
    return spark.createDataFrame([(s, d, float(x)) for s, w in weights.items() for d, x in w.items()], "stage string, dimension string, weight double")


def settings(environment: dict[str, str], defaults: dict[str, object], aliases: dict[str, tuple[str, ...]] | None = None) -> dict[str, object]:
    """Settings from an environment: each under its own or an alias's name, in the type of its default."""
    out = dict(defaults)
    for name, default in defaults.items():
        given = next((environment[k] for k in (name.upper(), *(aliases or {}).get(name, ())) if k in environment), None)
        if given is None:
            continue
        if isinstance(default, bool):
            out[name] = given.strip().lower() in ("1", "true", "yes", "on")
        else:
            out[name] = given if default is None else type(default)(given)
    return out


def export_replay(calls: DataFrame) -> DataFrame:
    """(key, request, result) of recorded searches, one a request.

    calls(request, result, status).  A failed call, or a request with two
    results, is an error: a replay could not tell which to give.
    """
    if not calls.filter(~F.coalesce(F.col("status") == "succeeded", F.lit(False))).isEmpty():
        raise ValueError("a recorded search failed")
    rows = calls.groupBy("request").agg(F.min("result").alias("result"), (F.min("result") != F.max("result")).alias("__two"))
    if not rows.filter("__two").isEmpty():
        raise ValueError("a request has different results")
    return rows.select(F.sha2("request", 256).alias("key"), "request", "result")


HITS = "array<struct<title: string, url: string, content: string>>"


def search_results(replies: DataFrame, most: int = 3) -> DataFrame:
    """Evidence rows of search replies (query, category, reply as JSON): the first hits, with defaults for what is absent."""
    hits = F.from_json(F.get_json_object("reply", "$.results"), HITS)
    rows = replies.select("query", "category", F.posexplode(F.slice(hits, 1, most)).alias("pos", "hit")).select("query", "category", "pos", "hit.*")
    url = F.coalesce("url", F.lit(""))
    place = F.get(F.split(url, "/"), 2)
    return rows.select("query", "category", "pos", F.coalesce("title", "query").alias("title"), url.alias("url"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce(F.nullif(place, F.lit("")), F.lit("unknown")).alias("source"))
