"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import layout_queries


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.llm.line_dedup import dedup_lines

    out = dedup_lines(documents(spark, sf_dir), min_chars=1, min_docs=10)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY rid, doc_id
"""

def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.llm.license_scan import label_documents

    return label_documents(documents(spark, sf_dir))


def _op3_sql() -> str:
    from ledgerlark.llm.license_scan import BASE, DRIFT, GRAM, MIN_SHARE, NOTICES

    both = [(t, x, "true") for t, x in BASE.items()] + [(t, x, "false") for t, x in NOTICES.items()]
    rows = ", ".join(f"({i}, '{t}', '{x}', {e})" for i, (t, x, e) in enumerate(both))
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(GRAM))
    return rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS uid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
templates(tid, txt, label, exact) AS (VALUES {rows}),
tw AS (SELECT tid, label, exact, string_split(txt, ' ') AS w FROM templates),
tg AS (SELECT tid, label, exact, len(w) AS tlen, i - 1 AS tpos, {gram} AS g FROM (SELECT *, unnest(range(1, len(w) - {GRAM - 2})) AS i FROM tw)),
dg AS (SELECT uid, i - 1 AS pos, {gram} AS g FROM (SELECT *, unnest(range(1, len(w) - {GRAM - 2})) AS i FROM docs)),
hits AS (SELECT DISTINCT uid, tid, pos, tpos, pos - tpos AS diagonal, tlen, label, exact FROM dg JOIN tg USING (g)),
islands AS (SELECT *, tpos - row_number() OVER (PARTITION BY uid, tid, diagonal ORDER BY tpos) AS island FROM hits),
runs AS (SELECT uid, tid, diagonal, min(pos) AS lo, max(pos) AS hi, min(tpos) AS tlo, max(tpos) AS thi, count(*) AS size, max(tlen) - {GRAM - 1} AS whole, max(label) AS label, bool_or(exact) AS exact
    FROM islands GROUP BY uid, tid, diagonal, island),
able AS (SELECT * FROM runs SEMI JOIN (SELECT uid, tid FROM runs WHERE NOT exact GROUP BY uid, tid HAVING sum(size) >= {MIN_SHARE} * max(whole)) USING (uid, tid)),
edges AS (SELECT a.uid, a.tid, a.lo AS alo, a.tlo AS atlo, b.lo, b.tlo, b.size - greatest(0, a.hi - b.lo + 1, a.thi - b.tlo + 1) AS gain
    FROM able a JOIN able b ON a.uid = b.uid AND a.tid = b.tid AND abs(a.diagonal - b.diagonal) <= {DRIFT} AND a.hi < b.hi AND a.thi < b.thi
    AND (a.lo, a.tlo) < (b.lo, b.tlo) AND greatest(0, a.hi - b.lo + 1, a.thi - b.tlo + 1) < b.size),
chains(uid, tid, lo, tlo, votes) AS (SELECT uid, tid, lo, tlo, size::BIGINT FROM able
    UNION SELECT e.uid, e.tid, e.lo, e.tlo, c.votes + e.gain FROM chains c JOIN edges e ON c.uid = e.uid AND c.tid = e.tid AND c.lo = e.alo AND c.tlo = e.atlo),
spans AS (SELECT uid, tid, diagonal, label, exact, size / whole::DOUBLE AS share FROM runs WHERE exact
    UNION ALL SELECT uid, tid, NULL, max(label), false, least(1.0, max(votes) / max(whole)::DOUBLE) FROM chains JOIN able USING (uid, tid, lo, tlo) GROUP BY uid, tid),
kept AS (SELECT *, exact AND share = 1.0 AS place FROM spans WHERE (exact AND share = 1.0) OR (NOT exact AND share >= {MIN_SHARE})),
per AS (SELECT uid, count(*) FILTER (WHERE place) AS n_base, min(diagonal) FILTER (WHERE place) AS f, max(diagonal) FILTER (WHERE place) AS l,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS ls, max(share) AS score FROM kept GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
    coalesce(bl, '') AS base_labels, coalesce(ls, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN per USING (uid)
"""


#: The synthetic tables' key; a real corpus needs a secret one.
DEMO_KEY = b"ledgerlark-demo-key"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.llm.pii import pseudonyms

    return pseudonyms(documents(spark, sf_dir).select("doc_id", "text"), DEMO_KEY).select("doc_id", "n_values", "kinds", "text")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.llm.spm import encode

    return encode(documents(spark, sf_dir).select("doc_id", "text"), digest=True)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.llm.media import media_columns

    return media_columns(documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.llm.decontaminate import leaks

    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.llm.langid import held_out, learn, predict

    docs = documents(spark, sf_dir)
    slim = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text")
    return predict(slim, learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.llm.near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.llm.substring_dedup import dedup_substrings

    return dedup_substrings(documents(spark, sf_dir), digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)),
first AS (SELECT h, min(doc_id) AS f FROM wins GROUP BY h),
hit AS (SELECT DISTINCT rid, i + k AS p FROM (SELECT rid, i FROM wins JOIN first USING (h) WHERE doc_id > f), range(50) AS r(k)),
words AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN hit USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""


def op6_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.llm.bwt_dedup import dedup_bytes

    return dedup_bytes(documents(spark, sf_dir), digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP6_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
wins AS (SELECT rid, i, md5(t[i + 1 : i + 200]) AS h FROM (SELECT rid, t, unnest(range(0, n - 199)) AS i FROM docs)),
twice AS (SELECT h FROM wins GROUP BY h HAVING count(*) > 1),
hit AS (SELECT rid, i FROM wins SEMI JOIN twice USING (h)),
runs AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hit),
spans AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM runs) GROUP BY rid, g),
ordered AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS from_ FROM spans),
kept AS (SELECT rid, string_agg(hex(t[from_ + 1 : a]), '' ORDER BY a) || any_value(hex(t[z + 1 : n])) AS k, count(*) AS n_spans, sum(b - a) AS gone
    FROM (SELECT o.*, d.t, d.n, max(b) OVER (PARTITION BY o.rid) AS z FROM ordered o JOIN docs d USING (rid)) GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, CASE WHEN k IS NULL THEN sha256(t) ELSE sha256(unhex(k)) END AS kept_sha256 FROM docs LEFT JOIN kept USING (rid)
"""


QUERIES = {
    "op1_pii_pseudonyms": op1_pii_pseudonyms,
    "op2_decontaminate": op2_decontaminate,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op6_bwt_dedup": op6_bwt_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_media_columns": op9_media_columns,
    "op10_near_dedup": op10_near_dedup,
}
ORACLES = {"op3_license_scan": _op3_sql(), "op6_bwt_dedup": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_substring_dedup": OP8_SQL}
QUERIES |= layout_queries.QUERIES
ORACLES |= layout_queries.ORACLES
