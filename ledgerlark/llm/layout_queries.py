"""Queries of sharding, the manifest and phrases, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the documents are sharded by, and the columns that order rows of one place on the curve.
BITS, N, TIES = 8, 24, ["doc_id", "size", "text_crc32"]


#: The 256 entries of CRC-32, by its rule (polynomial EDB88320, reflected).
CRC_TABLE = """crc_bits(i, k, c) AS (SELECT i, 0, i FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tbl FROM crc_bits WHERE k = 8)"""


def _crc_sql(hexed: str) -> str:
    """CRC-32 of bytes given in hex, with the list ``tbl`` at hand."""
    octets = f"list_transform(regexp_extract_all({hexed}, '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, x: xor(a >> 8, tbl[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.llm.hilbert import Dimension, shards
    from ledgerlark.llm.shared import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.coalesce("text", F.lit(""))
    # The text is read once; only what describes it is sorted.
    slim = stored(docs.select("doc_id", "lang", "source", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32")))
    dims = [Dimension("lang", "rank"), Dimension("source", "rank"), Dimension("size", "log"), Dimension("doc_id")]
    out = shards(slim, dims, N, law="rows", ties=TIES, bits=BITS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("__curve").alias("curve")
    )


def _op11_sql() -> str:
    """The curve by its corner and direction rules, level by level; the operator looks them up in a table."""
    steps, before = [], "codes"
    for k in range(BITS - 1, -1, -1):
        steps.append(f"l{k} AS (SELECT *, ((c0 >> {k}) & 1) + 2 * ((c1 >> {k}) & 1) + 4 * ((c2 >> {k}) & 1) + 8 * ((c3 >> {k}) & 1) AS b FROM {before}),")
        steps.append(f"t{k} AS (SELECT * EXCLUDE b, ((xor(b, e) >> ((d + 1) % 4)) | (xor(b, e) << (4 - (d + 1) % 4))) & 15 AS t FROM l{k}),")
        steps.append(f"w{k} AS (SELECT * EXCLUDE t, xor(xor(t, t >> 1), xor(t >> 2, t >> 3)) AS w FROM t{k}),")
        steps.append(f"g{k} AS (SELECT *, CASE WHEN w = 0 THEN 0 ELSE xor(2 * ((w - 1) // 2), (w - 1) // 2) END AS g, CASE WHEN w = 0 THEN 0 WHEN w % 2 = 0 THEN w - 1 ELSE w END AS o FROM w{k}),")
        ones = "CASE WHEN w = 0 OR o & 1 = 0 THEN 0 WHEN o & 2 = 0 THEN 1 WHEN o & 4 = 0 THEN 2 WHEN o & 8 = 0 THEN 3 ELSE 4 END"
        steps.append(f"s{k} AS (SELECT * EXCLUDE (e, d, h, w, g, o), xor(e, ((g << ((d + 1) % 4)) | (g >> (4 - (d + 1) % 4))) & 15) AS e, (d + {ones} + 1) % 4 AS d, h * 16 + w AS h FROM g{k}),")
        before = f"s{k}"
    levels = "\n".join(steps)
    size = "(length(bin(size)) - 1)"
    return rf"""
WITH RECURSIVE slim AS (SELECT doc_id, lang, source, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size, coalesce(text, '') AS body FROM documents),
logs AS (SELECT *, (length(bin(size)) * 1024 + CASE WHEN {size} >= 10 THEN (size >> ({size} - 10)) & 1023 ELSE (size << (10 - {size})) & 1023 END)::BIGINT AS lg FROM slim),
edges AS (SELECT min(lg) AS a, max(lg) AS b, coalesce(min(doc_id), 0) AS c, coalesce(max(doc_id), 0) AS z FROM logs),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM slim)),
sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM slim)),
codes AS (SELECT doc_id, size, body, (langs.r * 256 // langs.n)::INTEGER AS c0, (sources.r * 256 // sources.n)::INTEGER AS c1, ((lg - a) * 256 // (b - a + 1))::INTEGER AS c2,
    coalesce((doc_id - c)::HUGEINT * 256 // (z::HUGEINT - c + 1), 0)::INTEGER AS c3, 0::INTEGER AS e, 0::INTEGER AS d, 0::BIGINT AS h
    FROM logs, edges, langs, sources WHERE logs.lang IS NOT DISTINCT FROM langs.lang AND logs.source IS NOT DISTINCT FROM sources.source),
{levels}
{CRC_TABLE},
crc AS (SELECT doc_id, size, h, {_crc_sql("hex(encode(body))")} AS text_crc32 FROM {before}, crc_table),
placed AS (SELECT *, row_number() OVER (ORDER BY h, doc_id NULLS LAST, size, text_crc32) - 1 AS p, count(*) OVER () AS n FROM crc),
cut AS (SELECT *, (p * {N} // n)::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard, (p - row_number_first)::BIGINT AS slot, NULL::INTEGER AS grown_shard, h::BIGINT AS curve
FROM (SELECT *, min(p) OVER (PARTITION BY shard) AS row_number_first FROM cut)
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.llm.merkle import FIELDS, leaf, manifest

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs["n_chars"].cast("decimal(20,0)") + 1
    tampered = F.when(F.crc32(F.encode(docs["doc_id"].cast("string"), "utf-8")) % 7 == 0, leaf(docs, FIELDS, {"n_chars": more}))
    tag = F.concat_ws("|", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(tampered, F.lit("")))
    made = manifest(docs.select("lang", "doc_id", leaf(docs, FIELDS).alias("leaf"), tag.alias("tag")), "lang", "doc_id", "leaf", "tag")
    out = made.verified(lambda tag: tag.split("|")[1] or None)
    subroots = made.groups.select(F.col("grp").alias("g"), "subroot")
    doc_id = F.nullif(F.split("tag", "[|]")[0], F.lit("")).cast(docs.schema["doc_id"].dataType)
    return out.join(subroots, F.col("grp") == F.col("g")).select(
        doc_id.alias("doc_id"), "leaf", "subroot", F.lit(made.root).cast("string").alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified", F.col("place").alias("place")
    )


def _op12_sql() -> str:
    """Level by level; a tampered row is folded beside the tree's own nodes."""

    def part(c: str) -> str:
        return f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR, '-')"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"

    return rf"""
WITH RECURSIVE {CRC_TABLE},
base AS (SELECT doc_id, lang, {leaf("n_chars")} AS leaf, CASE WHEN {_crc_sql("hex(encode(doc_id::VARCHAR))")} % 7 = 0 THEN {leaf("n_chars::HUGEINT + 1")} ELSE {leaf("n_chars")} END AS claim FROM documents, crc_table),
named AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) AS m FROM base GROUP BY lang),
leaves AS (SELECT b.*, g, m, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf, claim) - 1 AS p FROM base b JOIN named n ON b.lang IS NOT DISTINCT FROM n.lang),
up(g, k, p, d, m) AS (SELECT g, 0, p, leaf, m FROM leaves UNION ALL
    SELECT g, k + 1, p // 2, sha256(d || coalesce(nx, '')), (m + 1) // 2 FROM (SELECT *, lead(d) OVER (PARTITION BY g ORDER BY p) AS nx FROM up WHERE m > 1) WHERE p % 2 = 0),
subroots AS (SELECT g, d AS subroot, count(*) OVER () AS m FROM up WHERE m = 1),
top(k, p, d, m) AS (SELECT 0, g, subroot, m FROM subroots UNION ALL
    SELECT k + 1, p // 2, sha256(d || coalesce(nx, '')), (m + 1) // 2 FROM (SELECT *, lead(d) OVER (ORDER BY p) AS nx FROM top WHERE m > 1) WHERE p % 2 = 0),
down(g, o, k, p, m, cur, way) AS (SELECT g, p, 0, p, m, claim, '' FROM leaves UNION ALL
    SELECT w.g, w.o, w.k + 1, w.p // 2, (w.m + 1) // 2, CASE WHEN w.p % 2 = 1 THEN sha256(u.d || cur) ELSE sha256(cur || coalesce(u.d, '')) END, way || coalesce(u.d, '')
    FROM down w LEFT JOIN up u ON u.g = w.g AND u.k = w.k AND u.p = xor(w.p, 1) WHERE w.m > 1),
across(g, o, k, p, m, cur, way) AS (SELECT d.g, o, 0, d.g, s.m, cur, way FROM down d JOIN subroots s ON s.g = d.g WHERE d.m = 1 UNION ALL
    SELECT w.g, w.o, w.k + 1, w.p // 2, (w.m + 1) // 2, CASE WHEN w.p % 2 = 1 THEN sha256(t.d || cur) ELSE sha256(cur || coalesce(t.d, '')) END, way || coalesce(t.d, '')
    FROM across w LEFT JOIN top t ON t.k = w.k AND t.p = xor(w.p, 1) WHERE w.m > 1)
SELECT doc_id, leaf, subroot, r.d AS root, sha256(way) AS proof_sha256, cur AS folded_root, cur = r.d AS verified, l.p::BIGINT AS place
FROM leaves l JOIN across a ON a.g = l.g AND a.o = l.p AND a.m = 1 JOIN subroots s ON s.g = l.g, (SELECT d FROM top WHERE m = 1) r
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.llm.phrases import collocations

    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All n-grams are listed and counted.
OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS p FROM docs)),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 5) AS r(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 30),
often AS MATERIALIZED (SELECT lang, phrase, n FROM f WHERE n >= 30),
halves AS MATERIALIZED (SELECT lang, phrase, k, a, j, array_to_string(w[1 : j], ' ') AS lp, array_to_string(w[j + 1 : k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
cuts AS (SELECT c.lang, c.phrase, c.k AS m, a, j, x.n AS l, y.n AS r, 2000000::HUGEINT * a // (x.n + y.n) AS score
    FROM halves c JOIN often x ON x.lang = c.lang AND x.phrase = c.lp JOIN often y ON y.lang = c.lang AND y.phrase = c.rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(a) AS most
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, a::BIGINT AS a, l::BIGINT AS l, r.r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= 2000
"""


QUERIES = {"op11_hilbert_shards": op11_hilbert_shards, "op12_merkle_manifest": op12_merkle_manifest, "op13_collocations": op13_collocations}
ORACLES = {"op11_hilbert_shards": _op11_sql(), "op12_merkle_manifest": _op12_sql(), "op13_collocations": OP13_SQL}
