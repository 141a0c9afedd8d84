"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, neighbours, packing, paragraphs, projections, quality, quotations, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return bpe.digests(_table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    pieces = packing.pack(_table(spark, sf_dir, "documents"), public.path("word_bpe_49k.json"))
    return packing.with_crc(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link(_table(spark, sf_dir, "conversations"))


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paragraphs.remove_repeats(_table(spark, sf_dir, "documents"), within_lines=True)
    return out.select("doc_id", "text", "removed_lines", F.size("removed_lines").alias("n_removed"))


def op7_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    every = [op1_bpe, op2_simhash, op3_packing, op4_neighbours, op5_quotations, op6_paragraphs, op7_projections, op8_warc, op9_licenses, op10_quality]
    return {f.__name__: f for f in every}


OP4_SQL = """
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.embedding) = len(c.embedding) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP5_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS k, conv_id, turn, role, text FROM conversations),
l AS (SELECT k, conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS n FROM m WHERE text IS NOT NULL),
x AS (SELECT k, conv_id, turn, n, line, len(regexp_replace(regexp_extract(line, '^((?:\s*>)*)', 1), '\s', '', 'g')) AS level,
  regexp_replace(line, '^(?:\s*>)*\s*', '') AS body FROM l),
b AS (SELECT *, regexp_full_match(body, '\s*') AS blank FROM x),
g AS (SELECT *, CASE WHEN blank OR lag(level) OVER w <> level OR coalesce(lag(blank) OVER w, true) THEN 1 ELSE 0 END AS begins FROM b WINDOW w AS (PARTITION BY k ORDER BY n)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY n) AS body FROM r WHERE NOT blank GROUP BY k, conv_id, turn, level, run
  UNION ALL SELECT conv_id, turn, level, body FROM r WHERE NOT blank),
u AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) AS unit FROM s WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
f AS (SELECT q.conv_id, q.turn, q.level, q.unit, max(o.turn) AS origin FROM u q JOIN u o ON q.conv_id = o.conv_id AND q.unit = o.unit AND o.level = 0 AND o.turn < q.turn
  WHERE q.level > 0 AND q.unit <> '' GROUP BY ALL),
p AS (SELECT conv_id, turn, count(*) AS linked_passages, arg_min(origin, level * 1000000000000 - origin) AS reply_to FROM f GROUP BY ALL),
w AS (SELECT conv_id, turn, reply_to AS root FROM p UNION ALL SELECT w.conv_id, w.turn, p.reply_to FROM w JOIN p ON w.conv_id = p.conv_id AND w.root = p.turn),
t AS (SELECT conv_id, turn, min(root) AS root FROM w GROUP BY ALL),
q AS (SELECT k, count(*) FILTER (WHERE regexp_matches(line, '^\s*>')) AS quoted_lines, max(level) AS quote_depth,
  string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT regexp_matches(line, '^\s*>')) AS clean FROM x GROUP BY k)
SELECT m.conv_id, m.turn, m.role, CASE WHEN m.text IS NOT NULL THEN coalesce(q.clean, '') END AS text,
  CAST(coalesce(q.quoted_lines, 0) AS BIGINT) AS quoted_lines, CAST(coalesce(q.quote_depth, 0) AS BIGINT) AS quote_depth,
  CAST(coalesce(p.linked_passages, 0) AS BIGINT) AS linked_passages, p.reply_to, coalesce(t.root, m.turn) AS thread_root
FROM m LEFT JOIN q ON q.k = m.k LEFT JOIN p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x FROM p),
f AS (SELECT x, min(page_id) AS first, count(*) AS times FROM d GROUP BY x),
j AS (SELECT d.page_id, d.n, d.x, CASE WHEN f.times > 1 AND d.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to FROM d JOIN f ON d.x = f.x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST(('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM j
"""


def _op9_sql() -> str:
    """The scan by brute force: every window of a template's class, without hashes."""
    values = []
    for name, text in sorted(licenses.TEMPLATES.items()):
        sh = licenses.template_shingles(text)
        size = 1
        while size < len(sh):
            size *= 2
        values.append(f"('{name}', {size}, [{', '.join(repr(s) for s in sh)}])")
    return f"""
WITH t(license, c, sh) AS (VALUES {', '.join(values)}),
d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
s AS (SELECT doc_id, list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) AS sh FROM d WHERE len(w) >= 5),
k AS (SELECT s.doc_id, t.license, t.c, t.sh AS want, s.sh AS own, unnest(generate_series(0, (len(s.sh) - 1) // t.c)) AS k FROM s, t WHERE list_has_any(s.sh, t.sh)),
v AS (SELECT doc_id, license, len(list_intersect(want, own[k * c + 1 : k * c + 2 * c])) / len(want) AS share,
  list_min(list_filter(generate_series(k * c, least(k * c + 2 * c, len(own)) - 1), lambda i: list_contains(want, own[i + 1]))) AS word FROM k)
SELECT doc_id, license, round(max(share), 6) AS containment, CAST(min(word) AS BIGINT) AS first_word
FROM v WHERE share >= 0.8 GROUP BY doc_id, license
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express."""
    return {"op4_neighbours": OP4_SQL, "op5_quotations": OP5_SQL, "op8_warc": OP8_SQL, "op9_licenses": _op9_sql()}
