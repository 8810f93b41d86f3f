"""One query for each operator, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_stream, cross_parse, decontaminate, interpolated_lm, pii, range_coder, scaled_sketch, suffix_merge, token_group_join, url_trie
from .store import table

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _crc(column: str, modulus: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def op1_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.scored(table(spark, sf_dir, "documents"), F.coalesce(_crc("doc_id", 5) != 1, F.lit(True)))


def op2_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_coder.read_ids(range_coder.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item it holds within the item's edit budget."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents")).drop("redacted")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.sketched(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_group_join.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_merge.deduplicated(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trie.judge_urls(table(spark, sf_dir, "pages"), url_trie.UrlTrie(RULES))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = _crc("doc_id", 4) == 2
    samples = cross_parse.sample_texts(docs.where(~held))
    return cross_parse.identify(docs, samples, F.col("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_interpolated_lm, op2_id_files, op3_benchmark_decontamination, op4_pii, op5_bpe_round_trip, op6_document_fingerprints, op7_jaccard_join, op8_suffix_dedup, op9_url_filter, op10_language_id)}

_HOST = "translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)"
ORACLES = {
    "op9_url_filter": f"""
        WITH parts AS (
          SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN {_HOST} ELSE '' END AS host,
                 CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN {_PATH} ELSE '' END AS path
          FROM pages),
        ruled AS (
          SELECT *, CASE
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
          FROM parts)
        SELECT page_id, host, path, rule, CASE WHEN rule IS NULL OR rule = 'example.com/en/7' THEN 'allow' ELSE 'block' END AS verdict FROM ruled""",
    # links between the least documents of equal sets; sets by 64-bit hashes, as 4-word shingles joined by one space
    "op7_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
          s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 3], ' ')) AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
          n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
          -- equal sets once
          k AS (SELECT doc_id, count(*) AS n, bit_xor(sh) AS x, sum(sh::HUGEINT // 3) AS y FROM s GROUP BY 1), c AS (SELECT n, x, y, min(doc_id) AS rep FROM k GROUP BY 1, 2, 3),
          m AS (SELECT k.doc_id, c.rep, c.n FROM k JOIN c ON k.n = c.n AND k.x = c.x AND k.y = c.y),
          r AS (SELECT s.doc_id, s.sh, c.n FROM s JOIN c ON s.doc_id = c.rep),
          p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.sh = b.sh AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
          e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
          t(node, top) AS (SELECT rep, rep FROM c UNION SELECT e.b, t.top FROM t JOIN e ON e.a = t.node AND t.top < e.b),
          g AS (SELECT node, min(top) AS top FROM t GROUP BY 1)
        SELECT d.doc_id, coalesce(m.n, 0) AS n_shingles, coalesce(g.top, d.doc_id) AS component_id FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN g ON g.node = m.rep""",
    # every 50-byte string by its hash, each with the least document that it starts in
    "op8_suffix_dedup": r"""
        WITH h AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
          c AS (SELECT doc_id, size, c, substr(x, 2000 * c + 1, 2098) AS x FROM (SELECT *, unnest(range(0, (size - 50) // 1000 + 1)) AS c FROM h WHERE size >= 50)),
          w AS (SELECT doc_id, 1000 * c + i AS i, hash(substr(x, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, c, x, unnest(range(0, least(1000, size - 49 - 1000 * c))) AS i FROM c)),
          f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
          hit AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.s = f.s AND f.first < w.doc_id),
          l AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM hit),
          g AS (SELECT doc_id, i, sum(CASE WHEN was IS NULL OR i > was + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM l),
          r AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY 1, 2),
          o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
          k AS (SELECT o.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans FROM o JOIN h ON o.doc_id = h.doc_id GROUP BY 1)
        SELECT h.doc_id, h.size AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.kept || substr(x, 2 * k.last + 1), x))) AS kept_sha256 FROM h LEFT JOIN k ON h.doc_id = k.doc_id""",
}
