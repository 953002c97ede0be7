"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolarium.llm.bpe import bpe_digests
from symbolarium.llm.delta_lloyd import centroid_clusters
from symbolarium.llm.disclosure import personal_data_digests
from symbolarium.llm.kneser_ney import ngram_scores
from symbolarium.llm.language_id import language_id
from symbolarium.llm.lz_fingerprint import lz_fingerprints
from symbolarium.llm.ngram_join import ngram_jaccard_components
from symbolarium.llm.packing import pack
from symbolarium.llm.prefix_trie import conversation_trie
from symbolarium.llm.quality import quality_verdicts
from symbolarium.llm.sharding import compacted_documents
from symbolarium.llm.toxicity import toxicity
from symbolarium.llm.url_cascade import judge_urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_documents(spark, sf_dir).select("doc_id", "text"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_documents(spark, sf_dir).select("doc_id", "text", F.col("source").alias("host")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_digests(_documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN)


def op5_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compacted_documents(_documents(spark, sf_dir).select("doc_id", "text"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_scores(_documents(spark, sf_dir).select("doc_id", "text"))


URL_RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprints(_documents(spark, sf_dir).select("doc_id", "text"))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    nodes = conversation_trie(conversations.select("conv_id", "turn", "role", "text"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digests(_documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_line_frequency": op3_line_frequency,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_size_tiered_sharding": op5_size_tiered_sharding,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_url_cascade": op7_url_cascade,
    "op8_toxicity": op8_toxicity,
    "op9_lz_fingerprint": op9_lz_fingerprint,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_delta_lloyd": op11_delta_lloyd,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_disclosure": op13_disclosure,
}

# Candidates by documents with different lines; then copies, whose other lines are made of pairs of
# words from candidates, count once for each rarest candidate.
_LINE_FREQUENCY_SQL = r"""
WITH base AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, source, i, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM base WHERE text IS NOT NULL)
), worded AS MATERIALIZED (
  SELECT doc_id, coalesce(source, chr(1)) AS host, i, line, lw, len(lw) AS size, array_to_string(lw, ' ') AS norm FROM lines WHERE len(lw) > 0
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), once AS MATERIALIZED (
  SELECT doc_id, host, norm, any_value(lw) AS lw, min(i) AS place FROM worded GROUP BY doc_id, host, norm
), whole AS MATERIALIZED (
  SELECT doc_id, host, md5(array_to_string(list_sort(list(norm)), chr(10))) AS document FROM once GROUP BY doc_id, host
), raw AS (
  SELECT o.host, norm, count(DISTINCT document) AS held FROM once o JOIN whole USING (doc_id) GROUP BY o.host, norm
), candidates AS MATERIALIZED (
  SELECT raw.* FROM raw JOIN (SELECT host, count(DISTINCT document) AS documents FROM whole GROUP BY host) h USING (host) WHERE held > 1000 OR (held > 20 AND held * 100 > 2 * documents)
), pairs AS MATERIALIZED (
  SELECT doc_id, host, norm, unnest(CASE WHEN len(lw) = 1 THEN lw ELSE list_transform(range(1, len(lw)), lambda k: lw[k] || ' ' || lw[k + 1]) END) AS pair FROM once
), known AS MATERIALIZED (
  SELECT DISTINCT host, pair FROM pairs SEMI JOIN candidates USING (host, norm)
), holds AS MATERIALIZED (
  SELECT o.doc_id, host, norm, held, place FROM once o JOIN candidates USING (host, norm)
), other AS (
  SELECT p.doc_id, count(*) AS total, count(k.pair) AS met FROM pairs p LEFT JOIN known k USING (host, pair)
  WHERE p.doc_id IN (SELECT doc_id FROM holds) AND (p.host, p.norm) NOT IN (SELECT (host, norm) FROM candidates) GROUP BY p.doc_id
), rarest AS (
  SELECT doc_id, arg_min(norm, (held, place)) AS norm FROM holds GROUP BY doc_id
), names AS MATERIALIZED (
  SELECT w.doc_id, w.host, CASE WHEN r.norm IS NULL OR 2 * met < total THEN document ELSE 'copies of ' || r.norm END AS name
  FROM whole w LEFT JOIN other USING (doc_id) LEFT JOIN rarest r USING (doc_id)
), frequent AS MATERIALIZED (
  SELECT host, norm FROM (SELECT h.host, norm, count(DISTINCT name) AS held FROM holds h JOIN names USING (doc_id) GROUP BY h.host, norm)
  JOIN (SELECT host, count(DISTINCT name) AS documents FROM names GROUP BY host) d USING (host) WHERE held > 1000 OR (held > 20 AND held * 100 > 2 * documents)
), taken AS (
  SELECT doc_id, sum(size) AS taken FROM worded SEMI JOIN frequent USING (host, norm) GROUP BY doc_id
), stats AS (
  SELECT base.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(taken, 0) AS taken
  FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN taken USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * taken <= 70 * n_words AS kept,
       CAST(taken AS BIGINT) AS n_removed_words
FROM stats
"""

_URL_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fit USING (page_id)
"""

_JOIN_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""



def _lloyd_sql(rounds: int) -> str:
    """Plain Lloyd with every comparison in every round: whole numbers in doubles, so exact."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, best.c AS c, best.d AS d FROM (
    SELECT vec_id, any_value(v.v) AS v, min({{'d': list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, m.v) + list_inner_product(m.v, m.v), 'c': m.c}}) AS best
    FROM kept v CROSS JOIN c{r} m GROUP BY vec_id
  )
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT c, list(CAST((s - (s % n + n) % n) // n AS DOUBLE) ORDER BY i) AS v FROM (
    SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i
  ) GROUP BY c
), c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY mark) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS mark, v FROM kept ORDER BY mark LIMIT 40)
), {", ".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(m.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON a.c = m.c
"""


# Nodes by their whole text; CRC-32 bit by bit.
_TRIE_SQL = r"""
WITH RECURSIVE ids AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS c FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc(conv_id, c, i, v) AS (
  SELECT conv_id, c, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT conv_id, c, i + 1, xor(w >> 1, 3988292384 * (w & 1))
  FROM (SELECT conv_id, c, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(c, i // 8 + 1, 1))) ELSE v END AS w FROM crc WHERE i < 8 * length(c))
), heads AS MATERIALIZED (
  SELECT conv_id, xor(v, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS first FROM crc WHERE i = 8 * length(c)
), turns AS MATERIALIZED (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY kind, pos) AS depth, t FROM (
    SELECT h.conv_id, 1 AS kind, pos, t FROM heads h JOIN turns b ON b.conv_id = h.first AND pos < h
    UNION ALL
    SELECT conv_id, 2, pos, t FROM turns JOIN heads USING (conv_id) WHERE pos >= h
  )
), paths AS MATERIALIZED (
  SELECT conv_id, depth, list(t) OVER (PARTITION BY conv_id ORDER BY depth) AS path, t.text AS text FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, [], '' FROM heads
), ended AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths
), nodes AS MATERIALIZED (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS saving,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM ended GROUP BY path, depth
), kids AS MATERIALIZED (
  SELECT path[:-2] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), sized AS MATERIALIZED (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)
), sums AS (
  SELECT path, sum(saving) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT unnest(list_transform(range(depth + 1), lambda d: path[:d])) AS path, saving, n_children FROM sized) GROUP BY path
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM sized n JOIN sums USING (path) LEFT JOIN sized p ON n.depth > 0 AND p.path = n.path[:-2]
"""


ORACLE_SQL: dict[str, str] = {
    "op12_prefix_trie": _TRIE_SQL,
    "op11_delta_lloyd": _lloyd_sql(5),
    "op10_ngram_jaccard_join": _JOIN_SQL,
    "op7_url_cascade": _URL_SQL,
    "op3_line_frequency": _LINE_FREQUENCY_SQL,
}
