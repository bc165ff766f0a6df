"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm import (
    alignment, bpe, langid, licences, lines, ngram_join, packing, prefixes, quality, sharding, urls, vectors, warc,
)
from trialframe.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_ngram_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their copies, links and groups by word 5-gram similarity."""
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


@query("op7_licence_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families named in every document."""
    return licences.licences(table(spark, sf_dir, "documents"))


@query("op8_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out quarter."""
    return langid.languages(table(spark, sf_dir, "documents"))


@query(
    "op4_quality_rules",
    r"""
WITH lines AS (
  SELECT doc_id, source, idx, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS idx
        FROM documents)
),
words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols
  FROM documents
),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM windows) WHERE n > 1)
  GROUP BY doc_id
),
doubled AS (
  SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n FROM lines WHERE len(words) > 0 GROUP BY doc_id, line)
  GROUP BY doc_id
),
contents AS (SELECT doc_id, array_to_string(w, ' ') AS content FROM words),
held AS (
  SELECT l.doc_id, source, content, norm, sum(n) AS words FROM (
    SELECT doc_id, source, len(words) AS n,
           translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
    FROM lines WHERE len(words) > 0) l JOIN contents USING (doc_id)
  GROUP BY ALL
),
sizes AS (SELECT source, count(DISTINCT content) AS documents FROM documents JOIN contents USING (doc_id) GROUP BY source),
frequent AS (
  SELECT source, norm, min(doc_id) AS first_doc FROM held JOIN sizes USING (source)
  GROUP BY source, norm, documents
  HAVING count(DISTINCT content) > 20 AND count(DISTINCT content) > 0.01 * documents
),
lost AS (
  SELECT doc_id, sum(words) AS removed FROM held JOIN frequent USING (source, norm)
  WHERE doc_id <> first_doc GROUP BY doc_id
)
SELECT *, NOT base_failed AND n_words - n_words_removed >= 0.3 * n_words AS kept FROM (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed, 0) AS BIGINT) AS n_words_removed,
         len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN doubled USING (doc_id) LEFT JOIN lost USING (doc_id))
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.rejected(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_words_removed", "base_failed", "kept",
    )


@query("op1_embedding_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of near-equal vectors of one label."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, lines removed as repeats, digest of the text that is left."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("left", F.lit("")), 256).alias("left_sha256")
    )


@query(
    "op9_warc_fixity",
    r"""
WITH records AS (
  SELECT page_id, strlen(record) AS length, sha256(record) AS digest,
         sha256('~' || substr(record, 2)) AS damaged
  FROM (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
          || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
          || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
          || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
          || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
        FROM pages)
),
runs AS (
  SELECT page_id // 1024 AS archive, page_id, length, digest, damaged, count(*) AS copies
  FROM records GROUP BY ALL
),
placed AS (
  SELECT *, coalesce(sum(length * copies) OVER (PARTITION BY archive ORDER BY page_id, digest
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM runs
)
SELECT CAST(archive AS BIGINT) AS archive, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
       copies, page_id, CASE WHEN digest < '03' THEN 'altered' ELSE 'missing' END AS kind,
       digest AS primary_digest, CASE WHEN digest < '03' THEN damaged END AS replica_digest
FROM placed WHERE digest < '03' OR digest >= 'fd'
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the pages' archives that a replica with damage holds wrong or not at all.

    The replica derives from the pages: records whose digest begins below 03
    have another first byte, and those from fd on are lost.
    """
    pages = table(spark, sf_dir, "pages")
    damaged = F.concat(F.lit("~"), F.expr("substring(text, 2)"))
    held = F.when(F.col("digest") < "03", damaged).when(F.col("digest") < "fd", F.col("text"))
    both = warc.manifest(pages, held)
    replica = both.where("stored is not null").withColumn("digest", F.col("stored"))
    return warc.audit(both.drop("stored"), replica.drop("stored"))


@query("op11_sharding")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 40 shards of nearly equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


@query(
    "op12_prefix_trie",
    r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
sizes AS (
  SELECT c, max(i) AS n, c - c % 5 AS lender,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
          list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
        lambda crc, x: list_reduce(list_concat([xor(crc, x)], [CAST(0 AS BIGINT) for k in range(8)]),
          lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 9 AS h
  FROM turns GROUP BY c
),
convs AS (
  SELECT s.c, s.n, s.lender, s.h, least(s.h, coalesce(l.n, 0)) AS lent FROM sizes s LEFT JOIN sizes l ON l.c = s.lender
),
built AS (
  SELECT c, i - h + lent AS depth, role, text FROM turns JOIN convs USING (c) WHERE i > h
  UNION ALL
  SELECT v.c, i, role, text FROM turns t JOIN convs v ON t.c = v.lender WHERE i <= h
),
paths AS (
  SELECT c, depth, strlen(text) AS bytes,
         string_agg(sha256(role || chr(0) || text), '') OVER (PARTITION BY c ORDER BY depth) AS node
  FROM built
  UNION ALL SELECT c, 0, 0, '' FROM convs
),
nodes AS (
  SELECT depth, node, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM paths GROUP BY depth, node
),
families AS (
  SELECT n.*, substr(node, 1, 64 * (depth - 1)) AS parent FROM nodes n
),
children AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM families WHERE depth > 0 GROUP BY ALL
),
weighed AS (
  SELECT n.depth, node, n.conv_id, n.n_convs, (n.n_convs - 1) * n.bytes AS saved,
         coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (depth, node)
),
summed AS (
  SELECT p.depth, p.node, count(*) FILTER (w.n_children = 0) AS n_leaves, sum(w.saved) AS saved_tokens
  FROM weighed w JOIN paths p ON p.c = w.conv_id AND p.depth <= w.depth GROUP BY p.depth, p.node
),
ends AS (
  SELECT depth, node, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256
  FROM paths JOIN (SELECT c, lent + greatest(n - h, 0) AS depth FROM convs) USING (c, depth) GROUP BY ALL
)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs,
       CAST(w.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM weighed w JOIN summed USING (depth, node) LEFT JOIN ends USING (depth, node)
LEFT JOIN nodes u ON u.depth = w.depth - 1 AND u.node = substr(w.node, 1, 64 * (w.depth - 1))
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefixes.trie(table(spark, sf_dir, "conversations"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens of every document are linked."""
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), a, b)


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
