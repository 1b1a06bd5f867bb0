"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import embedding, exact_dedup, html, licenses, line_dedup, merkle, minhash, mixing, periodic, quality, secrets, sentencepiece, token_counts
from vitrine.llm.common import read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(read(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids", "round_trip")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), size=4, percent=80)


def op5_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_embeddings(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "removed_words", "removed_lines")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def repeating_words(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of a row; a tenth of the ids repeat a stretch of them up to the end."""
    words = periodic.words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(read(spark, sf_dir, "documents"), split=repeating_words, with_text=False).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose crc32(doc_id) is divisible by 7 claim one character more than they have."""
    docs = read(spark, sf_dir, "documents")
    tampered = F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 0 AND n_chars IS NOT NULL")
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    return merkle.proofs(docs, "doc_id", "lang", merkle.FIELDS, claim=F.when(tampered, merkle.leaf(changed)))


OP13_SQL = """
WITH RECURSIVE field AS (
  SELECT row_number() OVER () AS r, doc_id, lang, n_chars,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
      lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS h
  FROM documents),
leaf AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(h, 4294967295) % 7 = 0
      THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS claim
  FROM field),
node AS (
  SELECT r, coalesce('=' || lang, '') AS tree, 0 AS lvl, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i,
         leaf AS digest, count(*) OVER (PARTITION BY lang) AS n
  FROM leaf
  UNION ALL
  SELECT NULL, tree, any_value(lvl) + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), any_value((n + 1) // 2)
  FROM node WHERE n > 1 GROUP BY tree, i // 2),
crown AS (
  SELECT tree, 0 AS lvl, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, digest, count(*) OVER () AS n FROM node WHERE n = 1
  UNION ALL
  SELECT NULL, any_value(lvl) + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), any_value((n + 1) // 2)
  FROM crown WHERE n > 1 GROUP BY i // 2),
walk AS (
  SELECT n.r, n.tree, 0 AS lvl, n.i, '' AS seen, coalesce(l.claim, l.leaf) AS fold FROM node n JOIN leaf l ON l.r = n.r
  UNION ALL
  SELECT w.r, w.tree, w.lvl + 1, w.i // 2, w.seen || coalesce(s.digest, ''),
         sha256(CASE WHEN w.i % 2 = 0 THEN w.fold || coalesce(s.digest, '') ELSE s.digest || w.fold END)
  FROM walk w JOIN node x ON x.tree = w.tree AND x.lvl = w.lvl AND x.i = w.i AND x.n > 1
  LEFT JOIN node s ON s.tree = w.tree AND s.lvl = w.lvl AND s.i = xor(w.i, 1)),
climb AS (
  SELECT w.r, w.tree, 0 AS lvl, c.i, w.seen, w.fold, x.digest AS subroot
  FROM walk w JOIN node x ON x.tree = w.tree AND x.lvl = w.lvl AND x.n = 1 JOIN crown c ON c.tree = w.tree
  UNION ALL
  SELECT w.r, w.tree, w.lvl + 1, w.i // 2, w.seen || coalesce(s.digest, ''),
         sha256(CASE WHEN w.i % 2 = 0 THEN w.fold || coalesce(s.digest, '') ELSE s.digest || w.fold END), w.subroot
  FROM climb w JOIN crown x ON x.lvl = w.lvl AND x.i = w.i AND x.n > 1
  LEFT JOIN crown s ON s.lvl = w.lvl AND s.i = xor(w.i, 1))
SELECT l.doc_id, l.leaf, c.subroot, x.digest AS root, sha256(c.seen) AS proof_sha256, c.fold AS folded_root, c.fold = x.digest AS verified
FROM leaf l JOIN climb c ON c.r = l.r JOIN crown x ON x.lvl = c.lvl AND x.n = 1"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_minhash": op3_minhash,
    "op4_licenses": op4_licenses,
    "op5_embedding": op5_embedding,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_periodic": op11_periodic,
    "op12_html": op12_html,
    "op13_merkle": op13_merkle,
}
ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op13_merkle": OP13_SQL}
