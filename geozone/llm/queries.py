"""The registered queries of this subpackage: one `opN_<name>` per operator, with production parameters, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geozone.llm import bpe, byte_bpe, counts, langid, manifest, packing, pii, resample, simhash, sketch, suffix, topk, warc
from geozone.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
# Results that SQL can express too.
ORACLES: dict[str, str] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@register
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), length=50).drop("kept")


@register
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), least_bytes=0)


@register
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@register
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@register
def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    return counts.token_counts(table(spark, sf_dir, "documents"), counts.zipf_scores(counts.model_pieces(path)))


@register
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_versions(table(spark, sf_dir, "documents"))


@register
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


ORACLES["op7_topk"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, x -> floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@register
def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.read_model(path))


@register
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


@register
def op10_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return packing.pack(op5_token_counts(spark, sf_dir, vocabulary).select("doc_id", "n_tokens"))


@register
def op11_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), byte_bpe.read_ranks(path), public_tokenizers.PATTERN)


@register
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_resample"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), wanted AS (
  SELECT list_filter(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark
), runs AS (
  SELECT rid, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM (SELECT rid, w FROM words UNION ALL SELECT -1, w FROM wanted)
), counted AS (
  SELECT rid, f, count(*) AS n FROM runs GROUP BY rid, f
), known AS (
  -- The checksum bit by bit: each byte is mixed in, then come eight steps.
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      regexp_extract_all(hex(encode(f)), '..'), lambda h: [('0x' || h)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT rid, bucket, n FROM counted JOIN known USING (f)
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (rid > 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (rid = -1), 0)::DOUBLE AS t
  FROM hashed GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM totals) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000)))) AS gain
  FROM totals
), weights AS (
  SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM hashed JOIN gains USING (bucket) WHERE rid > 0 GROUP BY rid
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) +
    floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (rid)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND place <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank
FROM ranked
"""


@register
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.check_documents(table(spark, sf_dir, "documents"), manifest.tampered_ids())


ORACLES["op13_manifest"] = """
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS rid, doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS f1,
    coalesce(strlen(source) || ':' || source, '-') AS f2,
    coalesce(strlen(lang) || ':' || lang, '-') AS f3,
    coalesce(strlen(text) || ':' || text, '-') AS f5, n_chars,
    -- The checksum bit by bit: each byte is mixed in, then come eight steps.
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda d: [ord(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
  FROM documents
), leaves AS (
  SELECT rid, doc_id, lang,
    sha256(f1 || f2 || f3 || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || f5) AS leaf,
    sha256(f1 || f2 || f3 || coalesce(strlen((n_chars + t)::VARCHAR) || ':' || (n_chars + t), '-') || f5) AS tampered
  FROM (SELECT *, CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS t FROM given)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
), tree AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1
  GROUP BY lang, level, pos // 2, n
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 2, n
), climb AS (
  SELECT p.rid, p.lang, 0 AS level, p.pos, p.n, '' AS proof, p.tampered AS h FROM placed p
  UNION ALL
  SELECT c.rid, c.lang, c.level + 1, c.pos // 2, (c.n + 1) // 2, c.proof || coalesce(t.h, ''),
    sha256(CASE WHEN t.h IS NULL THEN c.h WHEN c.pos % 2 = 0 THEN c.h || t.h ELSE t.h || c.h END)
  FROM climb c LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM c.lang AND t.level = c.level AND t.pos = xor(c.pos, 1)
  WHERE c.n > 1
), above AS (
  SELECT c.rid, 0 AS level, s.pos, s.n, c.proof, c.h FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.rid, c.level + 1, c.pos // 2, (c.n + 1) // 2, c.proof || coalesce(t.h, ''),
    sha256(CASE WHEN t.h IS NULL THEN c.h WHEN c.pos % 2 = 0 THEN c.h || t.h ELSE t.h || c.h END)
  FROM above c LEFT JOIN upper t ON t.level = c.level AND t.pos = xor(c.pos, 1)
  WHERE c.n > 1
)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, sha256(a.proof) AS proof_sha256, a.h AS folded_root, a.h = r.h AS verified
FROM placed p JOIN above a ON a.rid = p.rid AND a.n = 1 JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
CROSS JOIN (SELECT h FROM upper WHERE n = 1) r
"""
