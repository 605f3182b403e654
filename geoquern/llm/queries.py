"""Registered queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_topk, license_scan, ngram_join, quality, sentencepiece_codec, sharding, substring_dedup, token_counts, toxicity

SHARDS = 8
TOXIC_FROM = 0.3
KEEP_FROM = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of every document."""
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), check=True)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), with_text=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, end, edits of every region that matches a benchmark item."""
    return decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail_probability, keep of every document."""
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))
    return scored.withColumn("keep", (F.col("tail_probability") >= KEEP_FROM).cast("int"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place under the law ``rows``."""
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), n_shards=SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    return ngram_join.jaccard_classes(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out rows are not read."""
    docs = _table(spark, sf_dir, "documents")
    remainder = lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(4))
    fitted = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), where=remainder("_id") != 2)
    scored = toxicity.score_toxicity(docs, fitted)
    return scored.select("doc_id", F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffix sums of the length histogram: one row for every encoded length."""
    return token_counts.suffix_sums(token_counts.length_histogram(token_counts.encoded_lengths(_table(spark, sf_dir, "documents"))))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return exact_topk.exact_topk(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_substring_dedup, op3_decontamination, op4_quality, op5_sharding, op6_licenses, op7_ngram_join, op8_toxicity, op9_token_counts, op10_exact_topk)}


SQL_OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS g FROM p),
f AS (SELECT g, min(struct_pack(a := doc_id, b := s)) AS o FROM h GROUP BY g),
r AS (SELECT h.doc_id, h.s FROM h JOIN f USING (g) WHERE struct_pack(a := h.doc_id, b := h.s) <> f.o),
g AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 20)))) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(d.w) AS n, coalesce(len(g.gone), 0) AS m,
  CASE WHEN g.gone IS NULL THEN d.w ELSE list_transform(list_filter(range(len(d.w)), lambda i: NOT list_contains(g.gone, i)), lambda i: d.w[i + 1]) END AS kept
  FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

SQL_OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _sql_op6() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ",\n".join(f"({r['no']}, {r['priority']}, {r['confidence']}, {quote(r['label'])}, {quote(r['kw'])}, {quote(r['rx'])})" for r in license_scan.rules())
    base = " || ".join(f"list_transform(list_filter(range(len(w) - {len(p.split()) - 1}), lambda i: {' AND '.join(f'w[i + {k + 1}] = {quote(x)}' for k, x in enumerate(p.split()))}), lambda i: struct_pack(at := i, label := {quote(label)}))" for p, label in license_scan.BASE)
    gate = " OR ".join(f"contains(lower(coalesce(text, '')), {quote(s)})" for s in license_scan.STEMS)
    n = "(len({0}) - len(replace({0}, ' ', ''))) // 2"
    return rf"""
WITH rules(no, priority, confidence, label, kw, rx) AS (VALUES
{table}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.WORD}') AS w, ({gate}) AS gate FROM documents),
b AS (SELECT rid, doc_id, len(w) AS n_words, {base} AS base FROM d),
g AS (SELECT rid, ' ' || array_to_string(w, '  ') || ' ' AS norm FROM d WHERE gate AND len(w) > 0),
c AS (SELECT g.rid, r.*, list_transform(string_split_regex(norm, rx), lambda x: {n.format('x')}) AS pieces,
  list_transform(regexp_extract_all(norm, rx), lambda x: {n.format('x')}) AS lens FROM g JOIN rules r ON contains(norm, kw) AND regexp_matches(norm, rx)),
m AS (SELECT rid, no, priority, confidence, label, pieces, lens, unnest(range(1, len(lens) + 1)) AS k FROM c),
t AS (SELECT rid, no, priority, confidence, label, CAST(list_sum(pieces[1:k]) + coalesce(list_sum(lens[1:k - 1]), 0) AS BIGINT) AS f, lens[k] AS n FROM m),
x AS (SELECT rid, label, confidence FROM t AS a WHERE NOT EXISTS (SELECT 1 FROM t AS e WHERE e.rid = a.rid AND e.f <= a.f AND a.f + a.n <= e.f + e.n
  AND (e.priority > a.priority OR (e.priority = a.priority AND (e.n > a.n OR (e.n = a.n AND e.no < a.no)))))),
y AS (SELECT rid, list(DISTINCT label) AS found, max(confidence) AS top FROM x GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(base, lambda z: z['at'])) AS BIGINT) AS first_word, CAST(list_max(list_transform(base, lambda z: z['at'])) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(base, lambda z: z['label']))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(base, lambda z: z['label']), coalesce(found, [])))), ',') AS labels,
  CAST(greatest(coalesce(top, 0), CASE WHEN len(base) > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
FROM b LEFT JOIN y USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": SQL_OP2, "op6_licenses": _sql_op6(), "op10_exact_topk": SQL_OP10}
