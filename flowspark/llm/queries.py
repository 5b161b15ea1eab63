"""The operators' registered queries, each over its whole table, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_topk, kneser_ney, lm_scoring, minhash_dedup, pii, quality_rules, sentencepiece_sampling, source_mixing, token_counts, warc
from .common import table

WORD = r"[^\x20\x09-\x0D]+"


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.link(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


_OP1 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i, len(w) AS n FROM d WHERE len(w) > 0),
q AS (SELECT doc_id, n, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, hash(concat_ws(' ', a, b, c, d, e)) AS h FROM q WHERE (n >= 5 AND i <= n - 4) OR (n < 5 AND i = 1)),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM x JOIN k ku ON ku.doc_id = u JOIN k kv ON kv.doc_id = v WHERE 100 * shared >= 85 * (ku.n + kv.n - shared)),
g AS (SELECT u AS a, v AS b FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT g.a, r.root FROM r JOIN g ON g.b = r.doc_id)
SELECT documents.doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id, documents.doc_id = min(r.root) AS kept
FROM documents LEFT JOIN k USING (doc_id) JOIN r ON r.doc_id = documents.doc_id GROUP BY documents.doc_id, k.n
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.derive(warc.responses_of(pages), keep=("page_id",)).drop("block", "record")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_scoring.score(docs, lm_scoring.fit(docs.where(~lm_scoring.held_out(F.col("doc_id")))))
    return out.select("doc_id", lm_scoring.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512, keep_text=False)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = quality_rules.judge(docs, keep_text=False)
    names = ("words", "word_chars", "symbols", "dup_lines", "repeat_words", "removed_words")
    return out.select("doc_id", *[F.col(f"q_{n}").alias(n if n == "word_chars" else f"n_{n}") for n in names], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


_OP6 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
h AS (SELECT source, count(DISTINCT text) AS of FROM d GROUP BY source),
l AS (SELECT doc_id, source, text, unnest(lines) AS line FROM w),
n AS (SELECT doc_id, source, text, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS norm FROM l),
m AS (SELECT doc_id, source, text, line, array_to_string(norm, ' ') AS norm, len(norm) AS k FROM n WHERE len(norm) > 0),
f AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT text) AS docs FROM m GROUP BY source, norm) JOIN h USING (source) WHERE docs > 10 AND docs > of * 0.01::DOUBLE),
g AS (SELECT m.doc_id, count(*) - count(DISTINCT m.line) AS dup, coalesce(sum(CASE WHEN f.norm IS NOT NULL THEN m.k END), 0) AS removed
      FROM m LEFT JOIN f ON m.source = f.source AND m.norm = f.norm GROUP BY m.doc_id),
t AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w),
v AS (SELECT doc_id, i, w, lead(w) OVER o AS x, lead(w, 2) OVER o AS y FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, x, y) AS c FROM v WHERE y IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM u WHERE c > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(g.dup, 0)::BIGINT AS n_dup_lines,
        coalesce(r.rep, 0)::BIGINT AS n_repeat_words, coalesce(g.removed, 0)::BIGINT AS n_removed_words
      FROM w LEFT JOIN g USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_removed_words <= 50 * n_words AS kept FROM s
"""


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = source_mixing.mix(docs)
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


_OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
level AS (
  SELECT 0 AS step, -1::BIGINT AS n, 0::BIGINT AS a, 0::BIGINT AS b, false AS done
  UNION ALL
  SELECT step + 1, x.n, x.total - x.held, x.opened, x.n = level.n OR x.opened = 0
  FROM level, LATERAL (SELECT coalesce(count(*) FILTER (full_), 0)::BIGINT AS n, coalesce(sum(source_size), 0)::BIGINT AS total, coalesce(sum(3 * source_size) FILTER (full_), 0)::BIGINT AS held, coalesce(sum(weight) FILTER (NOT full_), 0)::BIGINT AS opened
    FROM (SELECT *, step > 0 AND 3 * source_size * level.b <= level.a * weight AS full_ FROM s)) x
  WHERE NOT done AND step < 1000),
last AS (SELECT a, b FROM level WHERE b > 0 ORDER BY step DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN 3 * source_size * b <= a * weight THEN (3 * source_size)::DOUBLE ELSE least(a::DOUBLE * weight / b::DOUBLE, (3 * source_size)::DOUBLE) END AS target FROM s, last),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0::DOUBLE END AS rate,
        ('0x' || substr(md5('mix-1:' || d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT))::BIGINT AS taken FROM r
"""

def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepiece_sampling.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, alpha=1.0, seed=8, verify=True)
    ids = F.sha2(F.array_join("pieces", ","), 256)
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), "n_pieces", ids.alias("pieces_sha256"), "lossless")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return kneser_ney.classify(docs, trusted, keep_text=False)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.tag(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_warc": op2_warc,
    "op3_exact_topk": op3_exact_topk,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mixing": op7_source_mixing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_pii": op10_pii,
}

ORACLES: dict[str, str] = {"op1_minhash_dedup": _OP1, "op3_exact_topk": _OP3, "op6_quality_rules": _OP6, "op7_source_mixing": _OP7}
