"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskey.llm import bm25, langid, quality, sentencepiece_lattice
from locuskey.llm.embedding_dedup import near_vectors
from locuskey.llm.hard_negatives import mine
from locuskey.llm.importance_resampling import resample
from locuskey.llm.jaccard_join import similar_documents
from locuskey.llm.packing import pack
from locuskey.llm.piecewise_hash import compare_with_next
from locuskey.llm.scratch import new_path
from locuskey.llm.sharding import place, write_shards
from locuskey.llm.substring_dedup import remove_repeated_windows
from locuskey.llm.warc import read_archives, resolve_revisits, write_archives


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_windows(docs, width=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return resolve_revisits(read_archives(index))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=4096, end_id=2).drop("ids")


#: The shards of op5_sharding.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(_read(spark, sf_dir, "documents"), SHARDS)
    path = new_path(spark, "shards")
    write_shards(placed, path)
    return spark.read.schema(placed.schema).parquet(path).select("doc_id", "slot", "shard")


def op6_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.search(docs, docs.where("doc_id % 20 = 0"), k=10)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_lattice.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.label(docs.drop("lang"), langid.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.95)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, _read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_packing": op4_packing,
    "op5_sharding": op5_sharding,
    "op6_exact_topk_search": op6_exact_topk_search,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_language_id": op8_language_id,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_piecewise_hash": op13_piecewise_hash,
}

ORACLE: dict[str, str] = {
    "op1_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS latest FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(d, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> latest THEN latest END AS refers_to FROM q""",
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[j : j + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS j FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a, b FROM o JOIN n i ON a = i.doc_id JOIN n j ON b = j.doc_id WHERE 100 * m >= 80 * (i.n + j.n - m)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, p.b FROM reach JOIN p ON reach.r = p.a),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)""",
    "op9_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, p.b FROM reach JOIN p ON reach.r = p.a),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j, len(ws) AS n FROM d),
h AS (SELECT doc_id, j, array_to_string(ws[j : j + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS j FROM d WHERE len(ws) >= 35)),
f AS (SELECT doc_id, j FROM h WHERE s IN (SELECT s FROM h GROUP BY s HAVING count(*) > 1)),
c AS (SELECT w.*, count(f.j) OVER (PARTITION BY w.doc_id ORDER BY w.j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone FROM w LEFT JOIN f ON w.doc_id = f.doc_id AND w.j = f.j),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op11_hard_negatives": """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10""",
    "op12_importance_resampling": r"""
WITH k AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS m FROM (SELECT unnest(range(256)) AS i)),
x AS (SELECT doc_id AS id, text, true AS doc FROM documents UNION ALL SELECT item_id, text, false FROM benchmark),
w AS MATERIALIZED (SELECT id, doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x),
f AS MATERIALIZED (SELECT id, doc, unnest(ws) AS f FROM w UNION ALL SELECT id, doc, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) > 1),
h AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(1, strlen(f) + 1), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)), lambda c, b: xor(m[xor(c & 255, b) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM f), k),
n AS MATERIALIZED (SELECT b, count(*) FILTER (WHERE doc) AS s, count(*) FILTER (WHERE NOT doc) AS t FROM f JOIN h USING (f) GROUP BY b),
g AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM n) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n),
d AS (SELECT id, count(*) AS n, sum(gain) AS total FROM f JOIN h USING (f) JOIN g USING (b) WHERE doc GROUP BY id),
r AS (SELECT w.id AS doc_id, len(ws) >= 20 AS able, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('7:' || w.id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d USING (id) WHERE doc),
q AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS of FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * of // 100 THEN place END AS rank FROM o""",
}
