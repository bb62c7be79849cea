"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embedding_dedup, html_extract, language, ngram_join, packing, quality, toxicity, url_filter


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held(folds: int, fold: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def op1_toxicity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", _held(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", _held(5, 0).alias("held_out"), "text_score", "metadata_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_chat_windows(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return chat.read_back(chat.format_windows(turns.unionByName(own), tokenizer_path()))


def op4_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op5_packing(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op6_url_filter(spark, sf_dir):
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op7_html_text(spark, sf_dir):
    return html_extract.extract_pages(_read(spark, sf_dir, "pages"))


def op8_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op9_language(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).select("doc_id", _held(3, 1).alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_chat_windows, op4_embedding_dedup, op5_packing, op6_url_filter, op7_html_text, op8_ngram_join, op9_language, op10_decontamination)}

ORACLES = {
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(c.m, v.vec_id)) AS component_id,
  least(v.vec_id, coalesce(c.m, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN c ON v.vec_id = c.a""",
    "op6_url_filter": """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '^(.*\\.)?(free-bets\\.example\\.com|cheap-pills\\.example\\.com|spam-farm\\.example\\.org)$') THEN 'block' ELSE 'allow' END AS verdict
FROM r""",
}
