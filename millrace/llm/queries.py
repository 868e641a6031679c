"""The queries opN_<name>: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, jaccard, language, linear, lm, neighbours, packing, quality, store, tokenfile, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def toxicity_chain(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Chain:
    labels = _table(spark, sf_dir, "labels").selectExpr("doc_id", "1 - quality AS low_quality", "toxic")
    return toxicity.fit(docs, labels, ("low_quality", "toxic"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_chain(spark, sf_dir, docs))
    return found.select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"), (~F.col("is_toxic")).alias("kept"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = linear.fold_of(F.col("doc_id"), 5)
    found = lm.score(docs, lm.fit(docs, fold != 1))
    held = F.coalesce(linear.fold_of(F.col("doc_id"), 5) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


# The rules of the query: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), RULES, urls.fit())


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.Scratch(spark, "op4")
    files = tokenfile.write(_table(spark, sf_dir, "documents"), out.folder("tokens"), _vocabulary(), metadata=("lang", "source"), end_id=2)
    return tokenfile.digests(spark, files)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), _vocabulary())


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, _ = neighbours.near(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, _vocabulary()).selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = linear.fold_of(F.col("doc_id"), 3)
    found = language.predict(docs, language.fit(docs, fold != 1))
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), size=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_url_filter": op3_url_filter,
    "op4_token_files": op4_token_files,
    "op5_bpe": op5_bpe,
    "op6_neighbours": op6_neighbours,
    "op7_packing": op7_packing,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_jaccard_join": op10_jaccard_join,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
ORACLE: dict[str, str] = {
    "op10_jaccard_join": f"""
WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS} AS w FROM documents),
members AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM members GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM members a JOIN members b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * o >= 85 * (s.n + t.n - o)),
linked AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM reach r JOIN linked l ON r.b = l.x),
named AS (SELECT b AS doc_id, min(a) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN named USING (doc_id)""",
}
