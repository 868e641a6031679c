"""Queries of tokens, vocabularies, counts and weights over the whole of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import estimators as E
from millrace.operators.frame import top_by
from millrace.plans.base import query, r

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_WORDS = "(SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[[:punct:]\\s]+'), lambda x: x <> '')) AS term, generate_subscripts(list_filter(regexp_split_to_array(lower(text), '[[:punct:]\\s]+'), lambda x: x <> ''), 1) AS pos FROM documents)"
_TERMS = f"(SELECT * FROM {_WORDS} WHERE term NOT IN ({_STOP}))"
_COUNTS = f"(SELECT doc_id, term, count(*) AS tf FROM {_TERMS} GROUP BY 1, 2)"
_DF = f"(SELECT term, count(*) AS df FROM {_COUNTS} GROUP BY 1)"
_N = "(SELECT count(*) FROM documents)"
_LIMITED = f"(SELECT term, df FROM {_DF} WHERE df / {_N} >= 0.01 AND df / {_N} <= 0.5 ORDER BY df DESC, term LIMIT 50)"
FIXED = ("house", "water", "time", "people")


def counts(d: DataFrame) -> DataFrame:
    return T.term_counts(d, "doc_id", "text")


def n_docs(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("n"))


def limited(d: DataFrame) -> DataFrame:
    return T.limited_vocabulary(counts(d), n_docs(d), 0.01, 0.5, 50)


query("tokenize", "documents", lambda d: d.select("doc_id", F.size(T.tokenize(F.col("text"))).alias("n"), F.size(T.tokenize(F.col("text"), [])).alias("all_words")), f"SELECT d.doc_id, CAST(coalesce(a.n, 0) AS INT) AS n, CAST(coalesce(a.m, 0) AS INT) AS all_words FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (term NOT IN ({_STOP})) AS n, count(*) AS m FROM {_WORDS} GROUP BY 1) a USING (doc_id)")
query("custom_tokenizer", "documents", lambda d: T.term_counts(d, "doc_id", "text", tokenizer=lambda t: F.split(t, " ")).groupBy("doc_id").agg(F.sum("tf").alias("n"), F.count("*").alias("terms")), "SELECT doc_id, count(*) AS n, count(DISTINCT term) AS terms FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM documents) GROUP BY 1")
query("vocab_build", "documents", lambda d: T.vocabulary(d, "doc_id", "text"), f"SELECT term, CAST(row_number() OVER (ORDER BY min((doc_id, pos)), term) - 1 AS INT) AS \"index\" FROM {_TERMS} GROUP BY term")
query("vocab_df_limits", "documents", limited, f"SELECT * FROM {_LIMITED}")
query("vocab_topk", "documents", lambda d: top_by(T.document_frequency(counts(d)), [F.col("df").desc(), F.col("term")], 20), f"SELECT * FROM {_DF} ORDER BY df DESC, term LIMIT 20")
query("count_vectorize", "documents", counts, f"SELECT * FROM {_COUNTS}")
query("count_vectorize_fixed_vocab", "documents", lambda d: T.Vectorizer(vocabulary=FIXED).counts(d, "doc_id", "text"), f"SELECT * FROM {_COUNTS} WHERE term IN {FIXED}")
query("idf", "documents", lambda d: T.idf(counts(d), n_docs(d)).withColumn("idf", r("idf", 6)), f"SELECT term, round(log10(({_N} + 1) / (df + 1)) + 1, 6) AS idf FROM {_DF}")
query("idf_plain", "documents", lambda d: T.idf(counts(d), n_docs(d), False).withColumn("idf", r("idf", 6)), f"SELECT term, round(log10({_N} / df) + 1, 6) AS idf FROM {_DF}")
_W = f"(SELECT doc_id, term, {{tf}} * (log10(({_N} + 1) / (df + 1)) + 1) AS w FROM {{counts}} JOIN {_DF} USING (term))"
for _name, _options, _tf, _size in (("none", {"norm": None}, "tf", "1"), ("l1", {}, "tf", "sum(abs(w)) OVER (PARTITION BY doc_id)"), ("l2", {"norm": "l2"}, "tf", "sqrt(sum(w * w) OVER (PARTITION BY doc_id))"), ("sublinear", {"sublinear": True}, "(log10(tf) + 1)", "sum(abs(w)) OVER (PARTITION BY doc_id)")):
    query(f"tfidf_{_name}", "documents", lambda d, o=_options: T.tfidf(counts(d), n_docs(d), "doc_id", **o).withColumn("weight", r("weight", 6)), f"SELECT doc_id, term, round(w / {_size}, 6) AS weight FROM {_W.format(tf=_tf, counts=_COUNTS)}")
query("tfidf_vectorize", "documents", lambda d: T.Vectorizer(min_df=0.01, max_df=0.5, max_features=50, norm="l2").weights(d, "doc_id", "text").withColumn("weight", r("weight", 6)), f"SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM {_W.format(tf='tf', counts=_COUNTS)} WHERE term IN (SELECT term FROM {_LIMITED})")
_NB = f"(SELECT t.term, g.lang, log10((coalesce(c, 0) + 1) / (g.total + (SELECT count(DISTINCT term) FROM {_TERMS}))) AS w FROM (SELECT DISTINCT term FROM {_TERMS}) t CROSS JOIN (SELECT lang, count(*) AS total FROM {_TERMS} GROUP BY 1) g LEFT JOIN (SELECT term, lang, count(*) AS c FROM {_TERMS} GROUP BY 1, 2) c ON c.term = t.term AND c.lang = g.lang)"


def bayes(d: DataFrame) -> DataFrame:
    return E.naive_bayes(d.filter("lang IS NOT NULL").select("lang", F.explode(T.tokenize(F.col("text"))).alias("term")), "lang")


query("nb_fit", "documents", lambda d: bayes(d).withColumn("weight", r("weight", 6)), f"SELECT term, lang, round(w, 6) AS weight FROM {_NB}")
query("nb_predict", "documents", lambda d: E.naive_bayes_predict(counts(d), bayes(d), "doc_id", "lang"), f"SELECT doc_id, lang AS prediction FROM (SELECT doc_id, lang, round(sum(tf * w), 9) AS s FROM {_COUNTS} JOIN {_NB} USING (term) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1")
