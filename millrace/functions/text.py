"""Tokens, vocabularies, counts and weights of terms, in long format: a row for each text and term that occurs in it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words that are left out unless a caller gives others.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()
SEPARATORS = r"[\p{Punct}\p{IsWhite_Space}]+"


def tokenize(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-case runs between ASCII punctuation and white space, without stop words (given ones replace the default)."""
    stop = STOP_WORDS if stop is None else stop
    words = F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(list(stop))) if stop else words


def occurrences(docs: DataFrame, id: str, text: str, stop: list[str] | None = None, tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, pos, term. tokenizer: a function from text to an array of terms, in place of tokenize()."""
    terms = tokenizer(F.col(text)) if tokenizer else tokenize(F.col(text), stop)
    return docs.select(F.col(id), F.posexplode(terms).alias("pos", "term"))


def term_counts(docs: DataFrame, id: str, text: str, stop: list[str] | None = None, tokenizer: Callable[[Column], Column] | None = None, terms: DataFrame | None = None) -> DataFrame:
    """id, term, tf; of the terms in terms (column term) alone, if given.

    Texts meet by their id before they are cut into terms, so that counting moves nothing; given terms are looked up before anything is counted.
    """
    own = docs.select(F.col(id), F.col(text).alias("_text"))
    if terms is None:
        own = own.repartition(F.col(id))
    words = own.select(F.col(id), F.explode(tokenizer(F.col("_text")) if tokenizer else F.split(F.lower("_text"), SEPARATORS)).alias("term"))
    if not tokenizer:
        out = STOP_WORDS if stop is None else stop
        words = words.filter(~F.col("term").isin(["", *out]))
    if terms is not None:
        words = words.join(terms.select("term"), "term", "left_semi")
    return words.groupBy(id, "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(docs: DataFrame, id: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """term and index, by first appearance (least id, then position). Only the distinct terms meet in one window."""
    first = occurrences(docs, id, text, stop).groupBy("term").agg(F.min(F.struct(id, "pos")).alias("at"))
    return first.select("term", (F.row_number().over(Window.orderBy("at", "term")) - 1).alias("index"))


def limited_vocabulary(counts: DataFrame, n_docs: DataFrame, min_df: float = 0.0, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """term and df of the terms in a part of the texts from min_df to max_df, both included; of these the max_features with the greatest df, of ties the least terms."""
    if not 0 <= min_df < max_df <= 1:
        raise ValueError("0 <= min_df < max_df <= 1 does not hold")
    kept = document_frequency(counts).crossJoin(F.broadcast(n_docs)).filter(F.col("df") / F.col("n") >= min_df).filter(F.col("df") / F.col("n") <= max_df).select("term", "df")  # n_docs: one row
    return kept if max_features is None else kept.orderBy(F.desc("df"), "term").limit(max_features)


def inverse_frequency(df: Column, n: Column, smooth: bool = True) -> Column:
    return F.log10((n + 1) / (df + 1)) + 1 if smooth else F.log10(n / df) + 1


def idf(counts: DataFrame, n_docs: DataFrame, smooth: bool = True) -> DataFrame:
    """term and idf. n_docs: one row with n."""
    return document_frequency(counts).crossJoin(F.broadcast(n_docs)).select("term", inverse_frequency(F.col("df"), F.col("n"), smooth).alias("idf"))


FREQUENT = 0.001  # of the texts: terms in as many are sent to all tasks


def tfidf(counts: DataFrame, n_docs: DataFrame, id: str, sublinear: bool = False, norm: str | None = "l1", smooth: bool = True) -> DataFrame:
    """id, term and weight: tf (or 1 + its logarithm) times idf, each text's weights to length 1 by l1 or l2. n_docs: one row with n.

    Frequent terms, at most as many as 1000 texts have terms, are sent to all tasks, so most counts stay where they are; those of
    other terms meet their idf by an exchange.
    """
    tf = F.log10("tf") + 1 if sublinear else F.col("tf").cast("double")
    all_idf = document_frequency(counts).crossJoin(F.broadcast(n_docs)).select("term", inverse_frequency(F.col("df"), F.col("n"), smooth).alias("idf"), (F.col("df") >= F.col("n") * FREQUENT).alias("often"))
    often = F.broadcast(all_idf.filter("often").select("term", "idf"))
    weight = (tf * F.col("idf")).alias("weight")
    near = counts.join(often, "term").select(id, "term", weight)
    far = counts.join(often, "term", "left_anti").join(all_idf.filter("NOT often").select("term", "idf").hint("merge"), "term").select(id, "term", weight)
    if norm is None:
        return near.unionByName(far)
    w = near.unionByName(far.repartition(F.col(id)))  # both lie by id where counts are those of term_counts()
    own = Window.partitionBy(id)
    size = F.sum(F.abs("weight")).over(own) if norm == "l1" else F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(own))
    return w.withColumn("weight", F.try_divide(F.col("weight"), size))


@dataclass(frozen=True)
class Vectorizer:
    """Options of a count or tf-idf vectorizer; set() changes some."""

    stop: list[str] | None = None
    tokenizer: Callable[[Column], Column] | None = None
    min_df: float = 0.0
    max_df: float = 1.0
    max_features: int | None = None
    vocabulary: tuple[str, ...] | None = None
    norm: str | None = "l1"
    smooth: bool = True
    sublinear: bool = False

    def set(self, **options) -> Vectorizer:
        return replace(self, **options)

    def df_limits(self, min_df: float = 0.0, max_df: float = 1.0) -> Vectorizer:
        """Sets both limits; a side that is not given goes back to its default."""
        return replace(self, min_df=min_df, max_df=max_df)

    def _n(self, docs: DataFrame) -> DataFrame:
        return docs.agg(F.count("*").alias("n"))

    def fit(self, docs: DataFrame, id: str, text: str) -> DataFrame:
        """The terms that transform() counts, in the column term."""
        if self.vocabulary is not None:
            return F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in self.vocabulary], "term string"))
        terms = limited_vocabulary(term_counts(docs, id, text, self.stop, self.tokenizer), self._n(docs), self.min_df, self.max_df, self.max_features).select("term")
        return terms if self.max_features is None or self.max_features > 100_000 else F.broadcast(terms)

    def transform(self, docs: DataFrame, terms: DataFrame, id: str, text: str) -> DataFrame:
        """id, term, tf; terms that are not in the vocabulary do not count."""
        return term_counts(docs, id, text, self.stop, self.tokenizer, terms)

    def counts(self, docs: DataFrame, id: str, text: str) -> DataFrame:
        return self.transform(docs, self.fit(docs, id, text), id, text)

    def weights(self, docs: DataFrame, id: str, text: str) -> DataFrame:
        return tfidf(self.counts(docs, id, text), self._n(docs), id, self.sublinear, self.norm, self.smooth)
