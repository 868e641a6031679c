"""Quality rules by the divergence of a document's histograms from those of its language.

A document has a histogram of character classes and one of common words (and all others). The
references are the sums of the same histograms over all documents of a language. The Jensen-Shannon
distance (base 2, 0 to 1) between a document and the reference of its language rejects documents
that are far away: by characters beyond a fixed distance, by common words beyond a part of the
distance that a text without any common word has from the reference; a document whose language is null or has no reference is compared with that
nearest to it. A histogram over fewer words than its minimum is not judged. Only built-in column functions are used.

Defined results: a null text has no words, and fails for fewer than the least words; empty texts
alike; texts are read whole; null and repeated ids are kept, one result per row; an empty table
gives an empty result; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import store

# Frequent function words of four languages.
COMMON = {
    "en": "the of and to in is that for it as was with be by on are at from this an he had".split(),
    "fr": "le la de des et les un une du en que qui dans pour par sur au est il elle ne pas".split(),
    "de": "der die das und in zu den von mit ist des ein eine auf für im nicht dem sich es als auch".split(),
    "es": "el la de que y en un los del se las por con no una su para es al lo como más".split(),
}

# Classes of characters; what is in none of them, and not blank, is the last class.
CLASSES = ["a-z", "A-Z", "0-9", ".,;:!?'\"()\\-", "#*$%&|<>", "\\u0080-\\x{10FFFF}"]

BLANK = "[\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Rules:
    least_words: int = 10
    repeat_percent: int = 20
    class_distance: float = 0.3  # of characters
    word_part: float = 0.8  # of common words, as a part of the distance of a text that has none
    class_words: int = 10  # documents with fewer words are not judged by characters
    common_words: int = 100  # nor, with fewer than these, by common words


def let(value: Column, body) -> Column:
    """body(value), where value is computed once for a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def repeated(words: Column, size: int = 5) -> Column:
    """How many words lie in windows of `size` words that occur twice or more."""

    def covered(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.struct(F.xxhash64(*[F.element_at(w, i + k) for k in range(size)]).alias("h"), i.alias("i")))

        def starts(s: Column) -> Column:
            n = F.size(s)
            own = F.transform(
                F.sequence(F.lit(1), n),
                lambda j: F.when(
                    ((j > 1) & (F.get(s, j - 2)["h"] == F.get(s, j - 1)["h"])) | ((j < n) & (F.get(s, j)["h"] == F.get(s, j - 1)["h"])),
                    F.get(s, j - 1)["i"],
                ),
            )
            return F.array_sort(F.filter(own, lambda x: x.isNotNull()))

        def total(p: Column) -> Column:
            gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size)).cast("long"))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda t, x: t + x)

        def repeats(s: Column) -> Column:
            alone = F.size(F.array_distinct(F.transform(s, lambda x: x["h"]))) == F.size(s)
            return F.when(alone, F.lit(0).cast("long")).otherwise(let(F.array_sort(s), lambda z: let(starts(z), total)))

        return let(hashes, repeats)

    return F.when(F.size(words) > size, let(words, covered)).otherwise(F.lit(0).cast("long"))


def _removed(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    chars = _removed(t, BLANK + "+").cast("long")
    counts = [_removed(t, f"[^{c}]+").cast("long") for c in CLASSES]
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    every = sorted({w for own in COMMON.values() for w in own})

    def own(w: Column) -> Column:
        known = F.array(*[F.lit(x) for x in every])
        low = F.filter(F.transform(w, lambda x: F.lower(x)), lambda x: x.isin(every))
        return let(low, lambda m: F.transform(known, lambda k: (F.size(m) - F.size(F.array_remove(m, k))).cast("long")))

    made = rows.select(
        "doc_id",
        "lang",
        chars.alias("word_chars"),
        counts[4].alias("n_symbols"),
        dup.alias("n_dup_lines"),
        F.array(*counts).alias("found"),
        let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated(w).alias("r"), own(w).alias("c"))).alias("w"),
    )
    rest = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x)
    seen = F.aggregate("w.c", F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select(
        "doc_id",
        "lang",
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("w.r").alias("n_repeat_words"),
        F.array_append("found", F.col("word_chars") - rest).alias("classes"),
        F.array_append("w.c", F.col("w.n") - seen).alias("common"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(F.greatest(total, F.lit(1).cast("long")), lambda n: F.transform(counts, lambda x: x / n))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def references(found: DataFrame) -> DataFrame:
    """One row of array columns: the references of the languages in COMMON that occur."""
    width = {"classes": len(CLASSES) + 1, "common": len({w for own in COMMON.values() for w in own}) + 1}
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, n in width.items() for i in range(n)]
    one = found.filter(F.col("lang").isin(list(COMMON))).groupBy("lang").agg(*sums)
    return one.agg(F.array_sort(F.collect_list(F.struct("lang", *[_shares(F.array(*[F.col(f"{c}{i}") for i in range(n)])).alias(c) for c, n in width.items()]))).alias("refs"))  # at most one for each language of COMMON


def bare_distance(reference: Column) -> Column:
    """The distance from a reference of a text without common words; null for a reference that has none either."""
    found = distance(F.transform(reference, lambda x, i: F.when(i == F.size(reference) - 1, 1.0).otherwise(0.0)), reference)
    return F.when(found > 0, found)


def assess(docs: DataFrame, rules: Rules = Rules(), id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:  # noqa: B008
    """measures() without histograms, and class_distance, word_distance, base_failed and kept."""
    scratch = store.Scratch(docs.sparkSession, "quality")
    found = scratch.table(measures(docs, id, text, lang), "measures")
    refs = scratch.table(references(found), "references")  # one row

    refs = refs.select(F.transform("refs", lambda r: r.withField("bare", bare_distance(r["common"]))).alias("refs"))

    def nearest(column: str) -> Column:
        """The least distance, and the bare distance of its reference."""
        own = F.filter("refs", lambda r: r["lang"] == F.col("lang"))
        chosen = F.when(F.size(own) > 0, own).otherwise(F.col("refs"))
        return let(_shares(F.col(column)), lambda p: F.array_min(F.transform(chosen, lambda r: F.struct(distance(p, r[column]).alias("d"), r["bare"].alias("bare")))))

    judged = found.crossJoin(F.broadcast(refs)).withColumns({"by_class": nearest("classes"), "by_word": nearest("common")})  # with one row
    judged = judged.withColumns({"class_distance": F.col("by_class.d"), "word_distance": F.col("by_word.d")})
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    far = F.coalesce((F.col("n_words") >= rules.class_words) & (F.col("class_distance") > rules.class_distance), F.lit(False)) | F.coalesce(
        (F.col("n_words") >= rules.common_words) & (F.col("word_distance") > rules.word_part * F.col("by_word.bare")), F.lit(False)
    )
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "word_distance")
