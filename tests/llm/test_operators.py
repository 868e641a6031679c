"""Small cases of the operators: nulls, empty and repeated rows, empty tables, and comparison with plain versions."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, jaccard, language, lm, neighbours, packing, quality, tokenfile, store, toxicity, urls

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BASE = "the quick brown fox jumps over the lazy dog and runs away from all of the big grey wolves in the old forest near town".split()
TEXTS = [" ".join(BASE), " ".join(BASE), " ".join(BASE[:-1]), None, "", " \n ", "One", "ONE", "a b", "don't stop  ", "é ü <|endoftext|> x\n\n y", "w " * 5000]
SCHEMA = "doc_id long, text string, lang string, source string, s long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, None, 1) for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_is_the_library(docs, none):
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    got = {r.doc_id: r.ids for r in bpe.encode(docs, VOCABULARY).collect()}
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert got == want
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()}
    assert back == {i: t.decode(x, skip_special_tokens=False) for i, x in want.items()}
    assert bpe.encode(none, VOCABULARY).count() == 0


def test_token_files_and_packing(spark, docs, none):
    t = Tokenizer.from_file(VOCABULARY)
    files = tokenfile.write(docs, store.Scratch(spark, "t").folder("x"), VOCABULARY, end_id=2)
    start = 0
    for r in tokenfile.digests(spark, files).orderBy("doc_id").collect():
        ids = np.array([*t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    pieces = packing.pack(docs, VOCABULARY).orderBy("doc_id", "start").collect()
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 for r in pieces)
    for i, x in enumerate(TEXTS):
        own = b"".join(bytes(r.ids) for r in pieces if r.doc_id == i)
        assert np.frombuffer(own, "<u4").tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 1]
    assert packing.pack(none, VOCABULARY).count() == 0


def plain_sets(size):
    out = []
    for t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        out.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    return out


def test_jaccard(docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    sets = plain_sets(4)
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[i] = min(root[i], root[j])
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert jaccard.join(none).count() == 0


def test_language_model(docs, none):
    model = lm.fit(docs, F.col("doc_id") != 0)
    r = {r.doc_id: r for r in lm.score(docs, model).collect()}
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for t in TEXTS]
    train = [x for d in tokens[1:] for x in d]
    for i, d in enumerate(tokens):
        want = sum(np.log10((train.count(x) + 0.5) / (len(train) + 0.5 * (len(set(train)) + 1))) for x in d) if i != 11 else r[i].base_score
        assert abs(r[i].base_score - want) < 1e-6
        assert r[i].n_tokens == len(d) and r[i].train_tokens == len(train) and np.isfinite(r[i].score) and r[i].score < 0
    empty = lm.fit(none, F.lit(True))
    assert all(np.isfinite(x.score) for x in lm.score(docs, empty).collect())


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = {g: grams.count(g) for g in set(grams)}
        covered = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), len(covered))
        assert got[i].word_chars == sum(map(len, w)) and got[i].n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert got[i].base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert quality.assess(none).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.example.COM/en/7x?q"), (2, None), (3, "no scheme"), (4, "x://casino-win.example.net/fr/1"), (5, "a://org/es/#"), (6, "a://xorg/es/"), (6, "")]
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/")]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, urls.fit()).collect()}
    assert got == {(1, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "casino-win.example.net", "/fr/1", None, "block"), (5, "org", "/es/", "org/es/", "block"), (6, "xorg", "/es/", None, "allow"), (6, "", "", None, "allow")}


def test_toxicity_and_language(spark, docs, none):
    rows = [(i, f"word{i} plain text here " + ("nasty" if i % 4 == 0 else "nice"), "en", None, 1) for i in range(80)]
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 == 0)) for i in range(80)] + [(3, None, 1)], "doc_id long, low int, toxic int")
    chain = toxicity.fit(d, labels, ("low", "toxic"))
    assert {r.doc_id for r in toxicity.score(d, chain).collect() if r.is_toxic} == set(range(0, 80, 4))
    assert toxicity.keep_clean(d, chain).columns == d.columns and toxicity.keep_clean(d, chain).count() == 60
    assert toxicity.score(docs, toxicity.fit(none, labels, ("low", "toxic"))).filter("is_toxic").count() == 0
    model = language.fit(docs, F.col("doc_id") != 0)
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[0] == "en"
    assert language.predict(docs, language.fit(none, F.lit(True))).filter("lang_pred <> 'und'").count() == 0


def test_neighbours(spark):
    x = np.random.default_rng(1).standard_normal((60, 8))
    x[30:40] = x[0] + 0.05 * x[30:40]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(60, None, 1), (61, [0.0] * 8, 1), (62, [float("nan")] * 8, 1), (63, [None] * 8, 1)]
    result, _, files = neighbours.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, i long"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in result.collect()}
    assert got == {**dict(enumerate(want.tolist())), 60: 0, 61: 0, 62: 0, 63: 0}
    assert neighbours.audit(result, files, every=1) >= 0.9
    assert neighbours.near(spark.createDataFrame([], "vec_id long, embedding array<double>"))[0].count() == 0


def test_groups_of_near_copies_are_linked_to_each_other(spark):
    rng = np.random.default_rng(3)

    def unit(v):
        return v / np.linalg.norm(v, axis=-1, keepdims=True)

    x = [unit(rng.standard_normal((600, 64)))]
    for size, spread in ((9, 0.02), (12, 0.02), (50, 0.02), (5, 0.0)):
        a, b = unit(rng.standard_normal((2, 64)))
        b = unit(b - (a @ b) * a)
        for centre in (a, 0.94 * a + np.sqrt(1 - 0.94**2) * b):
            x.append(unit(centre + spread * unit(rng.standard_normal((size, 64)))))
    u = np.concatenate(x)
    result = neighbours.near(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "vec_id long, embedding array<double>"))[0].collect()
    assert {r.vec_id: r.n_links for r in result} == dict(enumerate(((u @ u.T >= 0.9).sum(1) - 1).tolist()))
    assert len({r.component_id for r in result if r.vec_id >= 600}) == 4


def test_quality_rejects_prose_without_common_words(spark):
    other = "river stone walked yellow garden quiet evening letter winter carried summer bridge window mountain thought paper".split()
    good = [" ".join(w for k in range(40) for w in ("the" if k % 2 else "of", *np.random.default_rng(100 * n + k).choice(other, 3))) for n in range(30)]
    bare = " ".join(np.random.default_rng(7).choice(other, 160))
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame([(i, t, "en", None, 1) for i, t in enumerate([*good, bare])], SCHEMA)).collect()}
    assert all(got[i].kept for i in range(30))
    assert not got[30].kept and not got[30].base_failed and got[30].class_distance <= 0.3


def test_search_grows_with_the_table_until_the_recall_is_reached(spark, monkeypatch):
    # effort() promises that a pair at the threshold shares a window with probability 0.98 in one pass
    for n, least in ((10_000, 24), (600_000, 40), (3_000_000, 60)):
        tables, bits = neighbours.effort(n, 0.9)
        p = (1 - np.arccos(0.9) / np.pi) ** np.log2(n / neighbours.WINDOW)
        assert tables >= least and 1 - (1 - p) ** tables >= 0.98 and bits > np.log2(n / neighbours.WINDOW)
    # a pass of one table without rounds misses pairs; the audit sees it and goes on
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((1500, 64))
    y -= (y * x).sum(1)[:, None] * x
    u = np.concatenate([x, 0.905 * x + np.sqrt(1 - 0.905**2) * y / np.linalg.norm(y, axis=1)[:, None]])
    monkeypatch.setattr(neighbours, "effort", lambda n, threshold: (1, 24))
    monkeypatch.setattr(neighbours, "QUERIES", 300)
    passes = []
    result = neighbours.near(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "vec_id long, embedding array<double>"), rounds=0, passes=passes)[0]
    assert passes[0]["recall"] < 0.9 and passes[-1]["recall"] >= 0.98 and [p["tables"] for p in passes] == [2**k for k in range(len(passes))]
    assert result.agg(F.sum("n_links")).first()[0] >= 0.95 * 3000


def test_pipeline_judges_rows_whatever_their_ids(spark):
    import corpus_pipeline

    good, other = " ".join(BASE), " ".join(reversed(BASE))
    rows = [(None, "too short", "en", None, 0), (1, good, "en", None, 1), (1, "too short", "en", None, 2), (None, other, "en", None, 3), (7, None, "en", None, 4)]
    kept = corpus_pipeline.quality_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "s"] and {r.s for r in kept.collect()} == {1, 3}
    rows = [(5, good, "en", None, 0), (5, good, "en", None, 1), (None, good, "en", None, 2), (3, good, "en", None, 3), (3, other, "en", None, 4), (None, other, "en", None, 5), (9, None, "en", None, 6), (None, "", "en", None, 7)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "source", "s"] and {r.s for r in kept.collect()} == {3, 4, 6, 7}


def test_the_width_is_the_most_frequent_length(spark):
    rows = [(0, [None] * 3), (1, [1.0, 2.0]), (2, [float("nan")] * 3), (3, [0.0] * 3), (4, None), (5, [])] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(6, 9)]
    result = neighbours.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1))[0]
    assert {r.vec_id: r.n_links for r in result.collect()} == {i: 2 if i >= 6 else 0 for i in range(9)}
