"""Words with a common polynomial hash, brute-force comparisons, and the pipeline on planted rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, jaccard, kernels, language, lm, packing, quality, queries, store, tokenfile, toxicity, urls, wordtable

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DIR = "/root/testdata/sf0.001"
WORDS = "river stone walked yellow garden quiet evening letter winter carried summer bridge window mountain thought paper".split()


def twins():
    """Two words that any polynomial hash modulo a power of two confuses."""
    bits = [0]
    for _ in range(10):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_hashes_are_of_the_span_alone():
    a, b = twins()
    data = np.frombuffer((a + b + "abcdefghi" + "x" * 30 + "abcdefghi" + "abcdefg" + "abcdefgh").encode(), np.uint8)
    starts = np.array([0, 1024, 2048, 2087, 2096, 2103, 2048])
    ends = np.array([1024, 2048, 2057, 2096, 2103, 2111, 2056])
    h = kernels.span_hashes(data, starts, ends)
    assert h[0] != h[1] and h[2] == h[3] and h[5] == h[6] and len(set(h.tolist())) == 5
    assert not (h == kernels.span_hashes(data, starts, ends, 1)).any()


def test_words_with_one_hash_are_encoded_by_workers():
    h, words, shared = wordtable.merge(np.array([5, 3, 5, 3, 9], np.uint64), np.array([1, 2, 7, 2, 1], np.uint64), pa.array(["x", "y", "z", "y", "w"]))
    assert h.tolist() == [3, 5, 9] and words[0].as_py() == "y" and words[2].as_py() == "w" and shared.tolist() == [False, True, False]
    table = wordtable.Lookup([])
    table._find = lambda u: (np.zeros(len(u), np.int64), np.zeros(len(u), np.int64))  # all are shared
    ids, n = table.ids(np.array([5, 5], np.uint64), np.array([-1, -1]), [], lambda k: np.array([k, 8], np.uint32))
    assert ids.tolist() == [0, 8, 1, 8] and n.tolist() == [2, 2]


def test_twins_everywhere(spark):
    a, b = twins()
    docs = spark.createDataFrame([(1, a, 1), (2, b, 2)], "doc_id long, text string, ids long")
    t = Tokenizer.from_file(VOCABULARY)
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in ((1, a), (2, b))}
    for r in bpe.digests(docs, VOCABULARY).collect():
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), hashlib.sha256(",".join(map(str, want[r.doc_id])).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((a, b)[r.doc_id - 1].encode()).hexdigest()
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {1: 1, 2: 2}
    got = {r.doc_id: r.n_known for r in lm.score(docs, lm.fit(docs, F.col("doc_id") == 1)).collect()}
    assert got == {1: 2, 2: 1}
    files = tokenfile.write(docs, store.Scratch(spark, "t").folder("x"), VOCABULARY, end_id=2)
    assert {r.doc_id: r.ids_crc32 for r in tokenfile.digests(spark, files).collect()} == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in want.items()}


def test_packing_digests(spark):
    rows = [(1, "a b c " * 1500), (2, None), (3, "x"), (3, "x")]
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    pieces = queries.packed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in pieces) and len({r.sequence_id for r in pieces}) == len(pieces)
    for i, text in ((1, rows[0][1]), (2, ""), (3, "x")):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces if r.doc_id == i})
        assert sum(x[1] for x in own) == len(ids) and all(c == zlib.crc32(ids[s : s + n].tobytes()) and d == len(ids) for s, n, c, d in own)


def test_language_model_is_the_plain_one(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(WORDS[:9], rng.integers(0, 12))) for _ in range(60)] + [None, "new words", "River STONE"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.fit(docs, F.col("doc_id") % 3 != 1)
    tokens = [[*words(t), "</s>"] for t in texts]
    pair, left, right = Counter(), Counter(), defaultdict(set)
    single = Counter()
    for i, d in enumerate(tokens):
        if i % 3 != 1:
            single.update(d)
            for v, w in zip(["<s>", *d], d):
                pair[v, w] += 1
                left[v] += 1
                right[w].add(v)
    follow = {w: len(v) for w, v in right.items()}
    counts = Counter(pair.values())
    kinds = Counter(follow.values())

    def discounts(n):
        if min(n[k] for k in (1, 2, 3, 4)) <= 0:
            return [0, 0.5, 0.5, 0.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *[min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k) for k in (1, 2, 3)]]

    d, e = discounts(counts), discounts(kinds)

    def lower(w):
        total = len(pair)
        mass = sum(e[min(c, 3)] for c in follow.values())
        return max(follow.get(w, 0) - e[min(follow.get(w, 0), 3)], 0) / total + mass / total / (len(single) + 1)

    def p(v, w):
        if not left[v]:
            return lower(w)
        mass = sum(d[min(c, 3)] for (x, _), c in pair.items() if x == v)
        c = pair[v, w]
        return max(c - d[min(c, 3)], 0) / left[v] + mass / left[v] * lower(w)

    for v in ("<s>", "river", "never"):
        assert abs(sum(p(v, w) for w in [*single, "unknown"]) - 1) < 1e-9
    for r in lm.score(docs, model).collect():
        own = tokens[r.doc_id]
        assert abs(r.score - sum(math.log10(p(v, w)) for v, w in zip(["<s>", *own], own))) < 1e-6
        assert r.n_known == sum(w in single for w in own)


def test_urls_are_told_apart_by_words_not_seen(spark):
    blocked, allowed = urls.labelled()
    model = urls.fit([x for x in blocked if "casino" not in x[0]], [x for x in allowed if "museum" not in x[0]])

    def blocks(rows):
        return (urls.probability(model, pa.array([h for h, _ in rows]), pa.array([p for _, p in rows])) >= 0.8).mean()

    assert blocks([("xcasinobets.net", "/bonus/slots"), ("cheap-meds.org", "/buy/pills"), ("free-keygens.info", "/download/crack.exe")]) == 1
    assert blocks([("countyarchive.example.org", "/visit"), ("oldtownhistory.net", "/articles/2019/mill.html"), ("straße.example", "/über/uns"), ("", "")]) == 0
    assert blocks([x for x in allowed if "museum" in x[0]]) <= 0.2


def test_four_languages_held_out(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(quality.COMMON[l], 30)), l) for i, l in enumerate(list("de en es fr".split()) * 40)] + [(900, "", "en"), (901, "123 456", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs, F.col("doc_id") % 3 != 1)).collect()}
    assert sum(got[i].lang_pred == l for i, _, l in rows[:-2] if i % 3 == 1) >= 50 and all(0 <= r.score <= 1 for r in got.values())
    assert got[900].lang_pred == got[901].lang_pred == "und"


def test_quality_distances_are_the_plain_ones(spark):
    rows = [(i, " ".join(w for k in range(30) for w in (quality.COMMON[l][(i + k) % 9], WORDS[(i * 7 + k) % 16])) + "\nsame line\nsame line", l) for i, l in enumerate(["en", "de"] * 5)] + [(50, "$$$ ### %%% " * 30, "en"), (51, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality.measures(docs).collect()}
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    assert got[0].n_dup_lines == 1 and got[51].n_words == 0 and not got[51].kept and not got[50].kept and got[0].kept

    def js(p, q):
        p, q = np.array(p) / max(sum(p), 1), np.array(q) / max(sum(q), 1)
        m = (p + q) / 2
        return math.sqrt(max(0, sum(0.5 * x * math.log2(x / y) for a in (p, q) for x, y in zip(a, m) if x > 0)))

    for column, out in (("classes", "class_distance"), ("common", "word_distance")):
        refs = {l: np.sum([found[i][column] for i, _, x in rows if x == l], axis=0) for l in ("en", "de")}
        for i, _, l in rows:
            want = min(js(found[i][column], refs[x]) for x in ([l] if l else refs))
            assert abs(got[i][out] - want) < 1e-9


def test_join_agrees_with_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = {tuple(r) for r in con.sql("SELECT doc_id, n_shingles, component_id FROM (" + queries.ORACLE["op10_jaccard_join"] + ")").fetchall()}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in queries.op10_jaccard_join(spark, DIR).collect()} == want


def test_threshold():
    y = np.array([1, 1, 0, 1, 0, 0, 0, 0], bool)
    assert toxicity._threshold(np.array([0.9, 0.8, 0.7, 0.6, 0.2, 0.2, 0.1, 0.0]), y) == 0.75
    assert toxicity._threshold(np.array([0.5] * 8), y) < 0.5 and toxicity._threshold(np.zeros(3), np.zeros(3, bool)) == 1.0


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    common = quality.COMMON["en"]

    def text(n=60):
        return " ".join(w for _ in range(n) for w in (rng.choice(common), rng.choice(WORDS) + str(rng.integers(0, 50))))

    rows = [(i, text() + (" awful nastyword slur" if i % 5 == 0 else ""), "en", "s", 0) for i in range(60)]
    copy = rows[1][1].split()
    copy[40] = "changed"
    rows += [(60, " ".join(copy), "en", "s", 0), (61, rows[2][1], "en", "s", 0), (62, "short", "en", "s", 0), (63, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {i for i in range(60) if i % 5}
    t = Tokenizer.from_file(VOCABULARY)
    for i in (1, 33):
        assert sum(r.length for r in got if r.doc_id == i) == len(t.encode(rows[i][1], add_special_tokens=False).ids) + 1


def test_rows_that_span_batches_are_decoded_whole(spark):
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    long = " ".join(f"{w}{i} \U0001f9eeกé" for i, w in enumerate(WORDS * 400))
    texts = ["", long, None, "x", "x", long + "é", ""]
    docs = spark.createDataFrame([(i if i != 3 else None, x, 0) for i, x in enumerate(texts)], "doc_id long, text string, token int").coalesce(1)
    got = sorted(map(tuple, bpe.digests(docs, VOCABULARY).collect()), key=str)
    want = []
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.append((i if i != 3 else None, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str) and max(x[1] for x in got) > 30000
    back = sorted((str(r.doc_id), r.text) for r in bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect())
    assert back == sorted((str(i if i != 3 else None), x or "") for i, x in enumerate(texts))
    odd = spark.createDataFrame([("a", [None, 10**6, 300]), ("b", None), ("c", []), ("d", [-1])], "doc_id string, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, VOCABULARY).collect()} == {"a": t.decode([300], skip_special_tokens=False), "b": "", "c": "", "d": ""}


def test_pieces_are_joined_without_an_exchange(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = bpe.joined(bpe.encode(docs, VOCABULARY), VOCABULARY)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
