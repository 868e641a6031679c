"""Exact Jaccard join of n-gram sets by vertical partitioning.

All n-grams have one global order: rare ones first (by a counting sketch of all data, then by hash).
The order is cut into fragments, so each set falls into segments, one per fragment. Two sets with
the needed overlap share an n-gram within their prefixes, the first len - ceil(t * len) + 1 n-grams
in the order, so candidates come from the prefixes, without the n-grams that the sketch shows to be in one text only;
then partial overlaps are counted fragment by fragment and summed per pair, and the sums decide.

The sketch has a counter for about each n-gram, up to 2**34 in all; beyond that it tells rare n-grams apart less
well, so that more prefix n-grams are shuffled, and results stay the same.

Equal sets are one node. As only components are asked for, a bucket of a prefix n-gram offers its
nodes one of them, that with the most frequent n-grams (of copies, the least edited), and in a second round
perhaps another; each node is compared with the nearest of what it is offered; buckets within one
component are closed. Pairs of a node outside the component of the
node its bucket offers last and a node of another component are compared too, unless parities of
hashed members (512 bits a set) already differ in more places than the threshold allows, so no link
that joins two components is lost and groups of copies cost a linear number of comparisons.

Defined results: a null or blank text has an empty set, links with nothing and is its own
component; with fewer words than a shingle the whole sequence is the one member; null row ids stay,
without a component of others; rows that repeat an id are each treated by their own text;
texts are read whole; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm import store
from millrace.llm.components import components

BLOCK_BITS = 20
FLUSH = 1 << 21  # n-grams that a task counts at once
ONE = 8  # the sketch's code of a count of 1


def sets(column: pa.Array, size: int):
    """For slices of rows: first row, end row, distinct shingle hashes of each row (sorted), offsets by row, and set hashes."""
    for a, b, words, row in K.hashed_words(column):
        h, at = K.shingles(words, row, size, b - a)
        single = np.bincount(row, minlength=b - a) == 1 if len(row) else np.zeros(b - a, bool)
        if size > 1 and single.any() and not np.isin(np.flatnonzero(single), at).all():
            first = np.flatnonzero(single)
            own = words[np.searchsorted(row, first)]
            h, at = np.concatenate([h, K.chain([own], 1)]), np.concatenate([at, first])
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
        h, cut = K.distinct_in_rows(h, at, b - a)
        n = np.diff(cut)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(K.mix64(h), dtype=np.uint64)])
        yield a, b, h, cut, K.mix64(sums[cut[1:]] - sums[cut[:-1]] + n.astype(np.uint64))


def _coded(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(8 * np.log2(1 + counts)), 255).astype(np.uint8)


class Sketch:
    """Codes (an eighth of a binary logarithm) of how many sets hold an n-gram of each hash range, at most 255; files by block of ranges."""

    def __init__(self, bits: int, files: dict[int, str]):
        self.bits, self.files = bits, files

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        block = (at >> BLOCK_BITS).astype(np.uint16)
        order = np.argsort(block, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(block[order]) != 0)) if len(h) else np.zeros(0, np.int64)
        out = np.zeros(len(h), np.uint8)
        for i, j in zip(first.tolist(), np.append(first, len(h))[1:].tolist(), strict=True):
            own = order[i:j]
            out[own] = store.mapped(self.files[int(block[own[0]])])[at[own] & ((1 << BLOCK_BITS) - 1)]
        return out


def sketch(docs: DataFrame, text: str, size: int, scratch: store.Scratch) -> Sketch:
    bits = min(34, max(BLOCK_BITS, math.ceil(math.log2(1 + store.size_in_bytes(docs, text) // 3))))
    folder, low = scratch.folder("sketch"), 8

    def count(batches):
        held, n = [], 0

        def flush():
            at = np.sort(np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64)
            block = at >> BLOCK_BITS
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            at &= (1 << BLOCK_BITS) - 1
            tops, rests = [], []
            for i, j in zip(first.tolist(), np.append(first, len(at))[1:].tolist(), strict=True):
                if j - i > 1 << BLOCK_BITS - low:  # low bytes in the order of the counts of high parts
                    tops.append(np.bincount(at[i:j] >> low, minlength=1 << BLOCK_BITS - low).astype(np.uint32).tobytes())
                    rests.append(at[i:j].astype(np.uint8).tobytes())
                else:
                    tops.append(None)
                    rests.append(at[i:j].astype(np.uint32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(block[first].astype(np.int32)), pa.array(tops, pa.binary()), pa.array(rests, pa.binary())], names=["block", "top", "rest"])

        for batch in batches:
            for _, _, h, _, _ in sets(batch.column(0), size):
                if len(h):
                    held.append(h)
                    n += len(h)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def add(batches):
        """Rows come by block."""
        now, total = None, np.zeros(0, np.int64)
        for batch in batches:
            for block, top, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if now is not None:
                        yield done(now, total)
                    now, total = block, np.zeros(1 << BLOCK_BITS, np.int64)
                at = np.frombuffer(rest, np.uint32 if top is None else np.uint8).astype(np.int64)
                if top is not None:
                    at += np.repeat(np.arange(1 << BLOCK_BITS - low) << low, np.frombuffer(top, np.uint32))
                total += np.bincount(at, minlength=1 << BLOCK_BITS)
        if now is not None:
            yield done(now, total)

    def done(block, total):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([store.save(folder, f"block-{block}", _coded(total))])], names=["block", "file"])

    parts = docs.select(F.col(text).alias("t")).mapInArrow(count, "block int, top binary, rest binary")
    made = scratch.table(parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, file string"), "sketch-files")
    return Sketch(bits, {r.block: r.file for r in made.collect()})  # one row for a block of 2**20 counters


def parities(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """512 bits a row, as 8 words: of how many of its hashes, odd or even, fall on each bit. Two rows' words differ in no more bits than their sets in members."""
    row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    bits = np.bincount(row * 512 + (K.mix64(h) & np.uint64(511)).astype(np.int64), minlength=512 * (len(cut) - 1)) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def join(docs: DataFrame, size: int = 4, percent: int = 85, fragments: int = 8, rounds: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    scratch = store.Scratch(spark, "jaccard")
    code = sketch(docs, text, size, scratch)

    def ordered(h: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's hashes in the global order, and their codes. h ascends within a row."""
        rank = code(h)
        order = np.argsort(np.repeat(np.arange(len(cut) - 1) << 8, np.diff(cut)) + rank, kind="stable")
        return h[order], rank[order]

    def nodes(batches):
        for batch in batches:
            for a, b, h, cut, own in sets(batch.column(1), size):
                n = np.diff(cut)
                signs = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * (b - a) + 1, 8), pa.int32()), _signed(parities(h, cut)))
                h, rank = ordered(h, cut)
                take = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                at = K.ranges(cut[:-1], take)
                shared = rank[at] > ONE
                left = np.add.reduceat(np.append(shared, False), np.cumsum(take) - take, dtype=np.int64) * (take > 0)
                prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left)), pa.int32()), _signed(h[at[shared]]))
                middle = np.bincount(np.repeat(np.arange(b - a), n), rank, b - a) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), _signed(own), pa.array(middle), signs, prefix], names=["doc_id", "n", "s", "m", "x", "prefix"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t"))
    whole = scratch.table(rows.mapInArrow(nodes, f"doc_id {rows.schema[0].dataType.simpleString()}, n long, s long, m double, x array<long>, prefix array<long>"), "nodes")
    table = scratch.table(whole.select("doc_id", "n", "s"), "sizes")
    # equal sets collapse first; n-grams of one set only are dropped
    alike = scratch.table(whole.filter("n > 0").groupBy("s").agg(F.min("n").alias("n"), F.min("doc_id").alias("d"), F.min("m").alias("m"), F.first("x").alias("x"), F.first("prefix").alias("prefix")), "alike")
    scratch.remove("nodes")
    every = alike.select(F.explode("prefix").alias("g"), "s", "n", "m")
    posting = scratch.table(every.join(every.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g"), "g"), "postings")
    signs = alike.select("s", "x")

    def fits(a: str, b: str):
        """The smaller size is at least the threshold's part of the larger."""
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def differ():
        return sum((F.bit_count(F.col("xa")[i].bitwiseXOR(F.col("xb")[i])) for i in range(8)), F.lit(0))

    def near():
        """The parities xa and xb differ in no more places than linked sets can."""
        return (100 + percent) * differ() <= (100 - percent) * (F.col("na") + F.col("nb"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b, na, nb) that have the needed overlap, from partial overlaps summed over fragments."""
        pairs = scratch.table(pairs.select("a", "b", "na", "nb"), f"{name}-pairs")
        if pairs.isEmpty():
            return pairs.select("a", "b")
        needed = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
        chosen = alike.join(needed, "s", "left_semi").select(F.col("d").alias("doc_id"))

        def segments(batches):
            for batch in batches:
                for _, _, h, cut, own in sets(batch.column(1), size):
                    h, rank = ordered(h, cut)
                    # fragments of the order: a range of codes, cut on by the hash
                    key = np.repeat(np.arange(len(cut) - 1) * fragments, np.diff(cut)) + ((rank >> 3) + (h >> np.uint64(61))).astype(np.int64) % fragments
                    order = K.by_row(h, key, fragments * (len(cut) - 1))
                    k = key[order]
                    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
                    if not len(start):
                        continue
                    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(k)), pa.int32()), _signed(h[order]))
                    yield pa.RecordBatch.from_arrays([_signed(own[k[start] // fragments]), pa.array((k[start] % fragments).astype(np.int32)), lists], names=["s", "f", "x"])

        seg = scratch.table(rows.join(chosen, "doc_id", "left_semi").mapInArrow(segments, "s long, f int, x array<long>"), f"{name}-segments")
        left = pairs.join(seg.select(F.col("s").alias("a"), "f", F.col("x").alias("xa")), "a")
        both = left.join(seg.select(F.col("s").alias("b"), "f", F.col("x").alias("xb")), ["b", "f"])

        def overlap(batches):
            for batch in batches:
                xa, xb = batch.column(4), batch.column(5)
                (oa, va), (ob, vb) = ((x.offsets.to_numpy(), x.values.to_numpy()) for x in (xa, xb))
                na, nb = np.diff(oa), np.diff(ob)
                row = np.repeat(np.arange(batch.num_rows), na), np.repeat(np.arange(batch.num_rows), nb)
                v, r = np.concatenate([va[oa[0] : oa[-1]], vb[ob[0] : ob[-1]]]), np.concatenate(row)
                order = np.lexsort((v, r))
                v, r = v[order], r[order]
                same = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.bincount(r[1:][same], minlength=batch.num_rows).astype(np.int64))], names=["a", "b", "f", "n", "o"])

        partial = both.select("a", "b", "f", (F.col("na") + F.col("nb")).alias("n"), "xa", "xb").mapInArrow(overlap, "a long, b long, f int, n long, o long")
        once = partial.groupBy("a", "b", "f").agg(F.min("n").alias("n"), F.max("o").alias("o"))  # a set may come from several rows of one id
        summed = once.groupBy("a", "b").agg(F.min("n").alias("n"), F.sum("o").alias("o"))
        found = scratch.table(summed.filter(100 * F.col("o") >= percent * (F.col("n") - F.col("o"))).select("a", "b"), f"{name}-links")
        scratch.remove(f"{name}-segments")
        return found

    roots = None  # node, root of the nodes that are linked so far

    def labelled(part: DataFrame) -> DataFrame:
        return part.withColumn("c", F.col("s")) if roots is None else part.join(roots.select(F.col("node").alias("s"), F.col("root").alias("c")), "s", "left").withColumn("c", F.coalesce("c", "s"))

    def grown(links: DataFrame, name: str) -> DataFrame:
        """roots with the links, by the components of what they join."""
        if roots is None:
            return scratch.table(components(links, scratch, f"cc-{name}"), f"roots-{name}")
        own = roots.select(F.col("node").alias("s"), F.col("root").alias("c"))
        for k in "ab":
            links = links.join(own.select(F.col("s").alias(k), F.col("c").alias(f"c{k}")), k, "left").withColumn(f"c{k}", F.coalesce(f"c{k}", k))
        new = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch, f"cc-{name}").select("node", F.col("root").alias("to"))
        old = roots.join(new.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        return scratch.table(old.unionByName(new.join(roots, "node", "left_anti").select("node", F.col("to").alias("root"))), f"roots-{name}")

    open_ = posting
    for k in range(rounds + 1):
        # what lies in buckets of several components, with the component c and the bucket's node of this round
        member = labelled(open_.select("g", "s", "n", "m"))
        first = (F.col("m") if k == 0 else F.col("m") + F.pmod(F.xxhash64("s", F.lit(k)), F.lit(1000)) / 250).alias("h")
        hub = member.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.struct(first, "s", "n", "c")).alias("hub")).filter("lo < hi")
        open_ = scratch.table(member.join(hub.select("g", F.col("hub.s").alias("hs"), F.col("hub.n").alias("hn"), F.col("hub.c").alias("hc")), "g"), f"open{k}")
        scratch.remove(f"open{k - 1}" if k else "postings")
        if open_.isEmpty():
            break
        if k < rounds:
            spoke = open_.filter((F.col("c") != F.col("hc")) & fits("n", "hn")).select(F.col("hs").alias("a"), F.col("s").alias("b"), F.col("hn").alias("na"), F.col("n").alias("nb")).distinct()
            spoke = spoke.join(signs.toDF("a", "xa"), "a").join(signs.toDF("b", "xb"), "b").filter(near())
            nearest = spoke.groupBy("b").agg(F.min(F.struct(differ().alias("d"), "a", "na", "nb")).alias("p")).select("p.a", "b", "p.na", "p.nb")
            links = verified(nearest, f"spoke{k}")
        else:  # what is left: nodes outside the hub's component against the bucket's other components
            signed = open_.join(signs, "s")
            a = signed.filter("c != hc").select("g", F.col("s").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("x").alias("xa"))
            b = signed.select("g", F.col("s").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), "hc", F.col("x").alias("xb"))
            once = (F.col("cb") == F.col("hc")) | (F.col("a") < F.col("b"))
            rest = a.join(b, (a["g"] == b["g"]) & (F.col("ca") != F.col("cb")) & once & fits("na", "nb") & near())
            links = verified(rest.select("a", "b", "na", "nb").distinct(), "rest")
        if not links.isEmpty():
            roots = grown(links, str(k))
    own = table.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s").agg(F.min("doc_id").alias("d"))
    joined = labelled(own)
    named = scratch.table(joined.join(joined.groupBy("c").agg(F.min("d").alias("component_id")), "c").select("s", "component_id"), "named")
    return table.join(named, "s", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are the first of their component: one with the least id, any row of it where it repeats, null ids last."""
    rows, key = store.keyed(docs, store.Scratch(docs.sparkSession, "keep_one"))
    found = join(rows, size, percent, id=key, text=text).select(F.col("doc_id").alias(key), "component_id")
    first = F.min(F.struct(F.col(id).isNull().alias("last"), F.col(id).alias("own"), F.col(key).alias("key")))
    kept = found.join(rows.select(key, id), key).groupBy("component_id").agg(first.alias("f")).select(F.col("f.key").alias(key))
    return rows.join(kept, key, "left_semi").drop(key)
