"""Near-duplicate vectors by NN-descent.

Vectors are normalised in double precision and stored as arrays in the shared folder, which workers
map. Equal vectors are one node. The neighbour graph starts from windows over sorted sign hashes of
random projections and is refined by joins with neighbours of neighbours. Lists are cut, but only to
guide the search: of every pair compared that is at the threshold, the nodes are joined, by edges that
span what a batch joins. Further passes, with other projections, compare a node only with others than
its component: a run of one component counts by its borders, so it fills no window and no list. The
projections of a pass grow with the vectors, so that a pair at the threshold meets in a window about as
often in any table. After each pass some nodes are compared with all vectors, in blocks: the part of
their links that lies within components is the recall, and what is missed is joined. Passes go on, each
with twice the projections, until one joins few components and the recall is reached; each pass is logged.
Links are then counted exactly within components, in blocks of members, without a row per pair.
audit() does that comparison for a result, by the ids of its rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or whose
length is not the most frequent among valid ones (of equally frequent ones the least), link with nothing; they have 0 links and are their own
component; rows with a repeated id are vectors of their own that share it; null ids stay null; an
empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import logging
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import store
from millrace.llm.components import components

log = logging.getLogger(__name__)

ROW_BITS = 32
TABLES, BITS, WINDOW, EACH = 24, 24, 12, 3  # of tables and bits the least
MISS = 0.02  # of pairs at the threshold, about the part that no window of a pass shows
RECALL, QUERIES = 0.98, 2000  # to be reached, for about so many nodes
BORDER = 2  # rows at either end of a run of one component that stand for it
FEW = 1000  # a pass that joins fewer than one in so many of the nodes with links is the last
BLOCK = 256


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(column), width))
    for k, x in enumerate(column):
        v = x.as_py()
        if v is not None and len(v) == width and all(e is not None for e in v):
            out[k] = v
    out[~np.isfinite(out).all(1)] = 0
    top = np.abs(out).max(1, initial=0)
    out /= np.where(top > 0, top, 1)[:, None]
    norm = np.sqrt((out * out).sum(1))
    return out / np.where(norm > 0, norm, 1)[:, None], norm > 0


def _take(files: dict[int, str], index: np.ndarray) -> np.ndarray:
    parts = index >> ROW_BITS
    out = None
    for p in np.unique(parts).tolist():
        at = np.flatnonzero(parts == p)
        found = store.mapped(files[p])[index[at] & ((1 << ROW_BITS) - 1)]
        if out is None:
            out = np.empty((len(index), *found.shape[1:]), found.dtype)
        out[at] = found
    return out


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the least row that the pairs a, b join it with."""
    root = np.arange(n)
    while True:
        u, v = root[a], root[b]
        new = root.copy()
        np.minimum.at(new, np.maximum(u, v), np.minimum(u, v))
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _joined(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges (link) that span what the pairs of labels a, b join: one for each label but the first of a group."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _roots(at[: len(a)], at[len(a) :], len(names))
    own = np.flatnonzero(root != np.arange(len(names)))
    return _edges(names[own], names[root[own]], np.ones(len(own)), True)


def effort(n: int, threshold: float) -> tuple[int, int]:
    """Tables and bits for n vectors. A window spans as many rows as agree in log2(n / WINDOW) signs; each sign of a pair at the threshold agrees with probability 1 - angle / pi."""
    depth = math.log2(max(2.0, n / WINDOW))
    meet = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** depth
    return max(TABLES, math.ceil(math.log(MISS) / math.log1p(-meet)) if meet < 1 else 1), min(62, max(BITS, math.ceil(depth) + 8))


def _edges(i: np.ndarray, j: np.ndarray, s: np.ndarray, link: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(s, pa.float64()), pa.array(np.full(len(i), link))], names=["i", "j", "s", "link"])


def near(vectors: DataFrame, threshold: float = 0.9, id: str = "vec_id", vector: str = "embedding", neighbours: int = 8, rounds: int = 2, recall: float = RECALL, passes: list[dict] | None = None) -> tuple[DataFrame, DataFrame, dict[int, str]]:
    """Returns vec_id, index, n_links, component_id, kept per row; index pairs a, b that span the components; and the files. passes: gets what each pass did, with its recall."""
    spark = vectors.sparkSession
    scratch = store.Scratch(spark, "neighbours")
    folder = scratch.folder("vectors")
    rows = vectors.select(F.col(id).alias("vec_id"), F.col(vector).alias("v"))
    usable = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    head = rows.filter(usable).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = head.n if head else 1

    def put(batches):
        part = TaskContext.get().partitionId()
        ids, data, good = [], [], []
        for batch in batches:
            x, ok = _matrix(batch.column(1), width)
            ids.append(batch.column(0))
            data.append(x)
            good.append(ok)
        if sum(len(x) for x in data):
            file = store.save(folder, f"part-{part}", np.concatenate(data))
            row = 0
            for i, ok, x in zip(ids, good, data, strict=True):
                index = (part << ROW_BITS) + row + np.arange(len(ok))
                row += len(ok)
                same = pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() if k else None for v, k in zip(x + 0.0, ok, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([i, pa.array(index), same, pa.array([file] * len(ok))], names=["vec_id", "i", "h", "file"])

    read = scratch.table(rows.mapInArrow(put, f"vec_id {rows.schema[0].dataType.simpleString()}, i long, h binary, file string"), "read")
    parts = {r.p: r for r in read.groupBy(F.shiftright("i", ROW_BITS).alias("p"), "file").count().collect()}  # one for each input partition
    files = {p: r.file for p, r in parts.items()}
    copies = read.filter("h IS NOT NULL").groupBy("h").agg(F.min("i").alias("node"), F.count("*").alias("w"))
    known = scratch.table(read.join(copies, "h", "left").select("vec_id", "i", "node", "w"), "index")
    nodes = known.filter("i = node").select("i", "w")
    roots = scratch.table(nodes.select(F.col("i").alias("node"), F.col("i").alias("root")), "roots")

    def labels_of(roots: DataFrame, name: str) -> dict[int, str]:
        """Files with the root of each row that is a node, -1 for others; aligned with the vectors."""
        rows_of, to = {p: r["count"] for p, r in parts.items()}, scratch.folder(name)

        def put(batches):
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                i, root = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for p in np.unique(i >> ROW_BITS).tolist():
                    at = i >> ROW_BITS == p
                    found.setdefault(p, np.full(rows_of[p], -1, np.int64))[i[at] & ((1 << ROW_BITS) - 1)] = root[at]
            for p, x in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([store.save(to, f"part-{p}", x)])], names=["p", "file"])

        return {r.p: r.file for r in roots.select("node", "root").repartition(F.shiftright("node", ROW_BITS)).mapInArrow(put, "p long, file string").collect()}

    def signs(seed, tables):
        def hashed(batches):
            planes = np.random.default_rng(seed).standard_normal((width, tables * bits))
            weight = 1 << np.arange(bits, dtype=np.int64)[::-1]
            for batch in batches:
                i = batch.column(0).to_numpy()
                step = max(1, (1 << 21) // (tables * bits))
                for a in range(0, len(i), step):
                    own = i[a : a + step]
                    key = ((_take(files, own) @ planes > 0).reshape(len(own), tables, bits) * weight).sum(2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))), pa.array(key.ravel()), pa.array(np.repeat(own, tables))], names=["t", "k", "i"])

        return hashed

    def windows(labels):
        def compared(batches):
            i, t = np.zeros(0, np.int64), np.zeros(0, np.int32)
            for batch in batches:
                i, t = np.concatenate([i, batch.column(2).to_numpy()]), np.concatenate([t, batch.column(0).to_numpy()])
                n = len(i)
                if n < 2:
                    continue
                x, c, row = _take(files, i), _take(labels, i), np.arange(n)
                starts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])]))
                run = np.searchsorted(starts, row, "right") - 1
                first, end = starts[run], np.append(starts[1:], n)[run]
                border = np.flatnonzero((row - first < BORDER) | (end - row <= BORDER))
                after, before = np.searchsorted(border, end), np.searchsorted(border, first) - 1
                sim = np.full((n, 2 * WINDOW), -2.0)
                other = np.zeros((n, 2 * WINDOW), np.int64)
                for d in range(2 * WINDOW):
                    at = after + d if d < WINDOW else before - (d - WINDOW)
                    own = np.flatnonzero((at >= 0) & (at < len(border)))
                    j = border[at[own]]
                    fit = (t[own] == t[j]) & (c[own] != c[j])
                    own, j = own[fit], j[fit]
                    sim[own, d], other[own, d] = np.einsum("ij,ij->i", x[own], x[j]), j
                own, d = np.nonzero(sim >= threshold)
                if len(own):
                    yield _joined(c[own], c[other[own, d]])
                best = np.argsort(-sim, axis=1, kind="stable")[:, :EACH]
                s, j = np.take_along_axis(sim, best, 1).ravel(), i[np.take_along_axis(other, best, 1).ravel()]
                own, keep = np.repeat(i, EACH), s > 0.3
                yield _edges(own[keep], j[keep], s[keep], False)
                i, t = i[border[-WINDOW:]], t[border[-WINDOW:]]  # meet the next batch

        return compared

    def compare(labels):
        def compared(batches):
            for batch in batches:
                i, at, j = batch.column(0).to_numpy(), batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
                j = j[at[0] : at[-1]]
                for a in range(0, len(i), 1024):
                    b = min(len(i), a + 1024)
                    own = np.repeat(i[a:b], np.diff(at[a : b + 1]))
                    other = j[at[a] - at[0] : at[b] - at[0]]
                    if len(own):
                        c, d = _take(labels, own), _take(labels, other)
                        own, other, c, d = own[c != d], other[c != d], c[c != d], d[c != d]
                    if len(own):
                        s = np.einsum("ij,ij->i", _take(files, own), _take(files, other))
                        if (s >= threshold).any():
                            yield _joined(c[s >= threshold], d[s >= threshold])
                        yield _edges(own, other, s, False)

        return compared

    def best(edges: DataFrame, name: str) -> DataFrame:
        """The most similar neighbours of each vector, to search by: i, l (array of structs s, j)."""
        top = F.slice(F.sort_array(F.array_distinct(F.collect_list(F.struct("s", "j"))), False), 1, neighbours)  # lists bounded by tables or neighbours
        return scratch.table(edges.groupBy("i").agg(top.alias("l")), name)

    def missed(labels):
        """For each node its links and those of them within its component (s and j of a row that is no link), and links that join what is missed."""

        def compared(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    i = batch.column(0).to_numpy()[a : a + 256]
                    x, c = _take(files, i), _take(labels, i)
                    true, within = -np.ones(len(i), np.int64), -np.ones(len(i), np.int64)  # without itself
                    for p, file in files.items():
                        whole, roots_of = store.mapped(file), store.mapped(labels[p]) if p in labels else None
                        for b in range(0, len(whole) if p in labels else 0, 8192):
                            root = roots_of[b : b + 8192]
                            hit = (x @ whole[b : b + 8192].T >= threshold) & (root >= 0)
                            same = root == c[:, None]
                            true, within = true + hit.sum(1), within + (hit & same).sum(1)
                            own, other = np.nonzero(hit & ~same)
                            if len(own):
                                yield _joined(c[own], root[other])
                    yield _edges(i, np.maximum(true, 0), np.maximum(within, 0), False)

        return compared

    n_nodes = nodes.count()
    tables, bits = effort(n_nodes, threshold)
    edge, spans, k = "i long, j long, s double, link boolean", [], 0
    while True:
        labels = labels_of(roots, f"labels{k}")
        ordered = nodes.select("i").mapInArrow(signs(7 + k, tables), "t int, k long, i long")
        ordered = ordered.repartitionByRange("t", "k", "i").sortWithinPartitions("t", "k", "i")
        found = [scratch.table(ordered.mapInArrow(windows(labels), edge), f"windows{k}")]
        lists = best(found[0].filter("NOT link"), f"lists{k}")
        for r in range(rounds):
            edges = lists.select("i", F.explode("l").alias("e")).select("i", "e.j", "e.s")
            far = edges.select("i", "j").join(lists.select(F.col("i").alias("j"), F.col("l.j").alias("n")), "j").groupBy("i").agg(F.array_distinct(F.flatten(F.collect_list("n"))).alias("c"))
            new = far.select("i", F.array_remove("c", F.col("i")).alias("c")).mapInArrow(compare(labels), edge)
            found.append(scratch.table(new, f"compared{k}-{r}"))
            if r + 1 < rounds:
                lists = best(edges.unionByName(found[-1].filter("NOT link").drop("link")), f"lists{k}-{r}")
        links = reduce(DataFrame.unionByName, found).filter("link").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
        spans.append(scratch.table(links, f"links{k}"))
        new = components(spans[-1], scratch, f"cc{k}-").toDF("root", "to")
        roots = scratch.table(roots.join(new, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"roots{k}")
        for r in range(rounds):
            scratch.remove(f"compared{k}-{r}")
        scratch.remove(f"windows{k}")
        linked, joined = roots.filter("node <> root").count(), spans[-1].count()
        asked = nodes.select("i").filter(F.pmod(F.xxhash64("i", F.lit(k)), F.lit(max(1, n_nodes // QUERIES))) == 0)
        asked = scratch.table(asked.repartition(spark.sparkContext.defaultParallelism).mapInArrow(missed(labels_of(roots, f"audited{k}")), edge), f"audit{k}")
        share = asked.filter("NOT link AND j > 0").agg(F.avg(F.col("s") / F.col("j"))).first()[0]  # each node that has links counts the same
        share = 1.0 if share is None else share
        done = {"pass": k, "tables": tables, "bits": bits, "joined": joined, "recall": share}
        log.info("near-duplicate vectors: %s", done)
        if passes is not None:
            passes.append(done)
        lost = asked.filter("link").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
        if share < 1:
            spans.append(scratch.table(lost, f"lost{k}"))
            new = components(spans[-1], scratch, f"lostcc{k}-").toDF("root", "to")
            roots = scratch.table(roots.join(new, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"mended{k}")
        k, tables = k + 1, 2 * tables
        if FEW * joined <= linked and share >= recall:
            break
    links = reduce(DataFrame.unionByName, spans)
    blocks = roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"), F.count("*").alias("size")).filter("size > 1").drop("size")
    blocks = roots.join(blocks, "root").join(nodes.withColumnRenamed("i", "node"), "node").withColumn("k", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    blocks = blocks.groupBy("root", "k").agg(F.array_sort(F.collect_list(F.struct("node", "w"))).alias("m")).select("root", "k", F.col("m.node").alias("m"), F.col("m.w").alias("w"))
    blocks = scratch.table(blocks, "blocks")
    both = blocks.toDF("root", "ka", "ma", "wa").join(blocks.toDF("root", "kb", "mb", "wb"), "root").filter("ka <= kb").select("ka", "kb", "ma", "mb", "wa", "wb")

    def count(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b, wa, wb = (np.array(r[c]) for c in ("ma", "mb", "wa", "wb"))
                hit = _take(files, a) @ _take(files, b).T >= threshold
                if r["ka"] == r["kb"]:
                    np.fill_diagonal(hit, False)
                    out, n = a, hit @ wa
                else:
                    out, n = np.concatenate([a, b]), np.concatenate([hit @ wb, wa @ hit])
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(n.astype(np.int64))], names=["node", "n"])

    counted = both.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    named = known.filter("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least")).join(roots, "node")
    named = scratch.table(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").join(counted, "node", "left").select("node", "component_id", "n")
    n_links = F.coalesce("n", F.lit(0).cast("long")) + F.coalesce(F.col("w") - 1, F.lit(0).cast("long"))  # copies are links
    out = known.join(named, "node", "left").select("vec_id", F.col("i").alias("index"), n_links.alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return scratch.table(out.withColumn("kept", F.col("vec_id") == F.col("component_id")), "result"), links, files


def audit(result: DataFrame, files: dict[int, str], threshold: float = 0.9, every: int = 100) -> float:
    """Recall: of the links of vectors whose id is divisible by `every`, found by comparison with all, the part that n_links counts."""
    queries = result.filter(F.col("vec_id") % every == 0).select("index", "n_links")

    def count(batches):
        for batch in batches:
            i = batch.column(0).to_numpy()
            if len(i):
                x = _take(files, i)
                n = -np.ones(len(i), np.int64)
                for file in files.values():
                    whole = store.mapped(file)
                    for a in range(0, len(whole), 8192):
                        n += (x @ whole[a : a + 8192].T >= threshold).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.maximum(n, 0))], names=["found", "true"])

    r = queries.mapInArrow(count, "found long, true long").agg(F.sum(F.least("found", "true")).alias("f"), F.sum("true").alias("t")).first()
    return r.f / r.t if r.t else 1.0
