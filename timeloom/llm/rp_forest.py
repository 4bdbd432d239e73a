"""Nearest neighbours by a forest of random-projection trees and one priority queue (operator 2).

A tree's node splits space by the median of a projection on the difference of two random sample vectors, pulled towards a
random direction. Largest inner products are nearest neighbours once each vector has a further component that brings it to the
greatest length of all, and a query has 0 there. Trees are fitted on a bounded sample; every vector is then dealt to its leaf
in each tree. A query walks all trees with one queue: of all open nodes, whichever tree they are in, the one that the query is
least on the wrong side of is opened next, until the leaves reached hold enough vectors: ``effort * n ** (1 - fall)``, a share
of all that falls as ``n`` grows, counted in each tree.

Vectors and queries travel in packs of bounded size, and the packs of neighbouring leaves are joined, so no task holds a leaf,
whatever its size. A tree has few such groups, so a query has as many partial results however large the table is; what grows
is the number of slices that the queries are dealt to, each of which gets the vectors. A pair of packs is multiplied leaf by leaf, for those queries alone that reached the leaf; a query's best
are kept while its pack lasts. Scores of what remains are summed again in one fixed order, from the original vectors.

Equal vectors are one entry of the index with their smallest ids, as many as can appear in a result; no leaf fills with copies.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import Scratch

#: Vectors or queries of a pack, groups of neighbouring leaves in a tree, vectors a task packs at once, queries of a slice.
PACK, GROUPS, HELD, SLICE = 512, 4, 65_536, 32_768
#: More than ``k`` of a query that are scored again, so that the order of summing can't decide what is among them.
SPARE = 8


class Tree:
    """Nodes in heap order: children of i are 2 i + 1 and 2 i + 2; leaves follow the inner nodes."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        inner = (1 << depth) - 1
        self.direction, self.cut = np.zeros((inner, sample.shape[1]), np.float32), np.zeros(inner, np.float32)
        rows = {0: np.arange(len(sample))}
        for node in range(inner):
            own = rows.pop(node)
            a, b = sample[rng.choice(own, 2)] if len(own) else np.zeros((2, sample.shape[1]))
            way = a - b
            length = np.linalg.norm(way)
            noise = rng.standard_normal(sample.shape[1])
            way = (way / length if length else 0) + 0.1 * noise / np.linalg.norm(noise)
            side = sample[own] @ way
            self.direction[node], self.cut[node] = way, np.median(side) if len(own) else 0.0
            right = sample[own] @ self.direction[node] > self.cut[node]
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
        self.share = np.array([len(rows[inner + i]) for i in range(1 << depth)]) / max(1, len(sample))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.direction[node]) > self.cut[node])
        return node - ((1 << self.depth) - 1)


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees = [Tree(sample, depth, rng) for _ in range(trees)]

    def search(self, query: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one shared queue until they hold ``share`` of the vectors, counted once a tree."""
        heap = [(0.0, t, 0) for t in range(len(self.trees))]
        margin = [tree.direction @ query - tree.cut for tree in self.trees]
        found, held = [], 0.0
        while heap and held < share:
            far, t, node = heapq.heappop(heap)
            tree = self.trees[t]
            inner = len(tree.cut)
            while node < inner:
                m = float(margin[t][node])
                near, other = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(heap, (far + m * m, t, other))
                node = near
            found.append((t, node - inner))
            held += float(tree.share[node - inner])
        return found


def valid_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): vectors as doubles, without null ids and without vectors that are null, zero, or not finite throughout."""
    v = vectors[embedding].cast("array<double>")
    rows = vectors.select(vectors[vec_id].cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def packs(cells, keys, entries, vectors, lists=None):
    """Record batches of packs: rows of one (tree, near), ``PACK`` at most, with their leaves or lists of leaves."""
    order = np.lexsort((keys[2], keys[1], keys[0])) if lists is None else np.lexsort((keys[1], keys[0]))
    group = np.column_stack((keys[0][order], keys[1][order]))
    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)]) if len(order) else []
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        for i in range(a, b, PACK):
            own = order[i : min(b, i + PACK)]
            if lists is None:
                leaves, of = keys[2][own], b""
            else:
                leaves = np.concatenate([lists[j] for j in own])
                of = np.repeat(np.arange(len(own), dtype=np.int32), [len(lists[j]) for j in own]).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in ((int(group[a][0]), pa.int32()), (int(group[a][1]), pa.int32()), (zlib.crc32(entries[own].tobytes()), pa.int64()), (leaves.astype(np.int32).tobytes(), pa.binary()), (of, pa.binary()), (entries[own].tobytes(), pa.binary()), (vectors[cells[own]].tobytes(), pa.binary()))],
                ["tree", "near", "name", "leaves", "of", "entries", "vs"],
            )


PACKED = "tree int, near int, name bigint, leaves binary, of binary, entries binary, vs binary"


def held(batches):
    """(vectors, entries) of up to ``HELD`` rows at a time."""
    xs, es, n = [], [], 0
    for b in batches:
        if b.num_rows:
            xs.append(np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1))
            es.append(np.asarray(b.column(1)))
            n += b.num_rows
        if n >= HELD:
            yield np.concatenate(xs), np.concatenate(es)
            xs, es, n = [], [], 0
    if n:
        yield np.concatenate(xs), np.concatenate(es)


class Best:
    """The ``k`` best entries of each query of one pack, as packs of vectors pass by."""

    def __init__(self, row: dict, kind: type, k: int):
        self.name, self.k = (row["q_entries"], row["q_leaves"]), k
        self.entries = np.frombuffer(row["q_entries"], np.int64)
        self.v = np.frombuffer(row["q_vs"], kind).reshape(len(self.entries), -1).astype(float)
        leaves, of = np.frombuffer(row["q_leaves"], np.int32), np.frombuffer(row["of"], np.int32)
        order = np.argsort(leaves, kind="stable")
        self.leaves, self.of = leaves[order], of[order]
        self.floor = np.full(len(self.entries), -np.inf)
        self.parts, self.pending = [], 0

    def see(self, leaves: np.ndarray, entries: np.ndarray, v: np.ndarray) -> None:
        for leaf in np.intersect1d(leaves, self.leaves):
            asking = self.of[np.searchsorted(self.leaves, leaf) : np.searchsorted(self.leaves, leaf, "right")]
            own = np.flatnonzero(leaves == leaf)
            score = self.v[asking] @ v[own].T
            at, col = np.nonzero(score >= self.floor[asking][:, None])
            self.parts.append((asking[at], entries[own[col]], score[at, col]))
            self.pending += len(at)
        if self.pending > 4 * self.k * len(self.entries):
            self.reduce()

    def reduce(self) -> None:
        if not self.parts:
            return
        of, entry, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((entry, -score, of))
        of, entry, score = of[order], entry[order], score[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        last = place == self.k - 1
        self.floor[of[last]] = score[last]
        stay = place < self.k
        self.parts, self.pending = [(of[stay], entry[stay], score[stay])], 0

    def batch(self) -> pa.RecordBatch:
        self.reduce()
        of, entry, score = self.parts[0] if self.parts else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(self.entries[of], pa.int64()), pa.array(entry, pa.int64()), pa.array(score, pa.float64())], ["query", "entry", "score"])


def nearest(vectors: DataFrame, queries, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, trees: int = 8, leaf: int = 128, max_depth: int = 13, sample: int = 40_000, effort: float = 5.5, fall: float = 0.2, least: int = 2000, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` where ``queries`` (a condition on vec_id) holds, its ``k`` nearest found.

    Nearness is the inner product, larger first, ties to the smaller id; all rows but those of the query's own id are
    candidates. Vectors null, zero, or holding null or not finite components take no part, nor do rows without an id or
    vectors of another length than most. Repeated rows count once. Fewer than ``k`` candidates are all returned; an empty
    table gives an empty result. ``effort``, ``fall``, ``least``: how many vectors the leaves that a query reaches hold,
    counted in each tree: ``effort * n ** (1 - fall)``, ``least`` at least.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "forest")
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    kind = np.float32 if vectors.schema[embedding].dataType == T.ArrayType(T.FloatType(), vectors.schema[embedding].dataType.containsNull) else np.float64
    rows = valid_vectors(vectors, vec_id, embedding).withColumn("size", F.size("v"))
    size = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.col("size") == size["size"])
    # Only the k + 1 smallest ids of equal vectors can be in a result; the limit applies before the shuffle already.
    rows = rows.withColumn("vh", F.xxhash64("v"))
    place = F.row_number().over(Window.partitionBy("vh", "v").orderBy("vec_id"))
    index = rows.dropDuplicates(["vec_id", "vh", "v"]).withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vh", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = scratch.save(index.withColumn("entry", F.element_at("ids", 1)), "index")
    stats = index.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).first()
    n, most = stats["n"], float(stats["most"])
    fit = index.orderBy(F.xxhash64("entry", F.lit(seed))).limit(sample).select("v").toPandas()["v"]

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))))

    depth = int(min(max_depth, max(0, np.ceil(np.log2(max(1, n / leaf))))))
    forest = spark.sparkContext.broadcast(Forest(lifted(np.stack(fit.to_list())), trees, depth, seed))
    together = max(0, depth - int(np.log2(GROUPS)))
    wanted = max(effort * n**-fall, least / n)

    def deal(batches):
        for x, entries in held(batches):
            up = lifted(x)
            for t, tree in enumerate(forest.value.trees):
                leaves = tree.leaves(up)
                yield from packs(np.arange(len(x)), (np.full(len(x), t), leaves >> together, leaves), entries, x.astype(kind))

    def walk(batches):
        for x, entries in held(batches):
            cells, tree, near, lists = [], [], [], []
            for i, row in enumerate(x):
                reached: dict[tuple[int, int], list[int]] = {}
                for t, at in forest.value.search(np.append(row, 0.0), wanted):
                    reached.setdefault((t, at >> together), []).append(at)
                for (t, group), leaves in reached.items():
                    cells.append(i)
                    tree.append(t)
                    near.append(group)
                    lists.append(np.array(leaves, np.int32))
            cells = np.array(cells, int)
            yield from packs(cells, (np.array(tree), np.array(near)), entries[cells], x.astype(kind), lists)

    # Queries are searched once for each vector, whatever number of rows have it.
    asked = rows.where(queries).select("vec_id", "vh", "v").distinct().join(index.select("vh", "v", "entry"), ["vh", "v"])
    asked = scratch.save(asked.select("vec_id", "entry", "v"), "queries")

    def meet(batches):
        best = None
        for b in batches:
            for row in b.to_pylist():
                if best is None or best.name != (row["q_entries"], row["q_leaves"]):
                    if best is not None:
                        yield best.batch()
                    best = Best(row, kind, k + 1 + SPARE)
                entries = np.frombuffer(row["entries"], np.int64)
                best.see(np.frombuffer(row["leaves"], np.int32), entries, np.frombuffer(row["vs"], kind).reshape(len(entries), -1).astype(float))
        if best is not None:
            yield best.batch()

    slices = max(1, -(-asked.count() // SLICE))
    tasks, key = min(10_000, slices * trees << (depth - together)), ["tree", "near", "slice"]
    dealt = index.select("v", "entry").mapInArrow(deal, PACKED).select("tree", "near", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "leaves", "entries", "vs").repartition(tasks, *key)
    walked = asked.select("v", "entry").dropDuplicates(["entry"]).mapInArrow(walk, PACKED)
    walked = walked.select("tree", "near", (F.col("name") % slices).cast("int").alias("slice"), F.col("leaves").alias("q_leaves"), "of", F.col("entries").alias("q_entries"), F.col("vs").alias("q_vs")).repartition(tasks, *key)
    met = walked.hint("merge").join(dealt, key).drop("slice").mapInArrow(meet, "query bigint, entry bigint, score double")
    best = met.groupBy("query", "entry").agg(F.max("score").alias("score"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))).where(F.col("place") <= k + 1 + SPARE)
    answers = best.select("query", "entry").join(index.select("entry", "ids", "v"), "entry").join(asked.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query"), F.col("v").alias("q")), "query")
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    answers = answers.select("query_id", score.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
