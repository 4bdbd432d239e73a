"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, freed


def contracted(batches):
    """For mapInArrow over (u, v) of 16-byte ids: each node's link to the smallest node of its component among these links."""
    parts = [(b"".join(b.column(0).to_pylist()), b"".join(b.column(1).to_pylist())) for b in batches if b.num_rows]
    if not parts:
        return
    ends = [np.frombuffer(b"".join(p[i] for p in parts), ">u8").reshape(-1, 2).astype(np.uint64) for i in (0, 1)]
    both = np.concatenate(ends)
    order = np.lexsort((both[:, 1], both[:, 0]))
    sorted_ = both[order]
    fresh = np.concatenate(([True], (sorted_[1:] != sorted_[:-1]).any(axis=1)))
    number = np.empty(len(both), np.int64)
    number[order] = np.cumsum(fresh) - 1
    nodes = sorted_[fresh]
    u, v = number[: len(ends[0])], number[len(ends[0]) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            break
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    names = nodes.astype(">u8").tobytes()
    for i in range(0, len(moved), 10_000):
        some = moved[i : i + 10_000].tolist()
        yield pa.RecordBatch.from_arrays([pa.array([names[16 * x : 16 * x + 16] for x in root[some].tolist()], pa.binary()), pa.array([names[16 * x : 16 * x + 16] for x in some], pa.binary())], ["u", "v"])


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60, task_links: int = 1_000_000) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), 16-byte ids; root is the smallest node of its component.

    Tasks of at most ``task_links`` links first contract what they hold. If that is one task, its result is the components;
    else what is left alternates the large-star and small-star steps: each moves every neighbourhood's links to its minimum, so the number of
    rounds grows with the logarithm of the longest path. Each round is written out, which ends its lineage. Minima are
    pre-aggregated before the shuffle and the joins are inner ones that adaptive execution can split, so a hub of any degree
    is dealt out. An empty table gives an empty result; null ends and self-loops link nothing.
    """
    links = scratch.save(edges.where("u < v").select("u", "v"), "links")
    tasks = -(-links.count() // task_links)
    now, before = scratch.save(links.coalesce(max(1, tasks)).mapInArrow(freed(contracted), "u binary, v binary"), "cc"), None
    scratch.drop(links)
    if tasks <= 1:
        return _rooted(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour is linked to the minimum.
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # Small star: a node and its smaller neighbours are linked to the least of these.
        small_least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(small_least, "v")
        small = joined.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct()
        after = scratch.save(small, "cc")
        # Done when no node is both an end and a start: all links are stars already.
        n, digest = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if (n, digest) == before:
            break
        before = (n, digest)
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return _rooted(now)


def _rooted(now: DataFrame) -> DataFrame:
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
