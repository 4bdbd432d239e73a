"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks (operator 7).

Sources get target words by weight, none above a multiple of what it has (the excess is shared again by weight). Targets become
integer numbers of equal blocks by the highest quotients v / (2 s + 1), and the words that fill no block are apportioned in the
same way, one by one, so that sources of a few words get theirs too. A source's quota is apportioned likewise to bundles of
``bundle`` shards, and a bundle's to its shards: seeded hash partitions of about ``shard_docs`` documents. In a shard
the documents stand in a seeded order, the blocks are cut from that order, and the quota takes whole passes over it and then its
first blocks.

Sources are few (``max_sources``, an error beyond, and 20 or so in practice), so their apportionment runs on the driver; all
per-document work is one aggregation and one window over shards of bounded size, and no text is shuffled.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._numeric import word_counts
from ._store import Scratch, freed

WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights: list[int], share: Fraction = Fraction(3, 2), most: int = 2) -> list[float]:
    """Each source's target: ``share`` of all sizes by weight, cut at ``most`` times its size, the excess shared again."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ -= over
    return [float(x) for x in out]


def apportion(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1), ties to the earlier, none above ``most``; all of ``most`` if too few."""
    votes, most = np.asarray(votes, float), np.where(np.asarray(votes, float) > 0, most, 0).astype(np.int64)
    if most.sum() <= seats:
        return most
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    # All quotients above 1 / (2 d) win a seat in any case for the divisor d found by bisection; the rest go one by one.
    low, high = 0.0, float(votes.max()) * 2 + 1
    for _ in range(200):
        d = (low + high) / 2
        if d <= low or d >= high:
            break
        low, high = (d, high) if np.minimum(most, np.floor(votes / d + 0.5)).sum() > seats else (low, d)
    got = np.minimum(most, np.floor(votes / high + 0.5)).astype(np.int64)
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in np.flatnonzero(got < most)]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def quotas(votes: np.ndarray, words: int, most: np.ndarray, block: int) -> np.ndarray:
    """``words`` in all, none above ``most``: the blocks that fit into the votes' shares, then words by what is left of these."""
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    share = votes * (words / max(float(votes.sum()), 1e-300))
    got = block * apportion(votes, words // block, np.minimum(most, np.floor(share).astype(np.int64)) // block)
    got = got + apportion(np.maximum(share - got, 0), words - int(got.sum()), most - got)
    return got + apportion(votes, words - int(got.sum()), most - got)


def _plan(docs: DataFrame, doc_id: str, text: str, source: str, weights, share, most: int, block: int, shard_docs: int, seed: int, max_sources: int, bundle: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their shard and order, shards with their passes and rest)."""
    spark = docs.sparkSession
    only = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[source].cast("string").alias("source"), docs[text].cast("string").alias("text")).withColumn("seeded", F.xxhash64(F.lit(seed), "doc_id", "text"))

    def sized(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(word_counts(b.column(2)), pa.int64())], ["doc_id", "source", "seeded", "size"])

    rows = Scratch(spark, "mixing").save(only.mapInArrow(freed(sized), "doc_id bigint, source string, seeded bigint, size bigint"), "sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(max_sources + 1).collect()
    if len(per) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    per.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes, use = [r.size for r in per], [weights[i % len(weights)] for i in range(len(per))]
    goal = targets(sizes, use, share, most)
    quota = quotas(np.array(goal), round(sum(goal)), np.array([most * s for s in sizes]), block) if per else []
    plan = spark.createDataFrame([(r.source, i, r.size, goal[i], int(quota[i]), max(1, -(-r.docs // shard_docs))) for i, r in enumerate(per)], "source string, source_no int, source_size bigint, target double, quota bigint, shards bigint")
    plan = F.broadcast(plan)  # at most max_sources rows
    placed = rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("doc_id", "seeded", "size", "source_no", "source_size", "target", "quota", F.pmod(F.xxhash64("seeded"), F.col("shards")).alias("shard"))

    def bundled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bundle")
        quota = quotas(pdf["words"].to_numpy(), int(pdf["quota"].iloc[0]), most * pdf["words"].to_numpy(), block)
        return pd.DataFrame({"source_no": pdf["source_no"], "bundle": pdf["bundle"], "quota": quota})

    def dealt(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        words = pdf["words"].to_numpy()
        take, some = quotas(words, int(pdf["quota"].iloc[0]), most * words, block), np.maximum(words, 1)
        return pd.DataFrame({"source_no": pdf["source_no"], "shard": pdf["shard"], "passes": take // some, "rest": take % some})

    shards = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    shards = shards.withColumn("bundle", F.floor(F.col("shard") / bundle))
    shared = shards.groupBy("source_no", "bundle").agg(F.sum("words").alias("words"), F.first("quota").alias("quota"))
    shared = shared.groupBy("source_no").applyInPandas(bundled, "source_no int, bundle bigint, quota bigint")
    shards = shards.drop("quota").join(shared, ["source_no", "bundle"])
    shards = shards.groupBy("source_no", "bundle").applyInPandas(dealt, "source_no int, shard bigint, passes bigint, rest bigint")
    before = F.sum("size").over(Window.partitionBy("source_no", "shard").orderBy("seeded", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    return placed.withColumn("before", before), shards


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2, block: int = 8, shard_docs: int = 4096, seed: int = 7, max_sources: int = 1_000_000, bundle: int = 4096) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row: the words the mix takes of it, repeats counted.

    Sources are ordered by code point, null last, and get ``weights`` in turn. taken is at most ``most`` times size; only one
    document of a shard is taken in part. A null or empty text has size 0 and gives 0. Rows that are alike in id and text take
    turns in no fixed order, which their equal results don't show. An empty table gives an empty result.
    """
    rows, shards = _plan(docs, doc_id, text, source, weights, share, most, block, shard_docs, seed, max_sources, bundle)
    taken = F.col("passes") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    return rows.join(shards, ["source_no", "shard"]).select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2, block: int = 8, shard_docs: int = 4096, seed: int = 7, max_sources: int = 1_000_000, bundle: int = 4096, broadcast_shards: int = 100_000) -> DataFrame:
    """The mix as rows of ``docs``, all columns: each whole as often as it is taken, to the nearest whole number.

    Of a shard, what is taken once more are the documents before a place in the seeded order, so the shards' places are all that
    meets the texts: broadcast if they are ``broadcast_shards`` at most, else joined. Rows alike in id and text share a place;
    of those at the last place one row stands for as many as are taken once more. A null or empty text is never taken. An empty
    table gives an empty result.
    """
    rows, shards = _plan(docs, doc_id, text, source, weights, share, most, block, shard_docs, seed, max_sources, bundle)
    taken = (F.col("size") > 0) & (2 * (F.col("rest") - F.col("before")) >= F.col("size")) & (F.col("rest") > F.col("before"))
    cuts = rows.join(shards, ["source_no", "shard"]).groupBy("source_no", "shard", "passes", "seeded").agg(F.count_if(taken).alias("times"))
    cuts = cuts.groupBy("source_no", "shard", "passes").agg(F.max(F.when(F.col("times") > 0, F.struct("seeded", "times"))).alias("last"))
    names = {r.source: r for r in docs.select(docs[source].cast("string").alias("source")).groupBy("source").agg(F.count("*").alias("docs")).collect()}
    order = sorted(names, key=lambda s: (s is None, s or ""))
    count = {s: max(1, -(-names[s].docs // shard_docs)) for s in order}
    own = "__mix"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    plan = docs.sparkSession.createDataFrame([(s, i, count[s]) for i, s in enumerate(order)], f"{own}_source string, {own}_no int, {own}_shards bigint")
    cuts = cuts.select(F.col("source_no").alias(f"{own}_no"), F.col("shard").alias(f"{own}_shard"), F.col("passes").alias(f"{own}_passes"), F.col("last.seeded").alias(f"{own}_last"), F.col("last.times").alias(f"{own}_more"))
    cuts = F.broadcast(cuts) if sum(count.values()) <= broadcast_shards else cuts
    seeded = F.xxhash64(F.lit(seed), docs[doc_id].cast("bigint"), docs[text].cast("string"))
    placed = docs.withColumn(f"{own}_seeded", seeded).join(F.broadcast(plan), docs[source].cast("string").eqNullSafe(F.col(f"{own}_source")))
    placed = placed.withColumn(f"{own}_shard", F.pmod(F.xxhash64(f"{own}_seeded"), F.col(f"{own}_shards"))).join(cuts, [f"{own}_no", f"{own}_shard"])
    has_words = F.coalesce(docs[text].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    before = F.coalesce((F.col(f"{own}_seeded") < F.col(f"{own}_last")).cast("int"), F.lit(0))

    def times(df: DataFrame, n: Column) -> DataFrame:
        return df.withColumn(f"{own}_time", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*docs.columns)

    at_last = placed.where(has_words & (F.col(f"{own}_seeded") == F.col(f"{own}_last"))).dropDuplicates([f"{own}_no", f"{own}_seeded"])
    return times(placed.where(has_words), F.col(f"{own}_passes") + before).unionAll(times(at_last, F.col(f"{own}_more")))
