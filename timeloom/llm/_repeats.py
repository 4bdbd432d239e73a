"""What the two operators on repeated passages share: groups of anchors, what repeats around them, and cutting it out.

An anchor row is (g, d, h, at, ...): the identifier of the anchor's content, the row it is in (id and text hash), its place.
``spread`` turns a batch of anchor rows into a matrix of identifiers, one column for each window around the anchor by offset,
0 where the row's text has no such window. Windows are equal exactly if they have equal identifiers in one column; the
anchors of equal windows are equal, so only rows of one g have to meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._numeric import BitIndex, U, mix
from ._places import meeting, slice_count
from ._store import Scratch, freed

NO_ID = -(1 << 63)
INTERVALS = "d bigint, h bigint, a int, b int"


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, d, h). Rows alike in id and text have like results, so these name a row well enough."""
    only = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    return only.withColumn("d", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("h", F.xxhash64("text"))


def _intervals(d, h, first, last, length: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(first, pa.int32()), pa.array(last + length, pa.int32())], ["d", "h", "a", "b"])


def _seen_twice(ids: np.ndarray) -> np.ndarray:
    flat = ids.ravel()
    used = flat != 0
    column = np.tile(np.arange(ids.shape[1], dtype=U), len(ids))
    _, inverse, n = np.unique((flat ^ mix(column))[used], return_inverse=True, return_counts=True)
    hit = np.zeros(len(flat), bool)
    hit[used] = n[inverse] > 1
    return hit.reshape(ids.shape)


def _runs_of(spread: Callable, batch: pa.RecordBatch, length: int, chosen: Callable) -> Iterator[pa.RecordBatch]:
    """The intervals that the chosen windows of each row cover, a row for each run of neighbours."""
    ids, before = spread(batch)
    hit = np.pad(chosen(ids), ((0, 0), (1, 1)))
    row, first = np.nonzero(hit[:, 1:] & ~hit[:, :-1])
    _, last = np.nonzero(hit[:, :-1] & ~hit[:, 1:])
    last = last - 1
    at = np.asarray(batch.column("at")).astype(np.int64)[row] - before
    yield _intervals(np.asarray(batch.column("d"))[row], np.asarray(batch.column("h"))[row], at + first, at + last, length)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def row_names(d: np.ndarray, h: np.ndarray) -> bytes:
    """16 bytes for each row of :func:`keyed`."""
    return np.column_stack((d, h)).astype(">i8").tobytes()


def perhaps_in(docs: DataFrame, names: DataFrame, bits: int = 26) -> Callable[[bool], Callable]:
    """Filters for mapInArrow over rows of :func:`keyed`: True keeps all that are in ``names`` (d, h) and some others, False the rest.

    What is broadcast is of fixed size. If there are more names than it can tell apart, more rows than need be go on to the
    join that follows, at most all.
    """

    def keys(batches):
        for b in batches:
            key = mix(np.asarray(b.column(0)).view(U) ^ mix(np.asarray(b.column(1)).view(U)))
            got = list(BitIndex.sliced(key))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], ["slice", "keys"])

    index = BitIndex.built(names.select("d", "h").mapInArrow(keys, "slice int, keys binary"), bits, twice=False)
    shared = docs.sparkSession.sparkContext.broadcast(index.words.tobytes())

    def chosen(has: bool):
        def run(batches):
            wanted = BitIndex(bits, np.frombuffer(shared.value, U))
            for b in batches:
                yield b.filter(pa.array(wanted.has(mix(np.asarray(b.column("d")).view(U) ^ mix(np.asarray(b.column("h")).view(U)))) == has))

        return run

    return chosen


def placed(met: DataFrame) -> DataFrame:
    """(d, h, at, key) from the names that :func:`row_names` gave, one row for each."""
    part = lambda i: F.conv(F.hex(F.substring("name", i, 8)), 16, -10).cast("bigint")
    return met.select(part(1).alias("d"), part(9).alias("h"), "at", "key").dropDuplicates(["d", "h"])


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(text, d, h, at) of the rows of :func:`keyed` that have ``places``; other texts aren't shuffled."""
    docs = docs.select("text", "d", "h")
    some = docs.mapInArrow(perhaps_in(docs, places)(True), docs.schema)
    return some.join(hashed_if_small(places.select("d", "h", "at"), F.octet_length("at")), ["d", "h"]).select("text", "d", "h", "at")


def hashed_if_small(side: DataFrame, width: Column, most: int = 32 << 20) -> DataFrame:
    """A side of a join with texts, hashed where its share of a partition is ``most`` bytes at most, so that texts aren't sorted."""
    parts = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = side.agg(F.sum(width + 64)).first()[0] or 0
    return side.hint("shuffle_hash") if size <= most * parts else side


def repeated_intervals(docs: DataFrame, found: tuple[DataFrame, DataFrame, DataFrame], anchors: Callable, schema: str, spread: Callable, length: int, scratch: Scratch, batch_rows: int = 1000, slice_bytes: int | None = None) -> DataFrame:
    """(d, h, a, b): intervals that cover every window of ``length`` which occurs at two places or more.

    ``found``: what :func:`meeting` found of anchors. ``anchors(batches)`` makes rows of ``schema`` from their texts,
    (text, d, h, at). ``spread(batch)`` gives (identifiers (rows, offsets), how far before the anchor the first window starts). Contents that are
    not common are compared in one task, where they stream by. Around common ones, rows with the same surroundings
    are settled by counting those; of the distinct surroundings left, windows are compared by key in slices.
    """
    common = scratch.save(found[1], "common")
    some_common = bool(common.take(1))
    places = scratch.save(placed(found[0]), "places")
    scratch.drop(found[2])
    n = int(common.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def few(batches):
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.RecordBatch):
            g = np.asarray(rows.column("g"))
            same = np.concatenate(([False], g[1:] == g[:-1]))
            alone = ~(same | np.append(same[1:], False))
            rows = rows.filter(pa.array(~alone))
            g = g[~alone]
            start = 0
            while start < len(g):  # batches end where a group ends
                end = int(np.searchsorted(g, g[min(start + batch_rows, len(g)) - 1], "right"))
                yield from _runs_of(spread, rows.slice(start, end - start), length, _seen_twice)
                start = end

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            g = np.asarray(batch.column("g"))
            cut = int(np.searchsorted(g, g[-1], "left"))
            if cut:
                rows = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]).combine_chunks().to_batches()
                held = [batch.slice(cut)]
                for r in rows:
                    yield from flush(r)
        for r in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
            yield from flush(r)

    rare = with_places(docs, places).mapInArrow(freed(anchors), schema)
    rare = rare.join(common, "g", "left_anti") if some_common else rare
    found = rare.repartition(n, "g").sortWithinPartitions("g").mapInArrow(freed(few), INTERVALS)
    if not some_common:
        return found

    # Of these, rows whose windows are all the same as another's are settled together; one of them stands for them below.
    def named(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, batch_rows):
                part = batch.slice(i, batch_rows)
                ids, _ = spread(part)
                yield part.append_column("around_id", pa.array(mix(mix(ids ^ mix(np.arange(ids.shape[1], dtype=U))).sum(axis=1, dtype=U)).view(np.int64)))

    have = places.select("d", "h", F.explode("key").alias("g")).join(common, "g", "left_semi").select("d", "h").distinct()
    have = scratch.save(places.join(have, ["d", "h"], "left_semi"), "common-places")
    rows = with_places(docs, have).mapInArrow(freed(anchors), schema).join(common, "g", "left_semi")
    many = scratch.save(rows.mapInArrow(named, StructType([*rows.schema.fields, StructField("around_id", LongType())])), "common-anchors")
    alike = many.groupBy("around_id").agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "at")).alias("first"))
    alike = scratch.save(alike, "alike")
    settled = many.join(alike.where("n > 1").select("around_id"), "around_id", "left_semi").drop("around_id")

    def whole(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, batch_rows):
                yield from _runs_of(spread, batch.slice(i, batch_rows), length, lambda ids: ids != 0)

    rest = many.join(alike.select("around_id", "first"), "around_id").where(F.struct("d", "h", "at") == F.col("first")).drop("around_id", "first")
    rest = scratch.save(rest, "distinct-anchors")

    def windows(batch):
        for i in range(0, batch.num_rows, batch_rows):
            part = batch.slice(i, batch_rows)
            ids, before = spread(part)
            row, column = np.nonzero(ids)
            width = ids.shape[1]
            names = np.column_stack([np.asarray(part.column("d")), np.asarray(part.column("h")), np.asarray(part.column("at")).astype(np.int64) - before]).astype("<i8")
            yield names.tobytes(), np.arange(len(ids)) * width, row * width + column, mix(ids[row, column] ^ mix(column.astype(U))), None

    met, _, _ = meeting(rest, windows, slice_count(rest.count() * 1024, slice_bytes), scratch, width=24, exact=True)

    def spans(batches):
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d, h, start = np.frombuffer(name, "<i8").tolist()
                at = np.frombuffer(at, "<u4").astype(np.int64)
                edge = np.flatnonzero(np.diff(at, prepend=-2, append=1 << 40) > 1)
                first, last = at[edge[:-1]], at[edge[1:] - 1]
                yield _intervals(np.full(len(first), d), np.full(len(first), h), start + first, start + last, length)

    return found.union(settled.mapInArrow(whole, INTERVALS)).union(met.mapInArrow(spans, INTERVALS))


def cut_out(docs: DataFrame, intervals: DataFrame, cut: Callable, schema: str, scratch: Scratch, bits: int = 26) -> DataFrame:
    """``cut(doc_ids, texts, a, b)`` over all rows of :func:`keyed`, with the sorted intervals of each as lists, empty where none.

    Only rows that may have intervals are joined; the others are cut where they are read.
    """
    # As many as a row has anchors at most.
    of = scratch.save(intervals.groupBy("d", "h").agg(F.collect_set(F.struct("a", "b")).alias("s")), "intervals")

    chosen = perhaps_in(docs, of, bits)

    def plain(batches):
        for b in chosen(False)(batches):
            none = [[]] * b.num_rows
            yield from cut(b.column("doc_id").to_pylist(), b.column("text"), none, none)

    def joined(batches):
        for b in batches:
            a, e = [], []
            for s in b.column("s").to_pylist():
                s = sorted((x["a"], x["b"]) for x in s or [])
                a.append([x[0] for x in s])
                e.append([x[1] for x in s])
            yield from cut(b.column("doc_id").to_pylist(), b.column("text"), a, e)

    some = docs.mapInArrow(chosen(True), docs.schema).join(hashed_if_small(of, 32 * F.size("s")), ["d", "h"], "left").select("doc_id", "text", "s")
    return docs.mapInArrow(plain, schema).union(some.mapInArrow(joined, schema))
