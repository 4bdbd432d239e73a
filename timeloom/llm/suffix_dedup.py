"""Substring deduplication over bytes by bucket-pointer refinement (operator 10).

Suffixes are put in buckets by their first 64 bytes and refined to a depth of ``length`` bytes: the bucket of a suffix at
depth 2 d is the pair of its bucket at depth d and that of the suffix d bytes later, which is known already; the last step
uses an offset that makes the depth exact. Buckets are named by 64-bit identifiers of their contents instead of ranks, so
names agree between tasks without a global sort; within a task, sorting them finds suffixes that share one.

Not every suffix is sorted. Of the 64-byte strings in a window of ``length`` bytes one has the least hash, and in two equal
windows it is the same one. Such anchors, about 1 in 70 bytes, are bucketed first; those alone in their bucket can't be in a
repeated window and are dropped. The remaining buckets meet with the text around them, from which all their suffixes are
refined. Nothing is missed, and what is compared grows with what repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._numeric import BASES, U, chunks, mix, pair, powers
from ._places import meeting, met_key, slice_count
from ._repeats import cut_out, keyed, repeated_intervals, row_names, text_bytes
from ._store import Scratch

Q = 64


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i : i + width], by doubling."""
    now, w = x, 1
    while 2 * w <= width:
        now = best(now[:-w], now[w:])
        w *= 2
    return best(now[: len(now) - (width - w)], now[width - w :]) if w < width else now


def first_buckets(data: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Identifiers of the first Q bytes of all suffixes, or of those at the given places."""
    n = len(data)
    up, down = powers(BASES[0], n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:n], out=total[1:])
    if place is None:
        return mix((total[Q:] - total[:-Q]) * down[: n + 1 - Q])
    return mix((total[place + Q] - total[place]) * down[place])


def anchors_of(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, bucket identifiers) of the anchors in a chunk of texts, in bytes from the chunk's start."""
    n, span = len(data), length - Q + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U)
    bucket = first_buckets(data)
    rank = (bucket >> U(32)).astype(np.uint32)
    least = _sliding(rank, span, np.minimum)
    # Windows that cross into the next text choose no anchors.
    crossing = np.zeros(len(least) + 1, np.int32)
    ends = at[1:-1]
    np.add.at(crossing, np.clip(ends - length + 1, 0, len(least)), 1)
    np.add.at(crossing, np.clip(ends, 0, len(least)), -1)
    least = np.where(np.cumsum(crossing[:-1]) > 0, np.uint32(0), least)
    padded = np.concatenate((np.zeros(span - 1, np.uint32), least, np.zeros(span - 1, np.uint32)))
    chosen = np.flatnonzero(_sliding(padded, span, np.maximum) == rank)
    return chosen, bucket[chosen]


def refined(context: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers at depth ``length`` of the suffixes at each offset of each row of bytes."""
    rows, width = context.shape
    up, down = powers(BASES[1], width + 1)
    total = np.zeros((rows, width + 1), U)
    np.cumsum((context.astype(U) + U(1)) * up[:width], axis=1, out=total[:, 1:])
    now, depth = mix((total[:, Q:] - total[:, :-Q]) * down[: width + 1 - Q]), Q
    while 2 * depth <= length:
        now, depth = pair(now[:, :-depth], now[:, depth:], depth), 2 * depth
    if depth < length:
        now = pair(now[:, : now.shape[1] - (length - depth)], now[:, length - depth :], length)
    return now


def repeats(docs: DataFrame, length: int, most: int, slice_bytes: int | None, scratch: Scratch) -> DataFrame:
    """(d, h, a, b) over :func:`keyed` rows: byte intervals that cover every string of ``length`` with a second occurrence."""
    before, slices = length - Q, slice_count(text_bytes(docs), slice_bytes)

    def buckets(batch):
        d, h = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        for i, j, data, at in chunks(batch.column(0)):
            place, bucket = anchors_of(data, at, length)
            yield row_names(d[i:j], h[i:j]), at[:-1], place, mix(bucket), None  # anchors have small hashes; keys need to be spread

    found = meeting(docs.select("text", "d", "h"), buckets, slices, scratch, most=most)

    def anchors(batches):
        for batch in batches:
            d, h, places = np.asarray(batch.column(1)), np.asarray(batch.column(2)), batch.column(3).to_pylist()
            for i, j, data, at in chunks(batch.column(0), 1 << 18):
                place = np.concatenate([at[k - i] + np.frombuffer(places[k], "<u4").astype(np.int64) for k in range(i, j)])
                row = np.searchsorted(at, place, "right") - 1
                first, stop = np.maximum(at[row], place - before), np.minimum(at[row + 1], place + length)
                raw = data.tobytes()
                around = [raw[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
                g = met_key(mix(first_buckets(data, place)), slices)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(d[i + row]), pa.array(h[i + row]), pa.array((place - at[row]).astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array(around, pa.binary())], ["g", "d", "h", "at", "left", "around"])

    def spread(batch):
        left = np.asarray(batch.column("left")).astype(np.int64)
        around = batch.column("around").to_pylist()
        size = np.array([len(x) for x in around], np.int64)
        context = np.zeros((len(around), before + length), np.uint8)
        at = np.arange(before + length)[None, :] - (before - left)[:, None]
        context[(at >= 0) & (at < size[:, None])] = np.frombuffer(b"".join(around), np.uint8)
        ids = refined(context, length) | U(1)
        start = at[:, : before + 1]
        return np.where((start >= 0) & (start + length <= size[:, None]), ids, U(0)), before

    return repeated_intervals(docs, found, anchors, "g bigint, d bigint, h bigint, at int, left int, around binary", spread, length, scratch, slice_bytes=slice_bytes)


def kept_bytes(ids: list, column: pa.Array, a: list[list[int]], b: list[list[int]]):
    """(doc_id, bytes, removed, runs removed, kept bytes) of each text without its intervals."""
    for i, j, data, at in chunks(column):
        for k in range(i, j):
            raw = data[at[k - i] : at[k - i + 1]]
            runs: list[list[int]] = []
            for x, y in zip(a[k], b[k], strict=True):
                if runs and x <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], y)
                else:
                    runs.append([x, y])
            keep = np.ones(len(raw), bool)
            for x, y in runs:
                keep[x:y] = False
            kept = raw[keep].tobytes()
            yield ids[k], len(raw), len(raw) - len(kept), len(runs), kept


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, most: int = 40_000, slice_bytes: int | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row; kept is binary, or with ``digest`` kept_sha256.

    A byte goes if a string of ``length`` bytes over it also starts at another place, in the same row or any other. A null or
    empty text has no bytes. A repeated row is another place. Rows without an id are rows like others. A text of any length is
    taken whole. An empty table gives an empty result; further columns take no part. Buckets of more than ``most`` anchors are
    compared by their surroundings.
    """
    if length < Q + 1:
        raise ValueError(f"length must exceed {Q}")
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = keyed(docs, doc_id, text)
    found = repeats(rows, length, most, slice_bytes, scratch)
    last, kind = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())

    def cut(ids, column, a, b):
        got = list(kept_bytes(ids, column, a, b))
        kept = [hashlib.sha256(x[4]).hexdigest() if digest else x[4] for x in got]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in got], pa.int64()) for c in range(4)] + [pa.array(kept, kind)], ["doc_id", "n_bytes", "n_removed", "n_spans", last])

    return cut_out(rows, found, cut, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last} {'string' if digest else 'binary'}", scratch)
