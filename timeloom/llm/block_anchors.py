"""Substring deduplication over words by fixed-block anchors (operator 6).

A repeated window of ``window`` words holds a whole block of (window + 1) // 2 words of any text cut into such blocks. So the
non-overlapping blocks of every text are indexed and every rolling window of a block's length probes the index:

1. blocks and rolling windows are dealt by content into slices of the index, about 5 bytes each, and those that meet are anchors;
2. around each anchor stand the identifiers of all windows that contain it, and anchors of equal words meet: a hit extends as
   far as these windows repeat. Only texts with anchors are joined to them and read again.

The index is as large as the corpus needs and lies in as many tasks; nothing of it is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._numeric import U, Words, chunks, grams, mix
from ._places import meeting, met_key, slice_count
from ._repeats import cut_out, keyed, repeated_intervals, row_names, text_bytes
from ._store import Scratch

class Rolling:
    """Rolling block hashes of a chunk: ``key``, and which of them are whole and which are blocks of their text."""

    def __init__(self, data: np.ndarray, at: np.ndarray, block: int):
        self.words = Words(data, at)
        self.hash = self.words.hashes()
        self.key = mix(grams(self.hash, block))
        n = len(self.key)
        self.stop = self.words.stop()
        self.first = np.repeat(self.words.at[:-1], self.words.count)
        place = np.arange(n)
        self.whole = place + block <= self.stop[:n]
        self.block = self.whole & ((place - self.first[:n]) % block == 0)


def repeats(docs: DataFrame, window: int, most: int, slice_bytes: int | None, scratch: Scratch) -> DataFrame:
    """(d, h, a, b) over :func:`keyed` rows: word intervals that cover every window with a second occurrence."""
    block = (window + 1) // 2
    offsets, slices = window - block + 1, slice_count(text_bytes(docs), slice_bytes)

    def probes(batch):
        d, h = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        for i, j, data, at in chunks(batch.column(0)):
            r = Rolling(data, at, block)
            place = np.flatnonzero(r.whole)
            yield row_names(d[i:j], h[i:j]), r.words.at[:-1], place, r.key[place], r.block[place]

    found = meeting(docs.select("text", "d", "h"), probes, slices, scratch, most=most)

    def anchors(batches):
        for batch in batches:
            d, h, places = np.asarray(batch.column(1)), np.asarray(batch.column(2)), batch.column(3).to_pylist()
            for i, j, data, at in chunks(batch.column(0), 1 << 18):
                r = Rolling(data, at, block)
                found = np.concatenate([r.words.at[k - i] + np.frombuffer(places[k], "<u4").astype(np.int64) for k in range(i, j)])
                full = mix(grams(r.hash, window)) | U(1)
                start = found[:, None] - (window - block) + np.arange(offsets)
                inside = (start >= r.first[found][:, None]) & (start + window <= r.stop[found][:, None])
                ids = np.where(inside, full[np.clip(start, 0, max(0, len(full) - 1))], U(0)) if len(full) else np.zeros(start.shape, U)
                some = inside.any(axis=1)
                found, ids = found[some], ids[some]
                row = np.searchsorted(r.words.at, found, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(met_key(r.key[found], slices)), pa.array(d[i + row]), pa.array(h[i + row]), pa.array((found - r.words.at[row]).astype(np.int32)), pa.array([x.tobytes() for x in ids], pa.binary())], ["g", "d", "h", "at", "ids"])

    def spread(batch):
        return np.frombuffer(b"".join(batch.column("ids").to_pylist()), U).reshape(batch.num_rows, offsets), window - block

    return repeated_intervals(docs, found, anchors, "g bigint, d bigint, h bigint, at int, ids binary", spread, window, scratch, slice_bytes=slice_bytes)


def kept_words(ids: list, column: pa.Array, a: list[list[int]], b: list[list[int]]):
    """(doc_id, n_words, n_removed, kept text) of each text without its intervals."""
    for i, j, data, at in chunks(column):
        words = Words(data, at)
        for k in range(i, j):
            lo, hi = int(words.at[k - i]), int(words.at[k - i + 1])
            keep = np.ones(hi - lo, bool)
            for x, y in zip(a[k], b[k], strict=True):
                keep[x:y] = False
            start, end = words.start[lo:hi][keep].tolist(), words.end[lo:hi][keep].tolist()
            raw = data[at[k - i] : at[k - i + 1]].tobytes()
            base = int(at[k - i])
            yield ids[k], hi - lo, int(hi - lo - keep.sum()), b" ".join([raw[s - base : e - base] for s, e in zip(start, end, strict=True)])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, most: int = 40_000, slice_bytes: int | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row; with ``digest``, kept_sha256 instead of the kept text.

    A word goes if it is in a window of ``window`` words whose sequence also starts at another place, in the same row or any
    other. A null or empty text has no words. A repeated row is another place, so all its windows go. Rows without an id are
    rows like others. A text of any length is taken whole. An empty table gives an empty result; further columns take no part.
    Blocks at more than ``most`` places are compared by their surroundings.
    """
    scratch = Scratch(docs.sparkSession, "blocks")
    rows = keyed(docs, doc_id, text)
    found = repeats(rows, window, most, slice_bytes, scratch)
    last = "kept_sha256" if digest else "kept"

    def cut(ids, column, a, b):
        got = list(kept_words(ids, column, a, b))
        kept = [hashlib.sha256(x[3]).hexdigest() if digest else x[3].decode("utf-8", "replace") for x in got]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", last])

    return cut_out(rows, found, cut, f"doc_id bigint, n_words bigint, n_removed bigint, {last} string", scratch)
