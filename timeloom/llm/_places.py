"""Which places of a corpus meet: keys of places, dealt by key into slices and compared there, whatever their number.

A place has a key (a hash of what is there) and is a reference or a probe. Two places of one key meet if one of them is a
reference. A chunk of texts sends, for each slice, the low 32 bits of its keys and where they are, about 5 bytes a place. A
slice first takes all references, of which it holds one a key, then lets the probes stream by; those that meet go back, by
chunk, to what is known of the chunk. Keys that agree in slice and 32 bits meet without being equal, about one in a thousand
in the largest slices, so an exact comparison has to follow; with ``exact`` all 64 bits go and decide.

A slice stands for ``slice_bytes`` of text, 64 MB to 512 MB as the input grows, so that a chunk's rows for all slices stay few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._numeric import U
from ._store import MOST_PARTITIONS, Scratch, freed

#: Kinds, in their order within a slice: 0 references, 1 probes, 2 what is known of a chunk, sent on.
DEALT = "slice int, kind int, chunk bigint, key binary, place binary, names binary, starts binary"
#: Places that meet, by chunk; what is known of a chunk; without a chunk, keys of more than ``most`` places.
FOUND = "chunk bigint, key binary, place binary, names binary, starts binary"
MET = "name binary, at binary, key array<bigint>"
HELD = 1 << 18


def slice_count(text_bytes: int, slice_bytes: int | None = None) -> int:
    return max(2, -(-text_bytes // (slice_bytes or min(512 << 20, max(64 << 20, text_bytes // 8192)))))


def slice_of(key: np.ndarray, slices: int) -> np.ndarray:
    return ((key >> U(32)) * U(slices)) >> U(32)


def met_key(key: np.ndarray, slices: int) -> np.ndarray:
    """What stands for a key in results: its slice and low 32 bits."""
    return ((slice_of(key, slices) << U(32)) | (key & U(0xFFFFFFFF))).view(np.int64)


def _steps(place: np.ndarray) -> bytes:
    """Ascending numbers as steps of the least width that holds them all."""
    step = np.diff(place, prepend=0)
    width = 1 if (most := int(step.max(initial=0))) < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + step.astype(f"<u{width}").tobytes()


def _placed(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1), dtype=np.int64)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [name for name, _ in fields])


class _Slice:
    """The references of a slice, one for each key, and how many places each key has."""

    def __init__(self, number: int, most: int, kind: str):
        self.number, self.most = number, most
        self.key, self.chunk, self.place, self.count = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def _whole(self, key: np.ndarray) -> bytes:
        return key.tobytes() if key.itemsize == 8 else ((self.number << 32) | key.astype(np.int64)).tobytes()

    def _rows(self, key: np.ndarray, chunk: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        order = np.lexsort((place, chunk))
        key, chunk, place = key[order], chunk[order], place[order]
        edge = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1, append=chunk[-1] + 1)) if len(chunk) else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield int(chunk[a]), self._whole(key[a:b]), _steps(place[a:b]), None, None

    def add(self, chunk: int, key: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        self.new.append((key, np.full(len(key), chunk), place))
        self.size += len(key)
        if self.size > HELD:
            yield from self.settle()

    def settle(self) -> Iterator[tuple]:
        """Takes in what was added; of a key that was there already, all but the first place meet and go."""
        if not self.new:
            return
        key, chunk, place = (np.concatenate(x) for x in zip(*self.new, strict=True))
        self.new, self.size = [], 0
        order = np.argsort(key, kind="stable")
        key, chunk, place = key[order], chunk[order], place[order]
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        known = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        np.add.at(self.count, at[known], 1)
        first = ~known & np.append(True, key[1:] != key[:-1])
        yield from self._rows(key[~first], chunk[~first], place[~first])
        number = np.cumsum(first) - 1
        count = np.bincount(number[~known], minlength=int(first.sum()))
        merged = np.concatenate((self.key, key[first]))
        order = np.argsort(merged, kind="stable")
        self.key = merged[order]
        self.chunk, self.place, self.count = (np.concatenate(x)[order] for x in ((self.chunk, chunk[first]), (self.place, place[first]), (self.count, count)))

    def probe(self, chunk: int, key: np.ndarray, place: bytes) -> Iterator[tuple]:
        yield from self.settle()
        if not len(self.key):
            return
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = np.flatnonzero(self.key[at] == key)
        if len(hit):
            np.add.at(self.count, at[hit], 1)
            yield chunk, self._whole(key[hit]), _steps(_placed(place)[hit]), None, None

    def end(self) -> Iterator[tuple]:
        yield from self.settle()
        met = self.count > 1
        yield from self._rows(self.key[met], self.chunk[met], self.place[met])
        many = self.count > self.most
        if many.any():
            yield None, self._whole(self.key[many]), None, None, None


def meeting(rows: DataFrame, places: Callable, slices: int, scratch: Scratch, width: int = 16, most: int = 1 << 62, exact: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((name, at, key) of each text with places that meet, (g) keys of more than ``most`` places, the table that both read).

    ``places(batch)`` yields of each chunk of ``rows``: names (bytes, ``width`` for each text), starts (ascending), places
    (ascending, counted over the chunk; one belongs to the last text that starts at or before it), keys (uint64, well mixed),
    and which are references (None: all). ``at`` (u4) are places less their text's start, ``key`` what :func:`met_key` gives,
    or the key itself if ``exact``.
    """
    bits = "<u8" if exact else "<u4"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for names, starts, place, key, reference in places(batch):
                chunk += 1
                out = [(chunk % slices, 2, chunk, None, None, names, starts.astype("<i8").tobytes())]
                group = slice_of(key, slices).astype(np.int64)
                if reference is not None:
                    group = 2 * group + ~reference
                order = np.argsort(group.astype(np.uint16) if slices < 1 << 15 else group, kind="stable")
                group, place, low = group[order], place[order], key[order].astype(bits)
                edge = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(group) else []
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    s, kind = divmod(int(group[a]), 2) if reference is not None else (int(group[a]), 0)
                    out.append((s, kind, chunk, low[a:b].tobytes(), _steps(place[a:b]), None, None))
                yield _batch(DEALT, out)

    def compared(batches):
        now: _Slice | None = None
        for batch in batches:
            out = []
            for s, kind, chunk, key, place, names, starts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.number != s:
                    out += now.end() if now else ()
                    now = _Slice(s, most, bits)
                if kind == 2:
                    out.append((chunk, None, None, names, starts))
                elif kind == 0:
                    out += now.add(chunk, np.frombuffer(key, bits), _placed(place))
                else:
                    out += now.probe(chunk, np.frombuffer(key, bits), place)
                if len(out) > 1000:
                    yield _batch(FOUND, out)
                    out = []
            yield _batch(FOUND, out)
        if now:
            yield _batch(FOUND, list(now.end()))

    def named(rows_of):
        who = next(r for r in rows_of if r["names"] is not None)
        rows_of = [r for r in rows_of if r["names"] is None]
        if not rows_of:
            return []
        place, key = np.concatenate([_placed(r["place"]) for r in rows_of]), np.concatenate([np.frombuffer(r["key"], np.int64) for r in rows_of])
        order = np.argsort(place, kind="stable")
        place, key, starts = place[order], key[order], np.frombuffer(who["starts"], "<i8")
        text = np.searchsorted(starts, place, "right") - 1
        edge = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
        at = (place - starts[text]).astype("<u4")
        return [(who["names"][width * t : width * t + width], at[a:b].tobytes(), key[a:b]) for t, a, b in zip(text[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def gathered(batches):
        held, now = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["chunk"] != now:
                    yield _batch(MET, named(held))
                    held = []
                now = r["chunk"]
                held.append(r)
        if held:
            yield _batch(MET, named(held))

    dealt_rows = rows.mapInArrow(freed(dealt), DEALT).repartition(max(parts, min(slices, MOST_PARTITIONS)), "slice").sortWithinPartitions("slice", "kind")
    found = scratch.save(dealt_rows.mapInArrow(freed(compared), FOUND), "found")
    met = found.where("chunk is not null").repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(freed(gathered), MET)

    def listed(batches):
        for batch in batches:
            for key in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(key, np.int64))], ["g"])

    return met, found.where("chunk is null").select("key").mapInArrow(listed, "g bigint"), found
