"""State carried from line to line of a file, in parallel.

A file is cut into segments: the splits it is read in, or stretches of lines. What a segment does to the state is a small function
that is closed under composition (a threshold and two outcomes, or a table of few states). Each segment's function is found
apart; a row for each segment is enough to compose them in order, which gives the state that each begins with; and then
every segment runs apart from there. Lines of files keep their splits and are never shuffled; lines of tables are dealt by
stretches, so that one long file is many tasks either way.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a file that are dealt together.
STRETCH = 1 << 16


class Machine(Protocol):
    """A state machine over the ``columns`` of rows; it gives a column of type ``kind``. States and effects are JSON values.

    It may have ``effects(columns, edges)`` and ``runs(columns, edges, states)`` too, for the rows of many whole segments that
    begin at ``edges``; files of few lines are slow without.
    """

    columns: list[str]
    kind: str
    initial: object

    def effect(self) -> tuple[Callable[[list[pa.Array]], None], Callable[[], object]]:
        """(takes the rows of a segment, a batch at a time; what they do to the state they begin with)."""

    def after(self, effect: object, state: object) -> object:
        """The state that a segment of that effect leaves behind."""

    def run(self, state: object) -> Callable[[list[pa.Array]], pa.Array]:
        """Gives the column for batches of the rows of a segment that begins with ``state``."""


def _edges(batch: pa.RecordBatch) -> list[int]:
    """Where the segments of a batch of (path, block, line_no, ...) begin, and its end."""
    path, block = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
    if not len(block):
        return []
    new = np.append(True, pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1]))
    return np.append(np.flatnonzero(new), len(block)).tolist()


def _pieces(batch: pa.RecordBatch, inner: bool) -> Iterator[tuple[list[int], pa.RecordBatch]]:
    """(edges, rows) of each segment in a batch; with ``inner`` those between the first and the last, which are whole, are taken at once."""
    edge = _edges(batch)
    cuts = [edge[:2], edge[1:-1], edge[-2:]] if inner and len(edge) > 4 else list(map(list, zip(edge[:-1], edge[1:], strict=True)))
    for e in cuts:
        yield [x - e[0] for x in e], batch.slice(e[0], e[-1] - e[0])


def _in_order(last: int, piece: pa.RecordBatch, edges: list[int]) -> int:
    """The last segment's last line so far. State along a file means nothing if its lines come in another order."""
    at, begins = piece.column(2).to_numpy(zero_copy_only=False), np.zeros(len(piece), bool)
    begins[edges[:-1]] = True
    if at[0] <= last or (at[1:] <= at[:-1])[~begins[1:]].any():
        raise ValueError("the lines of a segment don't ascend")
    return int(at[-1])


def stretch_of(line_no: Column, stretch: int = STRETCH) -> Column:
    return F.floor(line_no / stretch).cast("bigint")


def carried(df: DataFrame, machine: Machine, name: str, stretch: int = STRETCH, placed: bool = False) -> DataFrame:
    """Adds what ``machine`` gives for each row of (path, line_no, ...), along each file in line order.

    Lines as :func:`read_lines` gives them have their split as ``block`` and come in its order. Others are dealt by ``stretch``
    lines. ``placed``: they have been already, have their stretch as ``block`` and come in its order. Line numbers of a file have to differ.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = "block" in df.columns and not placed
    df = df if splits or placed else df.withColumn("block", stretch_of(F.col("line_no"), stretch))
    keys, kept = ["path", "block", "line_no"], [c for c in df.columns if c not in ("path", "block", "line_no")]

    def dealt(rows: DataFrame) -> DataFrame:
        return rows if splits or placed else rows.repartition(n, "path", "block").sortWithinPartitions(*keys)

    many = hasattr(machine, "effects")  # short segments are taken many at a time by machines that can

    def summarised(batches):
        now = last = take = done = None
        for batch in batches:
            out = []
            for edges, piece in _pieces(batch, many):
                segment = (piece.column(0)[0].as_py(), piece.column(1)[0].as_py())
                if segment != now:
                    out += [(*now, json.dumps(done()))] if now else []
                    now, last, (take, done) = segment, -1, machine.effect()
                last = _in_order(last, piece, edges)
                if len(edges) > 2:
                    names = [piece.column(i).take(pa.array(edges[:-1])).to_pylist() for i in (0, 1)]
                    out += zip(*names, map(json.dumps, machine.effects(piece.columns[3:], edges)), strict=True)
                    now = None
                else:
                    take(piece.columns[3:])
            yield _rows(out)
        yield _rows([(*now, json.dumps(done()))] if now else [])

    def composed(batches):
        """A row for each segment but those that begin with the initial state."""
        path, state, last = None, machine.initial, None
        for batch in batches:
            out = []
            for p, block, effect in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p == path:
                    state = machine.after(json.loads(last), state)
                    out.append((p, block, json.dumps(state)))
                else:
                    path, state = p, machine.initial
                last = effect
            yield _rows(out)

    def ran(batches):
        now = last = call = None
        for batch in batches:
            states, out = batch.column(batch.num_columns - 1), []
            at = 0
            for edges, piece in _pieces(batch, many):
                segment = (piece.column(0)[0].as_py(), piece.column(1)[0].as_py())
                begin = [machine.initial if x is None else json.loads(x) for x in states.take(pa.array([at + e for e in edges[:-1]])).to_pylist()]
                if segment != now:
                    now, last, call = segment, -1, machine.run(begin[0])
                last = _in_order(last, piece, edges)
                columns = [piece.column(piece.schema.get_field_index(c)) for c in machine.columns]
                out.append(machine.runs(columns, edges, begin) if len(edges) > 2 else call(columns))
                now = None if len(edges) > 2 else now
                at += piece.num_rows
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.concat_arrays(out)], [*batch.schema.names[:-1], name])

    effects = dealt(df.select(*keys, *machine.columns)).mapInArrow(summarised, "path string, block bigint, effect string")
    states = effects.repartition(n, "path").sortWithinPartitions("path", "block").mapInArrow(composed, "path string, block bigint, state string")
    # A row for each split, of which read_lines bounds the number; else Spark decides, after the rows are dealt.
    rows = dealt(df.select(*keys, *kept)).join(F.broadcast(states) if splits else states, ["path", "block"], "left").select(*keys, *kept, "state")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, *kept).schema)
    out = (rows if splits else rows.sortWithinPartitions(*keys)).mapInArrow(ran, f"{schema}, `{name}` {machine.kind}")
    return out if splits else out.drop("block")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    path, block, text = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(block, pa.int64()), pa.array(text, pa.string())], ["path", "block", "text"])


class Rollover:
    """Which rows of ``low`` and ``high`` times, a year apart or the same, are the high one.

    A row is high if the time given to the row above is nearer to that. So it is high for sure if even the low time above is
    nearer to high, low for sure if the high time above isn't, and else like the row above. Rows without times are passed over.
    An effect is (the sum of the first row's times, the last time if the first row is low, and if it is high); null without rows.
    """

    columns, kind, initial = ["low", "high"], "boolean", None

    @staticmethod
    def _late(low: np.ndarray, high: np.ndarray, first: np.ndarray, late: np.ndarray) -> np.ndarray:
        """Which rows are high, if of those that begin a segment (``first``) it is the ones that are ``late``."""
        middle = low + high
        sure_high = np.append(False, 2 * low[:-1] > middle[1:])
        sure_low = np.append(True, 2 * high[:-1] <= middle[1:])
        sure_high[first], sure_low[first] = late, ~late
        settled = np.maximum.accumulate(np.where(sure_high | sure_low, np.arange(len(low)), 0))
        return sure_high[settled]

    @classmethod
    def _high(cls, low: np.ndarray, high: np.ndarray, before: int | None) -> np.ndarray:
        return cls._late(low, high, np.zeros(1, int), np.array([before is not None and 2 * before > low[0] + high[0]]))

    @staticmethod
    def _begins(some: np.ndarray, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(which segments have rows with times, where these begin among such rows)"""
        counts = np.add.reduceat(some.astype(np.int64), edges[:-1])
        return counts > 0, (np.cumsum(counts) - counts)[counts > 0]

    @staticmethod
    def _times(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = columns[0].is_valid().to_numpy(zero_copy_only=False)
        low, high = (c.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)[some] for c in columns)
        return some, low, high

    def effect(self):
        out: list = [None]

        def take(columns):
            _, low, high = self._times(columns)
            if not len(low):
                return
            if out[0] is None:
                # Before any time the first row is low, after one beyond all others it is high.
                starts = [(int(low[0] + high[0]), None), (0, 1 << 61)]
            else:
                starts = [(out[0][0], out[0][1]), (0, out[0][2])]
            ends = [int((high if self._high(low, high, before)[-1] else low)[-1]) for _, before in starts]
            out[0] = [starts[0][0], *ends]

        return take, lambda: out[0]

    def effects(self, columns, edges):
        """The effects of many whole segments."""
        some, low, high = self._times(columns)
        has, first = self._begins(some, edges)
        if not len(first):
            return [None] * len(has)
        last, ends = np.append(first[1:], len(low)) - 1, [(low + high)[first]]
        for late in (False, True):
            ends.append(np.where(self._late(low, high, first, np.full(len(first), late)), high, low)[last])
        found = iter(np.stack(ends, 1).tolist())
        return [next(found) if h else None for h in has.tolist()]

    def runs(self, columns, edges, states):
        """The column for the rows of many whole segments."""
        some, low, high = self._times(columns)
        has, first = self._begins(some, edges)
        out = np.zeros(len(some), bool)
        if len(first):
            known = np.array([s is not None for s in states])[has]
            before = np.array([s or 0 for s in states], np.int64)[has]
            out[some] = self._late(low, high, first, known & (2 * before > (low + high)[first]))
        return pa.array(out)

    def after(self, effect, state):
        if effect is None:
            return state
        middle, low, high = effect
        return high if state is not None and 2 * state > middle else low

    def run(self, state):
        now = [state]

        def call(columns):
            some, low, high = self._times(columns)
            out = np.zeros(len(some), bool)
            if len(low):
                late = self._high(low, high, now[0])
                now[0] = int((high if late[-1] else low)[-1])
                out[some] = late
            return pa.array(out)

        return call


class Table:
    """A machine of few states: ``step(state, value)`` gives (state, what the row gets). An effect is the end for each start."""

    def __init__(self, column: str, kind: str, arrow: pa.DataType, states: int, step: Callable):
        self.columns, self.kind, self.initial = [column], kind, 0
        self.arrow, self.states, self.step = arrow, states, step

    def effect(self):
        ends = list(range(self.states))

        def take(columns):
            for value in columns[0].to_pylist():
                new = {s: self.step(s, value)[0] for s in set(ends)}  # soon few: most values leave one state only
                ends[:] = [new[s] for s in ends]

        return take, lambda: ends

    def after(self, effect, state):
        return effect[state]

    def run(self, state):
        now = [state]

        def call(columns):
            out = []
            for value in columns[0].to_pylist():
                now[0], got = self.step(now[0], value)
                out.append(got)
            return pa.array(out, self.arrow)

        return call


class Records:
    """Numbers the records of a file whose lines may continue one another.

    Of each line it reads whether the next one continues it, if it begins a record itself (``opens``) and if it continues one
    (``stays``), and whether it is ``blank``, which no record begins with. It gives the record's number, from 1; negative for lines
    that continue it, 0 for what is in none. A state is (whether a record is open, records so far); an effect is what each of
    both beginnings comes to, with the records that begin meanwhile.
    """

    columns, kind, initial = ["opens", "stays", "blank"], "bigint", (False, 0)

    @staticmethod
    def _open(opens: np.ndarray, stays: np.ndarray, before: bool) -> np.ndarray:
        """Whether a record is open before each line, and after the last: lines settle that, keep it or turn it over."""
        turned = np.concatenate(([0], np.cumsum(opens & ~stays)))
        settles = np.concatenate(([True], opens == stays))
        value = np.concatenate(([before], opens)) ^ (turned % 2 == 1)
        last = np.maximum.accumulate(np.where(settles, np.arange(len(settles)), 0))
        return value[last] ^ (turned % 2 == 1)

    @staticmethod
    def _flags(columns: list[pa.Array]) -> list[np.ndarray]:
        return [c.to_numpy(zero_copy_only=False).astype(bool) for c in columns]

    def effect(self):
        ends = [[False, 0], [True, 0]]

        def take(columns):
            opens, stays, blank = self._flags(columns)
            opens = opens & ~blank
            for end in ends:
                is_open = self._open(opens, stays, end[0])
                end[1] += int((~is_open[:-1] & ~blank).sum())
                end[0] = bool(is_open[-1])

        return take, lambda: ends

    def after(self, effect, state):
        is_open, more = effect[int(state[0])]
        return is_open, state[1] + more

    def run(self, state):
        now = [*state]

        def call(columns):
            opens, stays, blank = self._flags(columns)
            is_open = self._open(opens & ~blank, stays, now[0])
            begins = ~is_open[:-1] & ~blank
            number = now[1] + np.cumsum(begins)
            now[:] = [bool(is_open[-1]), int(number[-1]) if len(number) else now[1]]
            return pa.array(np.where(begins, number, np.where(is_open[:-1], -number, 0)))

        return call
