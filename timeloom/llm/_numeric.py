"""Vectorised text kernels over Arrow string columns: words, rolling hashes, sets, and fixed-size bit indexes.

Texts are handled as the UTF-8 bytes that Arrow already holds, in chunks of about a megabyte, so memory follows the chunk (or
the longest single text) and not the partition. Hashes are 64 bits wide; where equality decides a result two are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20
#: Odd multipliers, one per independent hash.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Word separators: space, and tab to carriage return.
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII other than letters and digits; all else counts as letters.
_NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """The identifier of the concatenation of what ``a`` and ``b`` identify."""
    x = a * U(0xFF51AFD7ED558CCD) + b
    x ^= x >> U(32)
    x *= U(0xC4CEB9FE1A85EC53 ^ (salt << 1))
    x ^= x >> U(29)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(size, base, U)) * U(pow(base, -1, 1 << 64))
            down = np.cumprod(np.full(size, pow(base, -1, 1 << 64), U)) * U(base)
        _powers[base] = have = (up, down)
    return have


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, their offsets from 0), each of at most ``limit`` bytes or one text."""
    if len(column) == 0:
        return
    data, at = texts(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """The words of a chunk of texts: ``start`` and ``end`` in bytes, ``at`` the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, alphanumeric: bool = False):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        is_word = ~(_NOT_ALNUM if alphanumeric else _IS_SEP)[data]
        first, last = is_word.copy(), is_word.copy()
        first[1:] &= ~is_word[:-1]
        last[:-1] &= ~is_word[1:]
        inner = offsets[:-1][offsets[:-1] < n]
        first[inner] = is_word[inner]
        inner = inner[inner > 0] - 1
        last[inner] = is_word[inner]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.at)

    def hashes(self, lane: int = 0) -> np.ndarray:
        up, down = powers(BASES[lane], len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * up[: len(self.data)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(U) * U(0x632BE59BD9B4E019))

    def stop(self) -> np.ndarray:
        """For each word, the word after the last of its text."""
        return np.repeat(self.at[1:], self.count)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Identifiers of every run of k, by doubling; runs may cross texts, which the caller masks."""
    width, now = 1, h
    while 2 * width <= k:
        now = pair(now[:-width], now[width:], width) if len(now) > width else now[:0]
        width *= 2
    if width < k:
        now = pair(now[: len(now) - (k - width)], now[k - width :], k) if len(now) > k - width else now[:0]
    return now


def shingle_sets(words: Words, k: int = 5) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct identifiers of its k-word shingles; of fewer words, one for the whole; of none, none."""
    h = words.hashes()
    full = mix(grams(h, k) ^ U(k))
    for a, n in zip(words.at[:-1].tolist(), words.count.tolist(), strict=True):
        if n >= k:
            got = full[a : a + n - k + 1].copy()
            got.sort()
            yield got[np.concatenate(([True], got[1:] != got[:-1]))]
        else:
            yield mix(grams(h[a : a + n], n) ^ U(n)) if n else h[:0]


def set_id(shingles: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    n = U(len(shingles))
    return b"".join(int(mix(np.array([mix(shingles ^ U(b)).sum(dtype=U) + n], U))[0]).to_bytes(8, "big") for b in BASES)


def word_counts(column: pa.Array) -> np.ndarray:
    parts = [Words(data, at).count for _, _, data, at in chunks(column)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


class BitIndex:
    """Membership bits of fixed size, cut into slices that tasks build apart. May report a key that is not there, never miss one.

    ``bits`` fixes the size whatever the input: 2**(bits - 3) bytes, which bounds what is broadcast. Beyond some keys a bit,
    more and more passes that need not; exact counting follows wherever this is used, so results never depend on it.
    """

    SLICE_BITS = 5

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def _mask(key: np.ndarray) -> np.ndarray:
        one, low = U(1), U(63)
        return (one << (key & low)) | (one << ((key >> U(6)) & low)) | (one << ((key >> U(12)) & low)) | (one << ((key >> U(18)) & low))

    def has(self, key: np.ndarray) -> np.ndarray:
        m = self._mask(key)
        return (self.words[(key >> U(64 - (self.bits - 6))).astype(np.int64)] & m) == m

    @classmethod
    def sliced(cls, key: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Distinct keys packed by slice, for :meth:`built`."""
        key = np.unique(key)
        cut = np.searchsorted(key >> U(64 - cls.SLICE_BITS), np.arange((1 << cls.SLICE_BITS) + 1, dtype=U))
        for s in range(1 << cls.SLICE_BITS):
            if cut[s] < cut[s + 1]:
                yield s, key[cut[s] : cut[s + 1]].tobytes()

    @classmethod
    def built(cls, keys, bits: int, twice: bool) -> BitIndex | tuple[BitIndex, BitIndex]:
        """From a frame (slice int, keys binary): the index of all keys, and with ``twice`` also that of keys of two rows or more.

        The rows of a slice stream through one task, whose memory is that of the slices it holds; the driver receives the
        finished bits alone.
        """
        size = 1 << (bits - 6 - cls.SLICE_BITS)

        def build(batches):
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for s, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    seen, again = held.setdefault(s, (np.zeros(size, U), np.zeros(size if twice else 0, U)))
                    key = np.frombuffer(packed.as_buffer(), U)
                    m, at = cls._mask(key), ((key >> U(64 - (bits - 6))) & U(size - 1)).astype(np.int64)
                    if twice:
                        old = (seen[at] & m) == m
                        np.bitwise_or.at(again, at[old], m[old])
                    np.bitwise_or.at(seen, at, m)
            for s, (seen, again) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([seen.tobytes()], pa.binary()), pa.array([again.tobytes()], pa.binary())], ["slice", "seen", "again"])

        out = [np.zeros(1 << (bits - 6), U) for _ in range(1 + twice)]
        for row in keys.repartition(1 << cls.SLICE_BITS, "slice").mapInArrow(build, "slice int, seen binary, again binary").toLocalIterator():
            for into, part in zip(out, (row.seen, row.again), strict=False):
                into[row.slice * size : (row.slice + 1) * size] |= np.frombuffer(part, U)
        return (cls(bits, out[0]), cls(bits, out[1])) if twice else cls(bits, out[0])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and length, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
