"""Token ids in Re-Pair compressed shards with random access (operator 1).

Texts are range-partitioned by id, encoded, and written in blocks of about ``block_bytes`` of text. A block is a shard with a
grammar of its own: the most frequent pairs of neighbouring ids, counted over the whole block, become nonterminals, all
occurrences are replaced, and this repeats on what results until no pair pays for its rule or symbols run out. Pairs never cross documents, so each document is a run of symbols
of its own. A block holds, little-endian and in this order:

    "RPB1", then u32: documents, rules, symbols, first nonterminal
    i64 doc_id of each document; u8 whether it is null
    u32 tokens of each document; u32 first symbol of each document, and the number of symbols
    u16 left, u16 right, u32 expansion length of each rule (a rule only refers to ids and earlier rules)
    u16 each symbol

Expansion lengths let a reader skip to any token without expanding what is before it. All symbols fit 16 bits, which bounds
the rules. Blocks are rows of a Parquet table (part, block, ...), so lost tasks are written again and never seen twice.

Encoding looks words up: white space always separates tokens of this kind of vocabulary, so a word's ids don't depend on its
neighbours. Each Python worker keeps a bounded table of words it has encoded with the tokenizers library.
"""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._numeric import Words, chunks, ranges
from ._store import Scratch, freed

END_ID = 2
MAGIC = b"RPB1"


class WordTable:
    """Ids of words by hash; forgets all beyond ``most`` words."""

    #: Stands between words that are encoded in one go, as a token of its own.
    MARK = "\u2402"

    def __init__(self, file: str, most: int = 2_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(file), most
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.size >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.mark = np.array(self.tokenizer.encode(self.MARK, add_special_tokens=False).ids, np.uint16)
        self.stops = np.zeros(128, np.uint16)
        for c in ",.":
            (self.stops[ord(c)],) = self.tokenizer.encode(c, add_special_tokens=False).ids
        # Bytes of words whose case may matter: reserved ids are found in the text as it is, and marks are composed before case.
        self.cased = np.arange(256) >= 128
        self.cased[[t.content.encode()[0] for t in self.tokenizer.get_added_tokens_decoder().values()]] = True
        self.clear()

    def clear(self) -> None:
        self.hash, self.start, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint16)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many of each): many words a call where the mark between them is found again, else one."""
        n = len(self.mark)
        got = np.array(self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(words)], add_special_tokens=False)[0].ids, np.uint16)
        at = np.flatnonzero(got[: len(got) - n + 1] == self.mark[0])
        for i in range(1, n):
            at = at[got[at + i] == self.mark[i]]
        if len(at) == len(words) - 1 and (np.diff(at) > n).all() and not any(self.MARK in w for w in words):
            keep = np.ones(len(got), bool)
            keep[(at[:, None] + np.arange(n)).ravel()] = False
            return got[keep], np.diff(np.concatenate(([-n], at, [len(got)]))) - n
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in each for i in x], np.uint16), np.array([len(x) for x in each])

    def add(self, hashes: np.ndarray, words: list[str]) -> None:
        parts = [self._ids(words[i : i + 2000]) for i in range(0, len(words), 2000)]
        count = np.concatenate([n for _, n in parts]).astype(np.uint32)
        start = (len(self.pool) + np.cumsum(count, dtype=np.int64) - count).astype(np.uint32)
        self.pool = np.concatenate([self.pool, *[x for x, _ in parts]])
        merged = np.concatenate([self.hash, hashes])
        order = np.argsort(merged, kind="stable")
        self.hash, self.start, self.count = merged[order], np.concatenate([self.start, start])[order], np.concatenate([self.count, count])[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many of each), END_ID after each text."""
        # Letters count in lower case, and a comma or full stop after one is a token of its own: fewer words to know.
        words = Words(data, offsets, lower=True)
        kept = np.unique(np.searchsorted(words.start, np.flatnonzero(self.cased[data]), "right") - 1)
        kept = ranges(words.start[kept], words.end[kept] - words.start[kept])
        words.data[kept] = data[kept]
        last, before = words.data[words.end - 1], words.data[np.maximum(words.end - 2, 0)]
        mark = np.where((words.end - words.start > 1) & (before >= 97) & (before <= 122), last, 0)
        marked = (mark == 44) | (mark == 46)
        words.end = words.end - marked
        distinct, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, distinct)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == distinct[known]
        if not known.all():
            if len(self.hash) + (~known).sum() > self.most:
                self.clear()
                known[:] = False
            new = first[~known]
            raw = words.data.tobytes()
            self.add(distinct[~known], [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[new].tolist(), words.end[new].tolist(), strict=True)])
            at = np.searchsorted(self.hash, distinct)
        at = at[inverse]
        count = self.count[at].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(count + marked)))
        per_text = np.diff(total[words.at])
        out = np.full(int(total[-1]) + len(per_text), END_ID, np.uint16)
        # A word's ids go behind those of the words before it and the end ids of the texts before it.
        to = total[:-1] + np.repeat(np.arange(len(per_text)), words.count)
        out[ranges(to, count)] = self.pool[ranges(self.start[at].astype(np.int64), count)]
        out[(to + count)[marked]] = self.stops[mark[marked]]
        return out, per_text + 1


_tables: dict[str, WordTable] = {}


def word_table(file: str) -> WordTable:
    if file not in _tables:
        _tables[file] = WordTable(file)
    return _tables[file]


def compress(ids: np.ndarray, counts: np.ndarray, first: int, rounds: int | None = None, pairs: int = 4000, least: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules (n, 2), symbols of each document): the ``pairs`` most frequent pairs a round, of ``least`` occurrences or more.

    Ends when no pair is left that pays for its rule of 8 bytes, or all 16-bit symbols are used, or after ``rounds``.
    """
    s, rules = ids.astype(np.int32), []
    ends = np.zeros(len(s), bool)
    ends[np.cumsum(counts) - 1] = True
    for _ in itertools.count() if rounds is None else range(rounds):
        room = min(pairs, (1 << 16) - first - len(rules))
        if len(s) < 2 or room <= 0:
            break
        code = (s[:-1].astype(np.int64) << 16) | s[1:]
        free = ~ends[:-1]
        # A pair is frequent only if the pairs that share its slot are; this leaves few to sort.
        slot = ((code * 0x9E3779B1) >> 8) & ((1 << 20) - 1)
        slots = np.bincount(slot[free], minlength=1 << 20)
        floor = max(least, int(np.partition(slots, -room)[-room]))
        maybe = np.flatnonzero(free & (slots[slot] >= floor))
        found, n = np.unique(code[maybe], return_counts=True)
        keep = np.argsort(-n, kind="stable")[:room]
        keep = np.sort(keep[n[keep] >= least])
        if not len(keep):
            break
        found = found[keep]
        at = np.minimum(np.searchsorted(found, code[maybe]), len(found) - 1)
        hit = found[at] == code[maybe]
        place, at = maybe[hit], at[hit]
        # Of neighbouring occurrences, which overlap, every other is taken.
        fresh = np.concatenate(([True], place[1:] != place[:-1] + 1))
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
        even = (np.arange(len(place)) - run) % 2 == 0
        place, at = place[even], at[even]
        used, name = np.unique(at, return_inverse=True)
        base = first + len(rules)
        rules.extend(zip((found[used] >> 16).tolist(), (found[used] & 0xFFFF).tolist(), strict=True))
        s[place] = base + name
        ends[place] = ends[place + 1]
        left = np.ones(len(s), bool)
        left[place + 1] = False
        s, ends = s[left], ends[left]
    stop = np.flatnonzero(ends) + 1
    return s.astype(np.uint16), np.array(rules, np.uint16).reshape(-1, 2), np.diff(np.concatenate(([0], stop)))


def packed(doc_ids: list, ids: np.ndarray, counts: np.ndarray, first: int, **options) -> bytes:
    symbols, rules, per = compress(ids, counts, first, **options)
    length = np.ones(first + len(rules), np.uint32)
    for i, (a, b) in enumerate(rules.tolist()):
        length[first + i] = length[a] + length[b]
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([
        MAGIC, struct.pack("<4I", len(doc_ids), len(rules), len(symbols), first),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), counts.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(per))).astype("<u4").tobytes(),
        rules[:, 0].astype("<u2").tobytes(), rules[:, 1].astype("<u2").tobytes(), length[first:].astype("<u4").tobytes(), symbols.astype("<u2").tobytes(),
    ])


class Block:
    """Reads one block."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block")
        docs, rules, symbols, self.first = struct.unpack_from("<4I", data, 4)
        self.at = 20

        def take(kind: str, n: int) -> np.ndarray:
            out = np.frombuffer(data, kind, n, self.at)
            self.at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.counts, self.offsets = take("<u4", docs), take("<u4", docs + 1)
        self.left, self.right, self.length = take("<u2", rules), take("<u2", rules), take("<u4", rules)
        self.symbols = take("<u2", symbols)
        self._pool: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._pool is None:
            pool = np.zeros(self.first + int(self.length.sum()), np.uint16)
            pool[: self.first] = np.arange(self.first)
            length = np.concatenate((np.ones(self.first, np.int64), self.length.astype(np.int64)))
            start = np.cumsum(length) - length
            for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True), self.first):
                to, n, m = start[i], length[a], length[b]
                pool[to : to + n] = pool[start[a] : start[a] + n]
                pool[to + n : to + n + m] = pool[start[b] : start[b] + m]
            self._pool = pool, start, length
        return self._pool

    def all(self) -> np.ndarray:
        pool, start, length = self._expansions()
        return pool[ranges(start[self.symbols], length[self.symbols])]

    def tokens(self, doc: int, begin: int = 0, end: int | None = None) -> list[int]:
        """Ids begin to end of one document, expanding nothing else: whole symbols before ``begin`` are skipped by length."""
        end = int(self.counts[doc]) if end is None else min(end, int(self.counts[doc]))
        out: list[int] = []
        place = 0
        stack = self.symbols[self.offsets[doc] : self.offsets[doc + 1]][::-1].tolist()
        while stack and place < end:
            x = stack.pop()
            n = 1 if x < self.first else int(self.length[x - self.first])
            if place + n <= begin:
                place += n
            elif x < self.first:
                out.append(x)
                place += 1
            else:
                stack += [int(self.right[x - self.first]), int(self.left[x - self.first])]
        return out


def write_blocks(docs: DataFrame, file: str, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20, **options) -> DataFrame:
    """The table of blocks (part, block, docs, tokens, data), in ascending doc_id by (part, block), nulls first."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    only = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    # The text decides between equal ids, so that one id with many texts doesn't fill one partition.
    dealt = only.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches):
        table, part, block = word_table(file), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def out():
            data = packed([d for x in held for d in x[0]], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), table.size, **options)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([sum(len(x[0]) for x in held)], pa.int64()), pa.array([sum(len(x[1]) for x in held)], pa.int64()), pa.array([data], pa.binary())], ["part", "block", "docs", "tokens", "data"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, at in chunks(batch.column(1)):
                held.append((ids[i:j], *table.encode(data, at)))
                size += len(data) + 64 * (j - i)
                if size >= block_bytes:
                    yield out()
                    held, size, block = [], 0, block + 1
        if held:
            yield out()

    return scratch.save(dealt.mapInArrow(freed(run), "part int, block int, docs bigint, tokens bigint, data binary"), "blocks")


def token_digests(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20, scratch: Scratch | None = None, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row, read back from the written blocks.

    start counts the ids of all rows before it in ascending doc_id, a null id first; rows of equal ids follow each other in an
    order that their texts decide. A null or empty text has the end id alone. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "tokens")
    blocks = write_blocks(docs, file, scratch, doc_id, text, block_bytes, **options)

    def read(batches):
        for batch in batches:
            for part, number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                b = Block(data.as_buffer().to_pybytes())
                ids, stop = b.all().astype("<u4"), np.cumsum(b.counts, dtype=np.int64)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(stop.tolist(), b.counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(crc), pa.int32()), pa.array([number] * len(crc), pa.int32()), pa.array(b.doc_ids, pa.int64()), pa.array(stop - b.counts), pa.array(b.counts.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"])

    rows = blocks.select("part", "block", "data").mapInArrow(freed(read), "part int, block int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = blocks.select("part", "block", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # a row for each partition
    parts = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    at = sizes.select("part", "block", (F.sum("tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("tokens")).alias("inside")).join(parts, "part")
    at = scratch.save(at.select("part", "block", (F.col("before") + F.col("inside")).alias("base")), "starts")
    return rows.join(at, ["part", "block"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
