"""Stupid-backoff language-model scores, computed relationally (operator 9).

S(w | v) = c(v w) / c(v) where the pair occurs ``least`` times or more, else ``alpha`` c(w) / N; a text's first word has
c(w) / N. A text's score is the sum of log S over its words, with counts over all texts. Words are lower-cased (A-Z).

* Word counts: counted in each chunk, then summed by hash of the word. The commonest, at most ``common`` of them, are broadcast
  (16 bytes each) and numbered, so that a pair of them is one exact number of 42 bits. With them a text's score as if all its
  pairs backed off is known where it is read, and what each pair adds if it does not.
* Count table of pairs: counted in each task's buffers, then dealt by number into slices and summed. It holds the pairs that
  occur ``least`` times or more, a row of sorted numbers and counts for each slice.
* Pairs of more than a ``most_hot``-th of all places, at most ``most_hot`` therefore, are broadcast and added where they are read:
  no slice holds a pair of a large share of the rows. All other pairs of all texts are dealt to the slices of the count table,
  where they stream by and join it; memory is that of one slice of the table.
* Pairs with a word beyond the commonest are rows, counted and joined with ordinary aggregations, and so are such words.
* What slices add is summed by chunk of texts, in which the places of its texts are known, and then by document.

A slice stands for about ``slice_pairs`` places, so each buffer of some megabytes gives a row for each slice: up to some hundred
GB of text rows are long. Beyond, ``slice_pairs`` should grow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._numeric import U, Words, as_long, chunks
from ._repeats import NO_ID, keyed
from ._store import MOST_PARTITIONS, Scratch

#: Two numbers of words, of 21 bits each, and an odd number that spreads the pair over as many bits and can be undone.
WORD_BITS = 21
PAIR_MASK = U((1 << 2 * WORD_BITS) - 1)
SPREAD = 0x1E3779B97F5 | 1
UNSPREAD = pow(SPREAD, -1, 1 << 2 * WORD_BITS)
COUNTS = "slice int, key binary, many binary"
#: Rows of a slice, in the order of ``kind``: 0 its count table, 1 places of a chunk of texts, 2 what is known of such a chunk.
PLACES = "slice int, kind int, chunk bigint, key binary, many binary, of binary, d binary, h binary, base binary, words binary"
#: Of a chunk of texts: what a slice adds to some of them, or who they are.
SUMS = "chunk bigint, of binary, value binary, d binary, h binary, words binary"
PARTS = "d bigint, h bigint, value double, words bigint, texts bigint"
TEXT_BYTES = 4 << 20


def _pack(keys: np.ndarray) -> bytes:
    """Ascending numbers as the first and 32-bit steps, or as they are if one is wider."""
    step = np.diff(keys)
    if len(step) and step.max() < U(1 << 32):
        return b"\1" + keys[:1].tobytes() + step.astype("<u4").tobytes()
    return b"\0" + keys.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"\0":
        return np.frombuffer(data, U, offset=1)
    out = np.frombuffer(data, "<u4", offset=5).astype(U)
    out[0] = np.frombuffer(data, U, 1, 1)[0]
    return np.cumsum(out, dtype=U)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [name for name, _ in fields])


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n): hash and count of each word of the text column, the first."""

    def count(batches):
        def some(held):
            w, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["w", "n"])

        held, size = [], 0
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                held.append(Words(data, at, lower=True).hashes())
                size += len(held[-1])
                if size > 1_500_000:
                    yield some(held)
                    held, size = [], 0
        if held:
            yield some(held)

    return docs.mapInArrow(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def _added(batches):
    """For mapInArrow over sums sorted by chunk: (d, h, value, words, texts) of each text."""

    def out(rows):
        who = next(r for r in rows if r["of"] is None)
        value = np.frombuffer(who["value"], float).copy()
        for r in rows:
            if r["of"] is not None:
                value[np.frombuffer(r["of"], np.uint32)] += np.frombuffer(r["value"], float)
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(who["d"], np.int64)), pa.array(np.frombuffer(who["h"], np.int64)), pa.array(value), pa.array(np.frombuffer(who["words"], np.int64)), pa.array(np.ones(len(value), np.int64))], ["d", "h", "value", "words", "texts"])

    held, now = [], None
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["chunk"] != now:
                yield out(held)
                held = []
            now = r["chunk"]
            held.append(r)
    if held:
        yield out(held)


def _bounds(slices: int) -> np.ndarray:
    return np.array([-(-(i << 2 * WORD_BITS) // slices) for i in range(slices + 1)], U)


def _numbered(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The number of each word in the sorted table, -1 where it isn't in it."""
    distinct, inverse = np.unique(h, return_inverse=True)
    place = np.searchsorted(word, distinct)
    place[place == len(word)] = 0
    if not len(word):
        return np.full(len(h), -1)
    return np.where(word[place] == distinct, place, -1)[inverse]


def _pairs(number: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, spread numbers) of the pairs of which both words are numbered."""
    at = np.flatnonzero((text_of[1:] == text_of[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0))
    code = (number[at].astype(U) << U(WORD_BITS)) | number[at + 1].astype(U)
    return text_of[at], (code * U(SPREAD)) & PAIR_MASK


def _gain(key: np.ndarray, log: np.ndarray, rest: float) -> np.ndarray:
    """What a pair adds to the score when it doesn't back off, but for the log of its count."""
    code = (key * U(UNSPREAD)) & PAIR_MASK
    return rest - log[(code >> U(WORD_BITS)).astype(np.int64)] - log[(code & U((1 << WORD_BITS) - 1)).astype(np.int64)]


def pair_table(texts: DataFrame, known, slices: int, least: int) -> DataFrame:
    """(slice, key, many): of each slice the numbers of the pairs that occur ``least`` times or more, ascending, and their counts."""

    def count(batches):
        bounds = _bounds(slices)

        def some(held):
            key, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(key, bounds)
            rows = [(s, _pack(key[a:b]), n[a:b].astype("<u4").tobytes()) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if a < b]
            return _batch(COUNTS, rows)

        word = np.frombuffer(known.value[0], U)
        held, size = [], 0
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0), TEXT_BYTES):
                t = Words(data, at, lower=True)
                held.append(_pairs(_numbered(t.hashes(), word), np.repeat(np.arange(len(t.count)), t.count))[1])
                size += len(held[-1])
                if size > 2_000_000:
                    yield some(held)
                    held, size = [], 0
        if size:
            yield some(held)

    def summed(batches):
        def out(slice_no, keys, many):
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate(many)).astype(np.int64)
            enough = n >= least
            return _batch(COUNTS, [(slice_no, _pack(key[enough]), n[enough].astype("<i8").tobytes())])

        now, keys, many = None, [], []
        for batch in batches:
            for s, key, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if keys and s != now:
                    yield out(now, keys, many)
                    keys, many = [], []
                now = s
                keys.append(_unpack(key))
                many.append(np.frombuffer(n, "<u4"))
        if keys:
            yield out(now, keys, many)

    parts = max(min(slices, MOST_PARTITIONS), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return texts.mapInArrow(count, COUNTS).repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(summed, COUNTS)


def _rare_rows(texts: DataFrame, known) -> DataFrame:
    """(v, w, d, h): a row for each word that isn't numbered (v null), and for each pair with such a word."""

    def run(batches):
        word = np.frombuffer(known.value[0], U)
        for batch in batches:
            all_d, all_h = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for i, j, data, at in chunks(batch.column(0), TEXT_BYTES):
                t = Words(data, at, lower=True)
                h, text_of = t.hashes(), np.repeat(np.arange(j - i), t.count)
                rare = _numbered(h, word) < 0
                alone = np.flatnonzero(rare)
                both = np.flatnonzero((text_of[1:] == text_of[:-1]) & (rare[1:] | rare[:-1]))
                of = i + text_of[np.concatenate((alone, both))]
                v = pa.array(as_long(np.concatenate((h[alone], h[both]))), mask=np.arange(len(of)) < len(alone))
                w = pa.array(as_long(np.concatenate((h[alone], h[both + 1]))))
                yield pa.RecordBatch.from_arrays([v, w, pa.array(all_d[of]), pa.array(all_h[of])], ["v", "w", "d", "h"])

    return texts.mapInArrow(run, "v bigint, w bigint, d bigint, h bigint")


def _rare_sums(rows: DataFrame, words: DataFrame, least: int, rest: float) -> DataFrame:
    """(d, h, more): what words and pairs of :func:`_rare_rows` add to what is known where texts are read."""
    log = words.select("w", F.log("n").alias("log"))
    alone = rows.where("v is null").groupBy("w", "d", "h").agg(F.count("*").alias("times")).join(log, "w").select("d", "h", (F.col("times") * F.col("log")).alias("value"))
    pairs = rows.where("v is not null").groupBy("v", "w", "d", "h").agg(F.count("*").alias("times"))
    counts = pairs.groupBy("v", "w").agg(F.sum("times").alias("n")).where(F.col("n") >= least)
    counts = counts.join(log, "w").withColumnRenamed("log", "log_w").join(log.select(F.col("w").alias("v"), F.col("log").alias("log_v")), "v")
    counts = counts.select("v", "w", (F.log("n") + F.lit(rest) - F.col("log_v") - F.col("log_w")).alias("gain"))
    both = pairs.join(counts, ["v", "w"]).select("d", "h", (F.col("times") * F.col("gain")).alias("value"))
    return alone.union(both).groupBy("d", "h").agg(F.sum("value").alias("more"))


def _commonest(words: DataFrame, common: int) -> tuple[int, int]:
    """(count that the ``common`` commonest words exceed, places of all words); by bins of counts, of which there are few."""
    bins = words.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.max("n").alias("most"), F.count("*").alias("words"), F.sum("n").alias("places")).collect()
    floor, left = 0, sum(r.words for r in bins)
    for r in sorted(bins, key=lambda r: r.most):
        if left <= common:
            break
        floor, left = r.most, left - r.words
    return floor, sum(r.places for r in bins)


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = 0.4, least: int = 2, common: int = 1 << WORD_BITS, slice_pairs: int = 4_000_000, most_hot: int = 500_000) -> DataFrame:
    """(doc_id, n_words, log_score, mean_score) of each row, rounded to 4 decimals.

    A null or empty text has 0 words and null scores. Repeated rows count as often as they are there, and each gets its row.
    An empty table gives an empty result; further columns take no part. A text of any length is taken whole.
    """
    if common > 1 << WORD_BITS:
        raise ValueError(f"common is {1 << WORD_BITS} at most")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    rows = keyed(docs, doc_id, text).select("text", "d", "h")
    words = scratch.save(word_counts(rows.select("text")), "words")
    floor, total = _commonest(words, common)
    top = words.where(F.col("n") > floor).toArrow()
    w, n = top.column("w").to_numpy().view(U), top.column("n").to_numpy()
    order = np.argsort(w)
    known = spark.sparkContext.broadcast((w[order].tobytes(), np.log(n[order]).tobytes()))
    slices = max(4, -(-int(total) // slice_pairs))
    back, whole = math.log(alpha), math.log(max(1, total))
    table = scratch.save(pair_table(rows.select("text"), known, slices, least), "pairs")

    def often(batches):
        for batch in batches:
            for key, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.frombuffer(many, "<i8")
                hot = n > max(least - 1, total // most_hot)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(_unpack(key)[hot])), pa.array(n[hot])], ["key", "n"])

    hot = table.select("key", "many").mapInArrow(often, "key bigint, n bigint").toArrow()
    key, n = hot.column("key").to_numpy().view(U), hot.column("n").to_numpy()
    order = np.argsort(key)
    key, n = key[order], n[order]
    often_met = spark.sparkContext.broadcast((key.tobytes(), (np.log(n) + _gain(key, np.frombuffer(known.value[1]), whole - back)).tobytes()))

    def dealt(batches):
        word, log, bounds = np.frombuffer(known.value[0], U), np.append(np.frombuffer(known.value[1]), 0.0), _bounds(slices)
        hot, hot_value = np.frombuffer(often_met.value[0], U), np.frombuffer(often_met.value[1])
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            all_d, all_h = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for i, j, data, at in chunks(batch.column(0), TEXT_BYTES):
                t = Words(data, at, lower=True)
                number, text_of = _numbered(t.hashes(), word), np.repeat(np.arange(j - i), t.count)
                base = np.bincount(text_of, weights=log[number] - whole + back, minlength=j - i) - np.where(t.count > 0, back, 0.0)
                of, key = _pairs(number, text_of)
                if len(hot):
                    place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    met = hot[place] == key
                    base += np.bincount(of[met], weights=hot_value[place[met]], minlength=j - i)
                    of, key = of[~met], key[~met]
                order = np.argsort(key, kind="stable")
                of, key = of[order].astype("<u4" if j - i > 1 << 16 else "<u2"), key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                distinct, many = key[first], np.diff(np.append(first, len(key))).astype("<u4")
                cut, ends = np.searchsorted(distinct, bounds), np.append(first, len(key))
                d, h = all_d[i:j], all_h[i:j]
                chunk += 1
                out = [(chunk % slices, 2, chunk, None, None, None, d.tobytes(), h.tobytes(), base.tobytes(), t.count.astype(np.int64).tobytes())]
                for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    if a < b:
                        out.append((s, 1, chunk, _pack(distinct[a:b]), many[a:b].tobytes(), of[ends[a] : ends[b]].tobytes(), None, None, None, None))
                yield _batch(PLACES, out)

    def joined(batches):
        log, slice_no = np.frombuffer(known.value[1]), None
        table, value = np.zeros(0, U), np.zeros(0)
        for batch in batches:
            out = []
            for s, kind, chunk, key, many, of, d, h, base, count in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if s != slice_no:
                    slice_no, table, value = s, np.zeros(0, U), np.zeros(0)
                if kind == 0:
                    table = _unpack(key)
                    value = np.log(np.frombuffer(many, "<i8")) + _gain(table, log, whole - back)
                elif kind == 2:
                    out.append((chunk, None, base, d, h, count))
                elif len(table):
                    key, many = _unpack(key), np.frombuffer(many, "<u4")
                    place = np.minimum(np.searchsorted(table, key), len(table) - 1)
                    each = np.repeat(np.where(table[place] == key, value[place], 0.0), many)
                    texts = np.frombuffer(of, "<u4" if len(of) == 4 * len(each) else "<u2")
                    added = np.bincount(texts, weights=each)
                    some = np.flatnonzero(added)
                    if len(some):
                        out.append((chunk, some.astype("<u4").tobytes(), added[some].tobytes(), None, None, None))
            yield _batch(SUMS, out)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = [F.lit(None).cast("binary").alias(c) for c in ("of", "d", "h", "base", "words")]
    counted = table.select("slice", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("chunk"), "key", "many", *none)
    placed = rows.mapInArrow(dealt, PLACES).union(counted).repartition(max(parts, min(slices, MOST_PARTITIONS)), "slice").sortWithinPartitions("slice", "kind")
    texts = placed.mapInArrow(joined, SUMS).repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_added, PARTS)
    result = texts.groupBy("d", "h").agg(F.sum("value").alias("value"), F.sum("words").alias("words"), F.sum("texts").alias("texts"))
    if floor > 1 or floor >= least:  # else the words not numbered occur once, add nothing, and have no pair that counts
        rare = scratch.save(_rare_rows(rows, known), "rare")
        result = result.join(_rare_sums(rare, words, least, whole - back), ["d", "h"], "left").withColumn("value", F.col("value") + F.coalesce("more", F.lit(0.0)))
    result = result.withColumn("score", F.col("value") / F.col("texts")).withColumn("n_words", (F.col("words") / F.col("texts")).cast("bigint"))
    result = result.withColumn("each", F.explode(F.array_repeat(F.lit(1), F.col("texts").cast("int"))))
    score = F.when(F.col("n_words") > 0, F.col("score"))
    return result.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "n_words", F.round(score, 4).alias("log_score"), F.round(score / F.col("n_words"), 4).alias("mean_score"))
