"""Resampling documents towards a target distribution, by importance weights of hashed word n-grams (operator 11).

Features of a text are its runs of one to three words; a feature's bucket is the CRC of its bytes modulo ``buckets``. A bucket's
gain is the log ratio of its shares in the target and in the corpus, a document's weight the sum of the gains of its features.
Documents are drawn without replacement by weight plus Gumbel noise that the document's id seeds.

The kernel is a byte automaton over the UTF-8 buffer that Arrow holds. One lookup classifies every byte, differences of the
classes give the words, and a table-driven CRC is advanced at the starts of all words at once, a byte of each word a step, words
in order of length so that those not yet at their end are a prefix. The state after a word goes on through the blank into the
next word, so that runs of two and three words cost no more than their last word.

What is gathered of the corpus is a count for each bucket, whatever its size. Texts are read twice and never shuffled; the draw
sorts a narrow row for each document by ranges of (score, id).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._numeric import Words, chunks
from ._store import Scratch

#: Once fewer words than this are left they are finished one by one: a few very long words would take a step for each byte.
FEW = 16


def crc_table(polynomial: int = 0xEDB88320) -> np.ndarray:
    """What each byte does to a reflected CRC."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> 1) ^ np.where(x & 1, np.uint32(polynomial), np.uint32(0))
    return x


TABLE = crc_table()


def advanced(state: np.ndarray, data: np.ndarray, start: np.ndarray, order: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """The states after the bytes of each word. ``order`` has the longest word first, longer[j] counts the words of over j bytes."""
    s, at = state[order], start[order]
    j = 0
    while j < len(longer) and longer[j] >= FEW:
        n = longer[j]
        x = s[:n]
        s[:n] = TABLE[(x ^ data[at[:n]]) & 255] ^ (x >> 8)
        at[:n] += 1
        j += 1
    if j < len(longer):
        left = np.searchsorted(-longer[j:], -np.arange(int(longer[j])), "left")  # bytes left of each word, from the longest on
        for i, n in enumerate(left.tolist()):
            s[i] = zlib.crc32(data[at[i] : at[i] + n], int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int, most_words: int = 3) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of a chunk, and for runs of 1 to ``most_words`` words: (their last words, their buckets)."""
    words = Words(data, offsets, lower=True, alphanumeric=True)
    length = words.end - words.start
    ordinal = np.arange(len(length)) - np.repeat(words.at[:-1], words.count)
    order = np.argsort(length.astype(np.uint16) if length.max(initial=0) < 1 << 16 else length, kind="stable")[::-1]
    longer = len(length) - np.cumsum(np.bincount(length))[:-1] if len(length) else np.zeros(0, np.int64)
    out, state = [], np.full(len(length), 0xFFFFFFFF, np.uint32)
    for n in range(most_words):
        state = advanced(state, words.data, words.start, order, longer)
        last = np.flatnonzero(ordinal >= n)
        out.append((last, (state[last] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)))
        blank = TABLE[(state ^ 0x20) & 255] ^ (state >> 8)
        state = np.concatenate((blank[:1], blank[:-1]))  # the next run ends a word later
    return words, out


def bucket_counts(texts: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts (the first column) fall into each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                for _, bucket in features(data, at, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of the ratio of shares, target over corpus, one added to each count."""
    n = float(len(corpus))
    up = (target.astype(float) + 1.0) * (float(corpus.sum()) + n)
    down = (corpus.astype(float) + 1.0) * (float(target.sum()) + n)
    return np.floor(1000.0 * np.log(up / down)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    only = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for i, j, data, at in chunks(batch.column(1)):
                words, found = features(data, at, len(gain))
                n, weight = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for last, bucket in found:
                    total = np.concatenate(([0], np.cumsum(gain[bucket])))
                    edge = np.searchsorted(last, words.at)  # the first run that ends in each text or after it
                    n += np.diff(edge)
                    weight += np.diff(total[edge])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(words.count.astype(np.int64)), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return only.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def ranked(rows: DataFrame, scratch: Scratch, keys: list, most: int) -> DataFrame:
    """``rows`` with rank (1, 2, 3, ... by ``keys``, null beyond ``most``), by ranges of the keys and never in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, F.asc("__row")]  # rows that are alike come in any order, and don't all fall into one range
    rows = scratch.save(rows.withColumn("__row", F.monotonically_increasing_id()), "to_rank")
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__row")
    # The upper bits of this number are the range, the lower ones the place in it.
    ordered = scratch.save(ordered.withColumn("__place", F.monotonically_increasing_id()), "ranges")
    part, before, low = F.shiftright("__place", 33), [], 0
    for r in sorted(ordered.groupBy(part.alias("part")).count().collect()):  # a row a range
        before.append((r.part, low))
        low += r["count"]
    starts = rows.sparkSession.createDataFrame(before, "__part bigint, __before bigint")
    rank = F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1
    ordered = ordered.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return ordered.withColumn("rank", F.when(rank <= most, rank)).drop("__part", "__before", "__place")


def resampling(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row; rank is null for what isn't drawn.

    Of the documents of ``least_words`` words or more, ``percent`` % are drawn (rounded down) by score, ties to the smaller id,
    null ids first. A null or empty text has no features, weight 0, and is not drawn. Repeated rows count as often as they are
    there and get a rank each; alike in every result, they take turns in no fixed order. A text of any length is taken whole;
    memory follows the longest. Without a target all gains follow the corpus alone. An empty table gives an empty result; further columns take no part.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    gain = gains(bucket_counts(docs.select(docs[text].cast("string")), buckets), bucket_counts(target.select(target[target_text].cast("string")), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = scratch.save(weights(docs, gain, doc_id, text).withColumn("score", F.col("weight") + noise), "weights")
    enough = F.col("n_words") >= least_words
    n = rows.where(enough).count()
    drawn = ranked(rows.where(enough), scratch, [F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features")], percent * n // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    return drawn.select(*columns, "rank").union(rows.where(~enough).select(*columns, F.lit(None).cast("bigint")))


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is drawn; rows that share an id stay or go together."""
    drawn = resampling(docs, target, doc_id, text, **options).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, docs[doc_id].cast("bigint").eqNullSafe(drawn["__drawn"]), "left_semi")
