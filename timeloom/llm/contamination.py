"""Benchmark decontamination by size-partitioned MinHash containment search (operator 3).

A test item is short and a document may be long, so resemblance says little; what counts is the share of the item's word
shingles that the document contains. Items are partitioned by the size of their shingle sets, and the largest size n of a
partition sets what is asked there: each item is indexed under its n - ceil(t n) + h smallest shingle hashes (all, if it has
fewer), and a document is a candidate if it holds h of these at least. One with a containment of t lacks n - ceil(t n) of an
item's hashes at most, so the search misses nothing; h is ``HITS``, or less where the smallest item of the partition needs
fewer. Every shingle of every document probes the index (fixed-size bits first), and candidates are verified by exact containment.

Items are taken in blocks of bounded size, each a pass over the documents that shuffles nothing. Items of fewer than ``k``
words are one shingle of all their words, searched among the documents' runs of as many words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._numeric import BitIndex, U, Words, chunks, grams, mix
from ._store import freed, small_batches

INDEX_BITS = 24
#: Hashes of an item's sketch that a document must hold.
HITS = 3


class ItemIndex:
    """Test items by size of their shingle sets."""

    def __init__(self, ids: list, texts: list[str], k: int, percent: int):
        self.ids, self.parts = ids, []
        self.sizes = np.zeros(len(ids), np.int64)
        self.sets: list[np.ndarray] = [np.zeros(0, U)] * len(ids)
        by: dict[tuple[int, int], list[int]] = {}
        for i, j, data, at in chunks(pa.array(texts, pa.string())):
            words = Words(data, at, lower=True)
            h = words.hashes()
            for item, a, n in zip(range(i, j), words.at.tolist(), words.count.tolist(), strict=False):
                if n:
                    length = min(k, n)
                    self.sets[item] = np.unique(mix(grams(h[a : a + n], length) ^ U(length)))
                    self.sizes[item] = len(self.sets[item])
                    by.setdefault((length, int(self.sizes[item]).bit_length()), []).append(item)
        for (length, _), items in sorted(by.items()):
            needed = -(-percent * self.sizes[items] // 100)
            hits = max(1, min(HITS, int(needed.min())))
            size = int((self.sizes[items] - needed).max()) + hits
            sketch = [self.sets[i][:size] for i in items]
            key, owner = np.concatenate(sketch), np.repeat(items, [len(s) for s in sketch])
            order = np.argsort(key, kind="stable")
            bits = np.zeros(1 << (INDEX_BITS - 6), U)
            spread = mix(key)  # the smallest hashes have like leading bits
            np.bitwise_or.at(bits, (spread >> U(64 - (INDEX_BITS - 6))).astype(np.int64), BitIndex._mask(spread))
            self.parts.append((length, hits, key[order], owner[order], bits))

    def search(self, column: pa.Array, percent: int):
        """(row, item, shared shingles) for each text of ``column`` and item that it contains."""
        for i, _, data, at in chunks(column):
            words = Words(data, at, lower=True)
            h, stop = words.hashes(), words.stop()
            found: set[tuple[int, int, int]] = set()
            made: dict[int, np.ndarray] = {}
            for length, hits, key, owner, bits in self.parts:
                if length not in made:
                    made[length] = mix(grams(h, length) ^ U(length))
                g = made[length]
                hit = np.flatnonzero(BitIndex(INDEX_BITS, bits).has(mix(g)))
                hit = hit[hit + length <= stop[hit]]
                lo, hi = np.searchsorted(key, g[hit], "left"), np.searchsorted(key, g[hit], "right")
                many = hi - lo
                if not many.any():
                    continue
                at_key = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                row = np.searchsorted(words.at, np.repeat(hit, many), "right") - 1
                held = np.unique(row * len(key) + at_key)  # a hash of an item counts once a document
                pair, n = np.unique(held // len(key) * len(self.ids) + owner[held % len(key)], return_counts=True)
                found |= {(length, *divmod(x, len(self.ids))) for x in pair[n >= hits].tolist()}
            for length, r, item in sorted(found, key=lambda x: x[1:]):
                own = made[length][words.at[r] : words.at[r + 1] - length + 1]
                s = self.sets[item]
                place = np.minimum(np.searchsorted(s, own), len(s) - 1)
                shared = len(np.unique(place[s[place] == own]))
                if 100 * shared >= percent * len(s):
                    yield i + r, item, shared


def item_blocks(items: DataFrame, item_id: str, text: str, k: int, percent: int, block_bytes: int):
    """Indexes over blocks of the items, of about ``block_bytes`` of text each; the driver holds one at a time."""
    small_batches(items.sparkSession)
    only = items.select(items[item_id].cast("bigint").alias("item_id"), items[text].cast("string").alias("text")).where("text is not null")
    total = only.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        rows = only.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield ItemIndex([r.item_id for r in rows], [r.text for r in rows], k, percent)


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared): each document that holds ``percent`` or more of an item's shingles.

    Null and empty texts and items contain nothing and are contained in nothing. A null id is carried as it is. Repeated rows
    of either side each give rows. Empty tables give an empty result; further columns take no part.
    """
    spark, out = docs.sparkSession, None
    only = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    for index in item_blocks(items, item_id, item_text, k, percent, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            index = shared.value
            for batch in batches:
                got = list(index.search(batch.column(1), percent))
                rows = [g[0] for g in got]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([index.ids[g[1]] for g in got], pa.int64()), pa.array([int(index.sizes[g[1]]) for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())],
                    ["doc_id", "item_id", "n_item_shingles", "n_shared"],
                )

        found = only.mapInArrow(freed(search), "doc_id bigint, item_id bigint, n_item_shingles bigint, n_shared bigint")
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that contain none of the items; without a shuffle."""
    place = docs.columns.index(text)
    for index in item_blocks(items, item_id, item_text, k, percent, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _, _ in shared.value.search(batch.column(place), percent)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(freed(keep), docs.schema)
    return docs
