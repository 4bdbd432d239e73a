"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersection (operator 5).

Texts are lower-cased (A-Z), split into words, and turned into sets of hashed word shingles. Two texts whose Jaccard similarity
is at least t share one of the n - ceil(t n) + 1 first shingles of either, in any order that all follow: here by hash, with
the most common shingles last. Only texts that share such a shingle meet:

1. the first shingles of all texts are dealt by hash into slices, some 5 bytes each; those of one text alone are forgotten;
2. texts of equal sets become one class; classes that share a shingle meet in a tile. A shingle of more texts than a tile
   takes has a tile for each band of sizes (a ratio a little above 100 / percent) with the next, cut into pairs of blocks of
   bounded size. There the parity bitmaps' differing bits bound the overlap from above. A tile gives a spanning forest of what passes, not its pairs;
3. the forests' components are small sets of texts that may be near. In blocks of these, pairs that pass the bitmap bound and
   are not connected yet are intersected exactly as sorted arrays, which again gives a forest;
4. the components of these exact links are the result.

A link that a forest leaves out joins texts which are connected anyway, so no component loses a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._numeric import BitIndex, U, Words, as_long, chunks, grams, mix, set_id, shingle_sets
from ._places import meeting, slice_count
from ._repeats import text_bytes
from ._store import Scratch, freed
from .components import connected_components

#: Ratio of sizes in a band, as a multiple of what ``percent`` allows.
BAND = 1.008
COMMON_BITS = 22


def parity_bits(shingles: np.ndarray) -> bytes:
    """A bitmap of 0.6 to 1.2 bits for each shingle, 64 to 8,192 in all; each shingle flips a bit.

    Unlike sets then differ in 0.3 bits a shingle or more, and sets of similarity 0.8 in 0.23 at most.
    """
    width = min(8192, max(64, 1 << max(0, int(0.6 * len(shingles)) - 1).bit_length()))
    at = (mix(shingles) & U(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width) & 1 == 1, bitorder="little").tobytes()


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of a bitmap at a smaller width: bits that meet are added modulo 2, so differences still bound from above."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def overlap_needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection with 100 |A and B| >= percent |A or B|."""
    return -(-percent * (a + b) // (100 + percent))


class Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> None:
        roots = np.unique(self.root[np.append(others, a)])
        self.root[np.isin(self.root, roots)] = roots[0]


def _bitmaps(packed: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, U) for x in packed]


def forest(sizes: np.ndarray, bitmaps: list[bytes], cross: np.ndarray | None, percent: int, sets: list[np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """Links (i, j) that span all pairs whose bitmaps allow the similarity, or with ``sets`` all that have it.

    ``cross``: with it, only pairs of which one at least is marked are of interest.
    """
    n, trees, maps = len(sizes), Forest(len(sizes)), _bitmaps(bitmaps)
    order = np.argsort(sizes, kind="stable")
    widths = np.array([len(m) for m in maps])
    # Of each width, all bitmaps that are at least as wide, folded to it.
    at_width = {w: (rows := order[widths[order] >= w], np.stack([_fold(maps[i][None, :], w)[0] for i in rows])) for w in np.unique(widths).tolist()}
    for k, i in enumerate(order.tolist()):
        rows, bits = at_width[int(widths[i])]
        mine = _fold(maps[i][None, :], int(widths[i]))[0]
        near = (100 * sizes[i] >= percent * sizes[rows]) & (sizes[rows] >= sizes[i]) & (trees.root[rows] != trees.root[i])
        near &= (sizes[rows] > sizes[i]) | (rows > i)
        if cross is not None and not cross[i]:
            near &= cross[rows]
        if not near.any():
            continue
        rows, bits = rows[near], bits[near]
        need = overlap_needed(sizes[i], sizes[rows], percent)
        differ = np.bitwise_count(bits ^ mine).sum(axis=1, dtype=np.int64)
        rows = rows[(sizes[i] + sizes[rows] - differ) // 2 >= need]
        if sets is not None and len(rows):
            both = np.concatenate([sets[j] for j in rows])
            at = np.minimum(np.searchsorted(sets[i], both), len(sets[i]) - 1)
            shared = np.add.reduceat((sets[i][at] == both).astype(np.int64), np.cumsum([0, *(len(sets[j]) for j in rows[:-1])]))
            rows = rows[shared >= overlap_needed(sizes[i], sizes[rows], percent)]
        if len(rows):
            _, first = np.unique(trees.root[rows], return_index=True)
            for j in rows[first].tolist():
                yield i, j
            trees.join(i, rows)


def near_pairs(batches, percent: int):
    """For mapInArrow over (t, c, n, bits) sorted by t: links among the rows of each t.

    Texts that are near share many shingles, so the same rows meet again and again; what was compared is remembered, up to a
    fixed number of groups.
    """
    done: set = set()
    us, vs = [], []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

    for group in _runs(batches):
        c = group.column("c").to_pylist()
        key = tuple(sorted(c)) if len(c) < 9 else hash(frozenset(c))
        if key in done:
            continue
        if len(done) > 200_000:
            done.clear()
        done.add(key)
        for a, b in forest(np.asarray(group.column("n")).astype(np.int64), group.column("bits").to_pylist(), None, percent):
            us.append(min(c[a], c[b]))
            vs.append(max(c[a], c[b]))
        if len(us) >= 4096:
            yield out()
            us, vs = [], []
    yield out()


def _runs(batches):
    """Groups of two rows or more of one t, from batches sorted by it; only what may go on is held."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        t = np.asarray(batch.column(0))
        edge = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]))
        for k in np.flatnonzero(np.diff(edge[:-1]) > 1).tolist():
            yield batch.slice(int(edge[k]), int(edge[k + 1] - edge[k]))
        held = batch.slice(int(edge[-2]))
    if held is not None and held.num_rows > 1:
        yield held


def _groups(batches, keys: int):
    """Groups of equal leading columns from sorted batches, one at a time; only the open group is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(c)) for c in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _links(percent: int, marked: bool, exact: bool):
    """For mapInArrow over rows sorted by (t, band, i, j): those, then c, n, bits, block, role and with ``exact`` the sets."""

    def run(batches):
        us, vs = [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

        for group in _groups(batches, 4):
            if group.num_rows > 1:
                c = group.column("c").to_pylist()
                sets = [np.frombuffer(x, U) for x in group.column("sets").to_pylist()] if exact else None
                mark = np.asarray(group.column("role")) == 0 if marked else None
                for a, b in forest(np.asarray(group.column("n")).astype(np.int64), group.column("bits").to_pylist(), mark, percent, sets):
                    us.append(min(c[a], c[b]))
                    vs.append(max(c[a], c[b]))
            if len(us) >= 4096:
                yield out()
                us, vs = [], []
        yield out()

    return run


def _tiled(members: DataFrame, rows: int, columns: list[str]) -> DataFrame:
    """Members of (t, band) cut into blocks of about ``rows``, each pair of blocks a tile (t, band, i, j)."""
    many = members.groupBy("t", "band").agg(F.count("*").alias("m")).where(F.col("m") > rows).select("t", "band", F.ceil(F.col("m") / rows).cast("int").alias("blocks"))
    # A common shingle has many rows: the join's many-sided input is only sent on, and adaptive execution can split it.
    cut = members.join(many, ["t", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.select("t", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *columns)


def _in_tiles(tiles: DataFrame, run) -> DataFrame:
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(n, "t", "band", "i", "j").sortWithinPartitions("t", "band", "i", "j").mapInArrow(freed(run), "u binary, v binary")


def common_shingles(docs: DataFrame, k: int, least: int = 64, most: int = 100_000) -> np.ndarray:
    """Bits of shingles of very many texts, which every text then orders after all others.

    Any order gives the same links; this one keeps what many texts share from bringing these together. Counts cover all texts,
    of shingles that repeat within a few megabytes; ``most`` of them, the most frequent, are told apart.
    """

    def count(batches):
        def some(held):
            s, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(as_long(s[n > 3])), pa.array(n[n > 3].astype(np.int64))], ["s", "n"])

        held, size = [], 0
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                words = Words(data, at, lower=True)
                g = grams(words.hashes(), k)
                held.append(mix(g[np.arange(len(g)) + k <= words.stop()[: len(g)]] ^ U(k)))
                size += len(held[-1])
                if size > 1_200_000:
                    yield some(held)
                    held, size = [], 0
        if held:
            yield some(held)

    counts = docs.mapInArrow(freed(count), "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bits = np.zeros(1 << (COMMON_BITS - 6), U)
    key = np.array([r.s for r in counts.orderBy(F.desc("n"), "s").limit(most).select("s").collect()], np.int64).view(U)
    np.bitwise_or.at(bits, (key >> U(64 - (COMMON_BITS - 6))).astype(np.int64), BitIndex._mask(key))
    return bits


def smallest(s: np.ndarray, late: BitIndex, percent: int) -> np.ndarray:
    """The shingles of a set of which any set that is near shares one: the first in an order with the common ones last."""
    if not len(s):
        return s
    last = late.has(s)
    n = len(s) - -(-percent * len(s) // 100) + 1
    return mix(np.concatenate((s[~last], s[last]))[:n] if last.any() else s[:n])


def shared_tokens(docs: DataFrame, text: str, k: int, percent: int, scratch: Scratch, slice_bytes: int | None = None) -> DataFrame:
    """(c, t): the :func:`smallest` shingles that a set has in common with another, each set once; sets that share none are left out."""
    frequent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs.select(text), k).tobytes())

    def tokens(batch):
        late = BitIndex(COMMON_BITS, np.frombuffer(frequent.value, U))
        for _, _, data, at in chunks(batch.column(0)):
            known = {}
            for s in shingle_sets(Words(data, at, lower=True), k):
                if len(s) and (c := set_id(s)) not in known:  # equal sets count once
                    known[c] = smallest(s, late, percent)
            stop = np.cumsum([len(x) for x in known.values()], dtype=np.int64)
            total = int(stop[-1]) if len(stop) else 0
            yield b"".join(known), np.concatenate(([0], stop[:-1])) if total else stop, np.arange(total), np.concatenate(list(known.values())) if total else np.zeros(0, U), None

    only = docs.select(docs[text].cast("string").alias("text"))
    met, _, found = meeting(only, tokens, slice_count(text_bytes(only), slice_bytes), scratch)
    out = scratch.save(met.select(F.col("name").alias("c"), F.col("key").alias("t")).dropDuplicates(["c"]), "tokens")
    scratch.drop(found)
    return out


def shingle_classes(docs: DataFrame, text: str = "text", k: int = 5) -> DataFrame:
    """``docs`` with: n (set size), c (16 bytes naming the set, null where empty), bits (of the set, null where empty).

    Every column of ``docs`` stays except one called like these. A null text is an empty one.
    """
    keep = [f for f in docs.schema.fields if f.name not in ("n", "c", "bits")]
    place = [f.name for f in keep].index(text) if text in [f.name for f in keep] else None
    if place is None:
        raise ValueError(f"no column {text}")

    def classes(batches):
        for batch in batches:
            for i, j, data, at in chunks(batch.column(place)):
                sets = list(shingle_sets(Words(data, at, lower=True), k))
                n = [len(s) for s in sets]
                c = [set_id(s) if len(s) else None for s in sets]
                bit = [parity_bits(s) if len(s) else None for s in sets]
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column(x) for x in range(len(keep))] + [pa.array(n, pa.int64()), pa.array(c, pa.binary()), pa.array(bit, pa.binary())], [f.name for f in keep] + ["n", "c", "bits"])

    from pyspark.sql.types import StructType, _parse_datatype_string

    extra = _parse_datatype_string("n bigint, c binary, bits binary")
    return docs.select(*[f.name for f in keep]).mapInArrow(freed(classes), StructType(keep + extra.fields))


def _sets_of(docs: DataFrame, clusters: DataFrame, k: int, bits: int = 26) -> DataFrame:
    """(c, n, bits, sets) of the texts whose c is in ``clusters``, and of some others; from the texts again, so that no sets
    are kept of those that share nothing."""

    def keys(batches):
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8")[::2].astype(U)
            got = list(BitIndex.sliced(key))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], ["slice", "keys"])

    index = BitIndex.built(clusters.select("c").mapInArrow(keys, "slice int, keys binary"), bits, twice=False)
    shared = docs.sparkSession.sparkContext.broadcast(index.words.tobytes())

    def run(batches):
        wanted = BitIndex(bits, np.frombuffer(shared.value, U))
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                got = [(set_id(s), s) for s in shingle_sets(Words(data, at, lower=True), k) if len(s)]
                if not got:
                    continue
                hit = wanted.has(np.frombuffer(b"".join(c for c, _ in got), ">u8")[::2].astype(U))
                got = [x for x, h in zip(got, hit.tolist(), strict=True) if h]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.binary()), pa.array([len(s) for _, s in got], pa.int64()), pa.array([parity_bits(s) for _, s in got], pa.binary()), pa.array([s.tobytes() for _, s in got], pa.binary())], ["c", "n", "bits", "sets"])

    return docs.select(docs["text"]).mapInArrow(freed(run), "c binary, n bigint, bits binary, sets binary")


def near_links(docs: DataFrame, classes: DataFrame, k: int = 5, percent: int = 80, tile_rows: int = 2048, block_rows: int = 512, scratch: Scratch | None = None, slice_bytes: int | None = None) -> DataFrame:
    """(u, v): a spanning forest of all exact links between the sets of :func:`shingle_classes` of ``docs`` (text)."""
    scratch = scratch or Scratch(classes.sparkSession, "jaccard")
    tokens = shared_tokens(docs, "text", k, percent, scratch, slice_bytes)
    one = classes.where("c is not null").groupBy("c").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    one = scratch.save(tokens.join(one, "c"), "sharing")
    rows = one.select(F.explode("t").alias("t"), "c", "n", "bits")
    # Shingles of more texts than a tile takes; written, so that Catalyst knows its size and may broadcast it.
    common = scratch.save(one.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("m")).where(F.col("m") > tile_rows), "common")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = rows.join(common, "t", "left_anti").repartition(n, "t").sortWithinPartitions("t").mapInArrow(lambda b: near_pairs(b, percent), "u binary, v binary")
    roles = rows.join(common.select("t"), "t").withColumn("role", F.explode(F.array(F.lit(0), F.lit(1))))
    roles = roles.withColumn("band", F.floor(F.log("n") / float(np.log(BAND * 100 / percent))).cast("int") - F.col("role"))
    many = _in_tiles(_tiled(roles, tile_rows, ["c", "n", "bits", "role"]), _links(percent, True, False))
    maybe = scratch.save(few.union(many).distinct(), "maybe")
    clusters = connected_components(maybe, scratch).select(F.col("node").alias("c"), F.xxhash64("root").alias("t"))
    sets = _sets_of(docs, clusters, k).join(clusters, "c").groupBy("c", "t").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sets").alias("sets")).withColumn("band", F.lit(0))
    sets = scratch.save(sets, "clusters")
    return _in_tiles(_tiled(sets, block_rows, ["c", "n", "bits", "sets"]), _links(percent, False, True))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    component_id is the smallest doc_id that links reach, the row's own for a text without words. Rows with a null doc_id get
    the component's smallest id too, null where no row of it has one. Repeated rows each have a result row. An empty table
    gives none. A text of any length is taken whole. Further columns take no part.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    only = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    classes = scratch.save(shingle_classes(only, "text", k).drop("text"), "classes")
    roots = connected_components(scratch.save(near_links(only, classes, k, percent, scratch=scratch), "links"), scratch)
    ids = classes.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    of = ids.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = of.groupBy("root").agg(F.min("least").alias("component"))
    named = of.join(least, "root").select("c", "component")
    return classes.select("doc_id", F.col("n").alias("n_shingles"), "c").join(named, "c", "left").select("doc_id", "n_shingles", F.coalesce("component", F.when(F.col("c").isNull(), F.col("doc_id"))).alias("component_id"))


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, less those whose component has a smaller id: one document of each component stays.

    Rows that share an id count as one document, of which the row with the smallest text hash stays. Rows without an id stay,
    as nothing tells them apart. Texts without words link nothing and stay.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    of = scratch.save(near_components(docs, doc_id, text, k, percent, scratch).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("rows")), "components")
    copies = scratch.save(of.where("least < doc_id").select(F.col("doc_id").alias("__copy")), "copies")
    kept = docs.join(copies, docs[doc_id] == copies["__copy"], "left_anti")
    again = scratch.save(of.where("rows > 1 and least = doc_id").select(F.col("doc_id").alias("__again")), "again")
    if not again.take(1):
        return kept
    once = kept.join(again, kept[doc_id] == again["__again"], "left_anti")
    row = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.xxhash64(text)))
    return once.unionByName(kept.join(again, kept[doc_id] == again["__again"], "left_semi").withColumn("__row", row).where("__row = 1").drop("__row"))
