"""Phrase collocations by vertical lists of positions (operator 13).

Everything is per language. Texts are cut into pieces and those into words; chunks of some megabytes of text number their words,
skipping a number between pieces, so that neighbours in one piece are neighbours in number and others are not. A chunk holds,
for each phrase, the ascending list of the places where it occurs: inverted lists, split by ranges of places over the corpus.

A phrase grows by one word when its list is merged with that of the phrase that begins a place later and ends in the word beside
it; the merged list is where the longer phrase occurs, and its length counts the occurrences exactly. Only phrases that
are frequent in the whole corpus grow: a chunk sends each list's length once, by hash of the phrase into slices; a slice adds
them up and answers each chunk which of its phrases are frequent and how often they occur in all. So phrases of common words
cost a row a chunk, however often they occur, and nothing about phrases is ever broadcast or collected.

The first chunk that has a phrase names it: a word by its letters, a longer phrase by those that it begins and ends with. Joins of
these names, a row for each frequent phrase, give what scores need.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._numeric import U, Words, mix, pair, ranges, texts
from ._store import MOST_PARTITIONS, Scratch, freed

CHUNK_BYTES = 1 << 20
#: A-Z in lower case, all that ends a piece as a line feed.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[ord(c) for c in ".,;:!?\x0b\x0c\r"]] = 10

TEXTS = pa.schema([("chunk", pa.int64()), ("data", pa.binary()), ("at", pa.binary()), ("lang_of", pa.binary()), ("langs", pa.list_(pa.string()))])
SENT = pa.schema([("slice", pa.int32()), ("chunk", pa.int64()), ("key", pa.binary()), ("n", pa.binary())])
RETURNED = pa.schema([("chunk", pa.int64()), ("slice", pa.int32()), ("some", pa.binary()), ("total", pa.binary()), ("first", pa.binary())])
#: kind 0: the lists of a chunk; 1: a phrase that it names; 2: the words of a language in it.
FOUND = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("lists", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("key", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("a", pa.int64())])
_SPARK = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.string()): "array<string>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_SPARK[f.type]}" for f in schema)


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _whole(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, of which most are small where ``x`` mostly ascends; they wrap around elsewhere."""
    return np.diff(x, prepend=x.dtype.type(0))


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    head = json.dumps({k: [a.dtype.str, a.shape] for k, a in arrays.items()}).encode()
    return _squeezed(b"".join([len(head).to_bytes(4, "little"), head, *[np.ascontiguousarray(a).tobytes() for a in arrays.values()]]))


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    data = _whole(data)
    at = 4 + int.from_bytes(data[:4], "little")
    out = {}
    for k, (kind, shape) in json.loads(data[4:at]).items():
        n = int(np.prod(shape))
        out[k] = np.frombuffer(data, kind, n, at).reshape(shape)
        at += out[k].nbytes
    return out


def part(k: int, words: int, start: int) -> int:
    """The column of the part of ``words`` words from ``start`` on, among the parts of a phrase of k words."""
    return sum(k - n + 1 for n in range(1, words)) + start


class Lists:
    """The phrases of a chunk by key, the lengths of their lists, and the places, list by list."""

    def __init__(self, key: np.ndarray, length: np.ndarray, place: np.ndarray):
        self.key, self.length, self.place = key, length, place

    @classmethod
    def read(cls, data: bytes) -> Lists:
        x = _unpacked(data)
        return cls(np.cumsum(x["key"], dtype=U), x["length"], np.cumsum(x["place"], dtype=np.uint32))

    def packed(self) -> bytes:
        return _packed({"key": _steps(self.key), "length": self.length.astype("<u4"), "place": _steps(self.place.astype("<u4"))})

    def some(self, numbers: np.ndarray) -> Lists:
        start = np.cumsum(self.length) - self.length
        return Lists(self.key[numbers], self.length[numbers], self.place[ranges(start[numbers], self.length[numbers])])


def _grouped(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, ascending; the first of each in ``key``; lengths of their lists; the places, list by list)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], order[first], np.diff(np.append(first, len(key))), place[order]


class Candidates(Lists):
    """Phrases of one word more than those of a chunk's lists, and the keys of what each begins and ends with."""

    def __init__(self, lists: Lists):
        number = np.repeat(np.arange(len(lists.length)), lists.length)
        order = np.argsort(lists.place, kind="stable")
        place, number = lists.place[order], number[order]
        meet = np.flatnonzero(place[1:] == place[:-1] + 1)  # at a place begins one phrase of a length
        left, right = lists.key[number[meet]], lists.key[number[meet + 1]]
        key, first, length, place = _grouped(pair(left, right), place[meet])
        super().__init__(key, length, place)
        self.left, self.right = left[first], right[first]

    def named(self, i: int) -> dict:
        return {"left": int(self.left[i].view(np.int64)), "right": int(self.right[i].view(np.int64))}


class WordCandidates(Lists):
    """The words of a chunk of texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lang_of: np.ndarray, langs: list[str]):
        data = _PLAIN[data]
        words = Words(data, at)
        self.langs, self.data = langs, data
        cuts = np.cumsum(data == 10)
        text_of = np.repeat(np.arange(len(words.count)), words.count)
        apart = np.zeros(len(text_of), bool)
        apart[1:] = (text_of[1:] != text_of[:-1]) | (cuts[words.start[1:]] != cuts[words.end[:-1] - 1])
        place = (np.arange(len(text_of)) + np.cumsum(apart)).astype("<u4")
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], U)
        of = lang_of[text_of]
        self.counts = np.bincount(of, minlength=len(langs))
        key, first, length, place = _grouped(mix(words.hashes() ^ seeds[of]) if len(of) else np.zeros(0, U), place)
        super().__init__(key, length, place)
        self.start, self.end, self.lang_of = words.start[first], words.end[first], of[first]

    def named(self, i: int) -> dict:
        return {"lang": self.langs[self.lang_of[i]], "word": self.data[self.start[i] : self.end[i]].tobytes().decode()}


def _segments(data: np.ndarray, most: int) -> list[int]:
    """Ends of the parts of a text, each of about ``most`` bytes, that end where a piece ends."""
    out, at = [], 0
    if len(data) > most:
        cut = np.flatnonzero(_PLAIN[data] == 10) + 1
        while len(data) - at > most and len(cut):
            i = int(np.searchsorted(cut, at + most, "right"))
            i = i - 1 if i and cut[i - 1] > at else i
            if i == len(cut):
                break
            at = int(cut[i])
            out.append(at)
    return out if out and out[-1] == len(data) else [*out, len(data)]


def chunked(docs: DataFrame, text: str, lang: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of whole texts, or of whole pieces of a text that is longer than a chunk."""
    only = docs.select(docs[text].cast("string").alias("text"), F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"))

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        parts, sizes, names, size = [], [], [], 0

        def out():
            langs = sorted(set(names))
            number = {x: i for i, x in enumerate(langs)}
            row = (chunk, np.concatenate(parts).tobytes(), np.concatenate(([0], np.cumsum(sizes))).astype("<i8").tobytes(), np.array([number[x] for x in names], "<u4").tobytes(), langs)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, TEXTS, strict=True)], schema=TEXTS)

        for batch in batches:
            data, at = texts(batch.column(0))
            at = at.tolist()
            for i, name in enumerate(batch.column(1).to_pylist()):
                low = at[i]
                for end in _segments(data[low : at[i + 1]], chunk_bytes):
                    end += at[i]
                    parts.append(data[low:end].copy())
                    sizes.append(end - low)
                    names.append(name)
                    size += end - low + 16
                    low = end
                    if size >= chunk_bytes:
                        yield out()
                        parts, sizes, names, size, chunk = [], [], [], 0, chunk + 1
        if parts:
            yield out()

    return only.mapInArrow(freed(run), _ddl(TEXTS))


def _candidates(row: dict, k: int):
    if k == 1:
        return WordCandidates(np.frombuffer(row["data"], np.uint8), np.frombuffer(row["at"], "<i8"), np.frombuffer(row["lang_of"], "<u4"), row["langs"])
    return Candidates(Lists.read(row["lists"]))


def _rows(batch: pa.RecordBatch):
    """One row at a time: rows are large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _edges(key: np.ndarray, slices: int) -> np.ndarray:
    """Where the keys of each slice begin, and where the last ends."""
    return np.append(np.searchsorted(key, np.array([-(-(i << 64) // slices) for i in range(slices)], U)), len(key))


def _sent(k: int, slices: int):
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                c = _candidates(row, k)
                edge = _edges(c.key, slices).tolist()
                rows = [(s, row["chunk"], _squeezed(_steps(c.key[a:b]).tobytes()), _squeezed(c.length[a:b].astype("<u4").tobytes())) for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, SENT, strict=True)], schema=SENT)

    return run


def _summed(least: int):
    """Over rows of SENT sorted by slice and chunk: to each chunk, which of its keys reach ``least`` in all."""

    def settled(slice_no, rows):
        keys = [np.cumsum(np.frombuffer(_whole(r[1]), U), dtype=U) for r in rows]
        size, key = [len(x) for x in keys], np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        sums = np.add.reduceat(np.frombuffer(b"".join(_whole(r[2]) for r in rows), "<u4")[order].astype(np.int64), first)
        total, leads = np.empty(len(key), np.int64), np.zeros(len(key), bool)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(key))))
        leads[order[first]] = True
        enough, out, at = total >= least, [], 0
        for (chunk, _, _), n in zip(rows, size, strict=True):
            some = enough[at : at + n]
            if some.any():
                out.append((chunk, slice_no, np.packbits(some).tobytes(), total[at : at + n][some].tobytes(), np.packbits(leads[at : at + n][some]).tobytes()))
            at += n
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(RETURNED)], schema=RETURNED)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for s, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and s != now:
                    yield settled(now, held)
                    held = []
                now = s
                held.append(rest)
        if held:
            yield settled(now, held)

    return run


def _grown(k: int, slices: int, last: bool):
    """Over chunks and what was returned to them: their lists of phrases of k words, and the phrases that they name."""

    def settled(row, returned):
        c = _candidates(row, k)
        edge = _edges(c.key, slices)
        some, total, leads = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for r in sorted(returned, key=lambda r: r["slice"]):
            a, b = int(edge[r["slice"]]), int(edge[r["slice"] + 1])
            some.append(a + np.flatnonzero(np.unpackbits(np.frombuffer(r["some"], np.uint8), count=b - a)))
            total.append(np.frombuffer(r["total"], "<i8"))
            leads.append(np.unpackbits(np.frombuffer(r["first"], np.uint8), count=len(some[-1])).astype(bool))
        some, leads = np.concatenate(some), np.concatenate(leads)
        out = [{"kind": 1, "key": int(c.key[i].view(np.int64)), "a": n, **c.named(i)} for i, n in zip(some[leads].tolist(), np.concatenate(total)[leads].tolist(), strict=True)]
        if k == 1:
            out += [{"kind": 2, "lang": x, "a": n} for x, n in zip(c.langs, c.counts.tolist(), strict=True)]
        if not last and len(some):
            lists = c.some(some)
            out.append({"kind": 0, "chunk": row["chunk"], "a": len(lists.place), "lists": lists.packed()})
        return pa.RecordBatch.from_pylist(out, schema=FOUND)

    def run(batches):
        row, held = None, []
        for batch in batches:
            for r in _rows(batch):
                if r["slice"] is not None:
                    held.append(r)
                    continue
                if row:
                    yield settled(row, held)
                row, held = r, []
        if row:
            yield settled(row, held)

    return run


def frequent(docs: DataFrame, scratch: Scratch, text: str, lang: str, least: int, most_words: int, chunk_bytes: int, slice_keys: int) -> list[DataFrame]:
    """By number of words, from 1 on: (kind, lang, word, key, left, right, a), kinds 1 and 2 of FOUND."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = state = scratch.save(chunked(docs, text, lang, chunk_bytes), "texts")
    # An upper bound of the places of a chunk's lists, and so of what it sends.
    places = F.octet_length("data") / 4
    found = []
    for k in range(1, most_words + 1):
        slices = max(parts, 4, -(-int(state.agg(F.sum(places)).first()[0] or 0) // slice_keys))
        sent = state.mapInArrow(freed(_sent(k, slices)), _ddl(SENT)).repartition(max(parts, min(slices, MOST_PARTITIONS)), "slice").sortWithinPartitions("slice", "chunk")
        returned = sent.mapInArrow(freed(_summed(least)), _ddl(RETURNED))
        both = state.withColumn("slice", F.lit(None).cast("int")).unionByName(returned, allowMissingColumns=True).repartition(parts, "chunk").sortWithinPartitions("chunk", F.asc_nulls_first("slice"))
        grown = scratch.save(both.mapInArrow(freed(_grown(k, slices, k == most_words)), _ddl(FOUND)), f"words{k}")
        scratch.drop(lists)
        # What is named is small; the lists go as soon as the next ones are there.
        found.append(scratch.save(grown.where("kind > 0").drop("lists", "chunk"), f"found{k}"))
        lists, state, places = grown, grown.where("kind = 0").select("chunk", "lists", F.col("a").alias("places")), F.col("places")
    scratch.drop(lists)
    return found


def candidates(found: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(lang, phrase, key, a, l, r, inner) of each frequent phrase of 2 words or more.

    l and r are the frequencies of its two parts by cut, ``inner`` the keys of the shorter phrases of 2 words or more in it.
    """
    now, out = found[0].where("kind = 1").select("key", "lang", F.array("word").alias("words"), F.array("key").alias("keys"), F.array("a").alias("sums")), []
    for k, level in enumerate(found[1:], 2):
        x, y = now.alias("x"), now.alias("y")
        rows = level.where("kind = 1").alias("f").join(x, F.col("f.left") == F.col("x.key")).join(y, F.col("f.right") == F.col("y.key"))

        def parts(name: str, own: str) -> Column:
            side = lambda n, s: F.col(f"x.{name}")[part(k - 1, n, s)] if s < k - n else F.col(f"y.{name}")[part(k - 1, n, s - 1)]
            return F.array(*[side(n, s) for n in range(1, k) for s in range(k - n + 1)], F.col(f"f.{own}")).alias(name)

        rows = rows.select("f.key", "x.lang", F.concat("x.words", F.slice("y.words", -1, 1)).alias("words"), parts("keys", "key"), parts("sums", "a"))
        now = scratch.save(rows, f"phrases{k}")
        inner = [part(k, n, s) for n in range(2, k) for s in range(k - n + 1)]
        pick = lambda name, at: F.array(*[F.col(name)[i] for i in at]).cast("array<bigint>").alias
        out.append(now.select("lang", F.array_join("words", " ").alias("phrase"), "key", F.col("sums")[part(k, k, 0)].alias("a"), pick("sums", [part(k, j, 0) for j in range(1, k)])("l"), pick("sums", [part(k, k - j, j) for j in range(1, k)])("r"), pick("keys", inner)("inner")))
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0]


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, most_words: int = 4, top: int = 2000, inside_percent: int = 80, spread: int = 64, chunk_bytes: int = CHUNK_BYTES, slice_keys: int = 1_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, then frequency, then phrase.

    A null or empty text has no words; a null language is ``und``. Repeated rows count as often as they are there. Ties go by the
    bytes of the phrase, so no two ranks are left to chance. An empty table, and one without frequent phrases, gives an empty
    result; further columns take no part. A text longer than a chunk is cut where a piece ends, which no phrase crosses.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    levels = frequent(docs, scratch, text, lang, least, most_words, chunk_bytes, slice_keys)
    found, words = candidates(levels, scratch), levels[0].where("kind = 2").groupBy("lang").agg(F.sum("a").alias("n"))
    inside = found.select(F.explode("inner").alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    left = found.drop("inner").join(inside, "key", "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * inside_percent))
    cuts = F.transform(F.sequence(F.lit(1), F.size("l")), lambda k: F.struct(F.expr("2000000 * cast(a as decimal(20,0))").alias("up"), (F.element_at("l", k).cast("decimal(20,0)") + F.element_at("r", k).cast("decimal(20,0)")).alias("down"), k.alias("k")))
    scores = left.withColumn("cut", F.array_min(F.transform(cuts, lambda c: F.struct(F.call_function("div", c["up"], c["down"]).alias("score"), c["k"].alias("k")))))
    rows = scores.select("lang", "phrase", "a", F.element_at("l", F.col("cut.k")).alias("l"), F.element_at("r", F.col("cut.k")).alias("r"), F.col("cut.score").cast("bigint").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of each share of a language's phrases, so that no task takes more than ``spread * top`` rows.
    rows = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(spread)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
