"""Importance resampling against a plain version of itself."""

import hashlib
import math
import random
import re
import zlib

import pytest

from timeloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, weight string, score string, n_words string, rank string, bucket string, __row string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def make_rows():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcXYZé0ß漢", k=rng.randint(1, 9))) for _ in range(60)]
    texts = [None, "", " .,- ", "one", "Two words", "a`b_c{d}e\x00f", "x" * 70_000 + " " + "y" * 66_000 + " tail"]
    texts += [" ".join(rng.choices(vocab, k=n)) for n in (19, 20, 21)] + [rng.choice(". -\n").join(rng.choices(vocab, k=rng.randint(0, 200))) for _ in range(90)]
    texts.append(" ".join(rng.choices(vocab, k=260_000)))  # beyond a megabyte
    rows = list(enumerate(texts))
    return rows + [rows[20], rows[20], (30, texts[31]), (None, texts[40]), (None, texts[40]), (None, None)]


ROWS = make_rows()
TARGET = ["Two words of the test", "abc XYZ abc", None, "", ROWS[15][1]]


def brute(rows, target, percent=5):
    def found(text):
        w = WORD.findall(lower(text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    sets = [found(t) for _, t in rows]
    s, t = [0] * 10_000, [0] * 10_000
    for _, b in sets:
        for x in b:
            s[x] += 1
    for text in target:
        for x in found(text)[1]:
            t[x] += 1
    total_s, total_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (total_s + 10_000) / ((s[i] + 1) * (total_t + 10_000)))) for i in range(10_000)] if rows else []
    out, eligible = [], []
    for (doc, _), (words, b) in zip(rows, sets, strict=True):
        weight = sum(gain[x] for x in b)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        row = [doc, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if words >= 20:
            eligible.append(row)
    eligible.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for i, row in enumerate(eligible[: percent * len(eligible) // 100]):
        row[4] = i + 1
    return [tuple(r) for r in out]


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resampling(spark, percent):
    docs = spark.createDataFrame([(i, t, "w", "s", "n", "r", "b", "x") for i, t in ROWS], SCHEMA).repartition(5)
    target = spark.createDataFrame([(t, "i") for t in TARGET], "text string, doc_id string")
    got = [tuple(r) for r in importance.resampling(docs, target, percent=percent).collect()]
    assert sorted(got, key=repr) == sorted(brute(ROWS, TARGET, percent), key=repr)


def test_drawn_rows(spark):
    docs = spark.createDataFrame([(i, t, "w", "s", "n", "r", "b", "x") for i, t in ROWS], SCHEMA)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resampled(docs, target, percent=30)
    drawn = {r[0] for r in brute(ROWS, TARGET, 30) if r[4]}
    assert got.columns == docs.columns and sorted([r.doc_id for r in got.collect()], key=repr) == sorted([i for i, _ in ROWS if i in drawn], key=repr)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "some words " * 20)], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, text string")
    assert importance.resampling(none, docs).collect() == []
    assert [tuple(r) for r in importance.resampling(docs, none, percent=100).collect()] == brute([(1, "some words " * 20)], [], 100)


def test_whole_weights_of_long_words():
    """Words finished one by one give what the automaton gives."""
    import numpy as np
    import pyarrow as pa

    from timeloom.llm._numeric import chunks

    for _, _, data, at in chunks(pa.array(["é" * 40_000 + " " + "b" * 12 + " c"])):
        _, found = importance.features(data, at, 10_000)
    words = ["é" * 40_000, "b" * 12, "c"]
    for n, (_, bucket) in enumerate(found, 1):
        assert np.array_equal(bucket, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for i in range(4 - n)])
