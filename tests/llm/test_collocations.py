"""Collocations against a plain version of themselves."""

import random
import re
from collections import Counter

import pytest

from timeloom.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, phrase string, key bigint, a string, n string, rank string, slice string, chunk string"


def brute(rows, least=30, top=2000, inside_percent=80):
    per = {}
    for text, lang in rows:
        counts, total = per.setdefault("und" if lang is None else lang, (Counter(), []))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total.append(len(w))
            counts.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, (f, total) in per.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rows = []
        for p, a in found.items():
            if p not in inside or 100 * inside[p] < inside_percent * a:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((" ".join(p), a, f[p[:k]], f[p[k:]], sum(total), score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


def make_rows():
    rng = random.Random(13)
    vocab = ["New", "york", "of", "the", "é", "漢字", "\U00010000x", "￿x", "a\x00b", "don't", "x"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " "]) for _ in range(n))
    rows = [(say(rng.randint(0, 120)), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    rows += [(None, "en"), ("", "fr"), (" .,\n", "it"), ("new York of the " * 200, "en"), ("x" * 100_000, "en"), ("a a a a a a " * 40, "xx")]
    rows.append((say(30_000) * 12, "long"))  # beyond a megabyte
    return rows + [rows[0]] * 40


ROWS = make_rows()


def frame(spark, rows):
    return spark.createDataFrame([(1, t, g, "p", 5, "a", "n", "r", "s", "c") for t, g in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("options", [{}, {"top": 7}, {"chunk_bytes": 5000, "slice_keys": 100, "spread": 3}, {"least": 1, "top": 300}])
def test_collocations(spark, options):
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, ROWS), **options).collect())
    assert got == brute(ROWS, options.get("least", 30), options.get("top", 2000))


def test_empty_tables(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(None, None), ("a b c", "en")])).collect() == []


def test_exact_scores(spark):
    """Products beyond 64 bits, and a floor that doubles would get wrong."""
    from pyspark.sql import functions as F

    a, l, r = 9_000_000_000_000_001, 9_000_000_000_000_007, 9_000_000_000_000_003
    found = spark.createDataFrame([(a, l, r)], "a bigint, l bigint, r bigint")
    got = found.select(F.call_function("div", F.expr("2000000 * cast(a as decimal(20,0))"), F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)"))).first()[0]
    assert got == 2_000_000 * a // (l + r)
    assert 2_000_000 * a > 1 << 63


def test_segments_end_with_pieces():
    import numpy as np

    data = np.frombuffer(b"aaaa bbbb. cccc, dd " * 50 + b"e" * 300, np.uint8)
    ends = collocations._segments(data, 64)
    assert ends[-1] == len(data) and all(data[e - 1] in b".," for e in ends[:-1]) and max(np.diff([0, *ends])) <= 64 + 300
