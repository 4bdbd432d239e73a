"""Each operator against a plain version of itself, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timeloom.llm import block_anchors, chat_format, contamination, jaccard_join, lm_score, mixing, repair_tokens, rp_forest, suffix_dedup, toxicity
from timeloom.llm import _repeats
from timeloom.llm._store import Scratch
from timeloom.llm.components import connected_components
from timeloom.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, lang string, n bigint, c binary, d string, h string, bits int, tokens string, size string, entry string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def make_rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    base, passage = say(150), say(45)
    texts = [None, "", " \n\t ", "One", "one", "two words", "a b c d", "a b c d e", base, base, base.upper()]
    for _ in range(8):  # near copies
        w = base.split()
        for i in rng.sample(range(len(w)), 2):
            w[i] = "new" + str(i)
        texts.append(" ".join(w))
    texts += [say(rng.randint(5, 60)) + "\n" + passage + " " + say(rng.randint(0, 60)) for _ in range(8)]
    texts += [say(rng.randint(1, 90)) for _ in range(12)] + [say(4000) + " " + passage, "x" * 3000, "ab " * 200, passage]
    rows = [(i, t, [None, "s1", "s2", "\U00010000", "é"][i % 5]) for i, t in enumerate(texts)]
    rows += [rows[8], (3, "another text of the same id " + passage, "s1"), (None, "no id " + passage, "s2"), (None, None, None)]
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "x", 7, b"c", "d", "h", 1, "t", "s", "e") for i, t, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, *_) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return [(doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, *_) in enumerate(rows)]


def key(rows):
    return sorted(rows, key=repr)


def test_near_components(docs, none):
    got = [tuple(r) for r in jaccard_join.near_components(docs).collect()]
    assert key(got) == key(brute_components(ROWS))
    assert jaccard_join.near_components(none).collect() == []


def test_common_shingles_meet_in_blocks(spark, docs):
    """The path for shingles of more texts than a tile takes."""
    scratch = Scratch(spark, "test")
    only = docs.where("doc_id is not null and text not like 'another text%'").select("doc_id", "text")
    classes = scratch.save(jaccard_join.shingle_classes(only).drop("text"), "classes")
    links = jaccard_join.near_links(only, classes, tile_rows=3, block_rows=2, scratch=scratch, slice_bytes=3000)
    roots = {bytes(r.node): bytes(r.root) for r in connected_components(links, scratch).collect()}
    rows = [r for r in classes.collect() if r.c is not None]
    got, want = {}, {}
    for r in rows:
        got.setdefault(roots.get(bytes(r.c), bytes(r.c)), []).append(repr(r.doc_id))
    for doc, n, least in brute_components([r for r in ROWS if r[0] is not None and not (r[1] or "").startswith("another text")]):
        if n:
            want.setdefault(least, []).append(repr(doc))
    assert sorted(sorted(x) for x in got.values()) == sorted(sorted(x) for x in want.values())


def test_one_of_each_component_stays(docs, none):
    got = jaccard_join.without_near_copies(docs)
    want = {doc for doc, n, least in brute_components(ROWS) if doc is not None and least == doc}
    ids = [r.doc_id for r in got.collect()]
    assert got.columns == docs.columns and set(ids) - {None} == want and Counter(i for i in ids if i is not None).most_common(1)[0][1] == 1
    assert jaccard_join.without_near_copies(none).collect() == []


def test_components_in_rounds(spark):
    rng = random.Random(1)
    names = [rng.randbytes(16) for _ in range(200)]
    edges = [tuple(sorted(rng.sample(names, 2))) for _ in range(140)] + [tuple(sorted(names[i : i + 2])) for i in range(20)]
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges for x in e}
    frame = spark.createDataFrame(edges, "u binary, v binary").repartition(8)
    for size in (10**6, 20):
        got = connected_components(frame, Scratch(spark, "test"), task_links=size).collect()
        assert {bytes(r.node): bytes(r.root) for r in got} == want and len(got) == len(want)


def covered(sequences, width):
    n = Counter(tuple(s[i : i + width]) if isinstance(s, list) else s[i : i + width] for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        mark = bytearray(len(s))
        for i in range(len(s) - width + 1):
            if n[tuple(s[i : i + width]) if isinstance(s, list) else s[i : i + width]] > 1:
                mark[i : i + width] = b"\1" * width
        out.append(mark)
    return out


@pytest.mark.parametrize("most", [40_000, 2])
def test_repeated_words(docs, none, monkeypatch, most):
    plain = _repeats.repeated_intervals
    monkeypatch.setattr(block_anchors, "repeated_intervals", lambda *a, **k: plain(*a, **k, batch_rows=7))
    words = [WORD.findall(t or "") for _, t, *_ in ROWS]
    want = []
    for (doc, *_), w, mark in zip(ROWS, words, covered(words, 35), strict=True):
        want.append((doc, len(w), sum(mark), " ".join(x for x, m in zip(w, mark, strict=True) if not m)))
    got = [tuple(r) for r in block_anchors.without_repeats(docs, most=most, slice_bytes=3000).collect()]
    assert key(got) == key(want) and sum(r[2] for r in got) > 500
    assert block_anchors.without_repeats(none, most=most).collect() == []


@pytest.mark.parametrize("most", [40_000, 2])
def test_repeated_bytes(docs, none, monkeypatch, most):
    plain = _repeats.repeated_intervals
    monkeypatch.setattr(suffix_dedup, "repeated_intervals", lambda *a, **k: plain(*a, **k, batch_rows=7))
    data = [(t or "").encode() for _, t, *_ in ROWS]
    want = []
    for (doc, *_), x, mark in zip(ROWS, data, covered(data, 200), strict=True):
        want.append((doc, len(x), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(bytes(b for b, m in zip(x, mark, strict=True) if not m)).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.without_repeats(docs, most=most, slice_bytes=3000, digest=True).collect()]
    assert key(got) == key(want) and sum(r[2] for r in got) > 3000
    assert suffix_dedup.without_repeats(none, most=most).collect() == []


def test_contained_items(spark, docs, none):
    base = ROWS[8][1].split()
    items = [(1, " ".join(base[10:40])), (2, " ".join(base[10:30] + ["q", "r"])), (3, "A B c"), (4, None), (5, ""), (6, "nowhere at all to be found here"), (1, " ".join(base[10:40])), (None, ROWS[-3][1])]
    frame = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string")
    want = []
    for item, text in items:
        w = WORD.findall(lower(text or ""))
        k = min(5, len(w))
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for doc, t, *_ in ROWS:
            own = WORD.findall(lower(t or ""))
            shared = len(s & {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}) if s else 0
            if s and 100 * shared >= 80 * len(s):
                want.append((doc, item, len(s), shared))
    for block in (8 << 20, 200):
        got = [tuple(r) for r in contamination.contained_items(docs, frame, block_bytes=block).collect()]
        assert key(got) == key(want) and len(want) > 10
    clean = contamination.decontaminated(docs, frame)
    hit = Counter((d, t) for d, t, *_ in ROWS if any(w[0] == d for w in want))
    assert clean.columns == docs.columns and clean.count() == len([1 for d, t, *_ in ROWS if not _contains(t, items)])
    assert hit and contamination.contained_items(none, frame).collect() == [] and contamination.contained_items(docs, frame.limit(0)).collect() == []


def _contains(text, items):
    own = WORD.findall(lower(text or ""))
    for _, t in items:
        w = WORD.findall(lower(t or ""))
        k = min(5, len(w))
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        if s and 100 * len(s & {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}) >= 80 * len(s):
            return True
    return False


def test_apportion():
    rng = random.Random(3)
    for _ in range(200):
        votes = [rng.choice([0, rng.random() * 100, 5.0, 5.0]) for _ in range(rng.randint(1, 9))]
        most = [rng.randint(0, 30) for _ in votes]
        seats = rng.randint(0, 60)
        got = [0] * len(votes)
        for _ in range(seats):
            free = [i for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
            if not free:
                break
            got[min(free, key=lambda i: (-votes[i] / (2 * got[i] + 1), i))] += 1
        assert mixing.apportion(np.array(votes), seats, np.array(most)).tolist() == got


def test_mixture(docs, none):
    rows = [tuple(r) for r in mixing.mixture(docs, shard_docs=4).collect()]
    assert sorted((r[0] is None, r[0], r[1]) for r in rows if r[0] is not None) == sorted((False, d, len(WORD.findall(t or ""))) for d, t, *_ in ROWS if d is not None) and len(rows) == len(ROWS)
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([sizes[s] for s in order], [5, 2, 1, 5, 2][: len(order)])
    assert abs(sum(goal) - 1.5 * sum(sizes.values())) < 1e-6
    by = {}
    for _, size, source_size, target, taken in rows:
        assert 0 <= taken <= 2 * size
        by.setdefault((source_size, target), []).append(taken)
    assert sorted(by) == sorted(zip([sizes[s] for s in order], goal, strict=True))
    assert all(abs(sum(x) - target) <= 8 for (_, target), x in by.items())
    again = [tuple(r) for r in mixing.mixture(docs.repartition(5), shard_docs=4).collect()]
    assert key(rows) == key(again)
    assert mixing.mixture(none).collect() == [] and mixing.mixed(none).collect() == []
    assert mixing.targets([10, 100], [5, 1], Fraction(3, 2)) == [20.0, 145.0]


def test_mixture_in_bundles(docs):
    """Shards in bundles of two: what sources take stays near their targets, and no more than twice what there is."""
    by = {}
    for _, size, source_size, target, taken in (tuple(r) for r in mixing.mixture(docs, shard_docs=2, bundle=2).collect()):
        assert 0 <= taken <= 2 * size
        by.setdefault((source_size, target), []).append(taken)
    assert len(by) == 5 and all(abs(sum(x) - target) <= 8 for (_, target), x in by.items())


def test_mixed_rows(docs):
    got = mixing.mixed(docs, shard_docs=4)
    taken = {}
    for doc, size, *_, n in mixing.mixture(docs, shard_docs=4).collect():
        taken.setdefault((doc, size), []).append(n / size if size else 0)
    assert got.columns == docs.columns
    count = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in got.collect())
    assert all(abs(count[k] - sum(v)) <= 0.5 * len(v) + 1e-9 or len(v) > 1 for k, v in taken.items())


def test_small_sources(spark):
    """Sources of 1 to 10 words get what their targets say, to a word or two, though no block fits into most of them."""
    rows = [(i, " ".join(["w"] * (1 + i % 10)), f"s{i:03d}") for i in range(300)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(got) == 300 and all(r.taken <= 2 * r.size and abs(r.taken - r.target) <= 2 for r in got)
    assert abs(sum(r.taken for r in got) - sum(r.target for r in got)) < 1
    got = mixing.mixture(spark.createDataFrame([(i, "a b c", f"s{i:03d}") for i in range(300)], "doc_id bigint, text string, source string")).collect()
    assert all(abs(r.taken - r.target) <= 2 and r.taken > 0 for r in got)


def test_mixed_repeated_rows(spark):
    """A hundred rows alike in id and text count one by one, in the mix of words and in that of rows, under any column names."""
    rows = [(5, "a b c d e f g h i j", "few", "x", i) for i in range(100)] + [(i, "w " * 40, "many", "y", i) for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __mix_seeded string, __mix_shard int").repartition(3)
    got, words = mixing.mixed(docs), Counter()
    assert got.columns == docs.columns
    for r in got.collect():
        assert r["__mix_seeded"] in "xy"
        words[r.source] += len(r.text.split())
    of = {d: s for d, _, s, *_ in rows}
    taken, largest = Counter(), {"few": 10, "many": 40}
    for r in mixing.mixture(docs).collect():
        taken[of[r.doc_id]] += r.taken
    assert all(abs(words[s] - taken[s]) <= largest[s] for s in taken) and taken["few"] > 1000


def test_token_blocks(spark, docs, none):
    file = vocabulary()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(file)
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {(d, t): [*plain.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in ROWS}
    got = sorted((tuple(r) for r in repair_tokens.token_digests(docs, file, block_bytes=3000, least=2).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in ordered]
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t, *_ in ROWS for x in [ids[d, t]])
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert repair_tokens.token_digests(none, file).collect() == []


def test_grammar_round_trip():
    rng = np.random.default_rng(0)
    counts = np.array([1, 50, 0 + 1, 3000, 7, 400])
    ids = np.concatenate([rng.integers(0, 6, n) for n in counts]).astype(np.uint16)
    block = repair_tokens.Block(repair_tokens.packed([5, None, 7, 8, 9, -1], ids, counts, 100, rounds=5, pairs=20, least=2))
    assert (block.all() == ids).all() and len(block.symbols) < len(ids) / 2 and block.doc_ids == [5, None, 7, 8, 9, -1]
    at = np.concatenate(([0], np.cumsum(counts)))
    for doc, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        for x, y in ((0, None), (2, 5), (b - a - 1, None), (17, 300), (5, 5)):
            assert block.tokens(doc, x, y) == ids[a:b][x:y].tolist()


def test_word_table():
    table = repair_tokens.WordTable(vocabulary(), most=50)
    from timeloom.llm._numeric import chunks
    import pyarrow as pa

    texts = ["A. b, C.. é. é, x1. 's. it's, don't. ABC,. á. İ. end.", "␂ a␂b ␂␂", "<|endoftext|> x<|startoftext|>y Σς", "", None, "don't 123 a1b2 ..!! ñ " * 5, *[t for _, t, *_ in ROWS]]
    for i, j, data, at in chunks(pa.array(texts), 2000):
        ids, n = table.encode(data, at)
        stop = np.cumsum(n)
        for k in range(i, j):
            assert ids[stop[k - i] - n[k - i] : stop[k - i]].tolist() == [*table.tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 2]


def test_near_links_of_other_sizes(spark):
    """Half of a text under shingles of more than ``tile_rows`` texts is found at 50 percent."""
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(base), *[" ".join(base + [f"v{k}x{i}" for i in range(26)]) for k in range(6)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    scratch = Scratch(spark, "test")
    classes = jaccard_join.shingle_classes(rows).select("doc_id", "c", "n", "bits")
    links = jaccard_join.near_links(rows, scratch.save(classes, "classes"), percent=50, tile_rows=1, block_rows=2, scratch=scratch)
    assert len({(r.u, r.v) for r in links.collect()}) == 6


def test_word_table_case():
    """Reserved ids are found in the text as it is, and letters are composed with marks before their case is lowered."""
    table = repair_tokens.WordTable(vocabulary())
    import pyarrow as pa
    from timeloom.llm._numeric import chunks

    reserved = ["a <|ENDOFTEXT|> b", "x<|EndOfText|>, <|STARTOFTEXT|>. <|endoftext|>", "<|Im_Start|> <A, <|ABC <|"]
    marks = ["H\u0331 J\u030cA. T\u0308, W\u030a xY\u030aZ h\u0331 E\u0301", "\u00c9A, \u0130B. \u212a \u03a3A\u03a3 STRASSE, ABC."]
    texts = [*reserved, *marks, "", None, "ABC abc Abc, ABC."]
    for i, j, data, at in chunks(pa.array(texts)):
        ids, n = table.encode(data, at)
        stop = np.cumsum(n)
        for k in range(i, j):
            assert ids[stop[k - i] - n[k - i] : stop[k - i]].tolist() == [*table.tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 2], texts[k]


def brute_scores(rows, least):
    words = [WORD.findall(lower(t or "")) for _, t, *_ in rows]
    one, two = Counter(w for x in words for w in x), Counter(p for x in words for p in zip(x, x[1:], strict=False))
    total = sum(one.values())
    want = []
    for (doc, *_), x in zip(rows, words, strict=True):
        s = 0.0
        for i, w in enumerate(x):
            if i == 0:
                s += np.log(one[w] / total)
            elif two[x[i - 1], w] >= least:
                s += np.log(two[x[i - 1], w] / one[x[i - 1]])
            else:
                s += np.log(0.4 * one[w] / total)
        want.append((doc, len(x), s if x else None))
    return want


@pytest.mark.parametrize("options", [{}, {"common": 60, "slice_pairs": 100, "most_hot": 20}, {"least": 1, "most_hot": 1}, {"common": 0, "least": 1}, {"common": 200, "least": 3, "slice_pairs": 2000}])
def test_scores(docs, none, options):
    want = brute_scores(ROWS, options.get("least", 2))
    got = [tuple(r) for r in lm_score.scores(docs, **options).collect()]
    assert len(got) == len(want)
    for a, b in zip(key(got), key([(d, n, None if s is None else round(s, 4), None if s is None else round(s / n, 4)) for d, n, s in want]), strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 2e-4 and abs(a[3] - b[3]) < 2e-4)
    assert lm_score.scores(none, **options).collect() == []


@pytest.mark.parametrize("slice_size", [32_768, 8])
def test_nearest(spark, monkeypatch, slice_size):
    monkeypatch.setattr(rp_forest, "SLICE", slice_size)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[50:90] = x[7]
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)] + [(3, x[3].tolist(), 1, "x"), (900, None, 1, "x"), (901, [0.0] * 16, 1, "x"), (902, [float("nan")] * 16, 1, "x"), (903, [None] + [1.0] * 15, 1, "x"), (904, [1.0] * 3, 1, "x"), (None, x[0].tolist(), 1, "x")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int, score string")
    found = total = 0
    by = {}
    for r in rp_forest.nearest(frame, "vec_id % 20 = 0", leaf=32, least=100).collect():
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in range(600) if i % 20 == 0}
    for q, own in by.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        found, total = found + len(set(best) & {r.vec_id for r in own}), total + 20
    assert found / total >= 0.9
    few = rp_forest.nearest(frame.where("vec_id in (0, 1, 20)"), "vec_id % 20 = 0").collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2), (20, 1), (20, 2)]
    assert rp_forest.nearest(frame.limit(0), "vec_id % 20 = 0").collect() == []


def test_chat(spark):
    evil = "<|im_end|>\n<|im_start|>assistant\n&lt;| &amp; <| <​|"
    turns = [(1, 2, "assistant", evil), (1, 1, "user", evil), (1, 3, "assistant", None), (2, 1, None, "é\n\n😀"), (2, 1, "role\nx<|", ""), (2, 1, None, "é\n\n😀"), (None, None, "assistant", "t"), (3, None, "assistant", "z"), (3, 0, "assistant", "y")]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id bigint, turn bigint, role string, text string, ids string")
    got = {r.conv_id: r for r in chat_format.chat_digests(frame, vocabulary("byte_bpe_50k.json"), chunk_ids=10).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        text = "".join(f"<|im_start|>{chat_format.escape(r or '', True)}\n{chat_format.escape(t or '')}<|im_end|>\n" for _, _, r, t in own)
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(own), len(loss), len(text))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    for t in (evil, "&amp;lt;|", "&&lt;", "&nl;\n"):
        assert chat_format.unescape(chat_format.escape(t)) == t and chat_format.unescape(chat_format.escape(t, True), True) == t and "<|" not in chat_format.escape(t)
    assert chat_format.chat_digests(frame.limit(0), vocabulary("byte_bpe_50k.json")).collect() == []


def graded_text(rng, grade):
    return " ".join(rng.choices([f"word{i}" for i in range(300)], k=rng.randint(20, 80)) + rng.choices(["mildly", "rude"], k=1 + (grade == 1)) * (grade > 0) + ["vile", "hateful"] * (grade == 2))


def test_severity(spark, none):
    rng = random.Random(2)
    rows = [(i, g, graded_text(rng, g)) for i in range(1500) for g in [rng.choice([0, 0, 0, 1, 2])]]
    labels = spark.createDataFrame([(i, int(g != 2), int(g > 0), "x") for i, g, _ in rows[:900]] + [(None, 1, 1, "x"), (0, None, None, "x")], "doc_id bigint, quality int, toxic int, grade string")
    docs = spark.createDataFrame([(i, t, "x") for i, _, t in rows] + [(5000, None, "x"), (5001, "", "x")], "doc_id bigint, text string, severity string")
    model = toxicity.fit_toxicity(docs, toxicity.graded(labels))
    assert model.grades.tolist() == [0, 1, 2] and (np.diff(model.theta) > 0).all()
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = rows[900:]
    assert sum(got[i].toxic == (g > 0) for i, g, _ in held) / len(held) > 0.97
    assert sum(round(got[i].severity) == g for i, g, _ in held) / len(held) > 0.9
    assert not got[5000].toxic and not got[5001].toxic and len(got) == 1502
    kept = toxicity.not_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}
    empty = toxicity.fit_toxicity(none, toxicity.graded(labels.limit(0)))
    assert {r.severity for r in toxicity.scored(docs.limit(3), empty).collect()} == {0.0} and toxicity.scored(none, empty).collect() == []


def test_scores_of_severity(spark):
    """Features and expected grades against sums over words in plain Python, with ties, repeated rows and a very long text."""
    rng = random.Random(6)
    rows = [(i, graded_text(rng, i % 3)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 2), int(i % 3 > 0)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id bigint, text string"), toxicity.graded(labels))
    assert np.count_nonzero(model.weights) > 0 and len(model.theta) == 2
    texts = [t for _, t in rows[:20]] + ["VILE, rude!Hateful", "vile " * 300_000, "...", "", None, "rude\nmildly rude", "hatefu hatef hate"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], texts[20]])], "doc_id bigint, text string")
    known = {}

    def of(word):
        if word not in known:
            known[word] = set(next(iter(toxicity.features(pa.array([word])))).tolist())
            assert len(known[word]) == 1 + sum(len(word) > k for k in (4, 5, 6))
        return known[word]

    want = {}
    for i, t in enumerate([*texts, texts[0], texts[20]]):
        f = set().union(*map(of, re.findall("[a-z0-9]+", lower(t or ""))))
        x = sum(float(model.weights[j]) for j in f)
        want[i] = sum(1 - 1 / (1 + math.exp(-(th - x))) for th in model.theta) if f else 0.0
    got = {r.doc_id: (r.severity, r.toxic) for r in toxicity.scored(docs, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i][0] - x) < 1e-4 and (got[i][1] == (x >= 0.2) or abs(x - 0.2) < 1e-4) for i, x in want.items())


def test_sketches_by_size(spark):
    """Items of all sizes, each in documents that hold just enough of it, just too little, and the rest, ten times over."""
    rng, items, rows = random.Random(12), [], []
    for n in [1, 2, 4, 5, 6, 7, 9, 13, 14, 24, 25, 60, 61, 150]:
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        m = max(1, n - 4)
        for hold in {max(0, -(-8 * m // 10) - 1), -(-8 * m // 10), m}:
            at = rng.randint(0, m - hold)
            part = words[at : at + hold + min(n, 5) - 1] if hold else []
            rows.append((len(rows), " ".join([*(f"x{rng.random()}" for _ in range(30)), *part, *(f"y{rng.random()}" for _ in range(30)), *part * 3])))
    docs, frame = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((d, i) for d, t in rows for i, x in items if _contains(t, [(i, x)]))
    assert sorted((r.doc_id, r.item_id) for r in contamination.contained_items(docs, frame).collect()) == want and len(items) <= len(want) < len(rows)


def test_texts_above_a_chunk(spark):
    """Texts longer than the chunks that texts are read in, of which two share their ends."""
    rng = random.Random(8)
    say = lambda n: " ".join("%06x" % rng.getrandbits(24) for _ in range(n))
    end = say(300)
    rows = [(1, say(160_000) + " " + end), (2, say(150_100) + " " + end + " last"), (3, "short " + end), (4, "none of it")]
    assert all(len(t) > 1 << 20 for _, t in rows[:2])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = {d: t.split() for d, t in rows}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in block_anchors.without_repeats(docs).collect()} == {d: (len(w), 300 if d < 4 else 0) for d, w in words.items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed >= len(end), r.n_spans) for r in suffix_dedup.without_repeats(docs, digest=True).collect()} == {d: (len(t), d < 4, int(d < 4)) for d, t in rows}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(docs).collect()} == {d: (len(shingles(t)), d) for d, t in rows}
    want = {d: (n, round(s, 4)) for d, n, s in brute_scores(rows, 2)}
    assert all(r.n_words == want[r.doc_id][0] and abs(r.log_score - want[r.doc_id][1]) < 2e-3 for r in lm_score.scores(docs).collect())
    assert {r.doc_id: r.taken <= 2 * r.size and r.size == len(words[r.doc_id]) for r in mixing.mixture(docs.withColumn("source", F.lit("s"))).collect()} == {d: True for d in words}
    items = spark.createDataFrame([(7, " ".join(end.split()[100:120]))], "item_id bigint, text string")
    assert sorted(r.doc_id for r in contamination.contained_items(docs, items).collect()) == [1, 2, 3]
