"""The pipeline, stage by stage, on tables of its own."""

import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from timeloom.llm._store import Scratch
from timeloom.llm.queries import vocabulary
from tests.llm.test_operators import WORD, _contains, brute_components, graded_text


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(9)
    docs = []
    for i in range(300):
        grade = 2 if i % 10 == 0 else 0
        docs.append((i, graded_text(rng, grade), "en", f"s{i % 3}", 1))
    docs += [(300 + i, docs[i + 1][1] + " more", "en", "s1", 1) for i in range(0, 20, 4)] + [(400, docs[5][1], "en", "s0", 1)]
    items = [(1, " ".join(docs[7][1].split()[:15])), (2, "not in any of the documents here")]
    docs.append((500, None, "en", None, 0))
    for name, rows, schema in (("documents", docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("benchmark", items, "item_id bigint, text string"), ("labels", [(i, int(i % 10 != 0), int(i % 10 == 0)) for i in range(200)], "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return root, docs, items


def brute_mix(spark, rows):
    """How often each (id, text) is taken, seat by seat; few documents are one shard a source."""
    seeded = {(r.d, r.t): r.h for r in spark.createDataFrame([r[:2] for r in rows], "d bigint, t string").select("d", "t", F.xxhash64(F.lit(7), "d", "t").alias("h")).collect()}
    size = lambda t: len(WORD.findall(t or ""))
    own = Counter()
    for _, t, _, s, *_ in rows:
        own[s] += size(t)
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, left = {}, Fraction(3 * sum(own.values()), 2)
    while True:
        open_ = [s for s in order if s not in goal]
        unit = left / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if unit * weight[s] > 2 * own[s]]
        if not full:
            goal |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            goal[s] = Fraction(2 * own[s])
            left -= goal[s]
    share = {s: float(goal[s]) * (round(float(sum(goal.values()))) / float(sum(goal.values()))) if sum(goal.values()) else 0.0 for s in order}
    words = Counter()

    def seat(size, most, votes, got):
        free = [s for s in order if got[s] < most(s) and votes(s) > 0]
        if free:
            s = min(free, key=lambda s: (-votes(s) / (2 * got[s] + 1), order.index(s)))
            got[s] += 1
            words[s] += size
        return bool(free)

    blocks, ones, rest = Counter(), Counter(), Counter()
    total = round(float(sum(goal.values())))
    for _ in range(total // 8):
        seat(8, lambda s: min(2 * own[s], int(share[s])) // 8, lambda s: float(goal[s]), blocks)
    after = Counter(words)
    for _ in range(total - sum(after.values())):
        seat(1, lambda s: 2 * own[s] - after[s], lambda s: max(share[s] - after[s], 0), ones)
    after = Counter(words)
    for _ in range(total - sum(after.values())):
        seat(1, lambda s: 2 * own[s] - after[s], lambda s: float(goal[s]), rest)
    times = Counter()
    for s in order:
        passes, rest_of = divmod(words[s], max(1, own[s]))
        before = 0
        for d, t, *_ in sorted((r for r in rows if r[3] == s), key=lambda r: seeded[r[:2]]):
            n = size(t)
            times[d, t] += passes + (rest_of > before and 2 * (rest_of - before) >= n) if n else 0
            before += n
    return +times


def test_stages(spark, folder):
    root, rows, items = folder
    docs, scratch = spark.read.parquet(f"{root}/documents.parquet"), Scratch(spark, "test")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, root), name)
        kept[name] = [tuple(r) for r in docs.collect()]
        assert name == "tokens" or docs.columns == columns
    toxic = {i for i, t, *_ in rows if t and "vile" in t}
    assert {r[0] for r in kept["toxicity"]} == {r[0] for r in rows} - toxic
    clean = [(r[0], r[1]) for r in kept["toxicity"]]
    assert sorted(r[0] for r in kept["near_duplicates"]) == sorted(d for d, n, least in brute_components(clean) if d == least)
    assert {r[0] for r in kept["decontamination"]} == {r[0] for r in kept["near_duplicates"] if not _contains(r[1], items)}
    assert {r[0] for r in kept["mixing"]} <= {r[0] for r in kept["decontamination"]} and len(kept["mixing"]) > len(kept["decontamination"])
    assert Counter(r[:2] for r in kept["mixing"]) == brute_mix(spark, kept["decontamination"])
    assert sorted(r[0] for r in kept["tokens"]) == sorted(r[0] for r in kept["mixing"])
    plain = Tokenizer.from_file(vocabulary())
    ids = {r[:2]: [*plain.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in kept["mixing"]}
    assert Counter((d, n, crc) for d, _, n, crc in kept["tokens"]) == Counter((r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r in kept["mixing"] for x in [ids[r[:2]]])
    assert [r[1] for r in sorted(kept["tokens"], key=lambda r: r[1])] == np.cumsum([0, *(r[2] for r in sorted(kept["tokens"], key=lambda r: r[1]))])[:-1].tolist()
    assert corpus_pipeline.run(spark, root).count() == len(kept["tokens"])
