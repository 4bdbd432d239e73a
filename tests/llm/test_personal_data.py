"""Personal data: base spans against the patterns themselves, disguises by example."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timeloom.llm.personal_data import KINDS, personal_spans, redacted, span_digests, spans_of

SCHEMA = "doc_id bigint, text string, spans string, added string, kind string, n_email string"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


RULES = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
)


def brute(text):
    return [(k, m.start(), m.end()) for k, (pattern, good) in enumerate(RULES) for m in re.finditer(pattern, text) if good(m[0])]


def base(text):
    return [s[:3] for s in spans_of([text])[0] if not s[3]]


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("a1209.@-+ ()_%é\0漢,x5"), max_size=60))
def test_base_spans_follow_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("a1.@-+ ()[]é"), max_size=20), max_size=6), st.lists(st.sampled_from(["ann", "at", "host", "dot", "com", "[at]", "(dot)", "one", "two", "plus", "double", "4111", "1111", "@", ".", "the"]), max_size=14))
def test_any_text_is_taken(parts, words):
    """Spans are in order, within the text, and base ones stay whatever the transducers make of it."""
    text = " ".join(parts) + " " + " ".join(words)
    found = spans_of([text, "", text])
    assert found[0] == found[2] and found[1] == [] and [s[:3] for s in found[0] if not s[3]] == brute(text)
    assert all(0 <= a < b <= len(text) for _, a, b, _ in found[0])


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write to ann [at] host [dot] com now", "email", "ann [at] host [dot] com"),
        ("ann dot lee at mail dot host dot com today", "email", "ann dot lee at mail dot host dot com"),
        ("mail ann@host dot com today", "email", "ann@host dot com"),
        ("x ann(@)host(.)org y", "email", "ann(@)host(.)org"),
        ("ann { at } host { punkt } de", "email", "ann { at } host { punkt } de"),
        ("ann AT host DOT co DOT uk he", "email", "ann AT host DOT co DOT uk"),
        ("ann at host dot com dot He said", "email", "ann at host dot com"),
        ("аnn＠hоst．cоm.", "email", "аnn＠hоst．cоm"),
        ("a​nn@ho­st.com", "email", "a​nn@ho­st.com"),
        ("call plus four nine three zero one two three four five six!", "phone", "plus four nine three zero one two three four five six"),
        ("plus double four seven seven zero nine double zero nine double zero one", "phone", "plus double four seven seven zero nine double zero nine double zero one"),
        ("ruf plus vier neun drei null eins zwei drei vier fünf sechs an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs"),
        ("card four one one one, one one one one, one one one one, one one one one", "card", "four one one one, one one one one, one one one one, one one one one"),
        ("card 4111‑1111‑1111‑1111", "card", "4111‑1111‑1111‑1111"),
        ("٤١١١١١١١١١١١١١١١", "card", None),
        ("ip 192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1"),
        ("ip 192 dot 168 dot 0 dot 1 x", "ip", "192 dot 168 dot 0 dot 1"),
        ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ],
)
def test_disguises(text, kind, part):
    start = text.index(part) if part else 0
    assert spans_of(["before", text])[1] == [(KINDS.index(kind), start, start + len(part or text), True)]


@pytest.mark.parametrize("text", ["see us at host.com", "look at the dot com boom", "ann @ host . com", "one two three four five, six", "at dot com", "5 apples @ 3.50 each", "point three of plus one", "привет, мир. до свидания", "[dot] (at) [.] {@}", "un deux trois quatre cinq point"])
def test_clean_texts_stay_clean(text):
    assert spans_of([text]) == [[]]


def test_a_span_of_the_second_pass_that_extends_a_base_one_is_added():
    assert spans_of(["ａnn@host.com"]) == [[(0, 0, 12, True), (0, 1, 12, False)]]


def make_rows():
    rng = random.Random(12)
    some = ["ann@host.com", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111 1111 1111 1112", "+1 (988) 555-2485", "+1-2", "ann [at] host [dot] com", "wörd", "漢字", "\U0001f600", "plain", "9" * 5000 + ".1.1.1", "\0"]
    texts = [None, "", "no data", "+1 (988) 555-2485" * 3, "a@b.c" * 500]
    texts += [" ".join(rng.choices(some, k=rng.randint(0, 30))) for _ in range(60)] + ["é" * 700_000 + " ann@host.com " + "é" * 10]
    rows = list(enumerate(texts))
    return rows + [rows[9], rows[9], (9, "+49 301234567"), (None, "x 4111-1111-1111-1111"), (None, None)]


def test_digests(spark):
    rows = make_rows()
    docs = spark.createDataFrame([(i, t, "s", "a", "k", "n") for i, t in rows], SCHEMA).repartition(3)
    want = []
    for doc, text in rows:
        found = brute(text or "")
        every = sorted({*found, *[s[:3] for s in spans_of([text or ""])[0]]})
        said = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)
        want.append((doc, *[sum(k == i for i, _, _ in found) for k in range(4)], hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in every), len(every) - len(found)))
    assert sorted(map(tuple, span_digests(docs).collect()), key=repr) == sorted(want, key=repr)
    assert span_digests(docs.limit(0)).collect() == [] and personal_spans(docs.where("doc_id = 2")).first().spans == []


def test_redacted(spark):
    docs = spark.createDataFrame([(1, "call ann [at] host [dot] com or +1 (988) 555-2485.", "s"), (2, None, "s"), (3, "", "s")], "doc_id int, text string, spans string")
    got = redacted(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, "call [EMAIL] or [PHONE].", "s"), (2, None, "s"), (3, "", "s")]
