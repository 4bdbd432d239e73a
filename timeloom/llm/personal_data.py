"""Personal data in texts, disguised or not, by offset-preserving transducers (operator 12).

Two passes of one set of detectors. The first reads the text as it is and gives the base spans. The second reads what three
transducers make of it, and its spans are mapped back to the characters they came from:

1. characters: look-alikes, wide and other forms, and digits of other scripts become ASCII, invisible characters go;
2. numbers in words: in a run of digit words ("plus four nine, double three dot ...") each becomes its digit and what separates
   them goes;
3. at and dot: ``[at]``, ``(dot)``, ``[.]`` and the like become the sign; so do bare words in an address whose last label is a
   top-level domain, if a dot is spelled out ("ann at host dot com", but not "see us at host.com" nor "look at the dot com").

Each transducer writes, beside the characters, where in its input each begins and ends. A span of the second pass is added
unless one of the same kind in the first contains it.

A chunk of texts is one array of code points, with a NUL between texts, which no pattern takes in. Detectors and the first
transducer are array operations over it; only places that look like an address, a phone number or a disguise are looked at one
by one, each in time linear in its length.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._numeric import Words, chunks
from ._store import small_batches

KINDS = ("email", "ip", "card", "phone")
#: Stands for all characters that have no ASCII form; word characters to the tokeniser, in no pattern's class.
OTHER = 0x80
#: Characters that vanish.
GONE = 0xFF
#: Characters that look like the ASCII characters below them, and signs that pass for full stop and hyphen.
ALIKE = ("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅԌԚԜαονιρυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ。‐‑‒–—―−", "aeopcyxijshdqwABEKMHOPCTYXIJSGQWaovipuxABEZHIKMNOPTYX.-------")
#: Digits in words, in English, German, French and Spanish (OTHER stands for accented letters).
DIGITS = ("zero oh null z\x80ro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five f\x80nf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")
#: Other words of disguises.
SIGNS = {"@": "at arroba arobase", ".": "dot punkt point punto", "+": "plus", "2": "double doppel", "3": "triple"}
#: Words that follow "at" without being a host, and what bare words may end an address with.
ARTICLES = frozenset("the a an this that these those my your our his her its their any some each every all".split())
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co me app dev ai de fr es it uk us eu ca ch nl be pl se no dk fi ie pt br mx ar in jp cn ru au nz za".split())

_ADDRESS = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_OPEN, _CLOSE, _BLANK = b"[({<", b"])}>", b" \t"
_BRACKETED = re.compile(rb"[ \t]*[\[({<][ \t]*([.@])[ \t]*[\])}>][ \t]*")


def _set(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_IS_LOCAL, _IS_LABEL, _IS_DIGIT = _set(_LETTERS + "._%+-"), _set(_LETTERS + "-"), _set("0123456789")


@cache
def _plain() -> np.ndarray:
    """The ASCII form of each code point, OTHER or GONE."""
    out = np.full(0x110000, OTHER, np.uint8)
    out[:128] = np.arange(128)
    for i in range(128, 0x20000):
        c = chr(i)
        plain = unicodedata.normalize("NFKC", c)
        if unicodedata.category(c) == "Cf":
            out[i] = GONE
        elif unicodedata.decimal(c, None) is not None:
            out[i] = ord("0") + unicodedata.decimal(c)
        elif len(plain) == 1 and ord(plain) < 128:
            out[i] = ord(plain)
    for a, b in zip(*ALIKE, strict=True):
        out[ord(a)] = ord(b)
    return out


def emails(data: np.ndarray, whole: bytes) -> list[tuple[int, int]]:
    at = np.flatnonzero(data[1:-1] == 64) + 1
    at = at[_IS_LOCAL[data[at - 1]] & _IS_LABEL[data[at + 1]]]
    if not len(at):
        return []
    breaks = np.flatnonzero(~_IS_LOCAL[data])
    place = np.searchsorted(breaks, at) - 1
    first = np.where(place >= 0, breaks[place] + 1, 0)
    out, end = [], 0
    for begin, sign in zip(first.tolist(), at.tolist(), strict=True):
        begin = max(begin, end)  # matches don't overlap
        if begin < sign and (m := _ADDRESS.match(whole, sign + 1)):
            end = m.end()
            out.append((begin, end))
    return out


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(_IS_DIGIT[data].astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def addresses(data: np.ndarray, whole: bytes) -> list[tuple[int, int]]:
    """Four numbers joined by dots; a longer chain gives one for each four."""
    start, end = _runs(data)
    if len(start) < 4:
        return []
    linked = np.append(False, (end[:-1] + 1 == start[1:]) & (data[end[:-1]] == 46))
    head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(start))))
    ordinal = np.arange(len(start)) - head
    first = np.flatnonzero(ordinal % 4 == 0)
    first = first[first + 3 < len(start)]
    first = first[head[first + 3] == head[first]]
    small = lambda i: int(whole[start[i] : end[i]].lstrip(b"0")[:4] or b"0") <= 255
    return [(int(start[i]), int(end[i + 3])) for i in first.tolist() if all(small(j) for j in range(i, i + 4))]


def cards(data: np.ndarray, whole: bytes) -> list[tuple[int, int]]:
    at = np.flatnonzero(_IS_DIGIT[data])
    if not len(at):
        return []
    gap, after = np.diff(at), data[at[:-1] + 1]
    linked = (gap == 1) | (gap == 2) & ((after == 32) | (after == 45))
    first = np.flatnonzero(np.append(True, ~linked))
    count = np.diff(np.append(first, len(at)))
    fits = (count >= 13) & (count <= 19)
    if not fits.any():
        return []
    value = data[at].astype(np.int64) - 48
    from_right = np.repeat(first + count - 1, count) - np.arange(len(at))
    value = np.where(from_right % 2 == 1, value * 2 - 9 * (value > 4), value)
    good = np.flatnonzero(fits & (np.add.reduceat(value, first) % 10 == 0))
    return list(zip(at[first[good]].tolist(), (at[first[good] + count[good] - 1] + 1).tolist(), strict=True))


def phones(data: np.ndarray, whole: bytes) -> list[tuple[int, int]]:
    plus = np.flatnonzero(data[:-1] == 43)
    out = []
    for i in plus[_IS_DIGIT[data[plus + 1]]].tolist():
        m = _PHONE.match(whole, i)
        if m and 9 <= sum(map(m[0].count, b"0123456789")) <= 15:
            out.append(m.span())
    return out


DETECTORS = (emails, addresses, cards, phones)


def detected(data: np.ndarray) -> list[list[tuple[int, int]]]:
    whole = data.tobytes()
    return [find(data, whole) for find in DETECTORS]


@cache
def _lexicon() -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of words, what each stands for): a digit's character, or the sign."""
    words = {w: str(i) for i, many in enumerate(DIGITS) for w in many.split()}
    signs = {w: {"2": "D", "3": "T"}.get(s, s) for s, many in SIGNS.items() for w in many.split()}
    words |= signs
    text = " ".join(words).encode("latin-1")
    h = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lower=True, alphanumeric=True).hashes()
    order = np.argsort(h)
    return h[order], np.frombuffer("".join(words.values()).encode(), np.uint8)[order]


class Tokens:
    """Words of ASCII letters, digits and OTHER, with what those of the lexicon stand for (0: nothing)."""

    def __init__(self, data: np.ndarray):
        self.whole = data.tobytes()
        words = Words(data, np.array([0, len(data)]), lower=True, alphanumeric=True)
        self.start, self.end = words.start, words.end
        known, meaning = _lexicon()
        short = np.flatnonzero(self.end - self.start <= 8)
        h = words.hashes()[short]
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        self.sign = np.zeros(len(self.start), np.uint8)
        self.sign[short] = np.where(known[place] == h, meaning[place], 0)
        numeric = np.concatenate(([0], np.cumsum(_IS_DIGIT[data])))
        self.number = numeric[self.end] - numeric[self.start] == self.end - self.start

    def gap(self, i: int) -> bytes:
        return self.whole[self.end[i] : self.start[i + 1]]

    def word(self, i: int) -> str:
        return self.whole[self.start[i] : self.end[i]].decode("latin-1").lower()

    def after(self, i: int) -> tuple[str, int, str] | None:
        """(sign, next token, how) if a sign stands between token i and the next: plain, spaced, bracketed or bare (a word)."""
        last = len(self.start) - 1
        if i >= last:
            return None
        gap = self.gap(i)
        inner = gap.strip(_BLANK)
        if inner in (b".", b"@", b"-", b"_"):
            return (inner.decode(), i + 1, "plain") if gap == inner else ("@", i + 1, "spaced") if inner == b"@" else None
        if m := _BRACKETED.fullmatch(gap):
            return m[1].decode(), i + 1, "bracketed"
        sign = chr(self.sign[i + 1])
        if sign in "@." and i + 1 < last:
            then = self.gap(i + 1).strip(_BLANK)
            if len(inner) == len(then) == 1 and inner in _OPEN and then in _CLOSE:
                return sign, i + 2, "bracketed"
            if not inner and not then:
                return sign, i + 2, "bare"
        return None


#: Of an edit: begin, end, and what stands there instead: (characters, begin and end of each).
Edit = tuple[int, int, bytes, list[int], list[int]]


def _instead(a: int, b: int, sign: str) -> Edit:
    return a, b, sign.encode(), [a], [b]


def digit_runs(t: Tokens) -> list[Edit]:
    """Edits of runs of digit words, with signs and numbers between them."""
    is_digit = (t.sign >= 48) & (t.sign <= 57)
    part = t.number | (t.sign > 0) & (t.sign != 64)
    if not (part & (t.sign > 0)).any():
        return []
    edge = np.flatnonzero(np.diff(part.astype(np.int8), prepend=0, append=0))
    out: list[Edit] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a < 2 or not t.sign[a:b].any():
            continue
        runs, low = [], a
        for i in range(a, b):
            if i + 1 == b or t.gap(i).strip(b" \t,-/()\n"):
                runs.append((low, i + 1))
                low = i + 1
        for low, high in runs:
            signs = t.sign[low:high]
            if is_digit[low:high].sum() >= 4 or (signs == 46).sum() >= 3 or (signs[:1] == 43).any() and high - low > 1:
                out += _one_run(t, low, high)
    return out


def _one_run(t: Tokens, low: int, high: int) -> list[Edit]:
    out: list[Edit] = []
    begin, times = None, 1
    spelled = False  # whether what stands before the gap was written in words
    for i in range(low, high):
        sign, a, b = chr(t.sign[i]), int(t.start[i]), int(t.end[i])
        joins = i > low and (spelled or t.sign[i] > 0)  # a gap beside a word goes, one between numbers stays
        if joins:
            out.append((int(t.end[i - 1]), a, b"", [], []))
        spelled = t.sign[i] > 0
        if sign in "DT" and i + 1 < high:
            begin, times = a, 2 if sign == "D" else 3
            out.append((a, b, b"", [], []))
            continue
        if spelled and sign not in "DT":
            a0 = a if begin is None else begin
            out.append((a, b, sign.encode() * times, [a0] * times, [b] * times))
        begin, times = None, 1
    return out


def address_signs(t: Tokens, data: np.ndarray) -> list[Edit]:
    """Edits of bracketed signs, and of spelled ones in addresses."""
    out: list[Edit] = []
    signs = np.flatnonzero((t.sign == 64) | (t.sign == 46))
    marks = np.flatnonzero((data == 64) | (data == 46))
    inside = marks[(marks > 0) & (marks < len(data) - 1)]
    at = inside[data[inside] == 64]
    near = _set("[({< \t")[data[inside - 1]] & _set("])}> \t")[data[inside + 1]]
    # The token before each sign, where a bracketed sign or an address may be.
    before = np.concatenate((signs - 1, np.searchsorted(t.start, inside[near]) - 1, np.searchsorted(t.start, at) - 1))
    taken = -1
    for i in np.unique(before[before >= 0]).tolist():
        found = t.after(i)
        if not found:
            continue
        sign, j, how = found
        if how == "bracketed":
            out.append(_instead(int(t.end[i]), int(t.start[j]), sign))
        if sign == "@" and i >= taken:
            edits, taken = _one_address(t, i, found)
            out += edits
    return out


def _one_address(t: Tokens, i: int, found: tuple[str, int, str]) -> tuple[list[Edit], int]:
    """The edits of an address whose at sign follows token i, and the token it ends with."""
    _, j, how = found
    edits = [_instead(int(t.end[i]), int(t.start[j]), "@")]
    bare, dots, now = how == "bare", 0, j
    kept, end = (None, j) if bare or how == "spaced" else (0, j)
    while nxt := t.after(now):
        sign, to, how_dot = nxt
        if sign == "@":
            break
        if sign == ".":
            dots += 1
        if how_dot != "plain":
            edits.append(_instead(int(t.end[now]), int(t.start[to]), sign))
        now = to
        if t.word(now) in TOP_LEVEL and any(e[2] == b"." for e in edits):
            kept, end = len(edits), now
        elif how_dot == "bracketed" and not bare and kept is not None:
            kept, end = len(edits), now
    if kept is None or dots == 0 or bare and t.word(j) in ARTICLES:
        return [], i
    edits = edits[: max(kept, how != "plain")]
    while i > 0:  # what is spelled before the at sign
        back = next((k for k in (i - 1, i - 2) if k >= 0 and (s := t.after(k)) and s[1] == i and s[0] in ".-_"), None)
        if back is None:
            break
        s = t.after(back)
        if s[2] == "bare" and how == "plain":
            break
        if s[2] != "plain":
            edits.append(_instead(int(t.end[back]), int(t.start[i]), s[0]))
        i = back
    return edits, end


def edited(data: np.ndarray, edits: list[Edit]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, begin and end of each in ``data``); of edits that overlap the first stays."""
    parts, begins, ends, at = [], [], [], 0
    own = np.arange(len(data))
    for a, b, characters, first, last in sorted(set((a, b, c, tuple(x), tuple(y)) for a, b, c, x, y in edits)):
        if a < at:
            continue
        parts += [data[at:a], np.frombuffer(characters, np.uint8)]
        begins += [own[at:a], np.array(first, np.int64)]
        ends += [own[at:a] + 1, np.array(last, np.int64)]
        at = b
    return np.concatenate([*parts, data[at:]]), np.concatenate([*begins, own[at:]]), np.concatenate([*ends, own[at:] + 1])


def normalised(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters that the transducers make of code points, and where each begins and ends."""
    data = _plain()[points]
    kept = np.flatnonzero(data != GONE)
    data = data[kept]
    tokens = Tokens(data)
    out, begin, end = edited(data, digit_runs(tokens) + address_signs(tokens, data))
    if not len(out):
        return out, begin, end
    return out, kept[begin], kept[end - 1] + 1


def spans_of(texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    """For each text its spans (kind, start, end, added), in code points, by kind and place."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), "<u4")
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    base = detected(np.where(points < 128, points, OTHER).astype(np.uint8))
    data, begin, end = normalised(points)
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
    for kind, (own, more) in enumerate(zip(base, detected(data), strict=True)):
        first = np.array([a for a, _ in own], np.int64)
        for a, b in own:
            t = int(np.searchsorted(starts, a, "right")) - 1
            out[t].append((kind, int(a - starts[t]), int(b - starts[t]), False))
        for a, b in more:
            a, b = int(begin[a]), int(end[b - 1])
            i = int(np.searchsorted(first, a, "right")) - 1
            if i < 0 or own[i][1] < b:
                t = int(np.searchsorted(starts, a, "right")) - 1
                out[t].append((kind, int(a - starts[t]), int(b - starts[t]), True))
    return [sorted(x) for x in out]


SPANS = "array<struct<kind:string, start:bigint, end:bigint, added:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of each row: kind, start, end (exclusive, in code points), whether the method added it.

    A null or empty text has no spans. Repeated rows get a row each; an empty table gives an empty result; further columns take
    no part. A text of any length is taken whole.
    """
    small_batches(docs.sparkSession)
    only = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for i, j, *_ in chunks(batch.column(1)):
                found = spans_of([x or "" for x in batch.column(1)[i:j].to_pylist()])
                rows = [[{"kind": KINDS[k], "start": a, "end": b, "added": new} for k, a, b, new in x] for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(rows, _SPAN)], ["doc_id", "spans"])

    return only.mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def span_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts and digest of the base spans, all spans as a string."""
    rows = personal_spans(docs, doc_id, text)
    base = F.filter("spans", lambda s: ~s["added"])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    added = F.size(F.filter("spans", lambda s: s["added"])).cast("bigint").alias("n_added")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all columns, with each span of the text replaced by its kind in brackets; overlapping spans give one, of the first's kind."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def clean(value: str) -> str:
        out, at = [], 0
        for kind, a, b, _ in sorted(spans_of([value])[0], key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [value[at:a], f"[{KINDS[kind].upper()}]"]
            at = max(at, b)
        return "".join([*out, value[at:]])

    def run(batches):
        for batch in batches:
            new = pa.array([None if v is None else clean(v) for v in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema.set(place, pa.field(text, pa.string())))

    return docs.mapInArrow(run, docs.schema)
