r"""Token-level chat assembly (operator 4).

A turn is, in text, ``<|im_start|>role\ntext<|im_end|>\n``. Role and text are encoded apart from each other and from the
markers, whose reserved ids are spliced in, so no content can become a marker. In text, contents are escaped so that no marker
string is left in them: ``&`` becomes ``&amp;`` and then ``<|`` becomes ``&lt;|`` (in a role, a line feed becomes ``&nl;``);
undone in reverse order, this gives back any text. The loss mask covers the texts of assistant turns: segments have a flag
each, and prefix sums of their lengths spread the flags to ids.

Output rows are (conv_id, chunk, turns, ids, loss): chunks of a conversation in order, ids as little-endian u16, the mask as
packed bits. Turns are encoded where they are read. A conversation's turns meet in one task, as their order needs, but stream
through it, so one of any length takes the memory of a chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._numeric import ranges
from ._store import Scratch

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
FORMATTED = "conv_id bigint, chunk int, turns bigint, ids binary, loss binary"


def escape(text: str, role: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<|", "&lt;|")
    return text.replace("\n", "&nl;") if role else text


def unescape(text: str, role: bool = False) -> str:
    text = text.replace("&nl;", "\n") if role else text
    return text.replace("&lt;|", "<|").replace("&amp;", "&")


class Encoder:
    """A byte-level vocabulary with two reserved ids after its own."""

    def __init__(self, file: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.start, self.end = size, size + 1
        self._roles: dict[str, np.ndarray] = {}
        self.line = self.encode(["\n"])[0]
        self._pool: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def role(self, role: str) -> np.ndarray:
        if role not in self._roles:
            if len(self._roles) > 10_000:
                self._roles.clear()
            self._roles[role] = self.encode([escape(role, True) + "\n"])[0]
        return self._roles[role]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        if self._pool is None:
            # Byte-level vocabularies write bytes as printable characters: those that are so themselves, the rest from 256 on.
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in plain]
            byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
            words = [b""] * (self.end + 1)
            for word, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                words[i] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
            words[self.start], words[self.end] = START.encode(), END.encode()
            size = np.array([len(w) for w in words], np.int64)
            self._pool = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size
        pool, start, size = self._pool
        return pool[ranges(start[ids], size[ids])].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def formatted(turns: DataFrame, file: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_ids: int = 200_000) -> DataFrame:
    """Rows of chunks (see above). Turns are in order of ``turn``, nulls first, ties by role and then text.

    A null role or text is an empty one. Rows of a null conv_id form one conversation of that id. Repeated rows are turns of
    their own. An empty table gives no rows; further columns take no part.
    """
    only = turns.select(turns[conv_id].cast("bigint").alias("conv_id"), turns[turn].cast("bigint").alias("turn"), F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"))

    def encode(batches):
        enc = encoder(file)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                ids = [x.tobytes() for x in enc.encode([escape(x) for x in part.column(3).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(ids, pa.binary()), part.column(3)], ["conv_id", "turn", "role", "ids", "text"])

    def assemble(batches):
        enc = encoder(file)
        segments: list[np.ndarray] = []
        flags: list[bool] = []
        now, chunk, n, size = None, 0, 0, 0

        def out():
            length = np.array([len(s) for s in segments])
            stop = np.cumsum(length)
            edge = np.zeros(int(stop[-1]) + 1, np.int8)
            on = np.array(flags)
            np.add.at(edge, (stop - length)[on], 1)
            np.add.at(edge, stop[on], -1)
            loss = np.cumsum(edge[:-1]).astype(bool)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([chunk], pa.int32()), pa.array([n], pa.int64()), pa.array([np.concatenate(segments).astype("<u2").tobytes()], pa.binary()), pa.array([np.packbits(loss, bitorder="little").tobytes()], pa.binary())], ["conv_id", "chunk", "turns", "ids", "loss"])

        for b in batches:
            for c, r, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now is not None and (c,) != now:
                    if n:
                        yield out()
                    segments, flags, chunk, n, size = [], [], 0, 0, 0
                elif size >= chunk_ids:
                    yield out()
                    segments, flags, chunk, n, size = [], [], chunk + 1, 0, 0
                now = (c,)
                content = np.frombuffer(ids, np.uint16)
                segments += [np.array([enc.start], np.uint16), enc.role(r), content, np.array([enc.end], np.uint16), enc.line]
                flags += [False, False, r == LOSS_ROLE, False, False]
                n, size = n + 1, size + len(content)
        if n:
            yield out()

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = only.mapInArrow(encode, "conv_id bigint, turn bigint, role string, ids binary, text string")
    return encoded.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "ids").mapInArrow(assemble, FORMATTED)


def read_turns(enc: Encoder, ids: np.ndarray):
    """(role, text) of each turn in a chunk's ids."""
    for a, b in zip(np.flatnonzero(ids == enc.start).tolist(), np.flatnonzero(ids == enc.end).tolist(), strict=True):
        role, _, text = enc.bytes_of(ids[a + 1 : b]).decode().partition("\n")
        yield unescape(role, True), unescape(text)


def read_loss(enc: Encoder, ids: np.ndarray, loss: np.ndarray):
    """The unescaped text of each run under the mask."""
    edge = np.diff(np.concatenate(([0], loss[: len(ids)].astype(np.int8), [0])))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        yield unescape(enc.bytes_of(ids[a:b]).decode())


def chat_digests(turns: DataFrame, file: str, scratch: Scratch | None = None, **options) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the written chunks."""
    scratch = scratch or Scratch(turns.sparkSession, "chat")
    chunks = scratch.save(formatted(turns, file, **options), "formatted")

    def digest(batches):
        enc = encoder(file)
        now, done = None, []

        def out(rows):
            cols = list(zip(*[(c[0], n, t.hexdigest(), x, s.hexdigest(), f) for c, (n, t, x, s, f) in rows], strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        state: list = []
        for b in batches:
            for c, raw, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if now is None or (c,) != now:
                    if now is not None:
                        done.append((now, state))
                    now, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, loss = np.frombuffer(raw, "<u2"), np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little")
                for role, text in read_turns(enc, ids):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for text in read_loss(enc, ids, loss):
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(enc.bytes_of(ids).decode())
            if len(done) > 1000:
                yield out(done)
                done = []
        if now is not None:
            yield out([*done, (now, state)])

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.select("conv_id", "chunk", "ids", "loss").repartition(n, "conv_id").sortWithinPartitions("conv_id", "chunk").select("conv_id", "ids", "loss")
    return dealt.mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
