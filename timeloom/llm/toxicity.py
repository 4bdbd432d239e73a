"""Toxicity as severity: cumulative-link ordinal regression over sparse text features (operator 8).

P(grade <= g) = sigma(theta_g - w.x): all thresholds share one weight vector over hashed words (letters and digits, A-Z
lower-cased, and their first bytes; present or not), so a step between grades is learned from every labelled row. Weights carry an L1 penalty, which
leaves a few hundred of them and keeps long texts from adding up noise. The result is the expected grade.

The model is fitted on a bounded sample: the ``sample`` labelled rows with the smallest id hashes. Scoring runs over every row
without a shuffle; what is broadcast is one float for each of 2**``bits`` features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._numeric import BASES, U, Words, chunks, mix, powers
from ._store import freed, small_batches

BITS = 20
PREFIXES = (4, 5, 6)


def features(column: pa.Array, bits: int = BITS):
    """The sorted distinct features of each text: its words, and their first 4, 5 and 6 bytes where longer."""
    for _, _, data, at in chunks(column):
        words = Words(data, at, lower=True, alphanumeric=True)
        up, down = powers(BASES[0], len(words.data) + 1)
        total = np.zeros(len(words.data) + 1, U)
        np.cumsum((words.data.astype(U) + U(1)) * up[: len(words.data)], out=total[1:])
        hashes, of = [words.hashes()], [np.arange(len(words.start))]
        for k in PREFIXES:
            i = np.flatnonzero(words.end - words.start > k)
            start = words.start[i]
            hashes.append(mix((total[start + k] - total[start]) * down[start] + U(k)))
            of.append(i)
        text = np.repeat(np.arange(len(words.count)), words.count)[np.concatenate(of)]
        key = np.unique((text << bits) | (np.concatenate(hashes) >> U(64 - bits)).astype(np.int64))
        cut = np.searchsorted(key >> bits, np.arange(len(words.count) + 1))
        f = (key & ((1 << bits) - 1)).astype(np.int32)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield f[i:j]


def _sigma(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """theta ascending, one fewer than grades; ``grades`` are the values seen in training."""

    weights: np.ndarray
    theta: np.ndarray
    grades: np.ndarray

    def severity(self, sums: np.ndarray) -> np.ndarray:
        """The expected grade, for sums of weights."""
        above = 1 - _sigma(self.theta[None, :] - sums[:, None])
        return self.grades[0] + above @ np.diff(self.grades).astype(float)

    def score(self, column: pa.Array) -> np.ndarray:
        """The expected grade of each text; the lowest grade for one without any features."""
        bits = int(len(self.weights)).bit_length() - 1
        found = list(features(column, bits))
        got = self.severity(np.array([self.weights[f].sum(dtype=float) for f in found], float))
        return np.where([len(f) > 0 for f in found], got, float(self.grades[0])) if found else got


def fit(rows: list[np.ndarray], grades: np.ndarray, bits: int = BITS, penalty: float = 4e-4, rounds: int = 60, least_rows: int = 8, refit: bool = True) -> OrdinalModel:
    """Accelerated proximal gradient; one grade alone gives a model that always says it, no rows one that says 0.

    The penalty chooses features and shrinks their weights, so a second fit over the chosen ones has hardly any.
    """
    weights = np.zeros(1 << bits)
    levels, y = np.unique(grades, return_inverse=True) if len(grades) else (np.array([0]), np.zeros(0, int))
    if len(levels) < 2:
        return OrdinalModel(weights.astype(np.float32), np.zeros(0), levels)
    n, k = len(rows), len(levels)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    common = np.bincount(flat, minlength=1 << bits) >= least_rows
    used = np.flatnonzero(common)
    keep = common[flat]
    col, owner = np.searchsorted(used, flat[keep]), owner[keep]
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    theta = np.log(share / (1 - share))
    w, z, t, ahead = np.zeros(len(used)), np.zeros(len(used)), 1.0, theta.copy()
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(col, minlength=len(used)) / n * 100))  # rarer features step further
    step = 4.0

    def parts(w, theta):
        s = np.bincount(owner, weights=w[col], minlength=n)
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        upper, lower = _sigma(edge[y + 1] - s), np.where(y == 0, 0.0, _sigma(edge[y] - s))
        upper = np.where(y == k - 1, 1.0, upper)
        return upper, lower, np.maximum(upper - lower, 1e-12)

    def loss(w, theta):
        return -np.log(parts(w, theta)[2]).mean()

    for _ in range(rounds):
        upper, lower, mass = parts(z, ahead)
        slope = (1 - upper - lower) / n
        grad = np.bincount(col, weights=slope[owner], minlength=len(used))
        du, dl = upper * (1 - upper) / mass / n, lower * (1 - lower) / mass / n
        grad_theta = np.array([-du[y == g].sum() + dl[y == g + 1].sum() for g in range(k - 1)])
        base = loss(z, ahead)
        while True:
            new = z - step * scale * grad
            new = np.sign(new) * np.maximum(np.abs(new) - step * scale * penalty, 0)
            new_theta = np.maximum.accumulate(ahead - min(step, 1.0) * grad_theta * 4)
            if k > 2:
                new_theta += np.arange(k - 1) * 1e-6
            d = new - z
            if loss(new, new_theta) <= base + grad @ d + (d * d / scale).sum() / (2 * step) + grad_theta @ (new_theta - ahead) + ((new_theta - ahead) ** 2).sum() or step < 1e-3:
                break
            step /= 2
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, ahead = new + (t - 1) / after * (new - w), new_theta + (t - 1) / after * (new_theta - theta)
        ahead = np.maximum.accumulate(ahead)
        w, theta, t = new, new_theta, after
    weights[used] = w
    if refit:
        chosen = np.flatnonzero(weights).astype(np.int32)
        return fit([np.intersect1d(r, chosen, assume_unique=True) for r in rows], grades, bits, penalty / 40, 4 * rounds, least_rows, refit=False)
    return OrdinalModel(weights.astype(np.float32), theta, levels)


def graded(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(doc_id, grade) of labels 0 and 1: 0 not toxic, 1 toxic, 2 toxic and of no quality; the worst where rows differ.

    Rows without an id or a toxic label are left out; an unknown quality counts as quality.
    """
    grade = F.when(labels[toxic] == 0, 0).otherwise(1 + (F.coalesce(labels[quality], F.lit(1)) == 0).cast("int"))
    rows = labels.select(labels[doc_id].cast("bigint").alias("doc_id"), F.when(labels[toxic].isNotNull(), grade).alias("grade"))
    return rows.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))


def fit_toxicity(docs: DataFrame, grades: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 8_000, bits: int = BITS) -> OrdinalModel:
    """A model from the ``sample`` rows of ``grades`` (doc_id, grade) with the smallest id hashes.

    A label without a document adds nothing. Of several rows of an id the one with the smallest text hash counts. A null or
    empty text has no features. Without labels the model says 0 of every text.
    """
    small_batches(docs.sparkSession)
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    only = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    rows = only.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    rows = rows.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def packed(batches):
        for b in batches:
            f = [x.tobytes() for x in features(b.column(0), bits)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(f, pa.binary())], ["doc_id", "grade", "f"])

    got = rows.select("text", "doc_id", "grade").mapInArrow(freed(packed), "doc_id bigint, grade int, f binary").toPandas()
    got = got.sort_values("doc_id")
    return fit([np.frombuffer(x, np.int32) for x in got["f"]], got["grade"].to_numpy(), bits)


def scored(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text", reject: float = 0.2) -> DataFrame:
    """(doc_id, severity, toxic): expected grade of each row, and whether it is ``reject`` or more.

    A null or empty text has no features and gets the lowest grade. Each repeated row gets its own result row;
    an empty table gives none.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(s >= reject)], ["doc_id", "severity", "toxic"])

    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(freed(run), "doc_id bigint, severity double, toxic boolean")


def not_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text", reject: float = 0.2) -> DataFrame:
    """The rows of ``docs``, all columns, of a severity below ``reject``; each repeated row and each null or empty text stays or goes as :func:`scored` says."""
    small_batches(docs.sparkSession)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(place)) < reject))

    return docs.mapInArrow(freed(run), docs.schema)
