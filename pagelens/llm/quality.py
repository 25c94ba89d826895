"""Quality classifier: ordinal cumulative-link regression on graded ratings.

The grades are 0 (poor), 1 (good, but toxic) and 2 (good). A text is a set of hashed words and word
pairs, and one of LENGTHS classes of length; of the words only those get a weight that mark a grade
below the top: in MIN_DOCS training documents at least, MIN_Z standard errors and MIN_LIFT times more
often in the grade than in the others. So chance words can't stand for single documents, and the
ordinary words of long texts don't outweigh a mark. One weight vector is shared by all grades; ordered thresholds t1 < t2 cut its line: P(grade >= k) = sigmoid(w x - t_k). Weights and
thresholds are fitted together on the likelihood of a bounded sample of rated documents (for each
grade the `per_grade` ones with the least hash of doc_id, the grades weighted alike; the tasks make their features), the thresholds
as a first one and the logarithms of the steps, which keeps them in order. From the fit come the
expected grade, sum of P(grade >= k), and the tail P(grade >= 2), by which documents are selected.

Defined results: null text is empty and scored like any text without words; ratings without a
document, null ratings and null ids teach nothing; a document with several ratings has their least
grade. Without at least two grades nothing is learned: expected grade and tail are 0 and nothing is
selected. Repeated rows are rows like others. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import chunks, id_slice, least_rows, whole_id, word_hashes

BITS, PER_GRADE, TAIL, MIN_DOCS, MIN_Z, MIN_LIFT, LENGTHS = 18, 1000, 0.5, 6, 3.0, 6.0, 32
GRADES = 3


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade from ratings quality 0/1 and toxic 0/1."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    rows = labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null")
    return rows.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def features(texts: list[bytes], bits: int = BITS, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and column of each text's distinct words, bare and as written, and pairs of bare
    neighbours (of those columns that are known only, if given), and of its class of length, which has
    one of the last LENGTHS columns."""
    size = 1 << bits
    hashes, counts = word_hashes(texts, bare=True)
    doc = np.repeat(np.arange(len(texts)), counts)
    pair = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    same = doc[:-1] == doc[1:]
    written, n = word_hashes(texts)  # with punctuation, apart from the bare words
    key = np.concatenate((hashes, pair[same], written ^ np.uint64(0x5BD1E9955BD1E995))) >> np.uint64(64 - bits)
    row = np.concatenate((doc, doc[:-1][same], np.repeat(np.arange(len(texts)), n)))
    key = key.astype(np.int64) % (size - LENGTHS)
    if known is not None:
        row, key = row[known[key]], key[known[key]]
    length = size - 1 - np.minimum(2 * np.log2(1 + n), LENGTHS - 1).astype(np.int64)
    cell = np.concatenate((np.unique(row.astype(np.int64) << bits | key), np.arange(len(texts), dtype=np.int64) << bits | length))
    return cell >> bits, cell & (size - 1)


def telling(row: np.ndarray, col: np.ndarray, grade: np.ndarray, bits: int) -> np.ndarray:
    """Columns that mark a grade below the top, and those of the lengths."""
    size = 1 << bits
    seen = np.bincount(col, minlength=size)
    marks = np.zeros(size, bool)
    for g in np.unique(grade)[:-1]:
        inside = grade == g
        a, n, m = np.bincount(col[inside[row]], minlength=size), inside.sum(), (~inside).sum()
        rate = seen / (n + m)
        error = np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n + 1 / max(m, 1)))
        here, there = a / n, (seen - a) / max(m, 1)
        marks |= (here - there >= MIN_Z * error) & (here >= MIN_LIFT * (there + 0.5 / max(m, 1)))
    marks &= seen >= min(MIN_DOCS, max(1, len(grade) // 20))
    marks[size - LENGTHS :] = True
    return np.flatnonzero(marks)


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, w: np.ndarray, cut: np.ndarray):
        self.w, self.cut = w, cut

    @staticmethod
    def fit(row: np.ndarray, col: np.ndarray, grade: np.ndarray, bits: int = BITS, steps: int = 300, rate: float = 0.05, penalty: float = 1e-3) -> Ordinal:
        """Adam on the mean log-likelihood, each grade with the same total weight."""
        known = telling(row, col, grade, bits)
        keep = np.isin(col, known)
        row, col = row[keep], np.searchsorted(known, col[keep])
        dim, n = len(known), len(grade)
        present = np.unique(grade)
        weight = sum((grade == g) / (grade == g).sum() for g in present) / len(present)
        p = np.concatenate((np.zeros(dim), [-1.0], np.zeros(GRADES - 2)))
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, steps + 1):
            cut = np.concatenate((p[dim : dim + 1], p[dim] + np.cumsum(np.exp(p[dim + 1 :]))))
            s = np.bincount(row, p[col], n)
            tail = 1 / (1 + np.exp(-np.clip(s[:, None] - cut, -40, 40)))
            upper = np.concatenate((np.ones((n, 1)), tail), 1)[np.arange(n), grade]
            lower = np.concatenate((tail, np.zeros((n, 1))), 1)[np.arange(n), grade]
            chance = np.maximum(upper - lower, 1e-12)
            up, low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
            ds = weight * (up - low)
            grad = np.zeros_like(p)
            grad[:dim] = np.bincount(col, ds[row], dim) - penalty * p[:dim]
            dcut = np.zeros(GRADES - 1)
            for k in range(GRADES - 1):
                dcut[k] = -(weight * up)[grade == k + 1].sum() + (weight * low)[grade == k].sum()
            grad[dim] = dcut.sum()
            for k in range(1, GRADES - 1):
                grad[dim + k] = dcut[k:].sum() * np.exp(p[dim + k])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            p += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 - t / (steps + 1))
        w = np.zeros(1 << bits, np.float32)
        w[known] = p[:dim]  # steps of Adam leave none of them at 0
        return Ordinal(w, np.concatenate((p[dim : dim + 1], p[dim] + np.cumsum(np.exp(p[dim + 1 :])))))

    def tails(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2) of n texts."""
        s = np.bincount(row, self.w[col], n)
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.cut, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE, bits: int = BITS) -> Ordinal | None:
    picked = least_rows(grades(labels), "grade", per_grade)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b, texts in chunks(pdf["text"].tolist()):
                row, col = features(texts, bits)
                cols = [c.astype("<u4").tobytes() for c in np.split(col[np.argsort(row, kind="stable")], np.cumsum(np.bincount(row, minlength=b - a))[:-1])]
                yield pdf.iloc[a:b][["doc_id", "grade"]].assign(cols=cols)

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInPandas(run, "doc_id long, grade int, cols binary")
    got = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("cols").alias("cols")).orderBy("doc_id").collect()
    grade = np.array([r["grade"] for r in got], int)
    if len(set(grade.tolist())) < 2:
        return None
    cols = [np.frombuffer(r["cols"], "<u4").astype(np.int32) for r in got]
    return Ordinal.fit(np.repeat(np.arange(len(cols), dtype=np.int32), [len(c) for c in cols]), np.concatenate(cols), grade, bits)


def classify(docs: DataFrame, labels: DataFrame, tail: float = TAIL, bits: int = BITS, model: Ordinal | None = None) -> DataFrame:
    """doc_id, expected_grade, tail, selected for every row of docs."""
    model = model or train(docs, labels, bits=bits)
    known = None if model is None else model.w != 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b, texts in chunks(pdf["text"].tolist()):
                t = np.zeros((b - a, GRADES - 1)) if model is None else model.tails(*features(texts, bits, known), b - a)
                yield pd.DataFrame({
                    "doc_id": id_slice(pdf, "doc_id", a, b), "expected_grade": t.sum(1), "tail": t[:, -1], "selected": t[:, -1] >= tail,
                })

    return docs.select(*whole_id("doc_id"), "text").mapInPandas(run, "doc_id long, expected_grade double, tail double, selected boolean")
