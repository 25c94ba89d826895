"""Language ID by hierarchical discrimination.

A text is a vector of hashed character n-grams (1 to 3 code points of the lower-cased words, spaces
marking word ends), square-rooted and scaled to length one. First a linear classifier per language
family, one versus the rest, picks the family; then, within it, one-versus-one linear support vector
machines separate each pair of its languages and vote. All are squared-hinge SVMs with an L2
penalty, trained by accelerated gradient descent on a bounded sample of labelled rows: for each of
the `max_langs` languages with most rows the `per_lang` training rows with the least hash of doc_id.
Their features are made by the tasks; the driver gets at most 2^bits numbers a row.

Languages belong to the families of FAMILIES; a language not listed is a family of its own. The
score is the sigmoid of the winner's margin over the other families times the mean sigmoid of its
margins over its siblings, so it lies between 0 and 1.

A text is `known` if the winner's own margin, not its lead, reaches a floor: FLOOR times the margin
that all but a hundredth of the training rows reach; of texts shorter than SHORT characters, which
show little, a share of that by their length. Text of a language never learned, or letter
noise, lies on the far side of every classifier. One language alone has no margin: all is known.

Defined results: null text, or text without a letter, is `und` with score 0; so is every text if
there is nothing to learn from; with one language learned every text with a letter is that
language. A null doc_id is never learned from and is not held out. Repeated rows are rows like
others. Only doc_id, text and lang are read; lang never for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import chunks, id_slice, least_rows, whole_id, without

#: Fixed table: ISO 639 codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt",
    "indic": "hi bn ur mr gu pa ne",
    "sinitic": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BITS, PER_LANG, MAX_LANGS, FLOOR, SHORT = 12, 400, 256, 0.25, 200


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(texts: list[bytes], bits: int = BITS) -> np.ndarray:
    """One row per text, 2^bits columns."""
    dim, out = 1 << bits, np.zeros((len(texts), 1 << bits), np.float32)
    for row, raw in enumerate(texts):
        cut = " " + raw.decode("utf-8", "surrogatepass").lower() + " "
        c = np.frombuffer(cut.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        count = np.zeros(dim, np.float64)
        for n, mult in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
            h = np.zeros(max(len(c) - n + 1, 0), np.uint64)
            for j in range(n if len(h) else 0):
                h = (h + c[j : j + len(h)] + np.uint64(1)) * np.uint64(mult)
            count += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=dim)
        out[row] = np.sqrt(count / max(count.sum(), 1.0))
    return out


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights (bias last) of a squared-hinge linear SVM, classes weighted alike; y is +1 or -1."""
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    v, last = w.copy(), 1.0
    step = 1 / (2 * 2.0 + penalty)  # rows have length one, the bias adds one
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        pull = -2 * share * y * gap
        grad = np.append(pull @ x, pull.sum())
        grad[:-1] += penalty * v[:-1]
        new, now = v - step * grad, (1 + np.sqrt(1 + 4 * last * last)) / 2
        v, w, last = (new + (last - 1) / now * (new - w)).astype(np.float32), new.astype(np.float32), now
    return w


class Model:
    """Learned classifiers; small, bounded by languages times 2^bits."""

    def __init__(self, langs: list[str], x: np.ndarray | None = None, y: np.ndarray | None = None):
        self.langs = langs
        self.family = [_FAMILY.get(c, c) for c in langs]
        self.families = sorted(set(self.family))
        self.top, self.pairs = {}, {}
        if x is not None and len(langs) > 1:
            fam = np.array([self.families.index(self.family[i]) for i in y])
            if len(self.families) > 1:
                self.top = {f: svm(x, np.where(fam == f, 1.0, -1.0)) for f in range(len(self.families))}
            for a, b in combinations(range(len(langs)), 2):
                if self.family[a] == self.family[b]:
                    pick = (y == a) | (y == b)
                    self.pairs[a, b] = svm(x[pick], np.where(y[pick] == a, 1.0, -1.0))
        self.floor = -np.inf
        if self.top or self.pairs:
            self.floor = FLOOR * float(np.quantile(self.predict(x)[2], 0.01))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and the winner's margin of each row."""
        sure = lambda m: 1 / (1 + np.exp(-np.clip(6 * m, -50, 50)))
        n, score, own = len(x), np.ones(len(x)), np.zeros(len(x))
        if self.top:
            margins = np.stack([x @ w[:-1] + w[-1] for w in self.top.values()], 1)
            best = margins.argmax(1)
            others, own = np.sort(margins, 1)[:, -2], margins.max(1)
            score = sure((margins[np.arange(n), best] - others) / 2)
        else:
            best = np.zeros(n, int)
        lang = np.zeros(n, int)
        for f, name in enumerate(self.families):
            mine, rows = [i for i, g in enumerate(self.family) if g == name], np.flatnonzero(best == f)
            votes, belief, lead = (np.zeros((len(rows), len(mine))) for _ in range(3))
            for (a, b), w in self.pairs.items():
                if a in mine and b in mine:
                    m = x[rows] @ w[:-1] + w[-1]
                    for k, s in ((mine.index(a), m), (mine.index(b), -m)):
                        votes[:, k] += s > 0
                        belief[:, k] += sure(s)
                        lead[:, k] = np.maximum(lead[:, k], s)
            win = (votes + belief / (len(mine) + 1)).argmax(1)
            lang[rows] = np.array(mine)[win]
            if not self.top:
                own[rows] = lead[np.arange(len(rows)), win]
            if len(mine) > 1:
                score[rows] *= belief[np.arange(len(rows)), win] / (len(mine) - 1)
        return lang, score, own


def _sparse(texts: list[bytes], bits: int) -> list[bytes]:
    """The feature vectors as bytes: columns, then values."""
    out = []
    for row in features(texts, bits):
        cols = np.flatnonzero(row)
        out.append(cols.astype("<u4").tobytes() + row[cols].astype("<f4").tobytes())
    return out


def _dense(packed: list[bytes], bits: int) -> np.ndarray:
    x = np.zeros((len(packed), 1 << bits), np.float32)
    for i, b in enumerate(packed):
        n = len(b) // 8
        x[i, np.frombuffer(b, "<u4", n)] = np.frombuffer(b, "<f4", n, 4 * n)
    return x


def train(docs: DataFrame, per_lang: int = PER_LANG, bits: int = BITS, max_langs: int = MAX_LANGS) -> Model:
    """Learns from at most per_lang rows of each language, none of them held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    langs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).select("lang")
    picked = least_rows(rows.join(F.broadcast(langs), "lang", "left_semi"), "lang", per_lang)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b, texts in chunks(pdf["text"].tolist()):
                yield pdf.iloc[a:b][["lang", "doc_id"]].assign(x=_sparse(texts, bits))

    found = rows.join(F.broadcast(picked), ["lang", "doc_id"]).mapInPandas(run, "lang string, doc_id long, x binary")
    got = found.groupBy("lang", "doc_id").agg(F.min("x").alias("x")).orderBy("lang", "doc_id").collect()
    names = sorted({r["lang"] for r in got})
    return Model(names, _dense([r["x"] for r in got], bits), np.array([names.index(r["lang"]) for r in got])) if got else Model([])


def _identified(docs: DataFrame, model: Model | None, bits: int) -> DataFrame:
    """doc_id, text_key, held_out, lang_pred, score, known for every row of docs."""
    model = model or train(docs, bits=bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b, texts in chunks(pdf["text"].tolist()):
                for s in range(0, b - a, 512):
                    t = pdf["text"].iloc[a + s : min(a + s + 512, b)]
                    lettered = np.array([isinstance(v, str) and any(map(str.isalpha, v)) for v in t])
                    lang, score, known = np.array(["und"] * len(t), object), np.zeros(len(t)), np.zeros(len(t), bool)
                    if model.langs and lettered.any():
                        got, sure, own = model.predict(features([r for r, ok in zip(texts[s : s + 512], lettered) if ok], bits))
                        lang[lettered] = [model.langs[i] for i in got]
                        shown = np.minimum(1.0, [len(v) / SHORT for v, ok in zip(t, lettered) if ok])
                        score[lettered], known[lettered] = sure, own >= model.floor * shown
                    same = slice(a + s, a + s + len(t))
                    yield pd.DataFrame({
                        "doc_id": id_slice(pdf, "doc_id", a + s, a + s + len(t)), "text_key": pdf["text_key"].iloc[same].to_numpy(np.int64),
                        "held_out": pdf["held_out"].iloc[same].to_numpy(bool), "lang_pred": lang, "score": score, "known": known,
                    })

    rows = docs.select(*whole_id("doc_id"), "text", F.xxhash64("text").alias("text_key"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, text_key long, held_out boolean, lang_pred string, score double, known boolean")


def identify(docs: DataFrame, model: Model | None = None, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known for every row of docs."""
    return _identified(docs, model, bits).drop("text_key")


def keep_identified(docs: DataFrame, model: Model | None = None, bits: int = BITS) -> DataFrame:
    """The rows of docs whose language is known; all columns as they were."""
    return without(docs, _identified(docs, model, bits).where("not known"))
