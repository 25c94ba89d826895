"""Helpers shared by the corpus operators: joins of hot keys, word columns, numpy word hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.scratch import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the n-gram and mixing contracts, as a Java character class.
SPACE = r"[\x20\x09-\x0D]+"
#: Everything that is not a word character of the decontamination contract.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def fresh(taken: list[str], name: str) -> str:
    """A column name that isn't taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def is_small(df: DataFrame, size: Column, limit: int) -> bool:
    """Whether the rows of df, of `size` bytes each, have at most `limit` bytes together."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def pulled(rows: DataFrame, small: DataFrame, key: str, total: int, spread: Column, limit: int = 1000) -> DataFrame:
    """rows left-joined with small (key, n, further columns), n being the rows of a key and total those
    of all. Keys with over total / limit rows, at most `limit` by arithmetic, come by broadcast to
    where their rows are; the others are shuffled, so no key brings a task more than that."""
    bound = max(1000, -(-total // limit))
    values = [c for c in small.columns if c not in (key, "n")]
    packed = small.select(key, "n", F.struct(*values).alias("_v"))
    hot = packed.where(F.col("n") > bound).select(F.col(key).alias("_hot_key"), F.col("_v").alias("_hot"))
    cold = packed.where(F.col("n") <= bound).select(F.col(key).alias("_cold_key"), F.col("_v").alias("_cold"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    out = out.withColumn("_at", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spread))
    out = out.join(cold, F.col("_at") == F.col("_cold_key"), "left")
    got = F.coalesce("_hot", F.when(F.col(key).isNotNull(), F.col("_cold")))
    return out.withColumn("_got", got).select(*rows.columns, *[F.col("_got")[c].alias(c) for c in values])


def without(docs: DataFrame, lost: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """The rows of docs whose (doc_id, text) isn't among lost (doc_id, text_key); all columns as they
    were. Only keys travel if they are below `limit` bytes; beyond it both sides are shuffled."""
    doc, key = (fresh(docs.columns, c) for c in ("lost_doc", "lost_key"))
    lost = stored(lost.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct(), "lost")
    on = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key))
    return docs.join(F.broadcast(lost) if is_small(lost, F.lit(40), limit) else lost, on, "left_anti")


def least_rows(rows: DataFrame, key: str, count: int) -> DataFrame:
    """key, doc_id: of each key at most `count` distinct doc_ids, those with the least hash. Keys are
    few. One count by key sets a bound on the hash that some 2 count + 100 ids pass; only they are
    ranked."""
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col(key).isNotNull()).select(key, "doc_id", share.alias("_h"))
    bound = rows.groupBy(key).agg((F.lit(2.0 * count + 100) / F.count(F.lit(1))).alias("_bound"))
    few = rows.join(F.broadcast(bound), key).where("_h <= _bound").select(key, "doc_id", "_h").distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_h", "doc_id"))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= count).select(key, "doc_id")


def whole_id(name: str) -> list[Column]:
    """An id and whether it is null, for pandas: a column of longs with nulls would turn to floats."""
    return [F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name), F.col(name).isNull().alias("no_id")]


def id_slice(pdf, name: str, a: int, b: int):
    """The ids of rows a to b of a frame that whole_id() selected."""
    return pd.arrays.IntegerArray(pdf[name].to_numpy(np.int64)[a:b].copy(), pdf["no_id"].to_numpy(bool)[a:b].copy())


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() has a fast path for pure ASCII; it would change other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column, gaps: str = NOT_WORD, lower: bool = True) -> Column:
    """Array of words between gaps; empty for null."""
    text = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(ascii_lower(text) if lower else text, gaps), "")


# ---------------------------------------------------------------- numpy word hashing

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        for key, base in (("p", _P), ("q", _P_INV)):
            step = np.full(n, base, dtype=np.uint64)
            step[0] = 1
            _powers[key] = np.cumprod(step, dtype=np.uint64)
    return _powers["p"][:n], _powers["q"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space words (A-Z lower-cased) of all texts, and words per text;
    bare: words are runs of letters and digits, and of bytes beyond ASCII.

    One pass over the joined bytes: with H the prefix sums of byte * P^i, a word's hash is
    (H[end] - H[start]) * P^-start modulo 2^64, finalised.
    """
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8).copy()
    buf[(buf >= 65) & (buf <= 90)] |= 0x20
    gap = (buf == 32) | ((buf >= 9) & (buf <= 13))
    if bare:
        gap = (buf < 128) & ~((buf >= 97) & (buf <= 122)) & ~((buf >= 48) & (buf <= 57))
    inside = ~gap
    starts = np.flatnonzero(inside & np.concatenate(([True], gap[:-1])))
    ends = np.flatnonzero(gap & np.concatenate(([False], inside[:-1])))
    p, q = _pow(len(buf))
    total = np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p, dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    got = (total[ends - 1] - before) * q[starts]
    got = mix64(got + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return got, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingle_hashes(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its `size`-word shingles; a shorter text is one
    shingle, a text without words has none."""
    hashes, counts = word_hashes(texts)
    mult = mix64(np.arange(1, size + 1, dtype=np.uint64) * _P) | np.uint64(1)
    n = len(hashes) - size + 1
    whole = np.zeros(max(n, 0), np.uint64)
    for j in range(size if n > 0 else 0):
        whole += hashes[j : j + n] * mult[j]
    whole = mix64(whole)
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            found = np.sort(whole[at : at + c - size + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif c:
            one = np.sum(hashes[at : at + c] * mult[:c], dtype=np.uint64) + np.uint64(c)
            out.append(mix64(np.array([one], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def chunks(texts: list[str | None], limit: int = 2 << 20):
    """(from, to, encoded texts) slices of at most about `limit` bytes; one text is never cut."""
    start, held, total = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if held and total + len(b) > limit:
            yield start, i, held
            start, held, total = i, [], 0
        held.append(b)
        total += len(b)
    if held:
        yield start, start + len(held), held
