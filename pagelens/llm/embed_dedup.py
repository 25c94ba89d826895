"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance B = 2 (1 - c). The vectors are rotated by
a fixed random rotation, which spreads their length evenly, and cut into blocks of a few
dimensions. If two vectors are within B, then in one block at least their squared distance is
within that block's share of B (in proportion to its dimensions). Each block is range-joined: along
each of its axes bitmaps mark the vectors below each quantile, so that those within the block's radius
on all axes are an intersection of bitmaps; only they get a block distance. A pair belongs to the first
block that brings it within budget, which makes the union of the blocks' candidates free of repeats;
it is then tested exactly by its cosine in double precision.

A task is a pair of sub-blocks of `SUB_BLOCK` vectors of one label, for all blocks. Dealing vectors to
grid cells first doesn't pay: at this radius a block of eight coordinates differs by about the radius on
each axis, so neighbouring cells of any few axes hold most of the label, once for every block. The work
so grows with the square of a label's size, with a small constant: about a hundredth of the pairs of
vectors spread over the sphere gets the distance of a block. Equal vectors are one node with a count.
Tasks return link counts and a spanning forest of the links that they found, never the pairs.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, and a
vector with a null label, links with nothing: n_links 0, component_id its own vec_id. Vectors of
different lengths don't link. Repeated rows are vectors like others. A null vec_id is kept; its
component_id is the least vec_id of its component, if any. Labels may be of any plain type and are
compared as they are. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import partitions, pulled
from pagelens.llm.components import components
from pagelens.llm.ngram_join import _Union
from pagelens.scratch import stored

COSINE, BLOCKS, SUB_BLOCK, SLACK = 0.93, 8, 4096, 1e-9


@cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _cuts(dim: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dim, min(blocks, dim) + 1).astype(int)


def rotated(raw: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated. einsum: each row's result is the same whatever rows stand beside it."""
    unit = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
    return np.einsum("ij,jk->ik", unit, rotation(raw.shape[1]))


def valid(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(~F.exists(vector, bad) & some, F.lit(False))


class Ranges:
    """Points under a bitmap for each axis and quantile: those below it."""

    def __init__(self, points: np.ndarray, quantiles: int = 64):
        n = len(points)
        self.step = max(1, -(-n // quantiles))
        self.values, self.below = [], []
        for axis in points.T:
            order = np.argsort(axis, kind="stable")
            rank = np.empty(n, int)
            rank[order] = np.arange(n)
            self.values.append(axis[order])
            self.below.append(np.packbits(rank[None] < (np.arange(-(-n // self.step) + 1) * self.step)[:, None], axis=1))

    def near(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, point) for the points within about radius on every axis, none within it missed."""
        met = None
        for values, below, at in zip(self.values, self.below, x.T):
            low = np.searchsorted(values, at - radius, "left") // self.step
            high = -(-np.searchsorted(values, at + radius, "right") // self.step)
            some = below[high] & ~below[low]
            met = some if met is None else met & some
        row, byte = np.nonzero(met)
        i, bit = np.nonzero(np.unpackbits(met[row, byte][:, None], axis=1))
        return row[i], byte[i] * 8 + bit


def _join(rows: pd.DataFrame, lo: int, hi: int, cosine: float, blocks: int, tests: list[int] | None = None) -> list[tuple]:
    """Links of one task: (node, links, other); other is null in counts, links 0 in forest edges.
    tests gets the number of block distances of each step."""
    dim = int(rows["dim"].iloc[0])
    raw = np.stack([np.frombuffer(v, f"<f{len(v) // dim}") for v in rows["raw"]]).astype(np.float64)
    x, cuts = rotated(raw), _cuts(dim, blocks)
    norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    budget = 2 * (1 - cosine) * np.diff(cuts) / dim + SLACK
    sub, node, mult = rows["sub"].to_numpy(), rows["node"].to_numpy(), rows["mult"].to_numpy(np.int64)
    links, uf, forest = np.zeros(len(rows), np.int64), _Union(), []

    def verify(p: np.ndarray, q: np.ndarray, b: int) -> None:
        gap = (x[p] - x[q]) ** 2
        own = ~(np.add.reduceat(gap, cuts[:-1], axis=1)[:, :b] <= budget[:b]).any(1)
        p, q = p[own], q[own]
        ok = np.einsum("ij,ij->i", raw[p], raw[q]) / (norm[p] * norm[q]) >= cosine
        p, q = p[ok], q[ok]
        np.add.at(links, p, mult[q])
        np.add.at(links, q, mult[p])
        forest.extend((s, t) for s, t in zip(p.tolist(), q.tolist()) if uf.join(s, t))

    left, right = np.flatnonzero(sub == lo), np.flatnonzero(sub == hi)
    for b in range(len(budget) if len(left) and len(right) else 0):
        mine = x[:, cuts[b] : cuts[b + 1]]
        index = Ranges(mine[right])
        for at in range(0, len(left), 256):
            a = left[at : at + 256]
            p, q = index.near(mine[a], np.sqrt(budget[b]) + 1e-7)
            if lo == hi:
                later = p + at < q
                p, q = p[later], q[later]
            p, q = a[p], right[q]
            if tests is not None:
                tests.append(len(p))
            for k in range(0, len(p), 1 << 16):
                s, t = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                within = ((mine[s] - mine[t]) ** 2).sum(1) <= budget[b]
                verify(s[within], t[within], b)
    out = [(int(node[i]), int(links[i]), None) for i in np.flatnonzero(links)]
    return out + [(int(node[s]), 0, int(node[t])) for s, t in forest]


def near_pairs(nodes: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """node, links, other: see _join. nodes: node, label (string), embedding, mult."""
    spark = nodes.sparkSession
    keyed = nodes.select("node", F.concat_ws(":", F.size("embedding"), "label").alias("at"))
    full = keyed.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "n", F.ceil(F.col("n") / SUB_BLOCK).cast("int").alias("parts"))
    deal = pulled(keyed, full, "at", keyed.count(), F.concat(F.lit("-"), F.col("node").cast("string"))).where("parts is not null")
    deal = deal.withColumn("sub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    deal = deal.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.least("sub", "j"), F.greatest("sub", "j")
    task = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("at"), F.lit(8 * partitions(spark)))).otherwise(F.xxhash64("at", lo, hi))
    deal = deal.select("node", "at", "sub", lo.alias("lo"), hi.alias("hi"), task.alias("task"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(dim=pdf["embedding"].map(len), embedding=[v.tobytes() for v in pdf["embedding"]]).rename(columns={"embedding": "raw"})

    raw = nodes.select("node", "mult", "embedding").mapInPandas(packed, "node long, mult long, dim int, raw binary")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, lo, hi), g in pdf.groupby(["at", "lo", "hi"], sort=False):
            out += _join(g, int(lo), int(hi), cosine, blocks)
        node, links, other = zip(*out) if out else ((), (), ())
        # from integers to Int64 directly: by way of floats, node ids would lose digits
        return pd.DataFrame({"node": pd.array(node, "int64"), "links": pd.array(links, "int64"), "other": pd.array(list(other), "Int64")})

    return deal.join(raw, "node").groupBy("task").applyInPandas(run, "node long, links long, other long")


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    good = valid(F.col("embedding")) & F.col("label").isNotNull()
    rows = vectors.select("vec_id", "embedding", F.when(good, F.col("label").cast("string")).alias("label"), F.when(good, F.xxhash64(F.col("label").cast("string"), "embedding")).alias("node"))
    nodes = stored(rows.where("node is not null").groupBy("node", "label", "embedding").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("first")), "nodes")
    found = stored(near_pairs(nodes, cosine, blocks), "found")
    comp = stored(components(found.where("other is not null"), "node", "other"), "components")
    n_links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "first", "mult").join(n_links, "node", "left").join(comp, "node", "left")
    known = stored(known.select("node", "first", "mult", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "known")
    roots = known.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    known = pulled(known, roots, "root", known.count(), F.xxhash64("node")).select("node", F.col("mult").alias("n"), "least", (F.col("links") + F.col("mult") - 1).alias("n_links"))
    ids = pulled(rows.select("vec_id", "node"), stored(known, "linked"), "node", rows.count(), F.xxhash64("vec_id"))
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return ids.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
