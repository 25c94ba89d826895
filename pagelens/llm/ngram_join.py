"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two texts link when their sets of distinct five-word shingles have a Jaccard similarity of at
least 0.75. With T(x) = ceil(0.75 |x|), a partner of x shares at least T(x) shingles with it:

1. Inverted lists. Shingles are dealt by hash; every list's length (how many different sets hold
   the shingle) is counted over the whole corpus. Lists of length one are dropped.
2. A set with fewer than T(x) shingles in the lists that remain has no partner and leaves. What is
   left of it also bounds its partners' sizes.
3. DivideSkip's split with L = T(x) - 1 long lists: two partners meet in one of the remaining,
   shortest lists of x at least. In each of these short lists every set is tested exactly against
   the list's least set; the links found give a first partition.
4. Only lists with sets of several parts remain. Within the parts that they join, every set outside
   the largest part is searched by T-occurrence: its short lists are merged, the ids found are probed
   in its long lists by binary search, and those with the required overlap are links. Targets are
   dealt in blocks of `block_sets` sets and `block_bytes` at most, so no group has to fit a task.
5. Links give components. Equal sets are one node throughout, so copies never meet pairwise.

Defined results: null or word-free text has an empty set and links with nothing; its component is
its own doc_id. Rows that repeat a doc_id are kept row by row. A null doc_id is kept and its
component_id is the smallest non-null doc_id of its group, else null. Extra columns are ignored.
Sets are compared by 64-bit shingle hashes, all bits of which travel.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import chunks, id_slice, partitions, pulled, shingle_hashes, whole_id, without
from pagelens.llm.components import components
from pagelens.scratch import stored

SHINGLE = 5
POSTINGS = "bucket int, batch long, nodes binary, sizes binary, gaps binary, hashes binary, dfs binary"
LANES, WIRE = 256, 7
HEAP, CHUNK = 4096, 512 << 10  # bytes of text hashed at once: workers stay small


def needed(size):
    """T: the least overlap of a set of `size` shingles with any partner, ceil(3/4 size)."""
    return (3 * size + 3) // 4


def node_id(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_shingles, node (64-bit digest of the set; null for the empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b, texts in chunks(pdf["text"].tolist(), CHUNK):
                found = shingle_hashes(texts, size)
                yield pd.DataFrame({
                    "doc_id": id_slice(pdf, "doc_id", a, b),
                    "text_key": pdf["text_key"].iloc[a:b].to_numpy(np.int64),
                    "n_shingles": [len(x) for x in found],
                    "node": pd.array([node_id(x) if len(x) else None for x in found], dtype="Int64"),
                })

    rows = docs.select(*whole_id("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInPandas(run, "doc_id long, text_key long, n_shingles long, node long")


def _tight(values: np.ndarray) -> bytes:
    """Values in the narrowest unsigned integers that hold the largest."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _bytes(hashes: np.ndarray, width: int) -> bytes:
    """The `width` low bytes of each hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _rows(key: np.ndarray, batch: np.ndarray, idx: np.ndarray, hashes: np.ndarray, dfs: np.ndarray | None, width: int) -> list[tuple]:
    """One row for each key and batch, postings by idx, the set's number in its batch (as gaps)."""
    order = np.lexsort((idx, batch, key))
    key, batch, idx, hashes = key[order], batch[order], idx[order].astype(np.int64), hashes[order]
    dfs = None if dfs is None else np.minimum(dfs[order], 65535).astype(np.uint16)
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (batch[1:] != batch[:-1]))) if len(key) else np.empty(0, bool)
    cuts = np.flatnonzero(new).tolist()
    return [
        (int(key[a]), int(batch[a]), b"", b"", _tight(np.diff(idx[a:b], prepend=0)), _bytes(hashes[a:b], width), b"" if dfs is None else dfs[a:b].tobytes())
        for a, b in zip(cuts, [*cuts[1:], len(key)])
    ]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "batch", "nodes", "sizes", "gaps", "hashes", "dfs"])


def _unpacked(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """batch, idx, hash, df of all postings."""
    counts = [len(h) // width for h in pdf["hashes"]]
    idx = [np.cumsum(np.frombuffer(g, f"u{len(g) // n}"), dtype=np.uint32) for g, n in zip(pdf["gaps"], counts)]
    whole = np.zeros((sum(counts), 8), np.uint8)
    whole[:, :width] = np.frombuffer(b"".join(pdf["hashes"]), np.uint8).reshape(-1, width)
    dfs = np.frombuffer(b"".join(pdf["dfs"]), np.uint16)
    batch = np.repeat(pdf["batch"].to_numpy(np.int64), counts)
    return batch, np.concatenate(idx) if idx else np.empty(0, np.uint32), whole.view("<u8").ravel(), dfs


def shared_postings(docs: DataFrame, buckets: int, size: int = SHINGLE) -> DataFrame:
    """Postings of the shingles that two or more sets hold, with each list's length, dealt by batch;
    and for each batch the nodes and sizes of its sets. Stage 1 of the module's outline.

    Postings are dealt by lane, the top byte of the hash, and by some of the next bits where there
    are more buckets than lanes; the other seven bytes and the set's number within its batch of texts
    travel. Batches of the same sets (runs of copies, a table read twice) have the same name and the
    same rows; one of each stays. A list's length counts a set once per batch that holds it; it is cut
    at 65535. It orders lists, in the same way for all sets, and only lists of length one are dropped."""
    parts = max(1, -(-buckets // LANES))
    dealt_to = lambda h: (h >> np.uint64(56)) * np.uint64(parts) + ((h >> np.uint64(40)) & np.uint64(0xFFFF)) % np.uint64(parts)

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, _, texts in chunks(pdf["text"].tolist(), CHUNK):
                found = {node_id(x): x for x in shingle_hashes(texts, size) if len(x)}
                if found:
                    nodes = np.array(list(found), np.int64)
                    lens = np.array([len(x) for x in found.values()], np.int32)
                    name = node_id(nodes)
                    hashes = np.concatenate(list(found.values()))
                    rows = _rows(dealt_to(hashes), np.full(len(hashes), name), np.repeat(np.arange(len(lens)), lens), hashes, None, WIRE)
                    yield _frame([*rows, (name % (LANES * parts), name, nodes.tobytes(), lens.tobytes(), b"", b"", b"")])

    def lengths(pdf: pd.DataFrame) -> pd.DataFrame:
        lane = np.uint64(int(pdf["bucket"].iloc[0]) // parts)
        table = pdf["nodes"].map(len) > 0
        once = ~pd.DataFrame({"batch": pdf["batch"], "table": table}).duplicated()
        pdf, table = pdf[once], table[once]
        batch, idx, hashes, _ = _unpacked(pdf[~table], WIRE)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        again = hashes[1:] == hashes[:-1]
        keep = np.concatenate((again, [False])) | np.concatenate(([False], again)) if len(hashes) else np.empty(0, bool)
        order, hashes = order[keep], hashes[keep]
        _, run, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        batch = batch[order]
        rows = _rows(np.mod(batch, buckets), batch, idx[order], hashes | (lane << np.uint64(56)), counts[run], 8)
        tables = pdf[table].assign(bucket=np.mod(pdf.loc[table, "batch"], buckets))
        return _frame([*rows, *tables.itertuples(index=False, name=None)])

    dealt = docs.select("text").mapInPandas(lists, POSTINGS)
    return dealt.groupBy("bucket").applyInPandas(lengths, POSTINGS)


def candidates(postings: DataFrame) -> DataFrame:
    """node, size, most (the largest size of a partner), prefix (its short lists' shingles), members
    (all its shared shingles): the sets with at least T shared shingles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, one in pdf.groupby("batch", sort=False):
            table = one["nodes"].map(len) > 0
            if table.all():
                continue
            nodes, sizes = (np.frombuffer(one.loc[table, c].iloc[0], t) for c, t in (("nodes", np.int64), ("sizes", np.int32)))
            _, idx, hashes, dfs = _unpacked(one[~table], 8)
            order = np.lexsort((hashes, dfs, idx))
            idx, hashes = idx[order], hashes[order]
            cuts = np.flatnonzero(np.concatenate(([True], idx[1:] != idx[:-1]))).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(idx)]):
                s = int(sizes[idx[a]])
                if b - a >= needed(s):
                    mine = hashes[a:b]
                    most = min(7 * (b - a) // 3 - s, 4 * s // 3)  # 7 overlap >= 3 (a + b)
                    rows.append((int(nodes[idx[a]]), s, most, mine[: b - a - needed(s) + 1].astype(np.int64), mine.astype(np.int64)))
        return pd.DataFrame(rows, columns=["node", "size", "most", "prefix", "members"])

    found = postings.groupBy("bucket").applyInPandas(run, "node long, size int, most int, prefix array<long>, members array<long>")
    return found.dropDuplicates(["node"])


class _Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up.setdefault(up[x], up[x])
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _merged(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids on at least `least` of the lists, each sorted, and on how many: a merge by a heap; of very
    many postings by numpy, which gives the same."""
    if sum(map(len, lists)) <= HEAP:
        runs = [(i, sum(1 for _ in same)) for i, same in groupby(heapq.merge(*[x.tolist() for x in lists]))]
        found, count = (np.array(v, np.int64) for v in (zip(*runs) if runs else ((), ())))
    else:
        found, count = np.unique(np.concatenate(lists), return_counts=True)
    return found[count >= least], count[count >= least]


class Index:
    """Inverted lists of sets: for each shingle the numbers of the sets that hold it, in order. With
    the sets in order of size, a range of numbers is a range of sizes."""

    def __init__(self, sets: list[np.ndarray]):
        self.words, inv = np.unique(np.concatenate(sets) if sets else np.empty(0, np.int64), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(inv, kind="stable")
        self.held, self.start = owner[order], np.searchsorted(inv[order], np.arange(len(self.words) + 1))

    def search(self, mine: np.ndarray, least: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """DivideSkip: of the sets low .. high - 1 those that share at least `least` shingles with
        `mine`, and how many."""
        spot = np.minimum(np.searchsorted(self.words, mine), max(0, len(self.words) - 1))
        spot = spot[self.words[spot] == mine] if len(self.words) else spot[:0]
        if len(spot) < least:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lists = []
        for i in spot:
            one = self.held[self.start[i] : self.start[i + 1]]
            a, b = np.searchsorted(one, (low, high))
            if a < b:
                lists.append(one[a:b])
        if len(lists) < least:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lists.sort(key=len)
        probed = min(least - 1, int(least / (0.01 * np.log2(len(lists[-1]) + 1) + 1)))
        found, count = _merged(lists[: len(lists) - probed], least - probed)
        for k, one in enumerate(lists[len(lists) - probed :]):
            at = np.minimum(np.searchsorted(one, found), len(one) - 1)
            count = count + (one[at] == found)
            alive = count + (probed - k - 1) >= least
            found, count = found[alive], count[alive]
            if not len(found):
                break
        return found, count


def tested(pairs: DataFrame, cands: DataFrame) -> DataFrame:
    """The pairs (a, b) with Jaccard >= 0.75. b may be hot: its set is copied for every 512 of its pairs."""
    copies = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("copies", F.ceil(F.col("n") / 512).cast("int"))
    right = cands.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("members").alias("members_b")).join(copies.drop("n"), "b")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    left = pulled(pairs, copies, "b", pairs.count(), F.xxhash64("a", "b")).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).select("a", "b", "salt")
    left = left.join(cands.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("members").alias("members_a")), "a")

    both = left.join(right.drop("copies"), ["b", "salt"])
    overlap = F.size(F.array_intersect("members_a", "members_b"))
    return both.where(7 * overlap >= 3 * (F.col("size_a") + F.col("size_b"))).select("a", "b")  # 100 i >= 75 (a + b - i)


def links(cands: DataFrame, block_bytes: int = 24 << 20, block_sets: int = 1024) -> DataFrame:
    """(a, b) node pairs with Jaccard >= 0.75 that connect all such pairs. Stages 3 and 4."""
    spark = cands.sparkSession
    short = stored(cands.select("node", "size", "most", F.explode("prefix").alias("shingle")), "short")
    total = short.count()
    lists = short.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("size", "node"))["node"].alias("pivot"), F.min("size").alias("low"), F.max("most").alias("high")).where("n > 1")
    meet = pulled(short, lists, "shingle", total, F.xxhash64("node", "shingle"))
    meet = stored(meet.where("pivot is not null and most >= low and size <= high").select("shingle", "node", "pivot", "size", "most"), "meet")
    pairs = stored(meet.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    sure = stored(tested(pairs, cands), "sure")
    parts = stored(components(sure, "a", "b"), "parts")
    rooted = meet.select("shingle", "node").join(parts, "node", "left").select("shingle", "node", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    mixed = rooted.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_ = pulled(rooted, mixed, "shingle", total, F.xxhash64("node", "shingle")).where("low is not null").select("node", "root", "low")
    open_ = stored(open_.distinct(), "open")
    groups = stored(components(open_.select("root", "low").distinct(), "root", "low").withColumnRenamed("root", "grp"), "groups")
    nodes = open_.select("node", F.col("root").alias("part")).distinct()
    held = stored(nodes.join(groups, F.col("part") == groups["node"]).select(nodes["node"], "part", "grp"), "held")
    return sure.unionByName(_searched(held, cands, block_bytes, block_sets, 4 * partitions(spark)))


def _searched(held: DataFrame, cands: DataFrame, block_bytes: int, block_sets: int, tasks: int) -> DataFrame:
    """Links between different parts of each group: all sets outside the group's largest part are
    queries against all its sets, these in blocks."""
    sets = stored(held.join(cands.select("node", "size", "most", "members"), "node"), "sets")
    weight = lambda: F.sum(8 * F.size("members") + 64)
    by_part = sets.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("sets"), weight().alias("bytes"))
    group = by_part.groupBy("grp").agg(F.sum("sets").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("bytes", "sets", "part")).alias("main"))
    blocks = lambda n, b: F.greatest(F.lit(1), F.ceil(b / block_bytes), F.ceil(n / block_sets)).cast("int")
    asking = blocks(F.col("n") - F.col("main.sets"), F.col("bytes") - F.col("main.bytes"))
    group = group.select("grp", "n", blocks(F.col("n"), F.col("bytes")).alias("t"), asking.alias("q"), F.col("main.part").alias("main"))
    dealt = pulled(sets, group, "grp", sets.count(), F.xxhash64("node"))
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    targets = dealt.withColumn("ti", at("t")).withColumn("qi", every("q")).withColumn("asks", F.lit(False))
    queries = dealt.where("part <> main").withColumn("qi", at("q")).withColumn("ti", every("t")).withColumn("asks", F.lit(True))
    alone = (F.col("t") == 1) & (F.col("q") == 1)
    task = F.struct(F.when(alone, F.pmod(F.xxhash64("grp"), F.lit(tasks))).otherwise(F.col("grp")).alias("g"), F.when(alone, -1).otherwise(F.col("ti")).alias("t"), F.when(alone, -1).otherwise(F.col("qi")).alias("q"))
    dealt = targets.unionByName(queries).select(task.alias("task"), "grp", "node", "part", "size", "most", "members", "asks")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("grp", sort=False):
            asks = g["asks"].to_numpy(bool)
            t, q = g[~asks].sort_values("size", kind="stable"), g[asks]
            index = Index(t["members"].tolist())
            size, part, node = (t[c].to_numpy(np.int64) for c in ("size", "part", "node"))
            joined = _Union()
            low, high = (np.searchsorted(size, needed(q["size"].to_numpy(np.int64)), "left"), np.searchsorted(size, q["most"], "right"))
            for (n, p, s, m), a, b in zip(q[["node", "part", "size", "members"]].itertuples(index=False, name=None), low.tolist(), high.tolist()):
                found, overlap = index.search(m, needed(s), a, b)
                ok = (7 * overlap >= 3 * (s + size[found])) & (part[found] != p)
                out += [(n, int(node[y])) for y in found[ok].tolist() if joined.join(p, int(part[y]))]
        return pd.DataFrame(out, columns=["a", "b"])

    return dealt.groupBy("task").applyInPandas(run, "a long, b long")


def grouped(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_shingles, first (no_id, doc_id, text_key of the first document of its
    component, ids in order, null last; null for empty sets) for every row of docs."""
    spark = docs.sparkSession
    sets = stored(shingle_sets(docs, size), "sets")
    cands = stored(candidates(shared_postings(docs, partitions(spark), size)), "candidates")
    comp = stored(components(links(cands), "a", "b"), "components")
    mine = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = sets.where("node is not null").groupBy("node").agg(F.min(mine).alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = stored(nodes.join(comp, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root")), "nodes")
    roots = nodes.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = pulled(nodes.select("node", F.col("n").alias("copies"), "first", "root"), roots, "root", nodes.count(), F.xxhash64("node"))
    least = least.select("node", F.col("copies").alias("n"), F.coalesce("least", "first").alias("first")).where("n > 1 or least is not null")
    least = least.select("node", "n", "first")
    rows = pulled(sets, stored(least, "least"), "node", sets.count(), F.xxhash64("doc_id", "text_key"))
    return rows.withColumn("first", F.when(F.col("node").isNotNull(), F.coalesce("first", mine)))


def ngram_join(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text, ...)."""
    return grouped(docs, size).select("doc_id", "n_shingles", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The first document of each component and those without words; all columns as they were. The
    first has the least doc_id, ids before nulls, and of rows that share it the least digest of the
    text: rows are decided by id and text, so a repeated id loses no text that no other row stands
    for. Rows equal in both stay together."""
    lost = grouped(docs, size).where("first is not null and not (doc_id <=> first.doc_id and text_key = first.text_key)")
    return without(docs, lost)
