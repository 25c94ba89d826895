from __future__ import annotations

import json

import duckdb
import numpy as np
import pytest

from pagelens.llm import chat, embed_dedup, mixing
from pagelens.llm.queries import ORACLE, QUERIES
from tests.test_catalog import TABLES, rows


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, small, db):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(db.execute(ORACLE[name]).df())


def test_all_ten_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


# ---------------------------------------------------------------- embeddings


def brute_embeddings(vectors):
    n = len(vectors)
    links, root = [0] * n, list(range(n))

    def good(v):
        return v[1] is not None and v[2] is not None and len(v[1]) and all(x is not None and np.isfinite(x) for x in v[1]) and any(v[1])

    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(np.array(v[1], np.float32), np.float64) for v in (a, b))
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    p, q = root[i], root[j]
                    root = [min(p, q) if r in (p, q) else r for r in root]
    return {v[0]: (links[i], vectors[root[i]][0], root[i] == i) for i, v in enumerate(vectors)}


@pytest.mark.parametrize("sub_block", [2048, 3])
def test_embeddings_equal_brute_force(spark, monkeypatch, sub_block):
    monkeypatch.setattr(embed_dedup, "SUB_BLOCK", sub_block)
    rng = np.random.default_rng(2)
    vectors = []
    for c in range(12):
        centre = rng.standard_normal(32)
        vectors += [(0, (centre + rng.standard_normal(32) * s).tolist(), c % 2) for s in rng.uniform(0.1, 0.5, 9)]
    one = vectors[0][1]
    vectors += [(0, one, 0)] * 4 + [(0, [2 * x for x in one], 0), (0, one, None), (0, None, 0), (0, [0.0] * 32, 0), (0, [float("nan")] * 32, 0), (0, [None] * 32, 0), (0, [], 0), (0, [float("inf")] + one[1:], 0), (0, one[:8], 0), (0, one[:8], 0), (0, [3.0], 1), (0, [4.0], 1)]
    vectors = [(i, v, label) for i, (_, v, label) in enumerate(vectors)]
    table = spark.createDataFrame([(*v, 1, 2, 3) for v in vectors], "vec_id long, embedding array<float>, label int, node long, mult long, block int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_dedup(table).collect()}
    assert got == brute_embeddings(vectors)


def test_embeddings_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embed_dedup.embedding_dedup(spark.createDataFrame([], schema)).count() == 0
    got = sorted((tuple(r) for r in embed_dedup.embedding_dedup(spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, None, 1)], schema)).collect()), key=repr)
    assert got == sorted([(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, False)], key=repr)


def test_block_distances_are_few():
    """On vectors without any structure: no more than a tenth of all pairs get a block distance."""
    import pandas as pd

    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64)).astype("<f4")
    rows = pd.DataFrame({"node": np.arange(3000), "mult": 1, "raw": [v.tobytes() for v in x], "dim": 64, "sub": 0})
    tests = []
    embed_dedup._join(rows, 0, 0, 0.93, 8, tests)
    assert 0 < sum(tests) <= 0.1 * 3000 * 2999 / 2, sum(tests) / (3000 * 2999 / 2)


@pytest.mark.parametrize("kind, labels", [("long", [2**40, 2**40 + 2**32, 2**40]), ("string", ["a", "A", "a"]), ("boolean", [True, False, True])])
def test_labels_of_any_type(spark, kind, labels):
    table = spark.createDataFrame([(i, [1.0, 2.0], v) for i, v in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}")
    assert sorted(map(tuple, embed_dedup.embedding_dedup(table).collect())) == [(0, 1, 0, True), (1, 0, 1, True), (2, 1, 0, False)]


# ---------------------------------------------------------------- mixing


def test_targets_fill_and_reshare(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 10), (None, 1000), ("é", 5)]
    t = {r.source: r for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    assert t["a"].target == 30 and t["c"].target == 30 and t["é"].target == 1 * 15
    assert t["b"].target == pytest.approx((2025 - 75) * 2 / 4) and t[None].target == pytest.approx((2025 - 75) * 2 / 4)


def test_apportionment_is_sainte_lague(spark):
    import heapq

    for claims, seats in (([53.0, 24.0, 23.0], 7), ([1.0, 1.0, 1.0], 4), ([100.0, 1.0, 0.0], 10), ([7.0] * 30, 11), ([0.3, 99.7], 1)):
        table = spark.createDataFrame([(i, c, seats) for i, c in enumerate(claims)], "pos long, claim double, seats long")
        got = [r.quota for r in mixing.apportion(table, [], "claim", "seats", ["pos"]).orderBy("pos").collect()]
        quota = [0] * len(claims)
        heap = [(-c, i) for i, c in enumerate(claims) if c > 0]
        heapq.heapify(heap)
        for _ in range(seats):
            _, i = heapq.heappop(heap)
            quota[i] += 1
            heapq.heappush(heap, (-claims[i] / (2 * quota[i] + 1), i))
        assert got == quota


def test_mix(spark):
    rows_ = [(i, "w " * (20 + i % 50), f"s{i % 4}" if i % 9 else None, 7, 8) for i in range(1500)]
    rows_ += [(None, "x y", "s0", 1, 1), (1, "w " * 21, "s1", 1, 1), (1, "w " * 21, "s1", 1, 1), (7000, None, "s0", 1, 1), (7001, "", "tiny", 1, 1), (7002, "b " * 30000, "s2", 1, 1)]
    table = spark.createDataFrame(rows_, "doc_id long, text string, source string, size long, target long")
    got = mixing.mix(table).collect()
    assert len(got) == len(rows_) and all(0 <= r.taken <= 3 * r.size for r in got)
    source = {r[0]: r[2] for r in rows_}
    for s in {*source.values()}:
        mine = [r for r in got if source[r.doc_id] == s]
        assert sum(r.size for r in mine) == mine[0].source_size and abs(sum(r.taken for r in mine) - mine[0].target) <= 64
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    again = mixing.mix(table.repartition(7)).collect()
    assert sorted(got, key=key) == sorted(again, key=key)
    assert mixing.mix(table.limit(0)).count() == 0 and mixing.mixed(table.limit(0)).count() == 0
    small_groups = mixing.mix(table, shard_docs=16, group=4).collect()
    for s in {*source.values()}:
        mine = [r for r in small_groups if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 64 and all(0 <= r.taken <= 3 * r.size for r in mine)
    full = {s for s in {*source.values()} for r in got if source[r.doc_id] == s and r.target == 3 * r.source_size}
    assert full and all(r.taken == 3 * r.size for r in got if source[r.doc_id] in full)
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect())


def test_apportionment_with_rooms(spark):
    claims = [(0, 40.0, 10, 3), (1, 30.0, 10, 9), (2, 20.0, 10, 9), (3, 10.0, 10, 9)]
    table = spark.createDataFrame(claims, "pos long, claim double, seats long, room long")
    got = [r.quota for r in mixing.apportion(table, [], "claim", "seats", ["pos"], "room").orderBy("pos").collect()]
    assert got[0] == 3 and sum(got) == 10 and got == [3, 4, 2, 1]


def test_mixture_holds_the_words_taken(spark):
    rows_ = [(i, " ".join(f"w{i}x{k}" for k in range(10 + i % 90)), f"s{i % 4}", 1, 2) for i in range(400)] + [(900, None, "s0", 1, 2), (901, "only one", "z", 1, 2), (5, "other text", "s1", 1, 2)]
    table = spark.createDataFrame(rows_, "doc_id long, text string, source string, size long, Taken long")
    want = {(r.doc_id, r.size): r.taken for r in mixing.mix(table).collect()}
    out = mixing.mixed(table)
    assert out.columns == [*table.columns, "size_", "source_size", "target", "taken_", "passes"]
    got = out.collect()
    texts = {(r[0], r[1]) for r in rows_}
    assert {(r.doc_id, r.size_) for r in got} == {k for k, v in want.items() if v}
    for r in got:
        assert len(r.text.split()) == r.taken_ == want[r.doc_id, r.size_] and r.size == 1
        whole = next(t for i, t in texts if i == r.doc_id and len(t.split()) == r.size_)
        assert set(r.text.split()) <= set(whole.split()) and (not r.passes or whole in r.text)


# ---------------------------------------------------------------- chat


def test_levels_and_cycles(spark):
    calls = [("a", "b"), ("b", "a"), ("c", "a"), ("d", None), ("e", "d"), ("f", "e"), ("g", "gone"), ("h", "h"), *[(f"n{i}", f"n{i - 1}" if i else None) for i in range(70)]]
    got = {r.call_id: r.level for r in chat.levels(spark.createDataFrame(calls, "call_id string, after string")).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": 0, "e": 1, "f": 2, "g": 0, "h": None, **{f"n{i}": i for i in range(70)}}


def test_link_calls(spark):
    schema = {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}}}
    calls = [("1", None, "find", '{"q": "é", "a": [1.50, {"z":1,"b":null}]}'), ("2", "1", "find", '{"z": 1}'), ("3", None, "other", "[2]"), ("4", None, "find", "{"), (None, None, "find", None), ("1", None, "find", '{"q":"x"}')]
    table = spark.createDataFrame(calls, "call_id string, after string, name string, arguments string")
    results = spark.createDataFrame([("1", "r"), ("1", "again"), ("9", "lost"), (None, "null")], "call_id string, text string")
    linked, answered = chat.link_calls(table, results, {"find": schema}, ["name"])
    got = sorted((tuple(r) for r in linked.select("call_id", "linked", "level", "valid", "json").collect()), key=repr)
    assert ("1", True, 0, True, '{"arguments":{"a":[1.5,{"b":null,"z":1}],"q":"é"},"name":"find"}') in got and len(got) == 6
    assert ("2", False, 1, False, '{"arguments":{"z":1},"name":"find"}') in got and ("3", False, 0, True, '{"arguments":[2],"name":"other"}') in got
    assert ("4", False, 0, False, None) in got and (None, False, None, False, None) in got
    assert sorted(answered.select("call_id", "linked").collect(), key=repr) == sorted([("1", True), ("1", True), ("9", False), (None, False)], key=repr)


def test_canonical_json_form():
    numbers = {"1.0": "1", "1e2": "100", "-0.0": "0", "1e21": "1e+21", "1.5e-7": "1.5e-7", "0.00001": "0.00001", "1e-5": "0.00001", "123456789012345678901234567890": "123456789012345678901234567890", "0.1": "0.1", "2.5E300": "2.5e+300"}
    assert {k: chat.canonical_json(json.loads(k)) for k in numbers} == numbers
    assert chat.canonical_json(json.loads('{"b":"\\u001f\\ud800é/","a":[true,null,"\\ud83d\\ude00"]}')) == '{"a":[true,null,"😀"],"b":"\\u001f\\ud800é/"}'


def test_hard_arguments(spark):
    deep = "[" * 100_000
    calls = [("1", None, "find", '{"a":"\\ud800"}'), ("2", None, "find", '{"a":NaN}'), ("3", None, "find", '{"a":1e999}'), ("4", None, "find", deep), ("5", None, "find", '{"a":1.0}')]
    schema = {"type": "object", "properties": {"a": {"type": "string"}}}
    linked, _ = chat.link_calls(spark.createDataFrame(calls, "call_id string, after string, name string, arguments string"), spark.createDataFrame([], "call_id string"), {"find": schema}, [])
    got = {r.call_id: (r.valid, r.json) for r in linked.collect()}
    assert got["1"] == (True, '{"arguments":{"a":"\\ud800"},"name":"find"}') and got["5"] == (False, '{"arguments":{"a":1},"name":"find"}')
    assert [got[i] for i in "234"] == [(False, None)] * 3


def test_messages_come_in_topological_order(spark):
    turns = [(c, t, "user" if t % 2 else "assistant", f"m{t}\x1f") for c in range(3) for t in range(1, 801)]
    got = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)).collect()
    assert [(r.conv_id, r.turn) for r in got] == [(c, t) for c in range(3) for t in range(1, 801)] and got[-2].level == 399
    assert got[1].json == '{"role":"assistant","text":"m2\\u001f","turn":2}'


def test_conversations(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a\n\"é\""), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 5, "user", ""), (None, 0, "user", None), (2, None, "assistant", "x"), (3, 0, None, "y"), (1, 2, "assistant", "b")]
    table = spark.createDataFrame([(*t, 1, "k") for t in turns], "conv_id long, turn long, role string, text string, level long, kind string")
    got = chat.format_conversations(table).collect()
    assert len(got) == len(turns)
    by = {(r.conv_id, r.turn): r for r in got}
    assert (by[1, 1].level, by[1, 3].level, by[1, 5].level) == (0, 1, 0) and by[1, 1].linked and not by[1, 3].linked and by[1, 2].linked and by[1, 2].call_id == "1:1"
    assert json.loads(by[1, 1].json) == {"arguments": {"role": "user", "text": 'a\n"é"', "turn": 1}, "name": "reply"}
    assert by[1, 1].valid and by[1, 5].valid is False and by[None, 0].valid is False and by[1, 0].kind == "note" and by[3, 0].kind == "note"
    assert chat.format_conversations(table.limit(0)).count() == 0
