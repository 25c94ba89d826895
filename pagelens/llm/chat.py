"""Chat formatting: tool-call linking.

Calls and results meet in a hash join by identifier. A call may name the call it comes `after` (the
one whose result it reads); its level in the topological order is one more than that call's. Levels
come by pointer doubling, so a chain of n calls takes log2(n) joins; calls on a cycle, or after one,
never reach a first call and have a null level. Arguments are checked against the tool's JSON schema
and every message is written by one serialiser as canonical JSON: keys sorted by code point, no white
space, characters as they are (but control characters, quotes, backslashes and lone surrogates), and
numbers in their shortest form: 1.0 and 1e0 as 1, 1e21 as 1e+21, -0.0 as 0.

The joins are shuffled hash joins whose table side has one row for each identifier. Messages come out in
topological order: by conversation, then by level, a result after its call; what has no level, calls on
cycles among them, comes last.

Nothing is gathered by conversation: each message is a row of its own with its place, so a
conversation of any length is many rows of many tasks.

Defined results: a call without a result, or a result without a call, is not linked; a call whose
`after` is unknown has level 0. An identifier used by several calls or results counts as used once
when linking; each of its rows is kept. Null identifiers link with nothing. Arguments that are null
or no JSON (NaN, infinite or too deeply nested values are none) are invalid and have null JSON; of a tool without a schema any arguments are valid. Empty
tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.jsonschema import Validator
from pagelens.scratch import stored

#: Schema of the arguments of a turn of conversation.
TURN_SCHEMA = {
    "type": "object",
    "required": ["role", "text", "turn"],
    "properties": {"role": {"type": "string", "enum": ["user"]}, "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
}


_LONE = re.compile("[\ud800-\udfff]")


def _string(value: str) -> str:
    return _LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", json.dumps(value, ensure_ascii=False))


def _number(value: float) -> str:
    if not math.isfinite(value):
        raise ValueError("no number of JSON")
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    if 1e-6 <= abs(value) < 1e21:
        return format(Decimal(repr(value)), "f")
    digits, _, power = repr(value).partition("e")
    return f"{digits.removesuffix('.0')}e{'-' if power[0] == '-' else '+'}{power.lstrip('+-').lstrip('0')}"


def canonical_json(value) -> str:
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_string(k)}:{canonical_json(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    return json.dumps(value)


def _no_constant(name: str):
    raise ValueError(f"no JSON: {name}")


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level for calls (call_id, after) with distinct, non-null ids; null on cycles.

    Each round joins only the calls whose first call is not known yet with what is known of the call
    they point at. After r rounds chains of 2^r calls are known, so what is left when 2^r exceeds
    the number of links is on a cycle."""
    known = calls.select(F.col("call_id").alias("after"))
    edges = stored(calls.where("after is not null").join(known, "after", "left_semi").select("call_id", F.col("after").alias("up"), F.lit(1).cast("long").alias("level")), "follows")
    heads = edges.select(F.col("call_id").alias("up"), F.lit(False).alias("inner"))
    state = stored(edges.join(heads, "up", "left").select("call_id", "up", "level", F.coalesce("inner", F.lit(True)).alias("ends")), "levels")
    total, rounds = edges.count(), 0
    done, active = state.where("ends"), state.where(~F.col("ends"))
    while (1 << rounds) <= total and not active.isEmpty():
        next_ = done.unionByName(active).select(F.col("call_id").alias("up"), F.col("up").alias("on"), F.col("level").alias("more"), F.col("ends").alias("then"))
        state = stored(active.select("call_id", "up", "level").join(next_, "up").select("call_id", F.col("on").alias("up"), (F.col("level") + F.col("more")).alias("level"), F.col("then").alias("ends")), "levels")
        done, active, rounds = done.unionByName(state.where("ends")), state.where(~F.col("ends")), rounds + 1
    first = calls.join(edges.select("call_id"), "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level"))
    cyclic = active.select("call_id", F.lit(None).cast("long").alias("level"))
    return first.unionByName(done.select("call_id", "level")).unionByName(cyclic)


def checked(calls: DataFrame, schemas: dict[str, dict], keep: list[str], bare: bool = False) -> DataFrame:
    """`keep` columns, valid, problems (messages) and json (canonical; bare: of the arguments alone) of
    calls (name, arguments)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        validators = {k: Validator(s) for k, s in schemas.items()}
        for pdf in batches:
            rows = []
            for name, raw in zip(pdf["name"], pdf["arguments"]):
                try:
                    value = json.loads(raw, parse_constant=_no_constant)
                    shown = canonical_json(value if bare else {"arguments": value, "name": name})
                except (TypeError, ValueError, RecursionError) as e:
                    rows.append((False, f"no JSON: {type(e).__name__}", None))
                    continue
                found = validators[name].errors(value) if name in validators else []
                rows.append((not found, _LONE.sub("?", "; ".join(m for _, m in found)), shown))
            out = pdf[keep].reset_index(drop=True)
            out[["valid", "problems", "json"]] = pd.DataFrame(rows, columns=["valid", "problems", "json"])
            yield out

    # numbers pass as text: a column of longs with nulls would turn to floats in pandas
    kinds = {f.name: f.dataType for f in calls.select(*keep).schema.fields}
    passed = [F.col(c).cast("string").alias(c) for c in keep] + [F.col(c) for c in ("name", "arguments") if c not in keep]
    fields = ", ".join(f"`{c}` string" for c in keep)
    out = calls.select(*passed).mapInPandas(run, f"{fields}, valid boolean, problems string, json string")
    return out.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], "valid", "problems", "json")


def _hashed(table: DataFrame) -> DataFrame:
    return table.hint("shuffle_hash")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """calls (call_id, after, name, arguments, and `keep`) with linked, level, valid, problems, json;
    results (call_id, ...) with linked and the level of their call."""
    named = calls.where("call_id is not null").groupBy("call_id").agg(F.min("after").alias("after"))
    answered = results.where("call_id is not null").select("call_id").distinct().withColumn("linked", F.lit(True))
    order = stored(levels(named), "order")
    linked = checked(calls, schemas, list(dict.fromkeys(["call_id", *keep]))).join(_hashed(answered), "call_id", "left").join(_hashed(order), "call_id", "left")
    linked = linked.withColumn("linked", F.coalesce("linked", F.lit(False)))
    asked = order.withColumn("linked", F.lit(True))
    return linked, results.join(_hashed(asked), "call_id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as linked calls and results, a row for each message:
    conv_id, turn, kind, call_id, linked, level, valid, json, in topological order.

    A user's turn n is the call `conv:n` of the tool `reply`, after the assistant's answer before it
    (call `conv:n-2`, if turn n-1 is an assistant's); an assistant's turn n is the result of call
    `conv:n-1`. Other roles are notes. json is the message in canonical form; of calls it holds name
    and arguments. Levels, and whether arguments are valid, are null but for calls."""
    call = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - n).cast("string"))
    keyed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    user, assistant = F.coalesce(F.col("role") == "user", F.lit(False)), F.coalesce(F.col("role") == "assistant", F.lit(False))
    answers = turns.where(assistant & keyed).select(call(-1).alias("next"), call(1).alias("after")).distinct()
    asked = turns.where(user).withColumn("call_id", F.when(keyed, call(0))).join(_hashed(answers), F.col("call_id") == F.col("next"), "left")
    said = F.to_json(F.struct("role", "text", "turn"), {"ignoreNullFields": "false"}).alias("arguments")
    calls = asked.select("conv_id", "turn", "call_id", "after", F.lit("reply").alias("name"), said)
    results = turns.where(assistant).select("conv_id", "turn", F.when(keyed, call(1)).alias("call_id"), said)
    notes = turns.where(~user & ~assistant).select("conv_id", "turn", said)
    linked, answered = link_calls(calls, results, {"reply": TURN_SCHEMA}, ["conv_id", "turn"])
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["conv_id", "turn", "kind", "call_id", "linked", "level", "place", "valid", "json"]
    out = linked.withColumn("kind", F.lit("call")).withColumn("place", F.col("level")).select(*columns)
    others = answered.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", "linked", F.col("level").alias("place"), "arguments")
    others = others.unionByName(notes.select("conv_id", "turn", F.lit("note").alias("kind"), none("string").alias("call_id"), F.lit(False).alias("linked"), none("long").alias("place"), "arguments"))
    kept = [c for c in others.columns if c != "arguments"]
    plain = checked(others.withColumn("name", none("string")), {}, kept, bare=True)
    plain = plain.select(*kept, none("long").alias("level"), none("boolean").alias("valid"), "json").select(*columns)
    ordered = stored(out.unionByName(plain), "messages").orderBy("conv_id", F.asc_nulls_last("place"), "kind", "turn")
    return ordered.drop("place")
