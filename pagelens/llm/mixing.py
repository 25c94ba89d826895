"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

Sizes are words. Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, ...; together their
targets are the corpus size. A target stops at `cap` times its source's size and what it leaves is
reshared by weight (water filling: sources in order of cap / weight fill up one after another, so
one pass over the sources settles it).

The corpus size in blocks of `block_words` is given to sources by highest quotients
target / (2 k + 1), then each source's blocks to its groups of shards, and each group's to its shards,
by their sizes in the same way; none gets more blocks than `cap` times its words fill, so what a small
one can't hold goes to others. A shard is about `shard_docs` documents picked by a seeded digest, a
group at most `GROUP` shards: no task ranks more than that, however large a source is. Only the
sources, which are few against their documents, are ranked in one task. A source whose target is its
cap is taken `cap` times over. The documents of a shard, in the digest's order, are one cyclic run of
words; the quota is whole passes over it plus consecutive blocks from a seeded start. So no document is
taken more often than `cap` times and reruns agree.

Defined results: null text has size 0 and nothing is taken of it; a null source is a source of its
own; a null doc_id is digested with its text; repeated rows are rows like others. An empty table gives
an empty result. Extra columns are ignored by mix and kept by mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import SPACE, fresh
from pagelens.scratch import stored

BLOCK_WORDS, SHARD_DOCS, GROUP, CAP, SEED = 32, 512, 4096, 3, "mix-1"


def word_count(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    parts = F.split(text, SPACE)
    edges = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - edges).cast("long")


def digest(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"))


def number(hexed: Column) -> Column:
    """The first 8 hex digits as a long."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, docs, pos, full (whether the target is the cap), target for each source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), "pos")
    by = (
        by.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", 1 + (F.col("pos") - 1) % 3)
        .withColumn("most", cap * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(every))
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("rest", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn(
        "heavy", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    )
    wide = lambda a, b: F.col(a).cast("double") * F.col(b)
    by = by.withColumn("full", wide("most", "heavy") <= wide("rest", "weight"))
    by = by.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "pos", "rest", "heavy"))).over(every))
    share = F.col("level.rest").cast("double") * F.col("weight") / F.col("level.heavy")
    return by.select(
        "source", "source_size", "docs", "pos", "full",
        F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"),
    )


def apportion(claims: DataFrame, group: list[str], claim: str, seats: str, order: list[str], room: str | None = None) -> DataFrame:
    """claims with a column quota: `seats` of each group dealt by the highest claim / (2 k + 1), to each
    claim no more than its `room`.

    What each claim gets for certain (its exact share, less what rounding of m claims can move) is
    given at once; only the quotients around the exact shares are ranked, some five per claim, so
    the work doesn't grow with the seats. With rooms a group's seats must not exceed what they hold by
    more than two per claim. Ties go by `order`.
    """
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    extra = F.lit(2) if room else F.lit(0)
    c = claims.withColumn("_sum", F.sum(claim).over(every)).withColumn("_m", F.count(F.lit(1)).over(every))
    c = c.withColumn("_part", F.when(F.col("_sum") > 0, F.col(claim) / F.col("_sum")).otherwise(F.lit(0.0)))
    sure = F.greatest(F.lit(0), F.floor(F.col("_part") * F.col(seats) - F.col("_part") * F.col("_m") / 2 - 1))
    most = F.when(F.col(claim) > 0, F.ceil(F.col("_part") * F.col(seats) + F.col("_part") * F.col("_m") * (extra + 0.5) + 1)).otherwise(0)
    held = lambda x: (F.least(x, F.col(room)) if room else x).cast("long")
    c = c.withColumn("_sure", held(sure)).withColumn("_most", held(most))
    c = c.withColumn("_left", F.col(seats) - F.sum("_sure").over(every))
    key = [*group, *order]
    ranked = (
        c.where("_most > _sure")
        .select(*key, claim, "_left", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_k"))
        .withColumn("_n", F.row_number().over(every.orderBy((F.col(claim) / (2 * F.col("_k") + 1)).desc(), *order, "_k")))
        .where("_n <= _left")
        .groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.count(F.lit(1)).alias("_got"))
    )
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return c.join(ranked, on, "left").select(*claims.columns, (F.col("_sure") + F.coalesce("_got", F.lit(0))).alias("quota"))


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, cap: int = CAP, seed: str = SEED, group: int = GROUP) -> DataFrame:
    """doc_id, text_key, size, source_size, target, passes (over the whole document), parts (start and
    stop in words, from 0, of what is taken beyond them) for every row of docs (doc_id, text, source)."""
    sizes = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", word_count(F.col("text")).alias("size"))
    sizes = stored(sizes, "sizes")
    t = targets(sizes, cap).withColumn("_seats", F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words + 0.5).cast("long"))
    shards = F.ceil(F.col("docs") / shard_docs).cast("long")
    t = apportion(t, [], "target", "_seats", ["pos"]).select(
        "pos", "source", "source_size", "target", "full", F.col("quota").alias("blocks"), shards.alias("shards"), F.ceil(shards / group).cast("long").alias("groups")
    )
    t = stored(t, "targets")
    dug = F.when(F.col("doc_id").isNull(), digest(seed, F.lit(""), F.col("text_key"))).otherwise(digest(seed, F.col("doc_id")))
    rows = sizes.withColumnRenamed("source", "_source").withColumn("dug", dug)
    rows = rows.join(F.broadcast(t) if _few(t) else t, rows["_source"].eqNullSafe(t["source"])).withColumn("shard", number(F.col("dug")) % F.col("shards")).withColumn("grp", F.col("shard") % F.col("groups"))
    room = F.floor(cap * F.col("words") / block_words).cast("long")
    by_shard = stored(rows.groupBy("pos", "grp", "shard").agg(F.sum("size").alias("words"), F.max("full").alias("full"), F.max("blocks").alias("blocks")), "shards")
    by_group = by_shard.groupBy("pos", "grp").agg(F.sum("words").alias("words"), F.sum(room).alias("room"), F.max("blocks").alias("blocks"))
    by_group = apportion(by_group, ["pos"], "words", "blocks", ["grp"], "room").select(F.col("pos").alias("_pos"), F.col("grp").alias("_grp"), F.col("quota").alias("seats"))
    dealt = by_shard.join(by_group, (F.col("pos") == F.col("_pos")) & (F.col("grp") == F.col("_grp"))).drop("_pos", "_grp").withColumn("room", room)
    dealt = apportion(dealt, ["pos", "grp"], "words", "seats", ["shard"], "room")
    want = F.when(F.col("full"), cap * F.col("words")).otherwise(F.col("quota") * block_words)
    start = number(digest(seed, F.col("pos"), F.col("shard"))) % F.greatest(F.lit(1), F.ceil(F.col("words") / block_words)) * block_words
    dealt = dealt.where("words > 0").select(
        F.col("pos").alias("_pos"), F.col("shard").alias("_shard"), "words",
        F.floor(want / F.col("words")).cast("long").alias("passes"), (want % F.col("words")).alias("more"), start.cast("long").alias("begin"),
    )
    run = Window.partitionBy("pos", "shard").orderBy("dug", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("size").over(run))
    rows = rows.join(dealt, (F.col("pos") == F.col("_pos")) & (F.col("shard") == F.col("_shard")), "left")
    low, stop = F.col("end") - F.col("size"), F.col("begin") + F.col("more")
    piece = lambda a, b: F.struct((F.greatest(low, a) - low).cast("long").alias("start"), (F.least(F.col("end"), b) - low).cast("long").alias("stop"))
    pieces = F.array(piece(F.col("begin"), F.least(stop, F.col("words"))), piece(F.lit(0), stop - F.col("words")))
    parts = F.sort_array(F.filter(F.when(F.col("passes").isNull(), F.array().cast("array<struct<start:bigint,stop:bigint>>")).otherwise(pieces), lambda x: x["stop"] > x["start"]))
    return rows.select("doc_id", "text_key", "size", "source_size", "target", F.coalesce("passes", F.lit(0)).cast("long").alias("passes"), parts.alias("parts"))


def _few(t: DataFrame, limit: int = 8 << 20) -> bool:
    return (t.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 80)).first()[0] or 0) <= limit


def _words_taken() -> Column:
    return F.aggregate("parts", F.col("passes") * F.col("size"), lambda acc, x: acc + x["stop"] - x["start"])


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, text, source)."""
    return taken(docs, **options).select("doc_id", "size", "source_size", "target", _words_taken().alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture: the rows of docs that it takes words of, all columns as they were but text, which
    holds the words taken: the whole text once for each pass, then the words of each part joined by
    spaces, these pieces on lines of their own. Then size, source_size, target, taken and passes, under
    other names if docs has such columns. Rows equal in doc_id and text share what they take."""
    names = ["size", "source_size", "target", "taken", "passes"]
    doc, key, parts, *out = [fresh(docs.columns, c) for c in ("mix_doc", "mix_key", "mix_parts", *names)]
    rows = taken(docs, **options).withColumn("taken", _words_taken()).where("taken > 0")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy(F.desc("taken"), F.desc("source_size"))))
    rows = rows.where("nth = 1").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("parts").alias(parts), *[F.col(a).alias(b) for a, b in zip(names, out)])
    met = docs.join(rows, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)))
    split = F.filter(F.split("text", SPACE), lambda w: w != "")
    pieces = F.transform(parts, lambda x: F.array_join(F.slice(split, (x["start"] + 1).cast("int"), (x["stop"] - x["start"]).cast("int")), " "))
    text = F.array_join(F.concat(F.array_repeat(F.col("text"), F.col(out[-1]).cast("int")), pieces), "\n")
    return met.withColumn("text", text).select(*docs.columns, *out)
