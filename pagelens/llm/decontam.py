"""Benchmark decontamination on a positional inverted index (DataFrame functions only).

The index holds, for the terms that a search needs, each occurrence in the corpus: term, document,
position, and as payload the words around it. A search for a benchmark item's windows

1. counts over the whole corpus how often each benchmark term occurs,
2. looks up each window under its rarest term only (a window with a term that never occurs is out);
   equal windows are one, whatever items they come from,
3. probes the payload for the window's second rarest term, which rules most postings out, then, at the
   posting's position less the term's place in the window, for all words: in order they are an exact
   phrase match,
4. probes the payload around the posting for a stretch of at most `slop` more words than the window
   has that holds all its words in any order: a proximity match.

Postings are probed one by one, so a window of common words costs what its rarest term's list is long
and no task gathers a list. Windows are broadcast only after their measured size is below `limit`;
beyond it postings and windows are shuffled, frequent terms in `SALTS` parts. Documents are keyed by
doc_id and a digest of their text.

Defined results: null or word-free documents have no words, no hits and are not contaminated.
Benchmark rows with null or word-free text, or null item_id, find nothing. Repeated rows count as
rows of documents; repeated items count once. Empty tables give empty or hit-free results. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import is_small, without, words
from pagelens.scratch import stored

WINDOW, RATIO, SLOP, SALTS, BROADCAST = 13, 20, 5, 16, 8 << 20


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, iw (words): the distinct items that can be found."""
    return (
        benchmark.where("item_id is not null")
        .select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", words(F.col("text")).alias("iw"))
        .where(F.size("iw") > 0)
        .dropDuplicates(["item_key"])
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))


def term_counts(docs: DataFrame, terms: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """term, cf: occurrences in the whole corpus of each of `terms` that occurs."""
    every = docs.select(F.explode(words(F.col("text"))).alias("term"))
    if is_small(terms, F.octet_length("term") + 40, limit):
        return every.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    return every.groupBy("term").agg(F.count(F.lit(1)).alias("cf")).join(terms, "term")


def positional_index(docs: DataFrame, terms: DataFrame | None = None, around: int = WINDOW, limit: int = BROADCAST) -> DataFrame:
    """term, doc_id, text_key, pos (from 0), first, near: postings with the words first .. around
    pos as payload. terms (distinct): only their lists; None: every term's."""
    kept = _keyed(docs)
    first = F.greatest(F.col("pos") - (around - 1), F.lit(0))
    near = F.slice("w", first + 1, F.lit(2 * around - 1))
    if terms is not None and not is_small(terms, F.octet_length("term") + 40, limit):
        hit = kept.select("doc_id", "text_key", F.posexplode("w").alias("pos", "term")).join(terms, "term")
        found = hit.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("pos", "term")).alias("hits"))
        kept = kept.dropDuplicates(["doc_id", "text_key"])
        on = kept["doc_id"].eqNullSafe(found["doc_id"]) & kept["text_key"].eqNullSafe(found["text_key"])
        hit = kept.join(found, on).select(kept["doc_id"], kept["text_key"], "w", F.inline("hits"))
    else:
        hit = kept.select("doc_id", "text_key", "w", F.posexplode("w").alias("pos", "term"))
        if terms is not None:
            hit = hit.join(F.broadcast(terms), "term")
    return hit.select("term", "doc_id", "text_key", "pos", first.alias("first"), near.alias("near"))


def windows_of(items: DataFrame, counts: DataFrame, size: int = WINDOW) -> DataFrame:
    """win (words), n, at (place of the rarest term), term, second (the next rarest, null if there is no
    other), ids (of the items): the distinct windows whose terms all occur in the corpus."""
    place = items.select("item_key", F.posexplode("iw").alias("ipos", "term")).join(counts, "term", "left")
    rare = place.groupBy("item_key").agg(
        F.sort_array(F.collect_list(F.struct("ipos", F.coalesce("cf", F.lit(0)).alias("cf"), "term"))).alias("cfs")
    )
    n = F.least(F.lit(size), F.size("iw"))
    ranked = lambda s: F.array_sort(F.transform(F.slice("cfs", s + 1, n), lambda x: F.struct(x["cf"].alias("cf"), x["term"].alias("term"), (x["ipos"] - s).alias("at"))))
    wins = F.transform(F.sequence(F.lit(0), F.size("iw") - n), lambda s: F.struct(F.slice("iw", s + 1, n).alias("win"), n.alias("n"), ranked(s).alias("ranked")))
    wins = items.join(rare, "item_key").select("item_id", F.inline(wins)).withColumn("rare", F.col("ranked")[0]).where("rare.cf > 0")
    wins = wins.withColumn("second", F.try_element_at(F.filter("ranked", lambda x: x["term"] != F.col("rare.term")), F.lit(1))["term"])
    ids = F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids")
    wins = wins.groupBy("win").agg(F.first("n").alias("n"), F.min(F.struct("rare", "second")).alias("r"), ids)
    return wins.select("win", "n", F.col("r.rare.at").alias("at"), F.col("r.rare.term").alias("term"), F.col("r.second").alias("second"), "ids")


def _probed(index: DataFrame, wins: DataFrame, limit: int) -> DataFrame:
    """Each posting with the windows looked up under its term."""
    size = F.size("win") * 24 + F.octet_length(F.array_join("win", "")) + F.octet_length(F.array_join("ids", ",")) + 60
    if is_small(wins, size, limit):
        return index.join(F.broadcast(wins), "term")
    salted = index.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "pos"), F.lit(SALTS)))
    copies = wins.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["term", "salt"]).drop("salt")


def matches(index: DataFrame, wins: DataFrame, slop: int = SLOP, limit: int = BROADCAST) -> DataFrame:
    """doc_id, text_key, ids, n, start, near: the exact matches of windows (start is null for others)
    and their proximity matches around postings (near: start and end of the shortest stretch, the first
    if there are several). The index's payload must reach n + slop - 1 words to either side."""
    start, distinct = F.col("pos") - F.col("at"), F.array_distinct("win")
    exact = (start >= 0) & (F.slice("near", F.greatest(F.lit(1), start - F.col("first") + 1), F.col("n")) == F.col("win"))
    reach = F.col("n") + slop
    low = F.greatest(F.lit(0), F.col("pos") - reach + 1) - F.col("first")
    ends = lambda o: F.array_max(F.transform(distinct, lambda w: F.coalesce(F.nullif(F.array_position(F.slice("near", o + 1, reach), w), F.lit(0)), F.lit(1 << 30))))
    stretches = F.transform(F.sequence(low, F.col("pos") - F.col("first")), lambda o: F.struct(ends(o).alias("width"), (o + F.col("first")).alias("start")))
    best = F.when(F.size(F.array_except("win", "near")) == 0, F.array_min(F.filter(stretches, lambda x: (x["width"] <= reach) & (x["start"] + x["width"] > F.col("pos")))))
    # as a generator: its array is evaluated once, where a filter on columns would repeat it
    pair = F.filter(F.array(F.struct(F.when(exact, start).alias("start"), best.alias("best"))), lambda x: x["start"].isNotNull() | x["best"].isNotNull())
    probed = _probed(index, wins, limit).where(F.col("second").isNull() | F.array_contains("near", F.col("second")))
    found = probed.select("doc_id", "text_key", "ids", "n", F.inline(pair))
    near = F.when(F.col("best").isNotNull(), F.struct(F.col("best.start").alias("start"), (F.col("best.start") + F.col("best.width")).cast("int").alias("end")))
    return found.select("doc_id", "text_key", "ids", "n", "start", near.alias("near"))


def search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP, limit: int = BROADCAST) -> DataFrame:
    """matches() of the benchmark's windows in docs."""
    items = stored(items_of(benchmark), "items")
    terms = items.select(F.explode("iw").alias("term")).distinct()
    wins = stored(windows_of(items, term_counts(docs, terms, limit), size), "windows")
    index = stored(positional_index(docs, wins.select("term").distinct(), size + slop, limit), "postings")
    return matches(index, wins, slop, limit)


def judged(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, ratio: int = RATIO, slop: int = SLOP, limit: int = BROADCAST) -> DataFrame:
    """contamination()'s columns and text_key."""
    ids = F.explode(F.when(F.col("start").isNull(), F.array().cast("array<string>")).otherwise(F.col("ids")))
    found = stored(search(docs, benchmark, size, slop, limit), "matches")
    by = ["doc_id", "text_key"]
    spans = found.where("start is not null").groupBy(*by).agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))))
    listed = lambda df, name: df.groupBy(*by).agg(F.sort_array(F.collect_set("id")).alias(name))
    items = listed(found.select(*by, ids.alias("id")), "items")
    near = listed(found.where("near is not null").select(*by, F.explode("ids").alias("id")), "close")
    keyed = lambda df: df.withColumn("doc_key", F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "text_key")).drop(*by)
    hits = keyed(near).join(keyed(items), "doc_key", "left").join(keyed(spans.select(*by, covered.cast("long").alias("hit"))), "doc_key", "left")
    hits = stored(hits, "hits")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"), _NO_CASE, lower=False)).cast("long").alias("n_words"))
    rows = rows.withColumn("doc_key", F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "text_key"))
    n_hit, none = F.coalesce("hit", F.lit(0)).cast("long"), F.array().cast("array<string>")
    count = lambda c: F.size(F.coalesce(c, none)).cast("long")
    return rows.join(hits, "doc_key", "left").select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), count("items").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
        ((n_hit > 0) & (ratio * n_hit >= F.col("n_words"))).alias("contaminated"),
        count("close").alias("n_near"), F.concat_ws(",", F.coalesce("close", none)).alias("near_items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with a proximity
    match, exact ones among them), near_items (their ids) for every row of docs."""
    return judged(docs, benchmark, **options).drop("text_key")


#: NOT_WORD for texts in their own case: lower-casing A-Z moves no word boundary.
_NO_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated; all columns as they were."""
    return without(docs, judged(docs, benchmark, **options).where("contaminated"))
