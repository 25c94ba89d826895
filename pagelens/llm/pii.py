"""PII: personal data by pattern, and information-theoretic sanitisation (DataFrame functions only).

Base spans are e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers. Each found
value is a protected entity. A term (a word of letters, outside e-mail addresses) that stands in the
same text, wherever, may reveal it even where it is masked. Protected keys are the entities found in
`support` texts or more and, as back-off for rarer ones, the kinds. Over the whole corpus,

    P(k) = n(k) / N,   P(k|t) = (n(k, t) + a P(k)) / (n(t) + a),
    PMI(k; t) = log(P(k|t) / P(k)),   IC(k) = -log(P(k)),

with n(k, t) texts with both, n(k) texts with k, n(t) texts with t and N texts, a = SMOOTH: a few
texts alone prove little. Of texts with personal data, copies count once; of others, which only make a
term more common, each row counts. PMI / IC is the share of the key's information that the term
discloses. Where P(k|t) is at least `sure` and the share at least `generalise`, all occurrences of the
term in texts with the key become a placeholder; from `remove` on they are removed. Base spans always
stay.

Rows with personal data, few of all, are written with their texts once; only counts of candidate terms
(those that could pass even if no other text held them) take another pass over the corpus.

Positions come from the pieces between matches: a regular expression gives the matches and, used to
split, the gaps, and a running sum over both gives the offsets in code points. The patterns are the
contract's, written so that Java neither recurses nor rescans a long run from each of its places.

Defined results: null text is empty; empty texts, and tables, give no spans. Rows are keyed by
doc_id and text, so repeated rows each get the same result, and a null doc_id is a row like others.
Extra columns are ignored by find_pii and kept by sanitised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import fresh, is_small
from pagelens.scratch import stored

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the contract; possessive, and anchored to the start of a run of characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
CUES = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SUPPORT, SMOOTH, SURE, GENERALISE, REMOVE, BROADCAST = 3, 3.0, 0.6, 0.9, 0.97, 8 << 20
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "remove": ""}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(digits, n - i + 1, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)]), F.substring(digits, n - i + 1, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    d = _digits(value)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == "card", F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
        .otherwise(F.length(d).between(9, 15))
    )


def with_entities(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text, found (kind, gaps, hits): the rows with a valid base span, each once."""
    text = F.coalesce("text", F.lit(""))
    found = F.filter(F.array(*[
        F.when(
            text.rlike(CUES[k]),
            F.struct(F.lit(k).alias("kind"), F.split(text, PATTERNS[k]).alias("gaps"), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)).alias("hits")),
        )
        for k in KINDS
    ]), lambda x: x.isNotNull() & F.exists(x["hits"], lambda v: _valid(x["kind"], v)))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text", found.alias("found"))
    return rows.where(F.size("found") > 0).dropDuplicates(["doc_id", "text_key"])


def _placed(rows: DataFrame, by: list[str], gap: str, piece: str) -> DataFrame:
    """rows (by, i, gap length, piece) with start and end: a running sum over a text's pieces."""
    end = F.sum(F.col(gap) + F.length(piece)).over(Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length(piece))


def base_spans(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, kind, start, end, value: the valid base spans of with_entities' rows."""
    rows = rows.select("doc_id", "text_key", F.explode("found").alias("m"))
    pieces = F.zip_with(F.slice("m.gaps", F.lit(1), F.size("m.hits")), "m.hits", lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    rows = rows.select("doc_id", "text_key", "m.kind", F.posexplode(pieces).alias("i", "hit")).select("doc_id", "text_key", "kind", "i", "hit.gap", "hit.value")
    rows = _placed(rows, ["doc_id", "text_key", "kind"], "gap", "value")
    return rows.select("doc_id", "text_key", "kind", "start", "end", "value").where(_valid(F.col("kind"), F.col("value")))


_LETTERS, _OTHERS = r"\p{L}+", r"[^\p{L}]+"


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.regexp_replace(text, PATTERNS["email"], " ")), _OTHERS)), "")


def disclosing_terms(docs: DataFrame, rows: DataFrame, keys: DataFrame, smooth: float, sure: float, least: float, limit: int = BROADCAST) -> DataFrame:
    """key, term, disclosure (PMI / IC) of keys (text_key, key) and the terms that disclose them."""
    texts = rows.groupBy("text_key").agg(F.min("text").alias("text")).select("text_key", F.explode(_terms(F.col("text"))).alias("term"))
    texts = stored(texts, "terms")
    n_k = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_k"))
    n_kt = texts.join(keys, "text_key").groupBy("key", "term").agg(F.count(F.lit(1)).alias("n_kt"))
    n_here = texts.groupBy("term").agg(F.count(F.lit(1)).alias("n_here"))
    sizes = rows.agg(F.count(F.lit(1)), F.countDistinct("text_key")).first()
    n = float(docs.count() - sizes[0] + sizes[1])
    prior = F.col("n_k") / F.lit(n)
    chance = lambda total: (F.col("n_kt") + smooth * prior) / (total + smooth)
    share = lambda total: F.log(chance(total) / prior) / -F.log(prior)
    telling = lambda total: (F.col("n_k") < n) & (chance(total) >= sure) & (share(total) >= least)
    pairs = stored(n_kt.join(n_k, "key").join(n_here, "term").where(telling(F.col("n_here"))), "pairs")
    terms = pairs.select("term").distinct()
    small = is_small(terms, F.octet_length("term") + 40, limit)
    raw = lambda df: df.select(F.explode(F.array_distinct(F.split(F.lower("text"), _OTHERS))).alias("term")).join(F.broadcast(terms) if small else terms, "term")
    everywhere = raw(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n_all"))
    among = raw(rows).groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.col("n_here") + F.greatest(F.lit(0), F.coalesce("n_all", F.lit(0)) - F.coalesce("n_rows", F.lit(0)))
    met = pairs.join(everywhere, "term", "left").join(among, "term", "left")
    return met.where(telling(total)).select("key", "term", share(total).alias("disclosure"))


def all_spans(docs: DataFrame, support: int = SUPPORT, smooth: float = SMOOTH, sure: float = SURE, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, text_key, kind, start, end: base spans and spans of disclosing terms (`term` to be
    generalised, `remove` to be removed), each once."""
    rows = stored(with_entities(docs), "rows")
    base = stored(base_spans(rows), "spans")
    value = F.when(F.col("kind") == "email", F.lower("value")).when(F.col("kind") == "ip", F.col("value")).otherwise(_digits(F.col("value")))
    held = base.select("text_key", "kind", F.concat_ws(":", "kind", value).alias("entity")).distinct()
    often = held.select("entity", "text_key").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    keys = held.join(often, "entity").select("text_key", F.col("entity").alias("key")).unionByName(held.select("text_key", F.col("kind").alias("key")))
    keys = stored(keys.distinct(), "keys")
    told = stored(disclosing_terms(docs, rows, keys, smooth, sure, generalise), "told")
    spans = base.select("doc_id", "text_key", "kind", "start", "end")
    if told.isEmpty():
        return spans
    marked = stored(keys.join(told, "key").groupBy("text_key", "term").agg(F.max("disclosure").alias("d")), "marked")
    either = f"(?:{PATTERNS['email']})|{_LETTERS}"
    text = rows.join(marked.select("text_key").distinct(), "text_key", "left_semi").select("doc_id", "text_key", F.split("text", either).alias("gaps"), F.regexp_extract_all("text", F.lit(either), F.lit(0)).alias("hits"))
    pieces = F.zip_with(F.slice("gaps", F.lit(1), F.size("hits")), "hits", lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("word")))
    words = _placed(text.select("doc_id", "text_key", F.posexplode(pieces).alias("i", "w")).select("doc_id", "text_key", "i", "w.gap", "w.word"), ["doc_id", "text_key"], "gap", "word")
    words = words.select("doc_id", "text_key", F.lower("word").alias("term"), "start", "end")
    terms = words.join(marked, ["text_key", "term"]).select("doc_id", "text_key", F.when(F.col("d") >= remove, "remove").otherwise("term").alias("kind"), "start", "end")
    return spans.unionByName(terms)


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in MASKS]), kind)


def _joined(docs: DataFrame, per: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """docs left-joined with columns of per (doc_id, text_key, ...), under names that docs lacks. Only
    per travels if it is below BROADCAST bytes."""
    per = stored(per, "per_text")
    doc, key, *names = [fresh(docs.columns, c) for c in ("pii_doc", "pii_key", *columns)]
    per = per.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), *[F.col(c).alias(x) for c, x in zip(columns, names)])
    size = sum([F.octet_length(F.to_json(F.struct(x))) for x in names], F.lit(40))
    on = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key))
    return docs.join(F.broadcast(per) if is_small(per, size, BROADCAST) else per, on, "left"), names


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs."""
    spans = all_spans(docs, **options)
    per = spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", _rank(F.col("kind")).alias("rank"), "kind", "end"))).alias("all"))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")
    base = F.sha2(said(F.filter("all", lambda x: x["rank"] <= len(KINDS))), 256)
    counts = [f"n_{k}" for k in KINDS]
    per = per.select("doc_id", "text_key", *[count(k).alias(f"n_{k}") for k in KINDS], base.alias("base_sha256"), said(F.col("all")).alias("spans"))
    out, _ = _joined(docs.select("doc_id", "text"), per, [*counts, "base_sha256", "spans"])
    return out.select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of the text replaced by its mask; overlapping spans become one, with the
    mask of the first. All rows and columns stay; n_chars, where there is one, is counted anew."""
    spans = all_spans(docs, **options)
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", _rank(F.col("kind")), "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("part", F.sum(F.when(F.col("start") < reached, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc_id", "text_key", "part").agg(
        F.min(F.struct("start", _rank(F.col("kind")).alias("rank"), "kind")).alias("first"), F.max("end").alias("end")
    )
    merged = merged.select("doc_id", "text_key", F.col("first.start").alias("start"), "end", F.col("first.kind").alias("kind"))
    per = merged.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("masked"))
    out, (masked,) = _joined(docs, per, ["masked"])
    mask = F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair])
    before = lambda i: F.when(i > 0, F.col(masked)[i - 1]["end"]).otherwise(F.lit(0))
    parts = F.transform(masked, lambda x, i: F.concat(F.substring(F.col("text"), (before(i) + 1).cast("int"), (x["start"] - before(i)).cast("int")), mask[x["kind"]]))
    tail = F.substring(F.col("text"), (F.element_at(masked, -1)["end"] + 1).cast("int"), F.length("text"))
    clean = F.when(F.col(masked).isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), tail))
    out = out.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
