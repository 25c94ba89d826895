"""Registered queries and the SQL that gives the same rows.

Two kinds of input. Stored pages come through the snapshot adapter, some queries with a status, final
URL or error that a CASE over page_id makes up. Generated pages are small HTML texts built from rows
of other tables, with parts withheld by a modulus; they go through the same parser and rules, while
the SQL works the expectation out from the columns.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import url as urls
from pagelens.model import Context, by
from pagelens.operators import links as link_ops
from pagelens.operators.crawl_status import crawl_issues
from pagelens.operators.features import parse_pages, with_fingerprint
from pagelens.operators.metadata import Metadata
from pagelens.operators.structured_data import StructuredData
from pagelens.operators.uniqueness import Uniqueness, duplicate_groups
from pagelens.plans import audit
from pagelens.plans.crawl import all_issues
from pagelens.scratch import stored
from pagelens.sources.sitemap import bulk_sitemaps
from pagelens.sources.snapshot import snapshot_pages, url_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity", "category").agg(F.count(F.lit(1)).cast("bigint").alias("issues"))


def n(c: Column | str, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name)


def parsed(pages: DataFrame) -> DataFrame:
    """Features of pages as a table, for queries that read them more than once: the parse runs once."""
    return stored(with_fingerprint(parse_pages(pages)), "features")


# ---------------------------------------------------------------- stored pages


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_pages(table(spark, sf_dir, "pages"))


def answered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ten pages one is a 404, one redirects to another host's address and one failed."""
    i = F.col("page_id") % 10
    return snapshot_pages(
        table(spark, sf_dir, "pages"), status=F.when(i == 0, 404).otherwise(200), final_url=F.when(i == 1, F.concat(urls.normalize_column(F.col("url")), F.lit("/moved"))).otherwise(F.col("url")),
        error=F.when(i == 2, F.lit("Timeout: no answer")),
    )


#: RE2 forms used by the SQL below: scheme and authority, path, and the normalised address.
_ORIGIN = r"regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
_CUT = f"(case when {_PATH} in ('', '/') then '/' else regexp_replace({_PATH}, '/$', '') end)"
_NORMAL = f"({_ORIGIN} || {_CUT})"


@query(f"select page_id::bigint as page_id, {_NORMAL} as normalized_url from pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_column(F.col("url")).alias("normalized_url"))


@query(f"select page_id::bigint as page_id, {_CUT} as path, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host from pages")
def url_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.path_column(F.col("url")).alias("path"), urls.host_column(F.col("url")).alias("host"))


@query(f"select page_id::bigint as page_id, 'http://localhost:3000' || {_CUT} as rebased, false as is_local, true as is_remote from pages")
def url_rebase(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.rebase_column(u, "http://localhost:3000").alias("rebased"), urls.local_column(u).alias("is_local"), urls.remote_column(u).alias("is_remote"))


_TITLE = "trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'))"


@query(f"select page_id::bigint as ordinal, {_TITLE} as title, length({_TITLE})::bigint as title_length from pages")
def pages_title_features(spark, sf_dir):
    return parse_pages(stored_pages(spark, sf_dir)).select("ordinal", "title", n(F.length("title"), "title_length"))


@query("select page_id::bigint as ordinal, len(regexp_extract_all(html, '<h1[ >]'))::bigint as h1_count from pages")
def pages_h1_count(spark, sf_dir):
    return parse_pages(stored_pages(spark, sf_dir)).select("ordinal", n("h1_count", "h1_count"))


@query(
    "select code, 'warning' as severity, 'metadata' as category, count(*)::bigint as issues from pages, "
    "(values ('missing_meta_description'), ('missing_canonical'), ('incomplete_open_graph_tags')) c(code) group by all"
)
def metadata_issue_counts(spark, sf_dir):
    pages = stored_pages(spark, sf_dir)
    return counted(Metadata().apply(pages, pages, parse_pages(pages), Context()))


_ANSWERED = f"""answered as (select page_id, url, html, {_NORMAL} as norm, {_ORIGIN} as site, {_CUT} as path,
  case when page_id % 10 = 2 then null when page_id % 10 = 0 then 404 else 200 end as status,
  case when page_id % 10 = 2 then 'Timeout: no answer' end as error,
  case when page_id % 10 = 1 then {_NORMAL} || '/moved' else url end as final_url,
  case when page_id % 10 = 1 then {_NORMAL} || '/moved' else {_NORMAL} end as final_norm from pages)"""
_STATUS_ISSUES = """select page_id::bigint as ordinal, url, case when error is not null then 'fetch_failed' when status = 404 then 'unexpected_status' else 'redirected_page' end as code,
  case when error is not null or status = 404 then 'error' else 'warning' end as severity,
  case when error is not null then error when status = 404 then 'HTTP 404' else 'redirects to ' || final_url end as message
  from answered where error is not null or status = 404 or norm <> final_norm"""


@query(f"with {_ANSWERED} {_STATUS_ISSUES}")
def crawl_status_issues(spark, sf_dir):
    found = crawl_issues(answered_pages(spark, sf_dir), Context())
    return found.select(F.col("seq.ordinal").alias("ordinal"), "url", "code", "severity", "message")


@query(f"with {_ANSWERED}, s as ({_STATUS_ISSUES}) select a.site, count(s.code)::bigint as issues, count(s.code) = 0 as ok from answered a left join s on s.ordinal = a.page_id group by all")
def verdict_by_site(spark, sf_dir):
    pages = answered_pages(spark, sf_dir)
    found = crawl_issues(pages, Context()).groupBy("site").agg(F.count(F.lit(1)).alias("found"))
    every = pages.select("site").distinct().join(found, "site", "left")
    return every.select("site", n(F.coalesce("found", F.lit(0)), "issues"), F.col("found").isNull().alias("ok"))


@query(
    f"""with t as (select page_id, url, {_ORIGIN} as site, {_TITLE} as title from pages)
    select site, title, count(*)::bigint as pages, string_agg(url, ' ' order by page_id) as urls from t where title <> '' group by all having count(*) > 1"""
)
def duplicate_titles(spark, sf_dir):
    found = duplicate_groups(parsed(stored_pages(spark, sf_dir))).where("part = 0")
    return found.select("site", F.col("value").alias("title"), n("n", "pages"), F.array_join("urls", " ").alias("urls"))


_ANCHORS = """anchors as (select page_id, url, html, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) as href,
  unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as label from pages)"""


@query(f"with {_ANCHORS} select page_id::bigint as ordinal, href, label, count(*)::bigint as anchors from anchors group by all")
def anchors_extracted(spark, sf_dir):
    rows = parse_pages(stored_pages(spark, sf_dir)).select("ordinal", F.explode("anchors").alias("a"))
    return rows.groupBy("ordinal", F.col("a.href").alias("href"), F.col("a.text").alias("label")).agg(F.count(F.lit(1)).cast("bigint").alias("anchors"))


_LINKS = f"""{_ANCHORS}, linked as (select page_id, {_NORMAL} as source_url, {_CUT} as source_path, {_ORIGIN} as site, href, label, {_ORIGIN} || href as target_url
  from anchors where regexp_full_match(href, '[!-~]+') and not regexp_matches(href, '[<>"|^`{{}}\\\\]') and href <> '/' and label <> '')"""


@query(f"with {_LINKS} select page_id::bigint as source_ordinal, source_url, source_path, target_url, href as target_path, label as anchor_text, count(*)::bigint as links from linked group by all")
def internal_links(spark, sf_dir):
    found = link_ops.extract_links(parse_pages(stored_pages(spark, sf_dir)))
    return found.groupBy("source_ordinal", "source_url", "source_path", "target_url", "target_path", "anchor_text").agg(F.count(F.lit(1)).cast("bigint").alias("links"))


@query(f"with {_LINKS} select site, target_url, count(*)::bigint as links, count(distinct source_url)::bigint as sources from linked group by all")
def distinct_targets(spark, sf_dir):
    found = link_ops.extract_links(parse_pages(stored_pages(spark, sf_dir)))
    return found.groupBy("site", "target_url").agg(n(F.count(F.lit(1)), "links"), n(F.countDistinct("source_url"), "sources"))


@query(f"with {_LINKS} select site, count(distinct target_url)::bigint as issues from linked group by all")
def unresolved_links(spark, sf_dir):
    """No stored page is the target of a stored link, so every target is unresolved."""
    pages = stored_pages(spark, sf_dir)
    ctx = Context()
    links = link_ops.extract_links(parsed(pages))
    found = link_ops.target_issues(link_ops.judged_targets(links, link_ops.resolve_targets(links, pages, ctx), ctx))
    return found.where("code = 'unresolved_internal_link'").groupBy("site").agg(F.count(F.lit(1)).cast("bigint").alias("issues"))


@query(
    f"""with {_LINKS}, sites as (select distinct site from linked),
    paths as (select {_ORIGIN} as site, {_CUT} as path, arg_max({_NORMAL}, page_id) as url from pages group by all)
    select site, path, url, 0::bigint as inbound from paths where path <> '/' and site in (select site from sites)"""
)
def low_inbound(spark, sf_dir):
    pages, ctx = stored_pages(spark, sf_dir), Context()
    links = link_ops.extract_links(parsed(pages))
    judged = link_ops.judged_targets(links, link_ops.resolve_targets(links, pages, ctx), ctx)
    return link_ops.inbound_counts(links, judged, url_list(pages), pages).where("inbound < 1").select("site", "path", "url", "inbound")


@query(
    f"""with {_ANSWERED}, keys as (select site, norm as target_url, page_id, status, error from answered union all select site, final_norm, page_id, status, error from answered)
    select site, target_url, max(page_id)::bigint as ordinal from keys group by all"""
)
def page_index_collisions(spark, sf_dir):
    pages = answered_pages(spark, sf_dir)
    last = pages.select("site", "ordinal", F.explode(F.array("normalized_url", "normalized_final_url")).alias("target_url")).groupBy("site", "target_url").agg(F.max("ordinal").alias("ordinal"))
    return link_ops.page_index(pages).join(last, ["site", "target_url"]).select("site", "target_url", "ordinal")


# ---------------------------------------------------------------- generated pages

_HOST = "https://shop.example.com"


def _html(head: Column, body: Column) -> Column:
    return F.concat(F.lit("<!DOCTYPE html><html><head>"), head, F.lit("</head><body>"), body, F.lit("</body></html>"))


def _unless(condition: Column, text: Column) -> Column:
    return F.when(condition, F.lit("")).otherwise(text)


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part: title (twice the shop's name if key % 7 = 3, long if % 11 = 5, none if
    % 13 = 0), a description as long as key % 200, a canonical link (none if % 5 = 0, another if
    % 5 = 1), Open Graph tags (og:image missing if % 3 = 0) and key % 3 headings."""
    k, name = F.col("p_partkey"), F.col("p_name")
    title = F.when(k % 7 == 3, _cat("Acme ", name, " | ACME")).when(k % 11 == 5, _cat(name, F.lit(" x" * 40))).otherwise(name)
    url = _cat(f"{_HOST}/part/", k)
    head = _cat(
        _unless(k % 13 == 0, _cat("<title> ", title, "\n</title>")), _cat('<meta name="description" content="', F.repeat(F.lit("d"), (k % 200).cast("int")), '">'),
        _unless(k % 5 == 0, _cat('<link rel="canonical" href="', F.when(k % 5 == 1, F.lit(f"{_HOST}/other")).otherwise(_cat("/part/", k, "/?a=1")), '">')),
        *[f'<meta property="og:{p}" content="x">' for p in ("title", "description", "url", "type")], _unless(k % 3 == 0, F.lit('<meta property="og:image" content>')),
    )
    rows = table(spark, sf_dir, "part").select(k.alias("page_id"), url.alias("url"), _html(head, F.repeat(F.lit("<h1>x</h1>"), (k % 3).cast("int"))).alias("html"))
    return snapshot_pages(rows)


_PART = """parts as (select p_partkey as k, length(case when p_partkey % 7 = 3 then 'Acme ' || p_name || ' | ACME' when p_partkey % 11 = 5 then p_name || repeat(' x', 40) else p_name end) as len,
  p_name as name, 'https://shop.example.com/part/' || p_partkey as url from part)"""
_PART_ISSUES = f"""with {_PART}, found as (
  select k, url, case when k % 3 = 0 then 'missing_h1' when k % 3 = 2 then 'multiple_h1' end as code, case when k % 3 = 0 then 'missing <h1>' else 'multiple <h1> tags (2)' end as message from parts
  union all select k, url, case when k % 13 = 0 then 'missing_title' when len > 72 then 'title_too_long' when k % 7 = 3 then 'title_repeats_site_name' end,
    case when k % 13 = 0 then 'missing <title>' when len > 72 then 'title too long (' || len || ')' else 'title repeats Acme' end from parts
  union all select k, url, case when k % 200 = 0 then 'missing_meta_description' when k % 200 < 110 then 'meta_description_too_short' when k % 200 > 160 then 'meta_description_too_long' end,
    case when k % 200 = 0 then 'missing meta description' when k % 200 < 110 then 'meta description too short (' || (k % 200) || ')' else 'meta description too long (' || (k % 200) || ')' end from parts
  union all select k, url, case when k % 5 = 0 then 'missing_canonical' when k % 5 = 1 then 'canonical_mismatch' end,
    case when k % 5 = 0 then 'missing canonical link' else 'canonical mismatch (https://shop.example.com/other)' end from parts
  union all select k, url, case when k % 3 = 0 then 'incomplete_open_graph_tags' end, 'Open Graph tags incomplete (missing og:image)' from parts)"""


def _part_issues(spark, sf_dir):
    pages = part_pages(spark, sf_dir)
    return Metadata("Acme").apply(pages, pages, parse_pages(pages), Context())


@query(f"{_PART_ISSUES} select k::bigint as ordinal, url, code, message from found where code is not null")
def metadata_issues_detail(spark, sf_dir):
    return _part_issues(spark, sf_dir).select(F.col("seq.ordinal").alias("ordinal"), "url", "code", "message")


@query(f"{_PART_ISSUES} select k::bigint as ordinal, message from found where code = 'title_repeats_site_name'")
def title_repeats_site_name(spark, sf_dir):
    return _part_issues(spark, sf_dir).where("code = 'title_repeats_site_name'").select(F.col("seq.ordinal").alias("ordinal"), "message")


@query(f"{_PART_ISSUES} select code, count(*)::bigint as issues from found where code like '%description%' group by all")
def description_length_bands(spark, sf_dir):
    return by(_part_issues(spark, sf_dir).where("code like '%description%'"), "code")


@query(f"{_PART_ISSUES} select k::bigint as ordinal, code, message from found where code like '%canonical%'")
def canonical_check(spark, sf_dir):
    return _part_issues(spark, sf_dir).where("code like '%canonical%'").select(F.col("seq.ordinal").alias("ordinal"), "code", "message")


@query(f"{_PART_ISSUES} select k::bigint as ordinal, message from found where code = 'incomplete_open_graph_tags'")
def open_graph_missing(spark, sf_dir):
    return _part_issues(spark, sf_dir).where("code = 'incomplete_open_graph_tags'").select(F.col("seq.ordinal").alias("ordinal"), "message")


@query(
    """with d as (select p_partkey as k, p_partkey % 200 as n from part), g as (select n, count(*) as pages, string_agg('https://shop.example.com/part/' || k, ' ' order by k) as urls from d where n > 0 group by n having count(*) > 1)
    select repeat('d', n::int) as description, pages::bigint as pages, urls from g"""
)
def duplicate_descriptions(spark, sf_dir):
    found = duplicate_groups(parsed(part_pages(spark, sf_dir))).where("part = 1")
    return found.select(F.col("value").alias("description"), n("n", "pages"), F.array_join("urls", " ").alias("urls"))


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document; its text in a main element, escaped."""
    text = F.coalesce("text", F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), _cat(f"{_HOST}/doc/", F.col("doc_id")).alias("url"), _html(F.lit("<title>t</title>"), _cat("<main>", text, "</main>")).alias("html"))
    return snapshot_pages(rows)


_DIGEST = r"""digests as (select doc_id, case when length(t) >= 200 then sha256(t) end as digest from
  (select doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\r\n\f\v]+', ' ', 'g')) as t from documents))"""


@query(f"with {_DIGEST} select doc_id::bigint as ordinal, digest from digests")
def content_fingerprints(spark, sf_dir):
    return with_fingerprint(parse_pages(text_pages(spark, sf_dir))).select("ordinal", F.col("content_fingerprint").alias("digest"))


@query(
    f"""with {_DIGEST} select 'duplicate_content_fingerprint' as code, 'duplicate page content fingerprint => ' || string_agg('{_HOST}/doc/' || doc_id, ', ' order by doc_id) as message
    from digests where digest is not null group by digest having count(*) > 1"""
)
def duplicate_content(spark, sf_dir):
    pages = text_pages(spark, sf_dir)
    features = parsed(pages).withColumn("title", F.lit(""))
    return Uniqueness().apply(pages, pages, features, Context()).select("code", "message")


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer k of a ring: links to k + 1 with a text, to k + 2 without one, to
    /rails/x, to the root, to another host and to a mail address. Of seven pages one is a 404, one
    redirects to its /moved address, one failed."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    anchor = lambda href, text: _cat('<a href="', href, '">', text, "</a>")
    body = _cat(
        anchor(_cat("/c/", k + 1, "?x=1#y"), F.lit("next <b>page</b>")), anchor(_cat("/c/", k + 2), F.lit("<img src=x>")), anchor(F.lit("/rails/x"), F.lit("r")),
        anchor(F.lit("/"), F.lit("home")), anchor(F.lit("https://elsewhere.example.com/c/1"), F.lit("out")), anchor(F.lit("mailto:a@example.com"), F.lit("mail")),
    )
    rows = t.select(k.alias("page_id"), _cat(f"{_HOST}/c/", k).alias("url"), _html(F.lit(""), body).alias("html"))
    i = F.col("page_id") % 7
    return snapshot_pages(
        rows, status=F.when(i == 0, 404).otherwise(200), final_url=F.when(i == 4, _cat(F.col("url"), "/moved")).otherwise(F.col("url")), error=F.when(i == 2, F.lit("Timeout: no answer"))
    )


#: Sources are the pages that answered with HTML: k % 7 not in (0, 2). The target of k is k + 1.
_RING = """ring as (select c_custkey as k, c_custkey + 1 as t, (c_custkey + 1) in (select c_custkey from customer) as crawled from customer where c_custkey % 7 not in (0, 2)),
  judged as (select k, t, 'https://shop.example.com/c/' || k as source, 'https://shop.example.com/c/' || t as target, case when not crawled then 'unresolved' when t % 7 = 2 then 'ignored'
    when t % 7 = 0 then 'broken' when t % 7 = 4 then 'redirect' else 'kept' end as disposition from ring)"""


def _judged(spark, sf_dir):
    pages, ctx = linked_pages(spark, sf_dir), Context()
    links = link_ops.extract_links(parsed(pages))
    return pages, links, link_ops.judged_targets(links, link_ops.resolve_targets(links, pages, ctx), ctx)


@query(
    f"""with {_RING} select target as target_url, disposition <> 'unresolved' as crawled, case when disposition = 'unresolved' or disposition = 'ignored' then null when disposition = 'broken' then 404 else 200 end::int as status,
    disposition, source as sources from judged"""
)
def link_resolution(spark, sf_dir):
    _, _, judged = _judged(spark, sf_dir)
    return judged.select("target_url", F.coalesce("crawled", F.lit(False)).alias("crawled"), "status", "disposition", F.array_join("sources", " ").alias("sources"))


def _link_messages(code: str):
    def run(spark, sf_dir):
        _, _, judged = _judged(spark, sf_dir)
        return link_ops.target_issues(judged).where(F.col("code") == code).select("url", "message")

    return run


for _name, _code, _sql in (
    ("broken_links", "broken_internal_link", "'broken internal link (HTTP 404, sources: ' || source || ')'"),
    ("redirecting_links", "internal_link_redirects", "'internal link redirects to ' || target || '/moved (sources: ' || source || ')'"),
    ("unvalidated_links", "unresolved_internal_link", "'unable to validate internal link (sources: ' || source || ')'"),
):
    QUERIES[_name] = _link_messages(_code)
    _kind = {"broken_internal_link": "broken", "internal_link_redirects": "redirect", "unresolved_internal_link": "unresolved"}[_code]
    ORACLE[_name] = f"with {_RING} select target as url, {_sql} as message from judged where disposition = '{_kind}'"


@query(
    f"""with {_RING}, counts as (select t, count(*) as c from judged where disposition = 'kept' group by t)
    select '{_HOST}/c/' || c_custkey as url, coalesce(c, 0)::bigint as inbound from customer left join counts on t = c_custkey where c_custkey % 7 not in (0, 2)"""
)
def inbound_links(spark, sf_dir):
    pages, links, judged = _judged(spark, sf_dir)
    return link_ops.inbound_counts(links, judged, url_list(pages), pages).select("url", "inbound")


def item_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part. JSON-LD of a Product, name missing if k % 5 = 0, the price true instead
    of a number if k % 4 = 1, image not a URI if k % 7 = 2, cut short (a parse error) if k % 11 = 3;
    a microdata Event, its start date without a time, if k % 3 = 0; nothing at all if k % 13 = 6."""
    k = F.col("p_partkey")
    product = _cat(
        '{"@context":"https://schema.org","@type":"Product"', _unless(k % 5 == 0, _cat(',"name":"', F.col("p_name"), '"')),
        ',"image":"', F.when(k % 7 == 2, F.lit("not a uri")).otherwise(F.lit("https://shop.example.com/i.png")),
        '","offers":{"@type":"Offer","price":', F.when(k % 4 == 1, F.lit("true")).otherwise(F.col("p_size").cast("string")), "}", _unless(k % 11 == 3, F.lit("}")),
    )
    event = F.lit('<div itemscope itemtype="https://schema.org/Event"><span itemprop="name">Sale</span><meta itemprop="startDate" content="2026-01-31"></div>')
    body = _unless(k % 13 == 6, _cat('<script type="application/ld+json">', product, "</script>", _unless(k % 3 != 0, event)))
    rows = table(spark, sf_dir, "part").select(k.alias("page_id"), _cat(f"{_HOST}/item/", k).alias("url"), _html(F.lit(""), body).alias("html"))
    return snapshot_pages(rows)


_ITEMS = """items as (select p_partkey as k, k % 13 <> 6 as has, k % 11 = 3 as cut, k % 5 = 0 as unnamed, k % 4 = 1 as odd_price, k % 7 = 2 as odd_image, k % 3 = 0 as event from part)"""


def _items(spark, sf_dir):
    return parse_pages(item_pages(spark, sf_dir)).select("ordinal", F.explode("items").alias("i")).select("ordinal", "i.*")


@query(
    f"""with {_ITEMS} select k::bigint as ordinal, 0::bigint as pos, 'json-ld' as source, case when not cut then 'Product' end as type, cut as failed from items where has
    union all select k, 1, 'microdata', 'Event', false from items where has and event"""
)
def structured_items(spark, sf_dir):
    return _items(spark, sf_dir).select("ordinal", n("pos", "pos"), "source", "type", F.col("parse_error").isNotNull().alias("failed"))


@query(f"with {_ITEMS} select k::bigint as ordinal, 'Product' as types from items where has and not cut")
def jsonld_types(spark, sf_dir):
    return _items(spark, sf_dir).where("source = 'json-ld' and parse_error is null").select("ordinal", F.array_join("types", ",").alias("types"))


@query(f"with {_ITEMS} select k::bigint as ordinal from items where has and cut")
def jsonld_parse_errors(spark, sf_dir):
    pages = item_pages(spark, sf_dir)
    found = StructuredData().apply(pages, pages, parse_pages(pages), Context())
    return found.where("code = 'structured_data_parse_error'").select(F.col("seq.ordinal").alias("ordinal"))


@query("""select p_partkey::bigint as ordinal, '{"@type": "Event", "name": "Sale", "startDate": "2026-01-31"}' as data from part where p_partkey % 13 <> 6 and p_partkey % 3 = 0""")
def microdata_items(spark, sf_dir):
    return _items(spark, sf_dir).where("source = 'microdata'").select("ordinal", F.col("data_json").alias("data"))


@query(f"with {_ITEMS} select k::bigint as ordinal, 'Product' as type, '' as field, 'name' as property from items where has and not cut and unnamed")
def schema_errors_required(spark, sf_dir):
    rows = _items(spark, sf_dir).select("ordinal", F.explode("problems").alias("p")).where("p.issue like '%required property%'")
    return rows.select("ordinal", "p.type", "p.field", F.regexp_extract("p.issue", "property of '([^']*)'$", 1).alias("property"))


@query(
    f"""with {_ITEMS} select k::bigint as ordinal, 'Product' as type, 'image' as field from items where has and not cut and odd_image
    union all select k, 'Product', 'offers' from items where has and not cut and odd_price union all select k, 'Event', 'startDate' from items where has and event"""
)
def schema_errors_types_formats(spark, sf_dir):
    rows = _items(spark, sf_dir).select("ordinal", F.explode("problems").alias("p")).where("p.issue not like '%required property%'")
    return rows.select("ordinal", "p.type", "p.field")


@query(
    f"""with {_ITEMS}, codes as (select unnest(list_filter([case when not has then 'missing_structured_data' end, case when has and cut then 'structured_data_parse_error' end,
      case when has and not cut and (unnamed or odd_price or odd_image) then 'structured_data_schema_error' end, case when has and event then 'structured_data_schema_error' end], lambda x: x is not null)) as code from items)
    select code, 'warning' as severity, 'structured_data' as category, count(*)::bigint as issues from codes group by all"""
)
def structured_issue_counts(spark, sf_dir):
    pages = item_pages(spark, sf_dir)
    return counted(StructuredData().apply(pages, pages, parse_pages(pages), Context()))


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order, on a careers path if k % 2 = 0: k % 4 items, JobPosting but for the
    last, which is a WebPage; the first mentions it twice in a graph."""
    k = F.col("o_orderkey")
    job = '{"@type":["JobPosting"]}'
    wrap = lambda text: f'<script type="application/ld+json">{text}</script>'
    jobs = F.when(k % 4 == 2, F.lit(wrap('{"@graph":[%s,%s]}' % (job, job)))).when(k % 4 == 3, F.lit(wrap(job) * 2)).otherwise(F.lit(""))
    body = _unless(k % 4 == 0, _cat(jobs, wrap('{"@type":"WebPage"}')))
    url = F.when(k % 2 == 0, _cat(f"{_HOST}/careers/", k, "/")).otherwise(_cat(f"{_HOST}/team/", k))
    return snapshot_pages(table(spark, sf_dir, "orders").select(k.alias("page_id"), url.alias("url"), _html(F.lit(""), body).alias("html")))


@query("select o_orderkey::bigint as ordinal, case when o_orderkey % 4 = 0 then 'missing_structured_data' else 'multiple_job_postings' end as code from orders where o_orderkey % 4 in (0, 3)")
def job_posting_cardinality(spark, sf_dir):
    pages = job_pages(spark, sf_dir)
    return StructuredData().apply(pages, pages, parse_pages(pages), Context()).select(F.col("seq.ordinal").alias("ordinal"), "code")


@query("select o_orderkey::bigint as ordinal, 'missing_job_posting' as code from orders where o_orderkey % 3 = 0")
def job_posting_missing(spark, sf_dir):
    """Career pages without a posting are found; ordinary pages without one aren't."""
    k = F.col("o_orderkey")
    url = F.when(k % 3 == 0, _cat(f"{_HOST}/careers/", k)).otherwise(_cat(f"{_HOST}/careers/a/", k, "/b"))
    pages = snapshot_pages(table(spark, sf_dir, "orders").select(k.alias("page_id"), url.alias("url"), F.lit('<script type="application/ld+json">{"@type":"WebPage"}</script>').alias("html")))
    return StructuredData().apply(pages, pages, parse_pages(pages), Context()).select(F.col("seq.ordinal").alias("ordinal"), "code")


_ANY = "did not match one or more of the required schemas"


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part with five items, each with a fault by modulus: an Article whose headline is
    key % 150 long; a HowTo without steps (% 3 = 0), whose step has position 0 (% 3 = 1); an FAQPage
    whose question has no answer (% 4 = 0) or an answer without text (% 4 = 1); a JobPosting in another
    context (% 5 = 0) and without a place (% 5 < 2); a BreadcrumbList whose position is text (% 6 = 0)."""
    k = F.col("p_partkey")
    article = _cat('{"@type":"Article","headline":"', F.repeat(F.lit("h"), (k % 150).cast("int")), '"}')
    step = _cat('{"@type":"HowToStep","name":"n","text":"t","position":', F.when(k % 3 == 1, 0).otherwise(1), "}")
    how = _cat('{"@type":"HowTo","name":"h","step":[', _unless(k % 3 == 0, step), "]}")
    answer = _unless(k % 4 == 0, _cat(',"acceptedAnswer":{"@type":"Answer"', _unless(k % 4 == 1, F.lit(',"text":"a"')), "}"))
    faq = _cat('{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"@type":"Question","name":"q"', answer, "}]}")
    job = _cat(
        '{"@context":"', F.when(k % 5 == 0, F.lit("http://example.com")).otherwise(F.lit("https://schema.org")), '","@type":"JobPosting","title":"t","description":"d","datePosted":"2026-01-01",',
        '"hiringOrganization":{"@type":"Organization","name":"o"}', _unless(k % 5 < 2, F.lit(',"jobLocation":{}')), "}",
    )
    crumbs = _cat('{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":', F.when(k % 6 == 0, F.lit('"1"')).otherwise(F.lit("1")), ',"name":"n","item":"https://example.com/"}]}')
    body = F.concat(*[_cat('<script type="application/ld+json">', one, "</script>") for one in (article, how, faq, job, crumbs)])
    return snapshot_pages(table(spark, sf_dir, "part").select(k.alias("page_id"), _cat(f"{_HOST}/n/", k).alias("url"), _html(F.lit(""), body).alias("html")))


def _fault(when: str, kind: str, field: str, issue: str) -> str:
    quoted = f"The property '#/{field}' {issue}".replace("'", "''")
    return f"case when {when} then struct_pack(type := '{kind}', field := '{field}', issue := '{quoted}') end"


_FAULTS = ",\n      ".join([
    _fault("k % 150 > 110", "Article", "headline", "was not of a maximum string length of 110"),
    _fault("k % 3 = 0", "HowTo", "step", "did not contain a minimum number of items 1"),
    _fault("k % 3 = 1", "HowTo", "step/0/position", "did not have a minimum value of 1, inclusively"),
    _fault("k % 4 = 0", "FAQPage", "mainEntity/0", "did not contain a required property of 'acceptedAnswer'"),
    _fault("k % 4 = 1", "FAQPage", "mainEntity/0/acceptedAnswer", "did not contain a required property of 'text'"),
    _fault("k % 5 = 0", "JobPosting", "@context", "value 'http://example.com' did not match one of the following values: https://schema.org, https://schema.org/"),
    _fault("k % 5 < 2", "JobPosting", "", f"of type object {_ANY}"),
    _fault("k % 6 = 0", "BreadcrumbList", "itemListElement/0/position", "of type string did not match the following type: integer"),
])


@query(
    f"""with f as (select k, unnest(list_filter([{_FAULTS}], lambda x: x is not null)) as e from (select p_partkey as k from part))
    select k::bigint as ordinal, e.type as type, e.field as field, e.issue as issue from f"""
)
def schema_errors_nested(spark, sf_dir):
    rows = parse_pages(nested_pages(spark, sf_dir)).select("ordinal", F.explode("items").alias("i"))
    return rows.select("ordinal", F.explode("i.problems").alias("p")).select("ordinal", "p.type", "p.field", "p.issue")


@query("select 'https://shop.example.com/n/' || k as url, 5::bigint as items from (select p_partkey as k from part) where k % 150 <= 110 and k % 3 = 2 and k % 4 > 1 and k % 5 > 1 and k % 6 <> 0")
def schema_valid_pages(spark, sf_dir):
    """Pages all of whose items are valid."""
    rows = parse_pages(nested_pages(spark, sf_dir)).where(~F.exists("items", lambda i: F.size(i["problems"]) > 0))
    return rows.select("url", n(F.size("items"), "items"))


@query(
    """with l as (select c_custkey as k, c_custkey % 40 as t, row_number() over (partition by c_custkey % 40 order by c_custkey) as nth from customer),
    s as (select t, string_agg('https://shop.example.com/c/' || k, ', ' order by k) as listed, to_json(list('https://shop.example.com/c/' || k order by k))::varchar as urls from l where nth <= 3 group by t)
    select 'https://shop.example.com/t/' || t as url, 'unable to validate internal link (sources: ' || listed || ')' as message, '{"source_urls":' || urls || '}' as details from s"""
)
def first_sources(spark, sf_dir):
    """Forty targets with very many sources each, twice from every page: the first three are told."""
    k = F.col("c_custkey")
    link = _cat('<a href="/t/', k % 40, '">next</a>')
    rows = table(spark, sf_dir, "customer").select(k.alias("page_id"), _cat(f"{_HOST}/c/", k).alias("url"), _html(F.lit(""), _cat(link, link)).alias("html"))
    pages, ctx = snapshot_pages(rows), Context()
    links = link_ops.extract_links(parsed(pages))
    return link_ops.target_issues(link_ops.judged_targets(links, link_ops.resolve_targets(links, pages, ctx), ctx)).select("url", "message", "details")


# ---------------------------------------------------------------- sitemaps

_XMLNS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


@query(
    """with o as (select c_custkey as k, row_number() over (order by c_nationkey, c_custkey) - 1 as ordinal from customer where c_custkey % 7 <> 0)
    select 'https://shop.example.com/c/' || k as url, ordinal::bigint as ordinal, 'https://shop.example.com' as site from o"""
)
def sitemap_urls_in_order(spark, sf_dir):
    """Sitemaps as a table: an index of two indexes (the second names the first's documents again, and
    the root), a document for each nation with its customers, twice each; every seventh customer's
    entry stands in no namespace and doesn't count."""
    k = F.col("c_custkey")
    entry = _cat(F.when(k % 7 == 0, F.lit('<url xmlns="">')).otherwise(F.lit("<url>")), f"<loc> {_HOST}/c/", k, "/ </loc></url>")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", k.alias("k"), F.repeat(entry, F.lit(2)).alias("entry"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "entry"))), lambda x: x["entry"]), "")
    documents = rows.groupBy("c_nationkey").agg(_cat(f"<urlset {_XMLNS}>", listed, "</urlset>").alias("body")).select(_cat(f"{_HOST}/s/", F.col("c_nationkey")).alias("source"), "body")
    loc = lambda address: f"<sitemap><loc>{address}</loc></sitemap>"
    every = "".join(loc(f"{_HOST}/s/{i}") for i in range(25))
    indexes = [("root", loc(f"{_HOST}/a.xml") + loc(f"{_HOST}/b.xml")), ("a.xml", every), ("b.xml", every + loc(f"{_HOST}/root"))]
    indexes = spark.createDataFrame([(f"{_HOST}/{name}", f"<sitemapindex {_XMLNS}>{body}</sitemapindex>") for name, body in indexes], "source string, body string")
    return bulk_sitemaps(documents.unionByName(indexes), indexes.where(F.col("source") == f"{_HOST}/root"))


# ---------------------------------------------------------------- audit


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the item pages; of nine one answered 500, one is XML and one failed."""
    i = F.col("ordinal") % 9
    pages = item_pages(spark, sf_dir)
    pages = pages.withColumn("status", F.when(i == 0, 500).when(i == 2, None).otherwise(F.col("status")).cast("int")).withColumn("error", F.when(i == 2, F.lit("Timeout: no answer")))
    return audit.audit_entries(pages.withColumn("headers", F.when(i == 1, F.create_map(F.lit("content-type"), F.lit("application/xml"))).otherwise(F.col("headers"))))


_AUDIT = f"""{_ITEMS}, entries as (select k, case when k % 9 = 0 then 500 when k % 9 = 2 then null else 200 end as status,
  case when k % 9 = 2 then 'Timeout: no answer' when k % 9 = 0 then 'Non-success status' end as fetch_error, case when k % 9 = 1 then 'non-html' end as skipped_reason,
  case when k % 9 > 2 and has then 1 else 0 end as json_ld, case when k % 9 > 2 and has and event then 1 else 0 end as microdata,
  k % 9 > 2 and has and (cut or unnamed or odd_price or odd_image) as bad_json, k % 9 > 2 and has and event as bad_micro from items)"""


@query(
    f"""with {_AUDIT} select k::bigint as ordinal, status::int as status, fetch_error, skipped_reason, json_ld::bigint as json_ld_count, microdata::bigint as microdata_count, (bad_json::int + bad_micro::int)::bigint as errors,
    fetch_error is null and not bad_json and not bad_micro as ok, skipped_reason is not null or json_ld + microdata > 0 as structured_data_found from entries"""
)
def audit_entries(spark, sf_dir):
    return audited(spark, sf_dir).select("ordinal", "status", "fetch_error", "skipped_reason", "json_ld_count", "microdata_count", n(F.size("errors"), "errors"), "ok", "structured_data_found")


@query(
    f"""with {_AUDIT}, c as (select count(*)::bigint as total, count_if(fetch_error is not null)::bigint as http_errors, count_if(status = 200 and skipped_reason is null and json_ld + microdata = 0)::bigint as missing_data,
      count_if(status = 200 and (bad_json or bad_micro))::bigint as validation_errors, bool_and(fetch_error is null and not bad_json and not bad_micro) as all_ok from entries)
    select *, http_errors + missing_data + validation_errors as failure_count from c"""
)
def audit_failures(spark, sf_dir):
    return audit.failure_counts(audited(spark, sf_dir))


_PRODUCT_TEXT = """'{"@context":"https://schema.org","@type":"Product"' || case when p_partkey % 5 = 0 then '' else ',"name":"' || p_name || '"' end || ',"image":"'
  || case when p_partkey % 7 = 2 then 'not a uri' else 'https://shop.example.com/i.png' end || '","offers":{"@type":"Offer","price":' || case when p_partkey % 4 = 1 then 'true' else p_size::varchar end || '}'"""


def _problem(field: str, issue: str, kind: str) -> str:
    quoted = issue.replace("'", "''")
    return f"""'{{"field":"{field}","issue":"{quoted}","type":"{kind}"}}'"""


@query(
    f"""with {_AUDIT}, texts as (select p_partkey as k, length({_PRODUCT_TEXT}) as n from part),
    said as (select e.*, array_to_string(list_filter([
      case when k % 9 > 2 and has and cut then '{{"field":"parse","issue":"Expecting '','' delimiter: line 1 column ' || (n + 1) || ' (char ' || n || ')"}}' end,
      case when k % 9 > 2 and has and not cut and unnamed then {_problem("", "The property '#/' did not contain a required property of 'name'", "Product")} end,
      case when k % 9 > 2 and has and not cut and odd_image then {_problem("image", f"The property '#/image' of type string {_ANY}", "Product")} end,
      case when k % 9 > 2 and has and not cut and odd_price then {_problem("offers", f"The property '#/offers' of type object {_ANY}", "Product")} end,
      case when bad_micro then {_problem("startDate", "The property '#/startDate' must be a valid RFC3339 date/time string", "Event")} end], lambda x: x is not null), ',') as errors
      from entries e join items using (k) join texts using (k))
    select '{_HOST}/item/' || k as url, k::bigint as ordinal, case when k % 9 = 2 then '{{"status":"exception","error":"Timeout: no answer","structured_data_found":false,"validation_errors":[],"json_ld_count":0}}'
      when k % 9 = 0 then '{{"status":500,"error":"Non-success status","structured_data_found":false,"validation_errors":[],"json_ld_count":0}}'
      when k % 9 = 1 then '{{"status":200,"structured_data_found":true,"validation_errors":[],"json_ld_count":0,"skipped_reason":"non-html","content_type":"application/xml"}}'
      else '{{"status":200,"structured_data_found":' || (json_ld + microdata > 0) || ',"validation_errors":[' || errors || '],"json_ld_count":' || json_ld || ',"content_type":"text/html"}}' end as result from said"""
)
def audit_results_json(spark, sf_dir):
    return audit.result_rows(audited(spark, sf_dir))


# ---------------------------------------------------------------- whole audits


_WHOLE = f"""with {_ANSWERED}, html as (select *, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) as hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) as labels, {_TITLE} as title
    from answered where error is null and status = 200),
  anchors as (select page_id, site, norm, unnest(hrefs) as href, unnest(labels) as label, unnest(range(len(hrefs))) as pos from html),
  linked as (select *, site || href as target from anchors where regexp_full_match(href, '[!-~]+') and not regexp_matches(href, '[<>"|^`{{}}\\\\]') and href <> '/' and label <> ''),
  places as (select site, target, norm, min(struct_pack(o := page_id, p := pos)) as spot from linked group by site, target, norm),
  sources as (select *, row_number() over (partition by site, target order by spot) as nth from places),
  targets as (select site, target, min(spot) as spot, string_agg(norm, ', ' order by spot) as listed, '["' || string_agg(norm, '","' order by spot) || '"]' as urls from sources where nth <= 3 group by site, target),
  titles as (select site, title, min(page_id) as first, string_agg(url, ', ' order by page_id) as listed, to_json(list(url order by page_id))::varchar as urls from html where title <> '' group by site, title having count(*) > 1),
  paths as (select site, path, arg_max(norm, page_id) as url, min(page_id) as first from answered where path <> '/' group by site, path),
  seen as (select site, path from html union select site, case when final_norm = norm then path else path || '/moved' end from html)"""


@query(
    f"""{_WHOLE}
    select site, 0 as rule, 0 as part, page_id::bigint as ordinal, 0 as pos, case when error is not null then 'fetch_failed' when status = 404 then 'unexpected_status' else 'redirected_page' end as code,
      case when error is not null or status = 404 then 'error' else 'warning' end as severity, 'crawl' as category, url,
      case when error is not null then error when status = 404 then 'HTTP 404' else 'redirects to ' || final_url end as message,
      case when error is not null then '{{}}' when status = 404 then '{{"status":404}}' else '{{"final_url":"' || final_url || '","status":200}}' end as details from answered where error is not null or status = 404 or norm <> final_norm
    union all select site, 1, 0, page_id, pos, code, 'warning', 'metadata', url, message, details from html, (values (0, 'missing_meta_description', 'missing meta description', '{{}}'), (1, 'missing_canonical', 'missing canonical link', '{{}}'),
      (2, 'incomplete_open_graph_tags', 'Open Graph tags incomplete (missing og:title, og:description, og:url, og:type, og:image)', '{{"missing":["og:title","og:description","og:url","og:type","og:image"]}}')) m(pos, code, message, details)
    union all select site, 2, 0, page_id, 0, 'missing_structured_data', 'warning', 'structured_data', url, 'no structured data found; add JSON-LD or microdata markup', '{{"expected_sources":["json-ld","microdata"]}}' from html
    union all select site, 3, 0, first, 0, 'duplicate_title', 'warning', 'uniqueness', null, 'duplicate title ''' || title || ''' => ' || listed, '{{"urls":' || urls || ',"value":' || to_json(title)::varchar || '}}' from titles
    union all select site, 4, 0, spot.o, spot.p, 'unresolved_internal_link', 'warning', 'links', target, 'unable to validate internal link (sources: ' || listed || ')', '{{"source_urls":' || urls || '}}' from targets
    union all select p.site, 4, 1, first, 0, 'low_inbound_anchor_links', 'warning', 'links', p.url, 'inbound anchor links 0 below 1', '{{"inbound_count":0,"minimum":1,"source_urls":[]}}' from paths p
      where (p.site, p.path) in (select (site, path) from seen) and p.site in (select site from linked)"""
)
def issues_all(spark, sf_dir):
    """Every issue of every site of the stored pages, in order."""
    pages = answered_pages(spark, sf_dir)
    found = all_issues(url_list(pages), pages)
    return found.select("site", F.col("seq.rule").alias("rule"), F.col("seq.part").alias("part"), F.col("seq.ordinal").alias("ordinal"), F.col("seq.pos").alias("pos"), "code", "severity", "category", "url", "message", "details")


_PER_PAGE = f"""with {_ANSWERED}, html as (select * from answered where error is null and status = 200),
  s as ({_STATUS_ISSUES}), codes as (select code, severity, 'crawl' as category from s
  union all select code, 'warning', 'metadata' from html, (values ('missing_meta_description'), ('missing_canonical'), ('incomplete_open_graph_tags')) c(code)
  union all select 'missing_structured_data', 'warning', 'structured_data' from html)"""


def _per_page(spark, sf_dir):
    pages = answered_pages(spark, sf_dir)
    features, ctx = parsed(pages), Context()
    return functools.reduce(DataFrame.unionByName, [rule.apply(pages, pages, features, ctx) for rule in (Metadata(), StructuredData())], crawl_issues(pages, ctx))


@query(f"{_PER_PAGE} select severity, count(*)::bigint as issues from codes group by all")
def issues_by_severity(spark, sf_dir):
    return by(_per_page(spark, sf_dir), "severity")


@query(f"{_PER_PAGE} select category, count(*)::bigint as issues from codes group by all")
def issues_by_category(spark, sf_dir):
    return by(_per_page(spark, sf_dir), "category")


@query(f"{_PER_PAGE} select code, severity, category, count(*)::bigint as issues from codes group by all")
def issues_by_code(spark, sf_dir):
    return counted(_per_page(spark, sf_dir))
