from __future__ import annotations

import json

from pyspark.sql import functions as F

from pagelens.model import PAGES, Context, by
from pagelens.operators.links import extract_links, page_index
from pagelens.operators.features import parse_pages
from pagelens.plans.crawl import all_issues
from pagelens.plans.registry import RuleRegistry
from pagelens.sources.fetch import Fetched

S = "https://example.com"
LONG = "Plain words that say what this page is about, at a length that search engines show in full without cutting it off."
OG = "".join(f'<meta property="og:{p}" content="x">' for p in ("title", "description", "url", "type", "image"))
ITEM = '<script type="application/ld+json">{"@type":"WebPage"}</script>'


def page(path, body="", status=200, final=None, error=None, head=None, site=S, is_html=None):
    url = f"{site}{path}"
    norm = url if path != "" else f"{url}/"
    head = f'<title>T {path}</title><meta name="description" content="{LONG} {path}"><link rel="canonical" href="{url}">{OG}' if head is None else head
    html = f"<html><head>{head}</head><body><h1>x</h1>{body}{ITEM}</body></html>"
    f = f"{site}{final}" if final else norm
    return (url, norm, f, f, status if error is None else None, {"content-type": "text/html"}, html if error is None else None, error, error is None and status == 200 if is_html is None else is_html, site)


def audit(spark, pages, urls=None, rules=None, **ctx):
    rows = [(i, *p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, PAGES)
    listed = spark.createDataFrame([(p[1], i, p[9]) for i, p in enumerate(pages)] if urls is None else [(u, i, S) for i, u in enumerate(urls)], "url string, ordinal bigint, site string")
    return all_issues(listed, df, Context(**ctx), RuleRegistry.default(ctx.get("site_name")).rules_for(rules), keep=False).orderBy("seq")


def codes(issues):
    return [r.code for r in issues.collect()]


def test_status_chain(spark):
    found = audit(spark, [page("/a", error="Timeout: x"), page("/b", status=404), page("/c", final="/d"), page("/e"), page("/f", status=301, is_html=False)], rules="metadata").where("category = 'crawl'").collect()
    assert [(r.code, r.severity, r.message) for r in found] == [("fetch_failed", "error", "Timeout: x"), ("unexpected_status", "error", "HTTP 404"), ("redirected_page", "warning", f"redirects to {S}/d")]
    assert json.loads(found[2].details) == {"final_url": f"{S}/d", "status": 200}


def test_metadata_of_a_poor_page(spark):
    head = f'<title>Acme page about acme</title><meta name="description" content="{"d" * 161}">'
    rows = audit(spark, [page("/", "<h1>two</h1>", head=head)], rules="metadata", site_name="ACME").collect()
    assert [r.code for r in rows] == ["multiple_h1", "title_repeats_site_name", "meta_description_too_long", "missing_canonical", "incomplete_open_graph_tags"]
    assert [r.message for r in rows][:3] == ["multiple <h1> tags (2)", "title repeats ACME", "meta description too long (161)"]
    assert json.loads(rows[4].details) == {"missing": ["og:title", "og:description", "og:url", "og:type", "og:image"]}


def test_metadata_limits(spark):
    def one(title, description):
        return page("/x", head=f'<title>{title}</title><meta name="description" content="{description}"><link rel="canonical" href="/x">{OG}')

    for title, description, expected in (
        ("t" * 72, "d" * 110, []), ("t" * 73, "d" * 160, ["title_too_long"]), ("t", "d" * 109, ["meta_description_too_short"]), ("", "d" * 161, ["missing_title", "meta_description_too_long"]),
        ("a a " + "t" * 70, " ", ["title_too_long", "missing_meta_description"]),
    ):
        assert codes(audit(spark, [one(title, description)], rules="metadata", site_name="a")) == expected


def test_canonical(spark):
    def one(href, site=S):
        return page("/x", site=site, head=f'<title>t</title><meta name="description" content="{LONG}"><link rel="canonical" href="{href}">{OG}')

    cases = {"/x/?a=1#b": [], f"{S}/x": [], "http://example.com/x": ["canonical_mismatch"], f"{S}/y": ["canonical_mismatch"], "https://www.example.com/x": ["canonical_mismatch"], "": ["missing_canonical"]}
    for href, expected in cases.items():
        assert codes(audit(spark, [one(href)], rules="metadata")) == expected, href
    assert codes(audit(spark, [one("https://example.com/x", "http://localhost:3000")], rules="metadata")) == []
    assert codes(audit(spark, [one("https://example.com/y", "http://localhost:3000")], rules="metadata")) == ["canonical_mismatch"]


def test_uniqueness(spark):
    text = f"<main>{'word ' * 60}</main>"
    same = f'<title>t</title><meta name="description" content="d">'
    rows = audit(spark, [page("/a", text, head=same), page("/b", text.replace(" ", "\n "), head=same), page("/c", "<main>short</main>", head="<title></title>"), page("/d", "<main>short</main>", head="<title></title>")], rules="uniqueness").collect()
    assert [(r.code, r.url, r.message) for r in rows] == [
        ("duplicate_title", None, f"duplicate title 't' => {S}/a, {S}/b"), ("duplicate_meta_description", None, f"duplicate meta description 'd' => {S}/a, {S}/b"),
        ("duplicate_content_fingerprint", None, f"duplicate page content fingerprint => {S}/a, {S}/b"),
    ]
    assert json.loads(rows[2].details) == {"urls": [f"{S}/a", f"{S}/b"]}


def test_fingerprint_needs_200_characters(spark):
    for n, expected in ((199, []), (200, ["duplicate_content_fingerprint"])):
        pages = [page(p, f"<main>{'x' * n}</main>") for p in ("/a", "/b")]
        assert [c for c in codes(audit(spark, pages, rules="uniqueness"))] == expected


def test_structured_data(spark):
    def one(path, *scripts):
        p = list(page(path))
        p[6] = "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)
        return tuple(p)

    job = '{"@type":["JobPosting"]}'
    rows = audit(spark, [one("/none"), one("/bad", '{"@type":"Article"}', '{"@type":'), one("/careers/x", '{"@type":"WebPage"}'), one("/two", job, job), one("/graph", '{"@graph":[%s,%s]}' % (job, job)), one("/careers/y")], rules="structured_data").collect()
    assert [(r.code, r.url.removeprefix(S)) for r in rows] == [
        ("missing_structured_data", "/none"), ("structured_data_schema_error", "/bad"), ("structured_data_parse_error", "/bad"), ("missing_job_posting", "/careers/x"), ("multiple_job_postings", "/two"), ("missing_structured_data", "/careers/y"),
    ]
    assert json.loads(rows[1].details)["errors"][0]["type"] == "Article" and json.loads(rows[0].details) == {"expected_sources": ["json-ld", "microdata"]}


def a(href, text="go"):
    return f'<a href="{href}">{text}</a>'


def test_links_broken_and_first_three_sources(spark):
    pages = [page(f"/{i}", a("/gone") + a("/gone") + a(f"/{(i + 1) % 5}")) for i in range(5)] + [page("/gone", status=404)]
    rows = audit(spark, pages, rules="links").where("category = 'links'").collect()
    assert [(r.code, r.message) for r in rows] == [("broken_internal_link", f"broken internal link (HTTP 404, sources: {S}/0, {S}/1, {S}/2)")]


def test_links_without_resolution_and_errors(spark):
    pages = [page("/a", a("/b") + a("/missing") + a("/failed")), page("/b", a("/a")), page("/failed", error="Timeout: x")]
    rows = audit(spark, pages, rules="links").where("category = 'links'").collect()
    assert [(r.code, r.url) for r in rows] == [("unresolved_internal_link", f"{S}/missing")]
    assert rows[0].message == f"unable to validate internal link (sources: {S}/a)"


class Failing:
    def fetch(self, url):
        return Fetched(url, url, error="Reset: peer") if url.endswith("/down") else Fetched(url, url.replace("/old", "/new"), 200, {}, "", None, True)

    def close(self):
        pass


def test_links_fetched_on_demand(spark):
    rows = audit(spark, [page("/a", a("/down") + a("/old") + a("/b")), page("/b", a("/a"))], rules="links", fetcher=Failing).where("category = 'links'").collect()
    assert [(r.code, r.message) for r in rows] == [
        ("unresolved_internal_link", f"unable to validate internal link (Reset: peer) (sources: {S}/a)"), ("internal_link_redirects", f"internal link redirects to {S}/new (sources: {S}/a)"),
    ]


def test_low_inbound(spark):
    rows = audit(spark, [page("/", a("/about")), page("/about", a("/") + a("/about")), page("/lone")], rules="links").collect()
    assert [(r.code, r.url, r.message) for r in rows] == [("low_inbound_anchor_links", f"{S}/lone", "inbound anchor links 0 below 1")]
    assert json.loads(rows[0].details) == {"inbound_count": 0, "minimum": 1, "source_urls": []}


def test_no_links_no_low_inbound(spark):
    assert codes(audit(spark, [page("/a"), page("/b")], rules="links")) == []


def test_redirected_target_counts_for_its_final_page(spark):
    pages = [page("/a", a("/old")), page("/old", a("/a"), final="/new"), page("/new", a("/a"))]
    rows = audit(spark, pages, rules="links").where("category = 'links'").collect()
    assert [(r.code, r.url) for r in rows] == [("internal_link_redirects", f"{S}/old"), ("low_inbound_anchor_links", f"{S}/old")]


def test_skipped_links(spark):
    body = a("#x") + a("mailto:x@y") + a("tel:1") + a("javascript:x") + a("data:x") + a("https://other.com/x") + a("/rails/x") + a("/cdn-cgi/x") + a("/x", "<img src=y>") + a("/") + a("/für") + a(" /b#c ")
    df = spark.createDataFrame([(0, *page("/a", body))], PAGES)
    assert [(r.target_url, r.anchor_text) for r in extract_links(parse_pages(df)).collect()] == [(f"{S}/b", "go")]


def test_page_index_keeps_the_last(spark):
    pages = [page("/a", status=404), page("/b", final="/a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], PAGES)
    assert {r.target_url: r.page.status for r in page_index(df).collect()} == {f"{S}/a": 200, f"{S}/b": 200}


def test_sites_are_apart(spark):
    other = "https://example.org"
    rows = audit(spark, [page("/a", head="<title>t</title>"), page("/b", head="<title>t</title>", site=other), page("/c", a("/d"), site=other)], rules="uniqueness,links")
    assert [(r.code, r.site) for r in rows.collect()] == [("unresolved_internal_link", other), ("low_inbound_anchor_links", other), ("low_inbound_anchor_links", other)]


def test_empty_tables(spark):
    assert codes(audit(spark, [])) == []


def test_custom_rule_and_counts(spark):
    class Titles:
        code = "titles"

        def apply(self, urls, pages, features, ctx):
            from pagelens.model import issue, issues_from

            return issues_from(features, F.array(issue("short_title", "titles", F.col("url"), "short", "notice")), 9)

    df = spark.createDataFrame([(0, *page("/a"))], PAGES)
    found = all_issues(df, df, Context(extra={"k": 1}), [Titles()])
    assert [tuple(r) for r in by(found, "severity").collect()] == [("notice", 1)]
    assert Context(extra={"k": 1}).fetch("k") == 1
