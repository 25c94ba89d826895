from __future__ import annotations

import io
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pagelens.model import ConfigurationError, ValidationError
from pagelens.plans import audit as audits
from pagelens.plans import cli, config, report
from pagelens.plans.config import Configuration
from pagelens.plans.crawl import Crawl
from pagelens.plans.registry import RuleRegistry
from pagelens.plans.run import Run
from pagelens.sources import fetch
from pagelens.sources.sitemap import bulk_sitemaps, load_sitemap, sitemap_urls

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def urlset(*locs, ns=NS):
    return f"<urlset {ns}>{''.join(f'<url><loc> {x} </loc></url>' for x in locs)}</urlset>".encode()


def index(*locs):
    return f"<sitemapindex {NS}>{''.join(f'<sitemap><loc>{x}</loc></sitemap>' for x in locs)}</sitemapindex>".encode()


def test_sitemap_remote_index_cycles_and_duplicates():
    docs = {"https://e.com/i.xml": index("/a.xml", "https://e.com/i.xml", "/b.xml?x=1"), "https://e.com/a.xml": urlset("https://e.com", "/p/", "/p"), "https://e.com/b.xml": urlset("/q?z=1")}
    assert sitemap_urls("https://e.com/i.xml", "https://e.com", docs.__getitem__) == ["https://e.com/", "https://e.com/p", "https://e.com/q"]


def test_sitemap_children_move_to_the_base():
    docs = {"http://localhost:3000/i.xml": index("https://e.com/a.xml"), "http://localhost:3000/a.xml": urlset("https://e.com/p")}
    assert sitemap_urls("http://localhost:3000/i.xml", "http://localhost:3000", docs.__getitem__) == ["http://localhost:3000/p"]


def test_sitemap_local_sibling_and_bulk(tmp_path, spark):
    (tmp_path / "i.xml").write_bytes(index("https://e.com/maps/a.xml"))
    (tmp_path / "a.xml").write_bytes(urlset("https://e.com/p/", "/q"))
    assert sitemap_urls(str(tmp_path / "i.xml"), "http://localhost:3000") == ["http://localhost:3000/p", "http://localhost:3000/q"]
    docs = {"https://e.com/i.xml": index("https://e.com/b.xml", "https://e.com/a.xml", "https://e.com/i.xml"), "https://e.com/a.xml": urlset("https://e.com/p/", "https://e.com/q"), "https://e.com/b.xml": urlset("https://e.com/q", "https://e.com/r/?a"), "https://e.com/none.xml": urlset("https://e.com/x")}
    files = spark.createDataFrame([(k, v.decode()) for k, v in docs.items()], "source string, body string")
    got = [r.url for r in bulk_sitemaps(files, files.where("source like '%/i.xml'")).orderBy("ordinal").collect()]
    assert got == sitemap_urls("https://e.com/i.xml", "https://e.com", docs.__getitem__) == ["https://e.com/q", "https://e.com/r", "https://e.com/p"]
    bare = spark.createDataFrame([("s", urlset("/p", ns="").decode())], "source string, body string")
    assert bulk_sitemaps(bare, bare).count() == 0


def test_sitemap_without_namespace_is_empty(tmp_path, spark):
    (tmp_path / "a.xml").write_bytes(urlset("/p", ns=""))
    with pytest.raises(ValidationError):
        load_sitemap(spark, str(tmp_path / "a.xml"), "https://e.com")


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        path = self.path.split("?")[0]
        kinds = {"/xml": "application/xml", "/none": None}
        if path.startswith("/loop") or path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/loop" + path[5:] + "x" if path.startswith("/loop") else "/ok")
            self.end_headers()
            return
        self.send_response(404 if path == "/gone" else 200)
        if kinds.get(path, "text/html") is not None:
            self.send_header("Content-Type", kinds.get(path, "text/html; charset=utf-8"))
        self.end_headers()
        body = '<title>ok</title><a href="/gone">g</a><script type="application/ld+json">{"@type":"Article"}</script>' if path != "/sitemap.xml" else urlset("/ok", "/moved").decode()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_fetcher(site):
    f = fetch.HttpFetcher(site, 5)
    ok, xml, none, gone, moved, loop, dead = (f.fetch(u) for u in (*[f"{site}/{p}" for p in ("ok", "xml", "none", "gone", "moved", "loop")], "http://127.0.0.1:1/"))
    assert (ok.status, ok.is_html, xml.is_html, none.is_html, gone.status, gone.is_html) == (200, True, False, True, 404, False)
    assert moved.final_url == f"{site}/ok" and moved.status == 200
    assert loop.status is None and loop.error and dead.status is None and dead.error and dead.final_url == "http://127.0.0.1:1/"
    f.opener = object()
    with pytest.raises(AttributeError):
        f.fetch(f"{site}/ok")
    f.close()


class FakeBrowser:
    errors = (KeyError,)

    def __init__(self, answer=None):
        self.answer, self.calls, self.body, self.current_url = answer, [], "<p>", "https://e.com/now"

    def go(self, url):
        if url.endswith("bad"):
            raise KeyError("x")
        if url.endswith("bug"):
            raise ZeroDivisionError
        return self.answer

    def idle(self, timeout, quiet):
        self.calls.append("idle")

    def run(self, script):
        self.calls.append("run")

    def quit(self):
        self.calls.append("quit")


def test_browser_fetcher():
    b = FakeBrowser()
    f = fetch.BrowserFetcher(b)
    page = f.fetch("https://e.com/a")
    assert page.final_url == "https://e.com/now" and page.is_html and b.calls.count("idle") == 4 and b.calls.count("run") == 3
    assert f.fetch("https://e.com/bad").error.startswith("KeyError")
    with pytest.raises(ZeroDivisionError):
        f.fetch("https://e.com/bug")
    f.close()
    f.close()
    assert b.calls[-1] == "quit"
    with pytest.raises(ConfigurationError):
        fetch.fetcher_factory("browser", None)


def test_fetch_stage_keeps_going(spark):
    class Half:
        def fetch(self, url):
            if url.endswith("1"):
                raise RuntimeError("bug")
            return fetch.Fetched(url, url, 200, {}, "<p>", None, True)

        def close(self):
            pass

    rows = spark.createDataFrame([(i, f"https://e.com/{i}", "https://e.com") for i in range(3)], "ordinal bigint, url string, site string")
    got = {r.ordinal: (r.status, r.error) for r in fetch.fetch_pages(rows, Half, 2, 1).collect()}
    assert got == {0: (200, None), 1: (None, "RuntimeError: bug"), 2: (200, None)}


def test_crawl_and_report(site, spark):
    crawl = Crawl(spark, site, f"{site}/sitemap.xml", concurrency=2, timeout_seconds=5)
    result = crawl.call()
    out = io.StringIO()
    report.report(result, out)
    text = out.getvalue()
    assert not result.ok and "Status: FAILED" in text and "URLs: 2" in text and "broken internal link (HTTP 404" in text and "redirects to" in text
    crawl.release()


def test_audit_and_reports(site, spark, tmp_path):
    urls = [f"{site}/ok", f"{site}/gone", f"{site}/xml"]
    out, path = io.StringIO(), str(tmp_path / "deep" / "r.json")
    outcome = Run(spark, Configuration(output=out, timeout_seconds=5)).validate_json_ld(urls, debug=True, report_path=path, summary=True)
    text = out.getvalue()
    assert not outcome.ok
    assert "Structured data found: 1 (JSON-LD: 1, Microdata: 0)" in text and "  Article: INVALID [json-ld]" in text and "• /gone (404: Non-success status)" in text and "VALIDATION FAILED (2/3 URLs)" in text and path in text
    saved = json.load(open(path))
    assert list(saved["results"]) == urls and saved["results"][urls[0]]["json_ld_count"] == 1 and saved["results"][urls[1]]["status"] == 404
    assert saved["results"][urls[2]]["skipped_reason"] == "non-html" and saved["results"][urls[2]]["structured_data_found"] and "generated_at" in saved
    good = audits.Outcome(outcome.entries.where("skipped_reason is not null"))
    out = io.StringIO()
    audits.AuditReporter(out).report(good)
    assert "All 1 URLs passed validation." in out.getvalue() and good.ok


def test_rule_selection():
    r = RuleRegistry.default()
    assert r.codes == ["metadata", "structured_data", "uniqueness", "links"]
    pick = lambda n: [x.code for x in r.rules_for(n)]
    assert pick(None) == pick(" ") == pick([]) == r.codes
    assert pick(["links,metadata"]) == pick("links, metadata") == ["metadata", "links"]
    with pytest.raises(ConfigurationError, match="nope"):
        r.rules_for("nope,links")
    assert RuleRegistry(r.rules).rules_for("") == []


def test_configuration():
    c = Configuration(concurrency=lambda: "12", allowed_statuses=["200", 404], site_name=lambda: "x")
    assert c.concurrency == 12 and c.browser_concurrency == 4 and c.allowed_statuses == (200, 404) and c.timeout_seconds == 20 and c.network_idle_timeout_seconds == 5 and c.scroll_page and c.renderer == "http"
    for name, value in (("renderer", "lynx"), ("timeout_seconds", 0), ("concurrency", "x")):
        with pytest.raises(ConfigurationError):
            getattr(Configuration(**{name: value}), name)
    with pytest.raises(ConfigurationError, match="base_url"):
        Configuration().audit(None)
    with pytest.raises(ConfigurationError, match="sitemap_path"):
        Configuration(base_url="https://e.com").audit(None)
    config.reset()
    config.configure(lambda x: setattr(x, "site_name", "y"))
    assert config.configuration().site_name == "y"
    config.reset()


class Task:
    def __init__(self, ok=True):
        self.ok, self.seen = ok, None

    def validate(self, **options):
        self.seen = options
        return self

    def validate_json_ld(self, urls, **options):
        self.seen = {"urls": urls, **options}
        return self


def run(*argv, env=None, ok=True):
    out, err, task, cfg = io.StringIO(), io.StringIO(), Task(ok), Configuration()
    status = cli.start(argv, out=out, err=err, config=cfg, task=task, env=env or {})
    return status, out.getvalue(), err.getvalue(), task.seen, cfg


def test_cli():
    assert run("version")[:2] == (0, "1.0.0\n") and run()[0] == 0 and "Usage" in run("help")[1]
    assert run("what")[0] == 1 and "Unknown command: what" in run("what")[2]
    status, _, _, seen, cfg = run("validate", "--url", "https://e.com", "--rules", "links", "--concurrency", "3", env={"SITEMAP": " s.xml ", "TIMEOUT": "7"})
    assert status == 0 and seen == {"base_url": "https://e.com", "sitemap_path": "s.xml", "rule_names": "links"} and cfg.concurrency == 3 and cfg.timeout_seconds == 7
    assert run("validate", ok=False)[0] == 1
    assert run("validate", "--timeout", "x")[0] == 1 and "timeout must be an integer >= 1" in run("validate", "--timeout", "x")[2]
    assert run("validate", env={"CONCURRENCY": "0"})[0] == 1 and run("validate", "--nope")[0] == 1
    status, out, _, _, cfg = run("validate", env={"JS": "1"})
    assert cfg.renderer == "browser" and cfg.concurrency == 4 and "At most 4 browser pages" in out
    assert run("validate", env={"JS": "1", "CONCURRENCY": "9"})[4].concurrency == 9
    assert run("validate", "--renderer", "browser")[4].concurrency == 10
    _, _, _, seen, _ = run("ldjson", "--url", " https://e.com/b ", "--summary", env={"URL": "https://e.com/a; ;", "DEBUG": "1", "REPORT_PATH": "r.json"})
    assert seen["urls"] == ["https://e.com/a", "https://e.com/b"] and seen["debug"] and seen["summary"] and seen["report_path"] == "r.json" and seen["renderer"] == "http"
    assert run("ldjson")[3]["urls"] == ["http://localhost:3000"]


def test_tasks():
    task = Task()
    assert cli.run_task("validate:links", env={}, out=io.StringIO(), err=io.StringIO(), task=task) == 0 and task.seen["rule_names"] == "links"
    with pytest.raises(ConfigurationError):
        cli.run_task("validate:nope", env={})


def test_run_defaults(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    r = Run(None, Configuration())
    assert r.default_base_url() == "http://localhost:3000" and r.default_sitemap_path("http://localhost:3000/") == "http://localhost:3000/sitemap.xml"
    (tmp_path / "public").mkdir()
    (tmp_path / "public" / "sitemap.xml").write_text("x")
    assert r.default_sitemap_path("http://localhost:3000").endswith("public/sitemap.xml") and r.default_sitemap_path("https://e.com") == "https://e.com/sitemap.xml"
    assert Run(None, Configuration(sitemap_path="s")).default_sitemap_path("https://e.com") == "s"


def test_streaming_pages_match_batch(spark, small, tmp_path):
    from pagelens.sources.snapshot import snapshot_pages
    from pagelens.streaming.pages import page_issues, refresh_global

    pages = snapshot_pages(spark.read.parquet(f"{small}/pages.parquet"))
    pages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    q = page_issues(stream).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["seq", "code", "url", "message"]
    assert sorted(spark.table("found").select(*key).collect()) == sorted(page_issues(pages).select(*key).collect())
    seen = {}
    q = refresh_global(stream, str(tmp_path / "snap"), lambda issues, n: seen.update({n: issues.count()})).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen[0] > 0
