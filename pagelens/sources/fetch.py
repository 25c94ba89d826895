"""Live pages: fetchers and the stages that run them on executors."""

from __future__ import annotations

import socket
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from pagelens.functions import url as urls
from pagelens.model import PAGES, ConfigurationError

USER_AGENT, REDIRECTS, TIMEOUT, CONCURRENCY, BROWSER_CONCURRENCY, IDLE_TIMEOUT, QUIET = "pagelens/1.0", 5, 20, 10, 4, 5, 0.5


@dataclass
class Fetched:
    """What a fetcher returns for a URL."""

    url: str
    final_url: str
    status: int | None = None
    headers: dict[str, str] = field(default_factory=dict)
    body: str | None = None
    error: str | None = None
    is_html: bool = False


class Fetcher(Protocol):
    def fetch(self, url: str) -> Fetched: ...
    def close(self) -> None: ...


def html_response(headers: dict[str, str]) -> bool:
    """No content type, or one that names text/html; header names in any case."""
    kind = next((v for k, v in headers.items() if k.lower() == "content-type"), "") or ""
    return kind == "" or "text/html" in kind


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = REDIRECTS
    max_repeats = REDIRECTS


class HttpFetcher:
    """GET with redirects. Network failures are error pages; programming errors are raised. Openers
    are shared by the threads of a task: they hold no connection between requests."""

    def __init__(self, base_url: str | None = None, timeout_seconds: float = TIMEOUT):
        self.base_url, self.timeout = base_url, timeout_seconds
        self.opener: Any = None

    def fetch(self, url: str) -> Fetched:
        self.opener = self.opener or urllib.request.build_opener(_Redirects)
        request = urllib.request.Request(url, headers={"User-Agent": USER_AGENT})
        try:
            try:
                answer = self.opener.open(request, timeout=self.timeout)
            except urllib.error.HTTPError as e:
                if e.code in (301, 302, 303, 307, 308):
                    raise urllib.error.URLError(f"too many redirects: {e}") from e
                answer = e
            with answer:
                headers = {k.lower(): v for k, v in answer.headers.items()}
                status, final = int(answer.status), answer.geturl()
                body = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except (urllib.error.URLError, socket.error, TimeoutError) as e:
            return Fetched(url, url, error=f"{type(e).__name__}: {e}")
        return Fetched(url, final, status, headers, body, None, status == 200 and html_response(headers))

    def close(self) -> None:
        self.opener = None


class BrowserFetcher:
    """Rendered pages from a browser object with go(url), body, idle(timeout, quiet), run(script) and
    quit(); its answer's status, headers and url are used where it has them. Pages always count as
    HTML. Errors listed by the browser as `errors`, time-outs and system errors give error pages."""

    SCROLLS = ("window.scrollTo(0, document.body.scrollHeight)", "window.scrollTo(0, 0)", "window.scrollTo(0, document.body.scrollHeight / 2)")

    def __init__(self, browser: Any, base_url: str | None = None, idle_timeout: float = IDLE_TIMEOUT, scroll_page: bool = True):
        self.browser, self.base_url, self.idle_timeout, self.scroll_page = browser, base_url, idle_timeout, scroll_page

    def _idle(self) -> None:
        self.browser.idle(self.idle_timeout, QUIET)

    def fetch(self, url: str) -> Fetched:
        try:
            answer = self.browser.go(url)
            self._idle()
            for script in self.SCROLLS if self.scroll_page else ():
                self.browser.run(script)
                self._idle()
            final = getattr(answer, "url", None) or getattr(self.browser, "current_url", None) or getattr(self.browser, "url", None) or url
            headers = {k.lower(): v for k, v in (getattr(answer, "headers", None) or {}).items()}
            return Fetched(url, final, getattr(answer, "status", None), headers, self.browser.body, None, True)
        except Exception as e:
            if isinstance(e, (TimeoutError, OSError, *getattr(self.browser, "errors", ()))):
                return Fetched(url, url, error=f"{type(e).__name__}: {e}")
            raise

    def close(self) -> None:
        if self.browser is not None:
            self.browser.quit()
            self.browser = None


def fetcher_factory(renderer: str, base_url: str | None, timeout: float = TIMEOUT, idle_timeout: float = IDLE_TIMEOUT, scroll_page: bool = True, browser_factory: Callable[[], Any] | None = None):
    """A picklable-by-closure factory for the renderer; a browser needs a factory of its own."""
    if renderer == "browser":
        if browser_factory is None:
            raise ConfigurationError("Browser rendering requires a browser_factory")

        def browser():
            made = browser_factory()
            return made if hasattr(made, "fetch") else BrowserFetcher(made, base_url, idle_timeout, scroll_page)

        return browser
    return lambda: HttpFetcher(base_url, timeout)


def _row(ordinal: int, site: str | None, f: Fetched) -> tuple:
    base = site or f.url
    return (ordinal, f.url, urls.normalize(f.url, base), f.final_url, urls.normalize(f.final_url, base), f.status, f.headers, f.body, f.error, f.is_html, site)


_COLUMNS = [c.split()[0] for c in PAGES.split(", ")]


def fetch_pages(url_rows: DataFrame, factory: Callable[[], Fetcher], threads: int = CONCURRENCY, partitions: int | None = None) -> DataFrame:
    """Pages (model.PAGES) of url_rows (ordinal, url, site). In flight at once: tasks x threads. Any
    exception of a fetch becomes an error page. Results carry their ordinal; no order is implied.

    The stage has side effects: keep its result (a table, or persist) where several plans read it."""
    rows = url_rows.select("ordinal", "url", "site")
    rows = rows.repartition(partitions) if partitions else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = None

        def one(r: tuple) -> tuple:
            try:
                return _row(r[0], r[2], fetcher.fetch(r[1]))
            except Exception as e:
                return _row(r[0], r[2], Fetched(r[1], r[1], error=f"{type(e).__name__}: {e}"))

        try:
            with ThreadPoolExecutor(threads) as pool:
                for pdf in batches:
                    for at in range(0, len(pdf), 8 * threads):
                        part = pdf.iloc[at : at + 8 * threads]
                        fetcher = fetcher or factory()
                        found = list(pool.map(one, part.itertuples(index=False, name=None)))
                        out = pd.DataFrame(found, columns=_COLUMNS)
                        out["status"] = out["status"].astype("Int32")
                        yield out
        finally:
            if fetcher is not None:
                fetcher.close()

    return rows.mapInPandas(run, PAGES)
