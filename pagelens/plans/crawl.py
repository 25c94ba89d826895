"""The audit of a site: pages to features to issues."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pagelens.functions.schemas import SchemaRegistry
from pagelens.model import Context, Result
from pagelens.operators.crawl_status import crawl_issues
from pagelens.operators.features import parse_pages, with_fingerprint
from pagelens.plans.registry import Rule, RuleRegistry
from pagelens.scratch import remove, stored, written
from pagelens.sources import fetch
from pagelens.sources.sitemap import load_sitemap, read_source


def all_issues(urls: DataFrame, pages: DataFrame, ctx: Context | None = None, rules: Iterable[Rule] | None = None, keep: bool = True) -> DataFrame:
    """Issues (model.ISSUES) of stored or fetched pages. The parse runs once: features are written as a
    table for the rules that follow, unless `keep` is off or one rule alone reads them."""
    ctx = ctx or Context()
    rules = RuleRegistry.default(ctx.site_name).rules if rules is None else list(rules)
    features = with_fingerprint(parse_pages(pages, ctx.schema_registry))
    if keep and len(rules) > 1:
        features = stored(features, "features")
    out = crawl_issues(pages, ctx)
    for rule in rules:
        out = out.unionByName(rule.apply(urls, pages, features, ctx))
    return out


class Crawl:
    """One site from its sitemap; call() gives the Result. Fetched pages are written as a table: no plan
    that reads them fetches again, not even where an executor is lost, and they are read in as many
    parts as their size asks for, however few tasks fetched them. release() gives the storage back."""

    def __init__(
        self, spark: SparkSession, base_url: str, sitemap_path: str, rules: Iterable[Rule] | None = None, schema_registry: SchemaRegistry | None = None,
        allowed_statuses: Iterable[int] = (200, 301, 302), concurrency: int = fetch.CONCURRENCY, renderer: str = "http", timeout_seconds: float = fetch.TIMEOUT,
        network_idle_timeout_seconds: float = fetch.IDLE_TIMEOUT, scroll_page: bool = True, browser_factory: Callable[[], Any] | None = None,
        site_name: str | None = None, read: Callable[[str], bytes] = read_source, fetcher: Callable[[], Any] | None = None,
    ):
        self.spark, self.base_url, self.sitemap_path, self.read = spark, base_url, sitemap_path, read
        self.rules = RuleRegistry.default(site_name).rules if rules is None else list(rules)
        self.concurrency = concurrency
        self.factory = fetcher or fetch.fetcher_factory(renderer, base_url, timeout_seconds, network_idle_timeout_seconds, scroll_page, browser_factory)
        self.ctx = Context(base_url, tuple(allowed_statuses), schema_registry or SchemaRegistry.default(), self.factory, site_name)
        self.kept: list[str] = []

    def call(self) -> Result:
        urls = load_sitemap(self.spark, self.sitemap_path, self.base_url, self.read)
        workers = max(1, min(self.concurrency, self.spark.sparkContext.defaultParallelism))
        pages = fetch.fetch_pages(urls, self.factory, threads=max(1, self.concurrency // workers), partitions=workers)
        pages, at = written(pages, "pages")
        issues, by = written(all_issues(urls, pages, self.ctx, self.rules), "issues")
        self.kept += [at, by]
        return Result(self.base_url, self.sitemap_path, urls, pages, issues)

    def release(self) -> None:
        for path in self.kept:
            remove(self.spark, path)
        self.kept.clear()
