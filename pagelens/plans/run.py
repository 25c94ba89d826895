"""Run with defaults filled in: what the command line and library callers use."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import SparkSession

from pagelens.functions import url as urls
from pagelens.model import Result
from pagelens.plans import audit, report
from pagelens.plans.config import Configuration, configuration
from pagelens.sources.fetch import fetcher_factory

DEFAULT_BASE = "http://localhost:3000"


def local_path_default(base_url: str | None) -> bool:
    return urls.host(str(base_url or "")) in ("localhost", "127.0.0.1")


class Run:
    def __init__(self, spark: SparkSession, config: Configuration | None = None):
        self.spark, self.config = spark, config or configuration()

    def default_base_url(self) -> str:
        value = self.config.base_url
        return value if str(value or "").strip() else DEFAULT_BASE

    def default_sitemap_path(self, base_url: str) -> str:
        value = self.config.sitemap_path
        if str(value or "").strip():
            return value
        local = os.path.join(os.getcwd(), "public", "sitemap.xml")
        if local_path_default(base_url) and os.path.exists(local):
            return local
        return f"{base_url[:-1] if base_url.endswith('/') else base_url}/sitemap.xml"

    def validate(self, base_url: str | None = None, sitemap_path: str | None = None, rule_names=None) -> Result:
        base = base_url or self.default_base_url()
        crawl = self.config.audit(self.spark, base, sitemap_path or self.default_sitemap_path(base), rule_names)
        result = crawl.call()
        report.report(result, self.config.output)
        return result

    def validate_json_ld(
        self, url_list: Iterable[str], debug: bool = False, renderer: str | None = None, timeout_seconds: float | None = None,
        report_path: str | None = None, summary: bool = False,
    ) -> audit.Outcome:
        found, cfg = list(url_list), self.config
        renderer = renderer or cfg.renderer
        factory = fetcher_factory(renderer, found[0] if found else DEFAULT_BASE, timeout_seconds or cfg.timeout_seconds, cfg.network_idle_timeout_seconds, cfg.scroll_page, cfg.browser_factory)
        outcome = audit.audit_urls(self.spark, found, factory, cfg.schema_registry)
        reporter = audit.AuditReporter(cfg.output, report_path)
        reporter.details(outcome, debug, renderer)
        if report_path:
            audit.write_report(outcome, report_path)
        if summary:
            reporter.report(outcome)
        return outcome
