"""Settings: values or functions without arguments, checked when they are read."""

from __future__ import annotations

import sys
from typing import Any

from pagelens.functions.schemas import SchemaRegistry
from pagelens.model import ConfigurationError
from pagelens.plans.registry import RuleRegistry
from pagelens.sources import fetch

ALLOWED_STATUSES, RENDERERS = (200, 301, 302), ("http", "browser")
SETTINGS = (
    "allowed_statuses base_url browser_factory concurrency network_idle_timeout_seconds output renderer rule_registry "
    "schema_registry scroll_page site_name sitemap_path timeout_seconds"
).split()


class Configuration:
    """cfg.name = value or function; reading gives the resolved, checked value."""

    def __init__(self, **settings: Any):
        object.__setattr__(self, "_given", {})
        for k, v in settings.items():
            setattr(self, k, v)

    def __setattr__(self, name: str, value: Any) -> None:
        if name not in SETTINGS:
            raise AttributeError(name)
        self._given[name] = value

    def _value(self, name: str) -> Any:
        v = self._given.get(name)
        # a browser factory is a function whose call makes the factory, like any other setting
        return v() if callable(v) else v

    def _positive(self, name: str, default: int) -> int:
        v = self._value(name)
        if v is None:
            return default
        try:
            n = v if isinstance(v, int) and not isinstance(v, bool) else int(v, 10)
        except (TypeError, ValueError):
            n = 0
        if n < 1:
            raise ConfigurationError(f"pagelens {name} must be an integer >= 1")
        return n

    def __getattr__(self, name: str) -> Any:
        if name not in SETTINGS:
            raise AttributeError(name)
        if name == "concurrency":
            return self._positive(name, fetch.CONCURRENCY)
        if name == "network_idle_timeout_seconds":
            return self._positive(name, fetch.IDLE_TIMEOUT)
        if name == "timeout_seconds":
            return self._positive(name, fetch.TIMEOUT)
        v = self._value(name)
        if name == "allowed_statuses":
            v = ALLOWED_STATUSES if v is None else v
            return tuple(int(s) for s in (v if isinstance(v, list | tuple | set) else [v]))
        if name == "renderer":
            v = str(v or "").strip() or "http"
            if v not in RENDERERS:
                raise ConfigurationError("pagelens renderer must be http or browser")
        elif name == "rule_registry" and v is None:
            return RuleRegistry.default(site_name=self.site_name)
        elif name == "schema_registry" and v is None:
            return SchemaRegistry.default()
        elif name == "scroll_page" and v is None:
            return True
        elif name == "output" and v is None:
            return sys.stdout
        return v

    @property
    def browser_concurrency(self) -> int:
        return min(self.concurrency, fetch.BROWSER_CONCURRENCY)

    def audit(self, spark, base_url: str | None = None, sitemap_path: str | None = None, rule_names=None):
        """A crawl of the configured site; missing addresses are errors."""
        from pagelens.plans.crawl import Crawl

        base_url = self.base_url if base_url is None else base_url
        sitemap_path = self.sitemap_path if sitemap_path is None else sitemap_path
        for name, value in (("base_url", base_url), ("sitemap_path", sitemap_path)):
            if not str(value or "").strip():
                raise ConfigurationError(f"pagelens {name} is not configured")
        return Crawl(
            spark, base_url, sitemap_path, self.rule_registry.rules_for(rule_names), self.schema_registry, self.allowed_statuses, self.concurrency,
            self.renderer, self.timeout_seconds, self.network_idle_timeout_seconds, self.scroll_page, self.browser_factory, self.site_name,
        )


_current: list[Configuration] = []


def configuration() -> Configuration:
    if not _current:
        _current.append(Configuration())
    return _current[0]


def configure(change) -> Configuration:
    change(configuration())
    return configuration()


def reset() -> None:
    _current.clear()
