"""Rules and their selection by name."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame

from pagelens.model import ConfigurationError, Context
from pagelens.operators.links import Links
from pagelens.operators.metadata import Metadata
from pagelens.operators.structured_data import StructuredData
from pagelens.operators.uniqueness import Uniqueness


class Rule(Protocol):
    """A rule maps the crawl to issues (model.ISSUES); custom rules are objects like these."""

    code: str

    def apply(self, urls: DataFrame, pages: DataFrame, features: DataFrame, ctx: Context) -> DataFrame: ...


class RuleRegistry:
    def __init__(self, rules: Iterable[Rule], default_codes: Iterable[str] = ()):
        self.rules, self.default_codes = list(rules), [str(c) for c in default_codes]

    @classmethod
    def default(cls, site_name: str | None = None) -> RuleRegistry:
        rules = [Metadata(site_name), StructuredData(), Uniqueness(), Links()]
        return cls(rules, [r.code for r in rules])

    @property
    def codes(self) -> list[str]:
        return [r.code for r in self.rules]

    def rules_for(self, names: str | Iterable[str] | None = None) -> list[Rule]:
        """Rules of the names (comma-separated text or a list of such), in the registry's order."""
        given = [] if names is None else [names] if isinstance(names, str) else list(names)
        wanted = [n.strip() for v in given for n in str(v).split(",") if n.strip()] or self.default_codes
        unknown = [n for n in dict.fromkeys(wanted) if n not in self.codes]
        if unknown:
            raise ConfigurationError(f"Unknown pagelens rules: {', '.join(unknown)}")
        return [r for r in self.rules if r.code in wanted]
