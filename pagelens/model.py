"""Record types shared by all stages."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGES = (
    "ordinal bigint, url string, normalized_url string, final_url string, normalized_final_url string, status int, "
    "headers map<string,string>, body string, error string, is_html boolean, site string"
)
ANCHOR = "struct<pos:int,href:string,text:string,target_url:string,target_host:string,target_path:string>"
PROBLEM = "struct<field:string,issue:string,type:string>"
ITEM = f"struct<pos:int,source:string,data_json:string,parse_error:string,type:string,types:array<string>,problems:array<{PROBLEM}>>"
FEATURES = (
    "site string, ordinal bigint, url string, normalized_url string, normalized_final_url string, title string, h1_count int, "
    f"description string, canonical string, canonical_normal string, og_present array<string>, content_text string, anchors array<{ANCHOR}>, items array<{ITEM}>"
)
LINKS = "site string, source_ordinal bigint, pos int, source_url string, source_path string, target_url string, target_path string, anchor_text string"
RESOLUTIONS = "site string, target_url string, crawled boolean, status int, final_url string, error string"
SEQ = "struct<rule:int,part:int,ordinal:bigint,pos:int>"
ISSUES = f"site string, seq {SEQ}, code string, severity string, category string, url string, message string, details string"
SEVERITIES = ("error", "warning", "notice")


class PagelensError(Exception):
    """Base of this package's errors."""


class ConfigurationError(PagelensError):
    pass


class ValidationError(PagelensError):
    pass


@dataclass(frozen=True)
class Context:
    """What rules may ask for. base_url None: every page's own origin is its site. fetcher: a
    picklable factory of an object with fetch(url) and close(), for link targets not crawled."""

    base_url: str | None = None
    allowed_statuses: tuple[int, ...] = (200, 301, 302)
    schema_registry: Any = None
    fetcher: Any = None
    site_name: str | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    def fetch(self, name: str) -> Any:
        if name in self.extra:
            return self.extra[name]
        if not hasattr(self, name):
            raise KeyError(name)
        return getattr(self, name)


@dataclass
class Result:
    base_url: str | None
    sitemap_path: str | None
    urls: DataFrame
    pages: DataFrame
    issues: DataFrame

    @property
    def ok(self) -> bool:
        return self.issues.where(F.col("severity").isin(*SEVERITIES)).isEmpty()


def seq(rule: int, part: Column | int, ordinal: Column | str, pos: Column | int = 0) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    ordinal = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.struct(
        F.lit(rule).cast("int").alias("rule"), as_column(part).cast("int").alias("part"), ordinal.cast("bigint").alias("ordinal"), as_column(pos).cast("int").alias("pos")
    )


def issue(code: str, category: str, url: Column, message: Column | str, severity: str = "warning", **details: Column) -> Column:
    """An issue as a struct; details as a JSON object."""
    said = F.to_json(F.struct(*[v.alias(k) for k, v in details.items()])) if details else F.lit("{}")
    return F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), url.cast("string").alias("url"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"), said.alias("details"),
    )


def issues_from(rows: DataFrame, found: Column, rule: int, part: int = 0) -> DataFrame:
    """rows (site, ordinal, ...) with an array of issue structs, nulls among them, as issues."""
    kept = F.filter(found, lambda x: x.isNotNull())
    out = rows.select("site", "ordinal", F.posexplode(kept).alias("pos", "i"))
    return out.select("site", seq(rule, part, "ordinal", F.col("pos")).alias("seq"), "i.*")


def by(issues: DataFrame, column: str) -> DataFrame:
    """Issue counts by severity, category or code."""
    return issues.groupBy(column).agg(F.count(F.lit(1)).cast("bigint").alias("issues"))
