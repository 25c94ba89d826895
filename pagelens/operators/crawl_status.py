"""Crawl status: at most one issue for each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.model import Context, issue, issues_from


def redirected() -> Column:
    return F.coalesce("normalized_url", F.lit("")) != F.coalesce("normalized_final_url", F.lit(""))


def allowed(statuses: tuple[int, ...], status: str = "status") -> Column:
    """A null status is never allowed."""
    return F.coalesce(F.col(status).isin(*[int(s) for s in statuses]), F.lit(False))


def crawl_issues(pages: DataFrame, ctx: Context) -> DataFrame:
    url, status = F.col("url"), F.col("status")
    found = (
        F.when(F.col("error").isNotNull(), issue("fetch_failed", "crawl", url, F.col("error"), "error"))
        .when(~allowed(ctx.allowed_statuses), issue("unexpected_status", "crawl", url, F.concat(F.lit("HTTP "), F.coalesce(status.cast("string"), F.lit(""))), "error", status=status))
        .when(redirected(), issue("redirected_page", "crawl", url, F.concat(F.lit("redirects to "), F.col("final_url")), final_url=F.col("final_url"), status=status))
    )
    return issues_from(pages, F.array(found), 0)
