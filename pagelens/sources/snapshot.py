"""Stored page tables as page snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import url as urls


def snapshot_pages(
    table: DataFrame, url: str = "url", body: str = "html", ordinal: str = "page_id", status: Column | None = None,
    final_url: Column | None = None, error: Column | None = None, content_type: Column | None = None, site: Column | None = None,
) -> DataFrame:
    """Pages (model.PAGES) from a table with a URL and HTML in each row. Without other columns every
    page answered 200 with HTML under its own URL. As with live pages, one with an error has no
    status or body, and only an answer of 200 with HTML counts as HTML."""
    error = error if error is not None else F.lit(None).cast("string")
    status = F.when(error.isNull(), (status if status is not None else F.lit(200)).cast("int"))
    kind = content_type if content_type is not None else F.lit("text/html")
    address = F.col(url)
    final = F.coalesce(final_url, address) if final_url is not None else address
    is_html = (status == 200) & ((F.coalesce(kind, F.lit("")) == "") | kind.contains("text/html"))
    return table.select(
        F.col(ordinal).cast("bigint").alias("ordinal"), address.alias("url"), urls.normalize_column(address).alias("normalized_url"),
        final.alias("final_url"), urls.normalize_column(final).alias("normalized_final_url"), status.alias("status"),
        F.create_map(F.lit("content-type"), kind).alias("headers"), F.when(error.isNull(), F.col(body)).alias("body"), error.alias("error"),
        F.coalesce(is_html, F.lit(False)).alias("is_html"), (site if site is not None else urls.origin_column(address)).alias("site"),
    )


def url_list(pages: DataFrame) -> DataFrame:
    """The URL list (url, ordinal, site) that a stored snapshot stands for."""
    return pages.groupBy("site", F.col("normalized_url").alias("url")).agg(F.min("ordinal").alias("ordinal")).select("url", "ordinal", "site")
