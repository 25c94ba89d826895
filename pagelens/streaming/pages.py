"""Rules over a stream of page snapshots: an extension, the batch audit is the specification.

Crawl status, metadata and structured data judge each page by itself, so their plans run on a
stream unchanged and without state. Uniqueness and links compare pages: refresh_global runs them
over the accumulated snapshot for each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from pagelens.model import Context
from pagelens.operators.crawl_status import crawl_issues
from pagelens.operators.features import parse_pages, with_fingerprint
from pagelens.operators.metadata import Metadata
from pagelens.operators.structured_data import StructuredData
from pagelens.plans.crawl import all_issues
from pagelens.sources.snapshot import url_list


def page_issues(pages: DataFrame, ctx: Context | None = None) -> DataFrame:
    """Issues of the per-page rules for a streaming (or batch) DataFrame of pages."""
    ctx = ctx or Context()
    features = with_fingerprint(parse_pages(pages, ctx.schema_registry))
    out = crawl_issues(pages, ctx)
    for rule in (Metadata(ctx.site_name), StructuredData()):
        out = out.unionByName(rule.apply(pages, pages, features, ctx))
    return out


def refresh_global(pages: DataFrame, snapshot_path: str, sink: Callable[[DataFrame, int], None], ctx: Context | None = None) -> DataStreamWriter:
    """A writer that appends each micro-batch to the snapshot table, once per batch id, and hands
    the issues of the whole snapshot to sink(issues, batch_id)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{snapshot_path}/batch={batch_id}")
        whole = spark.read.parquet(snapshot_path).drop("batch")
        sink(all_issues(url_list(whole), whole, ctx, keep=False), batch_id)

    return pages.writeStream.foreachBatch(each)
