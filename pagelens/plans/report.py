"""Text report of a crawl."""

from __future__ import annotations

from typing import TextIO

from pyspark.sql import functions as F

from pagelens.model import Result, by


def report(result: Result, io: TextIO) -> None:
    """Header, counts, then the issues in order; issues are read a partition at a time."""
    put = lambda line: print(line, file=io)
    put("pagelens validation")
    put(f"Base URL: {result.base_url}")
    put(f"Sitemap: {result.sitemap_path}")
    put(f"URLs: {result.urls.count()}")
    put(f"Pages: {result.pages.count()}")
    if result.ok:
        put("Status: OK")
        return
    counts = by(result.issues, "severity").orderBy("severity").collect()
    put("Status: FAILED")
    put(f"Issues: {sum(r.issues for r in counts)}")
    for r in counts:
        put(f"{r.severity}: {r.issues}")
    for r in result.issues.orderBy(F.col("seq")).toLocalIterator():
        put(f"- [{r.severity}] {r.url or ''} {r.message}")
