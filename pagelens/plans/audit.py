"""Direct audit of structured data on a list of URLs, and its reports."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime
from typing import Any, TextIO

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import url as urls
from pagelens.functions.schemas import SchemaRegistry
from pagelens.operators.features import parse_pages
from pagelens.sources.fetch import fetch_pages


def audit_entries(pages: DataFrame, registry: SchemaRegistry | None = None) -> DataFrame:
    """One entry for each page: ordinal, url, status, items, errors, fetch_error, content_type,
    skipped_reason, and json_ld_count, microdata_count, ok, structured_data_found."""
    kind = F.coalesce(F.col("headers")["content-type"], F.lit(""))
    failed = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("status").isNotNull() & ~F.col("status").between(200, 299), F.lit("Non-success status"))
    )
    base = pages.withColumn("fetch_error", failed).withColumn("content_type", kind)
    skipped = F.col("fetch_error").isNull() & (kind != "") & ~kind.contains("text/html")
    base = base.withColumn("skipped_reason", F.when(skipped, F.lit("non-html")))
    judged = base.where("fetch_error is null and skipped_reason is null").withColumn("is_html", F.lit(True))
    items = parse_pages(judged, registry).select(F.col("ordinal").alias("_ordinal"), F.col("url").alias("_url"), "items")
    rows = base.join(items, (F.col("ordinal") == F.col("_ordinal")) & (F.col("url") == F.col("_url")), "left")
    rows = rows.withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))
    parse = lambda i: F.array(F.struct(F.lit("parse").alias("field"), i["parse_error"].alias("issue"), F.lit(None).cast("string").alias("type")))
    as_error = lambda i: F.struct(
        F.when(i["parse_error"].isNotNull(), i["source"]).otherwise(F.coalesce(i["type"], i["source"])).alias("type"), i["source"].alias("source"),
        F.when(i["parse_error"].isNotNull(), parse(i)).otherwise(i["problems"]).alias("errors"),
    )
    errors = F.transform(F.filter("items", lambda i: i["parse_error"].isNotNull() | (F.size(i["problems"]) > 0)), as_error)
    count = lambda source: F.size(F.filter("items", lambda i: i["source"] == source)).cast("bigint")
    rows = rows.withColumn("errors", errors)
    return rows.select(
        "ordinal", "url", "status", "items", "errors", "fetch_error", "content_type", "skipped_reason",
        count("json-ld").alias("json_ld_count"), count("microdata").alias("microdata_count"),
        (F.col("fetch_error").isNull() & (F.size("errors") == 0)).alias("ok"),
        (F.col("skipped_reason").eqNullSafe("non-html") | (F.size("items") > 0)).alias("structured_data_found"),
    )


# The three kinds of failure; each is a filter on entries.


def http_error() -> Column:
    return F.col("fetch_error").isNotNull() & ~F.col("status").eqNullSafe(200)


def missing_data() -> Column:
    return F.col("status").eqNullSafe(200) & ~F.col("structured_data_found")


def validation_error() -> Column:
    return F.col("status").eqNullSafe(200) & (F.size("errors") > 0)


def failure_counts(entries: DataFrame) -> DataFrame:
    """total, http_errors, missing_data, validation_errors, failure_count, all_ok."""
    n = lambda c: F.count_if(c).cast("bigint")
    out = entries.agg(F.count(F.lit(1)).cast("bigint").alias("total"), n(http_error()).alias("http_errors"), n(missing_data()).alias("missing_data"), n(validation_error()).alias("validation_errors"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_ok"))
    return out.withColumn("failure_count", F.col("http_errors") + F.col("missing_data") + F.col("validation_errors"))


def result_rows(entries: DataFrame) -> DataFrame:
    """url, result: the JSON report's record of each URL; of repeated URLs the last counts."""
    failed = F.col("fetch_error").isNotNull()
    no_errors = F.array().cast("array<string>")
    flat = F.flatten(F.transform("errors", lambda e: e["errors"]))
    error_shape = F.to_json(F.struct(
        F.when(F.col("status").isNull(), F.lit("exception")).otherwise(F.col("status").cast("string")).alias("status"), F.col("fetch_error").alias("error"),
        F.lit(False).alias("structured_data_found"), no_errors.alias("validation_errors"), F.lit(0).alias("json_ld_count"),
    ))
    # a status is a number where there is one
    error_shape = F.regexp_replace(error_shape, r'^\{"status":"(\d+)"', r'{"status":$1')
    good = F.to_json(F.struct(
        F.coalesce("status", F.lit(200)).alias("status"), "structured_data_found", flat.alias("validation_errors"), "json_ld_count", "skipped_reason", "content_type",
    ))
    return entries.groupBy("url").agg(F.max_by(F.when(failed, error_shape).otherwise(good), "ordinal").alias("result"), F.min("ordinal").alias("ordinal"))


@dataclass
class Outcome:
    entries: DataFrame

    @property
    def ok(self) -> bool:
        return self.entries.where(~F.col("ok")).isEmpty()


def audit_urls(spark: SparkSession, url_list: Iterable[str], fetcher: Callable[[], Any], registry: SchemaRegistry | None = None) -> Outcome:
    """Fetches and audits a list of URLs; the first one is the base of relative ones."""
    found = list(url_list)
    base = (found[0] if found else "") or "http://localhost:3000"
    rows = spark.createDataFrame([(i, u, base) for i, u in enumerate(found)], "ordinal bigint, url string, site string")
    pages = fetch_pages(rows, fetcher, threads=1, partitions=1).persist(StorageLevel.MEMORY_AND_DISK)
    return Outcome(audit_entries(pages, registry).persist(StorageLevel.MEMORY_AND_DISK))


class AuditReporter:
    """Text reports; entries are read in order, a partition at a time."""

    def __init__(self, io: TextIO, report_path: str | None = None):
        self.io, self.report_path = io, report_path

    def _put(self, *lines: str) -> None:
        for line in lines:
            print(line, file=self.io)

    def details(self, outcome: Outcome, debug: bool = False, renderer: str = "http") -> None:
        if renderer == "browser":
            self._put("JavaScript mode enabled")
        self._put(f"Validating JSON-LD on {outcome.entries.count()} URL(s)", "")
        for e in outcome.entries.orderBy("ordinal").toLocalIterator():
            self._entry(e, debug)
        self._put(f"STATUS: {'OK' if outcome.ok else 'FAILED'}")

    def _entry(self, e, debug: bool) -> None:
        self._put("=" * 80, f"URL: {e.url}", "=" * 80)
        if e.fetch_error is not None:
            self._put(f"Error: {e.fetch_error}", "")
            return
        self._put(f"Status: {e.status}" if e.status is not None else "Status: JS runtime fetch")
        self._put(f"Structured data found: {len(e['items'])} (JSON-LD: {e.json_ld_count}, Microdata: {e.microdata_count})")
        if debug and e["items"]:
            self._put("", "--- Detected Structured Data ---")
            for i, item in enumerate(e["items"], 1):
                shown = json.loads(item.data_json) if item.data_json is not None else {"error": True, "message": item.parse_error}
                self._put("", f"## Item {i} [{item.source}]", json.dumps(shown, indent=2, ensure_ascii=False))
            self._put("", "--- End ---")
        self._put("", "Validation results:")
        if not e.errors:
            self._put("  All valid!")
        for error in e.errors:
            self._put(f"  {error.type}: INVALID [{error.source}]", *[f"    - field: {p.field}, issue: {p.issue}" for p in error.errors])
        self._put("")

    def report(self, outcome: Outcome) -> None:
        n = failure_counts(outcome.entries).first()
        self._put("")
        if not n.failure_count:
            self._put(f"All {n.total} URLs passed validation.")
            return
        self._put(f"VALIDATION FAILED ({n.failure_count}/{n.total} URLs)", "")
        for name, chosen, count in (("HTTP ERRORS", http_error(), n.http_errors), ("MISSING STRUCTURED DATA", missing_data(), n.missing_data), ("VALIDATION ERRORS", validation_error(), n.validation_errors)):
            if not count:
                continue
            self._put(f"{name} ({count}):")
            for e in outcome.entries.where(chosen).orderBy("ordinal").toLocalIterator():
                why = f" ({'' if e.status is None else e.status}: {e.fetch_error})" if name == "HTTP ERRORS" else ""
                self._put(f"• {urls.shown_path(e.url)}{why}")
                if name == "VALIDATION ERRORS":
                    self._put(*[f"    - {p.field or '$'}: {p.issue or 'Unknown error'}" for error in e.errors for p in error.errors])
            self._put("")
        if self.report_path:
            self._put(f"Full details available in: {self.report_path}")
        self._put(f"{n.failure_count} of {n.total} URLs failed validation.")


def write_report(outcome: Outcome, path: str) -> None:
    """One JSON file with all results; for large tables write result_rows() with Spark instead."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    results = {r.url: json.loads(r.result) for r in result_rows(outcome.entries).orderBy("ordinal").toLocalIterator()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"generated_at": datetime.now().astimezone().isoformat(timespec="seconds"), "results": results}, f, indent=2, ensure_ascii=False)
