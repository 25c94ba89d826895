"""Structured-data rule over the items that the parse stage extracted and validated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import url as urls
from pagelens.model import Context, issue, issues_from

SOURCES = ("json-ld", "microdata")


def _add(code: str, message: Column | str, **details: Column) -> Column:
    return issue(code, "structured_data", F.col("url"), message, **details)


def item_check(item: Column) -> Column:
    source, problems = item["source"], item["problems"]
    parse = F.concat(source, F.lit(" parse error: "), item["parse_error"])
    schema = F.concat(source, F.lit(" schema errors: "), F.to_json(problems))
    return F.when(item["parse_error"].isNotNull(), _add("structured_data_parse_error", parse, source=source)).when(
        F.size(problems) > 0, _add("structured_data_schema_error", schema, errors=problems, source=source)
    )


def job_postings() -> Column:
    """Items, not occurrences, that mention a JobPosting."""
    return F.size(F.filter("items", lambda i: F.array_contains(i["types"], "JobPosting")))


def job_check() -> Column:
    n = job_postings()
    return F.when(n > 1, _add("multiple_job_postings", "multiple JobPosting structured data blocks found", count=n)).when(
        (n == 0) & urls.career_detail_column(F.col("url")),
        _add("missing_job_posting", "career detail page missing JobPosting structured data", expected_type=F.lit("JobPosting")),
    )


class StructuredData:
    code = "structured_data"

    def apply(self, urls_: DataFrame, pages: DataFrame, features: DataFrame, ctx: Context) -> DataFrame:
        missing = _add("missing_structured_data", "no structured data found; add JSON-LD or microdata markup", expected_sources=F.array(*[F.lit(s) for s in SOURCES]))
        found = F.when(F.size("items") == 0, F.array(missing)).otherwise(F.concat(F.transform("items", item_check), F.array(job_check())))
        return issues_from(features.select("site", "ordinal", "url", "items"), found, 2)
