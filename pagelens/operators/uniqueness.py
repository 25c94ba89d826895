"""Uniqueness rule: values that several HTML pages of a site share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.model import Context, issue, seq

FIELDS = ("title", "description", "content_fingerprint")


def duplicate_groups(features: DataFrame) -> DataFrame:
    """site, part (field's number), value, urls in page order, first ordinal, n.

    One pass for all fields. Values are counted with map-side combining first; only the rows of
    shared values are shuffled a second time and gathered, so a page that shares nothing costs one
    partial count, and Spark can split the join of a value that very many pages share."""
    each = features.select("site", "ordinal", "url", F.posexplode(F.array(*FIELDS)).alias("part", "value")).where("value <> ''")
    shared = each.groupBy("site", "part", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = each.join(shared, ["site", "part", "value"]).groupBy("site", "part", "value", "n").agg(F.sort_array(F.collect_list(F.struct("ordinal", "url"))).alias("held"))
    return rows.select("site", "part", "value", "n", F.col("held")[0]["ordinal"].alias("first"), F.transform("held", lambda x: x["url"]).alias("urls"))


class Uniqueness:
    code = "uniqueness"

    def apply(self, urls_: DataFrame, pages: DataFrame, features: DataFrame, ctx: Context) -> DataFrame:
        listed = F.array_join("urls", ", ")
        none, value, held = F.lit(None).cast("string"), F.col("value"), F.col("urls")
        quoted = lambda what: F.concat(F.lit(f"duplicate {what} '"), value, F.lit("' => "), listed)
        found = (
            F.when(F.col("part") == 0, issue("duplicate_title", "uniqueness", none, quoted("title"), urls=held, value=value))
            .when(F.col("part") == 1, issue("duplicate_meta_description", "uniqueness", none, quoted("meta description"), urls=held, value=value))
            .otherwise(issue("duplicate_content_fingerprint", "uniqueness", none, F.concat(F.lit("duplicate page content fingerprint => "), listed), urls=held))
        )
        rows = duplicate_groups(features)
        return rows.select("site", seq(3, F.col("part"), "first").alias("seq"), found.alias("i")).select("site", "seq", "i.*")
