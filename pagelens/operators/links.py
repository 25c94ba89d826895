"""Links rule: extract, resolve and judge internal links, and count inbound ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import url as urls
from pagelens.model import RESOLUTIONS, Context, issue, seq
from pagelens.operators.crawl_status import allowed

#: Fixed values.
SKIPPED_SCHEMES = ("mailto:", "tel:", "javascript:", "data:")
SKIPPED_PATHS = ("/rails/", "/cdn-cgi/")
SOURCES_SHOWN, MIN_INBOUND = 3, 1


def crawlable_href(href: Column) -> Column:
    ok = (href != "") & ~href.startswith("#")
    for scheme in SKIPPED_SCHEMES:
        ok &= ~href.startswith(scheme)
    return ok


def internal_path(path: Column) -> Column:
    """Usable as a source: known, and under none of the skipped prefixes; the root is."""
    ok = path.isNotNull()
    for prefix in SKIPPED_PATHS:
        ok &= ~path.startswith(prefix)
    return F.coalesce(ok, F.lit(False))


def crawlable_path(path: Column) -> Column:
    """Usable as a target: as internal_path, and not the root."""
    return internal_path(path) & F.coalesce(path != "/", F.lit(False))


def extract_links(features: DataFrame) -> DataFrame:
    """One row for each internal link with text (schema model.LINKS)."""
    rows = features.select("site", "ordinal", "url", "normalized_url", "anchors").withColumn("source_path", urls.path_column(F.col("normalized_url")))
    rows = rows.where(internal_path(F.col("source_path")))
    usable = F.filter("anchors", lambda a: crawlable_href(a["href"]) & (a["text"] != "") & a["target_url"].isNotNull())
    rows = rows.select("site", urls.host_column(F.col("site")).alias("host"), "ordinal", "normalized_url", "source_path", F.explode(usable).alias("a"))
    rows = rows.where((F.col("a.target_host") == F.col("host")) & crawlable_path(F.col("a.target_path")))
    return rows.select(
        "site", F.col("ordinal").alias("source_ordinal"), F.col("a.pos").alias("pos"), F.col("normalized_url").alias("source_url"), "source_path",
        "a.target_url", "a.target_path", F.col("a.text").alias("anchor_text"),
    )


def page_index(pages: DataFrame) -> DataFrame:
    """site, target_url, page: pages by normalised and by normalised final URL; the last one wins."""
    page = F.struct("status", "error", "normalized_final_url")
    keyed = pages.select("site", "ordinal", page.alias("page"), F.explode(F.array("normalized_url", "normalized_final_url")).alias("target_url"))
    return keyed.where("target_url <> ''").groupBy("site", "target_url").agg(F.max_by("page", "ordinal").alias("page"))


def resolve_targets(links: DataFrame, pages: DataFrame, ctx: Context) -> DataFrame:
    """Resolutions of the distinct targets (model.RESOLUTIONS); what was neither crawled nor could be
    fetched has no row. Each missing target is fetched once."""
    targets = links.select("site", "target_url").distinct()
    index = page_index(pages)
    final = F.coalesce("page.normalized_final_url", "target_url")
    known = targets.join(index, ["site", "target_url"]).select(
        "site", "target_url", F.lit(True).alias("crawled"), "page.status", final.alias("final_url"), "page.error"
    )
    if ctx.fetcher is None:
        return known
    from pagelens.sources.fetch import fetch_pages

    missing = targets.join(index.select("site", "target_url"), ["site", "target_url"], "left_anti")
    got = fetch_pages(missing.select(F.lit(0).cast("bigint").alias("ordinal"), F.col("target_url").alias("url"), "site"), ctx.fetcher)
    fetched = got.select(
        "site", F.col("url").alias("target_url"), F.lit(False).alias("crawled"), "status",
        F.coalesce("normalized_final_url", "url").alias("final_url"), "error",
    )
    return known.unionByName(fetched)


def judged_targets(links: DataFrame, resolutions: DataFrame, ctx: Context) -> DataFrame:
    """One row for each target: its resolution, disposition, first three sources and first place."""
    first = F.min(F.struct("source_ordinal", "pos"))
    by_source = links.groupBy("site", "target_url", "source_url").agg(first.alias("at"))
    # row_number below a limit: Spark keeps the first few of each target before the shuffle, so a
    # target that very many pages link to gathers three rows from each task and no more
    rank = F.row_number().over(Window.partitionBy("site", "target_url").orderBy("at"))
    top = by_source.withColumn("rank", rank).where(F.col("rank") <= SOURCES_SHOWN)
    grouped = top.groupBy("site", "target_url").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "source_url"))).alias("top"))
    rows = grouped.join(resolutions, ["site", "target_url"], "left")
    known = F.col("crawled").isNotNull()
    ignored = F.coalesce(F.col("status").isNull() & F.col("crawled") & F.col("error").isNotNull(), F.lit(False))
    final_url = F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("target_url"))
    rows = rows.withColumn("final_url", F.when(known, final_url)).withColumn("final_path", urls.path_column(F.col("final_url")))
    redirect = F.coalesce(F.col("status").between(300, 399), F.lit(False)) | (F.col("final_url") != F.col("target_url"))
    disposition = (
        F.when(~known | (F.col("status").isNull() & ~ignored), "unresolved")
        .when(ignored, "ignored")
        .when(~allowed(ctx.allowed_statuses), "broken")
        .when(redirect, F.when(crawlable_path(F.col("final_path")), "redirect").otherwise("redirect_out"))
        .when(~crawlable_path(F.col("final_path")), "out")
        .otherwise("kept")
    )
    return rows.withColumn("disposition", disposition).withColumn("sources", F.transform("top", lambda x: x["source_url"])).drop("top")


def target_issues(judged: DataFrame) -> DataFrame:
    target, status, sources = F.col("target_url"), F.col("status"), F.col("sources")
    tail = F.concat(F.lit("sources: "), F.array_join(sources, ", "), F.lit(")"))
    why = F.when(F.col("error").isNotNull(), F.concat(F.lit(" ("), F.col("error"), F.lit(")"))).otherwise("")
    found = (
        F.when(F.col("disposition") == "unresolved", issue("unresolved_internal_link", "links", target, F.concat(F.lit("unable to validate internal link"), why, F.lit(" ("), tail), error=F.col("error"), source_urls=sources))
        .when(F.col("disposition") == "broken", issue("broken_internal_link", "links", target, F.concat(F.lit("broken internal link (HTTP "), status.cast("string"), F.lit(", "), tail), source_urls=sources, status=status))
        .when(F.col("disposition").startswith("redirect"), issue("internal_link_redirects", "links", target, F.concat(F.lit("internal link redirects to "), F.col("final_url"), F.lit(" ("), tail), final_url=F.col("final_url"), source_urls=sources, status=status))
    )
    return judged.select("site", seq(4, 0, F.col("at.source_ordinal"), F.col("at.pos")).alias("seq"), found.alias("i")).where("i is not null").select("site", "seq", "i.*")


def sitemap_paths(url_list: DataFrame) -> DataFrame:
    """site, path, url (last of a path wins), ordinal (of the first)."""
    rows = url_list.select("site", "ordinal", urls.normalize_column(F.col("url")).alias("url")).withColumn("path", urls.path_column(F.col("url")))
    return rows.where(crawlable_path(F.col("path"))).groupBy("site", "path").agg(F.max_by("url", "ordinal").alias("url"), F.min("ordinal").alias("ordinal"))


def html_paths(pages: DataFrame) -> DataFrame:
    rows = pages.where("is_html").select("site", F.explode(F.array("normalized_url", "normalized_final_url")).alias("u"))
    return rows.select("site", urls.path_column(F.col("u")).alias("path")).where(crawlable_path(F.col("path"))).distinct()


def inbound_counts(links: DataFrame, judged: DataFrame, url_list: DataFrame, pages: DataFrame) -> DataFrame:
    """site, path, url, ordinal, inbound: links (occurrences) from other pages to each listed HTML
    page. Sites without any link have no rows."""
    kept = judged.where(F.col("disposition").isin("kept", "redirect")).select("site", "target_url", "final_path")
    counts = links.join(kept, ["site", "target_url"]).where("source_path <> final_path").groupBy("site", F.col("final_path").alias("path")).agg(F.count(F.lit(1)).alias("inbound"))
    listed = sitemap_paths(url_list).join(html_paths(pages), ["site", "path"], "left_semi")
    listed = listed.join(links.select("site").distinct(), "site", "left_semi")
    return listed.join(counts, ["site", "path"], "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)).cast("bigint"))


def low_inbound_issues(counts: DataFrame) -> DataFrame:
    n = F.col("inbound")
    found = issue(
        "low_inbound_anchor_links", "links", F.col("url"), F.concat(F.lit("inbound anchor links "), n.cast("string"), F.lit(f" below {MIN_INBOUND}")),
        inbound_count=n, minimum=F.lit(MIN_INBOUND), source_urls=F.array().cast("array<string>"),
    )
    return counts.where(n < MIN_INBOUND).select("site", seq(4, 1, "ordinal").alias("seq"), found.alias("i")).select("site", "seq", "i.*")


class Links:
    code = "links"

    def apply(self, urls_: DataFrame, pages: DataFrame, features: DataFrame, ctx: Context) -> DataFrame:
        links = extract_links(features)
        judged = judged_targets(links, resolve_targets(links, pages, ctx), ctx)
        return target_issues(judged).unionByName(low_inbound_issues(inbound_counts(links, judged, urls_, pages)))


__all__ = ["RESOLUTIONS", "Links", "extract_links", "inbound_counts", "judged_targets", "page_index", "resolve_targets"]
