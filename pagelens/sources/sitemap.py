"""Sitemaps: files or URLs, index files followed depth first, URLs unique in document order."""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions import url as urls
from pagelens.model import ValidationError
from pagelens.scratch import stored

#: Fixed value: elements of other namespaces, or of none, don't count.
NAMESPACE = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
TIMEOUT = 20


def read_source(source: str) -> bytes:
    """A remote or local document; the status of a remote one isn't looked at."""
    if urls.is_remote(source):
        from pagelens.sources.fetch import _Redirects

        try:
            with urllib.request.build_opener(_Redirects).open(source, timeout=TIMEOUT) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            return e.read()
    with open(source, "rb") as f:
        return f.read()


def child_source(parent: str, loc: str, base_url: str) -> str:
    """Of a remote index: joined and put on the base. Of a local one: the file of that name beside
    it, else the remote address as written, else a path from the index's folder."""
    if urls.is_remote(parent):
        return urls.normalize_for_base(urljoin(parent, loc), base_url)
    name = os.path.basename(urls.path(loc) or "")
    beside = os.path.join(os.path.dirname(parent), name)
    if name and os.path.isfile(beside):
        return beside
    return loc if urls.is_remote(loc) else os.path.normpath(os.path.join(os.path.dirname(parent), loc))


def _entries(body: bytes | str) -> tuple[bool, list[str]]:
    """Whether a document is an index, and its locations."""
    root = ElementTree.fromstring(body)
    index = root.tag.rsplit("}", 1)[-1] == "sitemapindex"
    entry = "sitemap" if index else "url"
    return index, [(e.text or "").strip() for e in root.iterfind(f".//{NAMESPACE}{entry}/{NAMESPACE}loc")]


def sitemap_urls(path: str, base_url: str, read: Callable[[str], bytes] = read_source) -> list[str]:
    """Normalised page URLs; a source that was read already gives nothing."""
    found: dict[str, None] = {}
    visited: set[str] = set()
    todo = [path]
    while todo:
        source = todo.pop()
        if source in visited:
            continue
        visited.add(source)
        index, locs = _entries(read(source))
        if index:
            todo += [child_source(source, loc, base_url) for loc in reversed(locs)]
        else:
            found |= dict.fromkeys(urls.normalize_for_base(loc, base_url) for loc in locs)
    return list(found)


def load_sitemap(spark: SparkSession, path: str, base_url: str, read: Callable[[str], bytes] = read_source) -> DataFrame:
    """urls (url, ordinal, site) of a sitemap; raises if it has none."""
    found = sitemap_urls(path, base_url, read)
    if not found:
        raise ValidationError(f"No URLs found in sitemap: {path}")
    return spark.createDataFrame([(u, i, base_url) for i, u in enumerate(found)], "url string, ordinal bigint, site string")


def bulk_locs(files: DataFrame) -> DataFrame:
    """source, is_index, pos, loc of very many sitemap documents (source, body) at once: the entries of
    the sitemap namespace in document order. A body that is null or no XML raises, as for one sitemap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, body in zip(pdf["source"], pdf["body"]):
                index, locs = _entries(body)
                rows += [(source, index, i, loc) for i, loc in enumerate(locs)]
            yield pd.DataFrame(rows, columns=["source", "is_index", "pos", "loc"])

    return files.select("source", "body").mapInPandas(run, "source string, is_index boolean, pos int, loc string")


def bulk_sitemaps(files: DataFrame, roots: DataFrame, depth: int = 16) -> DataFrame:
    """url, ordinal, site of the pages under the root documents, as load_sitemap gives them for one:
    indexes are followed to the documents of `files` (source, body) that they name by address, each
    document is read once, URLs are unique, in document order, numbered within each site.

    A document's place is the path of positions that leads to it; of several paths the first counts.
    Indexes are few against their URLs; each level is one join. More than `depth` levels raise."""
    locs = stored(bulk_locs(files), "locs")
    index = locs.where("is_index").select("source", "pos", urls.normalize_column(F.trim("loc")).alias("child"))
    at = roots.select("source", F.array(F.lit(0)).cast("array<int>").alias("place"), F.array("source").alias("above"))
    found = level = stored(at, "level")
    for _ in range(depth):
        below = level.join(index, "source").where(~F.array_contains("above", F.col("child")))
        below = below.select(F.col("child").alias("source"), F.array_append("place", F.col("pos")).alias("place"), F.array_append("above", F.col("child")).alias("above"))
        level = stored(below, "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    else:
        raise ValidationError(f"sitemap indexes are nested more than {depth} deep")
    first = found.groupBy("source").agg(F.min("place").alias("place"))
    pages = locs.where("not is_index").join(first, "source")
    pages = pages.select(urls.normalize_column(F.trim("loc")).alias("url"), F.array_append("place", F.col("pos")).alias("place")).where("url is not null")
    pages = pages.groupBy("url").agg(F.min("place").alias("place")).withColumn("site", urls.origin_column(F.col("url")))
    order = F.row_number().over(Window.partitionBy("site").orderBy("place"))
    return pages.select("url", (order - 1).cast("bigint").alias("ordinal"), "site")


__all__ = ["bulk_locs", "bulk_sitemaps", "child_source", "load_sitemap", "read_source", "sitemap_urls"]
