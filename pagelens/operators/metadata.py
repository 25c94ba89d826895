"""Metadata rule: headings, title, description, canonical link, Open Graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import html
from pagelens.functions import url as urls
from pagelens.model import Context, issue, issues_from

#: Fixed values.
TITLE_MAX, DESCRIPTION_MIN, DESCRIPTION_MAX = 72, 110, 160
NOT_WORD = r"[^\p{L}\p{M}\p{Nd}]+"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _add(code: str, message: Column | str, **details: Column) -> Column:
    return issue(code, "metadata", F.col("url"), message, **details)


def h1_check() -> Column:
    n = F.col("h1_count")
    return F.when(n == 0, _add("missing_h1", "missing <h1>")).when(n > 1, _add("multiple_h1", _text("multiple <h1> tags (", n, ")"), count=n))


def repeats_site_name(title: Column, site_name: str) -> Column:
    folded = site_name.upper().lower()  # upper case first: it spells out what has no single lower case
    tokens = F.filter(F.split(F.lower(F.upper(title)), NOT_WORD), lambda t: t == folded)
    return F.size(tokens) > 1


def title_check(site_name: str | None) -> Column:
    title, n, name = F.col("title"), F.length("title"), (site_name or "").strip()
    found = F.when(title == "", _add("missing_title", "missing <title>")).when(n > TITLE_MAX, _add("title_too_long", _text("title too long (", n, ")"), length=n))
    if name:
        found = found.when(repeats_site_name(title, name), _add("title_repeats_site_name", f"title repeats {name}", site_name=F.lit(name)))
    return found


def description_check() -> Column:
    text, n = F.col("description"), F.length("description")
    return (
        F.when(text == "", _add("missing_meta_description", "missing meta description"))
        .when(n < DESCRIPTION_MIN, _add("meta_description_too_short", _text("meta description too short (", n, ")"), length=n, minimum=F.lit(DESCRIPTION_MIN)))
        .when(n > DESCRIPTION_MAX, _add("meta_description_too_long", _text("meta description too long (", n, ")"), length=n))
    )


def canonical_check() -> Column:
    """canonical_normal: the canonical joined to the page and normalised, by the parse stage."""
    page, other = F.col("normalized_url"), F.col("canonical_normal")
    same = other.eqNullSafe(page) | (urls.local_column(page) & urls.path_column(other).eqNullSafe(urls.path_column(page)))
    return F.when(F.col("canonical") == "", _add("missing_canonical", "missing canonical link")).when(
        ~same, _add("canonical_mismatch", _text("canonical mismatch (", F.col("canonical"), ")"), canonical=F.col("canonical"))
    )


def open_graph_check() -> Column:
    missing = F.array_except(F.array(*[F.lit(p) for p in html.OPEN_GRAPH]), "og_present")
    return F.when(F.size(missing) > 0, _add("incomplete_open_graph_tags", _text("Open Graph tags incomplete (missing ", F.array_join(missing, ", "), ")"), missing=missing))


class Metadata:
    code = "metadata"

    def __init__(self, site_name: str | None = None):
        self.site_name = site_name

    def apply(self, urls_: DataFrame, pages: DataFrame, features: DataFrame, ctx: Context) -> DataFrame:
        rows = features.select("site", "ordinal", "url", "normalized_url", "title", "h1_count", "description", "canonical", "canonical_normal", "og_present")
        name = self.site_name if self.site_name is not None else ctx.site_name
        return issues_from(rows, F.array(h1_check(), title_check(name), description_check(), canonical_check(), open_graph_check()), 1)
