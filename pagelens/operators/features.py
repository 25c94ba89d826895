"""The parse stage: pages in, one feature record for each HTML page out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import html
from pagelens.functions.schemas import SchemaRegistry
from pagelens.model import FEATURES

FINGERPRINT_MIN = 200
_KEEP = ["site", "ordinal", "url", "normalized_url", "normalized_final_url"]
_WHITE = " \t\n\x0b\f\r\x00"


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text with white space squeezed; null below FINGERPRINT_MIN characters."""
    clean = F.btrim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "), F.lit(_WHITE))
    return F.when(F.length(clean) >= FINGERPRINT_MIN, F.sha2(clean, 256))


def parse_pages(pages: DataFrame, registry: SchemaRegistry | None = None, rows: int = 256) -> DataFrame:
    """Features of the HTML pages, structured items validated on the way. Pages reach Python with
    the columns it needs only; at most `rows` records are held at a time."""
    registry = registry or SchemaRegistry.default()

    def item(pos: int, source: str, data, error: str | None) -> tuple:
        if error is not None:
            return (pos, source, None, error, None, [], [])
        problems = [(p["field"], p["issue"], p["type"]) for p in registry.validate(data)]
        kind = data.get("@type")
        shown = kind if isinstance(kind, str) else None if kind is None else json.dumps(kind, ensure_ascii=False)
        return (pos, source, json.dumps(data, ensure_ascii=False), None, shown, html.types_of(data), problems)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows]
                out = part[_KEEP].reset_index(drop=True)
                found = [html.features(*[v if isinstance(v, str) else None for v in r]) for r in part[["body", "normalized_url", "url"]].itertuples(index=False, name=None)]
                for name in ("title", "h1_count", "description", "canonical", "canonical_normal", "og_present", "content_text", "anchors"):
                    out[name] = [f[name] for f in found]
                out["items"] = [[item(i, *x) for i, x in enumerate(f["items"])] for f in found]
                yield out

    return pages.where("is_html").select(*_KEEP, "body").mapInPandas(run, FEATURES)


def with_fingerprint(features: DataFrame) -> DataFrame:
    """Features with the content's fingerprint in place of its text."""
    return features.withColumn("content_fingerprint", fingerprint(F.col("content_text"))).drop("content_text")
