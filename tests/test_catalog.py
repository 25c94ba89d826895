from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from pagelens.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, str):
            return v
        return bool(v) if type(v).__name__ in ("bool", "bool_") else round(float(v), 6)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(name, spark, small, db):
    assert rows(catalog.QUERIES[name](spark, small).toPandas()) == rows(db.execute(catalog.ORACLE[name]).df())


def test_queries_without_sql_run(spark, small):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE):
        assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_parse_runs_once_for_all_rules(spark, small):
    """The features are written once; all rules read the table, and no plan holds a Python stage."""
    from pagelens.plans.crawl import all_issues
    from pagelens.sources.snapshot import snapshot_pages, url_list

    pages = snapshot_pages(spark.read.parquet(f"{small}/pages.parquet"))
    issues = all_issues(url_list(pages), pages)
    plan = issues._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "MapInPandas" not in plan and any("/features/" in f for f in issues.inputFiles())
    assert "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", "duplicate_titles duplicate_descriptions duplicate_content unresolved_links low_inbound inbound_links link_resolution broken_links issues_by_code issues_all first_sources".split())
def test_pages_are_parsed_once(name, spark, small):
    """The parse has run when the query is planned; the plan reads the features as a table."""
    plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


@pytest.fixture(scope="module")
def cut_titles(spark, tmp_path_factory):
    """Pages 3 to 9 of each ten; titles cut inside a reference, as those of the larger page tables are.
    Every page has a text of its own, but 13 and 14 share theirs."""
    titles = ["a &amp;&amp", "a &amp;&amp", "a &amp;&", "a &amp;&", "b &am", "b &amp;am", "b &am"]
    rows = []
    for i in range(3, 17):
        if i % 10 > 2:
            text = f"{min(i, 13) if i < 15 else i} " * 90
            rows.append((i, f"https://a.example.com/p/{i}", f'<html><head><title>{titles[(i - 3) % 10 % 7]}</title></head><body><h1>h</h1><p>{text}</p><a href="/t/{i}">x</a></body></html>'))
    at = tmp_path_factory.mktemp("cut")
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{at}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{at}/pages.parquet/*.parquet'")
    return str(at), con


def same_as_sql(name, spark, tables, keep=lambda df: df):
    at, con = tables
    found = rows(catalog.QUERIES[name](spark, at).toPandas().pipe(keep))
    assert found and found == rows(con.execute(catalog.ORACLE[name]).df())


def test_duplicate_titles_with_cut_references(spark, cut_titles):
    same_as_sql("duplicate_titles", spark, cut_titles)


def test_all_issues_with_cut_references_and_shared_texts(spark, cut_titles):
    """The SQL tells of no shared text, as sf0.01 has none: those issues are checked by themselves."""
    shared = []

    def apart(df):
        shared.extend(df.message[df.code == "duplicate_content_fingerprint"])
        return df[df.code != "duplicate_content_fingerprint"]

    same_as_sql("issues_all", spark, cut_titles, apart)
    assert shared == ["duplicate page content fingerprint => https://a.example.com/p/13, https://a.example.com/p/14"]


def test_title_features_with_cut_references(spark, cut_titles):
    same_as_sql("pages_title_features", spark, cut_titles)
