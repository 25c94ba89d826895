from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelens.functions import url as u

BASE = "https://example.com"
ABSOLUTE = [
    "https://example.com/pricing/", "HTTPS://Example.com/a//", "http://example.com:80/x?y=1#z", "http://example.com:8080", "https://example.com/für", "https://exa mple.com/a",
    "https://e_x.com/a", "https://user:pw@example.com/a/", "http://[::1]:3000/a", "not a url", "/relative", "", "https://example.com/a|b", "https://example.com/%zz", "https://example.com/a\n", "mailto:a@example.com",
]


@pytest.mark.parametrize(("given", "base", "expected"), [
    ("/pricing/", BASE, "https://example.com/pricing"), ("/pricing", "http://localhost:3000", "http://localhost:3000/pricing"), ("https://example.com", BASE, "https://example.com/"),
    ("https://example.com/a/", BASE, "https://example.com/a"), ("https://exa mple.com/a", BASE, "https://exa mple.com/a"), ("https://example.com/a?b#c", BASE, "https://example.com/a"),
    ("https://example.com:443/a//", BASE, "https://example.com/a/"), ("../b", "https://example.com/x/y/z", "https://example.com/x/b"), ("//other.com/a", BASE, "://other.com/a"), (None, BASE, None),
])
def test_normalize(given, base, expected):
    assert u.normalize(given, base) == expected


def test_normalize_for_base_rebases_and_cuts_two_slashes():
    assert u.normalize_for_base("https://example.com/a//", "http://localhost:3000") == "http://localhost:3000/a"
    assert u.normalize_for_base("/a", "http://localhost:3000") == "http://localhost:3000/a"


def test_path_remote_local():
    assert u.path("https://example.com") == "/"
    assert u.path("https://exa mple.com/") is None and u.path("://other.com/a") is None and u.path("1a:b") is None
    assert u.is_remote("https://example.com/a") and not u.is_remote("https://exa mple.com") and not u.is_remote("/a")
    assert u.is_local("http://127.0.0.1:3000/") and not u.is_local("http://[::1]/")
    assert u.shown_path("https://example.com/a/") == "/a/" and u.shown_path("x y") == "x y"


def test_link_target():
    assert u.link_target("https://example.com/a", "b?x#y") == "https://example.com/b"
    assert u.link_target("https://example.com/a", "/für") is None
    assert u.link_target(None, "/b") is None


def test_columns_agree_with_python(spark):
    df = spark.createDataFrame([(x,) for x in ABSOLUTE], "v string")
    c = F.col("v")
    rows = df.select("v", u.normalize_column(c).alias("n"), u.path_column(c).alias("p"), u.host_column(c).alias("h"), u.remote_column(c).alias("r"), u.local_column(c).alias("l"), u.rebase_column(c, "http://localhost:3000").alias("b"), u.normalize_udf(c, F.lit(BASE)).alias("d")).collect()
    for r in rows:
        remote = u.is_remote(r.v)
        assert r.n == (u.normalize(r.v) if remote else r.v), r.v
        assert r.p == u.path(r.v) and r.h == u.host(r.v) and r.r == remote and r.l == u.is_local(r.v), r.v
        assert r.d == u.normalize(r.v, BASE), r.v
        if remote:
            assert r.b == u.normalize_for_base(r.v, "http://localhost:3000"), r.v


def test_career_paths(spark):
    rows = spark.createDataFrame([("https://x.com/careers/dev/",), ("https://x.com/careers",), ("https://x.com/a/careers/dev",), ("https://x.com/careers/a/b",), ("x y",)], "v string")
    assert [r[0] for r in rows.select(u.career_detail_column(F.col("v"))).collect()] == [True, False, True, False, False]
