"""URL algebra: the same rules as Column expressions and as plain Python.

Only ASCII references that follow RFC 3986 are valid; host case is kept; query, fragment and user
are dropped by normalisation. Column forms take absolute URLs (what page tables hold) and leave
anything that needs a join to the Python twin, which the fetch and parse stages call.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_PCT = "%[0-9A-Fa-f]{2}"
_NAME = rf"(?:[A-Za-z0-9\-._~!$&'()*+,;=]|{_PCT})"
_PATH = rf"(?:[A-Za-z0-9\-._~!$&'()*+,;=:@/]|{_PCT})"
_TAIL = rf"(?:[A-Za-z0-9\-._~!$&'()*+,;=:@/?]|{_PCT})"
_USER = rf"(?:[A-Za-z0-9\-._~!$&'()*+,;=:]|{_PCT})"
#: Groups: scheme, user, host, port, path, query, fragment.
PATTERN = (
    rf"^(?:([A-Za-z][A-Za-z0-9+.\-]*):|(?![^/?#]*:))(?://(?:({_USER}*)@)?(\[[0-9A-Fa-f:.]+\]|{_NAME}*)(?::([0-9]*))?(?=[/?#]|\z))?"
    rf"({_PATH}*)(?:\?({_TAIL}*))?(?:#({_TAIL}*))?\z"
)
_COMPILED = re.compile(PATTERN.replace(r"\z", r"\Z"))
#: Ports that are left out, and hosts that are this machine.
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443", "ldap": "389", "ldaps": "636"}
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1")


# ------------------------------------------------------------------ Python


def parse(url: str | None) -> dict[str, str | None] | None:
    """The parts of a valid reference, else None."""
    m = _COMPILED.match(url) if isinstance(url, str) else None
    if not m:
        return None
    scheme, user, host, port, path, query, fragment = m.groups()
    return {"scheme": scheme.lower() if scheme else None, "user": user, "host": host or None, "port": port or None, "path": path, "query": query, "fragment": fragment}


def _slashless(path: str) -> str:
    return (path[:-1] if path.endswith("/") else path) or "/"


def _printed(p: dict) -> str:
    port = f":{p['port']}" if p["port"] and DEFAULT_PORTS.get(p["scheme"]) != p["port"] else ""
    return f"{p['scheme'] or ''}://{p['host'] or ''}{port}{_slashless(p['path'])}"


def normalize(url: str | None, base_url: str | None = None) -> str | None:
    """Joined to the base if it has no host; invalid input comes back as it was."""
    p = parse(url)
    if p is None:
        return url
    if not p["host"]:
        base = parse(base_url)
        if base is None or not base["scheme"]:
            return url
        p = parse(urljoin(base_url, url))
        if p is None:
            return url
    return _printed(p)


def normalize_for_base(url: str | None, base_url: str | None) -> str | None:
    """Normalised, put on the base's scheme, host and port, and normalised again."""
    first = normalize(url, base_url)
    p, base = parse(first), parse(base_url)
    if p is None or base is None:
        return first
    if base["host"]:
        p |= {k: base[k] for k in ("scheme", "host", "port")}
    return normalize(_printed(p | {"path": p["path"]}), base_url) if p["scheme"] else first


def path(url: str | None) -> str | None:
    p = parse(url)
    return None if p is None else _slashless(p["path"])


def host(url: str | None) -> str | None:
    p = parse(url)
    return None if p is None else p["host"]


def is_remote(value: str | None) -> bool:
    p = parse(value)
    return bool(p and p["scheme"] and p["host"])


def is_local(url: str | None) -> bool:
    return host(url) in LOCAL_HOSTS


def shown_path(url: str | None) -> str | None:
    """The path as written, or the whole of an invalid URL."""
    p = parse(url)
    return url if p is None else p["path"]


def link_target(source_url: str | None, href: str) -> str | None:
    """href joined to the source page and normalised; None if either is invalid."""
    if parse(source_url) is None or parse(href) is None:
        return None
    joined = parse(urljoin(source_url, href))
    return _printed(joined) if joined and joined["scheme"] and joined["host"] else None


# ------------------------------------------------------------------ Columns


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """value, worked out once for `then` however often it uses it."""
    return F.transform(F.array(value), then)[0]


def parts(url: Column) -> Column:
    """Struct: ok (a valid reference), scheme, host, port, path; empty texts where there is none."""
    found = [F.regexp_extract(url, PATTERN, g) for g in (1, 3, 4, 5)]
    return F.struct(
        F.coalesce(url.rlike(PATTERN), F.lit(False)).alias("ok"), F.lower(found[0]).alias("scheme"), found[1].alias("host"), found[2].alias("port"), found[3].alias("path")
    )


def _remote(p: Column) -> Column:
    return p["ok"] & (p["scheme"] != "") & (p["host"] != "")


def _slashless_column(p: Column) -> Column:
    cut = F.regexp_replace(p, r"/\z", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def _origin(p: Column) -> Column:
    usual = F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv])
    shown = F.when((p["port"] == "") | p["port"].eqNullSafe(usual[p["scheme"]]), F.lit("")).otherwise(F.concat(F.lit(":"), p["port"]))
    return F.concat(p["scheme"], F.lit("://"), p["host"], shown)


def origin_column(url: Column) -> Column:
    """scheme://authority of an absolute URL; null for others."""
    return _let(parts(url), lambda p: F.when(_remote(p), _origin(p)))


def normalize_column(url: Column) -> Column:
    """normalize() of absolute URLs; anything else as it was."""
    return _let(parts(url), lambda p: F.when(_remote(p), F.concat(_origin(p), _slashless_column(p["path"]))).otherwise(url))


def rebase_column(url: Column, base_url: str) -> Column:
    """normalize_for_base() of absolute URLs for a literal base."""
    b = parse(base_url)
    if b is None or not b["host"]:
        return normalize_column(normalize_column(url))
    origin = _printed(b | {"path": ""})[:-1]
    return _let(parts(url), lambda p: F.when(_remote(p), F.concat(F.lit(origin), _slashless_column(_slashless_column(p["path"])))).otherwise(url))


def path_column(url: Column) -> Column:
    return _let(parts(url), lambda p: F.when(p["ok"], _slashless_column(p["path"])))


def host_column(url: Column) -> Column:
    return _let(parts(url), lambda p: F.when(p["ok"] & (p["host"] != ""), p["host"]))


def remote_column(url: Column) -> Column:
    return _let(parts(url), _remote)


def local_column(url: Column) -> Column:
    return F.coalesce(host_column(url).isin(*LOCAL_HOSTS), F.lit(False))


def career_detail_column(url: Column) -> Column:
    """Path ends in /careers/<segment>, with or without a slash."""
    return _let(parts(url), lambda p: p["ok"] & p["path"].rlike(r"/careers/[^/]+/?\z"))


@F.pandas_udf(StringType())
def normalize_udf(url: pd.Series, base_url: pd.Series) -> pd.Series:
    return pd.Series([normalize(u, b) for u, b in zip(url, base_url)], dtype=object)
