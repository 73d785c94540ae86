"""URL resolution and serialisation after the public URL standard, for web addresses."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:")
_EDGE = "".join(map(chr, range(0x21)))
_PORTS = {"http": 80, "https": 443}
_PATH_SAFE = "%!$&'()*+,;=:@/~[]|^\\-._"
_QUERY_SAFE = "%!$&()*+,;=:@/?~[]|^\\`{}-._"


def normalise(value: str | None, base: str | None = None) -> str | None:
    """The address without fragment, host in lower case, default port and dot segments removed; None if it is no web address."""
    if value is None:
        return None
    value = re.sub(r"[\t\n\r]", "", value.strip(_EDGE))
    try:
        if base and not _SCHEME.match(value):
            value = urljoin(base, value) if value else base
        parts = urlsplit(value)
        scheme = parts.scheme.lower()
        if scheme not in _PORTS or not parts.hostname:
            return None
        host = parts.hostname.lower()
        if not host.isascii():
            host = host.encode("idna").decode("ascii")
        if re.search(r"[\s<>^|%#]", host):
            return None
        if ":" in host:
            host = f"[{host}]"
        port = parts.port
    except ValueError:
        return None
    user = parts.netloc.rpartition("@")[0]
    netloc = (f"{user}@" if user else "") + host + (f":{port}" if port is not None and port != _PORTS[scheme] else "")
    path = quote(parts.path.replace("\\", "/"), safe=_PATH_SAFE)
    kept: list[str] = []
    pieces = path.split("/")[1:] if path else [""]
    for i, piece in enumerate(pieces):
        dots = piece.lower().replace("%2e", ".")
        last = i == len(pieces) - 1
        if dots == "..":
            if kept:
                kept.pop()
            if last:
                kept.append("")
        elif dots == ".":
            if last:
                kept.append("")
        else:
            kept.append(piece)
    return urlunsplit((scheme, netloc, "/" + "/".join(kept), quote(parts.query, safe=_QUERY_SAFE), ""))


#: an address that is its own normal form, and a path below a site that needs no more than the site before it
_REGULAR_PATH = r"/(?!/)(?!(?:[^?]*/)?\.)[A-Za-z0-9_.~!$&()*+,;=:@/\-]*(?:\?[A-Za-z0-9_.~!$&()*+,;=:@/?\-]+)?"
_REGULAR_SITE = r"https?://[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?"
_REGULAR = rf"\A{_REGULAR_SITE}{_REGULAR_PATH}\z"


@F.pandas_udf(StringType())
def _normal(value: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else normalise(v) for v in value], dtype="object")


@F.pandas_udf(StringType())
def _resolved(value: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else normalise(v, b) for v, b in zip(value, base)], dtype="object")


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normal_url(value: Column | str) -> Column:
    """The normal form of an address; most are it already and never leave the JVM."""
    value = _column(value)
    regular = F.coalesce(value.rlike(_REGULAR), F.lit(False))
    return F.when(regular, value).otherwise(_normal(F.when(~regular, value)))


def resolved_url(value: Column | str, base: Column | str) -> Column:
    """The normal form of an address found at ``base``; regular addresses and paths from the root never leave the JVM."""
    value, base = _column(value), _column(base)
    regular = F.coalesce(value.rlike(_REGULAR), F.lit(False))
    rooted = ~regular & F.coalesce(value.rlike(rf"\A{_REGULAR_PATH}\z") & base.rlike(_REGULAR), F.lit(False))
    rest = ~regular & ~rooted
    site = F.regexp_extract(base, rf"\A{_REGULAR_SITE}", 0)
    return F.when(regular, value).when(rooted, F.concat(site, value)).otherwise(_resolved(F.when(rest, value), F.when(rest, base)))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+", 0)


def path_and_query(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^https?://[^/?#]+", ""), "#.*$", "")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def is_web(url: Column) -> Column:
    return url.rlike("(?i)^https?://")


def is_blocked_host(url: Column) -> Column:
    """Loopback, private and link-local hosts."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return host.rlike(r"^(?:localhost|127\.|10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|169\.254\.|\[?::1\]?$)")


def is_mail_protection(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+(/[^?#]*)", 1) == "/cdn-cgi/l/email-protection"
