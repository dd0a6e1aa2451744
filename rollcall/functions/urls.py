"""URL expressions built on the component pattern of RFC 3986, appendix B."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rollcall import fixed_values as fixed
from rollcall.functions.text import col, let, nfkc, strip

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
_HOST = r"(?s)^([^/?#:]*://(?:[^/?#@]*@)?)([^/?#:@\[\]\\]*)(.*)$"
_AUTHORITY = r"(?s)^//(.*@)?(\[[^\]]*\]|[^:@\[\]]*)(:.*)?$"


@dataclass(frozen=True)
class Parts:
    """Components of a URL. Delimiters stay in ``netloc``, ``query`` and ``fragment``."""

    scheme: Column
    netloc: Column
    path: Column
    query: Column
    fragment: Column
    userinfo: Column
    host: Column
    port: Column
    bad_authority: Column


def with_parts(url: Column, body: Callable[[Parts], Column]) -> Column:
    """Build an expression from the components of a URL; each pattern runs once."""

    def split(text: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(text, _PARTS, 1)).alias("scheme"),
            *[F.regexp_extract(text, _PARTS, n).alias(name)
              for n, name in enumerate(("netloc", "path", "query", "fragment"), 2)],
        )

    def authority(p: Column) -> Column:
        return F.struct(
            F.regexp_extract(p["netloc"], _AUTHORITY, 1).alias("userinfo"),
            F.lower(F.regexp_extract(p["netloc"], _AUTHORITY, 2)).alias("host"),
            F.substr(F.regexp_extract(p["netloc"], _AUTHORITY, 3), F.lit(2)).alias("port"),
            ((p["netloc"] != "") & ~p["netloc"].rlike(_AUTHORITY)).alias("bad_authority"),
        )

    def build(p: Column) -> Column:
        return let(authority(p), lambda a: body(Parts(
            **{n: p[n] for n in ("scheme", "netloc", "path", "query", "fragment")},
            **{n: a[n] for n in ("userinfo", "host", "port", "bad_authority")},
        )))

    return let(url, lambda text: let(split(text), build))


def _port_ok(port: Column) -> Column:
    number = F.when(port.rlike("^[0-9]+$"), port.try_cast("decimal(38,0)"))
    return (port == "") | F.coalesce(number <= 65535, F.lit(False))


def _without_empty(part: Column, mark: str) -> Column:
    return F.when(part == mark, F.lit("")).otherwise(part)


def canonical_url(url: Column | str) -> Column:
    """Scheme and host in lower case, everything else kept; NULL for a bad port or host.

    Empty queries and fragments vanish and ports are printed as plain integers.
    """

    def build(p: Parts) -> Column:
        tail = F.concat(p.path, _without_empty(p.query, "?"), _without_empty(p.fragment, "#"))
        port = F.when(
            p.port != "", F.concat(F.lit(":"), p.port.try_cast("int").cast("string"))
        ).otherwise(F.lit(""))
        netloc = F.when(
            p.host != "", F.concat(F.lit("//"), p.userinfo, p.host, port)
        ).otherwise(F.when(p.netloc == "//", F.lit("")).otherwise(p.netloc))
        return F.when(
            ~p.bad_authority & _port_ok(p.port), F.concat(_with_colon(p.scheme), netloc, tail)
        )

    return with_parts(F.regexp_replace(strip(nfkc(url)), "[\t\r\n]", ""), build)


def _with_colon(scheme: Column) -> Column:
    return F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit(""))


#: Characters that a stored URL holds in percent-encoding, besides those beyond ASCII.
_IN_PATH = r"""[\x00-\x20"#<>?`{}\x7F]|[^\x00-\x7F]"""
_IN_QUERY = r"""[\x00-\x20"#<>'\x7F]|[^\x00-\x7F]"""
_IN_FRAGMENT = r"""[\x00-\x20"<>`\x7F]|[^\x00-\x7F]"""
_IN_USER = r"""[\x00-\x20"#<>?`{}/;=\[\\\]^|\x7F]|[^\x00-\x7F]"""


def _escaped(text: Column, pattern: str) -> Column:
    """Text with the characters of a pattern as the percent-encoded bytes of their UTF-8 form; escapes stay as they are."""
    one = lambda c: F.when(c.rlike(pattern), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    return F.when(text.rlike(pattern), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def _resolved(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments, which may be written with ``%2e``."""
    def is_dots(part: Column, n: int) -> Column:
        return part.rlike(r"(?i)^(?:\.|%2e){" + str(n) + "}$")

    def step(done: Column, part: Column) -> Column:
        return F.when(is_dots(part, 2), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))) \
            .when(is_dots(part, 1), done).otherwise(F.concat(done, F.array(part)))

    def joined(parts: Column) -> Column:
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        last = F.element_at(parts, -1)
        ends = F.when(is_dots(last, 1) | is_dots(last, 2), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
        return F.concat(F.lit("/"), F.array_join(ends, "/"))

    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), let(parts, joined)).otherwise(path)


@F.pandas_udf(StringType())
def _ascii_host(host: pd.Series) -> pd.Series:
    """Hosts beyond ASCII by label in punycode; NULL where a label cannot be written so, and for NULL."""
    def encoded(name):
        if name is None:
            return None
        try:
            labels = re.split("[.\u3002\uff0e\uff61]", unicodedata.normalize("NFKC", name).lower())
            return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels)
        except UnicodeError:
            return None

    return host.map(encoded, na_action="ignore")


def stored_url(url: Column | str) -> Column:
    """The form kept in a snapshot.

    Scheme and host are in lower case, the host in punycode (RFC 3492), default ports vanish, dot segments are resolved,
    backslashes of the path are slashes, an empty path is ``/``, and what a URL cannot hold is percent-encoded.
    Only hosts beyond ASCII are sent to Python.
    """
    def build(p: Parts) -> Column:
        default = F.when(p.scheme == "https", F.lit("443")).otherwise(F.lit("80"))
        port = F.when((p.port == "") | (p.port == default), F.lit("")).otherwise(
            F.concat(F.lit(":"), p.port)
        )
        slashed = F.replace(p.path, F.lit("\\"), F.lit("/"))
        path = _resolved(F.when(slashed == "", F.lit("/")).otherwise(slashed))
        user = F.when(p.userinfo != "", F.concat(_escaped(F.rtrim(p.userinfo, F.lit("@")), _IN_USER), F.lit("@"))).otherwise("")
        return F.concat(
            p.scheme, F.lit("://"), user, p.host, port, _escaped(path, _IN_PATH),
            F.when(p.query == "", "").otherwise(F.concat(F.lit("?"), _escaped(F.substr(p.query, F.lit(2)), _IN_QUERY))),
            F.when(p.fragment == "", "").otherwise(F.concat(F.lit("#"), _escaped(F.substr(p.fragment, F.lit(2)), _IN_FRAGMENT))),
        )

    text = F.regexp_replace(strip(url), "[\t\r\n]", "")
    host = F.regexp_extract(text, _HOST, 2)  # Python cannot stand inside the functions above, so the host is set first
    foreign = _ascii_host(F.when(host.rlike("[^\\x00-\\x7F]"), host))
    plain = F.when(foreign.isNotNull(), F.concat(F.regexp_extract(text, _HOST, 1), foreign, F.regexp_extract(text, _HOST, 3))).otherwise(text)
    return with_parts(plain, build)


def is_http_url(url: Column) -> Column:
    """An absolute http or https URL with a host."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def _decode(text: Column) -> Column:
    # A stray percent sign stands for itself.
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    # The form encoding here keeps "~" and escapes "*"; Spark's does the reverse.
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")),
                     F.lit("%7E"), F.lit("~"))


def redact_query(
    url: Column | str, keys: Sequence[str] = fixed.SECRET_QUERY_KEYS
) -> Column:
    """Replace the values of secret query keys; order and blank values are kept."""
    secret = [k.casefold() for k in keys]

    def pair(item: Column) -> Column:
        at = F.instr(item, "=")
        key = _decode(F.when(at > 0, F.substring_index(item, "=", 1)).otherwise(item))
        value = _decode(F.when(at > 0, F.regexp_replace(item, "^[^=]*=", "")).otherwise(F.lit("")))
        shown = F.when(F.lower(key).isin(*secret), F.lit(fixed.REDACTED)).otherwise(value)
        return F.concat(_encode(key), F.lit("="), _encode(shown))

    def build(p: Parts) -> Column:
        items = F.filter(
            F.split(F.substr(p.query, F.lit(2)), "&"), lambda i: i != ""
        )
        query = F.nullif(F.array_join(F.transform(items, pair), "&"), F.lit(""))
        shown = F.coalesce(F.concat(F.lit("?"), query), F.lit(""))
        return F.concat(
            _with_colon(p.scheme), p.netloc, p.path, shown, _without_empty(p.fragment, "#")
        )

    return with_parts(col(url), build)


def domain_of(value: Column | str) -> Column:
    """Host of a URL or of a bare domain, without trailing dots; NULL where there is none."""
    full = let(
        F.lower(strip(value)),
        lambda t: F.when(t.contains("://"), t).otherwise(F.concat(F.lit("//"), t)),
    )
    return with_parts(full, lambda p: F.when(
        ~p.bad_authority, F.rtrim(F.nullif(_bare_host(p), F.lit("")), F.lit("."))
    ))


def _bare_host(p: Parts) -> Column:
    return F.regexp_replace(p.host, r"^\[|\]$", "")


@dataclass(frozen=True)
class Endpoint:
    """Checked forms of an endpoint address; all NULL for an invalid one."""

    shown: Column
    key: Column


def endpoint(value: Column | str) -> Endpoint:
    """Check an endpoint address and give its two forms without credentials.

    ``shown`` marks that credentials exist, ``key`` leaves them out.
    """

    def build(p: Parts) -> Column:
        port = p.port.try_cast("int")
        valid = (
            p.scheme.isin(*fixed.ENDPOINT_SCHEMES) & ~p.bad_authority & (p.host != "")
            & p.port.rlike("^[0-9]+$") & port.between(1, 65535)
            & p.path.isin("", "/") & p.query.isin("", "?") & p.fragment.isin("", "#")
        )
        address = F.concat(_bare_host(p), F.lit(":"), port.cast("string"))
        auth = F.when(p.userinfo != "", F.lit("***@")).otherwise(F.lit(""))
        start = F.concat(p.scheme, F.lit("://"))
        return F.when(valid, F.struct(
            F.concat(start, auth, address).alias("shown"), F.concat(start, address).alias("key")
        ))

    parts = with_parts(strip(value), build)
    return Endpoint(shown=parts["shown"], key=parts["key"])


def endpoint_key(value: Column | str) -> Column:
    """The metrics key of an outcome row: scheme, host and port only; ``unknown`` if no host."""

    def build(p: Parts) -> Column:
        port = p.port.try_cast("int")
        return F.concat(
            _with_colon(p.scheme), F.lit("//"),
            F.coalesce(F.nullif(_bare_host(p), F.lit("")), F.lit("unknown")),
            F.when(port > 0, F.concat(F.lit(":"), port.cast("string"))).otherwise(F.lit("")),
        )

    return with_parts(strip(value), build)


def join_url(base: Column | str, target: Column | str) -> Column:
    """Resolve a link against the page it was found on (RFC 3986, section 5)."""
    base, target = col(base), col(target)

    def build(b: Parts, t: Parts) -> Column:
        root = F.concat(b.scheme, F.lit(":"), b.netloc)
        folder = F.when(b.path == "", F.lit("/")).otherwise(
            F.regexp_replace(b.path, "[^/]*$", "")
        )
        merged = F.when(t.path.startswith("/"), t.path).otherwise(F.concat(folder, t.path))
        tail = F.concat(_without_empty(t.query, "?"), _without_empty(t.fragment, "#"))
        return (
            F.when(t.scheme != "", target)
            .when(t.netloc != "", F.concat(b.scheme, F.lit(":"), target))
            .when(t.path != "", F.concat(root, let(merged, _without_dots), tail))
            .when(t.query != "", F.concat(root, b.path, tail))
            .when(t.fragment != "", F.concat(root, b.path, b.query, t.fragment))
            .otherwise(base)
        )

    return with_parts(base, lambda b: with_parts(target, lambda t: build(b, t)))


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments by folding over the segments."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    closed = F.when(last.isin(".", ".."), F.concat(segments, F.array(F.lit("")))).otherwise(
        segments
    )
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        closed,
        empty,
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    needs = path.rlike(r"(^|/)\.{1,2}(/|$)")
    return F.when(needs, F.array_join(folded, "/")).otherwise(path)
