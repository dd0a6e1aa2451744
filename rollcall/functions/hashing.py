"""Length-prefixed SHA-256 digests, computed by the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.text import col, identity_text, let, location_text, strip
from rollcall.functions.urls import canonical_url

DIGEST = "^[0-9a-f]{64}$"


def _prefixed(*fields: Column) -> Column:
    """Digest of all fields, each behind its length; NULL if a field is NULL."""
    parts = F.transform(
        F.array(*fields), lambda f: F.concat(F.length(f).cast("string"), F.lit(":"), f)
    )
    return let(parts, lambda p: F.when(
        F.forall(p, lambda f: f.isNotNull()), F.sha2(F.array_join(p, ""), 256)
    ))


def base_hash(company: Column | str, title: Column | str) -> Column:
    """Identity of a listing."""
    return _prefixed(identity_text(company), identity_text(title))


def digest(value: Column | str) -> Column:
    """Canonical digest text; NULL unless it is 64 hexadecimal characters."""
    return let(F.lower(strip(value)), lambda text: F.when(text.rlike(DIGEST), text))


def is_strict_digest(value: Column | str) -> Column:
    """Lower-case digests only, as the classifier accepts them."""
    return F.coalesce(col(value).rlike(DIGEST), F.lit(False))


def content_hash(
    base: Column | str, url: Column | str, location: Column | str, closed: Column | str
) -> Column:
    """Digest of a listing's current state; NULL when a part cannot be made canonical."""
    flag = F.when(col(closed), F.lit("true")).otherwise(F.lit("false"))
    return _prefixed(digest(base), canonical_url(url), location_text(location), flag)


def canonical_json(text: Column | str) -> Column:
    """Compact JSON with sorted keys; NULL for text that is not JSON."""
    return F.to_json(F.try_parse_json(col(text)))


def response_fingerprint(
    method: Column | str, url: Column | str, status: Column | str, body: Column | str
) -> Column:
    return F.sha2(
        F.concat_ws("\u0000", col(method), col(url), col(status).cast("string"), col(body)), 256
    )
