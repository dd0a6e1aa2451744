"""Listing records of captured JSON boards, portals and page cards.

Every source maps to ``schemas.RAW_JOB`` plus ``ordinal``. A record that cannot be mapped goes to
the rejects with a reason; a document with a wrong envelope fails as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall import fixed_values as fixed
from rollcall.functions.envelopes import open_envelope
from rollcall.functions.text import casefold, col, collapse, let, once, strip
from rollcall.functions.urls import is_http_url, join_url

ITEMS = "array<variant>"
OBJECT = "map<string,variant>"


@dataclass(frozen=True)
class Mapped:
    """Outcome of one source: mapped rows, skipped records, failed documents."""

    rows: DataFrame
    rejects: DataFrame
    failures: DataFrame


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _text(value: Column) -> Column:
    """White space collapsed; NULL unless the value is a non-empty string."""
    # The schema of a large object is dear to print, so only scalars are asked for theirs.
    scalar = F.try_variant_get(value, "$", OBJECT).isNull() & F.try_variant_get(value, "$", ITEMS).isNull()
    is_text = F.when(scalar, F.schema_of_variant(value) == "STRING")
    return F.nullif(collapse(F.when(is_text, F.try_variant_get(value, "$", "string"))), F.lit(""))


def _text_at(value: Column, *paths: str) -> Column:
    return F.coalesce(*[_text(_at(value, p)) for p in paths])


def _list_at(value: Column, path: str) -> Column:
    return F.coalesce(_at(value, path, ITEMS), F.array().cast(ITEMS))


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", OBJECT).isNotNull()


def _tidy(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull()))


def _or_unspecified(values: Column) -> Column:
    return let(values, lambda v: F.when(F.size(v) > 0, v).otherwise(F.array(F.lit(fixed.UNSPECIFIED))))


def _json(value: Column) -> Column:
    return F.to_json(value)


def _raw(items: DataFrame, key: Sequence[str], **columns: Column) -> DataFrame:
    """Lay the columns out as a raw listing and add ``reason`` for oversized values."""
    null = F.lit(None)
    out = items.select(
        *key,
        columns["source"].alias("source"),
        columns["source_id"].alias("source_id"),
        columns["company"].alias("company"),
        columns["title"].alias("title"),
        columns["apply_url"].alias("apply_url"),
        columns["location"].cast("array<string>").alias("location"),
        null.cast("string").alias("season"),
        null.cast("string").alias("job_type"),
        columns["closed"].alias("is_closed_json"),
        null.cast("timestamp").alias("observed_at"),
        columns["payload"].alias("payload"),
        columns["reason"].alias("reason"),
    )
    long_value = (
        (F.length("source_id") > 500) | (F.length("company") > 500)
        | (F.length("title") > 1000) | (F.length("apply_url") > 4096)
    )
    return out.withColumn(
        "reason",
        F.coalesce("reason", F.when(long_value, F.lit("value too long"))),
    )


def _outcome(rows: DataFrame, failures: DataFrame) -> Mapped:
    return Mapped(
        rows.where("reason IS NULL").drop("reason"),
        rows.where("reason IS NOT NULL"),
        failures,
    )


#: The place of a document among those read, before they were spread.
READ = "__read"


def spread(documents: DataFrame) -> DataFrame:
    """Documents dealt out evenly to all cores, with their place as ``READ``.

    Captures are small to read and dear to parse: a few megabytes of a file, which one task reads, hold a million of them.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return documents.withColumn(READ, F.monotonically_increasing_id()).repartition(parts)


def _open_envelope(
    documents: DataFrame, body: str, path: str, reason: str, keep: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    parsed = once(spread(documents.select(*keep, F.col(body).alias("__body"))),
                  __items=_at(F.try_parse_json("__body"), path, ITEMS))
    items = parsed.select(
        *keep, READ, F.posexplode_outer("__items").alias("ordinal", "item")
    ).where("ordinal IS NOT NULL")
    failures = parsed.where("__items IS NULL").select(*keep, F.lit(reason).alias("reason"))
    return items, failures


def board_a(documents: DataFrame, *, board: str = "board", body: str = "body") -> Mapped:
    """Boards whose envelope is an object with a ``jobs`` list."""
    items, failures = _open_envelope(
        documents, body, "$.jobs", "response is missing a jobs list", [board]
    )
    item = F.col("item")
    token = strip(board)
    items = once(items, __id=_at(item, "$.id", "string"), __title=_text_at(item, "$.title"), __url=_text_at(item, "$.absolute_url"))
    ident, title, url = F.col("__id"), F.col("__title"), F.col("__url")
    places = F.concat(
        F.array(_text_at(item, "$.location.name")),
        F.transform(
            _list_at(item, "$.offices"),
            lambda o: F.coalesce(_text(_at(o, "$.location")), _text(_at(o, "$.location.name"))),
        ),
    )
    kept = F.struct(*[_at(item, f"$.{k}").alias(k) for k in fixed.BOARD_A_METADATA])
    rows = _raw(
        items, [board, READ, "ordinal"],
        source=F.lit(fixed.BOARD_A),
        source_id=F.concat(F.lit(f"{fixed.BOARD_A}:"), token, F.lit(":"), ident),
        company=token,
        title=title,
        apply_url=url,
        location=_or_unspecified(_tidy(places)),
        closed=F.lit("false"),
        payload=F.to_json(kept, {"ignoreNullFields": "false"}),
        reason=F.when(~_is_object(item), F.lit("not an object"))
        .when(ident.isNull(), F.lit("id is missing"))
        .when(title.isNull(), F.lit("title is missing"))
        .when(url.isNull() | ~is_http_url(url), F.lit("url is missing or not http(s)")),
    )
    return _outcome(rows, failures)


def valid_site(site: Column | str) -> Column:
    token = strip(site)
    return (token != "") & (F.length(token) <= 200) & ~token.rlike(r"[/\\?#]")


def board_b(documents: DataFrame, *, site: str = "site", body: str = "body") -> Mapped:
    """Boards whose envelope is an array."""
    usable = documents.where(F.coalesce(valid_site(site), F.lit(False)))
    bad_site = documents.where(~F.coalesce(valid_site(site), F.lit(False))).select(
        site, F.lit("not a site token").alias("reason")
    )
    items, failures = _open_envelope(
        usable, body, "$", "response must be a JSON array", [site]
    )
    item = F.col("item")
    items = once(items, __id=_text_at(item, "$.id"), __title=_text_at(item, "$.text"),
                 __url=_text_at(item, "$.applyUrl", "$.hostedUrl"))
    ident, title, url = F.col("__id"), F.col("__title"), F.col("__url")

    def places(value: Column) -> Column:
        is_text = F.schema_of_variant(value) == "STRING"
        parts = F.transform(
            F.split(F.when(is_text, F.try_variant_get(value, "$", "string")), "[\n;]"), strip
        )
        listed = F.transform(F.try_variant_get(value, "$", ITEMS), _text)
        return F.filter(
            F.coalesce(parts, listed, F.array().cast("array<string>")), lambda p: p != ""
        )

    location = _tidy(F.concat(
        places(_at(item, "$.categories.location")),
        places(_at(item, "$.categories.allLocations")),
        places(_at(item, "$.workplaceType")),
    ))
    payload = F.struct(
        F.lit(fixed.BOARD_B).alias("provider"), strip(site).alias("site"), item.alias("raw")
    )
    rows = _raw(
        items, [site, READ, "ordinal"],
        source=F.lit(fixed.BOARD_B),
        source_id=ident,
        company=strip(site),
        title=title,
        apply_url=url,
        location=let(location, lambda v: F.when(F.size(v) > 0, v)),
        closed=F.lit("false"),
        payload=_json(payload),
        reason=F.when(~_is_object(item), F.lit("not an object"))
        .when(ident.isNull(), F.lit("id is missing"))
        .when(title.isNull(), F.lit("title is missing"))
        .when(~F.coalesce(url.rlike("(?i)^https?://"), F.lit(False)),
              F.lit("url is missing or not http(s)")),
    )
    return _outcome(rows, failures.unionByName(bad_site))


def cards(
    captured: DataFrame, *, careers_url: str | Column, company: str | Column,
    key: Sequence[str] = ("page", "ordinal"),
) -> Mapped:
    """Cards read from result pages: title, location, href and status."""
    page = strip(F.lit(careers_url) if isinstance(careers_url, str) else careers_url)
    title, place = strip("title"), strip("location")
    href, status = strip("href"), strip(F.coalesce("status", F.lit("")))
    url = join_url(page, href)
    payload = F.struct(
        F.lit(fixed.CARDS).alias("provider"), page.alias("careers_url"), status.alias("status")
    )
    rows = _raw(
        captured, key,
        source=F.lit(fixed.CARDS),
        source_id=url,
        company=F.lit(company) if isinstance(company, str) else company,
        title=title,
        apply_url=url,
        location=F.when(place != "", F.array(place)),
        closed=F.when(casefold(status) == "closed", F.lit("true")).otherwise(F.lit("false")),
        payload=_json(payload),
        reason=F.when(F.coalesce(title, F.lit("")) == "", F.lit("title is missing"))
        .when(F.coalesce(F.col("href"), F.lit("")) == "", F.lit("link is missing")),
    )
    empty = captured.select(*key).where("false").withColumn("reason", F.lit(""))
    return _outcome(rows, empty)


def portal(
    records: DataFrame, name: str, *, record: str = "record",
    key: Sequence[str] = ("doc", "path"),
) -> Mapped:
    """Records of a configured portal: the first non-empty text among ordered keys."""
    config = fixed.PORTALS[name]
    item = F.col(record)

    def first(field: str) -> Column:
        return _text_at(item, *[f"$.{k}" for k in config[field]])

    def places(path: str) -> Column:
        value = _at(item, path)
        listed = F.transform(
            F.try_variant_get(value, "$", ITEMS),
            lambda v: F.coalesce(_text(v), _text_at(v, *[f"$.{k}" for k in fixed.PLACE_KEYS])),
        )
        return F.coalesce(listed, F.array(_text(value)))

    records = once(records, __id=first("id"), __title=first("title"), __link=first("url"))
    records = once(records, __url=join_url(F.lit(config["base"]), F.col("__link")))
    ident, title, url = F.col("__id"), F.col("__title"), F.col("__url")
    location = _tidy(F.concat(*[places(f"$.{k}") for k in config["location"]]))
    payload = F.struct(F.lit(name).alias("provider"), item.alias("raw"))
    rows = _raw(
        records, key,
        source=F.lit(name),
        source_id=F.when(ident.isNotNull(), F.concat(F.lit(f"{name}:"), ident)).otherwise(url),
        company=F.lit(config["company"]),
        title=title,
        apply_url=url,
        location=_or_unspecified(location),
        closed=F.lit("false"),
        payload=_json(payload),
        reason=F.when(~_is_object(item), F.lit("not an object"))
        .when(title.isNull(), F.lit("title is missing"))
        .when(~F.coalesce(is_http_url(url), F.lit(False)), F.lit("url is missing or not http(s)")),
    )
    empty = records.select(*key).where("false").withColumn("reason", F.lit(""))
    return _outcome(rows, empty)


def flatten_envelopes(
    documents: DataFrame, *, body: str = "body", key: Sequence[str] = ("doc",)
) -> tuple[DataFrame, DataFrame]:
    """Records inside nested lists and containers, in document order, at any depth.

    A list opens into its items; an object is replaced by its first container key that is present if
    that holds a list or an object, and is a record otherwise. ``path`` orders the records of a
    document. A document is one cell, so one pass over its text finds the records, without a shuffle.
    Documents that are not JSON are returned as rejects.
    """
    read = once(spread(documents.select(*key, F.col(body).alias("body"))), __sound=F.try_parse_json("body").isNotNull()).drop(READ)
    good = read.where("__sound") \
        .select(*key, F.inline(open_envelope("body"))) \
        .select(*key, "path", F.parse_json("record").alias("record"))
    left = read.where("NOT __sound").select(
        *key, F.array().cast("array<int>").alias("path"), "body", F.lit("not valid JSON").alias("reason")
    )
    return good, left


REGISTRY: dict[str, Callable[..., Mapped]] = {
    fixed.BOARD_A: board_a,
    fixed.BOARD_B: board_b,
    fixed.CARDS: cards,
    **{name: (lambda df, _n=name, **kw: portal(df, _n, **kw)) for name in fixed.PORTALS},
}


def register(name: str, mapper: Callable[..., Mapped]) -> None:
    """Add a source: a function from captured documents to ``Mapped``."""
    REGISTRY[name] = mapper


def map_source(name: str, documents: DataFrame, **options) -> Mapped:
    return REGISTRY[name](documents, **options)


def endpoint_list(
    documents: DataFrame, *, body: str = "body", key: Sequence[str] = ("doc",)
) -> DataFrame:
    """Endpoints of text or JSON lists: trimmed, blanks dropped, first occurrence kept."""
    parsed = F.try_parse_json(col(body))
    values = F.coalesce(
        _at(parsed, "$.proxies", "array<string>"),
        _at(parsed, "$", "array<string>"),
        F.split(col(body), "[,\r\n]"),
    )
    items = documents.select(*key, F.posexplode(values).alias("ordinal", "endpoint"))
    named = items.withColumn("endpoint", strip("endpoint")).where("endpoint != ''")
    return named.groupBy(*key, "endpoint").agg(F.min("ordinal").alias("ordinal"))
