"""Captured responses: relevance, canonical form, bounded buffers and page cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall import fixed_values as fixed
from rollcall.functions.hashing import canonical_json, response_fingerprint
from rollcall.functions.urls import redact_query
from rollcall.operators.dedupe import keep_first
from rollcall.operators.ordered import MIN_CHUNK_ROWS, in_order, with_running_sum


def is_relevant(
    url: Column, status: Column, resource_type: Column, content_type: Column,
    patterns: Sequence[str] = fixed.RELEVANT_URL_PATTERNS,
) -> Column:
    """2xx, requested by a matching URL or a script, and JSON by its type or its URL."""
    by_url = url.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
    by_script = resource_type.isin("xhr", "fetch")
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    as_json = kind.contains("json") | kind.contains("graphql")
    return status.between(200, 299) & (by_url | by_script) & (as_json | by_url)


def capture(
    responses: DataFrame, *, patterns: Sequence[str] = fixed.RELEVANT_URL_PATTERNS,
    secret_keys: Sequence[str] = fixed.SECRET_QUERY_KEYS,
) -> DataFrame:
    """Relevant responses with valid JSON: redacted URL, canonical body, size, fingerprint."""
    relevant = responses.where(
        is_relevant(F.col("url"), F.col("status"), F.col("resource_type"),
                    F.col("content_type"), patterns)
    )
    shaped = relevant.withColumns({
        "url": redact_query("url", secret_keys),
        "body": canonical_json("body"),
    }).where("body IS NOT NULL")
    return shaped.withColumns({
        "estimated_bytes": F.octet_length("body").cast("bigint"),
        "fingerprint": response_fingerprint("method", "url", "status", "body"),
    })


def fingerprint_dedupe(
    captured: DataFrame, *, page: str = "page_key", order: str = "seq"
) -> DataFrame:
    """First capture per page and fingerprint over the whole log."""
    return keep_first(captured, [page, "fingerprint"], [F.col(order)])


def retained(
    captured: DataFrame, *, page: Sequence[str] = ("page_key",), order: str = "seq",
    size: str = "estimated_bytes", max_payloads: int = fixed.MAX_PAYLOADS,
    max_bytes: int | None = fixed.MAX_PAYLOAD_BYTES, min_chunk_rows: int = MIN_CHUNK_ROWS,
) -> DataFrame:
    """The longest run of latest captures within both limits.

    Up to 1,000 captures Spark keeps the top rows of each group before the shuffle, so a hot
    page sends few rows. Larger buffers use chunked running totals.
    """
    if max_payloads <= 0 or (max_bytes is not None and max_bytes <= 0):
        raise ValueError("limits must be positive")
    if max_payloads > 1000:
        newest = in_order(captured, page, [-F.col(order)], min_rows=min_chunk_rows)
        summed = with_running_sum(newest, {"__n": F.lit(1), "__bytes": F.col(size)}).done()
        rows = summed.where(F.col("__n") <= max_payloads)
    else:
        latest = Window.partitionBy(*page).orderBy(F.desc(order))
        top = captured.withColumn("__n", F.row_number().over(latest)).where(
            F.col("__n") <= max_payloads
        )
        so_far = latest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = top.withColumn("__bytes", F.sum(size).over(so_far))
    if max_bytes is not None:
        rows = rows.where(F.col("__bytes") <= max_bytes)
    return rows.drop("__n", "__bytes")


def cut_repeated_pages(
    items: DataFrame, *, run: Sequence[str] = ("run",), page: str = "page",
    ordinal: str = "ordinal", ident: str = "source_id", max_pages: int = 20,
) -> DataFrame:
    """Items of the pages before the first page that repeats an earlier one.

    Two pages are equal when they hold the same ids in the same order. The comparison uses the
    sum of the SHA-256 of (position, id) in exact decimals and the item count, which combine
    before the shuffle; no page is collected. A run keeps at most ``max_pages`` signatures.
    """
    if max_pages < 1:
        raise ValueError("max_pages must be positive")
    early = items.where(F.col(page) <= max_pages)
    digest = F.sha2(
        F.concat_ws("\u0000", F.col(ordinal).cast("string"), F.col(ident).cast("string")), 256
    )

    def part(at: int) -> Column:
        return F.conv(F.substring(digest, at, 14), 16, 10).cast("decimal(20,0)")

    pages = early.groupBy(*run, page).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(part(1)).alias("__a"), F.sum(part(15)).alias("__b"),
        F.sum(part(29)).alias("__c"),
    )
    alike = Window.partitionBy(*run, "__n", "__a", "__b", "__c").orderBy(page)
    repeats = pages.withColumn("__seen", F.row_number().over(alike)).where("__seen > 1")
    stop = repeats.groupBy(*run).agg(F.min(page).alias("__stop"))
    return early.join(stop, list(run), "left").where(
        F.col("__stop").isNull() | (F.col(page) < F.col("__stop"))
    ).drop("__stop")
