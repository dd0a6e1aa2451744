"""Duplicate removal by key, without windows over whole groups.

Winners are found with ``min_by``/``max_by``, which combine before the shuffle, so a key that
holds a third of all rows sends one row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall import fixed_values as fixed


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key, all columns kept."""
    return _keep(df, keys, F.min_by, order)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of every key, all columns kept."""
    return _keep(df, keys, F.max_by, order)


def _keep(df, keys, pick, order) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = pick(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(picked).select(*keys, "__row.*").select(*df.columns)


def signature_dedupe(
    rows: DataFrame, *, scope: Sequence[str] = ("commit",), removed: str | None = "is_removed",
    order: Sequence[str] = ("file_ordinal", "line_no"),
) -> DataFrame:
    """Keep one row per (scope, identity, content), added rows before removed ones."""
    by = ([F.col(removed)] if removed else []) + [F.col(o) for o in order]
    return keep_first(rows, [*scope, "base_hash", "content_hash"], by)


def first_wins(
    rows: DataFrame, key: str, order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows that come first for their key, and all later ones with a reason.

    The first position per key is computed with a combined minimum and joined back; AQE splits a
    skewed partition of that join.
    """
    at = F.struct(*order)
    firsts = rows.groupBy(key).agg(F.min(at).alias("__first"))
    tagged = rows.join(firsts, key)
    won = at == F.col("__first")
    kept = tagged.where(won).drop("__first")
    later = tagged.where(~won).drop("__first").withColumn(
        "reason", F.lit(fixed.DUPLICATE_IDENTITY)
    )
    return kept, later


def last_wins(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The final row per key and ``first_seen``, the place where the key first appeared."""
    at = F.struct(*order)
    rest = [c for c in rows.columns if c != key]
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct(*rest), at).alias("__row"), F.min(at).alias("first_seen"))
        .select(key, "__row.*", "first_seen")
        .select(*rows.columns, "first_seen")
    )


def suppress_replaced(
    rows: DataFrame, *, scope: str = "commit", identity: str = "base_hash", kind: str = "kind"
) -> DataFrame:
    """Drop removed rows whose identity is also added in the same scope."""
    added = rows.where(F.col(kind) == "added").select(scope, identity).distinct()
    removed = rows.where(F.col(kind) == "removed").join(added, [scope, identity], "left_anti")
    return rows.where(F.col(kind) != "removed").unionByName(removed.select(*rows.columns))


def one_per_signature(
    rows: DataFrame, *, scope: str = "commit", apart: str | None = None, kind: str = "kind",
    order: Sequence[str] = ("file_ordinal", "line_no"),
) -> DataFrame:
    """``suppress_replaced`` and then ``signature_dedupe`` in one shuffle, by (scope, identity).

    Rows where the struct ``apart`` is not NULL share a signature only with rows of the same value. For scopes
    whose rows come from few texts, as commits: all rows of one identity in a scope meet in one task.
    """
    together = [scope, "base_hash"]
    added = F.max(F.col(kind) == "added").over(Window.partitionBy(*together)) & F.col(scope).isNotNull()
    seen = rows.withColumn("__replaced", (F.col(kind) == "removed") & added).where("NOT __replaced")
    signature = Window.partitionBy(*together, "content_hash", *([apart] if apart else []))
    first = signature.orderBy(F.col(kind) == "removed", *order)
    return seen.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth", "__replaced")


def record_dedupe(
    rows: DataFrame, *, primary: str, fallback: str, order: Sequence[str]
) -> DataFrame:
    """First row per source id, or per URL where there is no id; rows with neither are dropped."""
    identity = F.coalesce(
        F.when(F.col(primary) != "", F.col(primary)),
        F.when(F.col(fallback) != "", F.col(fallback)),
    )
    known = rows.withColumn("__identity", identity).where("__identity IS NOT NULL")
    return keep_first(known, ["__identity"], [F.col(o) for o in order]).drop("__identity")


def distinct_in_order(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Distinct values per key with the position at which each first appeared."""
    return df.groupBy(*keys, value).agg(F.min(order).alias("first_position"))
