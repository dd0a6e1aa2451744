"""Ordered windows that survive a hot key.

``lag``, running totals and "last known value" need all rows of a key in order, so a plain window
puts a key holding a third of the table into one task. Here keys above a share of the table
are cut into consecutive chunks of as many rows; a window runs inside each (key, chunk) and a
small table carries the result of the earlier chunks over. The cuts are quantiles of the full order
of the key's own rows, taken from a sample by hash, so chunks are even however the rows lie in time
and a repeated task gives the same cuts. Both side tables are bounded by construction: at most
``parts`` keys can hold more than 1/``parts`` of all rows, and their chunks
number at most twice that, so both may be broadcast at any data size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PARTS = 16_384
MIN_CHUNK_ROWS = 1_000_000
SAMPLES = 64  # rows of a chunk that its cuts are taken from
_STEPS = [2 ** j for j in range(PARTS.bit_length(), -1, -1)]  # of a binary search among the cuts of one key

_CHUNK, _CUTS, _HOT = "__chunk", "__cuts", "__hot"


@dataclass(frozen=True)
class Ordered:
    """Rows with their chunk, the keys and the order inside a key."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[Column, ...]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, _CHUNK).orderBy(*self.order)

    def with_rows(self, rows: DataFrame) -> Ordered:
        return Ordered(rows, self.keys, self.order)

    def done(self) -> DataFrame:
        return self.rows.drop(_CHUNK, _HOT)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for key in keys:
        test = test & left[key].eqNullSafe(right[f"__r_{key}"])
    return test


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__r_{k}" for k in keys})


def hot_keys(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], *,
    parts: int = PARTS, min_rows: int = MIN_CHUNK_ROWS,
) -> DataFrame:
    """Keys holding more than 1/``parts`` of all rows, with the first order value of every chunk but the first.

    Reads only the key and order columns. Counts combine before the shuffle; of a hot key about ``SAMPLES`` rows for
    each chunk are gathered.
    """
    share = df.agg(F.count(F.lit(1)).alias("n")).scalar() / F.lit(parts)
    limit = F.greatest(F.lit(float(min_rows)), share)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    large = _renamed(large.select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("__pieces")), keys)
    every = F.greatest(F.lit(1), F.floor(limit / SAMPLES)).cast("bigint")
    some = df.where(F.pmod(F.xxhash64(*order), every) == 0).select(*keys, F.struct(*order).alias("__at_place"))
    held = some.join(F.broadcast(large), _same(some, large, keys)).groupBy(*keys, "__pieces").agg(
        F.sort_array(F.collect_list("__at_place")).alias("__places"))
    places = F.col("__places")
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("__pieces") - 1),
        lambda i: F.get(places, F.floor(i * F.size(places) / F.col("__pieces")).cast("int")),
    )
    return held.select(*keys, F.array_distinct(cuts).alias(_CUTS))


def in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], *,
    parts: int = PARTS, min_rows: int = MIN_CHUNK_ROWS,
) -> Ordered:
    """Cut hot keys into chunks of about as many rows along ``order``, which should be total inside a key."""
    keys = tuple(keys)
    hot = _renamed(hot_keys(df, keys, order, parts=parts, min_rows=min_rows), keys)
    joined = df.join(F.broadcast(hot), _same(df, hot, keys), "left")
    cuts, place = F.col(_CUTS), F.struct(*order)
    chunk = F.aggregate(  # how many cuts are not above the row
        F.array(*[F.lit(s) for s in _STEPS]), F.lit(0),
        lambda found, s: F.when((found + s <= F.size(cuts)) & (F.get(cuts, found + s - 1) <= place), found + s)
        .otherwise(found),
    )
    rows = joined.withColumns({
        _CHUNK: F.when(cuts.isNotNull(), chunk).otherwise(F.lit(0)).cast("bigint"), _HOT: cuts.isNotNull(),
    }).drop(_CUTS, *[f"__r_{k}" for k in keys])
    return Ordered(rows, keys, tuple(order))


def _carry(
    data: Ordered, totals: Mapping[str, Column], over: Mapping[str, Callable[[WindowSpec], Column]]
) -> DataFrame:
    """One row per chunk of a hot key with what the earlier chunks hand over."""
    per_chunk = (
        data.rows.where(_HOT)
        .groupBy(*data.keys, _CHUNK)
        .agg(*[c.alias(n) for n, c in totals.items()])
    )
    before = (
        Window.partitionBy(*data.keys).orderBy(_CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return per_chunk.select(
        *data.keys, _CHUNK, *[make(before).alias(n) for n, make in over.items()]
    )


def _join_carry(rows: DataFrame, data: Ordered, carry: DataFrame) -> DataFrame:
    on = (*data.keys, _CHUNK)
    right = _renamed(carry, on)
    return rows.join(F.broadcast(right), _same(rows, right, on), "left").drop(
        *[f"__r_{k}" for k in on]
    )


def with_previous(data: Ordered, columns: Mapping[str, str]) -> Ordered:
    """Add the previous row's values: ``{new name: column}``; NULL on a key's first row."""
    w = data.window
    kept = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    local = data.rows.withColumn("__prev", F.lag(kept).over(w))
    position = F.struct(*data.order)
    carry = _carry(
        data,
        {"__last": F.max_by(kept, position)},
        {"__carry": lambda before: F.last("__last", ignorenulls=True).over(before)},
    )
    out = _join_carry(local, data, carry)
    value = F.coalesce(F.col("__prev"), F.col("__carry"))
    return data.with_rows(
        out.withColumns({n: value[n] for n in columns}).drop("__prev", "__carry")
    )


def with_running_sum(data: Ordered, sums: Mapping[str, Column]) -> Ordered:
    """Add running totals that include the current row."""
    w = data.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = data.rows.withColumns({f"__s_{n}": F.sum(c).over(w) for n, c in sums.items()})
    carry = _carry(
        data,
        {f"__t_{n}": F.sum(c) for n, c in sums.items()},
        {f"__c_{n}": (lambda b, n=n: F.sum(f"__t_{n}").over(b)) for n in sums},
    )
    out = _join_carry(local, data, carry)
    zero = F.lit(0)
    totals = {
        n: F.coalesce(F.col(f"__s_{n}"), zero) + F.coalesce(F.col(f"__c_{n}"), zero) for n in sums
    }
    return data.with_rows(
        out.withColumns(totals).drop(*[f"__{k}_{n}" for n in sums for k in "sc"])
    )


def with_last_known(
    data: Ordered, name: str, value: Column, *, include_current: bool = True
) -> Ordered:
    """Add the latest non-NULL ``value`` at or before each row."""
    end = Window.currentRow if include_current else -1
    w = data.window.rowsBetween(Window.unboundedPreceding, end)
    local = data.rows.withColumn("__known", F.last(value, ignorenulls=True).over(w))
    position = F.when(value.isNotNull(), F.struct(*data.order))
    carry = _carry(
        data,
        {"__last": F.max_by(value, position)},
        {"__carry": lambda before: F.last("__last", ignorenulls=True).over(before)},
    )
    out = _join_carry(local, data, carry)
    return data.with_rows(
        out.withColumn(name, F.coalesce(F.col("__known"), F.col("__carry"))).drop(
            "__known", "__carry"
        )
    )
