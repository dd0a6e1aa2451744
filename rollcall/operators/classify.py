"""Change classification of an observation log.

The state an observation meets depends only on the previous observation of the same key, so the
whole state machine is one ordered look-back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall import fixed_values as fixed
from rollcall.functions.hashing import is_strict_digest
from rollcall.operators.ordered import MIN_CHUNK_ROWS, in_order, with_previous

KEYS = ("namespace", "base_hash")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def check_ttl(seconds: int) -> int:
    if isinstance(seconds, bool) or not isinstance(seconds, int) or seconds <= 0:
        raise ValueError("the time to live must be a positive whole number of seconds")
    return seconds


def check_namespace(name: str) -> str:
    name = name.strip().strip(":")
    if not name or any(c.isspace() for c in name):
        raise ValueError("the namespace must be non-empty and hold no white space")
    return name


def valid_observations(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into usable observations and rejects with a reason."""
    reason = (
        F.when(~is_strict_digest("base_hash"), F.lit("base_hash must be a lower-case digest"))
        .when(~is_strict_digest("content_hash"), F.lit("content_hash must be a lower-case digest"))
        .when(F.col("is_closed").isNull(), F.lit("is_closed must be a boolean"))
    )
    tagged = observations.withColumn("reason", reason)
    return (
        tagged.where("reason IS NULL").drop("reason"),
        tagged.where("reason IS NOT NULL"),
    )


def state_of(
    previous_content: Column, previous_micros: Column, content: Column, now: Column,
    closed: Column, ttl_seconds: int,
) -> Column:
    """State of one observation; an entry is gone when its age reaches the time to live."""
    new, updated, closed_state, same = (F.lit(s) for s in fixed.STATES)
    expired = now - previous_micros >= F.lit(ttl_seconds * 1_000_000)
    return (
        F.when(previous_content.isNull() | expired, new)
        .when(previous_content == content, same)
        .when(closed, closed_state)
        .otherwise(updated)
    )


def classify(
    observations: DataFrame, *, keys: Sequence[str] = KEYS, content: str = "content_hash",
    closed: str = "is_closed", ts: str = "ts", ordinal: str = "ordinal",
    ttl_seconds: int = fixed.DEFAULT_TTL_SECONDS, min_chunk_rows: int = MIN_CHUNK_ROWS,
) -> DataFrame:
    """Add ``state`` to every observation, in (ts, ordinal) order inside a key."""
    check_ttl(ttl_seconds)
    timed = observations.withColumn("__at", micros(ts))
    data = in_order(timed, keys, [F.col("__at"), F.col(ordinal)], min_rows=min_chunk_rows)
    seen = with_previous(data, {"__content": content, "__before": "__at"}).done()
    state = state_of(
        F.col("__content"), F.col("__before"), F.col(content), F.col("__at"), F.col(closed),
        ttl_seconds,
    )
    return seen.withColumn("state", state).drop("__content", "__before", "__at")


def unexpired(state: DataFrame, ttl_seconds: int) -> DataFrame:
    """Entries seen within twice the time to live before the newest one; late rows may still need those."""
    newest = state.agg(F.max(micros("last_seen")).alias("m")).scalar()
    return state.where(micros("last_seen") > newest - F.lit(2 * ttl_seconds * 1_000_000))


def latest_state(
    observations: DataFrame, *, keys: Sequence[str] = KEYS, content: str = "content_hash",
    ts: str = "ts", ordinal: str = "ordinal",
) -> DataFrame:
    """What the log leaves behind per key; combined before the shuffle."""
    last = F.max_by(F.struct(content, ts), F.struct(ts, ordinal))
    return observations.groupBy(*keys).agg(last.alias("last")).select(
        *keys, F.col("last")[content].alias(content), F.col("last")[ts].alias("last_seen")
    )


def classify_batch(
    state: DataFrame, batch: DataFrame, *, keys: Sequence[str] = KEYS,
    content: str = "content_hash", closed: str = "is_closed", ts: str = "ts",
    ordinal: str = "ordinal", ttl_seconds: int = fixed.DEFAULT_TTL_SECONDS,
    min_chunk_rows: int = MIN_CHUNK_ROWS,
) -> DataFrame:
    """Classify a batch against a state table of (keys, content, last_seen).

    The state is first cut to the keys of the batch, so a small batch never shuffles the whole
    state; only each key's first row in the batch can meet it.
    """
    check_ttl(ttl_seconds)
    touched = state.join(batch.select(*keys).distinct(), list(keys), "left_semi").select(
        *keys, F.col(content).alias("__s_content"), micros("last_seen").alias("__s_at")
    )
    timed = batch.withColumn("__at", micros(ts))
    data = in_order(timed, keys, [F.col("__at"), F.col(ordinal)], min_rows=min_chunk_rows)
    seen = with_previous(data, {"__content": content, "__before": "__at"}).done()
    met = seen.join(touched, list(keys), "left")
    verdict = state_of(
        F.coalesce("__content", "__s_content"),
        F.when(F.col("__content").isNotNull(), F.col("__before")).otherwise(F.col("__s_at")),
        F.col(content), F.col("__at"), F.col(closed), ttl_seconds,
    )
    return met.withColumn("state", verdict).drop(
        "__content", "__before", "__at", "__s_content", "__s_at"
    )


def merge_state(
    state: DataFrame, batch: DataFrame, *, keys: Sequence[str] = KEYS,
    content: str = "content_hash", ts: str = "ts", ordinal: str = "ordinal",
) -> DataFrame:
    """The state after a batch: touched keys replaced, all others kept."""
    fresh = latest_state(batch, keys=keys, content=content, ts=ts, ordinal=ordinal)
    kept = state.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh)


def state_summary(
    classified: DataFrame, by: Sequence[str], rejected: DataFrame | None = None
) -> DataFrame:
    """Counts of the four states per run, zero where none, with the reject count."""
    counts = classified.groupBy(*by).agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in fixed.STATES]
    )
    if rejected is None:
        return counts
    refused = rejected.groupBy(*by).agg(F.count(F.lit(1)).alias("rejected"))
    return counts.join(refused, list(by), "full_outer").na.fill(
        0, [*fixed.STATES, "rejected"]
    )
