"""Health of sources and endpoints from their run and outcome logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall import fixed_values as fixed
from rollcall.functions.text import casefold, strip
from rollcall.functions.urls import endpoint_key
from rollcall.operators.classify import micros
from rollcall.operators.ordered import (
    MIN_CHUNK_ROWS, in_order, with_last_known, with_running_sum,
)


def valid_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs with a name and without negative numbers; others are rejected."""
    reason = (
        F.when(F.coalesce(strip("scraper"), F.lit("")) == "",
               F.lit("scraper name must be non-empty"))
        .when((F.col("duration_seconds") < 0) | (F.col("jobs_parsed") < 0),
              F.lit("duration and job count must not be negative"))
    )
    tagged = runs.withColumn("reason", reason)
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL")


def source_health(runs: DataFrame, *, ordinal: str | None = None) -> DataFrame:
    """Aggregates per source. The last error is that of the latest failing run.

    Durations are summed in microseconds, so the result does not depend on the order of rows.
    """
    at = F.struct("ts", ordinal) if ordinal else F.struct("ts")
    failed = F.col("error").isNotNull()
    span = F.round(F.col("duration_seconds") * 1_000_000).cast("bigint")
    n = F.count(F.lit(1))
    failures = F.count_if(failed)
    return runs.groupBy(casefold(strip("scraper")).alias("scraper")).agg(
        n.alias("runs"),
        F.count_if(~failed).alias("successes"),
        failures.alias("failures"),
        F.sum("jobs_parsed").alias("jobs_parsed"),
        (F.sum(span) / n / 1_000_000).alias("average_duration_seconds"),
        (failures / n).alias("error_rate"),
        F.max_by("error", F.when(failed, at)).alias("last_error"),
        F.max("ts").alias("last_run_at"),
    )


def recent_errors(runs: DataFrame, *, n: int = fixed.RECENT_ERRORS, ordinal: str | None = None):
    """The latest ``n`` errors, oldest first."""
    if n <= 0:
        raise ValueError("the limit must be positive")
    keys = ["ts", ordinal] if ordinal else ["ts"]
    latest = runs.where("error IS NOT NULL").orderBy(*[F.desc(k) for k in keys]).limit(n)
    return latest.select(
        *keys, casefold(strip("scraper")).alias("scraper"), "error"
    ).orderBy(*keys)


def run_row(jobs: DataFrame, scraper: str, started: Column, ended: Column) -> DataFrame:
    """The run-log row of a finished extraction."""
    return jobs.agg(F.count(F.lit(1)).alias("jobs_parsed")).select(
        F.lit(scraper).alias("scraper"),
        ended.alias("ts"),
        ((F.unix_micros(ended) - F.unix_micros(started)) / 1_000_000).alias("duration_seconds"),
        "jobs_parsed",
        F.lit(None).cast("string").alias("error"),
    )


def endpoint_health(outcomes: DataFrame, *, ordinal: str | None = None) -> DataFrame:
    """Aggregates per endpoint address without credentials; the last status may be NULL."""
    at = F.struct("ts", ordinal) if ordinal else F.struct("ts")
    bad = F.count_if(~F.col("success"))
    last = F.max_by(F.struct("status"), at)
    return outcomes.groupBy(endpoint_key("endpoint").alias("proxy")).agg(
        F.count_if(F.col("success")).alias("successes"),
        bad.alias("failures"),
        (bad / F.count(F.lit(1))).alias("failure_rate"),
        last["status"].alias("last_status"),
    )


def is_transient(status: Column) -> Column:
    return F.coalesce(status.isin(*fixed.TRANSIENT_STATUS), F.lit(False))


def failure_streaks(
    outcomes: DataFrame, *, keys=("endpoint",), ordinal: str = "ordinal",
    base_seconds: float = fixed.BASE_COOLDOWN_SECONDS,
    max_seconds: float = fixed.MAX_COOLDOWN_SECONDS, max_failures: int = fixed.MAX_FAILURES,
    min_chunk_rows: int = MIN_CHUNK_ROWS,
) -> DataFrame:
    """State after every outcome: streak, cooldown end (microseconds) and whether it is dead.

    A success resets all three. Only the fixed cooling statuses start a cooldown, which doubles
    with the streak up to a maximum.
    """
    if base_seconds <= 0 or max_seconds < base_seconds or max_failures < 1:
        raise ValueError("invalid health settings")
    timed = outcomes.withColumn("__at", micros("ts"))
    data = in_order(timed, keys, [F.col("__at"), F.col(ordinal)], min_rows=min_chunk_rows)
    data = with_running_sum(data, {"__n": F.lit(1)})
    data = with_last_known(data, "__ok", F.when(F.col("success"), F.col("__n")))
    since = F.coalesce(F.col("__ok"), F.lit(0))
    streak = F.col("__n") - since
    cooling = ~F.col("success") & F.coalesce(
        F.col("status").isin(*fixed.COOLING_STATUS), F.lit(False)
    )
    # Beyond 60 doublings any cooldown is at its maximum.
    delay = F.least(
        F.lit(float(max_seconds)),
        F.lit(float(base_seconds)) * F.pow(F.lit(2.0), F.least(streak - 1, F.lit(60))),
    )
    until = F.col("__at") + F.round(delay * 1_000_000).cast("bigint")
    cooled = F.when(
        cooling,
        F.struct(F.col("__n").alias("n"), until.alias("until"),
                 (streak >= max_failures).alias("dead")),
    )
    data = with_last_known(data, "__cool", cooled)
    live = F.col("__cool")["n"] > since
    return data.done().select(
        *outcomes.columns,
        streak.cast("bigint").alias("consecutive_failures"),
        F.when(live, F.col("__cool")["until"]).alias("cooldown_until"),
        F.coalesce(F.when(live, F.col("__cool")["dead"]), F.lit(False)).alias("dead"),
    )


def endpoint_state(streaks: DataFrame, *, keys=("endpoint",), ordinal: str = "ordinal"):
    """The state each endpoint is left in."""
    values = ("consecutive_failures", "cooldown_until", "dead")
    last = F.max_by(F.struct(*values), F.struct("ts", ordinal)).alias("last")
    return streaks.groupBy(*keys).agg(
        F.count_if(F.col("success")).alias("successes"),
        F.count_if(~F.col("success")).alias("failures"),
        last,
    ).select(*keys, "successes", "failures", "last.*")
