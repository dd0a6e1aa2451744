"""Integrity checks over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall import fixed_values as fixed
from rollcall.storage import work_path

IDS_PER_LINE = 10_000


def duplicate_groups(postings: DataFrame, column: str) -> DataFrame:
    """Values held by more than one posting, with their counts."""
    return postings.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n")
    ).where("n > 1")


def sharing(postings: DataFrame, column: str) -> DataFrame:
    """Postings whose value is not unique. AQE splits the join where one value is hot."""
    return postings.join(duplicate_groups(postings, column), column, "left_semi")


def stale_closed(
    postings: DataFrame, now: Column, stale_hours: float, *, closed: str = "is_closed",
    updated: str = "updated_at",
) -> DataFrame:
    cutoff = now - F.make_dt_interval(secs=F.lit(float(stale_hours) * 3600))
    return postings.where(F.col(closed) & (F.col(updated) < cutoff))


def short_hash(column: str) -> Column:
    """Bytes that differ exactly where the values differ: lower-case hex digits in half their length, other text as it is."""
    raw = F.unhex(column)
    return F.when(F.lower(F.hex(raw)) == F.col(column), F.concat(F.lit(b"\x01"), raw)).otherwise(
        F.concat(F.lit(b"\x00"), F.col(column).cast("binary")))


def findings(
    postings: DataFrame, companies: DataFrame, logs: DataFrame, *, now: Column,
    stale_hours: float = 720,
) -> DataFrame:
    """All offending postings as (code, id); the ids stay distributed.

    Both hashes are counted in one aggregate and the other findings are flags of one pass, so postings are scanned three
    times (once for the counts), companies and logs once each. Hashes cross shuffles as bytes.
    """
    orphan, same_base, same_content, unlogged, stale = fixed.AUDIT_CODES
    hashes = F.array(*[F.struct(F.lit(code).alias("code"), short_hash(name).alias("hash"))
                       for code, name in ((0, "base_hash"), (1, "content_hash"))])
    held = postings.select("id", F.explode(hashes).alias("h")).select("id", "h.*").where("hash IS NOT NULL")
    groups = held.groupBy("code", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # AQE splits this join where one hash is hot
    sharing = held.join(groups, ["code", "hash"], "left_semi").select(
        F.when(F.col("code") == 0, same_base).otherwise(same_content).alias("code"), "id")
    known = companies.select(F.col("id").alias("company_id")).distinct().withColumn("known", F.lit(True))
    logged = logs.select(F.col("job_id").alias("id")).distinct().withColumn("logged", F.lit(True))
    old = F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(float(stale_hours) * 3600))
    flags = F.array(
        F.when(F.col("known").isNull(), F.lit(orphan)),
        F.when(F.col("is_closed") & F.col("logged").isNull(), F.lit(unlogged)),
        F.when(F.col("is_closed") & old, F.lit(stale)),
    )
    rows = postings.select("id", "company_id", "is_closed", "updated_at")
    flagged = rows.join(known, "company_id", "left").join(logged, "id", "left").select(F.explode(flags).alias("code"), "id")
    return sharing.unionByName(flagged.where("code IS NOT NULL"))


def audit_summary(found: DataFrame) -> DataFrame:
    """Findings that are not empty, with their counts."""
    return found.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


def audit_report(found: DataFrame) -> DataFrame:
    """The report as JSON lines: one head line, then the findings with all their ids.

    Ids are cut into lines by value range, so that no line grows with the data. The lines' ids are written once to the
    working folder, so that the head line does not find them all again.
    """
    spark = found.sparkSession
    rows = found.groupBy(
        "code", F.floor(F.col("id") / IDS_PER_LINE).alias("part")
    ).agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("id")).alias("ids"))
    path = work_path(spark, "audit")
    rows.write.parquet(path)
    parts = spark.read.schema(rows.schema).parquet(path)
    total = parts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("problems"),
        F.count_distinct("code").alias("findings"),
    )
    head = total.select(
        F.lit("").alias("code"), F.lit(-1).cast("bigint").alias("part"),
        F.to_json(F.struct((F.col("problems") == 0).alias("healthy"), "findings")).alias("line"),
    )
    body = parts.select("code", "part", F.to_json(F.struct("code", "count", "ids")).alias("line"))
    return head.unionByName(body)
