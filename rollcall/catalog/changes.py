"""Classification and duplicate removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.catalog import query, table
from rollcall.operators import dedupe
from rollcall.operators.classify import classify, classify_batch, latest_state, state_summary

SIX_HOURS = 6 * 3600
LOG = {"keys": ["user_id"], "content": "event_type", "ordinal": "event_id"}


def observations(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", "ts", "event_type", "value",
        (F.col("event_type") == "error").alias("is_closed"),
    )


STATE_SQL = """
  CASE WHEN p IS NULL OR ts - pt >= INTERVAL 6 HOUR THEN 'NEW_ROLE'
       WHEN p = event_type THEN 'NO_OP'
       WHEN event_type = 'error' THEN 'ROLE_CLOSED' ELSE 'ROLE_UPDATED' END AS state"""

LAG_SQL = """
WITH o AS (SELECT event_id, user_id, event_type, ts, value,
  lag(event_type) OVER w AS p, lag(ts) OVER w AS pt
  FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("classify_changes", LAG_SQL.format(source="events")
       + "SELECT event_id, user_id," + STATE_SQL + " FROM o")
def classify_changes(spark, sf):
    return classify(observations(spark, sf), ttl_seconds=SIX_HOURS, **LOG).select(
        "event_id", "user_id", "state"
    )


HOT_CHUNK = 2_000  # rows; so small that the hot key of the test tables is cut
HOT_SQL = """(SELECT event_id, event_type, value, CASE WHEN event_id % 10 < 7 THEN -1 ELSE user_id END AS user_id,
  CASE WHEN event_id % 10 < 7 THEN TIMESTAMP '2024-01-10' ELSE ts END AS ts FROM events
  UNION ALL SELECT -event_id - 1, event_type, value, -1, TIMESTAMP '1970-01-01' FROM events WHERE event_id = 0)"""


def hot_observations(spark, sf):
    """A log in which one key holds 70 % of the rows at one time, and one row half a century before."""
    rows, crowd = observations(spark, sf), F.col("event_id") % 10 < 7
    moved = rows.withColumns({
        "user_id": F.when(crowd, F.lit(-1)).otherwise(F.col("user_id")).cast(rows.schema["user_id"].dataType),
        "ts": F.when(crowd, F.lit("2024-01-10").cast("timestamp_ntz")).otherwise(F.col("ts")),
    })
    early = rows.where("event_id = 0").withColumns({
        "event_id": (-F.col("event_id") - 1).cast(rows.schema["event_id"].dataType),
        "user_id": F.lit(-1).cast(rows.schema["user_id"].dataType), "ts": F.lit("1970-01-01").cast("timestamp_ntz"),
    })
    return moved.unionByName(early)


@query("classify_hot_key", LAG_SQL.format(source=HOT_SQL) + "SELECT event_id, user_id::BIGINT AS user_id," + STATE_SQL + " FROM o")
def classify_hot_key(spark, sf):
    return classify(hot_observations(spark, sf), ttl_seconds=SIX_HOURS, min_chunk_rows=HOT_CHUNK, **LOG).select(
        "event_id", F.col("user_id").cast("bigint").alias("user_id"), "state"
    )


@query("classify_incremental", LAG_SQL.format(source="events")
       + "SELECT event_id, user_id," + STATE_SQL
       + " FROM o WHERE ts >= TIMESTAMP '2024-01-16'")
def classify_incremental(spark, sf):
    rows = observations(spark, sf)
    split = F.lit("2024-01-16").cast("timestamp_ntz")
    state = latest_state(rows.where(F.col("ts") < split), **LOG)
    batch = rows.where(F.col("ts") >= split)
    return classify_batch(state, batch, ttl_seconds=SIX_HOURS, **LOG).select(
        "event_id", "user_id", "state"
    )


@query("state_summary", LAG_SQL.format(source="(SELECT * FROM events WHERE value >= 1)")
       + ", c AS (SELECT strftime(ts, '%Y-%m-%d') AS run," + STATE_SQL + " FROM o),"
       """
r AS (SELECT strftime(ts, '%Y-%m-%d') AS run, count(*) AS rejected FROM events
      WHERE value < 1 GROUP BY 1),
s AS (SELECT run, count(*) FILTER (state = 'NEW_ROLE') AS a,
  count(*) FILTER (state = 'ROLE_UPDATED') AS b, count(*) FILTER (state = 'ROLE_CLOSED') AS c,
  count(*) FILTER (state = 'NO_OP') AS d FROM c GROUP BY run)
SELECT run, coalesce(a, 0) AS "NEW_ROLE", coalesce(b, 0) AS "ROLE_UPDATED",
  coalesce(c, 0) AS "ROLE_CLOSED", coalesce(d, 0) AS "NO_OP", coalesce(rejected, 0) AS rejected
FROM s FULL JOIN r USING (run)""")
def summary(spark, sf):
    rows = observations(spark, sf)
    run = F.date_format("ts", "yyyy-MM-dd").alias("run")
    classified = classify(rows.where("value >= 1"), ttl_seconds=SIX_HOURS, **LOG)
    return state_summary(
        classified.select(run, "state"), ["run"], rows.where("value < 1").select(run)
    )


@query("signature_dedupe", """
SELECT source, base_hash, content_hash, is_removed, doc_id FROM (
  SELECT source, lang AS base_hash, sha256(text) AS content_hash, n_chars < 500 AS is_removed,
    doc_id, row_number() OVER (PARTITION BY source, lang, sha256(text)
                               ORDER BY n_chars < 500, doc_id) AS rn FROM documents)
WHERE rn = 1""")
def signature(spark, sf):
    rows = table(spark, sf, "documents").select(
        "source", F.col("lang").alias("base_hash"), F.sha2("text", 256).alias("content_hash"),
        (F.col("n_chars") < 500).alias("is_removed"), "doc_id",
    )
    return dedupe.signature_dedupe(rows, scope=("source",), order=("doc_id",))


@query("first_wins_identity", """
WITH u AS (SELECT 0 AS rank, s_suppkey AS ordinal, s_nationkey AS nation FROM supplier
  UNION ALL SELECT 1, c_custkey, c_nationkey FROM customer)
SELECT rank, ordinal, nation, CASE WHEN row_number() OVER (PARTITION BY nation
  ORDER BY rank, ordinal) > 1 THEN 'duplicate base identity in run' END AS reason FROM u""")
def first_wins(spark, sf):
    suppliers = table(spark, sf, "supplier").select(
        F.lit(0).alias("rank"), F.col("s_suppkey").alias("ordinal"),
        F.col("s_nationkey").alias("nation"),
    )
    customers = table(spark, sf, "customer").select(
        F.lit(1).alias("rank"), F.col("c_custkey").alias("ordinal"),
        F.col("c_nationkey").alias("nation"),
    )
    kept, later = dedupe.first_wins(
        suppliers.unionByName(customers), "nation", ["rank", "ordinal"]
    )
    none = F.lit(None).cast("string")
    return kept.withColumn("reason", none).unionByName(later).select(
        "rank", "ordinal", "nation", "reason"
    )


@query("last_wins_compaction", """
SELECT user_id, arg_max(event_id, event_id) AS event_id,
  arg_max(event_type, event_id) AS event_type, min(event_id) AS first_event
FROM events GROUP BY user_id""")
def last_wins(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return dedupe.last_wins(rows, "user_id", ["event_id"]).select(
        "user_id", "event_id", "event_type", F.col("first_seen.event_id").alias("first_event")
    )


@query("suppress_replaced", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
  CASE l_linestatus WHEN 'O' THEN 'added' ELSE 'removed' END AS kind FROM lineitem)
SELECT * FROM l WHERE kind = 'added' OR NOT EXISTS (SELECT 1 FROM l a WHERE a.kind = 'added'
  AND a.l_suppkey = l.l_suppkey AND a.l_partkey = l.l_partkey)""")
def suppress(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        F.when(F.col("l_linestatus") == "O", "added").otherwise("removed").alias("kind"),
    )
    return dedupe.suppress_replaced(rows, scope="l_suppkey", identity="l_partkey")


@query("record_dedupe", """
WITH r AS (SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE source || lang END AS ident,
  sha256(text) AS link FROM documents)
SELECT min(doc_id) AS doc_id, coalesce(ident, link) AS ident FROM r GROUP BY 2""")
def records(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", F.lit(None)).otherwise(F.concat("source", "lang"))
        .alias("key"),
        F.sha2("text", 256).alias("link"),
    )
    kept = dedupe.record_dedupe(rows, primary="key", fallback="link", order=["doc_id"])
    return kept.select("doc_id", F.coalesce("key", "link").alias("ident"))


@query("distinct_in_order", """
SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_position
FROM orders GROUP BY 1, 2""")
def distinct(spark, sf):
    return dedupe.distinct_in_order(
        table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey"
    )
