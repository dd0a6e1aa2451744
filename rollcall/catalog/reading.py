"""Search, pages, statistics, audit and health."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollcall.catalog import query, table
from rollcall.functions.hashing import digest
from rollcall.functions.urls import endpoint
from rollcall.operators import audit, health, listing, responses

ROWS_PER_PART = 250_000


def postings(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderpriority").alias("title"),
        (F.col("o_orderstatus") == "F").alias("is_closed"),
        F.when(F.col("o_orderstatus") == "P", F.lit("internship")).otherwise(F.lit("new_grad"))
        .alias("job_type"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def companies(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )


def found(spark, sf):
    return listing.search(
        postings(spark, sf), companies(spark, sf), term="  URGENT ", active=True
    )


FOUND_SQL = """
WITH f AS (SELECT o_orderkey AS id, c_name AS name, o_orderpriority AS title, o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus <> 'F' AND (lower(o_orderpriority) LIKE '%urgent%'
    OR lower(c_name) LIKE '%urgent%'))"""


@query("search_listings", FOUND_SQL + """
SELECT id, title, name, created_at FROM f ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40""")
def search(spark, sf):
    return listing.page_of(found(spark, sf), page=3, size=20).select(
        "id", "title", F.col("company.name").alias("name"), "created_at"
    )


@query("search_company", """
SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey
WHERE lower(c_name) = 'customer#000000007'""")
def search_company(spark, sf):
    rows = listing.search(
        postings(spark, sf), companies(spark, sf), company="  CUSTOMER#000000007 "
    )
    return rows.select("id", F.col("company.name").alias("name"))


@query("page_after", FOUND_SQL + """
SELECT id, created_at FROM f WHERE (created_at, id) < (TIMESTAMP '1997-01-01', 5000)
ORDER BY created_at DESC, id DESC LIMIT 20""")
def page_after(spark, sf):
    return listing.page_after(
        found(spark, sf), F.lit("1997-01-01").cast("timestamp_ntz"), F.lit(5000), size=20
    ).select("id", "created_at")


@query("listing_count", FOUND_SQL + """
SELECT count(*) AS total, 3 AS page, 20 AS page_size, ceil(count(*) / 20)::BIGINT AS total_pages,
  3 < ceil(count(*) / 20) AS has_next, count(*) > 0 AS has_previous FROM f""")
def listing_count(spark, sf):
    return listing.page_info(found(spark, sf), page=3, size=20)


@query("list_companies", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def list_companies(spark, sf):
    rows = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    return listing.list_companies(rows)


@query("listing_stats", """
SELECT (SELECT count(*) FROM customer) AS total_companies, count(*) AS total_jobs,
  count(*) FILTER (o_orderstatus <> 'F') AS active_jobs,
  count(*) FILTER (o_orderstatus = 'F') AS closed_jobs,
  count(*) FILTER (o_orderstatus = 'P') AS internship_jobs,
  count(*) FILTER (o_orderstatus <> 'P') AS new_grad_jobs FROM orders""")
def stats(spark, sf):
    return listing.system_stats(postings(spark, sf), companies(spark, sf))


@query("lookup_listing", """
SELECT p_partkey, sha256(p_partkey::VARCHAR) AS base_hash FROM part
WHERE p_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')""")
def lookup(spark, sf):
    part = table(spark, sf, "part")
    key = F.sha2(F.col("p_partkey").cast("string"), 256)
    wanted = part.where("p_type = 'ECONOMY'").select(
        F.concat(F.lit(" "), F.upper(key), F.lit("\n")).alias("wanted")
    )
    rows = part.select("p_partkey", key.alias("base_hash"))
    return listing.by_base_hashes(rows, wanted).select("p_partkey", "base_hash")


@query("digest_form", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN NULL ELSE sha256(p_partkey::VARCHAR) END
  AS digest FROM part""")
def digest_form(spark, sf):
    key = F.sha2(F.col("p_partkey").cast("string"), 256)
    text = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("sha256:"), key)).otherwise(
        F.concat(F.lit(" "), F.upper(key))
    )
    return table(spark, sf, "part").select("p_partkey", digest(text).alias("digest"))


def audit_findings(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"),
        F.sha2(F.concat_ws("|", "o_custkey", "o_orderpriority", "o_orderstatus"), 256)
        .alias("base_hash"),
        F.sha2(F.concat_ws("|", "o_custkey", "o_orderdate"), 256).alias("content_hash"),
        (F.col("o_orderstatus") == "F").alias("is_closed"),
        F.col("o_orderdate").alias("updated_at"),
    )
    known = table(spark, sf, "customer").where("c_acctbal >= 0").select(
        F.col("c_custkey").alias("id")
    )
    logs = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("job_id")
    )
    now = F.lit("1998-09-01").cast("timestamp_ntz")
    return audit.findings(rows, known, logs, now=now, stale_hours=720)


FINDINGS_SQL = """
WITH p AS (SELECT o_orderkey AS id, o_custkey, o_orderstatus = 'F' AS closed, o_orderdate,
  count(*) OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus) AS nb,
  count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS nc FROM orders),
found AS (
  SELECT 'orphan_job_postings' AS code, id FROM p
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
  UNION ALL SELECT 'duplicate_base_hash', id FROM p WHERE nb > 1
  UNION ALL SELECT 'duplicate_content_hash', id FROM p WHERE nc > 1
  UNION ALL SELECT 'closed_without_status_log', id FROM p WHERE closed
    AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')
  UNION ALL SELECT 'stale_closed_status', id FROM p WHERE closed
    AND o_orderdate < TIMESTAMP '1998-09-01' - INTERVAL 720 HOUR)"""


@query("integrity_findings", FINDINGS_SQL + " SELECT code, id FROM found")
def integrity_findings(spark, sf):
    return audit_findings(spark, sf)


@query("integrity_audit", FINDINGS_SQL + """
SELECT code, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM found GROUP BY code""")
def integrity_audit(spark, sf):
    return audit.audit_summary(audit_findings(spark, sf))


@query("audit_report", FINDINGS_SQL + """
SELECT '' AS code, -1::BIGINT AS part, '{"healthy":' || CASE WHEN count(*) = 0 THEN 'true'
  ELSE 'false' END || ',"findings":' || count(DISTINCT code) || '}' AS line FROM found
UNION ALL SELECT code, id // 10000, '{"code":"' || code || '","count":' || count(*) || ',"ids":['
  || string_agg(id::VARCHAR, ',' ORDER BY id) || ']}' FROM found GROUP BY 1, 2""")
def audit_report(spark, sf):
    return audit.audit_report(audit_findings(spark, sf))


def run_log(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit(" Source-"), F.col("user_id").cast("string")).alias("scraper"),
        "ts", "event_id", F.col("value").alias("duration_seconds"),
        F.length("props").cast("bigint").alias("jobs_parsed"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("RuntimeError: "), "props"))
        .alias("error"),
    )


@query("source_health", """
SELECT 'source-' || user_id AS scraper, count(*) AS runs,
  count(*) FILTER (event_type <> 'error') AS successes,
  count(*) FILTER (event_type = 'error') AS failures,
  sum(length(props))::BIGINT AS jobs_parsed,
  sum(round(value * 1000000)::BIGINT)::BIGINT::DOUBLE / count(*) / 1000000
    AS average_duration_seconds,
  count(*) FILTER (event_type = 'error') / count(*) AS error_rate,
  'RuntimeError: ' || arg_max(props, event_id) FILTER (event_type = 'error') AS last_error,
  max(ts) AS last_run_at FROM events GROUP BY user_id""")
def source_health(spark, sf):
    good, _ = health.valid_runs(run_log(spark, sf))
    return health.source_health(good, ordinal="event_id")


@query("recent_errors", """
SELECT ts, event_id, 'source-' || user_id AS scraper, 'RuntimeError: ' || props AS error
FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def recent_errors(spark, sf):
    return health.recent_errors(run_log(spark, sf), ordinal="event_id")


def outcomes(spark, sf):
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.concat(F.lit("http://u"), user, F.lit(":secret@Proxy"), user, F.lit(".test:8080"))
        .alias("endpoint"),
        "ts", F.col("event_id").alias("ordinal"), "user_id",
        kind.isin("click", "view").alias("success"),
        F.when(kind == "error", 429).when(kind == "signup", 500).when(kind == "purchase", 403)
        .when(kind == "click", 200).alias("status"),
    )


@query("endpoint_health", """
SELECT 'http://proxy' || user_id || '.test:8080' AS proxy,
  count(*) FILTER (event_type IN ('click', 'view')) AS successes,
  count(*) FILTER (event_type NOT IN ('click', 'view')) AS failures,
  count(*) FILTER (event_type NOT IN ('click', 'view')) / count(*) AS failure_rate,
  CASE arg_max(event_type, event_id) WHEN 'error' THEN 429 WHEN 'signup' THEN 500
    WHEN 'purchase' THEN 403 WHEN 'click' THEN 200 END AS last_status
FROM events GROUP BY user_id""")
def endpoint_health(spark, sf):
    return health.endpoint_health(outcomes(spark, sf), ordinal="ordinal")


@query("endpoint_parse", """
SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL
  ELSE 'socks5://***@host' || s_suppkey || '.test:1080' END AS shown,
  CASE WHEN s_acctbal < 0 THEN NULL ELSE 'socks5://host' || s_suppkey || '.test:1080' END AS key
FROM supplier""")
def endpoint_parse(spark, sf):
    host = F.concat(F.lit("SOCKS5://me:pw@Host"), F.col("s_suppkey").cast("string"))
    address = F.concat(
        host, F.when(F.col("s_acctbal") < 0, F.lit(".test:70000")).otherwise(F.lit(".test:1080/"))
    )
    parts = endpoint(address)
    return table(spark, sf, "supplier").select(
        "s_suppkey", parts.shown.alias("shown"), parts.key.alias("key")
    )


STREAK_SQL = """
WITH o AS (SELECT event_id AS ordinal, user_id, epoch_us(ts) AS t_us, ts,
  event_type IN ('click', 'view') AS success,
  CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 500 WHEN 'purchase' THEN 403
    WHEN 'click' THEN 200 END AS status FROM events),
i AS (SELECT *, sum(success::INT) OVER (PARTITION BY user_id ORDER BY ts, ordinal) AS island
  FROM o),
s AS (SELECT *, sum((NOT success)::INT) OVER (PARTITION BY user_id, island ORDER BY ts, ordinal)
  AS streak FROM i),
c AS (SELECT *, CASE WHEN NOT success AND status IN (403, 429, 503) THEN t_us
    + (least(900, 30 * pow(2, streak - 1)) * 1000000)::BIGINT END AS until,
  CASE WHEN NOT success AND status IN (403, 429, 503) THEN streak >= 5 END AS gone FROM s),
r AS (SELECT user_id, ordinal, success, streak::BIGINT AS consecutive_failures,
  last_value(until IGNORE NULLS) OVER w AS cooldown_until,
  coalesce(last_value(gone IGNORE NULLS) OVER w, false) AS dead FROM c
  WINDOW w AS (PARTITION BY user_id, island ORDER BY ts, ordinal))"""


@query("failure_streaks", STREAK_SQL + """
SELECT user_id, ordinal, consecutive_failures, cooldown_until, dead FROM r""")
def failure_streaks(spark, sf):
    return health.failure_streaks(outcomes(spark, sf), keys=["user_id"]).select(
        "user_id", "ordinal", "consecutive_failures", "cooldown_until", "dead"
    )


@query("streaks_hot_key", STREAK_SQL.replace("user_id", "grp").replace("FROM events", "FROM (SELECT *, user_id % 2 AS grp FROM events)") + """
SELECT grp, ordinal, consecutive_failures, cooldown_until, dead FROM r""")
def streaks_hot_key(spark, sf):
    """Two endpoints share all outcomes, so both are cut into chunks."""
    rows = outcomes(spark, sf).withColumn("grp", F.col("user_id") % 2)
    return health.failure_streaks(rows, keys=["grp"], min_chunk_rows=2000).select(
        "grp", "ordinal", "consecutive_failures", "cooldown_until", "dead"
    )


@query("endpoint_state", STREAK_SQL + """
SELECT user_id, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures,
  arg_max(consecutive_failures, ordinal) AS consecutive_failures,
  arg_max_null(cooldown_until, ordinal) AS cooldown_until, arg_max(dead, ordinal) AS dead
FROM r GROUP BY user_id""")
def endpoint_state(spark, sf):
    rows = health.failure_streaks(outcomes(spark, sf), keys=["user_id"])
    return health.endpoint_state(rows, keys=["user_id"])


def captured(spark, sf):
    """Pages as a response log: status, type and body follow from the URL."""
    url = F.col("url")
    body = F.to_json(F.struct(F.col("url").alias("u"), F.col("page_id").alias("id")))
    return table(spark, sf, "pages").select(
        F.lit("p").alias("page_key"), F.col("page_id").alias("seq"),
        F.concat(F.lit("https://h.test/api/"), F.col("page_id").cast("string"),
                 F.lit("?Token=s%20x&team=a+b&empty")).alias("url"),
        F.when(url.contains("spam"), F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.lit("GET").alias("method"),
        F.when(url.startswith("https"), F.lit("xhr")).otherwise(F.lit("document"))
        .alias("resource_type"),
        F.when(url.endswith(".html"), F.lit("text/html")).otherwise(F.lit("Application/JSON"))
        .alias("content_type"),
        F.when(url.contains("utm_"), F.lit("not json")).otherwise(body).alias("body"),
    )


@query("response_filter", """
WITH k AS (SELECT page_id AS seq, 'https://h.test/api/' || page_id
    || '?Token=%5BREDACTED%5D&team=a+b&empty=' AS url,
  '{"id":' || page_id || ',"u":"' || url || '"}' AS body FROM pages
  WHERE url NOT LIKE '%spam%' AND url NOT LIKE '%utm\\_%' ESCAPE '\\')
SELECT seq, url, body, strlen(body)::BIGINT AS estimated_bytes,
  sha256('GET' || chr(0) || url || chr(0) || '200' || chr(0) || body) AS fingerprint FROM k""")
def response_filter(spark, sf):
    return responses.capture(captured(spark, sf)).select(
        "seq", "url", "body", "estimated_bytes", "fingerprint"
    )


@query("response_relevance", """
SELECT page_id AS seq, url NOT LIKE '%spam%' AND url LIKE 'https%' AND url NOT LIKE '%.html'
  AS relevant FROM pages""")
def response_relevance(spark, sf):
    rows = captured(spark, sf)
    plain = F.regexp_replace("url", "/api/", "/page/")
    return rows.select("seq", responses.is_relevant(
        plain, F.col("status"), F.col("resource_type"), F.col("content_type")
    ).alias("relevant"))


@query("bounded_retention", """
WITH n AS (SELECT user_id, event_id, row_number() OVER w AS n,
  sum(length(props) + user_id) OVER w AS b FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC))
SELECT user_id, event_id FROM n WHERE n <= 20 AND b <= 1000""")
def bounded_retention(spark, sf):
    rows = table(spark, sf, "events").select(
        "user_id", "event_id", (F.length("props") + F.col("user_id")).alias("size")
    )
    return responses.retained(
        rows, page=["user_id"], order="event_id", size="size", max_payloads=20, max_bytes=1000
    ).select("user_id", "event_id")


@query("long_retention", """
WITH n AS (SELECT event_type, event_id, row_number() OVER w AS n, sum(length(props)) OVER w AS b FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY event_id DESC))
SELECT event_type, event_id FROM n WHERE n <= 1500 AND b <= 20000""")
def long_retention(spark, sf):
    """A buffer of thousands of captures, over pages that hold a fifth of the rows each."""
    rows = table(spark, sf, "events").select("event_type", "event_id", F.length("props").alias("size"))
    return responses.retained(
        rows, page=["event_type"], order="event_id", size="size", max_payloads=1500, max_bytes=20_000, min_chunk_rows=1000
    ).select("event_type", "event_id")


@query("fingerprint_dedupe", """
SELECT user_id, sha256(event_type || chr(0) || props) AS fingerprint, min(event_id) AS event_id
FROM events GROUP BY 1, 2""")
def fingerprint_dedupe(spark, sf):
    rows = table(spark, sf, "events").select(
        "user_id", "event_id",
        F.sha2(F.concat_ws("\u0000", "event_type", "props"), 256).alias("fingerprint"),
    )
    return responses.fingerprint_dedupe(rows, page="user_id", order="event_id")


@query("page_cut", """
WITH l AS (SELECT l_orderkey AS run, l_linenumber AS page, row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity,
    l_extendedprice) AS ordinal, l_returnflag AS ident FROM lineitem),
g AS (SELECT run, page, string_agg(ident, ',' ORDER BY ordinal) AS sig FROM l
  WHERE page <= 6 GROUP BY 1, 2),
r AS (SELECT run, page, row_number() OVER (PARTITION BY run, sig ORDER BY page) AS k FROM g),
s AS (SELECT run, min(page) AS stop FROM r WHERE k > 1 GROUP BY run)
SELECT run, page, count(*) AS items FROM l LEFT JOIN s USING (run)
WHERE page <= 6 AND (stop IS NULL OR page < stop) GROUP BY 1, 2""")
def page_cut(spark, sf):
    lines = table(spark, sf, "lineitem")
    # one deal by run serves all windows, groups and joins below; an order has few lines, so no run is large
    parts = max(spark.sparkContext.defaultParallelism, lines.count() // ROWS_PER_PART)
    place = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        "l_partkey", "l_quantity", "l_extendedprice"
    )
    rows = lines.repartition(parts, "l_orderkey").select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("page"),
        F.row_number().over(place).alias("ordinal"), F.col("l_returnflag").alias("source_id"),
    )
    kept = responses.cut_repeated_pages(rows, max_pages=6)
    return kept.groupBy("run", "page").agg(F.count(F.lit(1)).alias("items"))
