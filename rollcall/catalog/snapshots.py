"""Upserts, status history and change events."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.catalog import query, table
from rollcall.operators import events, snapshot

NOW = "2030-01-01 00:00:00"
CUT = "1998-01-01"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("upsert_company", """
WITH old AS (SELECT s_suppkey + 1 AS id, s_name AS name,
  CASE WHEN s_acctbal > 0 THEN 'old' || s_suppkey || '.example' END AS domain FROM supplier),
inc AS (SELECT s_name AS name, CASE WHEN s_acctbal > 5000 OR s_acctbal < -500
    THEN 'shop' || s_suppkey || '.example' END AS domain FROM supplier
  UNION ALL SELECT c_name, CASE WHEN c_acctbal > 0 THEN 'c' || c_custkey || '.example' END
  FROM customer),
new AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY sha256(name)) AS id,
  name, domain FROM inc WHERE name NOT IN (SELECT name FROM old))
SELECT id, old.name AS name, coalesce(inc.domain, old.domain) AS domain
FROM old JOIN inc ON old.name = inc.name UNION ALL SELECT id, name, domain FROM new""")
def upsert_company(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    key = F.col("s_suppkey").cast("string")
    old = s.select(
        (F.col("s_suppkey") + 1).alias("id"), F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("old"), key, F.lit(".example")))
        .alias("domain"),
        now().alias("created_at"),
    )
    moved = (F.col("s_acctbal") > 5000) | (F.col("s_acctbal") < -500)
    first = s.select(
        F.concat(F.lit("  "), "s_name", F.lit("\t")).alias("name"),
        F.when(moved, F.concat(F.lit(" Shop"), key, F.lit(".Example "))).alias("domain"),
        F.lit(1).alias("ordinal"),
    )
    second = c.select(
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0,
               F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit(".example")))
        .alias("domain"),
        F.lit(2).alias("ordinal"),
    )
    good, _ = snapshot.clean_companies(first.unionByName(second))
    return snapshot.upsert_companies(old, good, now=now()).select("id", "name", "domain")


def listings(spark, sf):
    """Orders as listings: closed when finished, content by status and price in cents."""
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1).alias("id"),
        F.sha2(key, 256).alias("base_hash"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderpriority").alias("title"),
        F.sha2(F.col("o_orderstatus"), 256).alias("content_hash"),
        F.concat(F.lit("https://shop.example/"), key).alias("apply_url"),
        F.col("o_orderpriority").alias("location"),
        F.year("o_orderdate").alias("season"),
        F.col("o_orderstatus").alias("job_type"),
        (F.col("o_orderstatus") == "F").alias("is_closed"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def observed(rows):
    """The same listings seen later: some moved, some closed."""
    return rows.withColumns({
        "location": F.when(F.col("title") == "1-URGENT", F.lit("Express"))
        .otherwise(F.col("location")),
        "is_closed": F.col("is_closed") | (F.col("title") == "2-HIGH"),
    }).drop("id", "created_at", "updated_at")


def posting_upsert(spark, sf, *, numbered: bool = True):
    rows = listings(spark, sf)
    old = rows.where(F.col("created_at") < F.lit(CUT).cast("timestamp_ntz"))
    return snapshot.upsert(
        old, observed(rows), now=now(), id_column="id" if numbered else None
    )


DIFF_SQL = """
WITH l AS (SELECT o_orderkey + 1 AS id, sha256(o_orderkey::VARCHAR) AS base_hash,
  o_custkey AS company_id, o_orderpriority AS title, sha256(o_orderstatus) AS content_hash,
  'https://shop.example/' || o_orderkey AS apply_url, o_orderpriority AS location,
  year(o_orderdate)::INT AS season, o_orderstatus AS job_type, o_orderstatus = 'F' AS is_closed,
  o_orderdate, o_orderdate < TIMESTAMP '1998-01-01' AS known FROM orders),
i AS (SELECT * REPLACE (CASE title WHEN '1-URGENT' THEN 'Express' ELSE location END AS location,
  is_closed OR title = '2-HIGH' AS is_closed), is_closed AS old_closed FROM l),
d AS (SELECT * REPLACE (CASE WHEN known THEN id ELSE (SELECT max(id) FROM l WHERE known)
    + row_number() OVER (PARTITION BY known ORDER BY sha256(base_hash)) END AS id),
  NOT known AS was_created,
  known AND (title = '1-URGENT' OR is_closed <> old_closed) AS was_changed FROM i),
r AS (SELECT *, CASE WHEN known THEN o_orderdate ELSE TIMESTAMP '2030-01-01' END AS created_at,
  CASE WHEN was_created OR was_changed THEN TIMESTAMP '2030-01-01' ELSE o_orderdate END
    AS updated_at FROM d)"""


@query("upsert_postings", DIFF_SQL + """
SELECT id, base_hash, company_id, location, season, is_closed, created_at, updated_at,
  was_created, was_changed FROM r""")
def upsert_postings(spark, sf):
    return posting_upsert(spark, sf).diff.select(
        "id", "base_hash", "company_id", "location", "season", "is_closed", "created_at",
        "updated_at", "was_created", "was_changed",
    )


@query("status_transitions", DIFF_SQL + """
, t AS (SELECT base_hash, CASE WHEN known THEN CASE WHEN old_closed THEN 'CLOSED' ELSE 'OPEN' END
  END AS previous_state, CASE WHEN is_closed THEN 'CLOSED' ELSE 'OPEN' END AS new_state FROM r)
SELECT * FROM t WHERE previous_state IS DISTINCT FROM new_state""")
def status_transitions(spark, sf):
    result = posting_upsert(spark, sf, numbered=False)
    return snapshot.status_transitions(result, now=now()).drop("changed_at")


EVENT_COLUMNS = """CASE WHEN was_created THEN 'JOB_CREATED' ELSE 'JOB_UPDATED' END AS type,
  '2030-01-01T00:00:00Z' AS occurred_at"""


@query("change_events", DIFF_SQL + f"""
SELECT 1 AS version, {EVENT_COLUMNS}, id, base_hash, company_id, title, content_hash, apply_url,
  location, season, job_type, is_closed FROM r WHERE was_created OR was_changed""")
def change_events(spark, sf):
    return events.change_events(posting_upsert(spark, sf), occurred_at=now())


@query("event_messages", DIFF_SQL + f"""
, e AS (SELECT *, {EVENT_COLUMNS} FROM r WHERE was_created OR was_changed)
SELECT '{{"job":{{"apply_url":"' || apply_url || '","base_hash":"' || base_hash
  || '","company_id":' || company_id || ',"content_hash":"' || content_hash || '","id":' || id
  || ',"is_closed":' || is_closed::VARCHAR || ',"job_type":"' || job_type || '","location":"'
  || location || '","season":' || season || ',"title":"' || title || '"}},"occurred_at":"'
  || occurred_at || '","type":"' || type || '","version":1}}' AS message FROM e""")
def event_messages(spark, sf):
    rows = events.change_events(posting_upsert(spark, sf), occurred_at=now())
    return events.event_message(rows).select("message")


@query("upsert_one", DIFF_SQL + """
, one AS (SELECT max(base_hash) AS b FROM l WHERE known)
SELECT l.base_hash AS base_hash, l.base_hash = b AS was_incoming,
  CASE WHEN l.base_hash = b THEN 'Moved' ELSE location END AS location
FROM l, one WHERE known""")
def upsert_one(spark, sf):
    rows = listings(spark, sf)
    old = rows.where(F.col("created_at") < F.lit(CUT).cast("timestamp_ntz"))
    one = old.orderBy(F.desc("base_hash")).limit(1).withColumn("location", F.lit("Moved"))
    result = snapshot.upsert_one(old, one.drop("id", "created_at", "updated_at"), now=now())
    return result.diff.select("base_hash", "was_incoming", "location")


@query("company_lookup", """
SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey + 1 END AS company_id,
  CASE WHEN c_acctbal < 0 THEN 'a listing needs a known company' END AS reason
FROM orders JOIN customer ON o_custkey = c_custkey""")
def company_lookup(spark, sf):
    name = F.format_string("  Customer#%09d ", "o_custkey")
    jobs = table(spark, sf, "orders").select(
        "o_orderkey", name.alias("company_name"), F.lit(None).cast("bigint").alias("company_id")
    )
    known = table(spark, sf, "customer").where("c_acctbal >= 0").select(
        (F.col("c_custkey") + 1).alias("id"), F.col("c_name").alias("name")
    )
    good, bad = snapshot.with_company_ids(jobs, known)
    none = F.lit(None).cast("string").alias("reason")
    return good.select("o_orderkey", "company_id", none).unionByName(
        bad.select("o_orderkey", "company_id", "reason")
    )


@query("log_transitions", """
WITH r AS (SELECT l_orderkey AS job_id, l_linenumber, l_partkey, trim(l_returnflag) AS p,
  CASE WHEN l_tax = 0 THEN '' WHEN l_linestatus = 'F' THEN 'N' ELSE 'A' END AS n FROM lineitem)
SELECT job_id, l_linenumber, l_partkey, CASE WHEN n = '' THEN 'new state must not be empty'
  WHEN p = n THEN 'a status log needs a transition'
  WHEN job_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
  THEN 'the listing does not exist' END AS reason FROM r""")
def log_transitions(spark, sf):
    requests = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_partkey",
        F.concat(F.lit(" "), "l_returnflag").alias("previous_state"),
        F.when(F.col("l_tax") == 0, F.lit("  ")).when(F.col("l_linestatus") == "F", F.lit("N "))
        .otherwise(F.lit("A")).alias("new_state"),
    )
    known = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("id")
    )
    return snapshot.checked_transitions(requests, known).select("job_id", "l_linenumber", "l_partkey", "reason")


def messages(spark, sf):
    return messages_of(table(spark, sf, "events"))


def messages_of(rows):
    """Event messages with defects that follow from the event type and value."""
    kind, value = F.col("event_type"), F.col("value")
    key = F.col("event_id").cast("string")
    text = F.concat(
        F.lit('{"version":'), F.when(value > 80, F.lit("2")).otherwise(F.lit("1")),
        F.lit(',"type":"'),
        F.when(kind == "signup", F.lit("JOB_GONE")).when(kind == "click", F.lit("JOB_CREATED"))
        .otherwise(F.lit("JOB_UPDATED")),
        F.lit('","occurred_at":"2024-01-01T00:00:00'),
        F.when(kind == "error", F.lit("")).otherwise(F.lit("Z")),
        F.lit('","job":{"id":'), key, F.lit(',"base_hash":"'), F.sha2(key, 256), F.lit('"}'),
        F.when(kind == "purchase", F.lit(',"extra":1}')).otherwise(F.lit("}")),
    )
    broken = F.when(value < 3, F.substring(text, 1, 40)).otherwise(text)
    return rows.select("event_id", broken.alias("value"))


@query("event_validate", """
SELECT event_id, CASE WHEN value < 3 THEN 'not JSON'
  WHEN event_type = 'purchase' THEN 'unexpected or missing fields'
  WHEN value > 80 THEN 'unknown version' WHEN event_type = 'signup' THEN 'unknown type'
  WHEN event_type = 'error' THEN 'occurred_at needs a zone'
  WHEN event_id = 0 THEN 'job id must be positive' END AS reason FROM events""")
def event_validate(spark, sf):
    return events.read_events(messages(spark, sf)).select("event_id", "reason")


DATA_SQL = """
  '{"version":' || CASE WHEN value > 80 THEN '2' ELSE '1' END || ',"type":"' || CASE event_type WHEN 'signup' THEN 'JOB_GONE'
  WHEN 'click' THEN 'JOB_CREATED' ELSE 'JOB_UPDATED' END || '","occurred_at":"2024-01-01T00:00:00'
  || CASE event_type WHEN 'error' THEN '' ELSE 'Z' END || '","job":{"id":' || event_id || ',"base_hash":"'
  || sha256(event_id::VARCHAR) || '"}' || CASE event_type WHEN 'purchase' THEN ',"extra":1}' ELSE '}' END"""
FRAMES_SQL = """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'JOB_GONE' WHEN 'click' THEN 'JOB_CREATED'
  ELSE 'JOB_UPDATED' END AS event, event_id::VARCHAR AS id, """ + DATA_SQL + """ AS data FROM events WHERE value >= 3"""


@query("sse_frames", FRAMES_SQL)
def sse_frames(spark, sf):
    return events.feed_frames(messages(spark, sf)).select("event_id", "event", "id", "data")


@query("frame_text", """
WITH d AS (SELECT doc_id, '"' || replace(replace(replace(text, chr(92), repeat(chr(92), 2)), '"', chr(92) || '"'),
  chr(10), chr(92) || 'n') || '"' AS note FROM documents)
SELECT doc_id, '{"type":"JOB_CREATED","note":' || note || ',"a":[1.50,true,"x : y"],"job":{"id":' || doc_id || '}}' AS data
FROM d""")
def frame_text(spark, sf):
    """White space goes between tokens only; keys keep their order and texts their blanks, quotes and backslashes."""
    note = F.col("text")
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        note = F.replace(note, F.lit(old), F.lit(new))
    rows = table(spark, sf, "documents").select("doc_id", F.concat(
        F.lit('\t{ "type" : "JOB_CREATED",\r\n"note" : "'), note, F.lit('" , "a": [ 1.50 ,true,\n"x : y" ], "job" : {"id" : '),
        F.col("doc_id").cast("string"), F.lit(" } }\n")).alias("value"))
    return events.feed_frames(rows).select("doc_id", "data")

