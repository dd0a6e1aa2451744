"""Captured documents built from the tables and read back by the sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.catalog import query, table
from rollcall.functions.text import location_display
from rollcall.plans import ingest
from rollcall.sources import commits, records


def text(name):
    return F.col(name).cast("string")


def json(**fields):
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def board_a_documents(spark, sf):
    good = json(
        id=F.col("p_partkey"),
        title=F.concat(F.lit("  "), F.col("p_name"), F.lit(" \t "), F.col("p_type")),
        absolute_url=F.concat(F.lit("https://b.test/"), text("p_partkey")),
        location=F.struct(F.col("p_brand").alias("name")),
        offices=F.array(
            F.struct(F.lit("Remote").alias("location")),
            F.struct(F.concat(F.lit(" "), "p_brand").alias("location")),
        ),
        updated_at=F.lit("2026-01-01"),
    )
    bad = json(id=F.col("p_partkey"), title=F.lit(7), absolute_url=F.lit("https://b.test/"))
    body = F.concat(F.lit('{"jobs":['), good, F.lit(","), bad, F.lit(',"malformed"]}'))
    return table(spark, sf, "part").select(
        F.concat(F.lit(" b"), text("p_size")).alias("board"), "p_partkey",
        F.when(F.col("p_size") == 1, F.lit('{"jobs":{}}')).otherwise(body).alias("body"),
    )


@query("board_json_a", """
SELECT 'greenhouse:b' || p_size || ':' || p_partkey AS source_id, 'b' || p_size AS company,
  p_name || ' ' || p_type AS title, 'https://b.test/' || p_partkey AS apply_url,
  p_brand || '; Remote' AS location, '{"id":' || p_partkey || ',"updated_at":"2026-01-01",'
  || '"requisition_id":null,"content":null,"metadata":null,"departments":null,"offices":'
  || '[{"location":"Remote"},{"location":" ' || p_brand || '"}]}' AS payload
FROM part WHERE p_size <> 1""")
def board_json_a(spark, sf):
    return records.board_a(board_a_documents(spark, sf)).rows.select(
        "source_id", "company", "title", "apply_url",
        location_display("location").alias("location"), "payload",
    )


@query("board_rejects", """
SELECT b.board, r.reason, count(*) AS n FROM (SELECT ' b' || p_size AS board, p_size FROM part) b,
  (VALUES ('title is missing'), ('not an object')) r(reason) WHERE p_size <> 1 GROUP BY 1, 2
UNION ALL SELECT ' b1', 'response is missing a jobs list', count(*) FROM part WHERE p_size = 1
HAVING count(*) > 0""")
def board_rejects(spark, sf):
    mapped = records.board_a(board_a_documents(spark, sf))
    refused = mapped.rejects.select("board", "reason").unionByName(mapped.failures)
    return refused.groupBy("board", "reason").agg(F.count(F.lit(1)).alias("n"))


def board_b_documents(spark, sf):
    good = json(
        id=F.concat(F.lit("s"), text("s_suppkey")),
        text=F.concat("s_name", F.lit("\n"), F.lit("Clerk")),
        applyUrl=F.when(F.col("s_acctbal") > 0, F.concat(F.lit("HTTPS://l.test/"),
                                                         text("s_suppkey"))),
        hostedUrl=F.concat(F.lit("https://h.test/"), text("s_suppkey")),
        categories=F.struct(
            F.lit("New York; Remote").alias("location"),
            F.array(F.lit("Remote"), F.concat(F.lit("N"), text("s_nationkey")))
            .alias("allLocations"),
        ),
        workplaceType=F.lit("hybrid"),
    )
    bad = F.concat(F.lit('{"id":"x","text":"y","applyUrl":"ftp://x"},null'))
    body = F.concat(F.lit("["), good, F.lit(","), bad, F.lit("]"))
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("site"), text("s_nationkey")).alias("site"), body.alias("body")
    )


@query("board_json_b", """
SELECT 's' || s_suppkey AS source_id, 'site' || s_nationkey AS company, s_name || ' Clerk' AS title,
  CASE WHEN s_acctbal > 0 THEN 'HTTPS://l.test/' ELSE 'https://h.test/' END || s_suppkey
    AS apply_url, 'New York; Remote; N' || s_nationkey || '; hybrid' AS location,
  'false' AS is_closed_json FROM supplier""")
def board_json_b(spark, sf):
    return records.board_b(board_b_documents(spark, sf)).rows.select(
        "source_id", "company", "title", "apply_url",
        location_display("location").alias("location"), "is_closed_json",
    )


def portal_documents(spark, sf):
    """Envelopes of three shapes around the same record, and a second, untitled record."""
    key = text("c_custkey")
    record = F.concat(
        F.lit('{"jobId":"'), key, F.lit('","job_title":"'), F.col("c_name"),
        F.lit('","job_path":"/en/jobs/'), key,
        F.lit('","location_name":"Seattle","locations":[{"city":"N'), text("c_nationkey"),
        F.lit('"},"Seattle"]}'),
    )
    other = F.concat(F.lit('{"jobId":"'), key, F.lit('","jobs":null}'))
    shape = (
        F.when(F.col("c_mktsegment") == "HOUSEHOLD",
               F.concat(F.lit('{"data":{"searchResults":['), record, F.lit(","), other,
                        F.lit("]}}")))
        .when(F.col("c_mktsegment") == "BUILDING",
              F.concat(F.lit("[["), record, F.lit(",5],"), other, F.lit("]")))
        .otherwise(F.concat(F.lit('{"jobs":[{"results":'), record, F.lit("},"), other,
                            F.lit("]}")))
    )
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"),
                                               shape.alias("body"))


def nested_documents(spark, sf):
    """Portal documents inside up to eight more lists, and some texts that are not JSON."""
    docs = portal_documents(spark, sf)
    depth = (F.col("doc") % 9).cast("int")
    body = F.concat(F.repeat(F.lit("["), depth), "body", F.repeat(F.lit("]"), depth))
    return docs.withColumn("body", F.when(F.col("doc") % 11 == 0, F.lit('{"jobs": [')).otherwise(body))


@query("flatten_envelope", """
SELECT c_custkey AS doc, 1::BIGINT AS place, 'record' AS kind, c_custkey::VARCHAR AS job_id,
  c_name AS title, 'N' || c_nationkey AS city, NULL::VARCHAR AS reason FROM customer
WHERE c_custkey % 11 <> 0
UNION ALL SELECT c_custkey, 2, 'untitled', c_custkey::VARCHAR, NULL, NULL, NULL FROM customer
WHERE c_custkey % 11 <> 0
UNION ALL SELECT c_custkey, 0, 'reject', NULL, NULL, NULL, 'not valid JSON' FROM customer
WHERE c_custkey % 11 = 0""")
def flatten_envelope(spark, sf):
    good, left = records.flatten_envelopes(nested_documents(spark, sf))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("path")).cast("bigint")
    none = F.lit(None).cast("string")

    def at(path):
        return F.try_variant_get("record", path, "string")

    return good.select(
        "doc", place.alias("place"),
        F.when(at("$.job_title").isNotNull(), "record").otherwise("untitled").alias("kind"),
        at("$.jobId").alias("job_id"), at("$.job_title").alias("title"),
        at("$.locations[0].city").alias("city"), none.alias("reason"),
    ).unionByName(left.select(
        "doc", F.lit(0).cast("bigint").alias("place"), F.lit("reject").alias("kind"),
        none.alias("job_id"), none.alias("title"), none.alias("city"), "reason",
    ))


@query("portal_json", """
SELECT c_custkey AS doc, 'amazon_jobs:' || c_custkey AS source_id, c_name AS title,
  'https://www.amazon.jobs/en/jobs/' || c_custkey AS apply_url,
  'Seattle; N' || c_nationkey AS location FROM customer""")
def portal_json(spark, sf):
    good, _ = records.flatten_envelopes(portal_documents(spark, sf))
    return records.portal(good, "amazon_jobs").rows.select(
        "doc", "source_id", "title", "apply_url", location_display("location").alias("location")
    )


@query("portal_json_b", """
SELECT p_partkey AS doc, CASE WHEN p_size > 25 THEN 'meta_careers:' || p_partkey
  ELSE 'https://www.metacareers.com/jobs/' || p_partkey END AS source_id,
  CASE WHEN p_size > 40 THEN 'Unspecified' ELSE p_brand END AS location FROM part""")
def portal_json_b(spark, sf):
    body = json(
        id=F.when(F.col("p_size") > 25, text("p_partkey")),
        name=F.col("p_name"),
        job_url=F.concat(F.lit("../jobs/./"), text("p_partkey")),
        locations=F.when(F.col("p_size") <= 40,
                         F.array(F.struct(F.col("p_brand").alias("display_name")))),
    )
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), body.alias("body"))
    good, _ = records.flatten_envelopes(parts)
    return records.portal(good, "meta_careers").rows.select(
        "doc", "source_id", location_display("location").alias("location")
    )


@query("card_project", """
SELECT p_partkey AS ordinal, p_name AS title, CASE WHEN p_size < 10
  THEN 'https://acme.test/job/' || p_partkey WHEN p_size < 20
  THEN 'https://acme.test/en/job/' || p_partkey WHEN p_size < 30
  THEN 'https://acme.test/job/' || p_partkey || '?q=1'
  ELSE 'https://other.test/' || p_partkey END AS apply_url,
  (p_type = 'ECONOMY')::VARCHAR AS is_closed_json FROM part""")
def card_project(spark, sf):
    key, size = text("p_partkey"), F.col("p_size")
    href = (
        F.when(size < 10, F.concat(F.lit("/job/"), key))
        .when(size < 20, F.concat(F.lit(" job/"), key))
        .when(size < 30, F.concat(F.lit("../job/"), key, F.lit("?q=1")))
        .otherwise(F.concat(F.lit("https://other.test/"), key))
    )
    shown = table(spark, sf, "part").select(
        F.lit(1).alias("page"), F.col("p_partkey").alias("ordinal"),
        F.concat(F.lit(" "), "p_name").alias("title"), F.col("p_brand").alias("location"),
        href.alias("href"),
        F.when(F.col("p_type") == "ECONOMY", F.lit(" Closed ")).otherwise(F.col("p_type"))
        .alias("status"),
    )
    mapped = records.cards(shown, careers_url="https://acme.test/en/jobs", company="Acme")
    return mapped.rows.select("ordinal", "title", "apply_url", "is_closed_json")


@query("endpoint_list", """
WITH r AS (SELECT n_nationkey AS doc, n_name, n_regionkey AS k FROM nation)
SELECT doc, endpoint, ordinal::INT AS ordinal FROM (
  SELECT doc, 'http://' || n_name || ':1' AS endpoint, CASE WHEN k = 0 THEN 1 ELSE 0 END AS ordinal
  FROM r UNION ALL SELECT doc, 'http://' || n_name || ':2', CASE WHEN k = 0 THEN 3 ELSE 1 END
  FROM r)""")
def endpoint_list(spark, sf):
    one = F.concat(F.lit("http://"), "n_name", F.lit(":1"))
    two = F.concat(F.lit("http://"), "n_name", F.lit(":2"))
    as_json = F.to_json(F.array(one, two, one))
    body = (
        F.when(F.col("n_regionkey") == 0,
               F.concat(F.lit(","), one, F.lit(" ,\n"), two, F.lit(","), one))
        .when(F.col("n_regionkey") == 1, as_json)
        .otherwise(F.concat(F.lit('{"proxies":'), as_json, F.lit("}")))
    )
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc"),
                                             body.alias("body"))
    return records.endpoint_list(rows)


def commit_documents(spark, sf, zone="Z", *more):
    """Commit details as JSON text, parsed with the schema of the source."""
    key = text("doc_id")
    files = F.array(
        F.struct(F.lit("src/a.py").alias("filename"), F.lit("modified").alias("status"),
                 F.col("text").alias("patch")),
        F.struct(F.lit("docs/Readme.MD").alias("filename"), F.lit("added").alias("status"),
                 F.col("text").alias("patch")),
        F.struct(F.concat("source", F.lit(".mdx")).alias("filename"),
                 F.lit("removed").alias("status"), F.lit(None).cast("string").alias("patch")),
    )
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int"))
    body = json(
        sha=F.sha2(key, 256),
        html_url=F.when(F.col("lang") != "de", F.concat(F.lit("https://git.test/"), key)),
        commit=F.struct(
            F.concat(F.lit("doc "), key).alias("message"),
            F.struct(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00" + zone)).alias("date"))
            .alias("author"),
        ),
        files=files,
    )
    parsed = F.from_json(body, schemas.COMMIT_DETAIL)
    rows = table(spark, sf, "documents").select(parsed.alias("d"), *more)
    return rows.select("d.*", *rows.columns[1:])


@query("commit_scan_filtered", """
SELECT sha256(doc_id::VARCHAR) AS sha, 'doc ' || doc_id AS message, lang AS ref,
  strftime(DATE '2024-01-01' + doc_id::INT, '%Y-%m-%d %H') AS hour FROM documents
WHERE lang = 'en' AND source = 'src3' AND doc_id >= 31 ORDER BY doc_id DESC LIMIT 100""")
def commit_scan_filtered(spark, sf):
    """Commits of one ref that touch one path since a time; their dates name no zone."""
    details = commit_documents(spark, sf, "", F.col("lang").alias("ref"))
    good, _ = commits.commit_feed(details)
    since = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
    chosen = commits.select_commits(good, ref="en", path="src3.mdx", details=details, since=since, per_page=100)
    utc = F.to_utc_timestamp("authored_at", F.current_timezone())
    return chosen.select("sha", "message", "ref", F.date_format(utc, "yyyy-MM-dd HH").alias("hour"))


@query("commit_scan", """
SELECT sha256(doc_id::VARCHAR) AS sha, 'doc ' || doc_id AS message,
  strftime(DATE '2024-01-01' + doc_id::INT, '%Y-%m-%d') AS day FROM documents WHERE lang <> 'de'""")
def commit_scan(spark, sf):
    good, _ = commits.commit_feed(commit_documents(spark, sf))
    return good.select("sha", "message", F.date_format("authored_at", "yyyy-MM-dd").alias("day"))


@query("commit_rejects", """
SELECT sha256(doc_id::VARCHAR) AS sha, 'html_url is missing' AS reason FROM documents
WHERE lang = 'de'""")
def commit_rejects(spark, sf):
    _, bad = commits.commit_feed(commit_documents(spark, sf))
    return bad.select("sha", "reason")


@query("commit_files", """
SELECT sha256(doc_id::VARCHAR) AS "commit", 0 AS file_ordinal, 'docs/Readme.MD' AS filename,
  0 AS additions, text AS patch FROM documents WHERE lang <> 'de'
UNION ALL SELECT sha256(doc_id::VARCHAR), 1, source || '.mdx', 0, NULL FROM documents
WHERE lang <> 'de'""")
def commit_files(spark, sf):
    good, _ = commits.commit_files(commit_documents(spark, sf))
    return good.select("commit", "file_ordinal", "filename", "additions", "patch")


@query("latest_commits", """
SELECT sha256(doc_id::VARCHAR) AS sha FROM documents WHERE lang <> 'de'
ORDER BY doc_id DESC LIMIT 10""")
def latest_commits(spark, sf):
    good, _ = commits.commit_feed(commit_documents(spark, sf))
    return commits.latest_commits(good, 10).select("sha")


@query("commit_page", """
SELECT sha256(doc_id::VARCHAR) AS sha FROM documents WHERE lang <> 'de'
  AND DATE '2024-01-01' + doc_id::INT >= DATE '2024-03-01' ORDER BY doc_id DESC
LIMIT 30 OFFSET 30""")
def commit_page(spark, sf):
    good, _ = commits.commit_feed(commit_documents(spark, sf))
    since = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    return commits.select_commits(good, since=since, page=2).select("sha")


@query("target_files", """
SELECT doc_id, source || '.md' AS filename FROM documents
WHERE source IN (SELECT source FROM documents WHERE lang = 'es')""")
def target_files(spark, sf):
    name = F.concat("source", F.lit(".md")).alias("filename")
    documents = table(spark, sf, "documents")
    return commits.only_target_files(
        documents.select("doc_id", name), documents.where("lang = 'es'").select(name)
    ).select("doc_id", "filename")


@query("file_text", """
SELECT doc_id::VARCHAR AS path, sha256(text) AS digest, NULL::VARCHAR AS reason FROM documents
  WHERE lang <> 'es'
UNION ALL SELECT doc_id::VARCHAR, NULL, 'unsupported file encoding' FROM documents
  WHERE lang = 'es'""")
def file_text(spark, sf):
    encoded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "(.{60})", "$1\n")
    documents = table(spark, sf, "documents").select(
        text("doc_id").alias("path"), F.lit("s").alias("sha"),
        F.when(F.col("lang") == "es", F.lit("none")).otherwise(F.lit("base64")).alias("encoding"),
        encoded.alias("content"),
    )
    good, bad = commits.file_texts(documents)
    return good.select(
        "path", F.sha2("text", 256).alias("digest"), F.lit(None).cast("string").alias("reason")
    ).unionByName(bad.select(
        "path", F.lit(None).cast("string").alias("digest"), "reason"
    ))


@query("board_ingest", """
WITH u AS (SELECT 0 AS r, 's' || s_suppkey AS source_id, s_nationkey::VARCHAR AS k FROM supplier
  UNION ALL SELECT 1, 'greenhouse:b' || p_size || ':' || p_partkey, p_size || p_name || p_type
  FROM part WHERE p_size <> 1),
f AS (SELECT source_id, r, count(*) OVER (PARTITION BY k) AS n FROM u WHERE r = 1)
SELECT (SELECT count(DISTINCT k) FROM u WHERE r = 1)
  + (SELECT count(*) FROM u WHERE r = 0) AS new_role,
  (SELECT count(*) FROM u WHERE r = 1) - (SELECT count(DISTINCT k) FROM u WHERE r = 1)
  AS duplicates, 2 * (SELECT count(*) FROM u) AS rejected""")
def board_ingest(spark, sf):
    result = ingest.board_ingest(
        [
            records.board_b(board_b_documents(spark, sf)),
            records.board_a(board_a_documents(spark, sf)),
        ],
        season=2027, job_type="Intern", order=("source_id", "ordinal"),
    )
    counts = result.classified.agg(F.count_if(F.col("state") == "NEW_ROLE").alias("new_role"))
    later = result.duplicates.agg(F.count(F.lit(1)).alias("n")).scalar()
    refused = result.rejected.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select("new_role", later.alias("duplicates"), refused.alias("rejected"))
