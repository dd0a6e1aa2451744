"""Canonical forms, hashes and row rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.catalog import query, table
from rollcall.functions import hashing, text, urls
from rollcall.functions.times import event_time
from rollcall.functions.validate import validate_rows
from rollcall.operators.health import is_transient

IDENTITY = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
PREFIXED = "length({0}) || ':' || {0}"


def _prefixed_sql(*fields: str) -> str:
    return "sha256(" + " || ".join(PREFIXED.format(f"({f})") for f in fields) + ")"


BRAND, NAME = IDENTITY.format("p_brand"), IDENTITY.format("p_name")


@query("base_hash", f"SELECT p_partkey, {_prefixed_sql(BRAND, NAME)} AS base_hash FROM part")
def base_hash(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", hashing.base_hash(F.concat(F.lit("  "), "p_brand", F.lit(" ")),
                                       F.upper("p_name")).alias("base_hash"),
    )


@query("identity_text", r"""
SELECT doc_id, trim(regexp_replace(replace(regexp_replace(replace(lower(nfc_normalize(text)),
  'ß', 'ss'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '_', ' '), '\s+', ' ', 'g')) AS identity
FROM documents""")
def identity(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.identity_text("text").alias("identity")
    )


@query("content_hash", f"""
SELECT page_id, {_prefixed_sql('sha256(page_id::VARCHAR)', 'url', "lower(split_part(url, '/', 3))",
                               "CASE WHEN url LIKE '%.html' THEN 'true' ELSE 'false' END")}
  AS content_hash FROM pages""")
def content_hash(spark, sf):
    rows = table(spark, sf, "pages").select(
        "page_id", "url", F.upper(F.sha2(F.col("page_id").cast("string"), 256)).alias("base"),
        F.concat(F.lit(" \t"), F.upper(F.split_part("url", F.lit("/"), F.lit(3)))).alias("place"),
        F.col("url").endswith(".html").alias("closed"),
    )
    return rows.select(
        "page_id", hashing.content_hash("base", "url", "place", "closed").alias("content_hash")
    )


@query("normalize_url", r"""
WITH p AS (SELECT page_id, split_part(url, '://', 1) AS s,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS h,
  regexp_extract(url, '^https?://[^/?#]+(.*)$', 1) AS rest FROM pages)
SELECT page_id, CASE s WHEN 'https' THEN 'https://User:Pw@' || h || ':443' || rest
  ELSE 'http://' || h || rest END AS url,
  CASE s WHEN 'https' THEN NULL ELSE 'http://' || h || '/a|b' END AS other FROM p""")
def normalize_url(spark, sf):
    part = "^(https?)://([^/?#]+)(.*)$"
    p = table(spark, sf, "pages").select(
        "page_id", *[F.regexp_extract("url", part, i).alias(n)
                     for i, n in ((1, "s"), (2, "h"), (3, "rest"))],
    )
    secure = F.col("s") == "https"
    messy = F.when(
        secure,
        F.concat(F.lit(" HTTPS://User:Pw@"), F.upper("h"), F.lit(":0443"), "rest"),
    ).otherwise(F.concat(F.lit("HTTP://"), F.upper("h"), F.lit(":"), "rest", F.lit("\t")))
    other = F.when(secure, F.concat(F.lit("https://"), "h", F.lit(":99999/x"))).otherwise(
        F.concat(F.lit("http://"), "h", F.lit("/a|b?#"))
    )
    return p.select(
        "page_id", urls.canonical_url(messy).alias("url"), urls.canonical_url(other).alias("other")
    )


@query("redact_url", r"""
SELECT page_id, regexp_replace(url, '(utm_source|page)=([^&#]*)', '\1=%5BREDACTED%5D', 'g')
  AS url FROM pages""")
def redact_url(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", urls.redact_query("url", ("UTM_source", "page")).alias("url")
    )


@query("domain_of", r"""
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS domain,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS bare FROM pages""")
def domain(spark, sf):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return table(spark, sf, "pages").select(
        "page_id", urls.domain_of("url").alias("domain"),
        urls.domain_of(F.concat(F.lit(" "), F.upper(host), F.lit(".:80"))).alias("bare"),
    )


@query("location_display", """
SELECT c_custkey, c_mktsegment || ' x; ' || c_name AS location,
  CASE WHEN c_acctbal < 0 THEN 'Unspecified' ELSE c_name END AS one FROM customer""")
def location(spark, sf):
    tabbed = F.concat(F.lit("  "), "c_mktsegment", F.lit(" \t x "))
    return table(spark, sf, "customer").select(
        "c_custkey",
        text.location_display(
            F.array(tabbed, F.lit(" "), F.col("c_name"), F.concat("c_mktsegment", F.lit(" x")))
        ).alias("location"),
        text.location_display(
            F.array(F.when(F.col("c_acctbal") < 0, F.lit(" ")).otherwise(F.col("c_name")))
        ).alias("one"),
    )


def _by_type(**values):
    out = None
    for kind, value in values.items():
        test = F.col("event_type") == kind
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out


@query("closed_flag", """
SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN true
  WHEN 'error' THEN false WHEN 'purchase' THEN false END AS closed FROM events""")
def closed_flag(spark, sf):
    value = _by_type(click="1", view='"  Yes "', error="2", signup='"maybe"', purchase="null")
    return table(spark, sf, "events").select(
        "event_id", text.closed_flag(value).alias("closed")
    )


@query("job_type_norm", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'new_grad' WHEN 'view' THEN 'internship'
  WHEN 'error' THEN 'new_grad' WHEN 'purchase' THEN 'full_time' ELSE 'internship' END AS job_type
FROM events""")
def job_type(spark, sf):
    value = _by_type(click="New-Grad", view=" intern ", error="NewGrad", signup="Internship",
                     purchase="full time")
    return table(spark, sf, "events").select("event_id", text.job_type(value).alias("job_type"))


@query("transient_status", """
WITH s AS (SELECT event_id, 400 + floor(value)::BIGINT % 130 AS status FROM events)
SELECT event_id, status, status IN (408, 425, 429, 500, 502, 503, 504) AS transient FROM s""")
def transient(spark, sf):
    status = (F.lit(400) + F.floor("value").cast("bigint") % 130).alias("status")
    return table(spark, sf, "events").select("event_id", status).withColumn(
        "transient", is_transient(F.col("status"))
    )


@query("event_time", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0
  THEN '' ELSE strftime(ts, '.%f') END || 'Z' AS at,
  strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS hour FROM events""")
def event_times(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", event_time("ts").alias("at"),
        event_time(F.date_trunc("hour", "ts")).alias("hour"),
    )


@query("validate_rows", """
SELECT c_custkey, array_to_string(list_filter([
  CASE WHEN c_nationkey = 0 THEN 'company_id must be positive' END,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'company_name length' END,
  CASE WHEN c_acctbal < 0 THEN 'title length' END,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'base_hash pattern' END,
  CASE WHEN c_acctbal > 9000 THEN 'apply_url must be http(s)' END,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'season out of range' END,
  CASE WHEN c_nationkey > 20 THEN 'job_type unknown' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM customer""")
def validate(spark, sf):
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    digest = F.sha2("c_name", 256)
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_nationkey").cast("bigint").alias("company_id"),
        F.when(segment == "HOUSEHOLD", F.lit("  ")).otherwise(F.col("c_name"))
        .alias("company_name"),
        F.when(balance < 0, F.lit("")).otherwise(segment).alias("title"),
        F.when(segment == "BUILDING", F.upper(F.concat(F.lit("A"), F.substring(digest, 2, 63))))
        .otherwise(digest).alias("base_hash"),
        digest.alias("content_hash"),
        F.when(balance > 9000, F.lit("ftp://x.test/"))
        .otherwise(F.concat(F.lit("https://x.test/"), F.col("c_custkey").cast("string")))
        .alias("apply_url"),
        segment.alias("location"),
        F.when(segment == "MACHINERY", F.lit(2025)).otherwise(F.lit(2026)).alias("season"),
        F.when(F.col("c_nationkey") > 20, F.lit("contract")).otherwise(F.lit(" New Grad"))
        .alias("job_type"),
        (balance > 0).alias("is_closed"),
    )
    good, bad = validate_rows(rows)
    none = F.lit("").alias("reasons")
    return good.select("c_custkey", none).unionByName(
        bad.select("c_custkey", F.array_join("reasons", ",").alias("reasons"))
    )


@query("stored_url", """
SELECT p_partkey, 'https://jobs.test/a/' || replace(p_name, ' ', '%20') || '/?q=%22' || p_partkey || '%20%C3%A9%27&r=%7E#x%20y' AS url
FROM part UNION ALL SELECT -p_partkey, 'http://xn--bcher-kva.test:8080/' || p_size FROM part""")
def stored_url(spark, sf):
    parts, key = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    plain = F.concat(F.lit("HTTPS://Jobs.Test:443/./a/b/%2E%2e/"), "p_name", F.lit('/?q="'), key, F.lit(" é'&r=%7E#x y"))
    foreign = F.concat(F.lit(" http://Bücher.test:8080/z/../"), F.col("p_size").cast("string"))
    return parts.select("p_partkey", urls.stored_url(plain).alias("url")).unionByName(
        parts.select((-F.col("p_partkey")).alias("p_partkey"), urls.stored_url(foreign).alias("url")))
