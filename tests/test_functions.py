"""Golden values of hashes, URLs, cells and flags."""

import pytest
from pyspark.sql import functions as F

from rollcall.functions import hashing, text, urls
from rollcall.functions.cells import labels_only, link_target, split_cells
from rollcall.functions.envelopes import records_of
from rollcall.functions.times import zoned_time
from rollcall.operators import extract


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize("company, title, digest", [
    ("OpenAI", "Software Engineer Intern",
     "c7a98cc595edbe4e59da82f1c415936e31ec5707768837f8af210debeddd7dfd"),
    ("  ACME—CORP ", "software_engineer\tINTERN",
     "6169d605a8d3dd84dd45828c1c065a9df0af98c422af228bd897b7cc65deaf52"),
    ("Ａｃｍｅ Corp", "Software Engineer Intern",
     "6169d605a8d3dd84dd45828c1c065a9df0af98c422af228bd897b7cc65deaf52"),
])
def test_base_hash(spark, company, title, digest):
    row = spark.createDataFrame([(company, title)], "c string, t string")
    assert row.select(hashing.base_hash("c", "t")).first()[0] == digest


def test_content_hash(spark):
    want = "d7154bb120e28b95a147b2d69cbf34dc03f51223b3b97876cfa0dfa028e29baa"
    rows = spark.createDataFrame([
        ("a" * 64, "https://jobs.example.com/apply?id=42", "New York, NY", False),
        (" " + "A" * 64, " HTTPS://JOBS.EXAMPLE.COM/apply?id=42 ", " New York,\t NY ", False),
        ("a" * 64, "https://jobs.example.com/Apply?id=42", "New York, NY", False),
        ("a" * 64, "https://jobs.example.com/apply?id=42", "New York, NY", True),
        ("a" * 63, "https://jobs.example.com/apply?id=42", "New York, NY", True),
    ], "b string, u string, l string, c boolean")
    got = [r[0] for r in rows.select(hashing.content_hash("b", "u", "l", "c")).collect()]
    assert got[:2] == [want, want]
    assert want not in got[2:] and got[2] != got[3] and got[4] is None


@pytest.mark.parametrize("url, want", [
    ("HTTPS://U:P@Example.COM:0443/A?q=1#f", "https://U:P@example.com:443/A?q=1#f"),
    ("https://e.com/a|b", "https://e.com/a|b"),
    ("https://e.com/?#", "https://e.com/"),
    ("http://[::1]:80/x", "http://[::1]:80/x"),
    ("http://[::1/x", None),
    ("https://e.com:99999/", None),
    ("MAILTO:a@b", "mailto:a@b"),
])
def test_canonical_url(spark, url, want):
    assert value(spark, urls.canonical_url(F.lit(url))) == want


def test_redaction(spark):
    url = F.lit("https://shop.test/cart?api_key=k9&page=3")
    assert value(spark, urls.redact_query(url)) == "https://shop.test/cart?api_key=%5BREDACTED%5D&page=3"
    parts = urls.endpoint(F.lit("http://ann:pw1@relay.test:3128"))
    assert value(spark, parts.key) == "http://relay.test:3128"
    assert value(spark, parts.shown) == "http://***@relay.test:3128"
    assert value(spark, urls.endpoint(F.lit("gopher://relay.test:70")).key) is None


@pytest.mark.parametrize("flag, want", [
    ("true", True), ("1", True), ('"1"', True), ('" Closed "', True), ("2", False), ("0", False),
    ('""', False), ('"no"', False), (None, False), ("null", False), ('"later"', None),
])
def test_closed_flag(spark, flag, want):
    assert value(spark, text.closed_flag(F.lit(flag).cast("string"))) is want


def test_zoned_time(spark):
    assert value(spark, zoned_time(F.lit("2026-01-01T00:00:00"))) is None
    assert value(spark, zoned_time(F.lit("2026-01-01T00:00:00Z"))) is not None


def rows_of(spark, *lines, headers=None):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, content string")
    return [r[0] for r in extract.extract_rows(df, headers=headers).orderBy("i")
            .select("row").collect()]


def listing(company="Birch", title="Baker", place="Oslo", link="[go](https://birch.test/j)", more="today"):
    return f"| {company} | {title} | {place} | {link} | {more} |"


@pytest.mark.parametrize("line, want", [
    (listing("__Oak &lt;3__", "*Head `Baker`*", "Oslo<br/>Bergen"), ("Oak <3", "Head Baker", "Oslo; Bergen")),
    (listing("Elm \\| Sons"), ("Elm | Sons", "Baker", "Oslo")),
    (listing("[Fir](https://fir.test) AS"), ("Fir AS", "Baker", "Oslo")),
    (listing(place="Oslo • Voss<br>Moss"), ("Birch", "Baker", "Oslo; Voss; Moss")),
])
def test_visible_text(spark, line, want):
    row = rows_of(spark, line)[0]
    assert (row.company, row.title, row.location) == want and row.date_posted == "today"


@pytest.mark.parametrize("link, want", [
    ("[go](https://birch.test/p_(x)/y(z)q)", "https://birch.test/p_(x)/y(z)q"),
    ("[a](#top) and [b](HTTP://birch.test/b)", "HTTP://birch.test/b"),
    ("[![pic](p.png)](https://birch.test/c?d=1&amp;e=2)", "https://birch.test/c?d=1&e=2"),
    ("<a class=z href='https://birch.test/f'>f</a>", "https://birch.test/f"),
    ("see https://birch.test/(g)!", "https://birch.test/(g)"),
    ("[h](https://birch.test/h(", None), ("<a broken", None), ("none", None), ("[i](mailto:x@y.z)", None),
    ("x](https://birch.test/k) [l](n", "https://birch.test/k"), ("[l](n https://birch.test/m", None),
])
def test_targets(spark, link, want):
    assert link_target(link) == want


@pytest.mark.parametrize("line, closed", [
    (listing("Birch 🔒"), True), (listing(title="~~Baker~~"), True), (listing(more="<b>closed</b>"), True),
    (listing(), False), (listing("Closed Doors Ltd"), False),
    (listing(link="[go](https://birch.test/?s=closed&t=~~u~~)"), False),
])
def test_closed_rows(spark, line, closed):
    assert rows_of(spark, line)[0].is_closed is closed


def test_lines_that_are_no_listing(spark):
    assert rows_of(
        spark, "| Company | Role | Location | Link | Date |", "|:--|--:|---|---|---|", "A sentence.",
        listing(link="soon"), listing(link="[x](https://birch.test/(y"), "| " + "<t" * 9000,
    ) == [None] * 6


def test_other_columns(spark):
    row = rows_of(
        spark, "| Voss | Yew | Miller | https://yew.test/7 | - |",
        headers=["Location", "Employer", "Position", "Link", "Notes"],
    )[0]
    assert (row.company, row.title, row.location, row.apply_url) == (
        "Yew", "Miller", "Voss", "https://yew.test/7")
    assert split_cells("a sentence") == []


def test_labels():
    assert labels_only("a [b](c) d [e](f(g)h) i") == "a b d e i"
    assert labels_only("[b](c) [open](never") == "b [open](never"
    assert labels_only("no ] link ( here )") == "no ] link ( here )"


def test_envelopes():
    deep = "[" * 300 + '{"data": {"results": [{"a": 1.50, "jobs": 7}, 3, "s"]}}' + "]" * 300
    assert [r["record"] for r in records_of(deep)] == ['{"a": 1.50, "jobs": 7}']
    text = '[{"jobs": [{"x": "]}"}, {"y": {"jobs": []}}]}, {"\\u006aobs": {"z": 1}}, {"jobs": null, "data": [1]}]'
    assert [r["record"] for r in records_of(text)] == [
        '{"x": "]}"}', '{"y": {"jobs": []}}', '{"z": 1}', '{"jobs": null, "data": [1]}']
    assert [r["path"] for r in records_of(text)] == [[0, 0, 0], [0, 0, 1], [1, 0], [2]]
    assert records_of("5") == records_of('"jobs"') == records_of("[]") == []


def test_stored_url(spark):
    cases = [
        ("https://Bücher.example/a/../b c", "https://xn--bcher-kva.example/b%20c"), ("HTTPS://Jobs.test:443", "https://jobs.test/"),
        ("http://x.test:80/a/%2e%2E/b/.", "http://x.test/b/"), ("http://x.test/../..", "http://x.test/"),
        ("http://x.test/a/b/..", "http://x.test/a/"), ("http://x.test/a..b/.c/...", "http://x.test/a..b/.c/..."),
        ("https://x.test:8443/é?ü=1&b='#ß", "https://x.test:8443/%C3%A9?%C3%BC=1&b=%27#%C3%9F"),
        ("https://日本。example/", "https://xn--wgv71a.example/"), ("https://[::1]:443/x", "https://[::1]/x"),
        ("https://me:p w@x.test/?", "https://me:p%20w@x.test/?"), (" https://x.test/a%20b%zz ", "https://x.test/a%20b%zz"),
        ("https://x.test/😀" + "y" * 2000, "https://x.test/%F0%9F%98%80" + "y" * 2000), (None, None),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string")
    got = [r[0] for r in df.orderBy("i").select(urls.stored_url("u")).collect()]
    assert got == [w for _, w in cases]
