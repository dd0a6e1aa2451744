"""Small operators: landing folders, look-ups, run rows, contracts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rollcall.functions import validate
from rollcall.functions.text import unescape_html
from rollcall.functions.times import utc_time
from rollcall.operators import events, health, listing
from rollcall.schemas import COMMIT_DETAIL
from rollcall.sources import commits, records
from rollcall.storage import work_path

START = dt.datetime(2026, 1, 1)


def test_landing_folder(spark):
    path = work_path(spark, "landing")
    texts = ['[{"sha": "a1", "n": 1},\n {"sha": "a2", "n": 2}]', '{"sha": "b1", "n": 3}', '{"sha": "c1", ']
    for text in texts:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").option("lineSep", "\n").text(path)
    for rows in (commits.read_documents(spark, path, "sha STRING, n INT"),):
        good, bad = commits.sound_documents(rows)
        assert sorted((r.sha, r.n) for r in good.collect()) == [("a1", 1), ("a2", 2), ("b1", 3)]
        found = bad.collect()
        assert len(found) == 1 and found[0].corrupt.startswith('{"sha": "c1"') and found[0].file.endswith(".txt")
    assert commits.read_documents(spark, path, "sha STRING, n INT", streaming=True).isStreaming


def test_sources_by_name(spark):
    docs = spark.createDataFrame([("fir", '{"jobs": []}')], "board string, body string")
    name = next(iter(records.REGISTRY))
    assert records.map_source(name, docs).rows.count() == 0
    records.register("mine", lambda df: records.board_a(df))
    try:
        assert records.map_source("mine", docs).failures.count() == 0
    finally:
        del records.REGISTRY["mine"]


def test_look_ups(spark):
    posts = spark.createDataFrame([(1, "ab"), (2, "cd")], "id bigint, base_hash string")
    assert [r.id for r in listing.by_base_hash(posts, " AB ").collect()] == [1]
    with pytest.raises(ValueError):
        listing.by_base_hash(posts, "  ")
    companies = spark.createDataFrame([(1, " Fir "), (2, "Elm")], "id bigint, name string")
    assert [r.id for r in listing.named(companies, "Fir").collect()] == [1]
    logs = spark.createDataFrame(
        [(3, 1, START), (2, 1, START), (1, 2, START), (4, 1, START - dt.timedelta(1))],
        "id bigint, job_id bigint, changed_at timestamp")
    assert [r.id for r in listing.status_history(logs).collect()] == [4, 2, 3, 1]
    assert [r.id for r in listing.status_history(logs, [2]).collect()] == [1]


def test_run_row(spark):
    end = F.lit(START + dt.timedelta(seconds=90))
    row = health.run_row(spark.range(7), "board", F.lit(START), end).first()
    assert (row.scraper, row.duration_seconds, row.jobs_parsed, row.error) == ("board", 90.0, 7, None)


def test_contract_columns(spark):
    rows = spark.createDataFrame([(1, 2)], "title int, surplus int")
    assert validate.unknown_columns(rows) == ["surplus"]
    with pytest.raises(ValueError):
        validate.validate_rows(rows, exact=True)


def test_character_references(spark):
    rows = spark.createDataFrame([("a &lt; b",), ("plain",), (None,)], "x string")
    assert [r[0] for r in rows.select(unescape_html("x")).collect()] == ["a < b", "plain", None]


def test_compact_text_equals_a_json_round_trip(spark):
    values = [
        {"type": "t", "job": {"id": 7, "b": [1.5, None, True, "x , y : {z}"]}, "a": "é \\ \" \\\" 漢字 😀"},
        {"z": 1, "a": {"y": [], "b": {}}, "s": "\\" * 3 + '"' * 3 + "\t\n end "}, [], "plain \" text ", 12,
        {"long": "word \\ \" " * 20_000},
    ]
    texts = [json.dumps(v, ensure_ascii=False, indent=k, separators=(" ,\t", " :\r\n ")) for v in values for k in (None, 2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    got = [r[0] for r in df.orderBy("i").select(events.compact_json("value")).collect()]
    assert got == [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in values for _ in (None, 2)]


def test_times_without_a_zone_are_utc(spark):
    rows = [("2026-03-01T10:00:00Z", 36000), ("2026-03-01T10:00:00", 36000), ("2026-03-01 10:00", 36000), ("2026-03-01", 0),
            ("2026-03-01T10:00:00.5+02:00", 28800), ("2026-03-01T25:00:00", None), ("soon", None), (None, None)]
    day = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc).timestamp()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [r[0] for r in df.orderBy("i").select(F.floor(F.unix_micros(utc_time("t")) / 1_000_000)).collect()]
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == [None if s is None else day + s for _, s in rows]


def test_commits_of_one_path_and_ref(spark):
    schema = COMMIT_DETAIL + ", ref STRING"
    detail = lambda sha, ref, *names: (sha, "https://git.test/" + sha, ("m", ("2026-01-01T00:00:00",)),
                                       [(n, "modified", 1, 0, 1, None) for n in names], ref)
    docs = spark.createDataFrame([detail("a", "main", "docs/x.md", "y.md"), detail("b", "main", "docs"), detail("c", "dev", "docs/z/q.md"),
                                  detail("d", "main", "docsy/x.md"), detail("e", "main")], schema)
    good, bad = commits.commit_feed(docs)
    pick = lambda **how: [r.sha for r in commits.select_commits(good, **how).collect()]
    assert pick(path="docs/", details=docs) == ["c", "b", "a"] and pick(path="docs", ref="main", details=docs) == ["b", "a"]
    assert pick(ref="dev") == ["c"] and pick(path="none", details=docs) == [] and bad.count() == 0
    with pytest.raises(ValueError):
        pick(path="docs")
