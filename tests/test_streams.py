"""Streams that stop and start again give what the batch gives."""

import datetime as dt
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rollcall.catalog.changes import LOG, SIX_HOURS, observations
from rollcall.operators.classify import classify
from rollcall.storage import work_path
from rollcall.streaming import ingest as streaming_ingest
from rollcall.streaming.classify import classify_stream
from rollcall.streaming.ingest import OBSERVED, ingest_batch, ingest_commits_stream
from rollcall.streaming.run import file_stream

SF = "/root/testdata/sf0.001"


def test_a_stream_goes_on_where_it_stopped(spark):
    path, out = work_path(spark, "landing"), work_path(spark, "stream")
    rows = observations(spark, SF)
    schema = rows.schema
    ordered = rows.withColumn("part", F.ntile(3).over(Window.orderBy("ts", "event_id")))

    def run(checkpoint=None):
        query, result = classify_stream(
            file_stream(spark, path, schema), out, keys=["user_id"], content="event_type", closed="is_closed",
            ts="ts", ordinal="event_id", ttl_seconds=SIX_HOURS, checkpoint=checkpoint)
        query.awaitTermination()
        return result.read()

    for part in (1, 2, 3):
        ordered.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)
        got = run()
    want = classify(rows, ttl_seconds=SIX_HOURS, **LOG)
    assert {(r.event_id, r.state) for r in got.collect()} == {(r.event_id, r.state) for r in want.collect()}
    assert got.count() == want.count()
    assert run().count() == want.count()
    with pytest.raises(ValueError):
        run(checkpoint=work_path(spark, "fresh"))


ROW = "| Acme | {title} | {place} | [x](https://jobs.test/1) | d |"


def _capture(folder, name, day, *lines):
    """One captured commit of a README in a landing folder."""
    detail = {"sha": name, "html_url": "https://git.test/" + name,
              "commit": {"message": "m", "author": {"date": f"2026-01-{day:02}T00:00:00"}},
              "files": [{"filename": "README.md", "status": "modified", "patch": "\n".join(lines)}]}
    (folder / f"{name}.json").write_text(json.dumps(detail))


def test_captured_commits_to_events_over_restarts(spark, tmp_path, monkeypatch):
    out, here, there = work_path(spark, "ingest"), ROW.format(title="Cook", place="Here"), ROW.format(title="Cook", place="There")

    def run():
        query, tables = ingest_commits_stream(spark, str(tmp_path), out, season=2026, job_type="internship")
        query.awaitTermination()
        return tables

    _capture(tmp_path, "a", 1, "+" + here, "+| half | a line", "+" + ROW.format(title="x" * 501, place="Here"))
    (tmp_path / "broken.json").write_text("{ no json")
    (tmp_path / "stranger.json").write_text('{"sha": "s", "commit": {"message": "m"}}')
    tables = run()
    refused = {(r.cause, r.reason) for r in tables.committed(tables.refused).collect()}
    assert refused == {("line", "not a valid job row"), ("row", "title length"), ("file", "not a JSON document"),
                       ("document", "html_url is missing")}
    assert tables.state.read().count() == 1

    _capture(tmp_path, "b", 2, "-" + here, "+" + there)
    ingest, broken = streaming_ingest.change_events, []

    def fails(*args, **kwargs):
        broken.append(1)
        raise RuntimeError("lost before the events were published")

    monkeypatch.setattr(streaming_ingest, "change_events", fails)
    with pytest.raises(Exception):
        run()
    assert broken
    monkeypatch.setattr(streaming_ingest, "change_events", ingest)
    _capture(tmp_path, "c", 3, "-" + there)
    tables = run()
    states = [r.state for r in tables.committed(tables.classified).orderBy("ts").collect()]
    assert states == ["NEW_ROLE", "ROLE_UPDATED", "ROLE_CLOSED"]
    posting = tables.committed(tables.postings).first()
    assert posting.is_closed and posting.location == "There" and posting.apply_url == "https://jobs.test/1"
    kinds = [json.loads(r.message)["type"] for r in tables.committed(tables.outbox).orderBy("batch").collect()]
    assert kinds == ["JOB_CREATED", "JOB_UPDATED", "JOB_UPDATED"]
    assert run().outbox.read().count() == 3


def test_a_batch_is_seen_as_a_whole(spark):
    """Rows of a batch that broke off before its commit row are in the files, and are not shown."""
    tables = streaming_ingest.Tables(spark, work_path(spark, "ingest"))
    assert tables.committed(tables.postings).count() == 0
    rows = [("n", "Acme", "t", "a" * 64, "1" * 64, "https://x.test/", "p", 2026, "new_grad", False,
             dt.datetime(2026, 1, 1), 0)]
    ingest_batch(tables, spark.createDataFrame(rows, OBSERVED), 0)
    assert tables.committed(tables.postings).count() == 1
    more = tables.postings.read().drop("batch").withColumn("location", F.lit("q"))
    tables.postings.write(1, more)
    assert tables.postings.read().first().location == "q" and tables.committed(tables.postings).first().location == "p"


def test_contract_is_checked_before_the_state(spark):
    tables = streaming_ingest.Tables(spark, work_path(spark, "ingest"))
    good = ("n", "Acme", "t", "a" * 64, "1" * 64, "https://x.test/", "p", 2026, "new_grad", False, dt.datetime(2026, 1, 1), 0)
    bad = [(5, "mailto:x"), (6, ""), (7, 1999), (8, "chef"), (2, "x" * 501), (1, "y" * 256), (10, None)]
    rows = [good] + [tuple(v if j == i else x for j, x in enumerate(good)) for i, v in bad]
    ingest_batch(tables, spark.createDataFrame(rows, OBSERVED), 0)
    assert [r.state for r in tables.classified.read().collect()] == ["NEW_ROLE"]
    assert tables.rejects.read().count() == len(bad)
