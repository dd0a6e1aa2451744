"""Whole plans: the life of a listing over commits, boards and streamed batches."""

import datetime as dt
import json

from pyspark.sql import functions as F

from rollcall.operators.classify import latest_state, merge_state
from rollcall.plans import ingest
from rollcall.sources import records
from rollcall.storage import work_path
from rollcall.streaming.ingest import OBSERVED, Tables, ingest_batch

START = dt.datetime(2026, 1, 1)
ROW = "| Acme | Intern | {place} | [x](HTTPS://Jobs.test:443?a=B) | d |"


def commit(spark, n, patch):
    return spark.createDataFrame(
        [(f"c{n}", "https://git.test/c", START + dt.timedelta(days=n), 0, "README.md", patch)],
        "commit string, html_url string, authored_at timestamp, file_ordinal int, "
        "filename string, patch string",
    )


def test_commit_lifecycle(spark):
    here, there = ROW.format(place="Here"), ROW.format(place="There")
    patches = ["+" + here, "+" + here, f"-{here}\n+{there}", "-" + there]
    files = None
    for n, patch in enumerate(patches):
        part = commit(spark, n, patch)
        files = part if files is None else files.unionByName(part)
    result = ingest.commit_ingest(files, season=2026, job_type="internship")
    states = [r.state for r in result.classified.orderBy("commit").collect()]
    assert states == ["NEW_ROLE", "NO_OP", "ROLE_UPDATED", "ROLE_CLOSED"]
    final = ingest.to_persist(result).collect()
    assert len(final) == 1 and final[0].is_closed and final[0].location == "There"
    assert final[0].apply_url == "https://jobs.test/?a=B"
    assert result.rejected.count() == 0


def test_commit_rejects(spark):
    row = ROW.format(place="Here")
    result = ingest.commit_ingest(
        commit(spark, 1, f"+| half | a line\n+{row}\n+{row}"),
        season=2026, job_type="new_grad",
    )
    assert result.classified.count() == 1
    rejected = result.rejected.collect()
    assert [(r.content, r.reason) for r in rejected] == [
        ("| half | a line", "not a valid job row")]
    line = ingest.summary_text(result).first().line
    assert line == "NEW_ROLE=1 ROLE_UPDATED=0 ROLE_CLOSED=0 NO_OP=0 rejected=1"


def test_commits_against_a_state(spark):
    here, there = ROW.format(place="Here"), ROW.format(place="There")
    keys = {"keys": ["namespace", "base_hash"], "ts": "seen_at", "ordinal": "place"}
    first = ingest.commit_ingest(commit(spark, 0, "+" + here), season=2026, job_type="intern")
    state = latest_state(first.classified, **keys)
    second = ingest.commit_ingest(
        commit(spark, 1, "+" + there), season=2026, job_type="intern", state=state)
    assert [r.state for r in second.classified.collect()] == ["ROLE_UPDATED"]
    assert merge_state(state, second.classified, **keys).count() == 1


def board_of(*jobs):
    return json.dumps({"jobs": list(jobs)})


def board_job(number, title, **more):
    return {"id": number, "title": title, "absolute_url": f"https://fir.test/{number}"} | more


def test_boards_in_order(spark):
    a = spark.createDataFrame(
        [("fir", board_of(board_job(7, " Night\tMiller ", location={"name": "Voss"},
                                    offices=[{"location": {"name": "Oslo"}}, {"location": "Voss"}]),
                          board_job(8, ""), 12)),
         ("elm", '{"jobs": 3}')], "board string, body string")
    mapped = records.board_a(a)
    row = mapped.rows.first()
    assert (row.source_id, row.title) == ("greenhouse:fir:7", "Night Miller")
    assert row.location == ["Voss", "Oslo"]
    assert mapped.rejects.count() == 2 and mapped.failures.count() == 1
    other = [{"id": "q", "text": "Night Miller", "hostedUrl": "https://oak.test/q", "workplaceType": "on-site",
              "categories": {"location": "Moss;Voss", "allLocations": ["Voss", "Hamar"]}}]
    again = records.board_b(spark.createDataFrame([("fir", json.dumps(other))], "site string, body string"))
    assert again.rows.first().location == ["Moss", "Voss", "Hamar", "on-site"]
    result = ingest.board_ingest([mapped, again], season=2026, job_type="internship")
    assert [(r.source, r.state) for r in result.classified.collect()] == [("greenhouse", "NEW_ROLE")]
    assert [r.source for r in result.duplicates.collect()] == ["lever"]


def test_two_captures_of_a_board_keep_one_listing(spark):
    body = board_of(board_job(7, "Miller"))
    twice = spark.createDataFrame([("fir", body), ("fir", body)], "board string, body string")
    result = ingest.board_ingest([records.board_a(twice)], season=2026, job_type="internship")
    assert [r.state for r in result.classified.collect()] == ["NEW_ROLE"]
    assert result.duplicates.count() == 1


def test_refused_observations_leave_no_trace(spark):
    tables = Tables(spark, work_path(spark, "ingest"))
    rows = [("n", name, "t", h * 64, "1" * 64, "https://x.test/", "p", 2026, "new_grad", False, START, 0)
            for name, h in (("Fir", "a"), ("  ", "b"), (None, "c"), ("Elm", "X"))]
    rows.append(("n m", "Oak", "t", "d" * 64, "1" * 64, "https://x.test/", "p", 2026, "new_grad", False, START, 0))
    ingest_batch(tables, spark.createDataFrame(rows, OBSERVED), 0)
    assert tables.classified.read().count() == tables.postings.read().count() == tables.state.read().count() == 1
    assert sorted(r.reason.split()[0] for r in tables.rejects.read().collect()) == [
        "base_hash", "company", "company", "namespace"]


def test_batches_publish_after_commit_and_can_be_repeated(spark):
    tables = Tables(spark, work_path(spark, "ingest"), merge_every=2)

    def batch(n, *rows):
        data = [("n", "Acme", t, t * 64, c * 64, "https://x.test/", p, 2026, "new_grad", x,
                 START + dt.timedelta(days=n), i) for i, (t, c, p, x) in enumerate(rows)]
        ingest_batch(tables, spark.createDataFrame(data, OBSERVED), n)

    batch(0, ("a", "1", "Here", False), ("b", "1", "Here", False))
    batch(1, ("a", "2", "There", False))
    batch(2, ("a", "3", "There", True), ("b", "1", "Here", False))
    batch(2, ("a", "3", "There", True), ("b", "1", "Here", False))
    states = [r.state for r in tables.classified.read().orderBy("batch", "ordinal").collect()]
    assert states == ["NEW_ROLE", "NEW_ROLE", "ROLE_UPDATED", "ROLE_CLOSED", "NO_OP"]
    posts = {r.base_hash[0]: r for r in tables.postings.read().collect()}
    assert posts["a"].is_closed and not posts["b"].is_closed
    assert sorted(r.id for r in posts.values()) == [1, 2]
    assert tables.companies.read().count() == 1
    logs = tables.logs.read().orderBy("batch", "base_hash").collect()
    assert [(r.previous_state, r.new_state) for r in logs] == [
        (None, "OPEN"), (None, "OPEN"), ("OPEN", "CLOSED")]
    kinds = tables.outbox.read().groupBy("type").agg(F.count("*").alias("n")).collect()
    assert {r.type: r.n for r in kinds} == {"JOB_CREATED": 2, "JOB_UPDATED": 2}


def test_files_without_a_path_are_rejects(spark):
    files = spark.createDataFrame(
        [("o/r", path, "s", "| Acme | Intern | Here | [x](https://jobs.test/1) | d |") for path in ("a.md", " ", None)],
        "repository string, path string, sha string, text string")
    config = spark.createDataFrame([("o/r", "New Grad")], "repository string, job_type string")
    result = ingest.full_sync(files, config, season=2026)
    assert result.classified.count() == 1
    assert [r.reason for r in result.rejected.collect()] == ["file path is missing"] * 2


def test_lines_are_routed_once_and_accepted_text_is_not_stored(spark):
    """Both outcomes start from the stored lines: no window is left behind them, and only rejects keep their text."""
    from rollcall.operators import extract

    good, stored = ROW.format(place="Here"), {}
    lines = [good, "| ↳ | Cook | There | [x](https://jobs.test/2) | d |", "| half | a line", "prose", "",
             "| " + "x" * 501 + " | Clerk | Y | [x](https://jobs.test/3) | d |", "| ↳ | Maid | Z | [x](https://jobs.test/4) | d |"]
    first = commit(spark, 1, "\n".join("+" + x for x in lines))
    alone = commit(spark, 2, "+| ↳ | Lost | Z | [x](https://jobs.test/5) | d |")

    def store(df, name):
        stored[name] = ingest.written(df, name)
        return stored[name]

    read = extract.diff_lines(first.unionByName(alone), joined=True)
    seen, refused = ingest.observe_lines(read, season=2026, job_type="internship", namespace="n", materialize=store)
    for side in (seen, refused):
        assert "Window" not in side._jdf.queryExecution().optimizedPlan().toString()
    kept = stored["extracted"].collect()
    assert {r.title for r in kept if r.reason is None} == {"Intern", "Cook", "Maid"}
    assert all((r.content is None) == (r.reason is None) for r in kept) and len(kept) == 6
    old_good, old_bad = extract.route_rows(extract.extract_rows(read))
    assert sorted((r.commit, r.line_no, r.company) for r in kept if r.reason is None) == sorted(
        (r.commit, r.line_no, r.company) for r in old_good.select("commit", "line_no", "row.company").collect())
    assert sorted((r.commit, r.line_no, r.content, r.reason) for r in refused.collect()) == sorted(
        (r.commit, r.line_no, r.content, r.reason) for r in old_bad.collect())


def test_one_per_signature_is_both_steps(spark):
    from rollcall.operators import dedupe

    rows = spark.range(4000).select(
        F.when(F.col("id") % 97 > 0, (F.col("id") % 7).cast("string")).alias("commit"),
        (F.xxhash64("id") % 50).cast("string").alias("base_hash"),
        (F.xxhash64("id", F.lit(1)) % 4).cast("string").alias("content_hash"),
        F.when(F.xxhash64("id", F.lit(2)) % 5 == 0, "added").otherwise("removed").alias("kind"),
        (F.col("id") % 3).cast("int").alias("file_ordinal"), F.col("id").cast("int").alias("line_no"),
    ).withColumns({"is_removed": F.col("kind") == "removed",
                   "bad_line": F.when(F.col("line_no") % 11 == 0, F.struct("file_ordinal", "line_no"))})
    both = dedupe.signature_dedupe(dedupe.suppress_replaced(rows), scope=("commit", "bad_line"))
    once = dedupe.one_per_signature(rows, apart="bad_line")
    assert once._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(str, once.collect())) == sorted(map(str, both.collect()))


def test_files_of_one_repository_are_read_in_many_tasks(spark):
    """Files meet their configuration without a shuffle by repository, also where Spark broadcasts nothing by itself."""
    files = spark.range(40).select(
        F.when(F.col("id") >= 0, "o/r").alias("repository"), F.concat(F.col("id").cast("string"), F.lit(".md")).alias("path"),
        F.lit("s").alias("sha"), F.lit(ROW.format(place="Here")).alias("text"))
    config = spark.createDataFrame([("o/r", "intern")], "repository string, job_type string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = ingest.full_sync(files, config, season=2026, materialize=False)
        plan = done.rejected._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert done.classified.count() == 40
