"""Operators against sequential models, with hot keys cut into chunks, and cases of their own."""

import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from rollcall.operators import audit, extract, health, listing, ordered, responses, snapshot
from rollcall.operators.classify import (
    check_namespace, check_ttl, classify, classify_batch, latest_state, merge_state, unexpired,
)
from rollcall.plans.store import KeyedTable
from rollcall.storage import work_path

LOG = "namespace string, base_hash string, content_hash string, is_closed boolean, " \
      "ts timestamp, ordinal bigint"
START = dt.datetime(2026, 1, 1)


def log(spark, rows):
    return spark.createDataFrame(
        [(n, k, c, x, START + dt.timedelta(seconds=s), i)
         for i, (n, k, c, x, s) in enumerate(rows)], LOG,
    )


def model(rows, ttl):
    known, out = {}, []
    for n, k, c, closed, s in rows:
        before = known.get((n, k))
        if before is None or s - before[1] >= ttl:
            out.append("NEW_ROLE")
        elif before[0] == c:
            out.append("NO_OP")
        else:
            out.append("ROLE_CLOSED" if closed else "ROLE_UPDATED")
        known[(n, k)] = (c, s)
    return out


def random_rows(seed, n=600):
    r = random.Random(seed)
    second, rows = 0, []
    for _ in range(n):
        second += r.choice([0, 0, 1, 3, 9])
        key = "hot" if r.random() < 0.5 else f"k{r.randrange(30)}"
        rows.append((r.choice("ab"), key, r.choice("xyz"), r.random() < 0.3, second))
    return rows


def states(df):
    return [r.state for r in df.orderBy("ordinal").select("state").collect()]


@pytest.mark.parametrize("chunk", [25, 10_000])
def test_classify_matches_the_sequential_rule(spark, chunk):
    rows = random_rows(7)
    got = states(classify(log(spark, rows), ttl_seconds=20, min_chunk_rows=chunk))
    assert got == model(rows, 20)


def test_incremental_equals_whole(spark):
    rows = random_rows(11, 400)
    whole, df = model(rows, 20), log(spark, rows)
    first, second = df.where("ordinal < 250"), df.where("ordinal >= 250")
    state = latest_state(first)
    assert states(classify_batch(state, second, ttl_seconds=20)) == whole[250:]
    merged = {tuple(r)[:3] for r in merge_state(state, second).collect()}
    assert merged == {tuple(r)[:3] for r in latest_state(df).collect()}


def test_expiry_is_inclusive_and_settings_are_checked(spark):
    rows = [("a", "k", "x", False, 0), ("a", "k", "x", False, 5), ("a", "k", "x", False, 9)]
    assert states(classify(log(spark, rows), ttl_seconds=5)) == ["NEW_ROLE", "NEW_ROLE", "NO_OP"]
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            check_ttl(bad)
    with pytest.raises(ValueError):
        check_namespace("a b")


def coalesce_model(lines):
    """Runs of one kind; in a run an opening line and all up to the next row end become one line."""
    out = []
    for _, run in itertools.groupby(lines, key=lambda line: line[1]):
        run = list(run)
        while run:
            first, last = run[0][2].lower(), 1
            if re.search("<t[rd]", first) and "</tr>" not in first:
                ends = [i for i, line in enumerate(run) if "</tr>" in line[2].lower()]
                if not ends:  # an open row stays as its lines
                    out += run
                    break
                last = ends[0] + 1
            out.append((*run[0][:2], "\n".join(line[2] for line in run[:last])))
            run = run[last:]
    return out


def test_coalesce_matches_the_sequential_rule(spark):
    r = random.Random(3)
    files, want = [], []
    for f in range(150):
        lines = [(i, r.choice(["added"] * 4 + ["removed"]),
                  r.choice(["<tr>", "<td>x", "y", "z</TR>", "</tr>", "<tr><td></tr>"]))
                 for i in range(r.randrange(1, 14))]
        files += [(f, *x) for x in lines]
        want += [(f, *x) for x in coalesce_model(lines)]
    df = spark.createDataFrame(files, "f int, line_no int, kind string, content string")
    arrays = df.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("line_no", "kind", "content"))).alias("lines"))
    arrays = arrays.unionAll(spark.createDataFrame(
        [(-1, None), (-2, [])], "f int, lines array<struct<line_no int, kind string, content string>>"))
    whole = extract.each_line(extract.join_rows(arrays, "lines"), "lines", ["f"])
    assert sorted(tuple(x) for x in whole.collect()) == sorted(want)
    assert "Exchange" not in extract.join_rows(df.select("f", F.array(F.struct("line_no", "kind", "content")).alias("lines")), "lines") \
        ._jdf.queryExecution().executedPlan().toString()


def test_a_long_file_is_joined_in_linear_time(spark):
    rows = [("\n".join(f"<tr>\n<td>{i}</td>\n</tr>" for i in range(30_000)),)]
    lines = extract.file_lines(spark.createDataFrame(rows, "text string"), joined=True)
    assert lines.count() == 30_000 and lines.where("line_no = 89997").first().content == "<tr>\n<td>29999</td>\n</tr>"


def test_diff_lines(spark):
    patch = "--- old.md\n+++ new.md\n@@ -3,2 +3,3 @@ head\n kept\n-gone\r\n+| a |\n+\n-\n+++two\n---three\n\\ No newline at end"
    df = spark.createDataFrame(
        [("README.md", patch), ("other.md", "+x"), ("docs/readme.MDX", None)],
        "filename string, patch string")
    rows = extract.diff_lines(df).orderBy("line_no").collect()
    assert [r.content for r in rows if r.kind == "added"] == ["| a |", "", "++two"]
    assert [r.content for r in rows if r.kind == "removed"] == ["gone", "", "--three"]


def test_continuation(spark):
    df = spark.createDataFrame(
        [(1, 0, "↳"), (1, 1, "Acme"), (1, 2, "↳"), (2, 5, "↳")], "f int, n int, company string")
    got = extract.fill_continuation(df, file=["f"], line="n").orderBy("f", "n").collect()
    assert [r.company for r in got] == [None, "Acme", "Acme", None]


def test_streaks_in_chunks(spark):
    r = random.Random(5)
    rows, want, streak = [], [], {}
    for i in range(500):
        key = "hot" if r.random() < 0.6 else f"e{r.randrange(9)}"
        ok, status = r.random() < 0.4, r.choice([403, 429, 500, None])
        n, until, dead = streak.get(key, (0, None, False))
        if ok:
            n, until, dead = 0, None, False
        else:
            n += 1
            if status in (403, 429, 503):
                until, dead = i + min(900, 30 * 2 ** (n - 1)), n >= 5
        streak[key] = (n, until, dead)
        want.append((n, until, dead))
        rows.append((key, START + dt.timedelta(seconds=i), i, ok, status))
    df = spark.createDataFrame(
        rows, "endpoint string, ts timestamp, ordinal bigint, success boolean, status int")
    got = health.failure_streaks(df, min_chunk_rows=20).orderBy("ordinal").collect()
    zero = int((START - dt.datetime(1970, 1, 1)).total_seconds())
    assert [
        (g.consecutive_failures,
         g.cooldown_until and g.cooldown_until // 1_000_000 - zero, g.dead) for g in got
    ] == want


@pytest.mark.parametrize("most", [3, 2000])
def test_retention(spark, most):
    sizes = [5, 1, 50, 2, 3, 4, 1]
    df = spark.createDataFrame([("p", i, s) for i, s in enumerate(sizes)],
                               "page_key string, seq bigint, estimated_bytes bigint")
    kept = responses.retained(df, max_payloads=most, max_bytes=9).collect()
    assert sorted(r.seq for r in kept) == ([4, 5, 6] if most == 3 else [4, 5, 6])
    large = df.withColumn("estimated_bytes", F.lit(10))
    assert responses.retained(large, max_payloads=most, max_bytes=9).count() == 0


def test_duplicate_identities_fail(spark):
    rows = spark.createDataFrame([("h", 1), ("h", 2)], "base_hash string, v int")
    with pytest.raises(Exception, match="each identity once"):
        snapshot.unique_rows(rows, "base_hash").collect()


def test_audit_and_pages(spark):
    posts = spark.createDataFrame(
        [(1, 1, "a", "x", True, START - dt.timedelta(days=60))],
        "id bigint, company_id bigint, base_hash string, content_hash string, "
        "is_closed boolean, updated_at timestamp")
    names = spark.createDataFrame([(1, "Acme")], "id bigint, name string")
    logs = spark.createDataFrame([], "job_id bigint")
    found = audit.findings(posts, names, logs, now=F.lit(START))
    assert sorted(r.code for r in found.collect()) == [
        "closed_without_status_log", "stale_closed_status"]
    healthy = audit.audit_report(found.where("false")).collect()
    assert [r.line for r in healthy] == ['{"healthy":true,"findings":0}']
    info = listing.page_info(spark.range(41), page=2).first()
    assert (info.total_pages, info.has_next, info.has_previous) == (3, True, True)
    empty = listing.page_info(spark.range(0)).first()
    assert (empty.total_pages, empty.has_next, empty.has_previous) == (0, False, False)


def test_hashes_are_compared_as_bytes_and_found_once(spark):
    hashes = ["00ab", "00ab", "00AB", "ab", "0ab", "", "", "zz", "zz", None, None, "0", "00"]
    posts = spark.createDataFrame(
        [(i, 1, h, None, False, START) for i, h in enumerate(hashes)],
        "id bigint, company_id bigint, base_hash string, content_hash string, is_closed boolean, updated_at timestamp")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    names = spark.createDataFrame([(1, "Acme")], "id bigint, name string")
    found = audit.findings(posts, names, spark.createDataFrame([], "job_id bigint"), now=F.lit(START))
    assert sorted(tuple(r) for r in found.collect()) == [("duplicate_base_hash", i) for i in (0, 1, 5, 6, 7, 8)]
    stored = posts.select(audit.short_hash("base_hash").alias("h")).distinct()
    assert {len(r.h) for r in stored.where("h IS NOT NULL").collect() if r.h[:1] == b"\x01"} == {1, 2, 3}
    lines = audit.audit_report(found.mapInArrow(counted, found.schema)).collect()
    assert sorted(r.line for r in lines) == [
        '{"code":"duplicate_base_hash","count":6,"ids":[0,1,5,6,7,8]}', '{"healthy":false,"findings":1}']
    assert seen.value == 6


def test_keyed_table_merges(spark):
    keyed = KeyedTable(spark, work_path(spark, "t"), "k STRING, v BIGINT", ["k"], merge_every=2)
    for n, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("c", 3)], [("b", 9)]]):
        keyed.write(n, spark.createDataFrame(rows, "k string, v bigint"))
    assert {tuple(r) for r in keyed.read().collect()} == {("a", 2), ("b", 9), ("c", 3)}
    assert {tuple(r) for r in keyed.read(before=2).collect()} == {("a", 2), ("b", 1)}
    only = spark.createDataFrame([("a",)], "k string")
    assert keyed.read(only=only).count() == 1


def test_merges_drop_expired_states(spark):
    rows = [("a", "x", START), ("b", "x", START + dt.timedelta(seconds=30)), ("c", "x", START + dt.timedelta(seconds=49))]
    schema = "base_hash string, content_hash string, last_seen timestamp"
    table = KeyedTable(spark, work_path(spark, "keyed"), schema, ["base_hash"], merge_every=1,
                       live=lambda t: unexpired(t, 10))
    table.write(0, spark.createDataFrame(rows, schema))
    assert sorted(r.base_hash for r in table.read().collect()) == ["b", "c"]


def test_chunks_are_even_at_one_time(spark):
    """A key with 70 % of the rows at one time, and a stray one long before, is cut into even parts in order."""
    rows = [(0, -10**9, 0)] + [(0, 5, i) for i in range(1, 7000)] + [(1 + i % 50, i, i) for i in range(3000)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, at long, n int")
    data = ordered.in_order(df, ["k"], [F.col("at"), F.col("n")], min_rows=500).rows
    sizes = {r["__chunk"]: r["count"] for r in data.where("k = 0").groupBy("__chunk").count().collect()}
    assert len(sizes) == 14 and max(sizes.values()) < 2 * 500 and sum(sizes.values()) == 7000
    ends = data.where("k = 0").groupBy("__chunk").agg(F.min(F.struct("at", "n")).alias("lo"), F.max(F.struct("at", "n")).alias("hi")) \
        .orderBy("__chunk").collect()
    assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(ends, ends[1:]))
    assert data.where("k > 0").select("__chunk").distinct().collect() == [(0,)]
    totals = ordered.with_running_sum(ordered.in_order(df, ["k"], [F.col("at"), F.col("n")], min_rows=500), {"c": F.lit(1)}).done()
    place = sorted((a, n) for k, a, n in rows if k == 0)
    got = {(r["at"], r["n"]): r["c"] for r in totals.where("k = 0").collect()}
    assert got == {p: i + 1 for i, p in enumerate(place)}


def test_chunks_of_empty_tables_and_null_keys(spark):
    empty = spark.createDataFrame([], "k int, at long")
    assert ordered.in_order(empty, ["k"], [F.col("at")], min_rows=1).done().collect() == []
    rows = spark.createDataFrame([(None, i if i else None) for i in range(100)], "k int, at long")
    data = ordered.with_running_sum(ordered.in_order(rows, ["k"], [F.col("at")], min_rows=10), {"c": F.lit(1)})
    assert data.rows.select("__chunk").distinct().count() == 10
    assert sorted((r["at"] or 0, r["c"]) for r in data.done().collect()) == [(i, i + 1) for i in range(100)]


def test_captured_documents_are_read_by_all_cores(spark):
    from rollcall.sources import records

    one = spark.range(0, 400, 1, 1)
    boards = one.selectExpr("'b' AS board", "'s' AS site", "concat('{\"jobs\":[{\"id\":', id, '}]}') AS body")
    records_in = one.selectExpr("id AS doc", "concat('{\"jobId\":\"', id, '\"}') AS body")
    found = [records.board_a(boards).rejects, records.board_b(boards).failures, records.flatten_envelopes(records_in)[0]]
    for rows in found:
        assert rows.rdd.getNumPartitions() > 1
        assert rows.count() == 400


def test_a_filter_does_not_repeat_what_is_worked_out_once(spark):
    from pyspark.sql import functions as F
    from rollcall.functions.text import once

    rows = once(spark.range(3).selectExpr("cast(id AS string) AS t"), code=F.sha2("t", 256)).where("code IS NOT NULL AND code <> ''")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    assert rows.count() == 3


def test_file_contents_are_decoded_once(spark):
    from rollcall.sources import commits

    rows = spark.createDataFrame(
        [("a", "s", "base64", "aGVs\r\nbG8=\n"), ("b", "s", "base64", "aG Vs*bG8="), ("c", "s", "none", "aGVsbG8="), ("d", "s", "base64", "a"),
         ("e", "s", "base64", None), ("f", "s", "base64", "/w==")],
        "path string, sha string, encoding string, content string")
    good, bad = commits.file_texts(rows)
    assert {r.path: r.text for r in good.collect()} == {"a": "hello", "b": "hello"}
    assert {r.path: r.reason for r in bad.collect()} == {
        "c": "unsupported file encoding", "d": "invalid file content", "e": "metadata is missing", "f": "invalid file content"}
    for side in (good, bad):
        assert side._jdf.queryExecution().optimizedPlan().toString().count("to_binary") <= 1


def test_observed_lines_are_stored_where_the_caller_says(spark):
    from rollcall.operators import extract
    from rollcall.plans.ingest import observe_lines

    names = []
    files = spark.sql("SELECT 'c' AS commit, 'u' AS html_url, TIMESTAMP'2024-01-01' AS authored_at, 0 AS file_ordinal, "
                      "'README.md' AS filename, '+| a | b |' AS patch")
    observe_lines(extract.diff_lines(files, joined=True), season=2026, job_type="internship", namespace="n",
                  materialize=lambda df, name: names.append(name) or df)
    assert names == ["extracted", "observations"]


def test_status_entries_are_checked_in_one_join(spark):
    """Accepted and refused entries come from one pass; the query sorts no entry twice."""
    from rollcall.catalog import snapshots

    plan = snapshots.log_transitions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan
    asked = spark.createDataFrame([(1, "OPEN", " CLOSED "), (1, "OPEN", "OPEN "), (2, "OPEN", ""), (3, None, "OPEN"), (None, None, "OPEN")],
                                  "job_id bigint, previous_state string, new_state string")
    known = spark.createDataFrame([(1,), (1,), (2,)], "id bigint")
    tagged = snapshot.checked_transitions(asked, known)
    assert sorted((r.job_id or 0, r.reason or "") for r in tagged.collect()) == [
        (0, "the listing does not exist"), (1, ""), (1, "a status log needs a transition"), (2, "new state must not be empty"),
        (3, "the listing does not exist")]
    good, bad = snapshot.log_transitions(asked, known)
    assert good.count() == 1 and bad.count() == 4
