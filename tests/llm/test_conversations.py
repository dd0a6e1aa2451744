import hashlib
import itertools
import re
import zlib

from hypothesis import given, settings, strategies as st

from rollcall.llm import conversations as cv
from rollcall.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

RIGHT = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(initials, faults):
    """(cost, audit) over all edits with at most two insertions in a gap."""
    best = None
    choices = [["D"] + (["K", "Ru", "Ra"] if f in (cv.FINE, cv.CUT) else []) for f in faults]
    gaps = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*choices):
        for added in itertools.product(gaps, repeat=len(edits) + 1):
            audit, made, cost = "I" * len(added[0]), added[0], 3 * len(added[0])
            for edit, x, f, extra in zip(edits, initials, faults, added[1:]):
                audit += edit[0] + "I" * len(extra)
                made += ("" if edit == "D" else x if edit == "K" else edit[1]) + extra
                cost += {"D": 4, "K": 0, "R": 3}[edit[0]] + (3 if f == cv.CUT and edit != "D" else 0) + 3 * len(extra)
            if RIGHT.fullmatch(made) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=3))
def test_cheapest_equals_all_edits(rows):
    initials, faults = [r[0] for r in rows], [r[1] for r in rows]
    if "" in initials:  # an empty role can only be changed or deleted, as an unknown one
        assert cv.cheapest(initials, faults) == brute([x or "x" for x in initials], faults)
    else:
        assert cv.cheapest(initials, faults) == brute(initials, faults)


def test_windows_change_nothing(monkeypatch):
    import random

    draw = random.Random(1)
    for _ in range(60):
        n = draw.randrange(1, 90)
        rows = [draw.choice("suax") for _ in range(n)], [draw.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        monkeypatch.setattr(cv, "WINDOW", 1000)
        whole = cv.cheapest(*rows)
        for w in (1, 2, 7, 64):
            monkeypatch.setattr(cv, "WINDOW", w)
            assert cv.cheapest(*rows) == whole


def test_long_conversation_is_linear():
    cost, audit = cv.cheapest(list("ua" * 50_000), [0, 0, 0, 2] * 25_000)
    assert cost == 75_000 and audit == "K" * 100_000


def test_query_equals_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        where = f"/root/testdata/{sf}"
        assert compare(spark, connect(where), QUERIES["op12_conversations"], SQL["op12_conversations"], where)[0] == ""


def rows_with(spark, rows):
    values = [(*r, 1, "x", "y") for r in rows]
    return spark.createDataFrame(values, SCHEMA + ", fault int, audit string, digest string")


def kind(conv, turn):
    f = lambda v: " " if v is None else str(v)
    return zlib.crc32(f"{f(conv)}:{f(turn)}".encode()) % 20


def free(conv, kinds):
    """Turns whose damage is of these kinds."""
    return (t for t in itertools.count() if kind(conv, t) in kinds)


def test_damage_and_edge_cases(spark):
    fine = range(5, 20)
    t = free(1, fine)
    rows = [(1, next(t), "user", "Hello."), (1, next(t), "assistant", "Yes.\n \x0b"), (1, next(t), "user", "Hello.")]
    gone = list(itertools.islice(free(2, [0]), 2))
    rows += [(2, g, "user", "All of it goes.") for g in gone]
    same = next(free(3, [3]))
    rows += [(3, same, "user", "Twice.")]
    cut = next(free(4, [2]))
    rows += [(4, cut, "user", "What? Here! Now."), (4, cut, "assistant", None)]
    rows += [(None, None, None, None), (None, 7, "user", "é" * 1000 + "?")]
    rows += [(6, 2 ** 63 - 1, "admin", "Yes."), (6, -2 ** 63, "umpire", "No.")]
    out = {r.conv_id: r for r in cv.repaired(cv.damaged(rows_with(spark, rows))).collect()}
    assert set(out) == {1, 2, 3, 4, None, 6}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (out[1].duplicate, out[1].cost, out[1].audit) == (1, 4, "KKD")
    assert out[1].repaired_sha256 == sha("user:Hello.\nassistant:Yes.\n \x0b")
    assert (out[2].gaps, out[2].cost, out[2].audit, out[2].repaired_sha256) == (0, 0, "", sha(""))
    assert (out[3].duplicate, out[3].illegal) == (1, 1)
    assert out[3].repaired_sha256 == sha("user:Twice.\nassistant:") and (out[3].cost, out[3].audit) == (7, "KDI")
    assert out[4].truncated == 1 and out[4].blank == 1
    assert out[None].blank == 1
    if kind(6, 2 ** 63 - 1) >= 5 and kind(6, -2 ** 63) >= 5:
        assert out[6].gaps == 2 ** 63 - 1 and out[6].audit == "KK"
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.repaired(cv.damaged(empty)).collect() == []


def test_one_conversation_on_a_third_of_the_rows(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Row {i}.") for i in range(6000)] + \
        [(2 + i // 4, i % 4, "user" if i % 2 == 0 else "assistant", f"Row {i}.") for i in range(12000)]
    out = cv.repaired(cv.damaged(spark.createDataFrame(rows, SCHEMA))).collect()
    hot = next(r for r in out if r.conv_id == 1)
    damaged = [(i, k) for i in range(6000) if (k := kind(1, i)) < 5]
    assert len(out) == 3001 and hot.duplicate == sum(k == 3 for _, k in damaged) and hot.blank == sum(k == 1 for _, k in damaged)
    assert len(hot.audit) >= 6000 - sum(k == 0 for _, k in damaged)
