"""Quality rules, decontamination, license scans and toxicity against plain models."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rollcall.llm import decontaminate as dc, licenses as li, linear, quality as q, toxicity as tx
from rollcall.llm.vec import ALNUM as A, BLANK as B, Block, blocks, hash_runs
from tests.llm.helpers import ALNUM, BLANK, docs_frame, edge_rows, lower


def test_words_equal_the_patterns():
    texts = [t or "" for _, t in edge_rows()] + ["a b", "b", "A-Z x_y 9z", "\x00a\x7fb\x1cc", "tail "]
    for limit in (1, 50, 10**6):
        got = {}
        for block in blocks(pa.array(texts), limit):
            for name, table in (("a", A), ("b", B)):
                w = block.words(table, True)
                for r in range(block.rows):
                    got[name, block.first + r] = [w.text(i) for i in range(w.bounds[r], w.bounds[r + 1])]
        for i, t in enumerate(texts):
            assert got["a", i] == ALNUM.findall(lower(t)) and got["b", i] == BLANK.findall(lower(t))


def test_hash_runs_depend_on_bytes_only():
    data = np.frombuffer(b"abc abc xabc" * 3, np.uint8)
    h = hash_runs(data, np.array([0, 4, 9, 12]), np.array([3, 7, 12, 15]))
    assert len(set(h.tolist())) == 1


def base_counts(t):
    t = t or ""
    w, seen, dup = BLANK.findall(t), set(), 0
    for line in t.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def test_quality_counts_and_verdicts(spark):
    rows = edge_rows() + [(20, "same line here\nother\nsame line here\n \nsame line here"), (21, "a b c d e f g h " * 9 + "#*$ <>"),
                          (22, "\n".join(["é ü"] * 5))]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for extra in (False, True):
        got = q.quality(docs_frame(spark, rows, extra), labels).collect()
        assert len(got) == len(rows)
        plain = Counter((i, *base_counts(t)) for i, t in rows)
        assert Counter((r.doc_id, *(r[c] for c in q.COUNTS)) for r in got) == plain
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert r.kept == (not r.base_failed) and r.score == 1.0
    assert q.quality(docs_frame(spark, []), labels).collect() == []
    assert q.keep_good(docs_frame(spark, []), labels).collect() == []


def test_quality_learns_and_keeps_clean(spark):
    draw = np.random.default_rng(1)
    word = lambda: "".join(draw.choice(list("aeinrst"), 5))
    rows, marks = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, " ".join(word() + ("$$$" if bad else "") for _ in range(40))))
        if i < 160:
            marks.append((i, 0 if bad else 1, 0))
    marks += [(5, None, 0), (999, 0, 0), (None, 0, 0), (6, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = docs_frame(spark, rows, True)
    got = {r.doc_id: r for r in q.quality(docs, labels).collect()}
    assert all(got[i].kept == (i % 4 != 0) and 0 <= got[i].score <= 1 for i in range(160, 240))
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_calibration_is_monotone_and_near_the_rate():
    draw = np.random.default_rng(2)
    y = (draw.random(4000) < 0.3).astype(float)
    raw = y * 2 + draw.normal(size=4000)
    p = linear.probability(raw, linear.calibrate(raw, y))
    assert abs(p.mean() - 0.3) < 0.02 and (np.diff(p[np.argsort(raw)]) >= 0).all()


def contaminated(t, items, width):
    w, hit, found = ALNUM.findall(lower(t)), set(), set()
    for i, text in items:
        v = ALNUM.findall(lower(text))
        k = min(width, len(v))
        if i is None or not v:
            continue
        wins = {tuple(v[a:a + k]) for a in range(len(v) - k + 1)}
        for a in range(len(w) - k + 1):
            if tuple(w[a:a + k]) in wins:
                hit |= set(range(a, a + k))
                found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_brute_force(spark):
    items = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (10, "lone"), (3, None), (4, "  "),
             (None, "two three"), (5, "a a a a a a a a a a a a"), (5, "a a a a a a a a a a a a"), (6, "é-ü ñ 7")]
    rows = edge_rows() + [
        (30, "x one two three four five six seven eight nine ten y short, ITEM z"), (31, "two three four five six seven eight nine ten eleven"),
        (32, "a " * 30), (33, "a a a a a a a a a"), (34, "lone lone"), (35, "short"), (36, "É-ü é ü ñ 7"), (37, "eight short"), (38, "item lone")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((i, *contaminated(t, items, 10)) for i, t in rows)
    for size in (10**6, 3):
        for extra in (False, True):
            got = dc.contamination(docs_frame(spark, rows, extra), bench, block_windows=size).collect()
            assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
        docs = docs_frame(spark, rows, True)
        clean = dc.drop_contaminated(docs, bench, block_windows=size)
        assert clean.columns == docs.columns
        assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, t in rows if not contaminated(t, items, 10)[4])
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and r.n_words == len(ALNUM.findall(lower(t))) for r, (_, t) in
               zip(sorted(dc.contamination(docs_frame(spark, rows[:9]), none).collect(), key=lambda r: (r.doc_id, r.n_words)),
                   sorted(rows[:9], key=lambda x: (x[0], len(ALNUM.findall(lower(x[1])))))))
    assert dc.contamination(docs_frame(spark, []), bench).collect() == []


def test_licenses(spark):
    rows = edge_rows() + [(40, "Released under the MIT License. Mit license!"), (41, "released under the terms of the mit license"),
                          (42, "released under the new mit license"), (43, "CC BY 4.0 cc-by"), (44, "Licensed under CC BY-NC 4.0."),
                          (45, "Licensed under the GNU General Public License, either version 3 or (at your option) any later version")]
    for extra in (False, True):
        got = {r.doc_id: r for r in li.license_scan(docs_frame(spark, rows, extra)).collect()}
        for i, t in rows:
            w = ALNUM.findall(lower(t))
            places = sorted((a, label) for p, label in li.PHRASES.items() for a in range(len(w)) if w[a:a + len(p.split())] == p.split())
            r = got[i]
            assert (r.n_words, r.n_base) == (len(w), len(places))
            assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
            assert r.base_labels == ",".join(sorted({x for _, x in places}))
    assert (got[40].labels, got[40].score, got[41].score, got[42].score) == ("mit", 1.0, 1.0, 0.5)
    assert got[43].labels == "cc-by" and got[44].labels == "cc-by,cc-by-nc-4.0" and got[45].labels == "gpl,gpl-3.0"
    assert li.license_scan(docs_frame(spark, [])).collect() == []


def test_automata_follow_the_markup():
    a = li.Automaton("alpha beta <<beginOptional>>maybe <<beginOptional>>very<<endOptional>> so<<endOptional>> <<var;2>> omega")
    accepts = lambda t: a.longest(li.hashed(t.split()).tolist(), 0, len(t.split())) == len(t.split())
    for good in ("alpha beta omega", "alpha beta maybe so omega", "alpha beta maybe very so x y omega", "alpha beta omega omega"):
        assert accepts(good)
    for bad in ("alpha omega", "alpha beta maybe omegas", "alpha beta x y z omega", "alpha beta maybe very so"):
        assert not accepts(bad)
    for wrong in ("<<var;1>> a b", "one", "a b <<beginOptional>> c"):
        with pytest.raises(ValueError):
            li.Automaton(wrong)


def test_toxicity_learns_from_other_rows_only(spark):
    draw = np.random.default_rng(3)
    word = lambda: "".join(draw.choice(list("aeinrst"), 5))
    slurs, rows, marks = ["grimbus", "volgar", "snarkel"], [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [word() for _ in range(30)]
        if toxic:
            w[draw.integers(30)] = slurs[i // 5 % 3] + ("" if i % 2 else "ish")
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(docs_frame(spark, rows, True), labels).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(out)) for i in got)
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    turned = spark.createDataFrame([(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, _, t in marks],
                                   "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in tx.toxicity(docs_frame(spark, rows), turned).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = tx.toxicity(docs_frame(spark, edge_rows(), True), none).collect()
    assert len(got) == len(edge_rows()) and all(r.predicted == 0 for r in got)
    one = spark.createDataFrame([(5, 1, 1), (5, 1, 0), (6, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(tx.toxicity(docs_frame(spark, edge_rows()), one).collect()) == len(edge_rows())
    assert tx.toxicity(docs_frame(spark, []), one).collect() == []


def test_label_model_joins_voters_that_copy_each_other():
    draw = np.random.default_rng(4)
    y = (draw.random(3000) < 0.3).astype(float)
    votes = np.stack([(draw.random(3000) < np.where(y == 1, 0.5, 0.02)) for _ in range(4)], 1)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], 1)
    belief, group, on, off = tx.label_model(votes, np.where(draw.random(3000) < 0.05, 1 - y, y))
    assert group[0] == group[4] == group[5] and len(set(group.tolist())) == 4
    assert (on > 0.4).all() and (off < 0.1).all() and np.mean((belief > 0.5) == (y == 1)) > 0.94


def test_block_of_no_bytes():
    empty = Block(0, 2, np.empty(0, np.uint8), np.zeros(3, np.int64))
    assert q.counts(empty)["n_words"].tolist() == [0, 0]
