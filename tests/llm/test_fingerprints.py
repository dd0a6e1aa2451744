import hashlib
import random

import numpy as np

from rollcall.llm import fingerprints as fp
from tests.llm.helpers import BLANK, components_of, docs_frame, edge_rows, lower
from tests.llm.test_near_dedup import families


def shingles(text):
    w = BLANK.findall(lower(text))
    return {tuple(w[max(0, i - 4):i + 1]) for i in range(len(w))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def model(rows):
    """(id, n_chars, edited text, next text) by descending id; ids are distinct."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        yield i, t, t[:len(t) - half] + after[:half], after


def test_rows_equal_a_plain_model(spark):
    draw = random.Random(4)
    rows = [(i * 3 - 40, " ".join(f"w{draw.randrange(60)}é" for _ in range(draw.choice([0, 1, 3, 40, 400])))) for i in range(300)]
    rows[7] = (rows[7][0], None)
    for parts in (1, 5, 64):
        out = {r.doc_id: r for r in fp.edited_fingerprints(docs_frame(spark, rows, True), parts=parts).collect()}
        assert len(out) == 300
        errors = []
        for i, text, edited, after in model(rows):
            r = out[i]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            errors += [r.near_edited - jaccard(shingles(text), shingles(edited)), r.near_next - jaccard(shingles(text), shingles(after))]
            assert (r.fingerprint == "") == (not shingles(text)) and (r.fingerprint == r.edited_fingerprint) >= (text == edited)
        assert np.std(errors) < 0.05 and abs(np.mean(errors)) < 0.01


def test_edge_cases(spark):
    rows = edge_rows()
    out = fp.edited_fingerprints(docs_frame(spark, rows, True)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)
    by = {r.doc_id: r for r in out}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "" and by[3].near_next == by[2].near_next == 1.0
    assert by[5].fingerprint == by[6].fingerprint and by[6].near_next == 1.0
    assert by[4].near_next == 0.0 and by[8].n_chars == 300_000
    last = next(r for r in out if r.doc_id is None)  # after the last comes the first, the largest id
    t = rows[10][1]
    assert last.edited_sha256 == hashlib.sha256((t[:len(t) - len(t) // 2] + rows[11][1][:len(t) // 2]).encode()).hexdigest()
    assert fp.edited_fingerprints(docs_frame(spark, [])).collect() == []
    assert fp.edited_fingerprints(docs_frame(spark, [(None, "a b"), (None, None)])).count() == 2
    alone = fp.edited_fingerprints(docs_frame(spark, [(3, "one two")])).collect()
    assert alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256(b"one one").hexdigest()


def test_one_id_on_a_third_of_the_rows_is_cut(spark):
    rows = [(500, f"text {i} of the hot id") for i in range(400)] + [(i, f"row {i}") for i in range(800)]
    ranged = fp._ranged(docs_frame(spark, rows).selectExpr("doc_id", "text", "xxhash64(text) h"), 12)
    sizes = [r["count"] for r in ranged.groupBy("range").count().collect()]
    assert max(sizes) < 250 and len(sizes) >= 8
    order = [r["range"] for r in ranged.orderBy("doc_id", "h").collect()]
    assert order == sorted(order)
    out = fp.edited_fingerprints(docs_frame(spark, rows), parts=12).collect()
    assert len(out) == 1200
    ordered = [r.text for r in docs_frame(spark, rows).selectExpr("doc_id", "text", "xxhash64(text) h").orderBy("doc_id", "h", ascending=False).collect()]
    want = sorted(hashlib.sha256((t[:len(t) - len(t) // 2] + n[:len(t) // 2]).encode()).hexdigest()
                  for t, n in zip(ordered, ordered[1:] + ordered[:1]))
    assert sorted(r.edited_sha256 for r in out) == want


def test_classes_equal_brute_force(spark):
    rows = families(3)
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(sets, links)
    out = fp.near_classes(docs_frame(spark, rows, True)).collect()
    assert {r.doc_id: r.component_id for r in out} == want and 1 < len(set(want.values())) < len(want)
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in out)


def test_classes_edge_cases(spark):
    out = {r.doc_id: r for r in fp.near_classes(docs_frame(spark, edge_rows(), True)).collect()}
    assert out[5].component_id == out[6].component_id == 5 and out[None].component_id is None
    assert out[1].component_id == 1 and out[2].component_id == 2 and out[1].n_shingles == 0
    assert fp.near_classes(docs_frame(spark, [])).collect() == []
