import random

import numpy as np
from pyspark.sql import functions as F

from rollcall.llm import near_dedup as nd
from rollcall.llm.components import components
from tests.llm.helpers import BLANK, components_of, docs_frame, edge_rows, lower


def shingles(text, k):
    w = BLANK.findall(lower(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def families(seed, texts=6, copies=40):
    """Texts with copies at many distances, so that groups are linked in chains and just not linked."""
    draw, rows = random.Random(seed), []
    for t in range(texts):
        base = [f"t{t}w{draw.randrange(5000)}" for _ in range(draw.choice([12, 60, 150]))]
        kept = [base]
        for _ in range(copies):
            w = list(draw.choice(kept[:5]))
            for _ in range(draw.choice([0, 1, 2, 3, 4, 6, 9])):
                at = draw.randrange(len(w))
                w[at:at + draw.choice([0, 1])] = draw.choice([[], [f"n{draw.randrange(9)}"], [f"u{draw.randrange(10**6)}"]])
                w = w or ["left"]
            kept.append(w)
            rows.append(" ".join(w))
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_groups_equal_brute_force(spark):
    for k, percent in ((4, 80), (2, 70)):
        rows = families(k)
        sets = {i: shingles(t, k) for i, t in rows}
        links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = components_of(sets, links)
        rows_out = nd.near_groups(docs_frame(spark, rows), shingle=k, percent=percent, band_rows=4 if percent == 80 else 2).collect()
        assert {r.doc_id: r.component_id for r in rows_out} == want
        assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in rows_out)
        assert 1 < len(set(want.values())) < len(want)


def test_links_need_no_bucket_leader(spark):
    """All rows in one bucket: the pivot search alone must find every component."""
    rows = families(11, texts=2, copies=60)
    sets = {i: shingles(t, 4) for i, t in rows}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    keep = set(first.values())
    number = {g: n for n, g in enumerate(sorted({g for s in sets.values() for g in s}))}
    buckets = spark.createDataFrame([(1, i) for i in keep], "band long, rep long")
    elements = spark.createDataFrame([(i, sorted(number[g] for g in sets[i])) for i in keep], "rep long, elements array<long>")
    found = components(nd.links(nd.star_pairs(buckets), elements, 80)).collect()
    links = [(a, b) for a in keep for b in keep if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of({i: 0 for i in keep}, links)
    assert {**{i: i for i in keep}, **{r.u: r.v for r in found}} == want


def test_sketch_coordinates_estimate_similarity():
    draw = np.random.default_rng(5)
    pool = draw.integers(0, 2**63, 4000).astype(np.uint64)
    for size in (1, 3, 40, 900):
        a, b = np.unique(pool[:size]), np.unique(np.concatenate([pool[:max(1, size * 9 // 10)], pool[3000:3000 + size // 10]]))
        s = nd.sketches([a, b, a], 128)
        assert (s != nd.EMPTY).all() and (s[0] == s[2]).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.15


def test_edges(spark):
    for extra in (False, True):
        got = nd.near_groups(docs_frame(spark, edge_rows(), extra), shingle=4).collect()
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
        assert len(got) == len(edge_rows())
        for i in (1, 2, 3):
            assert by[i] == [(0, i, True)]
        assert by[4] == [(1, 4, True)] and by[5] == [(9, 5, True)] * 2 and by[6] == [(9, 5, False)]
        assert by[None] == [(9, None, True)] and by[9][0][0] == 59_997
    none = docs_frame(spark, [])
    assert nd.near_groups(none).collect() == [] and nd.drop_near_copies(none).collect() == []


def test_drop_keeps_columns_and_one_of_each(spark):
    docs = docs_frame(spark, edge_rows(), True)
    kept = nd.drop_near_copies(docs, shingle=4)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 7, 8, 9, 10, None], key=str)


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (9, 8), (8, 7), (5, 5), (20, 1)] + [(100, 100 + i) for i in range(1, 60)]
    got = components(spark.createDataFrame(edges, "u long, v long"))
    want = components_of({x for e in edges for x in e}, edges)
    assert {r.u: r.v for r in got.collect()} == {i: c for i, c in want.items() if i != c}
    assert components(spark.createDataFrame([], "u long, v long")).agg(F.count("*")).first()[0] == 0
