"""Token counts, token files, segmentations: against the libraries on whole texts."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest

from rollcall.llm import segment as sg, token_counts as tc, token_files as tf
from rollcall.llm import queries
from rollcall.llm.queries import vocabulary
from rollcall.llm.vec import U, blocks, mix
from rollcall.storage import work_path
from tests.llm.helpers import docs_frame, edge_rows

ODD = ["word,\n\"Next\" one.", "a\nb\nc", "\nlead tail\n", "ends.\n", "x%%% y### Zé!! l'eau don't- a's b",
       "a  b", " a", "a ", "  ", "a \n b", "a\n\nb  c", "it's 'twas  we'll", "<|endoftext|> x", "x <|endoftext|>y <|startoftext|>",
       "é ́x", "a b c 　d", "A\x1cB \x1c C", "\r\n x\r\n", "ＡＢ ﬁ İ ß", "1234 5 6,7", "​ ﻿ z", "<s> </s> ▁ a▁b"]


def rows():
    return edge_rows() + [(100 + i, t) for i, t in enumerate(ODD)]


def test_counts_equal_the_library(spark):
    path = vocabulary("word_bpe_49k.json")
    lib = tc.tokenizer(path)
    want = Counter((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 8) for i, t in rows())
    for extra in (False, True):
        for chunk in (16_384, 40):
            got = tc.token_counts(docs_frame(spark, [r for r in rows() if chunk > 40 or len(r[1] or "") < 1000], extra), path,
                                  limit=8, chunk=chunk, overlap=6).collect()
            found = Counter(tuple(r) for r in got)
            assert found == (want if chunk > 40 else Counter({k: v for k, v in want.items() if k[1] < 1000}))
    assert tc.token_counts(docs_frame(spark, []), path).collect() == []


def test_splice_gives_the_ids_of_the_whole_text():
    path = vocabulary("word_bpe_49k.json")
    lib, encode = tc.tokenizer(path), tc._encode(path)
    texts = ODD + [" ".join(ODD * 3), "x" * 900, "word " * 300, "né " * 200 + "a" * 500 + " end of it", "\n".join(["abc def"] * 90)]
    for text in texts:
        for chunk, lap in ((30, 4), (64, 16), (200, 1)):
            assert tc.splice(text, encode, chunk, lap) == lib.encode(text, add_special_tokens=False).ids


def test_pieces_stay_bounded():
    made = []
    pieces = tc.Pieces(lambda p: [made.append(x) or len(x) for x in p], limit=5)
    for i in range(40):
        known = pieces.of([[f"p{i}", f"p{i + 1}"]])
        assert known[f"p{i}"] == len(f"p{i}") and len(known) <= 7


def test_files_hold_the_ids_in_order(spark):
    path = vocabulary("byte_bpe_50k.json")
    lib = tc.tokenizer(path)
    want, start = [], 0
    for i, t in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    for encoding in ("delta", "dictionary"):
        out = work_path(spark, "tokens-test")
        tf.write_tokens(docs_frame(spark, rows(), True), out, path, encoding=encoding)
        got = sorted((tuple(r) for r in tf.token_digests(tf.read_tokens(spark, out)).collect()), key=lambda r: r[1])
        assert got == want
        kinds = set()
        for file in ds.dataset(out.removeprefix("file:"), format="parquet").files:
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                column = meta.row_group(g).column(4)
                assert column.has_offset_index
                kinds |= set(column.encodings)
        assert ("DELTA_BINARY_PACKED" in kinds) == (encoding == "delta")
    out = work_path(spark, "tokens-test")
    tf.write_tokens(docs_frame(spark, []), out, path)
    assert tf.token_digests(tf.read_tokens(spark, out)).collect() == []


@pytest.fixture(scope="module")
def vocab():
    return sg.Vocabulary(vocabulary("piece_bpe_32k.model"))


def every_segmentation(text, vocab):
    data = (" " + text).encode() if text else b""
    model = sg.processor(vocabulary("piece_bpe_32k.model"))
    table = {model.id_to_piece(int(i)).replace("▁", " ").encode(): int(i) for i in vocab.id}
    found = []

    def go(at, ids, weight):
        if at == len(data):
            found.append((tuple(ids), weight))
            return
        for end in range(at + 1, len(data) + 1):
            i = table.get(data[at:end])
            if i is not None:
                go(end, ids + [i], weight + vocab.weight[i])

    go(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in found])
    return {ids: math.exp(w - total) for ids, w in found}


def test_samples_without_replacement_have_the_right_law(vocab):
    text, n = "to in", 6000
    p = every_segmentation(text, vocab)
    ranks, after = sg.sample_block(next(blocks(pa.array([text] * n))), mix(np.arange(n).astype(U), 3), sg.Lattices(vocab), 3)
    drawn = [[tuple(ids[b[r]:b[r + 1]].tolist()) for r in range(n)] for b, ids, _, _ in ranks]
    assert all(len({d[r] for d in drawn}) == 3 for r in range(n))
    first, second = Counter(drawn[0]), Counter(drawn[1])
    for ids, chance in sorted(p.items(), key=lambda x: -x[1])[:4]:
        later = sum(p[a] * chance / (1 - p[a]) for a in p if a != ids)
        assert abs(first[ids] / n - chance) < 0.03 and abs(second[ids] / n - later) < 0.03
    for _, _, log_prob, value in ranks:
        assert np.isfinite(log_prob).all()
    assert all((a[3] >= b[3]).all() for a, b in zip(ranks, ranks[1:])) and (ranks[-1][3] >= after).all()
    one = drawn[0][0]
    assert abs(math.exp(ranks[0][2][0]) - p[one]) < 1e-9


def test_all_segmentations_of_a_short_text_come_out(vocab):
    p = every_segmentation("on", vocab)
    ranks, after = sg.sample_block(next(blocks(pa.array(["on", "", "on"]))), mix(np.arange(3).astype(U)), sg.Lattices(vocab), len(p) + 3)
    got = [tuple(ids[b[0]:b[1]].tolist()) for b, ids, _, value in ranks if np.isfinite(value[0]) and b[1] > b[0]]
    assert sorted(got) == sorted(p) and after[0] == -np.inf


def test_emptied_tables_change_nothing(vocab):
    draw = np.random.default_rng(8)
    texts = [" ".join("".join(draw.choice(list("abcdeé"), draw.integers(1, 9))) for _ in range(60)) for _ in range(40)]
    keys = mix(np.arange(len(texts)).astype(U))
    whole, small = sg.Lattices(vocab), sg.Lattices(vocab)
    small.PLACES = 700
    runs = []
    for lattices in (whole, small):
        got = []
        for block in blocks(pa.array(texts), 900):
            ranks, after = sg.sample_block(block, keys[block.first:block.last], lattices, 2)
            got += [(ids[b[r]:b[r + 1]].tolist(), lp[r], v[r]) for b, ids, lp, v in ranks for r in range(block.rows)]
        runs.append(got)
    assert runs[0] == runs[1] and len(small.known) < len(whole.known)


def test_segmentations_of_a_table(spark):
    path = vocabulary("piece_bpe_32k.model")
    given = [r for r in rows() if "▁" not in (r[1] or "") and "\x00" not in (r[1] or "")]
    for extra in (False, True):
        got = sg.sampled_segmentations(docs_frame(spark, given, extra), path, k=3, digest=True).collect()
        assert all(r.round_trip for r in got)
        assert Counter(r.doc_id for r in got if r.rank == 0) == Counter(i for i, _ in given)
    ids = sg.sampled_segmentations(docs_frame(spark, given), path, k=2)
    by = defaultdict(list)
    for r in ids.collect():
        by[r.doc_id, r.rank].append(r)
        assert r.n_pieces == len(r.ids) and 0 <= r.inclusion <= 1
    assert all(len({tuple(x.ids) for x in v}) == 1 for v in by.values())
    assert by[1, 0][0].ids == [] and (1, 1) not in by and by[4, 0][0].ids != by[4, 1][0].ids
    back = {r.doc_id: r.text for r in sg.decode(ids.where("rank = 1"), path).collect()}
    text = dict(given)
    assert all(t == text[i] for i, t in back.items())
    plain = sg.decode(sg.encode(docs_frame(spark, given, True), path), path).collect()
    assert Counter((r.doc_id, r.text) for r in plain) == Counter((i, t or "") for i, t in given)
    assert sg.sampled_segmentations(docs_frame(spark, []), path).collect() == []


def test_the_query_returns_the_segmentations_themselves(spark):
    """The ids stand beside their digest and decode to the texts."""
    got = queries.op7_segmentations(spark, "/root/testdata/sf0.001").limit(60)
    rows = got.select("doc_id", "rank", "ids", "n_pieces", "ids_crc32").collect()
    assert rows and all(len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
