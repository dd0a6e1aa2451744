"""Small inputs and plain models."""

import re

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
EXTRA = ", key string, d long, rep long, kept boolean, words array<int>, score string, ids string"


def lower(text):
    return (text or "").translate(LOWER)


def docs_frame(spark, rows, extra=False):
    """Rows (id, text) as documents; with ``extra``, columns whose names the operators use themselves."""
    if extra:
        return spark.createDataFrame([(i, t, "x", 1, 2, True, [1], "s", "i") for i, t in rows], "doc_id long, text string" + EXTRA)
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def edge_rows(seed_text="one two three four five six seven eight nine ten eleven twelve"):
    """Null, empty, blank, odd and very long texts, repeated rows, a null id."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, seed_text), (5, seed_text), (6, seed_text.upper()),
        (7, "é ü ñ — ÉÜÑ 漢字 😀 a b"), (8, "x" * 300_000), (9, " ".join(f"w{i}" for i in range(60_000))), (None, seed_text),
        (10, "\n\n" + seed_text + "\n" + seed_text + "\n\n"),
    ]


def components_of(sets, links):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}
