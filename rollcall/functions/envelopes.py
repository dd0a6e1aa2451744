"""Records inside a JSON text, found without parsing values and without recursion."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall import fixed_values as fixed

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[\]{},:]|[^\s\[\]{},:"]++', re.DOTALL)


class _Node:
    """A value: its span, and for a list or an object its (key, value) children."""

    __slots__ = ("begin", "end", "kind", "children", "key")

    def __init__(self, begin: int, kind: str) -> None:
        self.begin, self.end, self.kind, self.children, self.key = begin, begin, kind, [], None


def _tree(text: str) -> _Node | None:
    """The containers of a valid JSON text."""
    top = _Node(0, "[")
    stack = [top]
    for token in _TOKEN.finditer(text):
        mark, here = token.group(), stack[-1]
        if mark in "[{":
            node = _Node(token.start(), mark)
            here.children.append((here.key, node))
            here.key = None
            stack.append(node)
        elif mark in "]}":
            here.end = token.end()
            stack.pop()
        elif mark in ",:":
            continue
        elif here.kind == "{" and here.key is None:
            here.key = json.loads(mark)
        else:
            here.children.append((here.key, None))  # a scalar
            here.key = None
    return top.children[0][1] if top.children else None


def records_of(text: str) -> list[dict]:
    """(path, text) of every record, in document order."""
    found, todo = [], [((), _tree(text))]
    while todo:
        path, node = todo.pop()
        if node is None:
            continue
        if node.kind == "[":
            todo += [((*path, i), child) for i, (_, child) in enumerate(node.children)][::-1]
            continue
        held = dict(node.children)
        inner = next((held[k] for k in fixed.CONTAINER_KEYS if k in held), None)
        if inner is None:
            found.append({"path": list(path), "record": text[node.begin : node.end]})
        else:
            todo.append(((*path, 0), inner))
    return found


RECORDS = T.ArrayType(T.StructType([
    T.StructField("path", T.ArrayType(T.IntegerType())), T.StructField("record", T.StringType())]))


@F.arrow_udf(RECORDS)
def open_envelope(text: pa.Array) -> pa.Array:
    """The records of each text; the text must be valid JSON or NULL."""
    kind = pa.list_(pa.struct([("path", pa.list_(pa.int32())), ("record", pa.string())]))
    return pa.array([None if t is None else records_of(t) for t in text.to_pylist()], kind)
