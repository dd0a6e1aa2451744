"""License scans: base phrases, and license templates compiled into token automata.

A template is wording with markup: ``<<beginOptional>> ... <<endOptional>>`` may be left out, ``<<var;N>>`` stands
for up to N words of any kind. It compiles into a nondeterministic automaton over words; a text is accepted
where every mandatory word follows in order, with nothing between that the markup does not allow. The
automata start only where the first two words of a template occur, which is found for all words at once.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollcall.llm.vec import ALNUM, blocks, gram_hash, Words, Block
from rollcall.llm.work import id_text

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public license wording with the regions that may vary.
OPT, END = "<<beginOptional>>", "<<endOptional>>"
TEMPLATES = {
    "mit": [
        f"released under the {OPT}terms of the{END} mit license",
        f"licensed under the {OPT}terms of the{END} mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of <<var;6>> associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use "
        "copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
        f"the software is furnished to do so subject to the following conditions the above copyright notice and this "
        f"permission notice {OPT}including the next paragraph{END} shall be included in all copies or substantial portions "
        "of the software",
    ],
    "apache-2.0": [
        f"licensed under the apache license version 2 0 {OPT}the license{END}",
        f"released under the {OPT}terms of the{END} apache license version 2 0",
    ],
    "gpl-2.0": [
        f"licensed under the {OPT}terms of the{END} gnu general public license {OPT}as published by the free software "
        f"foundation{END} {OPT}either{END} version 2 {OPT}or at your option any later version{END}",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        f"license as published by the free software foundation {OPT}either{END} version 2 of the license "
        f"{OPT}or at your option any later version{END}",
    ],
    "gpl-3.0": [
        f"licensed under the {OPT}terms of the{END} gnu general public license {OPT}as published by the free software "
        f"foundation{END} {OPT}either{END} version 3 {OPT}or at your option any later version{END}",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        f"license as published by the free software foundation {OPT}either{END} version 3 of the license "
        f"{OPT}or at your option any later version{END}",
    ],
    "cc-by-4.0": [f"licensed under {OPT}a{END} cc by 4 0",
                  f"licensed under a creative commons attribution 4 0 international {OPT}license{END}"],
    "cc-by-nc-4.0": [f"licensed under {OPT}a{END} cc by nc 4 0",
                     f"licensed under a creative commons attribution noncommercial 4 0 international {OPT}license{END}"],
    "cc-by-sa-4.0": [f"licensed under {OPT}a{END} cc by sa 4 0",
                     f"licensed under a creative commons attribution sharealike 4 0 international {OPT}license{END}"],
    "bsd-2-clause": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution",
    ],
    "isc": [
        "permission to use copy modify <<var;3>> distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
}


def hashed(words: list[str]) -> np.ndarray:
    block = Block(0, 1, np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words).encode())]))
    return block.words(ALNUM, True).hash


class Automaton:
    """One template: word edges and free steps between numbered states; the last state accepts."""

    def __init__(self, template: str) -> None:
        tokens = re.findall(r"<<[^>]*>>|[^\s<>]+", template.lower())
        if len(tokens) < 2 or any("<<" in t for t in tokens[:2]):
            raise ValueError("a template starts with two mandatory words")
        plain = [t for t in tokens if "<<" not in t]
        codes = iter(int(x) for x in hashed(plain))
        self.word: list[dict[int, int]] = [{}]  # state -> {word: next state}
        self.any: list[int] = [-1]
        self.free: list[list[int]] = [[]]
        opened: list[int] = []

        def state() -> int:
            self.word.append({})
            self.any.append(-1)
            self.free.append([])
            return len(self.word) - 1

        now = 0
        for t in tokens:
            if t == "<<beginoptional>>":
                opened.append(now)
                nxt = state()
                self.free[now].append(nxt)
                now = nxt
            elif t == "<<endoptional>>":
                nxt = state()
                self.free[now].append(nxt)
                self.free[opened.pop()].append(nxt)
                now = nxt
            elif t.startswith("<<var"):
                inside = [now]
                for _ in range(int(t.strip("<>").split(";")[1])):
                    nxt = state()
                    self.any[now] = nxt
                    now = nxt
                    inside.append(now)
                now = state()
                for s in inside:
                    self.free[s].append(now)
            else:
                nxt = state()
                self.word[now][next(codes)] = nxt
                now = nxt
        if opened:
            raise ValueError("an optional region is not closed")
        self.accept = now
        self.start = int(gram_hash([hashed(plain[:1]), hashed(plain[1:2])])[0])

    def _close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def longest(self, words: list[int], at: int, end: int) -> int:
        """End of the longest accepted run that starts at word ``at``, or -1."""
        states, found = self._close({0}), -1
        while states:
            if self.accept in states:
                found = at
            if at >= end:
                break
            w = words[at]
            states = self._close({s for x in states for s in (self.word[x].get(w, -1), self.any[x]) if s >= 0})
            at += 1
        return found


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]) -> None:
        self.phrases = [(gram_hash([hashed([w]) for w in p.split()])[0], len(p.split()), label) for p, label in phrases.items()]
        self.automata = [(label, Automaton(t)) for label, found in templates.items() for t in found]
        self.room = max(len(a.word) for _, a in self.automata)  # no run is longer
        self.starts = np.unique(np.array([a.start for _, a in self.automata], np.uint64))

    def base(self, words: Words):
        """(word, label) of every base phrase of a block, in word order."""
        found = []
        for k in sorted({k for _, k, _ in self.phrases}):
            at, grams = words.grams(k)
            for h, size, label in self.phrases:
                if size == k:
                    found += [(int(i), label) for i in at[grams == h]]
        return sorted(found)

    def templates(self, words: Words):
        """(first word, end, label) of every accepted place of a block."""
        at, grams = words.grams(2)
        first = np.flatnonzero(np.isin(grams, self.starts))
        if not len(first):
            return []
        row, found = words.row, []
        for i, start in zip(at[first], grams[first]):
            end = int(words.bounds[row[i] + 1])
            room = words.hash[i:min(end, i + self.room)].tolist()
            for label, a in self.automata:
                if a.start == int(start):
                    n = a.longest(room, 0, len(room))
                    if n > 0:
                        found.append((int(i), int(i) + n, label))
        return found


OUT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
       "score double, n_templates long")


def _scan(batches, scanner: Scanner):
    for batch in batches:
        ids = batch.column("doc_id")
        for block in blocks(batch.column("text")):
            words = block.words(ALNUM, True)
            base: dict[int, list] = {}
            whole: dict[int, list] = {}
            for i, label in scanner.base(words):
                r = int(np.searchsorted(words.bounds, i, "right")) - 1
                base.setdefault(r, []).append((i - int(words.bounds[r]), label))
            for i, _, label in scanner.templates(words):
                whole.setdefault(int(np.searchsorted(words.bounds, i, "right")) - 1, []).append(label)
            rows = []
            for r in range(block.rows):
                b, w = base.get(r, []), whole.get(r, [])
                own = {label for _, label in b}
                rows.append((int(words.count[r]), len(b), b[0][0] if b else None, b[-1][0] if b else None,
                             ",".join(sorted(own)), ",".join(sorted(own | set(w))), 1.0 if w else 0.5 if b else 0.0, len(w)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(block.first, block.rows), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                names=[f.split()[0] for f in OUT.split(", ")])


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base places, labels and score of every row of ``docs``; one pass, no shuffle.

    The score is 1 where a template is accepted, 0.5 where only base phrases occur, else 0. Null texts count as
    empty: no words, no places, empty labels. Repeated rows are scanned each, null ids stay null, an
    empty table gives no rows. Other columns are not read.
    """
    scanner = Scanner(phrases or PHRASES, templates or TEMPLATES)
    return id_text(docs, id_col, text_col).mapInArrow(partial(_scan, scanner=scanner), OUT)
