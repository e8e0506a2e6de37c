"""License scan: fuzzy search for short notices.

A notice with a budget of k edits is split into k + 1 pieces; whatever k edits do,
one piece is left whole (pigeonhole).  One automaton finds the pieces of all
notices exactly; each hit names a window of the text, barely longer than the notice,
in which the regex library's bounded-error matching then verifies the notice and gives
the span with the fewest edits.  Spans of a notice are taken best first; where a
window's best span meets one that is taken, the rest of the window is searched again.
So the spans are those of searching the whole text for the best match, then what lies
before and after it, and so on; but the work is linear in the number of hits.

The search runs on the text's words (letters of A-Z lowered, digits, and all
characters beyond ASCII) joined by single spaces, so punctuation and line breaks
don't count as edits.  Base phrases are exact runs of words.

Results: null texts count as empty; texts without a word give zeros and nulls;
overlapping spans of one label are reported once, that with the fewest edits first.
"""

from __future__ import annotations

import functools
from bisect import bisect_right, insort
from heapq import heappop, heappush

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versograph.llm.common import map_texts, table

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice in words, label, and the edits allowed (characters inserted, deleted or replaced).
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("licensed under the gnu general public license", "gpl", 4),
    ("licensed under the terms of the gnu general public license", "gpl", 5),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    ("mozilla public license", "mpl", 2),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under cc by sa 4 0", "cc-by-sa", 2),
    ("creative commons attribution", "cc", 2),
    ("all rights reserved", "proprietary", 1),
    ("the above copyright notice and this permission notice shall be included in all copies", "mit", 8),
    ("unless required by applicable law or agreed to in writing software distributed under the license", "apache", 9),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd", 7),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 7),
    ("this software is provided as is without any express or implied warranty", "zlib", 7),
    ("this is free and unencumbered software released into the public domain", "unlicense", 7),
    ("provided as is without warranty of any kind express or implied", "as-is", 6),
    ("cc0 1 0 universal", "cc0", 1),
    ("eclipse public license", "epl", 2),
    ("boost software license", "bsl", 2),
    ("common development and distribution license", "cddl", 4),
    ("european union public licence", "eupl", 2),
    ("sil open font license", "ofl", 2),
    ("open data commons open database license", "odbl", 3),
    ("microsoft public license", "ms-pl", 2),
    ("python software foundation license", "psf", 3),
    ("academic free license", "afl", 2),
    ("artistic license 2 0", "artistic", 1),
)
_SEPARATORS = bytes(c for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123))
WORDS_ONLY = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``edits`` + 1 pieces of nearly equal length."""
    n, k = len(notice), edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def meeting(taken: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Those of some sorted spans without overlaps that overlap start..end."""
    i = bisect_right(taken, (start, start))
    i -= i > 0 and taken[i - 1][1] > start
    j = i
    while j < len(taken) and taken[j][0] < end:
        j += 1
    return taken[i:j]


#: Characters of a run that is looked up in a window before its edits are counted.
GRAM = 3


class Scanner:
    def __init__(self, notices: tuple = NOTICES):
        self.notices = [(text, label, k, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}")) for text, label, k in notices]
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (text, _, k, _) in enumerate(self.notices):
            for offset, piece in pieces(text, k):
                at.setdefault(piece, []).append((i, offset))
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        #: For each notice its runs of GRAM characters, and how many of them every place with few enough edits has: an edit touches GRAM at most.
        self.grams = [([text[j : j + GRAM] for j in range(len(text) - GRAM + 1)], len(text) - GRAM + 1 - GRAM * k) for text, _, k, _ in self.notices]

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice, the parts of a text in which it can stand: at most 2 edits wider than the notice to either side."""
        starts: dict[int, set[int]] = {}
        for last, (length, where) in self.automaton.iter(text):
            for i, offset in where:
                starts.setdefault(i, set()).add(last - length + 1 - offset)
        out = {}
        for i, own in starts.items():
            notice, _, k, _ = self.notices[i]
            first = None
            parts = out[i] = []
            for start in sorted(own):
                if first is None or start > first + 2 * k:
                    first = start
                    parts.append((max(0, start - k), min(len(text), start + len(notice) + k)))
                else:
                    parts[-1] = (parts[-1][0], min(len(text), start + len(notice) + k))
        return out

    def spans(self, text: str, i: int, windows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(edits, start, end) of notice i: best and earliest first, without overlaps."""
        notice, _, k, pattern = self.notices[i]
        grams, least = self.grams[i]

        def possible(a: int, b: int) -> bool:
            there = {text[j : j + GRAM] for j in range(a, b - GRAM + 1)}
            return sum(g in there for g in grams) >= least

        def best(a: int, b: int) -> None:
            if b - a >= len(notice) - k and possible(a, b) and (m := pattern.search(text, a, b)):
                heappush(waiting, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        waiting: list[tuple] = []
        for w in windows:
            best(*w)
        taken: list[tuple[int, int]] = []  # sorted
        found = []
        while waiting:
            edits, start, end, a, b = heappop(waiting)
            if not meeting(taken, start, end):
                insort(taken, (start, end))
                found.append((edits, start, end))
            for x, y in meeting(taken, a, b):
                best(a, min(b, x))
                a = max(a, y)
            best(a, b)
        return found

    def fuzzy(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, notice length) over normalised text; best and earliest first per label, without overlaps."""
        found = []
        for i, own in self.windows(text).items():
            notice, label = self.notices[i][:2]
            found += [(*x, label, len(notice)) for x in self.spans(text, i, own)]
        kept: list[tuple[int, int, str, int, int]] = []
        taken: dict[str, list[tuple[int, int]]] = {}
        for edits, start, end, label, n in sorted(found):
            own = taken.setdefault(label, [])
            if not meeting(own, start, end):
                insort(own, (start, end))
                kept.append((start, end, label, edits, n))
        return sorted(kept)

    def scan(self, raw: bytes) -> dict:
        words = raw.translate(WORDS_ONLY).split()
        flat = b" ".join(words)
        padded = b" " + flat + b" "
        starts, labels = [], set()
        for phrase, label in BASE.items() if b" license " in padded else ():
            needle, at = b" " + phrase.encode() + b" ", -1
            while (at := padded.find(needle, at + 1)) >= 0:
                starts.append(padded.count(b" ", 0, at))
                labels.add(label)
        hits = self.fuzzy(flat.decode("utf-8", "replace"))
        score = 1.0 if starts else 0.0
        spans: list[dict] = []
        if hits:
            score = max([score, *(1 - e / n for _, _, _, e, n in hits)])
            spans = self.places(raw.decode("utf-8", "replace"), hits)
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {x[2] for x in hits})), "score": score, "hits": spans,
        }

    @staticmethod
    def places(text: str, hits: list) -> list[dict]:
        """Hits as spans of code points in the text itself, widened to whole words."""
        found = [m.span() for m in regex.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        offsets, at = [], 0
        for a, b in found:
            offsets.append(at)
            at += b - a + 1
        out = []
        for start, end, label, edits, _ in hits:
            i, j = max(0, bisect_right(offsets, start) - 1), max(0, bisect_right(offsets, end - 1) - 1)
            out.append({"label": label, "start": found[i][0], "end": found[j][1], "edits": edits})
        return out


@functools.lru_cache(4)
def scanner(notices: tuple) -> Scanner:
    return Scanner(notices)


def scan_documents(docs: DataFrame, notices: tuple = NOTICES) -> DataFrame:
    """doc_id, word counts, base places, labels, score and the spans of fuzzy hits."""
    ddl = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, hits array<struct<label:string,start:int,end:int,edits:int>>"
    names = [f.split()[0] for f in ddl.split(", ")]

    def run(texts: list[bytes]) -> list:
        got = [scanner(notices).scan(t) for t in texts]
        return [[x[c] for x in got] for c in names]

    return map_texts(docs, run, ddl)


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scan_documents(table(spark, sf_dir, "documents"))
    shown = F.transform("hits", lambda h: F.concat_ws(":", h["label"], h["start"].cast("string"), h["end"].cast("string"), h["edits"].cast("string")))
    return made.withColumn("hits", F.concat_ws(",", shown))
