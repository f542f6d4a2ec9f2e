"""License scan by conditional compression.

A text is cut at line and sentence ends. Runs of adjoining pieces that have enough of a template's words to differ from
it in DIFFERENT of them are candidate blocks, so a notice may stand inside a line of prose or be wrapped over lines. A
text goes to this step if it has a key word of some template: one more of its longest words than it may differ in, so
that no text within DIFFERENT of the template is without one. Each is compressed with zstandard alone and with each template as a raw-content
dictionary, both in lower case; the size reduction says how much of the block the template already holds, and must reach LEAST_REDUCTION
of what the template saves on its own text. The BEST templates by reduction are confirmed by exact wording: the words that have to
be changed, added or left out for the block to hold the template, DIFFERENT of its words at most.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

BEST = 3
DIFFERENT = 0.15
LEAST_REDUCTION = 0.2
# fixed values: licence notices and the licences they stand for
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)
# fixed values: words that tell licences apart
TELLING = {
    "apache", "mit", "gnu", "gpl", "lgpl", "agpl", "lesser", "library", "affero", "bsd", "mozilla", "mpl", "eclipse", "creative", "commons", "cc", "by", "nc", "sa", "nd", "cc0",
    "attribution", "noncommercial", "sharealike", "noderivatives", "noderivs", "artistic", "boost", "unlicense", "isc", "zlib",
}
_VERSION = re.compile(r"v?\d+(?:\.\d+)*")
_TOKEN = re.compile(r"\w+(?:[.-]\w+)*")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")


def pieces(text: str) -> Iterator[tuple[int, int, int]]:
    """(line number, start, end) of each sentence of each line; offsets in code points."""
    at = 0
    for n, line in enumerate(text.split("\n")):
        cuts = [0, *(m.end() for m in _SENTENCE.finditer(line)), len(line)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s < e:
                yield n, at + s, at + e
        at += len(line) + 1


def telling(words: list[str]) -> Counter:
    """The words, or parts of hyphenated ones, that tell licences apart; versions without a leading v or trailing zeros."""
    out: Counter = Counter()
    for w in words:
        for part in w.split("-"):
            if _VERSION.fullmatch(part):
                out[re.sub(r"(?:\.0)+$", "", part.lstrip("v"))] += 1
            elif part in TELLING and (part != "by" or "-" in w):
                out[part] += 1
    return out


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        import zstandard

        self.templates = [(name, t, _TOKEN.findall(t.lower())) for name, t in templates]
        # a confirmed window is no longer than this in words, so no run needs more between its first and last piece
        self.longest = max((len(w) for _, _, w in self.templates), default=0) * (1 + DIFFERENT)
        self.counts = [Counter(w) for _, _, w in self.templates]
        self.holders: dict[str, list[int]] = {}
        for i, c in enumerate(self.counts):
            for w in c:
                self.holders.setdefault(w, []).append(i)
        # words that differ cost one each at least, so these can't all be absent
        keys = {w for c, (_, _, ws) in zip(self.counts, self.templates, strict=True) for w in sorted(c, key=lambda w: (-len(w), w))[: int(DIFFERENT * len(ws)) + 1]}
        self.key = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(keys))) + r")(?!\w)", re.I)
        self.memo: dict[str, tuple | None] = {}
        self.plain = zstandard.ZstdCompressor(level=9)
        self.given = [zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in templates]
        sizes = [(len(self.plain.compress(t.lower().encode())), len(c.compress(t.lower().encode()))) for c, (_, t) in zip(self.given, templates, strict=True)]
        self.saves = [max(1, alone - given) for alone, given in sizes]

    def differences(self, block: list[str], template: list[str]) -> int | None:
        """Words to change for the best window of the block to read as the template; None if one of them tells licences apart."""
        match = difflib.SequenceMatcher(None, block, template, autojunk=False)
        pieces = [m for m in match.get_matching_blocks() if m.size]
        if not pieces:
            return None
        first, last = pieces[0], pieces[-1]
        # what stands in place of the template's first and last words belongs to the window too
        window = block[max(0, first.a - first.b) : last.a + len(template) - last.b]
        if telling(window) != telling(template):
            return None
        inside = last.a + last.size - first.a
        same = sum(m.size for m in pieces)
        return max(len(template), inside) - same

    def match(self, block: str) -> tuple[str, float, int, int] | None:
        """(licence, reduction, differing words, words of the template) of the confirmed template with fewest differences for its length."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        ranked = sorted((((alone - len(c.compress(raw))) / alone, -i) for i, c in enumerate(self.given)), reverse=True)[:BEST]
        words, found = _TOKEN.findall(block.lower()), []
        for reduction, i in ranked:
            name, _, template = self.templates[-i]
            wrong = self.differences(words, template)
            if wrong is not None and reduction * alone >= LEAST_REDUCTION * self.saves[-i] and wrong <= DIFFERENT * len(template):
                found.append((wrong / len(template), -len(template), name, round(reduction, 6), wrong, len(template)))
        return min(found)[2:] if found else None

    def blocks(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(line, start, end, words) of the runs of pieces that may be within DIFFERENT of a template."""
        keys = [m.start() for m in self.key.finditer(text)]
        if not keys:
            return
        cut = list(pieces(text))
        words = [_TOKEN.findall(text[s:e].lower()) for _, s, e in cut]
        has = [{i for w in set(ws) for i in self.holders.get(w, ())} for ws in words]
        for i, (n, s, _) in enumerate(cut):
            have = [0] * len(self.templates)
            count, inside = Counter(), 0
            for j in range(i, len(cut)):
                if j > i + 1:
                    inside += len(words[j - 1])
                if inside > self.longest or not has[i]:
                    break
                for w in words[j]:
                    count[w] += 1
                    for t in self.holders.get(w, ()):
                        have[t] += count[w] <= self.counts[t][w]
                e = cut[j][2]
                # both end pieces must have words of the template, else a shorter run serves as well
                if any(have[t] >= (1 - DIFFERENT) * len(self.templates[t][2]) for t in has[i] & has[j]) and (k := bisect.bisect_left(keys, s)) < len(keys) and keys[k] < e:
                    yield n, s, e, sum(map(len, words[i : j + 1]))

    def notices(self, text: str | None) -> list[tuple[int, int, int, tuple[str, float, int]]]:
        """(line, start, end, match) of the confirmed notices in order; of blocks that overlap the closest, then the shortest, stays."""
        found = []
        for n, s, e, size in self.blocks(text) if text else ():
            block = text[s:e]
            if block not in self.memo:
                if len(self.memo) > 20_000:
                    self.memo.clear()
                self.memo[block] = self.match(block)
            if self.memo[block]:
                *match, length = self.memo[block]
                found.append((match[2] / length, -length, size, s, e, n, tuple(match)))
        taken: list[tuple[int, int, int, tuple[str, float, int]]] = []
        for *_, s, e, n, match in sorted(found, key=lambda f: f[:5]):
            if all(e <= a or s >= b for _, a, b, _ in taken):
                taken.append((n, s, e, match))
        return sorted(taken, key=lambda t: t[1])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, line, start, end, license, reduction, differing_words, exact): a row for each confirmed notice.

    Null and empty texts have none. Repeated rows repeat their notices; other columns are ignored, whatever their
    names. Offsets are code points of the block.
    """

    names = ("doc_id", "line", "start", "end", "license", "reduction", "differing_words", "exact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scanner = Scanner(templates)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                out += [(doc_id, n, s, e, *match, match[2] == 0) for n, s, e, match in scanner.notices(text)]
            yield {c: [r[i] for r in out] for i, c in enumerate(names)}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, line int, start long, end long, license string, reduction double, differing_words int, exact boolean")
