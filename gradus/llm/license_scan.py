"""Find licence texts and notices in documents: Dice coefficient of word bigrams against templates, pruned by size.

A segment is a line, a paragraph of several lines, or a window of words anywhere in the text, across lines too. With d
the least coefficient, a template of t bigrams can only match a segment of s bigrams if d / (2 - d) * t <= s <=
(2 - d) / d * t, so most lines are left after counting their words, and the others meet only templates within these
bounds that share a bigram. A window must hold d / (2 - d) * t bigrams of the template, so most texts are left after
counting those of the whole text; a best window begins and ends with one of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from math import ceil

from pyspark.sql import DataFrame

from .arrow import in_slices, over_batches

LEAST = 0.8
#: Wordings of public licences and the short notices that name them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "reserved": ["All rights reserved."],
}
_WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_GAP = re.compile(r"\n[ \t\r\f\v]*\n")


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Pairs of neighbouring words in lower case, without punctuation around them."""
    words = _WORDS.findall(text.lower())
    return frozenset(zip(words, words[1:]))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def _natural(text: str) -> Iterator[tuple[int, int, str]]:
    """Number of the first line, place and text of every line, and of every paragraph of more than one line.

    Blank lines around a paragraph belong to none, so a single line with a line break after it is no paragraph.
    """
    line = 0
    at = 0
    for gap in [*_GAP.finditer(text), None]:
        paragraph = text[at:gap.start() if gap else len(text)]
        lines = paragraph.split("\n")
        filled = [k for k, one in enumerate(lines) if one.strip()]
        if len(filled) > 1:
            yield line + filled[0], at, paragraph
        for k, one in enumerate(lines):
            yield line + k, at, one
            at += len(one) + 1
        if gap:
            line += len(lines) - 1 + gap[0].count("\n")
            at = gap.end()


def segments(text: str, known: Templates | None = None) -> Iterator[tuple[int, str]]:
    """Number of the first line and text of every line, of every paragraph of more than one line, and of matching windows.

    A window is left out inside a line or paragraph that matches itself, and where it overlaps one of its own licence.
    """
    known = known or _public()
    windows = known.windows(text)
    taken = []
    for line, at, segment in _natural(text):
        yield line, segment
        if windows and (names := {name for _, name in known.matches(segment)}):
            taken.append((at, at + len(segment), names))
    for first, last, name in windows:
        if not any(a <= first and last <= b or a < last and first < b and name in names for a, b, names in taken):
            yield text.count("\n", 0, first), text[first:last]


class Templates:
    """Templates by size, and by bigram."""

    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least = least
        self.all = sorted(((len(b), name, b) for name, texts in templates.items() for b in map(bigrams, texts)), key=lambda t: (t[0], t[1]))
        self.sizes = [t[0] for t in self.all]
        self.low, self.high = self.sizes[0] * least / (2 - least) - 1e-9, self.sizes[-1] * (2 - least) / least + 1e-9
        self.bigrams = frozenset().union(*(t[2] for t in self.all))
        self.owners = defaultdict(list)
        for k, (_, _, template) in enumerate(self.all):
            for pair in template:
                self.owners[pair].append(k)

    def matches(self, text: str) -> Iterator[tuple[float, str]]:
        pairs = bigrams(text)
        if not self.low <= len(pairs) <= self.high or pairs.isdisjoint(self.bigrams):
            return
        first = bisect_left(self.sizes, len(pairs) * self.least / (2 - self.least) - 1e-9)
        last = bisect_right(self.sizes, len(pairs) * (2 - self.least) / self.least + 1e-9)
        for _, name, template in self.all[first:last]:
            score = dice(pairs, template)
            if score >= self.least:
                yield score, name

    def windows(self, text: str) -> list[tuple[int, int, str]]:
        """First and last place and licence of windows that match, none overlapping another: the best first.

        A window has at most (2 - d) / d times as many words as its template has bigrams.
        """
        lower = text.lower()
        if len(lower) != len(text):  # places must be those of the text
            lower = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        words = _WORDS.findall(lower)
        pairs = list(zip(words, words[1:]))
        present = Counter(k for pair in self.bigrams.intersection(pairs) for k in self.owners[pair])
        found = []
        for k, shared in present.items():
            size, name, template = self.all[k]
            needed, longest = ceil(size * self.least / (2 - self.least) - 1e-9), int(size * (2 - self.least) / self.least + 1e-9)
            if shared < needed:
                continue
            hits = [p for p, pair in enumerate(pairs) if pair in template]
            for i, first in enumerate(hits):
                end = bisect_left(hits, first + longest)
                if end - i < needed:
                    continue
                inside, both, best = set(), 0, (0.0, 0)
                for p in range(first, hits[end - 1] + 1):
                    if pairs[p] not in inside:
                        inside.add(pairs[p])
                        both += pairs[p] in template
                        best = max(best, (2 * both / (len(inside) + size), -p))
                if best[0] >= self.least:
                    found.append((-best[0], -size, first, -best[1], name))
        if not found:
            return []
        spans = [m.span() for m in _WORDS.finditer(lower)]
        chosen, result = [], []
        for _, _, first, last, name in sorted(found):
            at = bisect_left(chosen, (first, last))
            # pairs of neighbouring windows may share no word
            if (at == 0 or chosen[at - 1][1] + 1 < first) and (at == len(chosen) or last + 1 < chosen[at][0]):
                insort(chosen, (first, last))
                result.append((spans[first][0], spans[last + 1][1], name))
        return result


@cache
def _public() -> Templates:
    return Templates(TEMPLATES, LEAST)


def scan_licenses(df: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_matches (matching segments), license and dice of the best match, and its line, for every row.

    Of equal matches the first in the text counts, then the first name. Without a match n_matches is 0 and the rest is
    null; so it is for null and empty texts. One scan without shuffle; other columns are not read; repeated rows are
    scanned each on their own. Memory follows the longest single text. The templates are a few and go with the task.
    """
    known = TEMPLATES if templates is None else templates

    def run(source) -> Iterator[dict]:
        prepared = Templates(known, least)
        for batch in source:
            for part in in_slices(batch, text_col):
                rows = []
                for text in part.column(text_col).to_pylist():
                    found = []
                    for line, segment in segments(text or "", prepared):
                        hits = [(-score, line, name) for score, name in prepared.matches(segment)]
                        if hits:
                            found.append(min(hits))
                    best = min(found, default=None)
                    rows.append((len(found), best[2], -best[0], best[1]) if best else (0, None, None, None))
                yield {id_col: part.column(id_col), **dict(zip(("n_matches", "license", "dice", "line"), map(list, zip(*rows)), strict=True))}

    kind = df.schema[id_col].dataType.simpleString()
    return over_batches(df, [id_col, text_col], run, f"`{id_col}` {kind}, n_matches long, license string, dice double, line long")
