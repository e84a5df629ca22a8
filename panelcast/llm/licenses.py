"""License scans: where and how much of each license template a text holds, by patience alignment.

A template is found where at least ``LEAST_COVERAGE`` of its words align, in order, with a stretch of the
text. Such a stretch misses at most a fifth of the template's words, so of any larger set of template
places at least one is matched. The scan takes the set whose words are rarest in the text: if none of them
occurs, the template is not there and nothing is aligned; else every place of such a word says where the
template would begin, and the stretch around it is aligned.

Phrases that differ from others in a single word (``PHRASES``) are found only word by word.

``licenses`` has the best stretch of each template. ``stretches`` reads the text once more as parts that do not overlap: the
stretches of all templates are taken best first, and a template that lost a stretch to a better one is aligned again with what
is free around it. So a notice that occurs twice is there twice, and a part of the text names one template.

Words are runs of letters and digits with A-Z in lower case. Spans count words, the end excluded.

Defined results: null, empty and blank text holds no template; of stretches with equal coverage the
shortest counts, then the first; of templates with equal coverage the longest, then the first by name, names the document;
repeated rows are scanned once each; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from panelcast.llm.decontaminate import item_words as words_of
from panelcast.llm.patience import align
from panelcast.llm.text import as_bytes, map_rows

LEAST_COVERAGE = 0.8

#: Notices as they are commonly written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission."),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
        "rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "GPL-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions:"),
    "rights-reserved": "All rights reserved.",
}

#: Identifiers of the licenses whose tags are looked for.
TAGGED = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)

#: Notices that hold word by word only.
PHRASES = {
    **{f"SPDX:{name}": f"SPDX-License-Identifier: {name}" for name in TAGGED},
    "CC-BY-4.0": "licensed under CC BY 4.0",
    "CC-BY-4.0-name": "Creative Commons Attribution 4.0 International",
    "CC-BY-SA-4.0": "licensed under CC BY-SA 4.0",
    "CC-BY-SA-4.0-name": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-NC-4.0-name": "Creative Commons Attribution-NonCommercial 4.0 International",
}


@dataclass(frozen=True)
class Found:
    name: str
    coverage: float
    start: int
    end: int
    length: int


def _rank(found: Found) -> tuple:
    """Better stretches first: more coverage, longer templates, then shorter and earlier stretches."""
    return -found.coverage, -found.length, found.end - found.start, found.start, found.name


def _tight(text: list[bytes], matched: list[bytes], end: int) -> tuple[int, int]:
    """The stretch that the matched words need, each as late as it can be before ``end`` and then as early as it can be."""
    start = end
    for word in reversed(matched):
        start -= 1
        while text[start] != word:
            start -= 1
    end = start
    for word in matched:
        while text[end] != word:
            end += 1
        end += 1
    return start, end


class Template:
    """``whole`` templates are found word by word only, without other words between."""

    def __init__(self, name: str, text: str, least: float = LEAST_COVERAGE, whole: bool = False) -> None:
        self.name, self.words, self.least, self.whole = name, words_of(text.encode()), 1.0 if whole else least, whole
        least = self.least
        self.needed = -int(-least * len(self.words) // 1)
        self.slack = 1 + len(self.words) - self.needed
        self.places: dict[bytes, list[int]] = defaultdict(list)
        for j, word in enumerate(self.words):
            self.places[word].append(j)

    def starts(self, where: dict[bytes, list[int]]) -> set[int]:
        """Where in the text the template could begin; of at least ``slack`` places, one must be matched."""
        if sum(len(js) for w, js in self.places.items() if w not in where) >= self.slack:
            return set()
        left, out = self.slack, set()
        for word in sorted(self.places, key=lambda w: (len(where.get(w, ())), w)):
            if left <= 0:
                break
            left -= len(self.places[word])
            out.update(p - j for p in where.get(word, ()) for j in self.places[word])
        return out

    def within(self, text: list[bytes], low: int, high: int) -> Found | None:
        """What the words from ``low`` to ``high`` cover, if it is enough."""
        pairs = align(text[low:high], self.words)
        if len(pairs) < self.needed:
            return None
        start, end = _tight(text, [self.words[j] for _, j in pairs], low + pairs[-1][0] + 1)
        if self.whole and end - start > len(self.words):
            return None
        return Found(self.name, len(pairs) / len(self.words), start, end, len(self.words))

    def reach(self, start: int) -> tuple[int, int]:
        """Where the words of a template that begins at ``start`` can be."""
        around = 0 if self.whole else self.slack
        return max(0, start - around), max(0, start + len(self.words) + around)

    def all(self, text: list[bytes], where: dict[bytes, list[int]]) -> list[tuple[int, Found]]:
        """Each place where the template could begin, with the stretch around it that covers enough."""
        found = ((start, self.within(text, *self.reach(start))) for start in sorted(self.starts(where)))
        return [(start, f) for start, f in found if f]

    def find(self, text: list[bytes], where: dict[bytes, list[int]]) -> Found | None:
        """The stretch that covers most of the template, if one covers enough."""
        return min((f for _, f in self.all(text, where)), key=_rank, default=None)


class _Parts:
    """Parts of a text that do not overlap."""

    def __init__(self) -> None:
        self.taken: list[tuple[int, int, Found]] = []

    def around(self, place: int) -> tuple[int, float]:
        """The free words around a place that no part holds."""
        i = bisect_left(self.taken, (place + 1,))
        return self.taken[i - 1][1] if i else 0, self.taken[i][0] if i < len(self.taken) else float("inf")

    def add(self, found: Found) -> bool:
        low, high = self.around(found.start)
        if found.start < low or found.end > high:
            return False
        self.taken.insert(bisect_left(self.taken, (found.start,)), (found.start, found.end, found))
        return True


def parts(text: list[bytes], found: Iterable[tuple[Template, int, Found]]) -> list[Found]:
    """Stretches that do not overlap, best first; what lost its place is aligned again with the free words there."""
    out, lost = _Parts(), []
    for template, start, f in sorted(found, key=lambda x: _rank(x[2])):
        if not out.add(f):
            lost.append((template, start))
    for template, start in lost:
        low, high = template.reach(start)
        free = out.around(max(0, start))
        again = template.within(text, max(low, free[0]), int(min(high, free[1], len(text))))
        if again:
            out.add(again)
    return [f for _, _, f in out.taken]


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> None:
        made = [Template(name, text, least) for name, text in sorted((templates or TEMPLATES).items())]
        if templates is None:
            made += [Template(name, text, whole=True) for name, text in PHRASES.items()]
        self.templates = [t for t in made if t.words]
        self.words = {word for t in self.templates for word in t.words}

    def scan(self, text: bytes | None) -> list[Found]:
        """Templates that the text holds, the one with most coverage first."""
        return self.scan_all(text)[0]

    def scan_all(self, text: bytes | None) -> tuple[list[Found], list[Found]]:
        """The best stretch of each template, and all stretches that do not overlap in order."""
        tokens = words_of(text)
        where: dict[bytes, list[int]] = {w: [] for w in self.words.intersection(tokens)}
        if not where:
            return [], []
        for i, word in enumerate(tokens):
            if word in where:
                where[word].append(i)
        found = [(t, start, f) for t in self.templates for start, f in t.all(tokens, where)]
        best: dict[str, Found] = {}
        for _, _, f in found:
            if f.name not in best or _rank(f) < _rank(best[f.name]):
                best[f.name] = f
        return sorted(best.values(), key=lambda f: (-f.coverage, -f.length, f.name)), parts(tokens, found)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """Add the best ``license`` with its ``coverage`` and span, and as ``name:start:end`` all ``licenses``, each at its
    best stretch, and all ``stretches`` that do not overlap, in order."""
    scanner = Scanner(templates, least)

    def of_batch(batch: pa.RecordBatch) -> list:
        scans = [scanner.scan_all(t) for t in as_bytes(batch.column("text"))]
        found = [f for f, _ in scans]
        first = [f[0] if f else Found(None, 0.0, None, None, 0) for f in found]
        return [[f.name for f in first], [f.coverage for f in first], [f.start for f in first], [f.end for f in first],
                *[[",".join(f"{x.name}:{x.start}:{x.end}" for x in s[k]) for s in scans] for k in (0, 1)]]

    return map_rows(
        docs, of_batch,
        "license string, coverage double, start_word bigint, end_word bigint, licenses string, stretches string")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).drop("text")
