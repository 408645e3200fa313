"""License scans by patience alignment.

A text is compared with each template word by word. Words that occur once in both are anchors; the longest
increasing subsequence of anchors is kept, and the gaps between its members are aligned in the same way. Matched
words over the template's words is the coverage; a template is found where its coverage is that of the scan (80 %)
or more, or the template's own if it states one. The short notices state 100 %: four of their five words may be
those of another notice.

A text that covers a template lacks at most the rest of its words, so of the template's longest words, one more than
may be lacking are cues: a text without a cue is passed over. In the others, words that the template doesn't have are
left out, so words between a license's own don't matter, however many. The words that the template has once, wherever
the text has them, give the longest increasing subsequence that ends first; around it, the text is aligned. What is
before and after is searched in the same way, so several copies of a license are found. A match starts and ends at
the nearest words that give its coverage.

Nulls and texts without words match nothing. Repeated rows give repeated results. Where templates tie, all are
reported. Empty tables give empty results; templates without words are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import LOWER, map_rows, read_documents

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")

#: License notices, grants and texts by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


#: Coverage of templates that state their own: few words, most of which other notices have too.
COVERAGE = {"Apache-2.0": 1.0, "MIT": 1.0, "GPL-3.0": 1.0, "CC-BY-NC-4.0": 1.0}


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER)) if text else []


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places in a and b that patience alignment matches, in order."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
        tails: list[int] = []
        piles: list[tuple[int, int, tuple | None]] = []
        for i, j in anchors:
            k = bisect_left(tails, j)
            node = (i, j, piles[k - 1] if k else None)
            tails[k : k + 1] = [j]
            piles[k : k + 1] = [node]
        node, kept = piles[-1] if piles else None, []
        while node:
            kept.append(node[:2])
            node = node[2]
        kept.reverse()
        if kept:
            found += kept
            edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(found)


def chain(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (place in text, place in template), sorted by the first, that increases in both: the one that ends first, of the latest members."""
    tails: list[int] = []
    piles: list[tuple[int, int, tuple | None]] = []
    longest: tuple | None = None
    for i, j in places:
        k = bisect_left(tails, j)
        node = (i, j, piles[k - 1] if k else None)
        if k == len(tails):
            longest = node
        tails[k : k + 1] = [j]
        piles[k : k + 1] = [node]
    out = []
    while longest:
        out.append(longest[:2])
        longest = longest[2]
    return out[::-1]


class Template:
    """A license ready for use: its words, those that it has once, and how many must be matched."""

    def __init__(self, name: str, words: list[bytes], coverage: float):
        counts = Counter(words)
        self.name, self.words, self.distinct = name, words, set(words)
        self.place = {w: j for j, w in enumerate(words) if counts[w] == 1}
        allowed = int((1 - coverage) * len(words) + 1e-9)
        self.needed, self.cues = len(words) - allowed, []
        # Losing all cues must take more words than may be lacking.
        for word in sorted(counts, key=lambda w: (-len(w), w)):
            self.cues.append(word)
            if sum(counts[w] for w in self.cues) > allowed:
                break

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(matched words, start, end) of each place in a text's words that covers the template, in order."""
        hits = [i for i, w in enumerate(words) if w in self.distinct]
        known = [words[i] for i in hits]
        # Without a word of its own, a template is anchored at every place of its words, the first ones in the template.
        place = self.place or {w: self.words.index(w) for w in self.distinct}
        anchors = [(k, place[w]) for k, w in enumerate(known) if w in place]
        out, todo = [], [(0, len(hits))]
        while todo:
            low, high = todo.pop()
            if high - low < self.needed:
                continue
            found = chain(anchors[bisect_left(anchors, (low, -1)) : bisect_left(anchors, (high, -1))])
            if len(found) < max(1, len(place) - (len(self.words) - self.needed)):
                continue
            (first, j), (last, k) = found[0], found[-1]
            start, end = max(low, first - 2 * j - 2), min(high, last + 1 + 2 * (len(self.words) - k))
            pairs = self.tight(known, start, end)
            if len(pairs) >= self.needed:
                start, end = pairs[0][0], pairs[-1][0] + 1
                out.append((len(pairs), hits[start], hits[end - 1] + 1))
                todo += [(low, start), (end, high)]
            else:
                # Not one license: go on at both sides of the widest gap.
                wide = max(range(len(found)), key=lambda x: hits[found[x][0]] - (hits[found[x - 1][0]] if x else hits[low] - 1))
                at = found[wide][0]
                todo += [(low, at), (at, high)] if at > low else [(low + 1, high)]
        return sorted(out, key=lambda m: m[1])

    def tight(self, known: list[bytes], start: int, end: int) -> list[tuple[int, int]]:
        """The alignment of known[start:end], from the last start and to the first end that lose no word of it."""
        pairs = [(start + i, j) for i, j in align(known[start:end], self.words)]
        for side in (0, -1):
            while len(pairs) > 1:
                a, b = (pairs[1][0], pairs[-1][0] + 1) if side == 0 else (pairs[0][0], pairs[-2][0] + 1)
                less = [(a + i, j) for i, j in align(known[a:b], self.words)]
                if len(less) < len(pairs):
                    break
                pairs = less
        return pairs


class Scanner:
    """Templates by their cues."""

    def __init__(self, templates: dict[str, str], coverage: float, own: dict[str, float]):
        self.templates, self.cues = [], {}
        for name, text in templates.items():
            words = words_of(text)
            if words:
                template = Template(name, words, own.get(name, coverage))
                for cue in template.cues:
                    self.cues.setdefault(cue, []).append(len(self.templates))
                self.templates.append(template)

    def scan(self, text: str | None) -> list[dict]:
        """Matches by place: license, coverage, start and end (words, end exclusive)."""
        words, out = words_of(text), []
        for t in sorted({t for cue in self.cues.keys() & set(words) for t in self.cues[cue]}):
            template = self.templates[t]
            out += [{"license": template.name, "coverage": n / len(template.words), "start": start, "end": end} for n, start, end in template.matches(words)]
        return sorted(out, key=lambda m: (m["start"], m["license"]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | DataFrame | None = None, coverage: float = 0.8, own: dict[str, float] | None = None) -> DataFrame:
    """Columns id, matches (license, coverage, start, end) for each row of docs.

    templates are texts by name, or a table with the columns license and text, which goes to all tasks; own are
    coverages of templates that differ from the others'.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if isinstance(templates, DataFrame):
        templates = {r["license"]: r["text"] for r in templates.select("license", "text").collect()}
    own = COVERAGE if templates is None and own is None else own or {}
    templates = TEMPLATES if templates is None else templates

    def per_row():
        scanner = Scanner(templates, coverage, own)
        return lambda key, text: (key, scanner.scan(text))

    return map_rows(docs.select(id_col, text_col), per_row, f"`{id_col}` {kind}, matches array<struct<license:string,coverage:double,start:int,end:int>>")


def op10_patience_licenses(spark, sf_dir: str) -> DataFrame:
    """Licenses in every document, with the best coverage."""
    x = scan_licenses(read_documents(spark, sf_dir))
    named = F.transform("matches", lambda m: F.concat_ws(":", m["license"], F.format_number(m["coverage"], 4), m["start"].cast("string"), m["end"].cast("string")))
    return x.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("best_coverage"), F.array_join(named, ",").alias("licenses"))
