"""License scan: patience alignment of documents with license templates.

Both sides are lower-cased words. In a document, a template's words are first gathered into runs, which end
where the next template word is further away than the template is long. Of a template that may lack m words,
the m + 1 words that are rarest in the run are seeds: a notice that reaches the least coverage has one of them.
Each place of a seed gives a region: where the template would lie, and half its length
around it; so repeated notices have regions of their own. Each region is aligned: the words that are unique to both sides are anchors, their longest increasing subsequence is
kept, and the gaps between kept anchors are aligned in the same way; where a gap has no anchors, its
equal words at both ends are matched. Coverage is the share of the template's words that are matched.
A notice of fewer than SHORT words must be matched in full, and the words that tell a license from others (REQUIRED)
must stand in the document one after another; a license's bare name (NAMES) as a whole. An SPDX identifier may go on as an expression,
whose further identifiers are findings too. A short notice that is denied ("not under the ...") is none. All findings of a document are returned; one that takes half of its words from findings
with more matched words is none.

Edge cases: a null or blank text has no words and no license; an empty table gives no rows; equal rows get equal results; a very long
text is scanned whole; of equal coverage, the longer template and
then the first by name wins; of equal regions, the first; rows are scanned one by one; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Identifiers of the SPDX list.
IDS = (
    "MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "Apache-1.1", "MPL-1.1", "MPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "EPL-2.0", "BSL-1.0", "Unlicense",
    "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0",
    "BSD-4-Clause", "Artistic-2.0", "WTFPL", "EUPL-1.2", "EPL-1.0", "LGPL-3.0", "GFDL-1.3", "OFL-1.1", "PostgreSQL", "PSF-2.0", "MS-PL", "CDDL-1.0",
)
_GNU = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}
_CREATIVE = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}


def _names() -> list[str]:
    """What licenses are called, by rules for each family; case and punctuation do not count."""
    out = ["MIT No Attribution", "zlib License", "Mozilla Public License", "Eclipse Public License", "Boost Software License", "ISC License", "Apache License", "Artistic License", "The Unlicense", "SIL Open Font License"]
    out += [form.format(v) for v in ("1.1", "2.0") for form in ("Apache License {}", "Apache License, Version {}", "Apache {} License", "MPL {}")]
    out += [form.format(k) for k in (2, 3, 4) for form in ("BSD {}-Clause", "{}-Clause BSD")]
    for short, long in _GNU.items():
        out += [f"GNU {long} Public License", f"GNU {short}", f"{short} License"]
        out += [form.format(short, v) for v in ("2", "2.1", "3") for form in ("{}v{}", "{} v{}", "{} version {}")]
    for short, long in _CREATIVE.items():
        out += [f"Creative Commons {long}", *(f"CC {short} {v}" for v in ("1.0", "2.0", "2.5", "3.0", "4.0"))]
    return out + [f"license: {name}" for name in IDS]


#: Names by the name of their template.
NAMES = {"-".join(re.findall(r"\w+", name.lower())) + "-name": name for name in _names()}
#: Notices of well-known licenses. Version numbers are left out, as they differ.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-notice": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "gpl-notice": "This work is licensed under the GNU General Public License, version",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "Licensed under CC BY-NC",
    "apache-notice-bare": "Licensed under the Apache License",
    "mit-notice-bare": "under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-notice": "under the ISC License",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "gpl-notice-bare": "licensed under the GNU General Public License",
    "lgpl-notice": "licensed under the GNU Lesser General Public License",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
    "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-notice": "licensed under the GNU Affero General Public License",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-notice": "Licensed under the Mozilla Public License",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-notice": "Licensed under the Eclipse Public License",
    "boost-notice": "Distributed under the Boost Software License",
    "unlicense-grant": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsd-notice": "under the BSD License",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
    "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc0-notice": "Licensed under CC0",
    "mit-notice-name": "MIT License",
    **{f"{name.lower()}-spdx": f"SPDX-License-Identifier: {name}" for name in IDS},
    **{f"cc-{kind}-notice": f"Licensed under CC {kind.upper()}" for kind in ("by", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd")},
    **{
        f"cc-{kind}-name": f"under a Creative Commons {name}"
        for kind, name in _CREATIVE.items()
    },
    **NAMES,
}
#: By the first part of a template's name: words that tell its license from others, one after another in the document.
REQUIRED = {
    "apache": "apache license", "gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license",
    "mpl": "mozilla public license", "epl": "eclipse public license", "boost": "boost software license",
}
#: Also required of notices of these licenses.
REQUIRED_NOTICE = {"mit": "mit license", "isc": "isc license", "bsd": "bsd license"}
#: Words that may stand between a denial and the notice that it denies, and denials.
LEAD, DENIED = frozenset("a an any licensed distributed released available covered of terms the this under".split()), frozenset("neither never no nor not isn't aren't".split())
#: Words that an exception in an SPDX expression has at most.
EXCEPTION = 6
#: Templates of fewer words must be matched in full.
SHORT = 20
MIN_COVERAGE = 0.8
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    piles: list[int] = []
    tops: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = piles[k - 1] if k else -1
        if k == len(piles):
            piles.append(i)
            tops.append(v)
        else:
            piles[k], tops[k] = i, v
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (i, j) of a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        once_a, once_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        where = {w: j for j, w in enumerate(b[j0:j1], j0) if once_b[w] == 1}
        common_words = [(i, where[w]) for i, w in enumerate(a[i0:i1], i0) if once_a[w] == 1 and w in where]
        if common_words:
            kept = [common_words[k] for k in longest_increasing([j for _, j in common_words])]
            out += kept
            edges = [(i0 - 1, j0 - 1), *kept, (i1, j1)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
            continue
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            out.append((i1 - 1, j1 - 1))
            i1, j1 = i1 - 1, j1 - 1
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, least: float = MIN_COVERAGE):
        self.name, self.words = name, words_of(text)
        self.vocabulary = frozenset(self.words)
        #: Words that a notice may lack.
        self.missing = len(self.words) - ceil(least * len(self.words) - 1e-9) if len(self.words) >= SHORT else 0
        first = name.split("-")[0]
        phrase = words_of(REQUIRED.get(first) or REQUIRED_NOTICE.get(first if "-notice" in name else ""))
        if name.endswith("-spdx") or name in NAMES:
            phrase = self.words
        elif first == "cc":
            phrase = self.words[self.words.index("under") + 1 :]
        #: Places in the template of the words that tell it from others.
        self.required = next((range(k, k + len(phrase)) for k in range(len(self.words)) if phrase and self.words[k : k + len(phrase)] == phrase), range(0))
        self.least_words = len(self.vocabulary) - self.missing

    def regions(self, words: list[str], hits: list[int]) -> Iterator[tuple[int, int]]:
        """Spans of words that may hold the template; hits: places of any template's words."""
        own = [i for i in hits if words[i] in self.vocabulary]
        size, slack = len(self.words), max(2, len(self.words) // 2)
        start = 0
        for end in range(1, len(own) + 1):
            if end < len(own) and own[end] - own[end - 1] <= size:
                continue
            run = own[start:end]
            start = end
            places: dict[str, list[int]] = {}
            for i in run:
                places.setdefault(words[i], []).append(i)
            if len(places) < self.least_words:
                continue
            seeds = sorted(range(size), key=lambda j: (len(places.get(self.words[j], ())), j))[: self.missing + 1]
            for at in sorted({i - j for j in seeds for i in places.get(self.words[j], ())}):
                yield max(0, at - slack), at + size + slack

    def holds(self, matched: list[tuple[int, int]]) -> bool:
        """Whether enough words are matched, the required ones in places that follow each other."""
        if len(matched) < len(self.words) - self.missing or not matched:
            return False
        place = {j: i for i, j in matched}
        at = [place.get(j) for j in self.required]
        return not at or (at[0] is not None and at == list(range(at[0], at[0] + len(at))))

    def found(self, words: list[str], hits: list[int]) -> Iterator[list[int]]:
        """Matched places of words, for each region that holds the template."""
        size, slack = len(self.words), max(2, len(self.words) // 2)
        for a, b in self.regions(words, hits):
            exact = b - size - slack
            if exact >= 0 and words[exact : exact + size] == self.words:
                yield list(range(exact, exact + size))
            elif len(self.vocabulary.intersection(words[a:b])) >= self.least_words:  # else more words are missing than may be
                matched = align(words[a:b], self.words)
                if self.holds(matched):
                    yield [a + i for i, _ in matched]


def denied(words: list[str], first: int) -> bool:
    """Whether the words before a notice say that it does not hold; `isn't` is two words here."""
    i = first - 1
    while i >= 0 and words[i] in LEAD:
        i -= 1
    return i >= 0 and (words[i] in DENIED or (words[i] == "t" and i > 0 and f"{words[i - 1]}'t" in DENIED))


def expression(words: list[str], end: int, known: dict[tuple[str, ...], str]) -> Iterator[tuple[int, int, str]]:
    """(first, end, template) of the identifiers with which an SPDX expression goes on at `end`; known: templates by their identifier's words."""
    while end < len(words) and words[end] in ("or", "and", "with"):
        if words[end] == "with":
            end = next((i for i in range(end + 2, min(end + 2 + EXCEPTION, len(words))) if words[i] in ("or", "and")), len(words))
            continue
        fitting = [w for w in known if tuple(words[end + 1 : end + 1 + len(w)]) == w]
        if not fitting:
            return
        first, longest = end + 1, max(fitting, key=len)
        end = first + len(longest)
        yield first, end, known[longest]


def find_licenses(text: str | None, templates: list[Template], least: float = MIN_COVERAGE) -> tuple[int, list[tuple]]:
    """Number of words, and license, coverage, matched words, first and end word and version of all findings in the order of their places."""
    words = words_of(text)
    present = frozenset(words)
    likely = [t for t in templates if (len(t.vocabulary & present) >= t.least_words if t.missing else t.vocabulary <= present)]
    every = frozenset().union(*(t.vocabulary for t in likely))
    hits = [i for i, w in enumerate(words) if w in every]
    found = [(-len(at), at[-1] - at[0], at[0], t.name, len(at) / len(t.words), at) for t in likely for at in t.found(words, hits)]
    taken: set[int] = set()
    out = []
    for n, _, first, name, coverage, at in sorted(found, key=lambda f: (not f[3].endswith("-spdx"), f)):
        if coverage >= least and 2 * sum(i in taken for i in at) < -n:
            taken.update(at)
            if -n < SHORT and denied(words, first):
                continue
            out.append((name, coverage, -n, first, at[-1] + 1, version_of(words, first, at[-1] + 1)))
            if name.endswith("-spdx"):
                ids = {tuple(t.words[3:]): t.name for t in templates if t.name.endswith("-spdx")}
                for i, end, more in expression(words, at[-1] + 1, ids):
                    taken.update(range(i, end))
                    out.append((more, 1.0, end - i, i, end, None))
    return len(words), sorted(out, key=lambda f: (f[3], f[4], f[0]))


def find_license(text: str | None, templates: list[Template], least: float = MIN_COVERAGE) -> tuple:
    """Number of words, and license, coverage, matched words, first and end word and version of the best finding."""
    n, found = find_licenses(text, templates, least)
    return n, *best_of(found, {t.name: len(t.words) for t in templates})


def best_of(found: list[tuple], sizes: dict[str, int]) -> tuple:
    return min(found, key=lambda f: (-f[1], -sizes[f[0]], f[0], f[3]), default=(None, 0.0, 0, 0, 0, None))


def version_of(words: list[str], first: int, end: int) -> str | None:
    """The version that a notice names: numbers after `version` or `v` inside it or just behind it, or right after its end."""
    for i in range(first, min(end + 3, len(words))):
        at = i + 1 if words[i] in ("version", "v") else end if i == end else -1
        if at >= 0:
            digits = []
            while at < len(words) and len(digits) < 2 and words[at].isdecimal() and len(words[at]) < 3 - len(digits):
                digits.append(words[at])
                at += 1
            if digits:
                return ".".join(digits)
    return None


_FINDING = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("version", pa.string())])
_FIELDS = "license string, coverage double, n_matched bigint, first_word bigint, end_word bigint, version string"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, n_words, the best finding's license, coverage, n_matched, first_word, end_word, version, and all findings, for each row of docs."""
    texts = templates or TEMPLATES

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(n, t, least) for n, t in sorted(texts.items())]
        sizes = {t.name: len(t.words) for t in known}
        names = [f.name for f in _FINDING]
        for batch in batches:
            rows = [find_licenses(t, known, least) for t in batch.column("text").to_pylist()]
            best = [best_of(found, sizes) for _, found in rows]
            columns = [pa.array([b[k] for b in best], f.type) for k, f in enumerate(_FINDING)]
            every = pa.array([[dict(zip(names, f, strict=True)) for f in found] for _, found in rows], pa.list_(_FINDING))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), *columns, every], ["doc_id", "n_words", *names, "findings"])

    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id bigint, n_words bigint, {_FIELDS}, findings array<struct<{_FIELDS}>>")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices of every document, the best one in columns of its own."""
    return scan_licenses(common.documents(spark, sf_dir))
