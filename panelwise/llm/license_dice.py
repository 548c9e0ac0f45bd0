"""License scan: Dice coefficient over word bigrams against licence templates.

A text is normalised (lower case, runs of letters and digits as words,
copyright statements left out) and each window from a bigram of a template
to another is compared with the template: twice the shared bigrams over the
bigrams of both, repeats counted.  Windows have all the lengths that can
reach the threshold.  Size bounds prune: a text with too few bigrams, or with
too few of a template's own, can't reach it.  One pass over the texts, no
shuffle.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.shared import ship_by_value

THRESHOLD = 0.8

# Public licence notices, and the names that short notices give.
NOTICES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
}
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(what: str, name: str, version: str) -> str:
    return f"""This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} License as published
by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."""


def _gnu_only(what: str, name: str, version: str) -> str:
    return f"""This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} License version
{version} as published by the Free Software Foundation."""


def _gnu_warranty(what: str, name: str) -> str:
    return f"""This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} License for more details."""


_GNU = [("GPL-2.0", "program", "General Public", "2"), ("GPL-3.0", "program", "General Public", "3"),
        ("LGPL-2.0", "library", "Library General Public", "2"), ("LGPL-2.1", "library", "Lesser General Public", "2.1"),
        ("LGPL-3.0", "library", "Lesser General Public", "3"), ("LGPL-3.0", "program", "Lesser General Public", "3"),
        ("LGPL-2.1", "program", "Lesser General Public", "2.1"), ("AGPL-3.0", "program", "Affero General Public", "3")]
_CC = {"CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial",
       "CC-BY-ND-4.0": "Attribution-NoDerivatives", "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike",
       "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives"}
#: Notices with their disclaimers, and those of the licence families.
MORE_NOTICES = [
    ("MIT", f"{NOTICES['MIT']} {_AS_IS}"), ("ISC", f"{NOTICES['ISC']} {_ISC_AS_IS}"), ("BSD", f"{NOTICES['BSD']} {_BSD_NAMES}"),
    ("BSD", f"{NOTICES['BSD']} {_BSD_AS_IS}"), ("BSD", f"{NOTICES['BSD']} {_BSD_NAMES} {_BSD_AS_IS}"),
    ("Apache-2.0", f"{NOTICES['Apache-2.0']} See the License for the specific language governing permissions and limitations under the License."),
    *((k, _gnu(what, name, version)) for k, what, name, version in _GNU if k not in NOTICES),
    *((k, _gnu_only(what, name, version)) for k, what, name, version in _GNU),
    *((k, f"{form(what, name, version)} {_gnu_warranty(what, name)}") for k, what, name, version in _GNU for form in (_gnu, _gnu_only)),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which
is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which
accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html"""),
    ("EPL-1.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public
License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"""),
    *((k, f"This work is licensed under a Creative Commons {name} 4.0 International License.") for k, name in _CC.items()),
    *((k, f"This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license, visit "
          f"http://creativecommons.org/licenses/{k[3:-4].lower()}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.")
      for k, name in _CC.items()),
    ("CC0-1.0", """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This
work is published under the CC0 1.0 Universal public domain dedication."""),
]
NAMES = {
    "MIT": "the MIT License", "ISC": "the ISC License", "BSD": "the BSD License", "Apache-2.0": "the Apache License, Version 2.0",
    "GPL-3.0": "the GNU General Public License, version 3", "GPL-2.0": "the GNU General Public License, version 2",
    "LGPL-3.0": "the GNU Lesser General Public License, version 3", "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "MPL-2.0": "the Mozilla Public License, version 2.0", "EPL-2.0": "the Eclipse Public License, version 2.0",
    "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-ND-4.0": "CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0", "CC0-1.0": "CC0 1.0", "LGPL-2.1": "the GNU Lesser General Public License, version 2.1",
    "LGPL-2.0": "the GNU Library General Public License, version 2", "EPL-1.0": "the Eclipse Public License, version 1.0",
}
FORMS = ("Licensed under {}", "Released under {}", "This work is licensed under {}")

_WORDS = re.compile(r"[^\W_]+")
# where notices begin; a copyright statement on the same line ends there
_NOTICE = "|".join(sorted({r"\W+".join(map(re.escape, _WORDS.findall(t.lower())[:2])) for t in [*NOTICES.values(), *(t for _, t in MORE_NOTICES), *FORMS]}))
# words that follow 'copyright' in notices themselves
_NO_HOLDER = r"(?i:notices?|holders?|owners?|laws?|licen[cs]\w*|statements?|interests?|protect\w*|and|or|in)\b"
# at a line's begin: copyright word or sign with a year, sign or holder; the holder's words (up to 8) if the line ends or a notice begins after them
_COPYRIGHT = re.compile(
    rf"^[^\w\n(©]*(?:(?i:copyright)[^\w\n]*(?:\([cC]\)|©|(?=\d{{4}})|(?i:by\b)|(?=[A-Z])(?!{_NO_HOLDER}))|©|\([cC]\)(?=[^\w\n]*(?:\d{{4}}|(?i:copyright)|[A-Z][^\n]*\d{{4}})))"
    r"(?:[^\w\n]*(?:\d{4}|(?i:copyright|present))\b)*"
    rf"(?:[^\w\n]*+(?:(?!(?i:{_NOTICE})\b)\w++[^\w\n]*+){{0,8}}(?=$|(?i:{_NOTICE})\b))?", re.MULTILINE)


def normalised_words(text: str | None) -> list[str]:
    text = text or ""
    low = text.lower()
    if "copyright" in low or "©" in low or "(c)" in low:
        low = _COPYRIGHT.sub(" ", text).lower()
    return _WORDS.findall(low)


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[str, ...]

    @property
    def bigrams(self) -> Counter:
        return Counter(zip(self.words, self.words[1:]))


def standard_templates() -> list[Template]:
    short = [Template(k, tuple(normalised_words(form.format(name)))) for k, name in NAMES.items() for form in FORMS]
    return [Template(k, tuple(normalised_words(text))) for k, text in [*NOTICES.items(), *MORE_NOTICES]] + short


class LicenseScanner:
    def __init__(self, templates: list[Template], threshold: float = THRESHOLD):
        self.templates, self.threshold = templates, threshold
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in templates for w in t.words}))}
        n = len(self.vocabulary) + 1
        code = lambda a, b: self.vocabulary[a] * n + self.vocabulary[b]
        self.counts = [Counter({code(*k): v for k, v in t.bigrams.items()}) for t in templates]
        self.sizes = [sum(c.values()) for c in self.counts]
        self.known = np.array(sorted({k for c in self.counts for k in c}))
        self.members = np.array([[k in c for k in self.known] for c in self.counts])
        #: bigrams that a window has at least and at most, and shared ones in it
        self.least_size = [int(np.ceil(s * threshold / (2 - threshold) - 1e-9)) for s in self.sizes]
        self.most_size = [int(s * (2 - threshold) / threshold + 1e-9) for s in self.sizes]
        self.least_shared = [threshold * (s + m) / 2 for s, m in zip(self.sizes, self.least_size)]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """All matches, the nearest first where they overlap: license, Dice coefficient, first word and end word."""
        words = normalised_words(text)
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        pairs = ids[:-1] * (len(self.vocabulary) + 1) + ids[1:]
        place = np.searchsorted(self.known, pairs)
        hit = np.flatnonzero(self.known[np.minimum(place, len(self.known) - 1)] == pairs)
        if not len(hit):
            return []
        place = place[hit]
        near: list[tuple] = []
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for t in range(len(self.templates)):
            at = hit[self.members[t, place]]
            if len(pairs) < self.least_size[t] or len(at) < self.least_shared[t]:
                continue
            # windows from each own bigram on; enough of them must follow within the longest window
            follow = np.searchsorted(at, at + self.most_size[t]) - np.arange(len(at))
            starts = np.flatnonzero(follow >= self.least_shared[t])
            if len(starts):
                own[t] = at, self._full_from(t, pairs[at])
                near += [x for k in starts.tolist() if (x := self._nearest(t, *own[t], k, int(at[k]) + self.most_size[t] + 1))]
        heapq.heapify(near)
        kept: list[tuple[str, float, int, int]] = []
        begins: list[int] = []
        while near:
            dice, _, name, a, z, t, k = heapq.heappop(near)
            i = bisect_left(begins, a)
            if i and kept[i - 1][3] > a or i < len(kept) and begins[i] == a:
                continue
            if i < len(kept) and begins[i] < z:  # the nearest of the windows that end before the match kept there
                if x := self._nearest(t, *own[t], k, begins[i]):
                    heapq.heappush(near, x)
                continue
            kept.insert(i, (name, -dice, a, z))
            begins.insert(i, a)
        return sorted(kept, key=lambda x: (-x[1], x[0], x[2]))

    def _full_from(self, t: int, codes: np.ndarray) -> np.ndarray:
        """Per own bigram, the place of that one from which on a window has the template's repeats of it without this one; -1 for none."""
        full, seen = np.full(len(codes), -1), {}
        for j, c in enumerate(codes.tolist()):
            before = seen.setdefault(c, [])
            if len(before) >= self.counts[t][c]:
                full[j] = before[-self.counts[t][c]]
            before.append(j)
        return full

    def _nearest(self, t: int, at: np.ndarray, full: np.ndarray, k: int, end: int) -> tuple | None:
        """The nearest window from own bigram ``k`` on up to word ``end``, if near enough."""
        last = int(np.searchsorted(at, min(int(at[k]) + self.most_size[t], end - 1)))
        shared = np.cumsum(full[k:last] < k)
        if not len(shared) or shared[-1] < self.least_shared[t]:
            return None
        dice = 2 * shared / (self.sizes[t] + at[k:last] - at[k] + 1)
        j = int(np.argmax(dice))
        if dice[j] < self.threshold:
            return None
        return -float(dice[j]), -self.sizes[t], self.templates[t].license, int(at[k]), int(at[k + j]) + 2, t, k


def scan_documents(docs: DataFrame, templates: list[Template] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_matches, its nearest match: license, dice, first_word, end_word (null for none), and all
    matches, the nearest first, in ``matches``.

    Null and empty texts match nothing; texts are scanned whole; repeated
    rows get a row each; an empty table gives no rows; other columns are
    ignored.
    """
    scanner = LicenseScanner(templates or standard_templates(), threshold)
    match = {"license": pa.string(), "dice": pa.float64(), "first_word": pa.int64(), "end_word": pa.int64()}
    kinds = (pa.int32(), *match.values(), pa.list_(pa.struct(match)))
    names = ["doc_id", "n_matches", *match, "matches"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                found = scanner.scan(text.as_py())
                rows.append((len(found), *(found[0] if found else (None,) * 4), [dict(zip(match, x)) for x in found]))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    one = "license string, dice double, first_word bigint, end_word bigint"
    each = f"array<struct<{one.replace(' ', ':').replace(',:', ',')}>>"
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_matches int, {one}, matches {each}")


ship_by_value(__name__)
