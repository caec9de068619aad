"""License scan by conditional compression.

Texts with a cue word are kept by built-in functions.  In these, words of the
templates that stand close together form candidate blocks; a block of more than
``WINDOW`` words is looked at in overlapping windows, so each template fits whole
into one.  A block is compressed once alone and once with each template as zstandard
raw dictionary; templates are ranked by the bytes saved, as a share of what the
template itself saves.  All above ``LEAST_SHARE`` that could still be confirmed by the
block's words are compared word by word with it (lower case, without punctuation).  A wording is confirmed if its differences are at
most ``DIFFERENCES`` percent of its words and the words that tell licenses apart
(``kind_of``: versions, Lesser, ShareAlike and the like) are the same; of several the one with the most words in common,
less those missing and added, wins.  The missing and added words are part of the result.

One row a confirmed finding; a text without one has no row.  Null and empty texts
have none; repeated rows give their findings again; ids may be null; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.llm.common import text_or_empty
from symdex.llm.words import sliced

#: Wordings of public licenses and notices.
TEMPLATES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]
#: One of these stands in every template.
CUES = ["licens", "licenc", "copyright", "warrant", "redistribut", "permission", "public domain"]

WINDOW, NEAR, EDGE, DIFFERENCES, LEAST_SHARE = 400, 12, 4, 10, 0.1
LEVEL = 9
_WORD = re.compile(r"\S+")
_BARE = re.compile(r"[^\w]+")

FOUND = "doc_id long, block int, first_word long, n_words long, license string, template int, bytes_alone long, bytes_saved long, share double, n_missing int, n_added int, exact boolean, missing string, added string"


def bare(words: list[str]) -> list[str]:
    return [b for w in words if (b := _BARE.sub("", w.lower()))]


_TELLING = re.compile("lesser|affero|sharealike|noncommercial|noderiv|^later$")
_VERSION = re.compile(r"v?(\d+)$")


def kind_of(low: list[str]) -> list[str]:
    """Of bare words those that tell licenses apart, in order: names of variants, and numbers that are versions (3 for 3.0)."""
    out = []
    for before, w, after in zip(["", *low], low, [*low[1:], ""]):
        if _TELLING.search(w) or w == "library" and after == "general":
            out.append(w)
        elif (m := _VERSION.match(w)) and (w[0] == "v" or before in ("version", "v", "license", "licence", "cc0") or before.startswith(("by", "attribution"))):
            n = m[1]
            out.append(n[0] if len(n) == 2 and n[1] == "0" else n)
    return out


class Scanner:
    """Compressors and word lists of the templates."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = templates
        self.words = [bare(t.split()) for _, t in templates]
        self.counts = [Counter(words) for words in self.words]
        self.kinds = [kind_of(words) for words in self.words]
        self.vocabulary = {w for words in self.words for w in words if len(w) >= 5 or any(c.isdigit() for c in w)}
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = []
        for _, text in templates:
            known = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.given.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False))
        self.own = [max(1, self.saved(t.encode(), i)[1]) for i, (_, t) in enumerate(templates)]
        self.known: dict[str, tuple | None] = {}

    def saved(self, block: bytes, i: int) -> tuple[int, int]:
        """Bytes of a block alone, and how many fewer with template ``i`` known."""
        alone = len(self.plain.compress(block))
        return alone, alone - len(self.given[i].compress(block))

    def blocks(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """First word and words of the candidate blocks of a text."""
        words = [m.group() for m in _WORD.finditer(text)]
        low = [_BARE.sub("", w.lower()) for w in words]
        hits = [i for i, w in enumerate(low) if w in self.vocabulary or w.startswith(("licens", "licenc"))]
        start = 0
        for k in range(1, len(hits) + 1):
            if k == len(hits) or hits[k] - hits[k - 1] > NEAR:
                a, b = max(0, hits[start] - EDGE), min(len(words), hits[k - 1] + EDGE + 1)
                start = k
                joined = " ".join(low[a:b])
                if any(c in joined for c in CUES):
                    for s in range(a, max(a + 1, b - WINDOW // 2), WINDOW // 2):
                        yield s, words[s : min(b, s + WINDOW)]

    def confirmed(self, words: list[str]) -> tuple | None:
        """The first template by bytes saved that the block words, with figures; None where none is confirmed."""
        block = " ".join(words)
        if block in self.known:
            return self.known[block]
        data = block.encode()
        ranked = sorted(((self.saved(data, i), i) for i in range(len(self.templates))), key=lambda x: (-x[0][1], x[1]))
        best, have = None, Counter(bare(words))
        for (alone, saved), i in ranked:
            share = saved / self.own[i]
            if share < LEAST_SHARE:
                continue
            # words that the block has nowhere are missing in any case
            if 100 * (self.counts[i] - have).total() > DIFFERENCES * len(self.words[i]):
                continue
            missing, added, first, last = self.differences(words, i)
            if 100 * (len(missing) + len(added)) <= DIFFERENCES * len(self.words[i]) and kind_of(bare(words[first:last])) == self.kinds[i]:
                best = (i, first, last, alone, saved, share, missing, added)
                break
        if len(self.known) > 20_000:
            self.known.clear()
        self.known[block] = best
        return best

    def differences(self, words: list[str], i: int) -> tuple[list[str], list[str], int, int]:
        """Words of template ``i`` that the block lacks, words added inside it, and the block's words that it spans."""
        low, places = [], []
        for k, w in enumerate(words):
            b = _BARE.sub("", w.lower())
            if b:
                low.append(b)
                places.append(k)
        template = self.words[i]
        matches = [m for m in SequenceMatcher(None, template, low, autojunk=False).get_matching_blocks() if m.size]
        if not matches:
            return template, [], 0, 0
        # of the scattered matches those that lie within the template's own reach of the longest one
        centre = max(matches, key=lambda m: (m.size, -m.b))
        near = [m for m in matches if abs((m.b - m.a) - (centre.b - centre.a)) <= len(template) // DIFFERENCES + 1]
        used, missing, added = 0, [], []
        at = near[0].b
        for m in near:
            missing += template[used : m.a]
            added += low[at : m.b]
            used, at = m.a + m.size, m.b + m.size
        missing += template[used:]
        return missing, added, places[near[0].b], places[at - 1] + 1

    def findings(self, text: str) -> list[tuple]:
        """Confirmed templates of a text, each stretch of words once."""
        out: list[tuple] = []
        for start, words in self.blocks(text):
            rest = [(start, words)]
            while rest:  # what stands beside a finding may hold another
                at, own = rest.pop()
                best = self.confirmed(own)
                if best is None:
                    continue
                i, first, last, alone, saved, share, missing, added = best
                if not any(r[0] < at + last and at + first < r[1] for r in out):
                    out.append((at + first, at + last, i, alone, saved, share, missing, added))
                if first > 0:
                    rest.append((at, own[:first]))
                if last < len(own):
                    rest.append((at + last, own[last:]))
        return sorted(out)


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(list(templates))


def license_findings(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Confirmed license wordings of every whole text."""
    given = tuple((a, b) for a, b in templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(given)
        for batch in sliced(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for block, (first, last, i, alone, saved, share, missing, added) in enumerate(scan.findings(text)):
                    rows.append((doc, block, first, last - first, given[i][0], i, alone, saved, share, len(missing), len(added), not missing and not added, " ".join(missing), " ".join(added)))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
                names = [c.split()[0] for c in FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    low = F.lower(F.col("text"))
    some = F.lit(False)
    for cue in CUES:
        some = some | low.contains(cue)
    return text_or_empty(docs).where(some).mapInArrow(run, FOUND)
