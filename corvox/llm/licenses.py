"""License scans by conditional compression.

Blocks of a text around license cues are compressed alone and with each template as raw
dictionary. The reduction in size, relative to what the template saves on itself, ranks the
templates; in that order a template is confirmed by the exact differences of its words and the
aligned passage's: few may be missing or added, none of those that decide (NEEDS), and none of
those that tell another license (BARS). A block reaches as far from its cue as the longest
template's passage could (the longest notice's, for notices), so no passage is cut. Long blocks are read in overlapping windows; of
passages that overlap, the longest is kept. The time is in proportion to a text's length.

Cases: null or empty texts have no rows. Texts of any length are read whole. Repeated documents
have rows each; equal reductions tie by the template's name. Case, punctuation and spacing do
not count as wording. An empty table gives an empty result; extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

SCHEMA = "doc_id long, license string, start long, end long, size_alone long, size_with long, n_words long, n_matched long, n_other long, exact boolean"

# Wordings of license texts and notices.
SOURCE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": f"{SOURCE} {AS_IS}",
    "BSD-3-Clause": f"{SOURCE} {ENDORSE} {AS_IS}",
    "BSD-4-Clause": f"{SOURCE} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. {ENDORSE[3:]} {AS_IS}",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: The licenses of one family have one wording, with their own name, version and reach.
FAMILY = [("GPL", "General", "2"), ("GPL", "General", "3"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3"), ("AGPL", "Affero General", "3")]
for short, kind, version in FAMILY:
    name, title = f"{short}-{version if '.' in version else version + '.0'}", f"GNU {kind} Public License"
    grant = f"you can redistribute it and/or modify it under the terms of the {title}"
    TEMPLATES |= {
        f"{name}-or-later": f"{grant} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"{name}-only": f"{grant} version {version} as published by the Free Software Foundation.",
        f"{name}-notice": f"licensed under the {title}, version {version}.",
        f"{name}-only-notice": f"licensed under the {title}, version {version} only.",
        f"{name}-or-later-notice": f"licensed under the {title}, version {version} or later.",
    }
#: Short names by which notices call a license.
SHORT = {
    "MIT": ["MIT"], "ISC": ["ISC"], "Apache-2.0": ["Apache 2.0", "Apache"], "BSD-2-Clause": ["BSD 2-Clause"], "BSD-3-Clause": ["BSD 3-Clause"], "MPL-2.0": ["MPL 2.0", "Mozilla Public"],
    "GPL-2.0": ["GNU GPL v2", "GPLv2"], "GPL-3.0": ["GNU GPL v3", "GPLv3"], "LGPL-3.0": ["GNU LGPL v3", "LGPLv3"], "AGPL-3.0": ["GNU AGPL v3", "AGPLv3"], "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "CC0-1.0": ["CC0 1.0"],
}
for name, called in SHORT.items():
    TEMPLATES[f"{name}-notice-spdx"] = f"SPDX-License-Identifier: {name}"
    for k, n in enumerate(called):
        the, end = ("", "") if name.startswith("CC") else ("the ", "" if "GPL" in name else " license")
        for how, phrase in (("licensed", "licensed under"), ("released", "released under"), ("terms", "under the terms of")):
            if (how, name) != ("released", "MIT"):  # MIT-notice
                TEMPLATES[f"{name}-notice-{how}{k or ''}"] = f"{phrase} {the}{n}{end}"
#: Words of which each must be matched, by parts of a template's name, and words that the passage must not hold.
NEEDS = {"BSD-3": "endorse promote", "BSD-4": "advertising acknowledgement endorse promote", "MIT": "mit", "Apache": "apache", "SA": "sharealike", "NC": "nc", "GPL": "gnu general public", "LGPL": "lesser", "AGPL": "affero", "later": "later", "only-notice": "only", "MPL": "mozilla"}
BARS = {"BSD-2": "endorse promote advertising", "BSD-3": "advertising", "GPL": "lesser library affero", "LGPL": "affero", "AGPL": "lesser library", "only": "later", "BY-4": "sharealike noncommercial noderivatives nonderivs", "BY-SA": "noncommercial"}
#: Words right after a notice that make it another one.
TAILS = [("only",), ("or", "later"), ("or", "any", "later"), ("or", "newer")]
CUE = re.compile(r"licen[sc]e|licen[sc]ing|hereby granted|redistribut|public domain|creative commons|gpl|cc[ -]by|cc0", re.IGNORECASE)
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Share of the template's own saving that makes a candidate; share of its words that must match, and of other words among them.
RANKED, MATCHED, OTHER = 0.3, 0.9, 0.1
#: Templates of fewer words are notices. Their blocks are compressed without coding of literals (a negative level), whose gain or loss on a few words hides that of the dictionary.
NOTICE = 24


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(text.lower() if len(text.lower()) == len(text) else text)]


def deciding(name: str, want: set[str]) -> tuple[set[str], set[str]]:
    """Words that a passage of the template must and must not have."""
    parts = {name, *name.split("-"), *("-".join(name.split("-")[i:j]) for i in range(9) for j in range(i + 2, 9))}
    pick = lambda table: {w for k, v in table.items() if k in parts or "-" in k and any(p.startswith(k) for p in parts) for w in v.split()}
    versions = {w for w in want if re.fullmatch(r"\d+(\.\d+)*", w) and w in re.findall(r"\d+(?:\.\d+)*", name.replace(".0", "")) + re.findall(r"\d+(?:\.\d+)*", name)}
    return (pick(NEEDS) & want) | versions, pick(BARS) - want


def starts(want: list[str], block: list[str]) -> Iterator[int]:
    """Where a passage with want's wording could start: its words, in any order, hold enough of want's."""
    need, have, size, n, end = Counter(want), Counter(), int((1 + OTHER) * len(want)), 0, 0
    for i, first in enumerate(block):
        for w in block[end : i + size]:
            have[w] += 1
            n += have[w] <= need[w]
        end = i + size
        if n >= MATCHED * len(want) and first in need:
            yield i
        n -= have[first] <= need[first]
        have[first] -= 1


class Templates:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        import zstandard as z

        self.words = {k: [w for w, _, _ in words(t)] for k, t in templates.items()}
        self.deciding = {k: deciding(k, set(w)) for k, w in self.words.items()}
        # notices have blocks of their own: in one as large as a license's, their small reduction would be lost
        few = [k for k, w in self.words.items() if len(w) < NOTICE]
        self.groups = [(x, int((1 + OTHER) * max(len(self.words[k]) for k in x)) + 1) for x in (few, [k for k in self.words if k not in few]) if x]
        folded = {k: " ".join(w).encode() for k, w in self.words.items()}
        level = {k: -1 if len(w) < NOTICE else 3 for k, w in self.words.items()}
        plain = {n: z.ZstdCompressor(level=n, write_content_size=False) for n in (-1, 3)}
        self.plain = {k: plain[n] for k, n in level.items()}
        self.by = {k: z.ZstdCompressor(level=level[k], write_content_size=False, dict_data=z.ZstdCompressionDict(t, dict_type=z.DICT_TYPE_RAWCONTENT)) for k, t in folded.items()}
        self.saves = {k: len(self.plain[k].compress(t)) - len(self.by[k].compress(t)) for k, t in folded.items()}

    @staticmethod
    def windows(run: list[tuple[str, int, int]], cues: list[int], reach: int) -> Iterator[list[tuple[str, int, int]]]:
        """The words around cues (word numbers): blocks of that reach, in windows that share as much with the next one."""
        blocks: list[list[int]] = []
        for i in cues:
            if blocks and i - reach <= blocks[-1][1]:
                blocks[-1][1] = i + reach
            else:
                blocks.append([max(0, i - reach), i + reach])
        for a, b in blocks:
            b = min(b, len(run))
            for i in range(a, max(b - reach, a + 1), 3 * reach):
                yield run[i : min(b, i + 4 * reach)]

    def ranked(self, block: list[str], names: list[str]) -> list[tuple[str, int, int]]:
        """(template, size alone, size with it) of the candidates among names, largest reduction first."""
        data = " ".join(block).encode()
        alone = len(self.plain[names[0]].compress(data))
        with_ = {k: len(self.by[k].compress(data)) for k in names}
        return sorted(((k, alone, n) for k, n in with_.items() if alone - n >= RANKED * self.saves[k]), key=lambda x: (x[2] - x[1], x[0]))

    def aligned(self, name: str, block: list[str]) -> tuple[int, int, int] | None:
        """(first word, last word + 1, matched words) of the first passage of the block that has the template's wording."""
        want = self.words[name]
        size, slack, wide, best = int((1 + OTHER) * len(want)), max(1, int(OTHER * len(want))), 0, None
        for i in starts(want, block):
            if best and i >= best[1]:
                break
            tries = [size] if i < wide else [size + slack, size]
            wide = wide if i < wide else i + slack
            for n in tries:
                if got := self.placed(name, block, i, i + n):
                    while (more := self.placed(name, block, max(0, got[0] - slack - 1), got[1] + slack + 1)) and more[2] > got[2]:
                        got = more  # the passage grows as long as more of the template aligns
                    if n > size:
                        return got
                    if not best or (got[2], got[0] - got[1]) > (best[2], best[0] - best[1]):
                        best = got
        return best

    def placed(self, name: str, block: list[str], low: int, high: int) -> tuple[int, int, int] | None:
        """The same for block[low:high], at the place of the longest common run."""
        want = self.words[name]
        same = [m for m in SequenceMatcher(None, want, block[low:high], autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return None
        longest = max(same, key=lambda m: m.size)
        off, slack = longest.b - longest.a, max(3, len(want) // 4)
        same = [m for m in same if abs(m.b - m.a - off) <= slack]
        a, b, n = low + same[0].b, low + same[-1].b + same[-1].size, sum(m.size for m in same)
        if n < MATCHED * len(want) or b - a - n > OTHER * len(want):
            return None
        needs, bars = self.deciding[name]
        hit = {w for m in same for w in want[m.a : m.a + m.size]}
        if needs - hit or bars & set(block[a:b]) or ("only" in name or "notice" in name) and any(tuple(block[b : b + len(x)]) == x for x in TAILS):
            return None
        return a, b, n

    def found(self, text: str) -> list[tuple]:
        """(license, start, end, size alone, size with, template words, matched words, other words, exact) in order of start."""
        out, found = [], [m.start() for m in CUE.finditer(text)]
        if not found:
            return []
        all_ = words(text)
        at = [a for _, a, _ in all_]
        cues = [max(0, bisect_right(at, c) - 1) for c in found]
        for names, window in ((names, x) for names, reach in self.groups for x in self.windows(all_, cues, reach)):
            left = [window]
            while left:
                run = left.pop()
                block = [w for w, _, _ in run]
                for name, alone, with_ in self.ranked(block, names) if block else ():
                    # of templates that are found, one that holds another's wording is tried first by its larger reduction
                    if got := self.aligned(name, block):
                        i, j, n = got
                        out.append((name, run[i][1], run[j - 1][2], alone, with_, len(self.words[name]), n, j - i - n, n == len(self.words[name]) == j - i))
                        left += [run[:i], run[j:]]
                        break
        keep: list[tuple] = []
        for x in sorted(set(out), key=lambda x: (x[1], -x[2], x[0])):
            if keep and x[1] < keep[-1][2]:
                if x[2] - x[1] > keep[-1][2] - keep[-1][1]:
                    keep[-1] = x
            else:
                keep.append(x)
        return keep


def scanned(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Rows of SCHEMA, one for every license passage of a document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = [x.split()[0] for x in SCHEMA.split(",")]

    def make():
        own = Templates(templates or TEMPLATES)

        def run(batch: pa.RecordBatch) -> dict:
            got = [(d, *x) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for x in own.found(t)]
            return dict(zip(names, zip(*got, strict=True), strict=True)) if got else dict.fromkeys(names, ())

        return run

    return map_slices(rows, make, SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
