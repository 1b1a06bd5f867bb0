"""Licence scans: Dice coefficient over word bigrams against templates.

Text is normalised to lower-case words of letters and digits.  Compared with
the templates are the whole text, every line, and every run of lines that share
most of their bigrams with one template (a licence spread over several lines),
and windows of words anywhere in the text that begin and end with bigrams of one
template (a notice inside a longer line, or one that begins or ends in a line).
Dice of sets of m and n bigrams is at most 2 min(m, n) / (m + n), so a template
is only compared with units whose size lets them reach the threshold.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import values_of

THRESHOLD = 0.8
LINE_SHARE = 0.5     # of a line's bigrams, for it to belong to a run
TOKEN = re.compile(r"[^\W_]+")

# Customary licence notices and texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE."""),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License."""),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details.""",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details. You should have received a copy of the GNU General Public License along with
        this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA
        02110-1301 USA."""),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details. You should have received a copy of the GNU General Public License along with
        this program. If not, see <https://www.gnu.org/licenses/>."""),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser
        General Public License for more details. You should have received a copy of the GNU Lesser General Public License
        along with this library. If not, see <https://www.gnu.org/licenses/>."""),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero
        General Public License for more details. You should have received a copy of the GNU Affero General Public License
        along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.""",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
        PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
        NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
        NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.""",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. THIS SOFTWARE IS
        PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
        NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
        NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    "ISC": (
        "Released under the ISC License.",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE."""),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author
        or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
        this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend
        this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
        For more information, please refer to <https://unlicense.org>"""),
    "CC0-1.0": ("Licensed under CC0 1.0.", "Dedicated to the public domain under CC0 1.0 Universal."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "Proprietary": ("All rights reserved.",),
}


def words_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    """Word pairs; a single word counts as one pair with nothing."""
    return set(zip(words, words[1:])) if len(words) != 1 else {(words[0], "")}


class Templates:
    """The templates' bigram sets and an index from bigrams to templates."""

    def __init__(self, texts: dict[str, tuple[str, ...]], threshold: float):
        self.threshold = threshold
        self.sets = [(name, bigrams(words_of(t))) for name, variants in texts.items() for t in variants]
        self.index: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, (_, grams) in enumerate(self.sets):
            for gram in grams:
                self.index[gram].append(i)

    def shared(self, grams: set) -> dict[int, int]:
        """Bigrams shared with each template that shares any."""
        counts: dict[int, int] = defaultdict(int)
        for gram in grams & self.index.keys():
            for i in self.index[gram]:
                counts[i] += 1
        return counts

    def best(self, grams: set, shared: dict[int, int] | None = None) -> tuple[float, str] | None:
        """(Dice, licence) of the best template at or over the threshold; the
        first by name on ties."""
        m, found = len(grams), None
        for i, both in (self.shared(grams) if shared is None else shared).items():
            name, n = self.sets[i][0], len(self.sets[i][1])
            if 2 * min(m, n) < self.threshold * (m + n):
                continue
            dice = 2 * both / (m + n)
            if dice >= self.threshold and (found is None or (-dice, name) < (-found[0], found[1])):
                found = (dice, name)
        return found

    def windows(self, text: str, shared: dict[int, int]) -> list[tuple[int, int, str, float]]:
        """Windows of words at or over the threshold that do not overlap; of those
        that do, the one that explains most.  ``shared`` is of the whole text: a
        window shares at least threshold / (2 - threshold) of the template's bigrams,
        so few templates remain for a text that holds no licence."""
        least = self.threshold / (2 - self.threshold)
        near = [i for i, both in shared.items() if both >= least * len(self.sets[i][1]) - 1e-9]
        if not near:
            return []
        words = [(m.start(), m.end(), m[0].lower()) for m in TOKEN.finditer(text)]
        grams = list(zip((w[2] for w in words), (w[2] for w in words[1:])))
        found = []
        for i in near:
            name, template = self.sets[i]
            n = len(template)
            places = [k for k, gram in enumerate(grams) if gram in template]
            best, beyond = None, -1
            for j, first in enumerate(places):
                if best and first > best[1] + n / 3:
                    found.append((best[0], i, best[1], best[2]))
                    best, beyond = None, best[2]
                if first <= beyond or bisect_left(places, first + n / least) - j < least * n - 1e-9:
                    continue
                seen, both, at = set(), 0, first
                while at < min(len(grams), first + 2 * n / least) and len(seen) <= n / least:
                    if grams[at] not in seen:
                        seen.add(grams[at])
                        if grams[at] in template:
                            both += 1
                            dice = 2 * both / (len(seen) + n)
                            if dice >= self.threshold and (best is None or dice > best[0]):
                                best = (dice, first, at)
                    at += 1
            if best:
                found.append((best[0], i, best[1], best[2]))
        # The most shared bigrams first, weighted by Dice; a taken window bars those that overlap it.
        found.sort(key=lambda f: (-f[0] * f[0] * (f[3] - f[2] + 1 + len(self.sets[f[1]][1])), f[2], self.sets[f[1]][0]))
        out: list[tuple[int, int, str, float]] = []
        for dice, i, first, last in found:
            start, end = words[first][0], words[last + 1][1]
            k = bisect_left(out, (start,))
            if (k == 0 or out[k - 1][1] <= start) and (k == len(out) or end <= out[k][0]):
                insort(out, (start, end, self.sets[i][0], dice))
        return out

    def scan(self, text: str, whole: dict[int, int] | None = None) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, Dice) of the units that match, by start.  A run
        of several lines is reported where it matches no worse than its lines, a
        window where it overlaps no line or run, or is longer and no worse.
        ``whole`` is what the whole text shares with the templates."""
        lines, at = [], 0
        for line in text.split("\n"):
            lines.append((at, at + len(line), bigrams(words_of(line))))
            at += len(line) + 1
        spans: list[tuple[int, int, str, float]] = []
        open_runs: dict[int, int] = {}
        runs: list[tuple[int, int, int]] = []
        for k, (start, end, grams) in enumerate(lines):
            shared = self.shared(grams) if grams else {}
            if not grams and k + 1 < len(lines):
                continue  # blank lines do not end a run
            if shared and (hit := self.best(grams, shared)):
                spans.append((start, end, hit[1], hit[0]))
            member = {i for i, both in shared.items() if both >= LINE_SHARE * len(grams)}
            for i in [i for i in open_runs if i not in member]:
                runs.append((i, open_runs.pop(i), k))
            for i in member:
                open_runs.setdefault(i, k)
        runs += [(i, k, len(lines)) for i, k in open_runs.items()]
        for i, k, stop in runs:
            while stop > k and not lines[stop - 1][2]:
                stop -= 1
            if stop - k > 1:
                start, end = lines[k][0], lines[stop - 1][1]
                hit = self.best(bigrams(words_of(text[start:end])), None)
                if hit and all(hit[0] >= s[3] for s in spans if start <= s[0] and s[1] <= end):
                    spans = [s for s in spans if not (start <= s[0] and s[1] <= end)] + [(start, end, hit[1], hit[0])]
        spans.sort()
        over, gone, added, k = [], set(), [], 0
        for start, end, name, dice in self.windows(text, self.shared(bigrams(words_of(text))) if whole is None else whole):
            while k < len(spans) and spans[k][0] < end:
                over.append(spans[k])
                k += 1
            over = [s for s in over if start < s[1]]
            if all(s[3] <= dice and s[1] - s[0] < end - start for s in over):
                gone.update(over)
                added.append((start, end, name, dice))
                over = []
        return sorted(set(spans) - gone | set(added))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: the id, licence and dice of the best match
    (null without one; the earliest on ties), whole (the whole text is that
    licence), n_matches and spans (licence:start:end, by start; code points).

    Null counts as empty and matches nothing; so do texts without words."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = templates if templates is not None else TEMPLATES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(texts, threshold)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, in values_of(batch, "_text"):
                text = text or ""
                grams = bigrams(words_of(text))
                shared = index.shared(grams)
                spans = index.scan(text, shared)
                whole = index.best(grams, shared)
                best = max(spans, key=lambda s: (s[3], -s[0]), default=None)
                is_whole = whole is not None and (best is None or whole[0] >= best[3])
                licence, dice = (whole[1], whole[0]) if is_whole else (best[2], best[3]) if best else (None, None)
                row = (licence, dice, is_whole, len(spans), ",".join(f"{name}:{s}:{e}" for s, e, name, _ in spans))
                for column, value in zip(out, row):
                    column.append(value)
            types = (pa.string(), pa.float64(), pa.bool_(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))],
                                             ["_id", "licence", "dice", "whole", "n_matches", "spans"])

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(scan, f"_id {kind}, licence string, dice double, whole boolean, n_matches long, spans string"
                           ).withColumnRenamed("_id", id_col)
