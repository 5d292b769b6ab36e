"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text is normalised to one sequence of lower-case words of letters and digits; line and paragraph
breaks part words like any space. A passage is any run of words in it, compared, as its set of word
bigrams, with each template: a notice is found inside a line, wrapped over lines or over paragraphs. At
a threshold t, Dice can only be reached by sets that hold t / (2 - t) of a template's bigrams, so a
template is only looked for in texts with that many of them. Runs begin and end with a bigram of the
template (others only lower Dice) and grow while the threshold can be reached. A template of one word
matches that word.

Runs compete, those of the highest Dice first, then by name and place: a run goes if kept runs of the
same licence, or of templates of comparable size, hold half of it, or it holds half of such a run.

Defined results: null and empty texts match nothing; ties go to the template whose name comes first;
repeated rows get equal results. The templates are a fixed list, broadcast with the function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_TABLE, tune

THRESHOLD = 0.8

# Notices, permission paragraphs and whole texts of public licences, by identifier. The long texts of
# Apache, GPL and MPL are known by the notices that files carry in their place.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    (
        "LGPL-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any "
        "later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License "
        "for more details.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
        "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to "
        "be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
]


def bigrams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Distinct word bigrams; a single word counts as one."""
    return set(zip(words, words[1:])) if len(words) > 1 else {(w,) for w in words}


class Scanner:
    """Templates as bigram sets, found by their bigrams and bounded by their sizes."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.sets = [(name, bigrams(text.encode().translate(WORD_TABLE).split())) for name, text in templates]
        self.holders: dict[tuple, list[int]] = {}
        for k, (_, s) in enumerate(self.sets):
            for b in s:
                self.holders.setdefault(b, []).append(k)
        self.known = set(self.holders)
        self.singles = {b for b in self.known if len(b) == 1}
        self.ratio = (2 - threshold) / threshold

    def runs(self, pairs: list[tuple[bytes, ...]], k: int) -> list[tuple[float, str, int, int, int]]:
        """(Dice, name, first, last, template) of the best run from each place at which one reaches the threshold.

        A run whose first bigram comes again is no better than the one from there, and one whose last
        bigram has come before is no better than without it; so no place is passed more often than the
        template has bigrams.
        """
        name, s = self.sets[k]
        out = []
        for first in [i for i, b in enumerate(pairs) if b in s]:
            own, both, best = set(), 0, None
            for last in range(first, len(pairs)):
                b = pairs[last]
                if b in own:
                    if b == pairs[first]:
                        break
                    continue
                own.add(b)
                if b in s:
                    both += 1
                    dice = 2 * both / (len(own) + len(s))
                    if dice >= self.threshold and (best is None or dice > best[0]):
                        best = (dice, name, first, last, k)
                elif 2 * len(s) < self.threshold * (2 * len(s) + len(own) - both):
                    break
            if best:
                out.append(best)
        return out

    def scan(self, text: bytes | None) -> list[tuple[float, str]]:
        """Matches (Dice, name) of all passages that are kept."""
        words = (text or b"").translate(WORD_TABLE).split()
        found = self.known.intersection(zip(words, words[1:]))
        if self.singles:
            found |= self.singles.intersection(zip(words))
        shared: dict[int, int] = {}
        for b in found:
            for k in self.holders[b]:
                shared[k] = shared.get(k, 0) + 1
        able = [k for k, n in shared.items() if 2 * n >= self.threshold * (n + len(self.sets[k][1]))]
        if not able:
            return []
        pairs, alone = list(zip(words, words[1:])), list(zip(words)) if self.singles else []
        runs = [r for k in able for r in self.runs(alone if self.sets[k][1] <= self.singles else pairs, k)]
        return [r[:2] for r in self.kept(sorted(runs, key=lambda r: (-r[0], r[1], -len(self.sets[r[4]][1]), r[2])))]

    def kept(self, runs: list[tuple[float, str, int, int, int]]) -> list[tuple[float, str, int, int, int]]:
        """Runs that no better one stands for."""
        out: list[tuple[float, str, int, int, int]] = []
        holders: dict[int, list[int]] = {}
        for run in runs:
            _, name, first, last, k = run
            n, inside, over = len(self.sets[k][1]), 0, {}
            for at in range(first, last + 1):
                rivals = [o for o in holders.get(at, ()) if out[o][1] == name or self.alike(n, len(self.sets[out[o][4]][1]))]
                inside += bool(rivals)
                for o in rivals:
                    over[o] = over.get(o, 0) + 1
            if 2 * inside >= last - first + 1 or any(2 * m >= out[o][3] - out[o][2] + 1 for o, m in over.items()):
                continue
            for at in range(first, last + 1):
                holders.setdefault(at, []).append(len(out))
            out.append(run)
        return out

    def alike(self, m: int, n: int) -> bool:
        """Whether sets of m and n bigrams could reach the threshold with each other."""
        return m <= self.ratio * n and n <= self.ratio * m


def scan_licenses(
    spark: SparkSession, docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: doc_id, license (best match or null), dice (0 without), n_matches, licenses (sorted, joined by commas)."""
    tune(spark)
    known = TEMPLATES if templates is None else templates

    @F.pandas_udf("license string, dice double, n_matches long, licenses string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(known, threshold)
        for texts in batches:
            rows = []
            for t in texts:
                found = scanner.scan(t)
                best = min(found, key=lambda m: (-m[0], m[1]), default=(0.0, None))
                rows.append((best[1], best[0], len(found), ",".join(sorted({name for _, name in found}))))
            yield pd.DataFrame(rows, columns=["license", "dice", "n_matches", "licenses"])

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    found = docs.select("doc_id", scan(raw).alias("m"))
    return found.select("doc_id", "m.license", "m.dice", "m.n_matches", "m.licenses")
