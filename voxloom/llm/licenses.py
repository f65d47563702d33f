"""Licence scans: TF-IDF cosine of headers and licence files to templates, inherited by the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import fresh, map_in_arrow, named, written

# Published licence texts, their openings, and the statements that the licences themselves recommend.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = (
    _BSD_OPENING + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
    "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim "
    "that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
    "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"
)
_APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_TAIL = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_GNU_COPIES = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU = (("GPL-2.0", "General Public License", "2", "Version 2, June 1991"), ("GPL-3.0", "General Public License", "3", "Version 3, 29 June 2007"), ("LGPL-2.1", "Lesser General Public License", "2.1", "Version 2.1, February 1999"),
        ("LGPL-3.0", "Lesser General Public License", "3", "Version 3, 29 June 2007"), ("AGPL-3.0", "Affero General Public License", "3", "Version 3, 19 November 2007"))
_CC = (("CC-BY-4.0", "BY", "Attribution"), ("CC-BY-SA-4.0", "BY-SA", "Attribution-ShareAlike"), ("CC-BY-NC-4.0", "BY-NC", "Attribution-NonCommercial"), ("CC-BY-ND-4.0", "BY-ND", "Attribution-NoDerivatives"),
       ("CC-BY-NC-SA-4.0", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("CC-BY-NC-ND-4.0", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_IDENTIFIERS = {name.lower(): name for name in "Apache-2.0 MIT BSD-2-Clause BSD-3-Clause ISC Zlib Unlicense BSL-1.0 MPL-2.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later CC-BY-4.0 CC-BY-SA-4.0".split()}
_IDENTIFIED = re.compile(r"spdx-license-identifier:[ \t]*([a-z0-9.+() -]+)")


def _statements() -> tuple[tuple[str, str], ...]:
    out = [
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
        ("Apache-2.0", _APACHE_HEADER),
        ("Apache-2.0", _APACHE_HEADER + _APACHE_TAIL),
        ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
        ("MIT", "Released under the MIT License."),
        ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
        ("MIT", _MIT),
        ("BSD-3-Clause", _BSD_OPENING),
        ("BSD-2-Clause", _BSD_2 + _BSD_DISCLAIMER),
        ("BSD-3-Clause", _BSD_2 + _BSD_NAMES + _BSD_DISCLAIMER),
        ("ISC", _ISC),
        ("Zlib", _ZLIB),
        ("Unlicense", _UNLICENSE),
        ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
        ("BSL-1.0", _BOOST),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        ("MPL-2.0", "Mozilla Public License Version 2.0"),
        ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
        ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
        ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ]
    for name, title, version, dated in _GNU:
        out += [
            (f"{name}-only", f"GNU {title} {dated}"),
            (f"{name}-only", f"GNU {title} {dated} Copyright (C) Free Software Foundation, Inc. {_GNU_COPIES}"),
            (f"{name}-only", f"This work is licensed under the GNU {title}, version {version}."),
            (f"{name}-or-later", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation, either version {version} of the License, or any later version."),
        ]
    for name, short, title in _CC:
        out += [(name, f"Licensed under CC {short} 4.0."), (name, f"This work is licensed under a Creative Commons {title} 4.0 International License."), (name, f"Creative Commons {title} 4.0 International Public License")]
    return tuple(out)


#: Statements by which texts declare a licence (SPDX identifier, statement).
TEMPLATES: tuple[tuple[str, str], ...] = _statements()
#: What a directory has whose licence file holds no known statement.
UNKNOWN = "LicenseRef-unknown"

#: Cosine from which a statement counts.
THRESHOLD = 0.75
#: Share of a text's words in statements from which it is a licence file whatever its name.
LICENCE_SHARE = 0.2

_FUNCTION_WORDS = frozenset("a an and any are as at be by for from in is it may not of on or that the this to under use using with you".split())
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_UNIT_END = re.compile(r"\n|(?<=[.;!?])\s")
_NEGATED = re.compile(r"\b(?:not|never|no longer|isn't|neither)\s+(?:\w+\s+){0,2}?(?:licensed|released|distributed|available|covered)\b")
_LICENCE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"


class Scanner:
    """Sparse TF-IDF vectors of the templates and the cosine of a unit of text to each."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        counts = [Counter(_WORD.findall(text.lower())) for _, text in templates]
        seen = Counter(w for c in counts for w in c)
        n = len(templates)
        self.idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in seen.items()}
        self.unknown = math.log(1 + n) + 1
        self.vectors = []
        for c in counts:
            v = {w: (1 + math.log(k)) * self.idf[w] for w, k in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append({w: x / norm for w, x in v.items()})
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for t, v in enumerate(self.vectors):
            for w, x in v.items():
                self.postings.setdefault(w, []).append((t, x))
        self.longest = max((sum(c.values()) for c in counts), default=0)
        self.anchors = self._anchors()
        self._anchor = re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, self.anchors)) + r")(?![a-z0-9])").search

    def _anchors(self) -> tuple[str, ...]:
        """Words of which a unit holds one if its cosine to any template reaches the threshold.

        Without them a template's other weights alone bound the cosine
        (Cauchy-Schwarz); words are taken until every bound is below it,
        function words and short ones last.
        """
        chosen: set[str] = set()
        for v in self.vectors:
            rest = [((w in _FUNCTION_WORDS) + (len(w) < 5), -x, w) for w, x in v.items() if w not in chosen]
            left = sum(x * x for _, x, _ in rest)
            for _, x, w in sorted(rest):
                if left < self.threshold**2 * 0.999:
                    break
                chosen.add(w)
                left -= x * x
        return tuple(sorted(chosen))

    def hot(self, text: str, first: int = 0, end: int | None = None) -> bool:
        return bool(self.anchors) and self._anchor(text, first, len(text) if end is None else end) is not None

    def cosines(self, words: list[str]) -> list[float]:
        """The cosine to each template: only those that share a word are touched."""
        sums = [0.0] * len(self.names)
        norm = 0.0
        for w, k in Counter(words).items():
            weight = (1 + math.log(k)) * self.idf.get(w, self.unknown)
            norm += weight * weight
            for t, x in self.postings.get(w, ()):
                sums[t] += weight * x
        return [x / math.sqrt(norm) for x in sums] if norm else sums

    def scan(self, text: str) -> tuple[dict[str, float], int, int]:
        """(best cosine of each licence that the text states, words in such statements, all words).

        Units are the text's sentences and lines, and runs of them up to
        twice the longest template's length, so a header broken over lines is
        found.  Of runs that overlap the one with the greatest product of
        cosine and logarithm of its length speaks, and for its nearest
        template only, so a licence isn't taken for a variant of it whose text
        is almost the same.  A unit that says "not licensed" and the like
        states nothing.  ``SPDX-License-Identifier`` lines are read as such.
        """
        lower = text.lower()
        total = -1
        matches: list[tuple[float, int, int, float, str]] = []
        units: list[list[str]] = []
        if self.hot(lower):
            bounds = [0, *(m.end() for m in _UNIT_END.finditer(lower)), len(lower)]
            units = [_WORD.findall(lower[a:b]) for a, b in zip(bounds, bounds[1:])]
            total = sum(map(len, units))
            barred = [bool(_NEGATED.search(lower, a, b)) for a, b in zip(bounds, bounds[1:])]
            hot = [self.hot(lower, a, b) for a, b in zip(bounds, bounds[1:])]
            for k, h in enumerate(hot):
                if not h:
                    continue
                words: list[str] = []
                seen: set[str] = set()
                known = 0
                for j in range(k, len(units)):
                    if barred[j] or words and set(units[j]) <= seen:
                        break  # a unit that only repeats words is a statement of its own
                    words = words + units[j]
                    seen.update(units[j])
                    known += sum(w in self.idf for w in units[j])
                    if j > k and (len(words) > 2 * self.longest or known * 2 < len(words)):
                        break  # mostly foreign words: longer runs are further from every template
                    near = max(zip(self.cosines(words), self.names), default=(0.0, ""))
                    if near[0] >= self.threshold:
                        matches.append((near[0] * math.log2(1 + len(words)), k, j, *near))
        found: dict[str, float] = {}
        used = [False] * len(units)
        for _, k, j, cosine, name in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not any(used[k : j + 1]):
                used[k : j + 1] = [True] * (j + 1 - k)
                found[name] = max(found.get(name, 0.0), cosine)
        for m in _IDENTIFIED.finditer(lower) if "spdx-license-identifier:" in lower else ():
            for name in re.split(r"[\s()]+", m[1]):
                if name in _IDENTIFIERS:
                    found[_IDENTIFIERS[name]] = 1.0
        return found, sum(len(u) for u, x in zip(units, used) if x), total


def declared(files: DataFrame, text_col: str, names: tuple[str, str, str], templates, threshold: float) -> DataFrame:
    """``files`` without the text and with what each declares itself, in columns of three given names: licences (sorted), best cosine, share of its words in statements; no row is moved."""
    keep = [c for c in files.columns if c != text_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            found_names, scores, shares = [], [], []
            for text in batch.column(len(keep)):
                found, stated, total = scanner.scan(text.as_py() or "")
                found_names.append(sorted(found))
                scores.append(max(found.values(), default=0.0))
                shares.append(stated / total if total > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found_names, pa.list_(pa.string())), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], names=[*keep, *names])

    kinds = files.select(*map(named, keep)).schema
    schema = T.StructType(list(kinds.fields)).add(names[0], T.ArrayType(T.StringType())).add(names[1], T.DoubleType()).add(names[2], T.DoubleType())
    return map_in_arrow(files.select(*map(named, keep), named(text_col).cast("string").alias(names[0])), scan, schema)


def directory(path: Column) -> Column:
    """The directory of a path without a trailing slash; the root is the empty string."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, the root (empty string) included."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    lead = F.when(folder.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(lead, F.array_join(F.slice(parts, F.lit(1), n), "/"))))


def license_scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, licence_share: float = LICENCE_SHARE) -> DataFrame:
    """The licences of every file: its own statements, else those of the nearest ancestor directory.

    A file declares the licences of which a template's TF-IDF cosine to one of
    its units (lines and sentences, and runs of them) reaches ``threshold``.
    Whole texts are scanned where they are read.  A file is a directory's
    licence file if its name says so (LICENSE, COPYING, ...) or statements
    make up ``licence_share`` of its words; a directory has the licences of
    all its licence files.  A file without a statement of its own inherits
    from its directory or the nearest one above that has licences: distinct
    directories, not files, are joined with the paths above them, and files
    are joined with their directory's answer once.

    Adds to the columns of ``files`` without ``text_col``: ``declared``
    (sorted array), ``score`` (best cosine, 0 if none), ``licenses`` (own or
    inherited, empty if none), ``inherited_from`` (directory or null); columns
    of these names are replaced, all others are kept whatever their names.  A
    licence file by name with words but no known statement gives its directory
    ``LicenseRef-unknown``.  A null or empty text declares nothing; a text is
    scanned whole however long it is, in time that grows with its length; of
    two licences at the same cosine the later name is taken; a null path
    inherits nothing; repeated rows are kept; an empty table gives an empty
    result.
    """
    added = ("declared", "score", "licenses", "inherited_from")
    kept = [c for c in files.columns if c.lower() not in added or c in (path_col, text_col)]
    says, score, share, folder, above, theirs, depth, near, worded = fresh(files.columns, "says", "score", "share", "folder", "above", "theirs", "depth", "near", "worded")
    has_words = F.coalesce(F.length(F.trim(named(text_col))) > 0, F.lit(False))
    rows = files.select(*map(named, (c for c in kept if c != text_col)), has_words.alias(worded), directory(named(path_col)).alias(folder), named(text_col))
    own = written(declared(rows, text_col, (says, score, share), templates, threshold), "declared")
    columns = [c for c in kept if c != text_col]
    by_name = F.regexp_extract(named(path_col), r"[^/]*$", 0).rlike(_LICENCE_NAME)
    known = F.size(says) > 0
    holds = own.filter(F.col(folder).isNotNull() & (known & (by_name | (F.col(share) >= licence_share)) | by_name & F.col(worded)))
    of_folder = holds.select(F.col(folder).alias(above), F.explode(F.when(known, F.col(says)).otherwise(F.array(F.lit(UNKNOWN)))).alias(theirs)).groupBy(above).agg(F.sort_array(F.collect_set(theirs)).alias(theirs))
    wanting = own.filter(~known & F.col(folder).isNotNull()).select(folder).distinct()
    climbed = wanting.select(folder, F.explode(ancestors(F.col(folder))).alias(above)).join(of_folder, above)
    nearest = climbed.groupBy(folder).agg(F.max(F.struct(F.length(above).alias(depth), F.col(above), F.col(theirs))).alias(near))
    nearest = nearest.select(F.col(folder).alias(depth), F.col(f"{near}.{above}").alias(above), F.col(f"{near}.{theirs}").alias(theirs))
    told = own.join(nearest, (F.col(folder) == F.col(depth)) & ~known, "left")
    return told.select(
        *map(named, columns), F.col(says).alias("declared"), F.col(score).alias("score"),
        F.when(known, F.col(says)).otherwise(F.coalesce(F.col(theirs), F.array().cast("array<string>"))).alias("licenses"), F.col(above).alias("inherited_from"),
    )
