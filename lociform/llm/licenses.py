r"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams.

A text is lower-cased (A-Z); what is neither letter nor digit only parts words, so line ends and comment
marks do not matter.  Passages are windows of exactly as many words as a template, from every word where a
bigram of that template begins, anywhere in the text.  The distinct word bigrams of both are compared:
dice = 2 |a & b| / (|a| + |b|).  As |a & b| is at most the smaller of both, a passage of n bigrams can only
reach the threshold t with templates of t n / (2 - t) to (2 - t) n / t bigrams, and needs at least t / (2 - t)
of the template's bigrams: windows of fewer hits are pruned before their bigrams are counted, and so are, inside
the JVM, texts that have none of the words without which no template's share of bigrams can be met.

Where passages overlap that match different licences the one that shares more bigrams stays (then that of the
higher dice, then the first name), so that licences that hold most of another do not count for it.

The templates are a fixed list of notices, headers and short licences; licences of thousands of words are told
by their headers.  There is no join and no shuffle but the final maximum by document.

Edge cases: null and empty texts have no passages; a text of one word has no bigrams and matches nothing;
repeated rows and null ids count together under their id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lociform.llm.common import prepare

_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_GPL_SHORT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = _BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
#: Licences that one line declares, by their identifiers, and other identifiers and names of the same.
IDENTIFIERS = {
    "AGPL-3.0": ("AGPL-3.0-only", "AGPL-3.0-or-later", "AGPLv3"), "Apache-2.0": ("Apache 2.0", "Apache License 2.0", "Apache License Version 2.0"), "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause-Clear"), "BSL-1.0": ("Boost Software License 1.0",), "CC-BY-4.0": (), "CC-BY-NC-4.0": (), "CC-BY-NC-ND-4.0": (), "CC-BY-NC-SA-4.0": (), "CC-BY-ND-4.0": (), "CC-BY-SA-4.0": (),
    "CC0-1.0": (), "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0"), "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"), "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL v1.2"),
    "GPL-2.0": ("GPL-2.0-only", "GPL-2.0-or-later", "GPLv2", "GNU GPLv2"), "GPL-3.0": ("GPL-3.0-only", "GPL-3.0-or-later", "GPLv3", "GNU GPLv3"), "ISC": ("ISC License",), "LGPL-2.1": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPLv2.1"),
    "LGPL-3.0": ("LGPL-3.0-only", "LGPL-3.0-or-later", "LGPLv3"), "MIT": ("MIT License",), "MPL-2.0": ("Mozilla Public License 2.0",), "Unlicense": (), "Zlib": ("zlib License",),
}
_CC = {"BY-NC-ND": "Attribution-NonCommercial-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives"}


def _lines() -> tuple:
    """Lines by which a licence is declared: its identifier after the tag for it, and its names after "licensed under"."""
    tags = [(name, f"SPDX-License-Identifier: {i}") for name, others in IDENTIFIERS.items() for i in (name, *(o for o in others if o.startswith(name)))]
    told = [(name, f"Licensed under {the}{o}") for name, others in IDENTIFIERS.items() for o in others if not o.startswith(name + "-") for the in ("", "the ")]
    commons = [(f"CC-{k}-4.0", text) for k, long in _CC.items() for text in (f"Licensed under CC {k} 4.0.", f"This work is licensed under a Creative Commons {long} 4.0 International License.")]
    return tuple(dict.fromkeys(tags + told + commons))


#: Notices, headers and short licences by which texts declare a licence; the lines above come with them.
TEMPLATES = (
    ("AGPL-3.0", _GPL_SHORT.format("Affero General Public License", 3)),
    ("AGPL-3.0", _GPL.format("Affero General Public License", 3, "Affero General Public License")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("GPL-2.0", _GPL_SHORT.format("General Public License", 2)),
    ("GPL-2.0", _GPL.format("General Public License", 2, "General Public License")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL_SHORT.format("General Public License", 3)),
    ("GPL-3.0", _GPL.format("General Public License", 3, "General Public License")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", _ISC),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", _GPL_SHORT.replace("program", "library").format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", _GPL.replace("program", "library").format("Lesser General Public License", "2.1", "Lesser General Public License")),
    ("LGPL-3.0", _GPL_SHORT.format("Lesser General Public License", 3)),
    ("LGPL-3.0", _GPL.format("Lesser General Public License", 3, "Lesser General Public License")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");"),
    *_lines(),
)

LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, A-Z lower-cased."""
    return re.findall(r"[^\W_]+", text.translate(LOWER))


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


#: Words too common to tell a licence by.
COMMON = frozenset("a an and any as at be by can for has if in is it may no not of on one or that the this to under use was with without you".split())


def telling_words(own: list[str], threshold: float) -> set[str]:
    """Words of which a passage that reaches the threshold has at least one, longest first.

    Such a passage has at least t / (2 - t) of the template's bigrams.  Without any of these words it
    would lack more than the rest.
    """
    spare = len(own) - needed(len(own), threshold)
    found: set[str] = set()
    words = sorted({w for b in own for w in b.split()}, key=lambda w: (w in COMMON, -len(w), w))
    for w in words:
        if sum(any(x in found for x in b.split()) for b in own) > spare:
            break
        found.add(w)
    return found


def needed(n_bigrams: int, threshold: float) -> int:
    """Of a template's bigrams, how many a passage that reaches the threshold has at least."""
    return math.ceil(n_bigrams * threshold / (2 - threshold) - 1e-9)


class Scanner:
    """The templates by bigram, to look for all of them in one pass over a text's bigrams."""

    def __init__(self, templates: tuple, threshold: float) -> None:
        self.threshold = threshold
        self.templates = [(name, len(words_of(text)), frozenset(bigrams_of(text))) for name, text in templates]
        self.by_bigram: dict[str, list[int]] = {}
        for k, (_, _, own) in enumerate(self.templates):
            for b in own:
                self.by_bigram.setdefault(b, []).append(k)

    def passages(self, grams: list[str]) -> list[tuple[float, float, str, int, int]]:
        """(rank, dice, licence, first, end) of all windows that reach the threshold."""
        hits: dict[int, list[int]] = {}
        for at, gram in enumerate(grams):
            for k in self.by_bigram.get(gram, ()):
                hits.setdefault(k, []).append(at)
        found = []
        for k, places in hits.items():
            name, width, own = self.templates[k]
            least = needed(len(own), self.threshold)
            for n, at in enumerate(places):
                if bisect_left(places, at + width - 1) - n < least:
                    continue
                window = set(grams[at : at + width - 1])
                shared = len(window & own)
                dice = 2.0 * shared / (len(window) + len(own))
                if dice >= self.threshold:
                    found.append((shared + dice / 2, dice, name, at, at + width))
        return found

    def scan(self, text: str | None) -> dict[str, float]:
        """The best dice of each licence found in a text."""
        words = words_of(text or "")
        found = sorted(self.passages([f"{a} {b}" for a, b in zip(words, words[1:])]))
        best: dict[str, float] = {}
        if len({name for _, _, name, _, _ in found}) > 1:
            # the best passage of each licence over each word
            over = {name: np.zeros(len(words) + max(w for _, w, _ in self.templates)) for _, _, name, _, _ in found}
            for rank, _, name, first, end in found:
                over[name][first:end] = rank
            beaten = lambda rank, _, name, first, end: any((top := row[first:end].max()) > rank or top == rank and other < name for other, row in over.items() if other != name)
            found = [m for m in found if not beaten(*m)]
        for _, dice, name, _, _ in found:
            best[name] = max(dice, best.get(name, 0.0))
        return best


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(id_col, license, dice): the licences found in each document, with the best dice of each."""
    prepare(df.sparkSession)
    words = sorted(set().union(*(telling_words(bigrams_of(text), threshold) for _, text in templates)))
    telling = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(re.escape, words))})(?![\p{{L}}\p{{N}}])"
    schema = StructType([df.schema[id_col], StructField("license", StringType()), StructField("dice", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in batches:
            rows = [(k, name, round(dice, 6)) for k, text in enumerate(b.column(1).to_pylist()) for name, dice in scanner.scan(text).items()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], schema.names)

    found = df.where(F.lower(text_col).rlike(telling)).select(id_col, text_col).mapInArrow(run, schema)
    return found.groupBy(id_col, "license").agg(F.max("dice").alias("dice"))


def scan_sql(templates: tuple = TEMPLATES, threshold: float = 0.8) -> str:
    """The same over table documents for an engine with list functions."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(name)}, {len(words_of(text))}, [{', '.join(map(quoted, bigrams_of(text)))}])" for k, (name, text) in enumerate(templates))
    return rf"""
WITH t(k, license, width, own) AS (VALUES {rows}),
tb AS (SELECT k, license, width, own, unnest(own) AS gram FROM t),
w AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{{L}}\p{{N}}]+') AS words FROM documents WHERE text IS NOT NULL),
g AS (SELECT r, doc_id, [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))] AS grams FROM w),
p AS (SELECT r, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS at FROM g),
h AS (SELECT p.r, p.at, tb.k, tb.license, tb.width, tb.own FROM p JOIN tb USING (gram)),
d AS (SELECT h.r, g.doc_id, h.license, h.at AS first_, h.at + h.width AS end_, h.own, list_distinct(list_slice(g.grams, h.at, h.at + h.width - 2)) AS window_ FROM h JOIN g USING (r)),
m AS (SELECT r, doc_id, license, first_, end_, len(list_intersect(window_, own)) AS shared, len(window_) + len(own) AS both_ FROM d),
f AS (SELECT *, 2.0 * shared / both_ AS dice, shared + 2.0 * shared / both_ / 2 AS rank_ FROM m WHERE 2.0 * shared / both_ >= {threshold})
SELECT doc_id, license, max(round(dice, 6)) AS dice FROM f
WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.r = f.r AND o.license <> f.license AND o.first_ < f.end_ AND f.first_ < o.end_
  AND (o.rank_ > f.rank_ OR o.rank_ = f.rank_ AND o.license < f.license))
GROUP BY doc_id, license"""
