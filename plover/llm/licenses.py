"""License scans: sparse TF-IDF cosine to templates, then inheritance by directory.

Notices of a whole text are its lines, its sentences and every run of as many
words as a template has, so a notice may be wrapped over lines or stand within a
long sentence; a licence file is also compared as a whole with the licence
texts. Notices and templates are TF-IDF vectors. The document frequencies of all
words come from all texts; words of fewer than ``LEAST_SHARE`` of the texts
weigh alike, so a notice counts the same in a small table and a large one, and
the words to send to tasks are bounded by the mean number of distinct words of a
text over that share.

A notice reaches the threshold only if it holds the words of enough of a
template's squared weight, so other texts and notices are passed by, which loses
nothing.

A file without a notice of its own inherits the license of the nearest ancestor
directory that has a licence file. Directories, not files, are joined with
their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.session import materialize

#: Short notices by license.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License", "This project is licensed under the terms of the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "You may not use this file except in compliance with the Apache License"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "Licensed under GPL version 2"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "Licensed under GPL version 3"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Subject to the terms of the Mozilla Public License, version 2.0",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0",),
    "proprietary": ("All rights reserved", "Copyright. All rights reserved", "Confidential and proprietary. Unauthorized copying is prohibited"),
}
#: Headers of source files by license; fixed values.
HEADERS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
}
_AS_IS = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. ' + _AS_IS
#: Whole licence texts, as licence files hold them; fixed values.
TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "BSD-2-Clause": (_BSD + _BSD_END,),
    "BSD-3-Clause": (_BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: A term that a smaller share of texts holds weighs as if this share held it.
LEAST_SHARE = 1e-3
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_BREAK = re.compile(r"\n+|(?<=[.;!?])\s+")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def _counts(most: int = 300_000):
    """Texts that hold each term; the empty term counts all. A task's counts are handed on before they are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        named = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])
        for batch in batches:
            for text in batch.column(1):
                total.update({"", *terms(text.as_py() or "")})
            if len(total) > most:
                yield named()
                total.clear()
        yield named()

    return run


class Matcher:
    """Cosine of notices to the templates; ``seen`` has the texts that hold each term, all of them under ""."""

    def __init__(self, seen: dict[str, int], threshold: float):
        rows, self.threshold = seen.get("", 0), threshold
        self.unknown = 1 - math.log(LEAST_SHARE)
        self.weight = {t: 1 + min(math.log((rows + 1) / (n + 1)), -math.log(LEAST_SHARE)) for t, n in seen.items() if t}
        known = [(name, terms(x)) for table in (TEMPLATES, HEADERS, TEXTS) for name, notices in table.items() for x in notices]
        self.templates = [(name, self.vector(found), len(found)) for name, found in known]
        self.whole = {k for k, (name, found) in enumerate(known) if any(found == terms(x) for x in TEXTS.get(name, ()))}
        self.holders: dict[str, list[int]] = {}
        for k, (_, vector, _) in enumerate(self.templates):
            for term in vector:
                self.holders.setdefault(term, []).append(k)

    def vector(self, found: list[str]) -> dict[str, float]:
        raw = {t: n * self.weight.get(t, self.unknown) for t, n in Counter(found).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()} if norm else {}

    def able(self, held: set[str]) -> list[int]:
        """The templates of which the terms hold enough for a cosine at the threshold."""
        energy: dict[int, float] = {}
        for term in held.intersection(self.holders):
            for k in self.holders[term]:
                energy[k] = energy.get(k, 0.0) + self.templates[k][1][term] ** 2
        return [k for k, e in energy.items() if e >= self.threshold**2 - 1e-9]

    def cosine(self, found: list[str], k: int) -> float:
        vector = self.vector(found)
        return sum(v * vector.get(t, 0.0) for t, v in self.templates[k][1].items())

    def best_run(self, found: list[str], k: int) -> float:
        """The largest cosine of a run of as many terms as the template has, kept up term by term."""
        _, template, m = self.templates[k]
        count: dict[str, int] = {}
        norm = dot = best = 0.0
        for place, term in enumerate(found):
            w, c = self.weight.get(term, self.unknown), count.get(term, 0)
            norm, dot, count[term] = norm + w * w * (2 * c + 1), dot + w * template.get(term, 0.0), c + 1
            if place >= m:
                term = found[place - m]
                w, c = self.weight.get(term, self.unknown), count[term]
                norm, dot, count[term] = norm - w * w * (2 * c - 1), dot - w * template.get(term, 0.0), c - 1
            if place >= m - 1 and dot > 0 and dot * dot > best * best * norm:
                best = dot / math.sqrt(norm)
        return best

    def best(self, text: str, whole: bool = False) -> tuple[str, float] | None:
        """The license of the notice that is nearest to a template; ties by name. ``whole``: the text is a licence file."""
        found = terms(text)
        able = self.able(set(found))
        scores = [(self.best_run(found, k), k) for k in able]
        if able:
            for notice in {*text.split("\n"), *_BREAK.split(text)}:
                some = terms(notice)
                scores += [(self.cosine(some, k), k) for k in self.able(set(some))]
        scores += [(self.cosine(found, k), k) for k in able if whole and k in self.whole]
        top = min(((-score, self.templates[k][0]) for score, k in scores if score >= self.threshold), default=None)
        return (top[1], min(-top[0], 1.0)) if top else None


def _match(seen: dict[str, int], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, file = Matcher(seen, threshold), re.compile(LICENCE_FILE)
        for batch in batches:
            found = [matcher.best(x.as_py() or "", bool(file.match((p.as_py() or "").rpartition("/")[2]))) for p, x in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x and x[0] for x in found], pa.string()), pa.array([x and x[1] for x in found], pa.float64())], ["path", "kept", "own", "similarity"])

    return run


def license_scan(files: DataFrame, threshold: float = 0.7, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per file row: path, license, similarity, inherited_from, and the columns ``keep``.

    ``license`` is the file's own notice, else that of the nearest ancestor
    directory with a licence file that has one (`inherited_from` is that
    directory), else null. Of several licence files in a directory the most
    similar counts, then the first by path. A null path has no ancestors; a null
    or empty text has no notice. Repeated rows are scanned each; other columns
    are ignored. Ids are carried in ``keep``, null or not.
    """
    kept = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(c) for c in keep])
    named = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"), kept.alias("kept"))
    kind = named.schema["kept"].dataType.simpleString()
    counted = materialize(named.select("path", "text").mapInArrow(_counts(), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    rows = counted.filter("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seen = {r["term"]: r["n"] for r in counted.filter(F.col("n") >= LEAST_SHARE * rows).collect()}
    own = materialize(named.mapInArrow(_match(seen, threshold), f"path string, kept {kind}, own string, similarity double"), "notices")
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    own = own.withColumn("directory", F.when(F.col("path").contains("/"), parent).when(F.col("path").isNotNull(), F.lit("")))

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    order = F.struct((-F.col("similarity")).alias("s"), "path", F.col("own").alias("license"))
    held = own.filter(F.col("own").isNotNull() & name.rlike(LICENCE_FILE)).groupBy(F.col("directory").alias("holder")).agg(F.min(order).alias("top"))
    held = held.select("holder", F.col("top.license").alias("held_license"), (-F.col("top.s")).alias("held_similarity"))
    directories = own.filter("own is null and directory is not null").select("directory").distinct()
    parts = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    chain = directories.select("directory", F.posexplode(ancestors).alias("depth", "ancestor"))
    nearest = chain.join(held, F.col("ancestor") == F.col("holder")).groupBy(F.col("directory").alias("d")).agg(F.max(F.struct("depth", "holder", "held_license", "held_similarity")).alias("near"))
    met = own.join(nearest, (F.col("directory") == F.col("d")) & F.col("own").isNull(), "left")
    found = [F.coalesce("own", "near.held_license").alias("license"), F.coalesce("similarity", "near.held_similarity").alias("similarity"), F.col("near.holder").alias("inherited_from")]
    return met.select("path", *found, *[F.col(f"kept.{c}").alias(c) for c in keep])
