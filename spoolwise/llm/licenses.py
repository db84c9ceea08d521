"""License scans: passages compared with license templates by Dice coefficient over word bigrams."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from . import words as W

# Texts of public licenses and of the notices that stand for them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}
LEAST = 0.85


def bigrams(hashes: np.ndarray) -> np.ndarray:
    """A number for each pair of neighbouring words; one word alone is a pair with nothing."""
    if len(hashes) == 1:
        return W.mix(hashes, 77)
    return W.mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:], 78)


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def size_bounds(size: int, least: float) -> tuple[float, float]:
    """Sizes of sets that can reach ``least`` beside one of ``size``: the overlap is at most the lesser size."""
    return least * size / (2 - least), (2 - least) * size / least


@dataclass
class Scanner:
    names: list[str]
    sets: list[set]
    every: np.ndarray
    holds: np.ndarray  # template x bigram of ``every``

    @staticmethod
    def of(templates: Mapping[str, str]) -> Scanner:
        names, sets = [], []
        for name, text in templates.items():
            buf = W.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            w = W.find_words(buf, np.array([0, len(buf)]), W.SYMBOL)
            if len(w.start):
                names.append(name)
                sets.append(set(bigrams(w.hashes()).tolist()))
        every = np.array(sorted(set().union(*sets)), np.uint64)
        return Scanner(names, sets, every, np.array([[int(b) in s for b in every] for s in sets], bool))

    def slice(self, buf: np.ndarray, offsets: np.ndarray, least: float) -> list[list[tuple]]:
        """For each row (template, dice, first word, end word) of the best passage for each template, if good enough.

        Passages are runs of whole sentences (cut after . ! ? before white space, and at line ends). A text is looked at
        for a template only if it holds as many of its bigrams as the least size that can match. Only sentences that
        hold a bigram of the template can begin or end its best passage, and only passages whose number of bigrams lies
        within the size bounds are compared. Of equal passages the first and shortest is taken.
        """
        out: list[list[tuple]] = [[] for _ in range(len(offsets) - 1)]
        low = W.LOWER[buf]
        w = W.find_words(low, offsets, W.SYMBOL)
        if not len(w.start) or not len(self.every):
            return out
        hashes = w.hashes()
        stop = buf == 10
        stop[:-1] |= ((buf[:-1] == 46) | (buf[:-1] == 33) | (buf[:-1] == 63)) & W.SPACE[buf[1:]]
        seen = np.concatenate(([0], np.cumsum(stop)))
        last = np.ones(len(w.start), bool)
        last[:-1] = seen[w.start[1:]] > seen[w.end[:-1]]
        last[w.first[1:][w.first[1:] > 0] - 1] = True
        rows, k = w.rows(), len(self.every)
        same = np.flatnonzero(rows[1:] == rows[:-1])
        # a bigram of every word with the next one, and the bigram that a word makes alone
        grams = np.concatenate((W.mix(hashes[same] * np.uint64(0x9E3779B97F4A7C15) + hashes[same + 1], 78), W.mix(hashes, 77)))
        at = np.minimum(np.searchsorted(self.every, grams), k - 1)
        hit = self.every[at] == grams
        seen_ = np.unique(np.concatenate((rows[same], rows))[hit] * k + at[hit])
        row, gram = seen_ // k, seen_ % k
        for name, own, holds in zip(self.names, self.sets, self.holds):
            enough = np.bincount(row[holds[gram]], minlength=len(out)) >= size_bounds(len(own), least)[0]
            for r in np.flatnonzero(enough).tolist():
                f, e = int(w.first[r]), int(w.first[r + 1])
                ends = (np.flatnonzero(last[f:e]) + f + 1).tolist()
                best = self._best(own, hashes, [f, *ends[:-1]], ends, least)
                if best:
                    out[r].append((name, best[0], best[1] - f, best[2] - f))
        return out

    def _best(self, own: set, hashes: np.ndarray, begins: list[int], ends: list[int], least: float) -> tuple | None:
        """(coefficient, begin, end) of the best run of sentences.

        A run grows sentence by sentence with its set of bigrams. It ends when that set is too large, or when it holds
        every bigram of the template that the text still has: from then on the coefficient can't rise. So a notice that is
        repeated very often costs each of its beginnings one notice.
        """
        small, large = size_bounds(len(own), least)
        first = begins[0]
        pairs = W.mix(hashes[first : ends[-1] - 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[first + 1 : ends[-1]], 78).tolist()
        inner = [pairs[b - first : e - 1 - first] for b, e in zip(begins, ends)]
        lone = {n: int(bigrams(hashes[b:e])[0]) for n, (b, e) in enumerate(zip(begins, ends)) if e - b == 1}
        # the bigram across the border to the sentence before belongs to runs that hold both
        across = [None, *[pairs[b - 1 - first] for b in begins[1:]]]
        at = {n for n, s in enumerate(inner) if not own.isdisjoint(s)} | {n for n, g in lone.items() if g in own}
        cross = {n for n in range(1, len(begins)) if across[n] in own}
        at = sorted({*at, *cross, *[n - 1 for n in cross]})
        rest, later = {}, set()
        for n in range(len(begins) - 1, (at[0] if at else len(begins)) - 1, -1):
            here = own.intersection(inner[n])
            rest[n] = len(later | here)
            later |= here
            if across[n] in own:
                later.add(across[n])
        best = None
        for x, i in enumerate(at):
            got, shared, grown = set(), 0, i
            for j in at[x:]:
                for n in range(grown, j + 1):
                    new = set(inner[n]) if n == i else {across[n], *inner[n]}
                    new -= got
                    got |= new
                    shared += len(new & own)
                    if len(got) > large:
                        break
                grown = j + 1
                if len(got) > large:
                    break
                size, same = (len(got), shared) if got else (1, int(lone[i] in own))
                if size >= small:
                    d = 2 * same / (size + len(own))
                    if d >= least and (best is None or d > best[0]):
                        best = (d, begins[i], ends[j])
                if shared >= rest[i] and got:
                    break
        return best


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` plus ``licenses``: for each template with a passage of Dice coefficient ``least`` or more the name, the
    coefficient and the passage as a range of words, in the templates' order.

    Texts are normalised to runs of letters and digits in lower case (A-Z) and non-ASCII characters. Null and empty
    texts have no licenses; templates without words are passed over; equal rows fare equally. Columns of ``docs`` pass
    through (``licenses`` is replaced). One pass, no shuffle; a template list is as long as the caller makes it.
    """
    docs = docs.drop("licenses")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(dict(templates))
    kind = pa.list_(pa.struct([("name", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.of(shared.value)
        for batch in batches:
            found = [x for _, _, buf, off in W.text_slices(batch.column(text)) for x in scanner.slice(buf, off, least)]
            made = pa.array([[dict(zip(("name", "dice", "start", "end"), f)) for f in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], made], names=[*names, "licenses"])

    ddl = "licenses array<struct<name:string,dice:double,start:long,end:long>>"
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(ddl).fields]))
