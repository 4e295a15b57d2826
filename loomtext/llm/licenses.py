"""License scans: texts compared with licence templates by the Dice coefficient over word bigrams.

Text and templates are normalised alike: A-Z lower-cased, and words are runs of ASCII letters, digits and bytes beyond
ASCII, so punctuation, layout and quotes do not matter. A template of b bigrams is compared with every window of b
bigrams of the text, or with the whole text if that is shorter. For sizes a and b the coefficient is
2 * overlap / (a + b), overlap counting repeated bigrams, so it can reach the threshold only if
a >= b * t / (2 - t), and only if a window holds ceil(t * (a + b) / 2) bigrams of the template at all: running sums of
such hits prune templates and windows before any is counted. Of windows that overlap, the best is kept, the first of
equal ones; of templates of one licence the best window counts. Whole licence texts, which hold notices themselves, come
before notices, whatever the coefficients.

Whole texts are scanned, however long. Null, empty and blank texts have no match, an empty table gives no rows, repeated
rows are scanned each, and other columns are not carried along, whatever their names.
"""

from __future__ import annotations

import re
from functools import partial
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.llm._arrays import slices, utf8_flat
from loomtext.llm._held import held
from loomtext.llm.shingles import FACTOR, mixed, word_spans
from loomtext.runtime import ship

#: Least Dice coefficient, in hundredths.
THRESHOLD = 80
PIECE_BYTES = 1 << 20

_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _creative_commons():
    """The notices of each kind and version, in words and in short."""
    words = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version, place in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
            name = "-".join(words[x] for x in kind.split("-"))
            name = name if version == "4.0" else name.replace("NoDerivatives", "NoDerivs")
            yield f"CC-{kind}-{version}", f"This work is licensed under a Creative Commons {name} {version} {place} License."
            yield f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}."


# Public licence notices and texts, by SPDX identifier. No text of one licence is a part of another's.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", f"{_BSD} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", _BSD_NAMES),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    *_creative_commons(),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)

#: Words behind "GNU" that make it another licence.
MEMBERS = ("lesser", "affero", "library", "free")
#: Pairs of words behind a window in which its version may still be told.
BEHIND = 4

_BLANK = np.ones(256, bool)
_BLANK[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = False


def bigrams(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pairs of neighbouring words, and where each text's words start. The pair that begins with a text's
    last word belongs to no text."""
    words, word_at, _ = word_spans(flat, at, _BLANK)
    return (mixed(words[:-1] * np.uint64(FACTOR) + words[1:]) if len(words) > 1 else words[:0]), word_at


def _says_version(text: str) -> np.ndarray:
    """Of each pair of a template's words, whether its second word is a version's number, or the next part of one."""
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    number = [bool(re.fullmatch("v?[0-9]+", w)) for w in words]
    begins = [n and (w[0] == "v" or before in ("version", "v")) for before, w, n in zip(words, words[1:], number[1:])]
    return np.array([b or (i > 0 and begins[i - 1] and number[i + 1]) for i, b in enumerate(begins)], bool)


class Book:
    """Templates as bigram numbers: `known` holds all bigrams' hashes, ascending."""

    def __init__(self, templates=TEMPLATES, threshold: int = THRESHOLD, whole: tuple = ()):
        self.threshold = threshold
        self.notices = len(templates)  # templates from this number on are whole texts
        templates = (*templates, *whole)
        self.names = [name for name, _ in templates]
        flat, at = utf8_flat(pa.array([text for _, text in templates]))
        pairs, word_at = bigrams(flat, at)
        own = [pairs[a : max(a, b - 1)] for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True)]
        self.known = np.unique(np.concatenate(own))
        self.sizes = [len(x) for x in own]
        self.counts = np.zeros((len(own), len(self.known) + 1), np.int64)  # the last column: no template's bigram
        for i, x in enumerate(own):
            np.add.at(self.counts[i], np.searchsorted(self.known, x), 1)
        # What a notice says of its version must be said in the text, as a changed number alone hardly moves the coefficient.
        self.versions = [np.unique(np.searchsorted(self.known, x[_says_version(text)])) if i < self.notices else np.zeros(0, np.int64) for i, (x, (_, text)) in enumerate(zip(own, templates, strict=True))]
        # So must what tells a family's members apart.
        other = [bigrams(*utf8_flat(pa.array([f"gnu {word}"])))[0] for word in MEMBERS]
        other = np.array([np.searchsorted(self.known, x[0]) for x in other if x[0] in self.known], np.int64)
        self.others = [other[self.counts[i][other] == 0] if i < self.notices else other[:0] for i in range(len(own))]
        # A small table tells most bigrams that no template has.
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.known >> np.uint64(48)] = True

    def numbers(self, pairs: np.ndarray) -> np.ndarray:
        """Each bigram's place in `known`, or its length if it is not there."""
        out = np.full(len(pairs), len(self.known), np.int64)
        some = np.flatnonzero(self.maybe[pairs >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.known, pairs[some]), len(self.known) - 1)
        out[some] = np.where(self.known[at] == pairs[some], at, len(self.known))
        return out

    def matches(self, numbers: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(start, end, template, overlap, sizes) of a text's best windows; start and end count bigrams."""
        found = []
        size = len(numbers)
        hit = numbers < len(self.known)
        hits = int(hit.sum())
        for i, b in enumerate(self.sizes):
            a = min(size, b)
            need = -(-self.threshold * (a + b) // 200)
            if need > a or need > hits:
                continue
            inside = np.concatenate(([0], np.cumsum(self.counts[i][numbers] > 0)))
            if inside[-1] < need:
                continue
            held = inside[a:] - inside[:-a]
            best: list[tuple[int, int]] = []
            for start in np.flatnonzero(held >= need).tolist():
                got = np.bincount(numbers[start : start + a], minlength=len(self.known) + 1)
                overlap = int(np.minimum(got, self.counts[i])[:-1].sum())
                if overlap >= need and np.isin(self.versions[i], numbers[start : start + a + BEHIND]).all() and not got[self.others[i]].any():
                    best.append((-overlap, start))
            taken: list[int] = []
            for overlap, start in sorted(best):
                if all(abs(start - other) >= a for other in taken):
                    taken.append(start)
                    found.append((start, start + a, i, -overlap, a + b))
        return found


def full_texts() -> tuple[tuple[str, str], ...]:
    """Whole texts of long licences, as published, by SPDX identifier: the files of the folder `texts`."""
    folder = resources.files("loomtext.llm") / "texts"
    return tuple((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt"))


def _scan(key: str, templates: tuple, threshold: int, whole: tuple, batches):
    book = held(("licenses", templates, threshold, whole), lambda: Book(templates, threshold, whole))
    kinds = [pa.list_(pa.struct([("license", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("dice", pa.float64())]))]
    for batch in batches:
        for piece in slices(batch, batch.schema.names[1], PIECE_BYTES):
            pairs, word_at = bigrams(*utf8_flat(piece.column(1)))
            numbers = book.numbers(pairs)
            rows = []
            for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
                found = sorted((i < book.notices, -2 * overlap / sizes, start, end, book.names[i]) for start, end, i, overlap, sizes in book.matches(numbers[a : max(a, b - 1)])) if b - a > 1 else []
                kept: list[tuple[float, int, int, str]] = []
                for _, dice, start, end, name in found:
                    if all(end <= s or e <= start for _, s, e, _ in kept):
                        kept.append((dice, start, end, name))
                rows.append([{"license": name, "start_word": start, "end_word": end + 1, "dice": -dice} for dice, start, end, name in sorted(kept, key=lambda x: x[1:])])
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, kinds[0])], names=[key, "matches"])


def scan(df: DataFrame, templates: tuple = TEMPLATES, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text", whole: tuple | None = None) -> DataFrame:
    """Rows (key, matches): licences found, in order of place, with words from and to and the Dice coefficient. `whole`:
    whole licence texts, those of full_texts() unless given."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(partial(_scan, key, templates, threshold, full_texts() if whole is None else whole), f"`{key}` {kind}, matches array<struct<license string, start_word bigint, end_word bigint, dice double>>")
