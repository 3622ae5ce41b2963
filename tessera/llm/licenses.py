"""License scan: Dice coefficient over word bigrams against licence templates.

Texts are normalised (lower case, everything but letters and digits becomes a space) and compared
to each template unit by unit: every line, every paragraph of several lines, and the whole text.
Texts that hold no anchor (one of a few words of each template, without which too few of its bigrams are
left) are dropped first. Before any bigram is built, size bounds prune: two sets can only reach a Dice coefficient of t if
the smaller holds at least t / (2 - t) of the larger, so a unit meets only templates of like size,
and a unit that is like none in size is dropped. What no unit matched is then searched by windows of
each template's own length that slide over the words of the whole text, across lines and paragraphs.
A template is searched for only if the text holds one of its anchors; windows begin and end at a bigram of the template, and are compared where
enough of these lie in one. All of it is one projection of native functions; there is no shuffle, and
templates are a literal of fixed size.

Defined results: one row per unit that reaches the threshold, with its best template (ties: the
first name), and one per window, best first, that overlaps no better one and no such unit (its
unit_index is the number of its first word in the text without such units); null and empty texts, and tables without rows, give none; repeated rows give their
rows again; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let

THRESHOLD = 0.8
#: The parts of the BSD texts and of the GNU notices.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
    "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(what: str, license_: str, version: str) -> str:
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {license_} as published by the Free Software Foundation, "
        f"{version} (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {license_} for more details. You should have received a copy of the "
        f"{license_} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )


#: Notices and short licence texts, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "BSD-2-Clause-text": _BSD_HEAD + _BSD_TWO + _BSD_TAIL,
    "BSD-3-Clause-text": _BSD_HEAD + _BSD_TWO + _BSD_THIRD + _BSD_TAIL,
    "GPL-2.0-header": _gnu("program", "GNU General Public License", "either version 2 of the License, or"),
    "GPL-3.0-header": _gnu("program", "GNU General Public License", "either version 3 of the License, or"),
    "AGPL-3.0-header": _gnu("program", "GNU Affero General Public License", "either version 3 of the License, or"),
    "LGPL-2.1-header": _gnu("library", "GNU Lesser General Public License", "either version 2.1 of the License, or"),
    "LGPL-3.0-header": _gnu("program", "GNU Lesser General Public License", "either version 3 of the License, or"),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution."
    ),
}


#: Stands in a text for a unit that matched; no template has it.
_GONE = " \x01 "
#: Words that are poor anchors, as many texts have them.
_COMMON = frozenset(
    "a above all an and any are as at be by for from in is it may no not of on or see shall that the this to under use with without you "
    "action agreed altered applicable author authors basis binary claim code commercial conditions copy copies details domain even file free general including library must "
    "other others names name product products program provided purpose rights source version following must form forms list made make obtain person people".split()
)


def template_bigrams(text: str) -> list[str]:
    found = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:], strict=False)})


def _bounds(size, threshold: float) -> tuple[float, float]:
    least = threshold / (2 - threshold)
    return size * least, size / least


def _needed(size: int, threshold: float) -> int:
    """Bigrams of a template that a window must hold to reach the threshold, however short it is."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9)


def anchors(grams: list[str], threshold: float, known: frozenset | set = frozenset()) -> list[str]:
    """Words of which every window or unit that reaches the threshold holds one at least; `known` ones first among equals."""
    left, chosen = {g: g.split() for g in grams}, []
    spare = len(grams) - _needed(len(grams), threshold)
    while len(grams) - len(left) <= spare:
        uses = Counter(w for pair in left.values() for w in set(pair))
        word = min(uses, key=lambda w: (w in _COMMON or w.isdigit(), len(w) < 4, w not in known, -uses[w], w))
        chosen.append(word)
        left = {g: pair for g, pair in left.items() if word not in pair}
    return chosen


def all_anchors(templates: dict[str, str], threshold: float) -> dict[str, list[str]]:
    """The anchors of each template; short templates choose first, as they have the least choice."""
    found: dict[str, list[str]] = {}
    known: set[str] = set()
    for name, grams in sorted(((n, template_bigrams(t)) for n, t in templates.items()), key=lambda x: (len(x[1]), x[0])):
        found[name] = anchors(grams, threshold, known)
        known.update(found[name])
    return found


def may_match(text: Column, templates: dict[str, str], threshold: float) -> Column:
    """False for texts that hold no anchor of any template, and so no match: one search for each anchor in the
    lower-cased text, before anything is normalised or cut. A short anchor must also be a word of its own."""
    words = sorted({w for own in all_anchors(templates, threshold).values() for w in own}, key=lambda w: (len(w) < 4, w))

    def held(lower: Column) -> Column:
        gate = F.lit(False)
        for word in words:
            found = lower.contains(word)
            gate = gate | (found if len(word) > 3 else found & lower.rlike(rf"(?:^|[^\p{{L}}\p{{N}}]){word}(?:[^\p{{L}}\p{{N}}]|$)"))
        return gate

    return let(F.lower(text), held)


def read_templates(folder: str) -> dict[str, str]:
    """Templates from the files of a folder, by file name without .txt: full licence texts of one's own choice."""
    return {p.name.removesuffix(".txt"): p.read_text(errors="replace") for p in sorted(Path(folder).iterdir()) if p.is_file()}


def _windows(norm: Column, templates: dict[str, str], threshold: float) -> Column:
    """Array of (unit, unit_index, best) of the windows of a normalised text."""
    entries, every, chosen = [], set(), all_anchors(templates, threshold)
    for name, text in sorted(templates.items()):
        grams, length = template_bigrams(text), len(re.findall("[a-z0-9]+", text.lower())) - 1
        own = chosen[name]
        every.update(own)
        entries.append(F.struct(
            F.lit(name).alias("name"), F.lit(len(grams)).alias("size"), F.lit(length).alias("length"), F.lit(_needed(len(grams), threshold)).alias("needed"),
            F.array(*[F.lit(f" {w} ") for w in own]).alias("anchors"), F.array(*map(F.lit, grams)).alias("grams"),
        ))
    table = F.array(*entries)

    def of_template(grams: Column, t: Column) -> Column:
        at = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t["grams"], g), i)), lambda i: i.isNotNull())

        def window(hits: Column, k: Column) -> Column:
            start = F.get(hits, k)
            dense = F.get(hits, k + t["needed"] - 1) < start + t["length"]
            last = lambda: F.array_max(F.filter(F.slice(hits, k + 1, t["length"]), lambda h: h < start + t["length"]))
            judge = lambda own, end: F.struct((F.size(F.array_intersect(own, t["grams"])) * -2.0 / (F.size(own) + t["size"])).alias("less"), (-t["size"]).alias("smaller"), t["name"].alias("license"), start.alias("start"), end.alias("end"))
            return F.when(dense, let(last(), lambda end: let(F.array_distinct(F.slice(grams, start + 1, end - start + 1)), lambda own: judge(own, end))))

        return let(at, lambda hits: F.filter(F.transform(hits, lambda _, k: window(hits, k)), lambda w: w["less"] <= -threshold))

    def search(text: Column) -> Column:
        near = F.filter(table, lambda t: F.exists(t["anchors"], lambda a: text.contains(a)))
        words = F.filter(F.split(text, " "), lambda w: w != "")
        pairs = let(words, lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)))
        grams = F.filter(pairs, lambda x: x.isNotNull())
        found = F.array_sort(let(grams, lambda g: F.flatten(F.transform(near, lambda t: of_template(g, t)))))
        none = F.filter(found, lambda _: F.lit(False))
        # A window is of the words start .. end + 1.
        return F.aggregate(found, none, lambda kept, x: F.when(F.exists(kept, lambda y: (y["start"] <= x["end"] + 1) & (x["start"] <= y["end"] + 1)), kept).otherwise(F.concat(kept, F.array(x))))

    padded = F.concat(F.lit(" "), F.regexp_replace(norm, r"[ \n]+", " "), F.lit(" "))
    gate = F.lit(False)
    for word in sorted(every):
        gate = gate | padded.contains(f" {word} ")
    rows = F.transform(search(padded), lambda w: F.struct(F.lit("window").alias("unit"), w["start"].alias("unit_index"), F.struct(w["less"].alias("less"), w["license"].alias("license")).alias("best")))
    return F.when(gate, rows)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit (line, paragraph, text, window), unit_index, license, dice."""
    known = sorted((name, template_bigrams(text)) for name, text in templates.items())
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(grams)).alias("size"), F.array(*map(F.lit, grams)).alias("grams")) for name, grams in known])
    sizes = sorted({len(grams) for _, grams in known})

    def like(size: Column) -> Column:
        """A size that some template's bounds admit; spans that touch are joined."""
        spans: list[list[float]] = []
        for low, high in (_bounds(s, threshold) for s in sizes):
            if spans and low <= spans[-1][1] + 1:
                spans[-1][1] = max(high, spans[-1][1])
            else:
                spans.append([low, high])
        test = F.lit(False)
        for low, high in spans:
            test = test | size.between(low, high)
        return test

    def unit(kind: str):
        return lambda words, i: F.struct(F.lit(kind).alias("unit"), i.alias("unit_index"), words.alias("words"))

    # A unit of n words has n - 1 bigrams at most (repeats count once), so only its lower bound holds for words.
    floor = _bounds(sizes[0], threshold)[0] + 1

    def bigrams(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))

    def best(grams: Column) -> Column:
        def score(t: Column) -> Column:
            low, high = _bounds(t["size"], threshold)
            near = F.size(grams).between(low, high)
            dice = F.when(near, F.size(F.array_intersect(grams, t["grams"])) * 2.0 / (F.size(grams) + t["size"]))
            return F.when(dice >= threshold, F.struct((-dice).alias("less"), t["name"].alias("license")))

        return F.array_min(F.transform(table, score))

    docs = docs.select("doc_id", "text").filter(may_match(F.col("text"), templates, threshold))
    norm = docs.select("doc_id", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ").alias("norm"))
    broken = r"\n(?:[ ]?\n)+"
    parts = norm.select("doc_id", "norm", F.split("norm", "\n").alias("lines"), F.filter(F.split("norm", broken), lambda p: p.contains("\n")).alias("paragraphs"))
    several = F.when(F.size("lines") > 1, F.array("norm")).otherwise(F.array().cast("array<string>"))
    texts = F.concat(
        F.transform("lines", unit("line")),
        F.transform("paragraphs", unit("paragraph")),
        F.transform(several, unit("text")),
    )
    blank = r"[ \n]+"
    pruned = F.filter(texts, lambda u: F.char_length(u["words"]) >= 2 * floor - 1)
    cut = F.transform(pruned, lambda u: F.struct(u["unit"].alias("unit"), u["unit_index"].alias("unit_index"), F.filter(F.split(u["words"], blank), lambda w: w != "").alias("words")))
    sized = F.filter(cut, lambda u: F.size(u["words"]) >= floor)
    grams = F.filter(F.transform(sized, lambda u: F.struct(u["unit"].alias("unit"), u["unit_index"].alias("unit_index"), bigrams(u["words"]).alias("grams"))), lambda u: like(F.size(u["grams"])))
    judged = F.filter(F.transform(grams, lambda u: F.struct(u["unit"].alias("unit"), u["unit_index"].alias("unit_index"), best(u["grams"]).alias("best"))), lambda u: u["best"].isNotNull())
    units = parts.select("doc_id", "norm", "lines", "paragraphs", judged.alias("judged"))

    def matched(kind: str, texts: str) -> Column:
        return F.transform(F.filter("judged", lambda u: u["unit"] == kind), lambda u: F.get(F.col(texts), u["unit_index"]))

    def without(text: Column, pattern: str, gone: Column, joiner: str) -> Column:
        return F.array_join(F.transform(F.split(text, pattern), lambda x: F.when(F.array_contains(gone, x), F.lit(_GONE)).otherwise(x)), joiner)

    rest = without(without(F.col("norm"), broken, matched("paragraph", "paragraphs"), "\n\n"), "\n", matched("line", "lines"), "\n")
    rest = F.when(F.size("judged") <= 0, F.col("norm")).when(~F.exists("judged", lambda u: u["unit"] == "text"), rest)
    left = units.select("doc_id", "judged", rest.alias("rest"))
    both = left.select("doc_id", "judged", _windows(F.col("rest"), templates, threshold).alias("windows"))
    none = F.filter("judged", lambda _: F.lit(False))
    found = both.select("doc_id", F.explode(F.concat("judged", F.coalesce("windows", none))).alias("u"))
    return found.select("doc_id", F.col("u.unit").alias("unit"), F.col("u.unit_index").cast("long").alias("unit_index"), F.col("u.best.license").alias("license"), (-F.col("u.best.less")).alias("dice"))
