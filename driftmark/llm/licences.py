"""Licence scan by Dice coefficient over word bigrams, in DataFrame functions alone.

Texts are lower-cased words of a-z and 0-9, wherever lines break. A window of a document has as many
words as a template (or all, if the document has fewer) and carries the template's licence if the
Dice coefficient of their distinct bigrams is at least ``least``. Dice >= t needs a share t / (2 - t)
of the template's bigrams, so of any larger rest one must be there: a template's anchors are such a
rest, and a window lies so that one anchor of the document takes its place in the template. Sizes
prune templates: 2 min(a, b) / (a + b) bounds the coefficient. Each template counts once a document,
with its best window (ties: the first).

Null and empty texts and texts of fewer than two words match nothing; repeated rows give a row each;
texts of any length are scanned whole; an empty table gives no rows. Columns beside the id and the
text are not read. There is no shuffle.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices, headers and whole texts as the licences word them. A slash parts a licence from the kind of its text.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0/header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2/text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3/clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "bsl-1.0/text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0/header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc/text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "lgpl-2.1/header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "mit": "Released under the MIT License.",
    "mit/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit/text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0/header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense/text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "zlib/text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    """Distinct bigrams of normalised words, in order."""
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def anchors(text: str, least: float) -> list[tuple[str, int]]:
    """(bigram, first place) of bigrams of which a match holds at least one; the longest are taken as the rarest."""
    words, grams = words_of(text), bigrams(text)
    first = {}
    for i, g in enumerate(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)):
        first.setdefault(g, i)
    need = math.ceil(least / (2 - least) * len(grams) - 1e-9)
    return [(g, first[g]) for g in sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - need + 1]]


def trie(words: list[str]) -> str:
    """A pattern of any of the words that shares their beginnings, so that a search turns away early."""
    if "" in words:
        rest = trie([w for w in words if w])
        return f"(?:{rest})?" if rest else ""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    parts = [("[^a-z0-9]++" if c == " " else c) + trie(sorted(set(own))) for c, own in sorted(by.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _let(value, body):
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, matches (array of licence, kind, dice, start and words of the best window of each template, by template)."""
    known = [(k, t) for k, t in sorted((templates or TEMPLATES).items()) if bigrams(t)]
    found = [(g, i, at) for i, (_, t) in enumerate(known) for g, at in anchors(t, least)]
    names = sorted({g for g, *_ in found})
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    maybe = low.rlike(f"(?<![a-z0-9])(?:{trie(names)})(?![a-z0-9])") if names else F.lit(False)
    entries = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(i).alias("t"), F.lit(at).alias("at")) for g, i, at in found])
    table = F.array(*[F.struct(F.lit(k.split("/")[0]).alias("licence"), F.lit(k.partition("/")[2] or "notice").alias("kind"), F.lit(len(words_of(t))).alias("words"), F.lit(len(bigrams(t))).alias("n"), F.split(F.lit("|".join(bigrams(t))), r"\|").alias("grams")) for k, t in known])

    def windows(grams):
        """Distinct (template, first word) of the windows that anchors lay."""
        hits = F.filter(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda h: h["g"].isin(names))
        start = lambda h, e: F.greatest(F.lit(0), F.least(h["i"] - e["at"], F.size(grams) + 1 - table[e["t"]]["words"]))
        # As one number each, which are told apart by hashing; structs would be compared pair by pair.
        laid = F.transform(hits, lambda h: F.transform(F.filter(entries, lambda e: e["g"] == h["g"]), lambda e: F.shiftleft(e["t"].cast("long"), 40) + start(h, e)))
        return F.transform(F.array_sort(F.array_distinct(F.flatten(laid))), lambda w: F.struct(F.shiftright(w, 40).cast("int").alias("t"), w.bitwiseAND(F.lit((1 << 40) - 1)).cast("int").alias("start")))

    def measured(grams, w):
        t = table[w["t"]]
        own = F.array_distinct(F.slice(grams, w["start"] + 1, t["words"] - 1))
        low_, high = least / (2 - least), (2 - least) / least

        def dice(x):
            fits = (F.size(x) >= t["n"] * low_ - 1e-9) & (F.size(x) <= t["n"] * high + 1e-9)
            return F.when(fits, F.lit(2.0) * F.size(F.array_intersect(x, t["grams"])) / (F.size(x) + t["n"]))

        return F.struct(w["t"].alias("t"), (-_let(own, dice)).alias("less"), w["start"].alias("start"))

    def matches(words):
        grams = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        good = _let(grams, lambda g: F.array_sort(F.filter(F.transform(windows(g), lambda w: measured(g, w)), lambda m: m["less"] <= -least + 1e-12)))
        first = _let(good, lambda a: F.filter(a, lambda m, i: (i == 0) | (m["t"] != F.get(a, i - 1)["t"])))
        return F.transform(first, lambda m: F.struct(table[m["t"]]["licence"].alias("licence"), table[m["t"]]["kind"].alias("kind"), (-m["less"]).alias("dice"), m["start"].cast("long").alias("start"), F.least(table[m["t"]]["words"], F.size(words)).cast("long").alias("words")))

    none = F.array().cast("array<struct<licence:string,kind:string,dice:double,start:bigint,words:bigint>>")
    words = F.split(F.trim(F.regexp_replace(F.col("dm_low"), "[^a-z0-9]+", " ")), " ")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), low.alias("dm_low"), maybe.alias("dm_maybe"))
    return rows.select("doc_id", F.when(F.col("dm_maybe"), _let(words, matches)).otherwise(none).alias("matches"))
