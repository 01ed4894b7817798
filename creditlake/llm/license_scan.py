"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence texts and the notices that name them.
TEMPLATES: dict[str, str] = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-notice": "Released under the MIT License.",
}

#: Further licences, which only passages() and scanned() read; oracle() has those above.
FURTHER: dict[str, str] = {
    "agpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "lgpl-2.1-header": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}

NOT_WORD = r"[^\p{L}\p{N}]+"
KINDS = ("line", "block", "document", "passage")
BLOCK = r"\n[ \t\r]*\n"


def template_bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, in order."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def size_bounds(size: int, least: float) -> tuple[int, int]:
    """The numbers of bigrams that a text can have whose coefficient with size bigrams is least or more."""
    return math.ceil(size * least / (2 - least) - 1e-9), math.floor(size * (2 - least) / least + 1e-9)


def anchors(templates: Mapping[str, str], least: float) -> list[str]:
    """Words of which a text must contain one if its coefficient with any template is least or more.

    It must share size_bounds' lower bound of the template's bigrams; so many words are taken that fewer have none."""
    found: set[str] = set()
    for text in templates.values():
        left = template_bigrams(text)
        need = size_bounds(len(left), least)[0]
        while len(left) >= need and left:
            count = Counter(w for b in left for w in set(b.split()) if len(w) > 5 or len(w) > 2 and not any(len(x) > 5 for y in left for x in y.split()))
            best = next((w for w in sorted(found) if count[w]), None) or min(count, key=lambda w: (-count[w], w))
            found.add(best)
            left = [b for b in left if best not in b.split()]
    return sorted(found)


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " ")), " ")


def bigrams_of(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def _apart(text: Column) -> Column:
    """text with a line end of its own on either side of each line."""
    return F.concat(F.lit("\n"), F.replace(text, F.lit("\n"), F.lit("\n\n")), F.lit("\n"))


def _listed(bigrams: list[str]) -> Column:
    """A constant array; one text, cut up when the plan is made, since a literal for each takes seconds to send."""
    return F.split(F.lit("\n".join(bigrams)), "\n")


def _constants(templates: list[str], least: float) -> Column:
    """For each template its number, its bigrams, the fewest to share, and the most that a passage has. A constant, so
    that the plan has the search once and not for each template."""
    rows = []
    for i, template in enumerate(templates):
        own = template_bigrams(template)
        low, high = size_bounds(len(own), least)
        longest = math.ceil(high * (len(re.sub(r"[\W_]+", " ", template.lower()).split()) - 1) / len(own))
        rows.append(F.struct(F.lit(i).alias("i"), _listed(own).alias("own"), F.lit(low).alias("low"), F.lit(longest).alias("longest")))
    return F.array(*rows)


def passages(bigrams: Column, template: Column, least: float) -> Column:
    """The number and the best coefficient of the passages in an array of bigrams that are alike to a template of _constants.

    A passage is any run of words, across lines and blocks, that begins and ends with a bigram of the template: a longer
    run with other words at its ends is less alike. Runs repeat their bigrams no more than the template does, in
    proportion. Passages that overlap one counted before, from the left, are not counted again."""
    own, low, longest = (template[k] for k in ("own", "low", "longest"))
    none = F.struct(F.lit(0).alias("n"), F.lit(0.0).cast("double").alias("dice"), F.lit(-1).alias("last"))

    def found(all_: Column) -> Column:
        hits = F.filter(F.transform(all_, lambda b, i: F.struct(i.alias("at"), b.alias("b"))), lambda s: F.array_contains(own, s["b"]))
        enough = F.size(F.array_intersect(all_, own)) >= low
        return F.when(enough, F.element_at(F.transform(F.array(F.transform(hits, lambda s: s["at"])), lambda at: counted(all_, at)), 1)).otherwise(none)

    def counted(all_: Column, at: Column) -> Column:
        """Windows of every start from which enough bigrams of the template follow near enough."""
        n = F.size(at)
        starts = F.when(n >= low, F.sequence(F.lit(1), F.greatest(n - low + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, lambda k: F.element_at(at, k + (low - 1)) - F.element_at(at, k) < longest)
        best = F.filter(F.transform(starts, lambda k: F.array_max(F.transform(ends(at, k), lambda e: window(all_, F.element_at(at, k), e)))), lambda w: w["dice"] >= least)
        return F.aggregate(best, none, lambda acc, w: F.struct(
            (acc["n"] + (w["start"] > acc["last"]).cast("int")).alias("n"), F.greatest(acc["dice"], w["dice"]).alias("dice"),
            F.when(w["start"] > acc["last"], w["end"]).otherwise(acc["last"]).alias("last")))

    def ends(at: Column, k: Column) -> Column:
        return F.filter(F.slice(at, k + (low - 1), F.lit(longest)), lambda e: e - F.element_at(at, k) < longest)

    def window(all_: Column, start: Column, end: Column) -> Column:
        held = F.element_at(F.transform(F.array(F.array_distinct(F.slice(all_, start + 1, end - start + 1))), lambda h: F.struct(
            F.size(h).alias("size"), F.size(F.array_intersect(h, own)).alias("shared"))), 1)
        return F.element_at(F.transform(F.array(held), lambda h: F.struct((2.0 * h["shared"] / (h["size"] + F.size(own))).alias("dice"), start.alias("start"), end.alias("end"))), 1)

    return F.element_at(F.transform(F.array(bigrams), found), 1)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES | FURTHER, least: float = 0.9) -> DataFrame:
    """For each row of docs: id_col, license, dice, unit, n_matches.

    Each line, each block between blank lines, and the whole text is lowercased, every run of other characters than
    letters and digits becomes one space, and its set of word bigrams is compared with those templates whose size
    allows a coefficient of least or more. Passages within and across lines and blocks (see passages) are compared too,
    with each template where no line, block or document alike to it lies. n_matches counts (unit or passage, template)
    pairs at least so alike; license, dice and unit are of the best (then the first template by name, then line before
    block before document before passage), null if there is none, as for null and empty texts. One projection: no row moves, and texts without a word that all matches need are
    not cut up. Rows that repeat each have their result; other columns are not read."""
    names = sorted(templates)
    must = "|".join(map(re.escape, anchors(templates, least)))

    def unit(kind: int, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    def bigrams(u: Column) -> Column:
        return F.struct(u["kind"].alias("kind"), F.array_distinct(bigrams_of(words_of(u["text"]))).alias("own"), u["text"].alias("text"))

    def scores(u: Column) -> Column:
        each = []
        for i, name in enumerate(names):
            own = template_bigrams(templates[name])
            low, high = size_bounds(len(own), least)
            size = F.size(u["own"])
            shared = F.size(F.array_intersect(u["own"], _listed(own)))
            dice = F.when((size >= low) & (size <= high), 2.0 * shared / (size + len(own))).otherwise(0.0)
            each.append(F.struct(dice.alias("dice"), F.lit(-i).alias("template"), (-u["kind"]).alias("kind"), u["text"].alias("text")))
        return F.filter(F.array(*each), lambda s: s["dice"] >= least)

    text = F.col("text")
    parts = F.concat(F.transform(F.split(text, "\n"), lambda t: unit(0, t)), F.transform(F.split(text, BLOCK), lambda t: unit(1, t)), F.array(unit(2, text)))
    parts = F.when(F.lower(text).rlike(must), F.filter(parts, lambda u: F.lower(u["text"]).rlike(must))).otherwise(F.array().cast("array<struct<kind:int,text:string>>"))
    hits = F.flatten(F.transform(F.transform(parts, bigrams), scores))

    def left_over(t: Column) -> Column:
        """The passages alike to a template in the text without its lines, blocks and document that are."""
        whole = F.filter(F.col("hits"), lambda h: h["template"] == -t["i"])
        rest = F.aggregate(whole, _apart(text), lambda acc, h: F.replace(acc, _apart(h["text"]), F.lit("\n")))
        got = passages(F.when(F.size(whole) > 0, bigrams_of(words_of(rest))).otherwise(F.col("bigrams")), t, least)
        return F.element_at(F.transform(F.array(got), lambda g: F.struct(g["dice"].alias("dice"), (-t["i"]).alias("template"), F.lit(-3).alias("kind"), g["n"].alias("n"))), 1)

    maybe = F.lower(text).rlike(must)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", hits.alias("hits"), F.when(maybe, bigrams_of(words_of(text))).alias("bigrams"))
    none = F.array().cast("array<struct<dice:double,template:int,kind:int,n:int>>")
    runs = F.when(F.col("bigrams").isNotNull(), F.filter(F.transform(_constants([templates[n] for n in names], least), left_over), lambda g: g["n"] > 0)).otherwise(none)
    units = F.transform("hits", lambda h: F.struct(h["dice"].alias("dice"), h["template"].alias("template"), h["kind"].alias("kind"), F.lit(1).alias("n")))
    rows = rows.select("id", F.concat(units, runs).alias("hits"))
    rows = rows.select("id", F.array_max("hits").alias("best"), F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["n"]).alias("n_matches"))
    found = F.col("best").isNotNull()
    name = F.when(found, F.element_at(F.array(*map(F.lit, names)), 1 - F.col("best.template")))
    kind = F.when(found, F.element_at(F.array(*map(F.lit, KINDS)), 1 - F.col("best.kind")))
    return rows.select(F.col("id").alias(id_col), name.alias("license"), F.col("best.dice").alias("dice"), kind.alias("unit"), "n_matches")


def oracle(least: float = 0.9) -> str:
    """The same scan in SQL, every unit against every template."""
    values = ", ".join(f"({i}, '{n}', [{', '.join(repr(b) for b in template_bigrams(TEMPLATES[n]))}])" for i, n in enumerate(sorted(TEMPLATES)))
    return rf"""
WITH t(i, name, b) AS (VALUES {values}),
u AS (
 SELECT doc_id, 0 AS kind, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT doc_id, 1, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT doc_id, 2, text FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, kind, string_split(trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM u),
g AS (SELECT doc_id, kind, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM w),
s AS (SELECT doc_id, kind, i, name, 2.0 * len(list_intersect(own, b)) / (len(own) + len(b)) AS dice
 FROM g, t WHERE len(own) BETWEEN len(b) * {least} / {2 - least} - 1e-6 AND len(b) * {2 - least} / {least} + 1e-6),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, i, kind) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM s WHERE dice >= {least})
SELECT doc_id, name AS license, CAST(dice AS DOUBLE) AS dice, ['line', 'block', 'document'][kind + 1] AS unit, coalesce(n, 0) AS n_matches
FROM documents LEFT JOIN (SELECT * FROM h WHERE r = 1) USING (doc_id)
"""
