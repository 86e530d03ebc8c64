"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

Native: SQL functions only. Words are lower-case runs of letters and digits, so line breaks, comment marks and
quotes do not count; the coefficient is ``2 |A and B| / (|A| + |B|)`` over distinct bigrams. Units are every
line, every whole text of several lines, and windows: as many words as the template has, from
each place on where one of the template's bigrams stands (fewer at the end of the text), so notices that
are wrapped, commented out or part of longer lines are found inside any file.

Sizes bound the work. A coefficient of ``t`` needs sizes that differ by a factor of at most ``(2 - t) / t``, so a line meets
only the templates within these bounds; and it needs ``t / (2 - t)`` of the template's bigrams, so windows are laid only for
templates of which the whole text has that share. For that the text's bigrams are reduced to those that any template has.

Each row gets its best template: the highest coefficient, then the most shared bigrams, the smaller template name, and
the earlier unit (0 is the whole text, lines count from 1, windows come last; ``word_start`` is the place of
a window's first word). Null texts, texts without two words and an empty table find nothing; rows that repeat get
equal results. Long texts are one row; the windows of a text grow with the places where template bigrams stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.common import prepare
from kilnworks.llm.shingle_sql import letter_words

LEAST_DICE = 0.8

# Public licence notices and short licence texts, without the lines that name a year and a holder.
_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
          "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
          "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
          '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
          "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
          "furnished to do so, subject to the following conditions:")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:")
_BSD_TWO = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution.")
_BSD_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
              "this software without specific prior written permission.")
_BSD_END = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
            "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
            "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
            "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
            "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
            "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_GNU_END = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of "
            "the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.")
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-boilerplate": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                              "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
                              'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
                              "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                              "limitations under the License.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                         "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": f"{_BSD} {_BSD_TWO} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD} {_BSD_TWO} {_BSD_THIRD} {_BSD_END}",
    "BSD-clauses": _BSD,
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                      "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                      "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _GNU_END,
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                      "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. " + _GNU_END,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
           "the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": _GRANT,
    "MIT-text": f"{_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
                'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
                "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
                "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
                "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
                "SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                 "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
            "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
            "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
            "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
            "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
            "software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


#: Windows are numbered behind all lines.
_WINDOWS = 1 << 40


def bigrams(words):
    """Hashes of neighbouring words, in order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, least_dice: float = LEAST_DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence (null if none), shared and sizes of the bigram sets, unit (null for a window) and word_start (null for others), of every row."""
    spark = prepare(docs.sparkSession)
    # the templates are a short list given by the caller, so their bigrams are literals of the plan
    table = (spark.createDataFrame(sorted(notices.items()), "licence string, notice string").select("licence", letter_words(F.col("notice")).alias("w"))
             .select("licence", F.size("w").alias("n"), F.array_distinct(bigrams(F.col("w"))).alias("b")).where(F.size("b") > 0).collect())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("x"))
    empty = F.lit(None)
    if not table:
        return rows.select("doc_id", empty.cast("string").alias("licence"), *[empty.cast("long").alias(c) for c in ("shared", "n_text", "n_notice", "unit", "word_start")])
    reach = (2 - least_dice) / least_dice
    most, fewest = int(max(len(t["b"]) for t in table) * reach) + 1, int(min(len(t["b"]) for t in table) / reach) - 1
    known = F.array(*[F.struct(F.lit(t["licence"]).alias("licence"), F.lit(t["n"]).alias("n"), F.array(*[F.lit(h) for h in t["b"]]).alias("b")) for t in table])
    any_known = F.array(*[F.lit(h) for h in sorted({h for t in table for h in t["b"]})])
    lines = F.transform(F.split(F.coalesce("x", F.lit("")), "\n"), lambda x: letter_words(x))
    rows = rows.select("doc_id", lines.alias("l")).withColumn("all", F.flatten("l")).withColumn("g", bigrams("all"))
    units = F.concat(F.array(F.when(F.size("l") > 1, F.col("all"))), F.col("l"))
    # a unit needs more distinct bigrams than the smallest template allows, so more words than that; long units
    # are cut off by their distinct bigrams, not by their words, as words may repeat
    rows = rows.withColumn("u", F.transform(units, lambda u, i: F.struct(i.alias("unit"), F.when(F.size(u) > fewest, F.array_distinct(bigrams(u))).alias("b"))))
    rows = rows.withColumn("some", F.array_intersect("g", any_known))
    rows = rows.select("doc_id", "g", "some", F.filter("u", lambda u: F.size(u["b"]).between(F.lit(fewest), F.lit(most))).alias("u")).withColumn(
        "t", F.when((F.size("u") > 0) & (F.size("some") > 0), known))
    # of which the whole text has enough bigrams for any of its windows
    rows = rows.withColumn("inside", F.filter("t", lambda t: F.size(F.array_intersect(F.col("some"), t["b"])) * reach >= F.size(t["b"])))

    def measured(t, b, unit):
        return F.struct(F.size(F.array_intersect(t["b"], b)).cast("long").alias("shared"), F.size(b).cast("long").alias("n_text"),
                        F.size(t["b"]).cast("long").alias("n_notice"), t["licence"].alias("licence"), unit.cast("long").alias("unit"))

    def against(u):
        # the most that sets of these sizes can reach
        near = F.filter("t", lambda t: 2.0 * F.least(F.size(t["b"]), F.size(u["b"])) / (F.size(t["b"]) + F.size(u["b"])) >= least_dice)
        return F.transform(near, lambda t: measured(t, u["b"], u["unit"]))

    def windows(t):
        starts = F.filter(F.transform("g", lambda h, i: F.when(F.array_contains(t["b"], h), i)), lambda i: i.isNotNull())
        return F.transform(starts, lambda i: measured(t, F.array_distinct(F.slice("g", i + 1, t["n"] - 1)), i + F.lit(_WINDOWS)))

    rows = rows.withColumn("m", F.concat(F.flatten(F.transform("u", against)), F.flatten(F.transform("inside", windows))))
    dice = lambda m: 2.0 * m["shared"] / (m["n_text"] + m["n_notice"])
    best = F.array_sort(F.filter("m", lambda m: dice(m) >= least_dice), lambda a, b: (
        F.when(dice(a) > dice(b), -1).when(dice(a) < dice(b), 1).when(a["shared"] > b["shared"], -1).when(a["shared"] < b["shared"], 1)
        .when(a["licence"] < b["licence"], -1).when(a["licence"] > b["licence"], 1).when(a["unit"] < b["unit"], -1).when(a["unit"] > b["unit"], 1).otherwise(0)))
    rows = rows.withColumn("best", F.get(best, F.lit(0)))
    unit = F.col("best.unit")
    return rows.select("doc_id", *[F.col(f"best.{c}").alias(c) for c in ("licence", "shared", "n_text", "n_notice")],
                       F.when(unit < _WINDOWS, unit).alias("unit"), F.when(unit >= _WINDOWS, unit - _WINDOWS).alias("word_start"))
