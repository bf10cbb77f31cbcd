"""Licence scans: normalised passages against licence templates by the Dice coefficient over word bigrams, in DataFrame operations only.

A document's passages are the whole text, its paragraphs, its lines, and its longest runs of lines that read like
licences (half of a line's bigrams occur in some template), which finds notices wrapped beside other text. With a threshold t, a passage of a
bigrams can only match a template of b if t / (2 - t) <= a / b <= (2 - t) / t: these bounds prune the
templates of a passage, and passages that fit none are not looked at further. A second bound needs the
passage alone: enough of its bigrams must occur in any template at all. Only what passes both is
joined with the templates' bigrams and counted. Licences that differ in few words are told apart by them: a
passage has to have the template's version numbers and exactly its variant words, and of the templates left the
best one counts.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Short forms and notices of common licences, as they are published.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-rights-reserved", "All rights reserved."),
]
#: How short notices name a licence, and the verbs they begin with.
NAMES: list[tuple[str, str]] = [
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    ("CC0-1.0", "CC0 1.0"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("EPL-2.0", "the Eclipse Public License, version 2.0"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("ISC", "the ISC License"),
    ("MIT", "the MIT License"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("Unlicense", "the Unlicense"),
]
VERBS = ("Licensed", "Released", "Distributed", "Available", "Provided", "Published")
TEMPLATES += [t for name, called in NAMES for verb in VERBS if (t := (name, f"{verb} under {called}.")) not in TEMPLATES]
#: The closing paragraphs of the MIT, ISC and BSD licences, and the terms of the latter, as they are published.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_START = {name: next(t for n, t in TEMPLATES if n == name and t.startswith("Permission")) for name in ("MIT", "ISC")}
#: The licences whose whole text is a template.
WHOLE = {"MIT": f"{_START['MIT']} {_AS_IS}", "ISC": f"{_START['ISC']} {_ISC_END}", "BSD-2-Clause": f"{_BSD} {_BSD_END}", "BSD-3-Clause": f"{_BSD} {_BSD_THIRD} {_BSD_END}"}
TEMPLATES += list(WHOLE.items())
#: Words that make another licence of one; a passage has exactly those of its template. Version numbers are single digits; a passage has all those of its template.
VARIANTS = ("affero", "endorse", "lesser", "library", "nc", "nd", "noderivatives", "noncommercial", "sa", "sharealike")
DIGITS = tuple("123456789")
_PY_WORD = re.compile(r"[^\W_]+")


def template_words(text: str) -> list[str]:
    return _PY_WORD.findall(text.lower())


def normal_words(line: Column) -> Column:
    """Words of a line: lower-cased runs of letters and digits; none for a line that states a copyright."""
    low = F.lower(line)
    stated = F.contains(low, F.lit("copyright")) & low.rlike(r"^[^\p{L}\p{N}]*copyright\b")
    return F.when(stated, F.array().cast("array<string>")).otherwise(F.array_remove(F.split(low, r"[^\p{L}\p{N}]+"), ""))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``id, licence, dice, passages``: for each document the licences it states, the best coefficient and the number of passages that do.

    Bigrams are counted with repeats: the coefficient is twice the common ones over the sum of both
    numbers. Passages are different sequences of words among the whole document, its paragraphs (between empty
    lines), its lines and its longest runs of licence-like lines (lines of one word or none continue a run; notices in
    one run without another line between them count together). A passage counts for the best of the templates whose variant words and
    version numbers it has, of equal ones for each. Very long texts are put into words whole, but only passages that fit
    a template's size go on. Templates of one word have no bigrams and match nothing, like null, empty and one-word
    passages. Rows that repeat an id count together, a null id is an id. Other columns are not read. An
    empty table or no templates give an empty result. The templates are a parameter of fixed size.
    """
    spark = docs.sparkSession
    own = [(n, name, Counter(" ".join(x) for x in zip(w, w[1:])), len(w) - 1) for n, (name, text) in enumerate(templates) if len(w := template_words(text)) > 1]
    if not own:
        return docs.limit(0).select(F.col(f"`{id_col}`").alias("id"), F.lit("").alias("licence"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("passages"))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    marks = {n: (" ".join(sorted(set(w) & set(VARIANTS))), " ".join(sorted(set(w) & set(DIGITS)))) for n, (_, text) in enumerate(templates) for w in [template_words(text)]}
    text_of = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({n}, {text_of(name)}, {', '.join(map(text_of, g.split(' ')))}, {k}, {size}, {text_of(marks[n][0])}, {text_of(marks[n][1])})" for n, name, c, size in own for g, k in c.items())
    table = spark.sql(f"SELECT template, licence, xxhash64(first, second) AS gram, times, b, variants, digits FROM VALUES {values} AS t(template, licence, first, second, times, b, variants, digits)")
    known = sorted({r["gram"] for r in table.select("gram").collect()})  # the templates' bigrams

    text = F.col(f"`{text_col}`")
    a = F.col("a")

    def fits(n: Column) -> Column:
        """Size bounds: some template must be able to reach the threshold."""
        return reduce(lambda x, y: x | y, [(n >= b * low - 1e-9) & (n <= b * high + 1e-9) for b in sorted({size for _, _, _, size in own})]) & (n >= 1)

    # each line is put into words once; the whole text's words are those of its lines, and paragraphs are only cut where there is an empty line
    lines = docs.where(text.isNotNull()).select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.split(text, r"\r\n|[\n\r]").alias("lines")).withColumn("words", F.transform("lines", normal_words))
    none = F.array().cast("array<array<string>>")
    gap = r"(?:\r\n|[\n\r])[ \t]*(?:\r\n|[\n\r])+"
    part = lambda p: F.flatten(F.transform(F.split(p, r"\r\n|[\n\r]"), normal_words))
    n_of = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    met_of = lambda w: F.filter(F.zip_with(F.slice(w, F.lit(1), n_of(w)), F.slice(w, F.lit(2), n_of(w)), lambda x, y: F.xxhash64(x, y)), lambda g: g.isin(known))
    # other lines become a mark, and the text between marks is a run; words hold neither line ends nor marks
    like = F.transform("words", lambda w: F.when((F.size(w) < 2) | (2 * F.size(met_of(w)) >= F.size(w) - 1), F.array_join(w, " ")).otherwise(F.lit("\0")))
    runs = F.transform(F.filter(F.split(F.array_join(like, "\n"), "\0"), lambda r: F.contains(F.trim(r, F.lit("\n")), F.lit("\n"))), lambda r: F.array_remove(F.split(r, r"[ \n]+"), ""))
    passages = F.concat(
        F.array(F.flatten("words")), F.col("words"), runs,
        F.when(F.col("text").rlike(gap), F.transform(F.split("text", gap), part)).otherwise(none))
    fitting = lines.select("id", F.explode(F.filter(passages, lambda w: fits(F.size(w) - 1))).alias("w"))
    # of a passage's bigrams so many must be some template's, as common ones are at least threshold * (a + b) / 2 and b at least low * a
    met = fitting.select("id", "w", (F.size("w") - 1).alias("a"), met_of(F.col("w")).alias("met")).where(F.size("met") >= a * low - 1e-9)
    only = lambda words: F.array_sort(F.array_distinct(F.filter("w", lambda x: x.isin(*words))))
    met = met.select("id", F.array_join("w", " ").alias("passage"), "a", "met", F.array_join(only(VARIANTS), " ").alias("has"), F.array_join(only(DIGITS), " ").alias("numbers"))
    keys = ["id", "passage", "a", "has", "numbers"]
    mine = met.distinct().select(*keys, F.explode("met").alias("gram")).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("mine"))
    told = (F.col("has") == F.col("variants")) & (F.size(F.array_except(F.array_remove(F.split("digits", " "), ""), F.split("numbers", " "))) == 0)
    pairs = mine.join(table, "gram").where((a >= F.col("b") * low - 1e-9) & (a <= F.col("b") * high + 1e-9) & told)
    dice = pairs.groupBy("id", "passage", "a", "template", "licence", "b").agg(F.sum(F.least("mine", "times")).alias("common")).withColumn("dice", 2 * F.col("common") / (a + F.col("b")))
    # the best of a passage: at most as many rows as there are templates
    each = dice.where(F.col("dice") >= threshold - 1e-9).groupBy("id", "passage", "licence").agg(F.max("dice").alias("dice"))
    best = each.groupBy("id", "passage").agg(F.max("dice").alias("dice"), F.collect_list(F.struct("licence", "dice")).alias("all"))
    best = best.select("id", "passage", "dice", F.explode(F.filter("all", lambda x: x["dice"] >= F.col("dice") - 1e-9)["licence"]).alias("licence"))
    return best.groupBy("id", "licence").agg(F.max("dice").alias("dice"), F.count_distinct("passage").alias("passages"))
