"""Licence scan (operator 3): DataFrame functions only.

Segments of a text (each line, each paragraph of several lines, the whole text if it has several
paragraphs) are normalised to lower-case letters and digits and compared with licence templates by the
Dice coefficient of their word bigrams: 2 * (distinct bigrams in common) / (bigrams of both, repeats
counted). A coefficient of t needs sizes within a factor of t / (2 - t), so a segment meets only templates
of about its own size, and most segments are dropped by their word count before bigrams are built.

A notice may also stand inside a line or be spread over paragraphs, whatever its breaks. So the text is read as one sequence of words
too: a window has a template's number of bigrams (fewer at the text's end) and starts at any bigram of the template, and of each
template the best window of a text is reported (the earlier of equals) if it reaches the threshold. Windows are of the template's size,
so one that matches has `threshold` times that many of its bigrams. Hence two exact cuts come first: a text
needs enough of the words that begin the template's bigrams, then enough of the bigrams themselves.

Each document is scanned in its own row, against templates that are constants: no shuffle, no state.

Defined results: null, empty and one-word segments match nothing; every template that reaches the
threshold is reported, so ties give a row each; repeated rows are reported each; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import documents

THRESHOLD = 0.8

#: Licence notices and texts: fixed values.
TEMPLATES = {
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-line": "Licensed under the BSD License.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def _bigrams(text: str) -> list[str]:
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def _constant(values: list[str]) -> Column:
    """An array of strings as one constant."""
    return F.split(F.lit("\n".join(values)), "\n")


def _once(value: Column) -> Column:
    """value, computed once a row: behind a generator the optimiser does not copy it into the places (and loops) that use it."""
    return F.explode(F.array(value))


def _in_order(w: Column) -> Column:
    """The bigrams of an array of two words or more."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))


def windows(plain: DataFrame, grams: dict[str, list[str]], threshold: float) -> DataFrame:
    """plain (doc_id, plain) -> doc_id, segment (window), position (its first word), template, dice: the best window of each template."""
    rows = []
    for name, g in grams.items():
        distinct = list(dict.fromkeys(g))
        firsts = list(dict.fromkeys(x.split(" ")[0] for x in distinct))
        # a word that is missing takes at least one bigram with it
        rows.append((name, len(g), distinct, firsts, len(firsts) - (len(distinct) - threshold * len(g))))
    vocabulary = _constant(sorted({w for r in rows for w in r[3]}))
    constants = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(n).alias("n"), _constant(g).alias("grams"), _constant(firsts).alias("firsts"), F.lit(float(least)).alias("least")) for name, n, g, firsts, least in rows])
    least = F.lit(threshold)
    worded = plain.select("doc_id", "plain", _once(F.array_intersect(F.split("plain", "[ \n]+"), vocabulary)).alias("common"))
    possible = worded.select("doc_id", "plain", _once(F.filter(constants, lambda t: F.size(F.array_intersect(F.col("common"), t["firsts"])) >= t["least"] - 1e-9)).alias("templates")).where(F.size("templates") > 0)
    read = possible.select("doc_id", "templates", _once(F.filter(F.split("plain", "[ \n]+"), lambda w: w != "")).alias("w")).where(F.size("w") > 1)
    paired = read.select("doc_id", "templates", _once(_in_order(F.col("w"))).alias("grams"))
    held = paired.select("doc_id", "grams", F.explode("templates").alias("t")).select("doc_id", "grams", "t", _once(F.array_intersect("grams", F.col("t.grams"))).alias("held")).where(F.size("held") >= least * F.col("t.n") - 1e-9)
    starts = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains("held", g), i)), lambda i: i.isNotNull())

    def window(i: Column) -> Column:
        part = F.slice("grams", i + 1, F.col("t.n"))
        return F.struct(F.round(2.0 * F.size(F.array_intersect(part, F.col("held"))) / (F.size(part) + F.col("t.n")), 6).alias("dice"), (-i).alias("back"))

    best = held.select("doc_id", F.col("t.name").alias("template"), _once(F.array_max(F.transform(starts, window))).alias("best")).where(F.col("best.dice") >= least)
    return best.select("doc_id", F.lit("window").alias("segment"), (-F.col("best.back")).alias("position"), "template", F.col("best.dice").alias("dice"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, segment (line, paragraph, document, window), position, template, dice."""
    grams = {name: _bigrams(text) for name, text in sorted(templates.items())}
    factor = threshold / (2 - threshold)
    least, most = min(map(len, grams.values())) * factor, max(map(len, grams.values())) / factor
    constants = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(len(g)).alias("n"), _constant(list(dict.fromkeys(g))).alias("grams")) for n, g in grams.items()])

    plain = F.lower(F.regexp_replace("text", r"[^\p{L}\p{Nd}\n]+", " "))
    blank_line = r"\n *\n[ \n]*"

    def cut(kind: str, parts: Column, when: Column) -> Column:
        return F.transform(F.when(when, parts).otherwise(F.array().cast("array<string>")), lambda s, i: F.struct(F.lit(kind).alias("segment"), i.alias("position"), s.alias("s")))

    split = docs.select("doc_id", plain.alias("plain")).where("plain IS NOT NULL").select("*", F.split("plain", blank_line).alias("paragraphs"))
    paragraphs = F.transform("paragraphs", lambda p: F.when(F.contains(p, F.lit("\n")), p).otherwise(F.lit("")))
    segments = F.concat(
        cut("line", F.split("plain", "\n"), F.lit(True)), cut("paragraph", paragraphs, F.contains("plain", F.lit("\n"))), cut("document", F.array("plain"), F.size("paragraphs") > 1)
    )
    rows = split.select("doc_id", F.explode(segments).alias("x")).select("doc_id", "x.segment", "x.position", F.filter(F.split("x.s", "[ \n]+"), lambda w: w != "").alias("w"))
    sized = rows.where((F.size("w") - 1).between(least, most))
    paired = sized.select("*", _in_order(F.col("w")).alias("grams"))
    n = F.size("grams")
    scored = F.transform(
        F.filter(constants, lambda t: n.between(t["n"] * factor, t["n"] / factor)),
        lambda t: F.struct(t["name"].alias("template"), (2.0 * F.size(F.array_intersect(F.col("grams"), t["grams"])) / (n + t["n"])).alias("dice")),
    )
    found = paired.select("doc_id", "segment", "position", F.explode(F.filter(scored, lambda t: t["dice"] >= threshold)).alias("t"))
    whole = found.select("doc_id", "segment", "position", "t.template", F.round("t.dice", 6).alias("dice"))
    return whole.union(windows(split.select("doc_id", "plain"), grams, threshold))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in sorted(TEMPLATES.items()))
    return rf"""
WITH given(template, text) AS (VALUES {values}),
templates AS (
  SELECT template, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS grams
  FROM (SELECT template, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')), ' +'), lambda x: x <> '') AS w FROM given)),
plain AS (SELECT doc_id, lower(regexp_replace(text, '[^\p{{L}}\p{{Nd}}\n]+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL),
paragraphs AS (SELECT *, regexp_split_to_array(plain, '\n *\n[ \n]*') AS ps FROM plain),
segments AS (
  SELECT doc_id, 'line' AS segment, unnest(string_split(plain, chr(10))) AS s, unnest(range(0, len(string_split(plain, chr(10))))) AS position FROM paragraphs
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(ps) AS s, unnest(range(0, len(ps))) AS position FROM paragraphs) WHERE contains(s, chr(10))
  UNION ALL SELECT doc_id, 'document', plain, 0 FROM paragraphs WHERE len(ps) > 1),
worded AS (SELECT doc_id, segment, position, list_filter(regexp_split_to_array(s, '[ \n]+'), lambda x: x <> '') AS w FROM segments),
sized AS (SELECT * FROM worded WHERE len(w) BETWEEN 2 AND 1000),
paired AS (SELECT doc_id, segment, position, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS grams FROM sized),
scored AS (
  SELECT doc_id, segment, position, template, 2.0::DOUBLE * len(list_distinct(list_intersect(p.grams, t.grams))) / (len(p.grams) + len(t.grams)) AS dice
  FROM paired p JOIN templates t ON len(p.grams) BETWEEN 0.66 * len(t.grams) AND 1.51 * len(t.grams)),
read AS (SELECT *, row_number() OVER () AS nr FROM (SELECT doc_id, list_filter(regexp_split_to_array(plain, '[ \n]+'), lambda x: x <> '') AS w FROM plain)),
sequences AS (SELECT nr, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS grams FROM read),
places AS (SELECT nr, unnest(grams) AS gram, unnest(range(0, len(grams))) AS position FROM sequences),
starts AS (SELECT DISTINCT nr, position, template FROM places JOIN (SELECT template, unnest(grams) AS gram FROM templates) USING (gram)),
rated AS (
  SELECT nr, s.doc_id, p.position, template,
    round(2.0::DOUBLE * len(list_distinct(list_intersect(s.grams[p.position + 1 : p.position + len(t.grams)], t.grams))) / (len(s.grams[p.position + 1 : p.position + len(t.grams)]) + len(t.grams)), 6) AS dice
  FROM starts p JOIN templates t USING (template) JOIN sequences s USING (nr)),
windows AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY nr, template ORDER BY dice DESC, position) = 1)
SELECT doc_id, segment, CAST(position AS INT) AS position, template, round(dice, 6) AS dice FROM scored WHERE dice >= {THRESHOLD}
UNION ALL SELECT doc_id, 'window', CAST(position AS INT), template, dice FROM windows WHERE dice >= {THRESHOLD}
"""


OP3_SQL = _sql()
