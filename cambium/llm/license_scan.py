"""Licence notices and texts by Dice coefficient over word bigrams, in DataFrame functions only."""

from __future__ import annotations

import json
import math
import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: notices and texts of common licences, as they are written in files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
        HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
        FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor
        the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
        permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
        EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and
        to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
        following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
        unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language
        processor.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
        and by any means.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
        as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
}
LEAST_DICE = 0.8


def _normal_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _all_bigrams(words: Column) -> Column:
    """The bigrams of an array of words, one after the other."""
    n = F.size(words)
    made = F.transform(F.array(words), lambda w: F.transform(F.slice(w, F.lit(2), F.size(w)), lambda b, i: F.concat(F.get(w, i), F.lit(" "), b)))
    return F.when(n >= 2, F.get(made, F.lit(0))).otherwise(F.array().cast("array<string>"))


#: Places of one template's windows in their numbers; more than a text can have words.
_ROOM = 1 << 40


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@dataclass(frozen=True)
class Pack:
    """Templates made ready: each one's words and bigrams, and the anchors and anchor words that its matches need.

    A text within `least` of a template has least / (2 - least) of its bigrams, so of any choice that
    is larger than what may be missing it has one. Of each template so many bigrams are chosen as
    anchors, those that few long words cover; a text without any of these words, and of the anchors without one, matches nothing.
    """

    bigrams: dict[str, list[str]]
    sizes: dict[str, int]
    anchors: dict[str, list[tuple[str, int]]]  # (bigram, its first place in the template)
    words: list[str]
    weak: list[str]  # anchors without a word of five letters

    @classmethod
    def of(cls, templates: dict[str, str], least: float) -> Pack:
        bigrams, sizes, anchors, chosen, weak = {}, {}, {}, set(), set()
        for name, text in sorted(templates.items()):
            words = template_words(text)
            every = pairs_of(words)
            grams = list(dict.fromkeys(every))
            bigrams[name], sizes[name] = grams, len(words)
            needed = len(grams) - math.ceil(round(least * len(grams) / (2 - least), 9)) + 1
            covered: list[str] = []
            while len(covered) < needed and grams:
                left = [g for g in grams if g not in covered]
                gain = lambda w: sum(w in g.split(" ") for g in left)  # noqa: B023, E731
                best = max({w for g in left for w in g.split(" ")}, key=lambda w: (min(len(w), 6), w in chosen, gain(w), len(w), w))  # noqa: B023
                own = [g for g in left if best in g.split(" ")]
                covered += own
                if len(best) >= 5:
                    chosen.add(best)
                else:
                    weak.update(own)
            anchors[name] = [(g, every.index(g)) for g in covered]
        return cls(bigrams, sizes, anchors, sorted(chosen), sorted(weak))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """doc_id, n_matches, n_windows, licenses, best_dice for every row of docs.

    Every line of a text, and a text of several lines as a whole, is a segment. A segment's set
    of word bigrams is compared with those templates whose set's size allows a Dice coefficient
    of `least` at all: between least / (2 - least) and (2 - least) / least times its own. Besides, wherever
    one of a template's anchors (see Pack) stands in a text, the window of the template's own number of
    words, aligned at the anchor and cut at the text's ends, is compared with the template, across lines
    and inside of them; so wrapped notices, notices inside a sentence and texts within longer files are found.

    n_matches: (segment, template) pairs of `least` or more; n_windows: such (window, template) pairs; licenses:
    the ids of both, sorted and comma-joined; best_dice: the highest coefficient among them, 0 without one.

    A text without any anchor is passed over, which loses nothing. Works row by row, without join or
    shuffle; the templates are a literal. Null, empty and one-word segments have no bigrams and match nothing. Very
    long texts are read whole: the time grows with the words and with the anchors found. Repeated rows and
    doc_ids stay; other columns are ignored, whatever their names. Empty input: no rows.
    """
    pack = Pack.of(templates, least)
    names = list(pack.bigrams)
    known = F.from_json(F.lit(json.dumps([{"id": k, "grams": pack.bigrams[k], "size": pack.sizes[k]} for k in names])), "array<struct<id:string,grams:array<string>,size:int>>")
    flat = [{"gram": g, "template": i, "at": at} for i, k in enumerate(names) for g, at in pack.anchors[k]]
    anchors = F.from_json(F.lit(json.dumps(flat)), "array<struct<gram:string,template:int,at:int>>")
    needed = F.from_json(F.lit(json.dumps(sorted({x["gram"] for x in flat}))), "array<string>")
    low, high = least / (2 - least) - 1e-9, (2 - least) / least + 1e-9  # they only prune; dice decides

    docs = docs.select("doc_id", "text", F.lower("text").alias("lower"))  # once, not for each word
    likely = reduce(operator.or_, (F.col("lower").contains(w) for w in pack.words), F.lit(False))
    if pack.weak:
        likely = likely | F.rlike("lower", F.lit("|".join(f"(?<![a-z0-9]){g.replace(' ', '[^a-z0-9]+')}(?![a-z0-9])" for g in pack.weak)))
    likely = F.coalesce(likely, F.lit(False))
    df = docs.select("doc_id", "text", F.when(likely, _all_bigrams(_normal_words(F.col("text")))).alias("every"))
    df = df.withColumn("found", F.coalesce(F.array_intersect("every", needed), F.array().cast("array<string>")))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    segments = F.when(F.size(lines) > 1, F.concat(lines, F.array("text"))).otherwise(lines)
    df = df.select(
        "doc_id", "every", "found", known.alias("known"), anchors.alias("anchors"),
        F.when(F.size("found") > 0, F.transform(segments, lambda s: F.array_distinct(_all_bigrams(_normal_words(s))))).alias("grams"),
    )
    both = lambda g, t: F.size(F.array_intersect(g, t["grams"])) * F.lit(2.0) / (F.size(g) + F.size(t["grams"]))
    match = lambda g, t: F.struct(both(g, t).alias("dice"), t["id"].alias("id"))
    enough = lambda m: m["dice"] >= least

    def near(g: Column) -> Column:
        in_bounds = F.filter("known", lambda t: (F.size(t["grams"]) >= F.size(g) * low) & (F.size(t["grams"]) <= F.size(g) * high) & (F.size(g) > 0))
        return F.filter(F.transform(in_bounds, lambda t: match(g, t)), enough)

    # a window by its template and its first word's place, as one number
    places = lambda g: F.filter(F.sequence(F.lit(0), F.size("every") - 1), lambda i: F.get("every", i) == g)
    of_anchor = lambda g, at: F.transform(F.filter("anchors", lambda a: a["gram"] == g), lambda a: F.transform(at, lambda i: a["template"].cast("long") * _ROOM + i - a["at"] + _ROOM // 2))
    of_gram = lambda g: F.flatten(F.get(F.transform(F.array(places(g)), lambda at: of_anchor(g, at)), F.lit(0)))
    windows = F.when(F.size("found") > 0, F.array_distinct(F.flatten(F.transform("found", of_gram))))

    def window(w: Column) -> Column:
        t, start = F.get("known", F.floor(w / _ROOM).cast("int")), (w % _ROOM - _ROOM // 2).cast("int")
        begin, stop = F.greatest(start, F.lit(0)), F.least(start + t["size"] - 1, F.size("every"))
        return F.struct(F.array_distinct(F.slice("every", begin + 1, stop - begin)).alias("g"), t.alias("t"))

    none = F.array().cast("array<struct<dice:double,id:string>>")
    df = df.select(
        "doc_id",
        F.coalesce(F.flatten(F.transform("grams", near)), none).alias("lines"),
        F.coalesce(F.filter(F.transform(F.transform(windows, window), lambda w: match(w["g"], w["t"])), enough), none).alias("windows"),
    )
    df = df.withColumn("found", F.concat("lines", "windows"))
    return df.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_matches"),
        F.size("windows").cast("long").alias("n_windows"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["id"]))), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda m: m["dice"])), F.lit(0.0)), 6).alias("best_dice"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _quoted(x) for x in row) + ")" for row in rows)


_PACK = Pack.of(TEMPLATES, LEAST_DICE)
ORACLE_SQL = f"""
WITH t AS (
  SELECT id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w
  FROM (VALUES {_values(list(TEMPLATES.items()))}) v(id, text)
), tg AS (
  SELECT id, len(w) AS size, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM t
), anchors AS (
  SELECT * FROM (VALUES {_values([(k, g, at) for k, found in _PACK.anchors.items() for g, at in found])}) v(id, gram, place)
), d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
seg AS (
  SELECT row_id, unnest(CASE WHEN contains(text, chr(10)) THEN list_append(string_split(text, chr(10)), text) ELSE [text] END) AS s FROM d
), sg AS (
  SELECT row_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT row_id, list_filter(regexp_split_to_array(lower(s), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM seg)
  WHERE len(w) >= 2
), m AS (
  SELECT row_id, id, 2.0 * len(list_intersect(sg.g, tg.g)) / (len(sg.g) + len(tg.g)) AS dice FROM sg, tg
  WHERE len(tg.g) BETWEEN len(sg.g) * 0.5 AND len(sg.g) * 2.0
), pairs AS (
  SELECT row_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p
  FROM (SELECT row_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM d) WHERE len(w) >= 2
), starts AS (
  SELECT DISTINCT row_id, id, i - place AS start
  FROM (SELECT row_id, unnest(p) AS gram, unnest(range(len(p))) AS i FROM pairs) JOIN anchors USING (gram)
), wm AS (
  SELECT row_id, id, 2.0 * len(list_intersect(x.g, tg.g)) / (len(x.g) + len(tg.g)) AS dice
  FROM (SELECT row_id, id, list_distinct(p[greatest(start, 0) + 1 : least(start + size - 1, len(p))]) AS g FROM starts JOIN pairs USING (row_id) JOIN tg USING (id)) x JOIN tg USING (id)
), every AS (
  SELECT *, 1 AS line FROM m WHERE dice >= {LEAST_DICE} UNION ALL SELECT *, 0 FROM wm WHERE dice >= {LEAST_DICE}
)
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (WHERE line = 1)::BIGINT AS n_matches, count(*) FILTER (WHERE line = 0)::BIGINT AS n_windows,
       coalesce(string_agg(DISTINCT e.id, ',' ORDER BY e.id), '') AS licenses, round(coalesce(max(e.dice), 0), 6)::DOUBLE AS best_dice
FROM d LEFT JOIN every e USING (row_id)
GROUP BY d.row_id
"""
