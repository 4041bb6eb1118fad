"""License scan by the Dice coefficient over word bigrams, in DataFrame functions only.

Units are a text's lines and its paragraphs (runs of lines between blank
ones).  A unit and a template are lower-cased, everything but letters and
digits becomes a space, and their sets of word bigrams are compared:
``2 |A and B| / (|A| + |B|)``.  A template is a candidate for a unit only if
both sizes allow the coefficient to reach the threshold, so most units are
compared with no template at all.  The same bound says how many bigrams of a
template may be absent, hence a few words of which every match has one at
least (``telling_words``); texts without any of them are not split into units.

Notices that are neither are found as windows: runs of words over any lines and
paragraphs, up to the whole text, from one bigram of the template to another.
Only windows beside the matching lines and paragraphs are reported, the best of
those that overlap, with the line of their first word.  Only templates of which
a text has enough bigrams at all are tried.

Null and empty texts, and units of fewer than two words, match nothing.  A row
comes out for each document, unit and best template (ties: template name);
repeated documents give repeated rows, and null ids are kept.  A paragraph of
one line is only reported as that line.  ``sql`` has the lines and paragraphs
without the windows.  Columns besides ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.rules import let

LEAST_DICE = 0.9

#: Notices and short texts of public licences.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")


def adjacent(w: Column) -> Column:
    """Word bigrams by their place."""
    return F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))))


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of the normalised text."""
    return let(words(text), lambda w: F.array_distinct(adjacent(w)))


def template_rows(df: DataFrame, templates: dict[str, str]) -> list:
    spark = df.sparkSession
    rows = spark.createDataFrame(sorted(templates.items()), "name string, body string")
    return rows.select("name", bigrams(F.col("body")).alias("b"), F.size(words(F.col("body"))).alias("n")).filter(F.size("b") > 0).orderBy("name").collect()


def telling_words(known: list[list[str]], least: float) -> list[str]:
    """Words such that every unit that reaches ``least`` for some template has one of them.

    A match shares ``least / (2 - least)`` of a template's bigrams at least, so
    it cannot miss a larger set of them; words are taken, long and useful ones first,
    until those that occur in so many bigrams of each template are covered.
    """
    spare = [int(len(b) * (1 - least / (2 - least)) + 1e-9) for b in known]
    chosen: list[str] = []
    while True:
        open_ = [[x for x in b if not set(x.split(" ")) & set(chosen)] for b in known]
        short = [k for k, b in enumerate(known) if len(b) - len(open_[k]) <= spare[k]]
        if not short:
            return chosen
        gain: dict[str, float] = {}
        for k in short:
            need = spare[k] + 1 - (len(known[k]) - len(open_[k]))
            count: dict[str, int] = {}
            for x in open_[k]:
                for w in set(x.split(" ")):
                    count[w] = count.get(w, 0) + 1
            for w, n in count.items():
                gain[w] = gain.get(w, 0.0) + min(n, need) / need * 10.0 ** min(len(w), 7)
        chosen.append(min(gain, key=lambda w: (-gain[w], w)))


SPANS = "array<struct<first:int,last:int,dice:double,license:string>>"


def windows(pairs: Column, taken: Column, known: list, least: float) -> Column:
    """``first, last, dice, license`` of the windows that reach ``least`` and meet none of the word ranges ``taken``."""
    low, high = least / (2 - least), (2 - least) / least
    rows = [(k, r.name, list(r.b), len(r.b), math.ceil(low * len(r.b) - 1e-9), int(high * (r.n - 1) + 1e-9)) for k, r in enumerate(known)]
    parts = ("order", "name", "b", "size", "need", "most")
    templates = F.array(*(F.struct(*((F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(n) for n, v in zip(parts, row))) for row in rows))
    every = F.array(*map(F.lit, sorted({x for r in known for x in r.b})))

    def of(t: Column, own: Column) -> Column:
        def from_hits(hits: Column) -> Column:
            def from_start(a: Column) -> Column:
                first = F.get(hits, a)
                ends = F.sequence(a + t["need"] - 1, F.least(F.size(hits), a + t["most"]) - 1)
                near = F.filter(F.transform(ends, lambda b: F.get(hits, b)), lambda j: j - first < t["most"])

                def scored(j: Column) -> Column:
                    dice = let(F.array_distinct(F.slice(pairs, first + 1, j - first + 1)), lambda x: 2.0 * F.size(F.array_intersect(x, own)) / (F.size(x) + t["size"]))
                    return F.struct((-dice).alias("minus"), t["order"].alias("order"), first.alias("first"), (j + 1).alias("last"), t["name"].alias("license"))

                return F.filter(F.transform(near, scored), lambda x: -x["minus"] >= least)

            return F.when(F.size(hits) >= t["need"], F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits) - t["need"]), from_start)))

        places = F.filter(F.transform(pairs, lambda x, i: F.when(F.array_contains(own, x), i)), lambda i: i.isNotNull())
        return F.when(F.size(own) >= t["need"], let(places, from_hits))

    def add(chosen: Column, x: Column) -> Column:
        row = F.struct(x["first"].alias("first"), x["last"].alias("last"), (-x["minus"]).alias("dice"), x["license"].alias("license"))
        meets = F.exists(chosen, lambda c: (c["first"] <= x["last"]) & (x["first"] <= c["last"]))
        return F.when(meets, chosen).otherwise(F.concat(chosen, F.array(row))).cast(SPANS)

    def all_of(present: Column) -> Column:
        found = F.transform(templates, lambda t: let(F.array_intersect(present, t["b"]), lambda own: of(t, own)))
        return F.array_sort(F.flatten(F.filter(found, lambda x: x.isNotNull())))

    return F.filter(F.aggregate(let(F.array_intersect(pairs, every), all_of), taken.cast(SPANS), add), lambda c: c["dice"].isNotNull())


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """``doc_id, unit, line, license, dice`` of every unit that reaches ``least``."""
    known = template_rows(docs, templates)
    low, high = least / (2 - least), (2 - least) / least

    def best(b: Column) -> Column:
        found = []
        for k, r in enumerate(known):
            s = len(r.b)
            both = F.size(F.array_intersect(b, F.array(*map(F.lit, r.b))))
            dice = F.when(F.size(b).between(low * s, high * s), 2.0 * both / (F.size(b) + s)).otherwise(F.lit(0.0))
            found.append(F.struct(dice.alias("dice"), F.lit(-k).alias("order"), F.lit(r.name).alias("license")))
        return F.array_max(F.array(*found))

    unit = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("unit"), (i + 1).alias("line"), x.alias("body"))
    by_line, by_paragraph = F.split("text", "\n"), F.split("text", "\n[ \\t\\r]*\n")
    lines = F.transform(by_line, unit("line"))
    paragraphs = F.filter(F.transform(by_paragraph, unit("paragraph")), lambda u: F.instr(F.trim(u["body"]), "\n") > 0)
    row = lambda kind, line, name, dice: F.struct(kind.alias("unit"), line.alias("line"), name.alias("license"), dice.alias("dice"))
    scored = F.transform(F.concat(lines, paragraphs), lambda u: let(let(bigrams(u["body"]), best), lambda x: row(u["unit"], u["line"], x["license"], x["dice"])))
    matched = F.filter(scored, lambda u: u["dice"] >= least)
    sizes = lambda bodies: F.transform(bodies, lambda x: F.size(words(x)))
    total = lambda counts, n: F.aggregate(F.slice(counts, F.lit(1), n), F.lit(0), lambda a, x: a + x)

    def beside(units: Column, in_lines: Column, in_paragraphs: Column) -> Column:
        def taken(u: Column) -> Column:
            count = F.when(u["unit"] == "line", in_lines).otherwise(in_paragraphs)
            return F.struct(total(count, u["line"] - 1).alias("first"), (total(count, u["line"]) - 1).alias("last"), F.lit(None).cast("double").alias("dice"), F.lit(None).cast("string").alias("license"))

        def line(first: Column) -> Column:
            upto = F.aggregate(in_lines, F.struct(F.lit(0).alias("sum"), F.lit(1).alias("line")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.when(a["sum"] + x <= first, a["line"] + 1).otherwise(a["line"]).alias("line")))
            return upto["line"]

        found = let(let(words(F.col("text")), adjacent), lambda pairs: windows(pairs, F.transform(units, taken), known, least))
        return F.concat(units, F.transform(found, lambda x: row(F.lit("window"), line(x["first"]), x["license"], x["dice"])))

    whole = let(matched, lambda u: let(sizes(by_line), lambda a: let(sizes(by_paragraph), lambda b: beside(u, a, b))))
    # an inner explode would compute the whole array once more to filter empty ones
    lower = F.lower("text")
    told = F.lit(False)
    for w in telling_words([r.b for r in known], least):
        told = told | F.contains(lower, F.lit(w))
    rows = docs.filter(told).select("doc_id", F.explode_outer(whole).alias("u")).filter(F.col("u").isNotNull())
    return rows.select("doc_id", "u.unit", "u.line", "u.license", F.round("u.dice", 6).alias("dice"))


def sql(templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE) -> str:
    """The same scan for DuckDB."""
    quoted = ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in sorted(templates.items()))
    words = "list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH templates(name, body) AS (VALUES {quoted}),
t AS (SELECT name, {pairs} AS b FROM (SELECT name, {words.format('body')} AS w FROM templates)),
paragraphs AS (SELECT doc_id, generate_subscripts(p, 1) AS line, unnest(p) AS body
  FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n') AS p FROM documents)),
units AS (
  SELECT doc_id, 'line' AS unit, generate_subscripts(l, 1) AS line, unnest(l) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
  UNION ALL SELECT doc_id, 'paragraph', line, body FROM paragraphs WHERE contains(trim(body, ' '), chr(10))),
u AS (SELECT doc_id, unit, line, {pairs} AS b FROM (SELECT *, {words.format('body')} AS w FROM units)),
scored AS (SELECT doc_id, unit, line, name, 2.0 * len(list_intersect(u.b, t.b)) / (len(u.b) + len(t.b)) AS dice
  FROM u JOIN t ON len(u.b) BETWEEN len(t.b) * {least / (2 - least)!r} AND len(t.b) * {(2 - least) / least!r})
SELECT doc_id, unit, line::INT AS line, name AS license, round(dice, 6) AS dice FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit, line ORDER BY dice DESC, name) AS k FROM scored WHERE dice >= {least}) WHERE k = 1
"""
