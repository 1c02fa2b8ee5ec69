"""Licence texts and notices in documents, by the Dice coefficient over word bigrams.

Texts are normalised to lower-case words without punctuation. A unit of a document (the whole text, or one of its lines) has
the set of its word bigrams; it matches a template if 2 * shared / (both sizes) reaches ``at_least``. Since the shared part
can't exceed the smaller set, only units with sizes between t / (2 - t) and (2 - t) / t of the template's can match; others
are not compared.

Notices that are no unit, such as one wrapped over some lines or within a sentence, are found as passages: runs of words, of
any length and across lines, whose bigrams pass the same test. The best run begins and ends in a bigram of the template, so
all runs from each of these are tried, in texts that hold t / (2 - t) of a template's bigrams.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.store import table
from assay.llm.text import LOWER, UPPER, lower_ascii

# Notices and licence texts in public use, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS"
        " OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
        " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR"
        " OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION"
        " WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        " an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for"
        " the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
        " General Public License for more details.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
AT_LEAST = 0.8
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), "")


def in_pairs(w: Column) -> Column:
    """Each word but the last with the next one."""
    after = F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
    return F.transform(after, lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))


def bigrams(w: Column) -> Column:
    """The set of a text's word bigrams; of one word, that word."""
    return F.when(F.size(w) == 1, w).otherwise(F.array_distinct(in_pairs(w)))


def template_sets(templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[tuple[str, str, list[str]]]:
    """Name, licence and bigram set of the templates that have words."""
    out = []
    for at, (licence, text) in enumerate(templates):
        w = [x for x in re.split(BREAKS, text.lower()) if x]
        pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] if len(w) > 1 else w
        if pairs:
            out.append((f"{licence} {at}", licence, list(dict.fromkeys(pairs))))
    return out


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, at_least: float = AT_LEAST
) -> DataFrame:
    """The matches in ``docs`` (doc_id, text): ``doc_id``, ``line``, ``licence``, ``template`` and ``dice``.

    A row for each unit and template that match, and for each passage beyond them (see ``passages``). ``line`` counts from 1,
    as line feeds split the text; 0 is the whole text, which stands alone if it is one line; that of a passage is the line it
    begins in. Null and wordless units match nothing; repeated rows match each for itself. Templates are a bounded list and
    become a constant of the plan.
    """
    return _units(docs, templates, at_least).unionByName(passages(docs, templates, at_least))


def _known(templates: Sequence[tuple[str, str]]) -> Column:
    known = [{"template": t, "licence": n, "size": len(g), "grams": g} for t, n, g in template_sets(templates)]
    return F.from_json(
        F.lit(json.dumps(known)), "array<struct<template:string,licence:string,size:int,grams:array<string>>>"
    )


def _units(docs: DataFrame, templates: Sequence[tuple[str, str]], at_least: float) -> DataFrame:
    """Whole texts and lines that match."""
    low, high = at_least / (2 - at_least), (2 - at_least) / at_least
    known = _known(templates)
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    unit = lambda at, value: F.struct(at.alias("line"), value.alias("unit"))
    single = F.transform(F.when(F.size(lines) > 1, lines).otherwise(F.array().cast("array<string>")), lambda x, i: unit(i + 1, x))
    units = docs.select("doc_id", F.explode(F.concat(F.array(unit(F.lit(0), text)), single)).alias("u"))
    units = units.select("doc_id", F.col("u.line").alias("line"), normalised(F.col("u.unit")).alias("w"))
    # No filter stands between these: it would move below the projections and make the arrays anew for every element.
    units = units.withColumn("grams", bigrams(F.col("w")))
    n = F.size("grams")
    fitting = F.filter(known, lambda t: (n > 0) & (n >= low * t["size"]) & (n <= high * t["size"]))
    dice = lambda t: 2.0 * F.size(F.array_intersect(F.col("grams"), t["grams"])) / (n + t["size"])
    rated = F.transform(
        fitting, lambda t: F.struct(t["licence"].alias("licence"), t["template"].alias("template"), dice(t).alias("dice"))
    )
    matched = F.filter(rated, lambda t: t["dice"] >= at_least)
    return units.select("doc_id", "line", F.inline(matched))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _stretches(of: Column, shift: int) -> Column:
    """The numbers of the stretches of 2^``shift`` elements that an array has."""
    return F.filter(F.sequence(F.lit(0), F.shiftright(F.size(of), shift)), lambda j: F.shiftleft(j, shift) < F.size(of))


def _without(
    runs: Column, order: Callable[[Column], Column], clash: Callable[[Column, Column], Column], key: Sequence[str], kind: str
) -> Column:
    """Runs by the stretch they begin in, each unless it clashes with one kept before it in this order.

    Only runs that touch the same place clash, so a run meets those of its own and the nearest stretches. What clashes with
    none before it stays, and what clashes with that goes, all at once; the few others are taken one by one.
    """
    of = lambda at: F.shiftright(at, STRETCH)
    same = lambda x, y: F.struct(*[x[c] for c in key]) == F.struct(*[y[c] for c in key])
    each = lambda by, test: F.transform(by, lambda s: F.filter(s, test))

    def around(by: Column, x: Column, reach: Column) -> Column:
        begin = F.greatest(of(x["first"]) - reach, F.lit(0))
        return F.flatten(F.slice(by, begin + 1, of(x["last"]) - begin + 1))

    def one_by_one(rows: Column) -> Column:
        ordered = F.transform(F.sort_array(F.transform(rows, lambda x: F.struct(order(x).alias("o"), x.alias("x")))), lambda x: x["x"])
        add = lambda kept, x: F.when(F.exists(kept, lambda y: clash(x, y)), kept).otherwise(F.array_append(kept, x))
        return F.aggregate(ordered, F.array().cast(f"array<{kind}>"), add)

    def chosen(by: Column, reach: Column) -> Column:
        beaten = lambda x: F.exists(around(by, x, reach), lambda y: (order(y) < order(x)) & clash(x, y))
        return _let(each(by, lambda x: ~beaten(x)), lambda sure: with_rest(by, sure, reach))

    def with_rest(by: Column, sure: Column, reach: Column) -> Column:
        open_ = lambda x: ~F.exists(around(sure, x, reach), lambda y: same(x, y) | clash(x, y))
        rest = one_by_one(F.flatten(each(by, open_)))
        join = lambda rest: F.transform(sure, lambda s, j: F.concat(s, F.filter(rest, lambda x: of(x["first"]) == j)))
        return _let(rest, join)

    span = F.transform(F.flatten(runs), lambda x: of(x["last"]) - of(x["first"]))
    return _let(F.struct(runs.alias("by"), F.coalesce(F.array_max(span), F.lit(0)).alias("reach")), lambda r: chosen(r["by"], r["reach"]))


RUN = "struct<dice:double,shared:int,first:int,last:int>"
PASSAGE = "struct<dice:double,shared:int,first:int,template:string,licence:string,last:int,hits:array<int>,nth:int>"
#: A stretch of a text has 2^STRETCH words, a wide one 2^WIDE. Results do not depend on them.
STRETCH, WIDE = 5, 9


def passages(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, at_least: float = AT_LEAST
) -> DataFrame:
    """Runs of words that match a template, in the form of ``scan``, but for those in a whole text or line that matches it.

    Of runs of one template that overlap, the most similar counts. Of templates that share bigrams of the text, the one with
    the most of them counts, as the others are its relatives (LGPL in GPL), and all of them where they are equal.

    A run grows with the bigrams that are new in it, whatever repeats between them. Where those behind a stretch come first is
    found once for all starts in it, from lists of wide stretches, so a text that repeats a notice is not read to its end
    from each start.
    """
    low, high = at_least / (2 - at_least), (2 - at_least) / at_least
    sets = template_sets(templates)
    every = list(dict.fromkeys(g for _, _, grams in sets for g in grams))
    single = any(" " not in g for g in every)
    known = _known(templates)

    # Arrays used in a lambda stand in a column that is named twice, so that it isn't made anew for every element.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", normalised(F.col("text")))
    grams = F.when(F.size("w") == 1, F.col("w")).otherwise(in_pairs(F.col("w")))
    grams = F.concat(grams, F.col("w")) if single else grams
    found = found.select("doc_id", "text", grams.alias("grams"))
    every = F.from_json(F.lit(json.dumps(every)), "array<string>")
    found = found.select("doc_id", "text", F.array_intersect("grams", every).alias("seen"))
    held = lambda t, here: F.size(F.array_intersect(here, t["grams"])) >= low * t["size"] - 1e-9
    near = F.filter(known, lambda t: (F.size("seen") > 0) & held(t, F.col("seen")))
    found = found.select("doc_id", F.inline(F.filter(F.array(F.struct("text", near.alias("near"))), lambda x: F.size(x["near"]) > 0)))

    by_line = F.transform(F.split("text", "\n"), normalised)
    found = found.select("doc_id", "near", F.inline(F.array(F.struct(by_line.alias("lines")))))
    numbers = F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i + 1, F.size(x))))
    in_lines = F.transform("lines", bigrams)
    found = found.select(
        "doc_id", "near",
        F.inline(F.array(F.struct(F.flatten("lines").alias("w"), numbers.alias("number"), in_lines.alias("in_lines")))),
    )
    found = found.select("*", F.inline(F.array(F.struct(bigrams(F.col("w")).alias("in_text")))))

    def matches(g: Column, t: Column) -> Column:
        n, size = F.size(g), F.size(t["grams"])
        fits = (n > 0) & (n >= low * size - 1e-9) & (n <= high * size + 1e-9)
        return fits & (2.0 * F.size(F.array_intersect(g, t["grams"])) / (n + size) >= at_least)

    judged = lambda t: F.struct(
        *[t[c].alias(c) for c in ("template", "licence", "size", "grams")],
        matches(F.col("in_text"), t).alias("whole"), F.transform("in_lines", lambda g: matches(g, t)).alias("lines"),
    )
    found = found.select("doc_id", "w", "number", F.inline(F.array(F.struct(F.transform("near", judged).alias("near")))))
    found = found.select("*", F.inline(F.array(F.struct(in_pairs(F.col("w")).alias("pairs")))))

    def before(of: Column) -> Column:
        """For each element the place of the equal one before it, or -1."""
        placed = F.sort_array(F.transform(of, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        earlier = lambda s, x, k: F.when((k > 0) & (F.get(s, k - 1)["x"] == x["x"]), F.get(s, k - 1)["i"]).otherwise(-1)
        linked = _let(placed, lambda s: F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), earlier(s, x, k).alias("p"))))
        return F.transform(F.sort_array(linked), lambda x: x["p"])

    more = [before(F.col("pairs")).alias("pairs_before")] + ([before(F.col("w")).alias("w_before")] if single else [])
    found = found.select("*", F.inline(F.array(F.struct(*more))))

    def runs(t: Column, nth: Column, e: Column, previous: Column) -> Column:
        hit = F.transform(e, lambda x: F.array_contains(t["grams"], x))
        return _let(hit, lambda hit: of_hits(t, nth, e, previous, hit))

    def of_hits(t: Column, nth: Column, e: Column, previous: Column, hit: Column) -> Column:
        # Runs with more bigrams of their own than this cannot match.
        most = F.floor(high * t["size"] + 1e-9).cast("int")
        is_hit = lambda x: F.get(hit, x)
        begin = lambda j: F.shiftleft(j, STRETCH)
        none = F.array().cast("array<int>")
        fresh = lambda a: lambda x: F.get(previous, x) < a
        first = lambda x: F.slice(x, F.lit(1), most)
        wide = lambda s: F.shiftleft(s, WIDE)
        upto = lambda a, end: F.when(a < F.least(end, F.size(e)), F.sequence(a, F.least(end, F.size(e)) - 1)).otherwise(none)

        # Where bigrams come first, seen from the beginning of a wide stretch: those in it, and all from it on. Nothing is
        # before the first one, so it needs none.
        in_wide = lambda s: first(F.filter(upto(wide(s), wide(s + 1)), fresh(wide(s))))
        own_firsts = F.transform(_stretches(e, WIDE), lambda s: F.when(s > 0, in_wide(s)).otherwise(none))

        def all_firsts(own: Column) -> Column:
            on = lambda s: first(F.filter(F.flatten(F.slice(own, s + 1, F.size(own))), fresh(wide(s))))
            return F.transform(own, lambda x, s: F.when((s == 0) | (F.size(x) >= most), x).otherwise(on(s)))

        def behind(j: Column, firsts: Column) -> Column:
            """The same from the stretch after ``j`` on."""
            a, s = begin(j + 1), F.shiftright(j, WIDE - STRETCH) + 1
            return first(F.concat(F.filter(upto(a, wide(s)), fresh(a)), F.filter(F.coalesce(F.get(firsts, s), none), fresh(a))))

        def step(s: Column, x: Column, a: Column) -> Column:
            own, shared = s["own"] + 1, s["shared"] + is_hit(x).cast("int")
            now = 2.0 * shared / (own + t["size"])
            better = now > s["best"]["dice"]
            run = F.struct(now.alias("dice"), shared.alias("shared"), a.alias("first"), x.alias("last"))
            return F.struct(own.alias("own"), shared.alias("shared"), F.when(better, run).otherwise(s["best"]).alias("best"))

        def best(a: Column, new: Column) -> Column:
            zero = F.lit(0)
            nothing = F.struct(F.lit(0.0).alias("dice"), zero.alias("shared"), a.alias("first"), a.alias("last"))
            start = F.struct(zero.alias("own"), zero.alias("shared"), nothing.alias("best"))
            return F.aggregate(new, start, lambda s, x: step(s, x, a), lambda s: s["best"])

        enough = lambda new: F.size(F.filter(new, is_hit)) >= low * t["size"] - 1e-9

        def in_stretch(j: Column, firsts: Column) -> Column:
            here, nothing = upto(begin(j), begin(j + 1)), F.array().cast(f"array<{RUN}>")

            def tried(later: Column) -> Column:
                new = lambda a: first(F.concat(F.filter(upto(a, begin(j + 1)), fresh(a)), F.filter(later, fresh(a))))
                of = lambda a: _let(new(a), lambda x: F.when(enough(x), best(a, x)))
                good = F.filter(F.transform(F.filter(here, is_hit), of), lambda r: r["dice"] >= at_least)
                return F.when(enough(F.concat(F.filter(here, fresh(begin(j))), later)), good).otherwise(nothing)

            return F.when(F.exists(here, is_hit), _let(behind(j, firsts), tried)).otherwise(nothing)

        good = _let(_let(own_firsts, all_firsts), lambda firsts: F.transform(_stretches(e, STRETCH), lambda j: in_stretch(j, firsts)))
        order = lambda r: F.struct(-r["dice"], r["first"])
        overlap = lambda x, y: (x["first"] <= y["last"]) & (y["first"] <= x["last"])
        passage = lambda r: F.struct(
            r["dice"].alias("dice"), r["shared"].alias("shared"), r["first"].alias("first"),
            t["template"].alias("template"), t["licence"].alias("licence"), r["last"].alias("last"),
            F.filter(F.sequence(r["first"], r["last"]), is_hit).alias("hits"), nth.alias("nth"),
        )
        return F.transform(_without(good, order, overlap, ["first"], RUN), lambda s: F.transform(s, passage))

    def of_template(t: Column, nth: Column) -> Column:
        of_pairs = runs(t, nth, F.col("pairs"), F.col("pairs_before"))
        if not single:
            return of_pairs
        return F.when(F.contains(F.get(t["grams"], F.lit(0)), F.lit(" ")), of_pairs).otherwise(runs(t, nth, F.col("w"), F.col("w_before")))

    equal = lambda x, y: (x["shared"] == y["shared"]) & (x["dice"] == y["dice"]) & (x["template"] != y["template"])
    clash = lambda x, y: F.arrays_overlap(x["hits"], y["hits"]) & ~equal(x, y)
    order = lambda x: F.struct(-x["shared"], -x["dice"], x["template"], x["first"])
    side_by_side = lambda of: F.transform(
        _stretches(F.col("w"), STRETCH),
        lambda j: F.flatten(F.transform(of, lambda by: F.coalesce(F.get(by, j), F.array().cast(f"array<{PASSAGE}>")))),
    )
    kept = F.flatten(_without(_let(F.transform("near", of_template), side_by_side), order, clash, ["nth", "first"], PASSAGE))

    line = lambda i: F.get("number", i)
    # What an array of structs holds is copied with each, so the template's lines are looked up where they are.
    of = lambda x: F.get("near", x["nth"])
    touched = lambda x: F.sequence(line(x["first"]), line(x["last"]))
    beyond = F.filter(kept, lambda x: ~of(x)["whole"] & ~F.exists(touched(x), lambda i: F.get(of(x)["lines"], i - 1)))
    rows = F.transform(
        beyond,
        lambda x: F.struct(line(x["first"]).alias("line"), x["licence"].alias("licence"), x["template"].alias("template"), x["dice"].alias("dice")),
    )
    return found.select("doc_id", F.inline(rows))


def op8_licenses(spark, folder):
    """All matches in all documents."""
    return scan(table(spark, folder, "documents").select("doc_id", "text"))


def _sql() -> str:
    values = ",\n".join(
        f"('{t}', '{n}', {len(g)}, [{', '.join(repr(x) for x in g)}])" for t, n, g in template_sets()
    )
    return rf"""
WITH t(template, licence, size, grams) AS (VALUES {values}),
d AS (
    SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents
), u AS (
    SELECT doc_id, 0 AS line, text AS unit FROM d
    UNION ALL
    SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS unit
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d
          WHERE contains(text, chr(10)))
), w AS (
    SELECT doc_id, line, list_filter(regexp_split_to_array(translate(unit, '{UPPER}', '{LOWER}'),
        '{BREAKS}'), lambda x: x <> '') AS w
    FROM u
), g AS (
    SELECT doc_id, line, CASE WHEN len(w) = 1 THEN w ELSE
        list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS grams
    FROM w WHERE len(w) > 0
), r AS (
    SELECT doc_id, line, licence, template,
        2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + t.size) AS dice
    FROM g JOIN t ON len(g.grams) BETWEEN t.size * {AT_LEAST / (2 - AT_LEAST)!r}::DOUBLE AND t.size * {(2 - AT_LEAST) / AT_LEAST!r}::DOUBLE
)
SELECT doc_id, CAST(line AS INTEGER) AS line, licence, template, dice FROM r WHERE dice >= {AT_LEAST}::DOUBLE
"""


OP8_SQL = _sql()
