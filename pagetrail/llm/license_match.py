"""Licence detection by the Dice coefficient over word bigrams.

Texts are normalised (lower case, anything but letters, digits and dots inside
numbers becomes one space) and looked at line by line, as a whole, and in runs
of neighbouring lines, as notices are wrapped.  A unit
matches a template if the Dice coefficient of their sets of word bigrams is at
least the threshold.  Since 2 min(a, b) / (a + b) bounds the coefficient of
sets of sizes a and b, only templates within the size bounds are compared.

Only documents and lines with a key word are compared: key words are chosen so
that no match can avoid them, which loses none.  DataFrame functions only.

A run starts and ends with lines that share bigrams with the template, since
others only lower the coefficient, and has at most twice as many words as the
template's upper size bound.  It counts where neither one of its lines nor the
whole text matches the template; of runs that overlap the best counts.

Defined results: a null or empty text has no licence (count 0, null name); of
templates with an equal best coefficient the name that sorts first is given;
repeated lines count each time; repeated rows give repeated results, and rows of
one key with different texts have their own; long texts are read whole; other
columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# The words by which these licences are named or granted in notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "all-rights-reserved": "All rights reserved",
}

_MIT_WARRANTY = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Whole licences, without titles and copyright lines. Those of many pages (Apache, GPL, MPL) are known by their notices.
FULL_TEXTS = {
    "MIT-text": f"{TEMPLATES['MIT-grant']} {_MIT_WARRANTY}",
    "BSD-2-Clause-text": f"{TEMPLATES['BSD-grant']} {_BSD_TWO} {_BSD_WARRANTY}",
    "BSD-3-Clause-text": f"{TEMPLATES['BSD-grant']} {_BSD_TWO} {_BSD_THREE} {_BSD_WARRANTY}",
    "ISC-text": f"{TEMPLATES['ISC-grant']} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}

#: What separates words: anything but letters, digits, and a dot between digits.
SEPARATORS = r"[^\p{L}\p{N}.]+|\.(?![0-9])|(?<![0-9])\."


def normalised(text: Column) -> Column:
    """Lower-case words, one space between and around them; lines keep their newlines."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), SEPARATORS, " "), F.lit(" "))


def template_words(text: str) -> list[str]:
    return regex.sub(SEPARATORS, " ", text.lower()).split()


def template_bigrams(texts: dict[str, str] = TEMPLATES) -> dict[str, list[str]]:
    out = {}
    for name, text in texts.items():
        words = template_words(text)
        out[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
    return out


def key_words(threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit with a match holds one.

    A match shares at least t / (2 - t) of a template's bigrams, so that it can't avoid the key words once fewer
    bigrams than that are free of them.  Long words come first, as rarer ones.
    """
    chosen: set[str] = set()
    for own in template_bigrams(TEMPLATES | FULL_TEXTS).values():
        shared = math.ceil(threshold / (2 - threshold) * len(own) - 1e-9)
        while len(free := [b for b in own if not chosen & set(b.split())]) >= shared:
            often = Counter(w for b in free for w in set(b.split()))
            chosen.add(max(often, key=lambda w: (len(w) >= 6, often[w], len(w), w)))
    return sorted(chosen)


def holds_key_word(text: Column, threshold: float = THRESHOLD) -> Column:
    """Whether a text, in lower case, holds one; the text is lowered once."""
    words = key_words(threshold)
    return F.exists(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]))


def bigrams_of(line: Column) -> Column:
    """The distinct word bigrams of a normalised line."""
    return _bigrams(_words(line))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.array(words), lambda ws: F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y)))
    return F.array_distinct(pairs[0])


def _dice(own: Column, want: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(own, want)) / (F.size(own) + F.size(want))


def _in_runs(rows: DataFrame, threshold: float) -> DataFrame:
    """k, unit (the first line), license, dice of the runs of lines that match."""
    lines = F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.cast("int").alias("unit"), _words(normalised(x)).alias("words")))
    rows = rows.where(F.contains("t", F.lit("\n"))).select("k", F.filter(lines, lambda x: F.size(x["words"]) > 0).alias("lines"))
    rows = rows.select("k", "lines", _bigrams(F.flatten(F.transform("lines", lambda x: x["words"]))).alias("own"))
    candidates = []
    for name, bigrams in sorted(template_bigrams(TEMPLATES | FULL_TEXTS).items()):
        want, least = F.array(*map(F.lit, bigrams)), math.ceil(threshold / (2 - threshold) * len(bigrams) - 1e-9)
        most = math.floor((2 - threshold) / threshold * len(bigrams) + 1e-9)
        # without so many of a template's bigrams in all, no run has them
        enough = F.size(F.array_intersect("own", want)) >= least
        candidates.append(F.when(enough, F.struct(F.lit(name).alias("license"), want.alias("want"), F.lit(least).alias("least"), F.lit(most).alias("most"))))
    near = rows.select("k", "lines", "own", F.explode(F.filter(F.array(*candidates), lambda c: c.isNotNull())).alias("c")).select("k", "lines", "own", "c.*")
    near = near.where(_dice(F.col("own"), F.col("want")) < threshold).drop("own")
    near = near.withColumn("alone", F.transform("lines", lambda x: _dice(_bigrams(x["words"]), F.col("want")) >= threshold))
    counted = F.aggregate("lines", F.array(F.lit(0)), lambda n, x: F.concat(n, F.array(F.element_at(n, -1) + F.size(x["words"]))))
    near = near.withColumn("before", counted)
    # with the last word of the line before and the first word of the line after
    none = F.array().cast("array<string>")
    line = lambda i: F.coalesce(F.get("lines", i)["words"], none)
    around = lambda x, i: F.concat(F.slice(line(i - 1), -1, 1), x["words"], F.slice(line(i + 1), 1, 1))
    hits = F.transform("lines", lambda x, i: F.when(F.arrays_overlap(_bigrams(around(x, i)), "want"), i))
    near = near.withColumn("hits", F.filter(hits, lambda i: i.isNotNull())).where(F.size("hits") > 1)

    def fits(i: Column, j: Column) -> Column:
        few = F.get("before", j + 1) - F.get("before", i) <= 2 * F.col("most")
        return (j > i) & few & ~F.exists(F.slice("alone", i + 1, j - i + 1), lambda a: a)

    def run(i: Column, j: Column) -> Column:
        words = F.flatten(F.transform(F.slice("lines", i + 1, j - i + 1), lambda x: x["words"]))
        dice = F.transform(F.array(_bigrams(words)), lambda own: _dice(own, F.col("want")))[0]
        return F.struct((-dice).alias("d"), (j - i).alias("n"), i.alias("i"), j.alias("j"))

    runs = F.flatten(F.transform("hits", lambda i: F.transform(F.filter("hits", lambda j: fits(i, j)), lambda j: run(i, j))))
    near = near.withColumn("runs", F.array_sort(F.filter(runs, lambda r: r["d"] <= -threshold)))
    apart = lambda kept, r: ~F.exists(kept, lambda x: (x["i"] <= r["j"]) & (r["i"] <= x["j"]))
    best = F.aggregate("runs", F.slice("runs", 1, 0), lambda kept, r: F.when(apart(kept, r), F.concat(kept, F.array(r))).otherwise(kept))
    near = near.select("k", "license", "lines", F.explode(best).alias("r"))
    return near.select("k", F.get("lines", F.col("r.i"))["unit"].alias("unit"), "license", (-F.col("r.d")).alias("dice"))


def license_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every unit of a document that matches a template: key, unit (line number from 0, of a run its first; -1: the
    whole text), license, dice."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(holds_key_word(F.col(text), threshold))
    lines = F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.cast("int").alias("unit"), x.alias("line")))
    whole = F.array(F.struct(F.lit(-1).alias("unit"), F.col("t").alias("line")))
    units = F.when(F.contains("t", F.lit("\n")), F.concat(lines, whole)).otherwise(lines)
    units = F.filter(units, lambda u: holds_key_word(u["line"], threshold))
    own = rows.select("k", F.explode(units).alias("u")).select("k", "u.unit", bigrams_of(normalised(F.col("u.line"))).alias("own"))
    sizes = F.size("own")
    matches = []
    for name, bigrams in sorted(template_bigrams(TEMPLATES | FULL_TEXTS).items()):
        b = len(bigrams)
        inside = sizes.between(math.ceil(threshold / (2 - threshold) * b - 1e-9), math.floor((2 - threshold) / threshold * b + 1e-9))
        shared = F.size(F.array_intersect("own", F.array(*map(F.lit, bigrams))))
        matches.append(F.when(inside, F.struct(F.lit(name).alias("license"), (2.0 * shared / (sizes + b)).alias("dice"))))
    found = own.select("k", "unit", F.explode(F.filter(F.array(*matches), lambda m: m["dice"] >= threshold)).alias("m"))
    found = found.select("k", "unit", "m.license", "m.dice").unionByName(_in_runs(rows, threshold))
    return found.withColumnRenamed("k", key)


def document_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: n_matches (units by templates), license (of the best match), dice, licenses (all names)."""
    # rows of one key may hold different texts
    rows = docs.select(F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("h")).alias("k"), F.col(text).alias("t"))
    found = license_lines(rows, key="k", text="t", threshold=threshold)
    # repeated rows each find the same lines: count by distinct unit
    found = found.distinct().groupBy("k").agg(
        F.count("*").alias("n_matches"),
        F.min(F.struct((-F.col("dice")).alias("d"), F.col("license").alias("l"))).alias("best"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    out = rows.select(F.col("k").alias("own")).join(found, F.col("own.id").eqNullSafe(F.col("k.id")) & (F.col("own.h") == F.col("k.h")), "left")
    return out.select(F.col("own.id").alias(key), F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.col("best.l").alias("license"), (-F.col("best.d")).alias("dice"), F.coalesce("licenses", F.lit("")).alias("licenses"))
