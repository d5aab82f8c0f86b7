"""Licence scans: Dice coefficient over word bigrams between passages and licence templates.

Passages of a text are its lines, its blocks between blank lines where a block has several
lines, its sentences (across line ends) where it has several, and the whole text where it has
several blocks. A passage and a template are normalised alike: lower case, runs of anything
but letters and digits to one space. With |A| and |B| distinct bigrams, Dice is
2|A∩B| / (|A|+|B|), so a template can reach a threshold t only where |A| lies between
t/(2-t)|B| and (2-t)/t|B|. A passage has at least as many bigrams as distinct words less one,
so passages of too many distinct words for every template, or too short ones, are dropped
before any bigram is made. A passage that reaches the threshold lacks at most
|B| - ⌈t/(2-t)|B|⌉ of the template's bigrams. Of words that share no bigram of the template,
each one that a passage lacks costs it all bigrams with that word, so it must hold a certain
number of them; texts, and then passages, that hold too few of every template's words are
passed over before any bigram is made. Of some words that together stand in more bigrams than
a passage may lack it must hold one, which is looked for first, in the plain text. A text or template of one word has that word as its
only bigram. All of it is DataFrame expressions.

Null and empty texts match nothing; a null id is reported like any other. Repeated rows give
repeated matches. Ties in the coefficient go to the smaller template id. Whole texts count,
however long; an empty table gives an empty result, and other columns, whatever their names,
play no part.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices as licences are commonly declared, and the licences' own short texts and standard headers.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": "Released under the MIT License.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "proprietary": "All rights reserved.",
}
SENTENCE = r"([.!?])[ \t\r\n]+([\p{Lu}\"(])"  # where a sentence ends and the next begins


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), F.lit(""))


def bigrams_of(words: Column) -> Column:
    """Distinct bigrams of a list of words; of a single word, the word."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) < 2, words).otherwise(pairs))


def telling_words(grams: list[str], threshold: float) -> tuple[list[str], int]:
    """Words that share no bigram, long ones first, and how many of them a passage must hold to reach the threshold."""
    spare = len(grams) - math.ceil(round(threshold / (2 - threshold) * len(grams), 9))
    chosen, sizes, used = [], [], set()
    for w in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (-len(w), w)):
        own = {g for g in grams if w in g.split(" ")}
        if not own & used:
            chosen.append(w)
            sizes.append(len(own))
            used |= own
    lacking = 0
    for n in sorted(sizes):  # the most words that the spare bigrams allow to lack
        spare -= n
        if spare < 0:
            break
        lacking += 1
    return chosen, len(chosen) - lacking


def marking_words(grams: list[str], threshold: float) -> list[str]:
    """Few and long words of which a passage must hold one to reach the threshold: they stand in more bigrams than it may lack."""
    spare = len(grams) - math.ceil(round(threshold / (2 - threshold) * len(grams), 9))
    of = {w: {g for g in grams if w in g.split(" ")} for g in grams for w in g.split(" ")}
    chosen: list[str] = []
    covered: set[str] = set()
    while len(covered) <= spare:
        best = max(sorted(of), key=lambda w: len(of[w] - covered) * len(w) ** 2)
        chosen.append(best)
        covered |= of.pop(best)
    return chosen


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, broadcast_bigrams: int = 200_000, max_marks: int = 10_000
) -> DataFrame:
    """Rows (id, unit, unit_no, license, dice): each passage's best template of at least `threshold`.

    Templates are a parameter; they are broadcast while they have at most `broadcast_bigrams`
    bigrams, and joined by a shuffle beyond that.
    """
    spark: SparkSession = docs.sparkSession
    named = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, body string")
    grams = named.select("license", F.explode(bigrams_of(words_of(F.col("body")))).alias("gram"))
    by_template: dict[str, list[str]] = {}
    for r in grams.collect():  # the templates given, a parameter
        by_template.setdefault(r.license, []).append(r.gram)
    sizes = [(k, len(v)) for k, v in by_template.items()]
    telling = [telling_words(g, threshold) for g in by_template.values()]
    marks = sorted({w for g in by_template.values() for w in marking_words(g, threshold)})
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    grams = grams.join(F.broadcast(spark.createDataFrame(sizes, "license string, n_template long")), "license")
    if sum(n for _, n in sizes) <= broadcast_bigrams:
        grams = F.broadcast(grams)
    least, most = min((n for _, n in sizes), default=1) * low, max((n for _, n in sizes), default=0) * high

    def held(words: Column) -> Column:
        """A cheap necessary test; a template set with very many words does without."""
        if not 0 < len(marks) <= max_marks or any(need < 1 for _, need in telling):
            return F.size(words) > 0
        array = lambda ws: F.array(*map(F.lit, ws))
        enough = [F.size(F.array_intersect(words, array(ws))) >= need for ws, need in telling]
        return F.arrays_overlap(words, array(marks)) & reduce(lambda a, b: a | b, enough)

    def marked(low: Column) -> Column:
        return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in marks)) if 0 < len(marks) <= max_marks else F.lit(True)

    text = F.coalesce(F.col(text_col), F.lit(""))
    # as lambdas, so that the lower-case text and the words are made once, however often they are looked at
    docs = docs.filter(F.exists(F.array(F.lower(text)), marked)).filter(F.exists(F.array(words_of(text)), held))
    lines, blocks = F.split(text, "\n"), F.split(text, r"\n[\t ]*\n")
    parts = F.split(F.regexp_replace(text, SENTENCE, "$1\u0001$2"), "\u0001")
    unit = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("unit_no"), x.alias("body"))
    none = F.filter(F.array(unit("text")(text, F.lit(0))), lambda u: F.lit(False))
    several = F.filter(F.transform(blocks, unit("block")), lambda u: F.instr(u["body"], "\n") > 0)
    sentences = F.when(F.size(parts) > 1, F.transform(parts, unit("sentence"))).otherwise(none)
    whole = F.when(F.size(blocks) > 1, F.array(unit("text")(text, F.lit(0)))).otherwise(none)
    units = F.filter(F.concat(F.transform(lines, unit("line")), several, sentences, whole), lambda u: (F.char_length(u["body"]) >= F.lit(2 * least - 1)) & F.exists(F.array(F.lower(u["body"])), marked))
    units = F.transform(units, lambda u: F.struct(u["unit"].alias("unit"), u["unit_no"].alias("unit_no"), words_of(u["body"]).alias("words")))
    units = F.filter(units, lambda u: held(u["words"]) & (F.size(F.array_distinct(u["words"])) <= F.lit(most + 1)))
    # outer, as the optimizer would make the units twice more to see beforehand whether there are any
    rows = docs.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__row"), F.explode_outer(units).alias("__u")).filter("__u is not null")
    rows = rows.select("__id", "__row", F.col("__u.unit").alias("unit"), F.col("__u.unit_no").alias("unit_no"), bigrams_of(F.col("__u.words")).alias("__grams")).withColumn("__n", F.size("__grams"))
    rows = rows.filter((F.col("__n") >= least) & (F.col("__n") <= most))
    hits = rows.select("__id", "__row", "unit", "unit_no", "__n", F.explode("__grams").alias("gram")).join(grams, "gram")
    hits = hits.filter((F.col("__n") >= F.col("n_template") * low) & (F.col("__n") <= F.col("n_template") * high))
    both = hits.groupBy("__id", "__row", "unit", "unit_no", "license", "__n", "n_template").agg(F.count(F.lit(1)).alias("__both"))
    scored = both.withColumn("dice", 2.0 * F.col("__both") / (F.col("__n") + F.col("n_template"))).filter(F.col("dice") >= threshold)
    best = scored.groupBy("__id", "__row", "unit", "unit_no").agg(F.max(F.col("dice")).alias("dice"), F.min_by("license", F.struct(-F.col("dice"), F.col("license"))).alias("license"))
    return best.select(F.col("__id").alias(id_col), "unit", "unit_no", "license", "dice")
