"""License scans: MinHash bands over overlapping text windows retrieve templates, containment verifies them.

Words are lower-cased runs of letters and digits; shingles are five consecutive words, hashed to 64 bits. A text is cut into overlapping
windows on two scales, since a window must not be much longer than what it looks for: windows of ``SHORT`` = 2 shingles, two apart, for
notices of fewer than ``LONG`` = 16 shingles, and windows of 16 shingles, eight apart, for longer texts. Each window has ``BANDS`` MinHash values,
one band each: the least shingle hash under the band's mask. Templates are indexed by the same values over their own windows
at every place (short ones also over their first and last shingle alone), each with the place of its least shingle, so that a hit says where in the
text the template would start.

Collision: a window collides with a template window of Jaccard similarity s in at least one band with probability 1 - (1 - s) ** BANDS. An
unedited occurrence of three or more shingles contains a whole window that the index has, and one of one or two shingles shares at least one of
two with a window, which is the least in half the bands, as masks come with their complements (probability 1 in both cases). A long template with a fifth of its shingles changed
has windows of s = 0.43 or more at any alignment (0.1%), and several of them. Retrieved places are then verified exactly: the share of
the template's distinct shingles (as strings) that occur from there on, with ``SLACK`` shingles and a fifth of its length on either side for inserted
and missing words, must be ``CONTAINMENT`` or more.

Phrases too short for a shingle (license tags, a bare title) are found by patterns.

Result: one row per occurrence: id, license, notice (number of the template, then of the phrase), containment, start_word, end_word (exclusive; from the
first to the last shingle found). Places less than half a template apart are one occurrence; the best of them counts. Defined results:
null and empty texts have no rows; repeated rows give repeated results; an empty table gives an empty result; extra
columns are ignored. Main path: DataFrame functions only. Texts without a hit are not shuffled; those with one are written once and meet their few verified
places in a join. The index is as large as the list of templates, not as the corpus.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgrid.llm.common import checkpointed, running_sums

SHINGLE, BANDS, CONTAINMENT, SHORT, LONG, SLACK = 5, 12, 0.8, 2, 16, 8
#: Places between two windows, by scale.
STEPS = {SHORT: 2, LONG: 8}

#: Usual license notices and first sentences of licenses, with SPDX names.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("AGPL", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
)

#: Further notices and titles.
MORE_NOTICES = (
    ("MIT", "The MIT License (MIT) Copyright (c)"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License v 2.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
)

#: License texts and headers.
LONG_TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("as-is-disclaimer", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""),
    ("BSD-disclaimer", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)

#: Phrases of fewer than five words; the license is the pattern's first group, or the name if that is given.
PHRASES = (
    (None, r"(?i)\bSPDX-License-Identifier:\s*([A-Za-z0-9][A-Za-z0-9.+-]*)"),
    ("MIT", r"(?i)\bMIT License\s+Copyright \(c\)()"),
)
ALL_TEMPLATES = TEMPLATES + MORE_NOTICES + LONG_TEXTS
_WORDS = r"[\p{L}\p{N}]+"
#: Masks of the bands: a fixed sequence of random 64-bit numbers, each with its complement, so that of two shingles each is the least in half the bands.
MASKS = tuple(m ^ flip for m in (random.Random(17 + i).getrandbits(64) - 2**63 for i in range(BANDS // 2)) for flip in (0, -1))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORDS), F.lit(0))


def shingle_hashes(words: Column) -> Column:
    """64-bit hashes of all shingles of an array of words."""
    one = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)])
    return F.when(F.size(words) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), one)).otherwise(F.array().cast("array<bigint>"))


def window_starts(n: Column, size: int) -> Column:
    """First shingles of the windows of a scale over n shingles: each shingle lies in one, the last window may be cut by the end."""
    step = STEPS[size]
    regular = F.sequence(F.lit(0), n - 1, F.lit(step)) if size == SHORT else F.array_union(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(step)), F.array(F.greatest(n - size, F.lit(0))))
    return F.when(n > 0, regular).otherwise(F.array().cast("array<int>"))


def band(hashes: Column, start: Column, size: int, k: int) -> Column:
    """The least hash of a window under the mask of band k (as the hash itself)."""
    mask = F.lit(MASKS[k])
    if size == SHORT:
        a = F.get(hashes, start).bitwiseXOR(mask)
        return F.least(a, F.get(hashes, start + 1).bitwiseXOR(mask)).bitwiseXOR(mask)  # least leaves out nulls
    return F.array_min(F.transform(F.slice(hashes, start + 1, F.lit(size)), lambda h: h.bitwiseXOR(mask))).bitwiseXOR(mask)


def _with(value: Column, use) -> Column:
    """``use(value)``, with value computed once."""
    return F.transform(F.array(value), use)[0]


def _shingles(words: Column) -> Column:
    n = F.size(words)
    starts = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(SHINGLE)), " "))


def template_index(spark: SparkSession, templates: tuple[tuple[str, str], ...] = ALL_TEMPLATES) -> tuple[DataFrame, dict[int, list[list[int]]]]:
    """Index rows (scale, band, value, place, notice, license, size, shingles), and the values per scale and band."""
    frame = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "notice int, license string, text string")
    frame = frame.withColumn("words", words_of(F.col("text"))).where(F.size("words") >= SHINGLE).withColumn("hashes", shingle_hashes(F.col("words")))
    frame = frame.withColumn("scale", F.when(F.size("hashes") < LONG, SHORT).otherwise(LONG)).withColumn("shingles", F.array_distinct(_shingles(F.col("words"))))
    n = F.size("hashes")
    parts = []
    for size in (SHORT, LONG):
        starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))
        own = frame.where(F.col("scale") == size).withColumn("start", F.explode(starts))
        made = own.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), band(F.col("hashes"), F.col("start"), size, k).alias("value")) for k in range(BANDS)])).alias("v"))
        if size == SHORT:  # the ends alone, as a window meets them that lies across an end
            ends = F.array(*[F.struct(F.lit(k).alias("band"), F.get("hashes", i).alias("value")) for k in range(BANDS) for i in (F.lit(0), n - 1)])
            made = made.unionByName(own.select("*", F.explode(ends).alias("v")))
        parts.append(made)
    index = parts[0].unionByName(parts[1])
    places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("hashes", i) == F.col("v.value"))
    index = index.select("scale", "v.band", "v.value", F.explode(places).alias("place"), "notice", "license", F.size("words").alias("size"), "shingles").distinct()
    sets: dict[int, list[list[int]]] = {size: [[] for _ in range(BANDS)] for size in (SHORT, LONG)}
    # A band's value is one of the template's own shingle hashes, so a text without any of them has no hit.
    for r in index.select("scale", "band", "value").distinct().orderBy("scale", "band", "value").collect():
        sets[r["scale"]][r["band"]].append(r["value"])
    return index, sets


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per occurrence of a template or phrase; see the module's description. ``ALL_TEMPLATES`` is the full list."""
    index, sets = template_index(docs.sparkSession, templates)

    def hits(hashes: Column, size: int) -> Column:
        """(scale, band, value, at) of the bands of this scale's windows that the index has; at is the place of the least shingle."""
        def of(start: Column) -> Column:
            made = []
            for k in range(BANDS):
                if sets[size][k]:
                    value = band(hashes, start, size, k)
                    at = start + F.array_position(F.slice(hashes, start + 1, F.lit(size)), value).cast("int") - 1
                    made.append(F.when(value.isin(sets[size][k]), F.struct(F.lit(size).alias("scale"), F.lit(k).alias("band"), value.alias("value"), at.alias("at"))))
            return F.filter(F.array(*made), lambda x: x.isNotNull()) if made else F.array().cast(_HITS)

        known = sorted({v for values in sets[size] for v in values})
        windows = F.flatten(F.transform(window_starts(F.size(hashes), size), of))
        return F.when(F.exists(hashes, lambda h: h.isin(known)), windows).otherwise(F.array().cast(_HITS))

    found = _with(words_of(F.col(text_col)), lambda ws: F.struct(
        ws.alias("words"), _with(shingle_hashes(ws), lambda h: F.concat(hits(h, SHORT), hits(h, LONG))).alias("hits")))
    kept = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), found.alias("f")).where(F.size("f.hits") > 0)
    # Row numbers are fixed by the checkpoint; it holds the texts with a hit only.
    kept = checkpointed(kept.select("id", "row", "f.words", "f.hits"))
    each = kept.select("row", F.explode("hits").alias("h")).select("row", F.col("h.scale").alias("scale"), F.col("h.band").alias("band"), F.col("h.value").alias("value"), F.col("h.at").alias("at"))
    # The index has some ten thousand rows: templates times places times bands.
    places = each.join(F.broadcast(index), ["scale", "band", "value"]).select("row", "notice", (F.col("at") - F.col("place")).alias("start")).distinct()
    about = index.select("notice", "license", "size", "shingles").distinct()
    # The region of each place is cut where the row's words are, so a row's words are never copied once per place.
    slack = lambda size: F.lit(SLACK) + F.floor(size / 5).cast("int")
    places = places.join(F.broadcast(about.select("notice", "size")), "notice").groupBy("row").agg(F.collect_list(F.struct("notice", "start", "size")).alias("places"))

    def cut(p: Column) -> Column:
        base = F.greatest(p["start"] - slack(p["size"]), F.lit(0))
        upto = p["start"] + p["size"] + slack(p["size"])
        return F.struct(p["notice"].alias("notice"), p["start"].alias("start"), base.alias("base"), F.slice("words", base + 1, F.greatest(upto - base, F.lit(0))).alias("region"))

    regions = kept.select("id", "row", "words").join(places, "row").select("id", "row", F.explode(F.transform("places", cut)).alias("p")).select("id", "row", "p.*")
    matched = regions.join(F.broadcast(about), "notice")

    def measured(around: Column) -> Column:
        """Containment in the words from ``around`` words before the start to as many after the end, and the span of the shingles found."""
        low, high = F.greatest(F.col("start") - around, F.lit(0)), F.col("start") + F.col("size") + around
        region = F.when(high > low, F.slice("region", low - F.col("base") + 1, F.greatest(high - low, F.lit(0)))).otherwise(F.array().cast("array<string>"))

        def spans(own: Column) -> Column:
            first = lambda a: F.array_position(a, F.lit(True)).cast("int")
            same = F.transform(own, lambda s: F.array_contains("shingles", s))
            return F.struct(
                (F.size(F.array_intersect(own, "shingles")) / F.size("shingles")).alias("containment"),
                (low + first(same) - 1).alias("start_word"), (low + F.size(own) - first(F.reverse(same)) + SHINGLE).alias("end_word"),
            )

        return _with(_shingles(region), spans)

    # The template's own length first: with slack, a neighbouring occurrence would lengthen the span.
    tested = matched.withColumn("m", measured(F.lit(0)))
    tested = tested.withColumn("m", F.when(F.col("m.containment") >= containment, F.col("m")).otherwise(measured(slack(F.col("size")))))
    tested = tested.select("id", "row", "notice", "license", "size", "start", "m.*").where(F.col("containment") >= containment)
    by_start = Window.partitionBy("row", "notice").orderBy("start")
    new = (F.col("start") - F.lag("start").over(by_start) > F.floor(F.col("size") / 2)).cast("int")
    tested = tested.withColumn("occurrence", F.sum(F.coalesce(new, F.lit(0))).over(by_start))
    far = F.abs(F.col("start_word") - F.col("start"))
    best = tested.groupBy("row", "id", "notice", "license", "occurrence").agg(F.max_by(F.struct("containment", "start_word", "end_word"), F.struct(F.col("containment"), -far, -F.col("start"))).alias("m"))
    named = best.select("id", "license", "notice", "m.containment", "m.start_word", "m.end_word")
    phrases = phrase_hits(docs, id_col, text_col, len(templates))
    return named.unionByName(phrases).withColumnRenamed("id", id_col)


_HITS = "array<struct<scale:int,band:int,value:bigint,at:int>>"


def phrase_hits(docs: DataFrame, id_col: str, text_col: str, first_notice: int) -> DataFrame:
    """Occurrences of ``PHRASES``, with positions in words."""
    text = F.col(text_col)
    count = lambda t: F.regexp_count(t, F.lit(_WORDS))
    parts = []
    for i, (name, pattern) in enumerate(PHRASES):
        pieces = F.transform(F.split(text, pattern, -1), count)
        whole, group = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        own = F.transform(whole, count)
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(own)), own, lambda p, w: p + w)
        rows = docs.where(F.regexp_like(text, F.lit(pattern))).select(
            F.col(id_col).alias("id"), F.explode(F.arrays_zip(running_sums(steps).alias("end"), own.alias("own"), group.alias("group"))).alias("x"))
        license_ = F.lit(name) if name else F.col("x.group")
        parts.append(rows.select("id", license_.alias("license"), F.lit(first_notice + i).alias("notice"), F.lit(1.0).alias("containment"),
                                 (F.col("x.end") - F.col("x.own")).alias("start_word"), F.col("x.end").alias("end_word")))
    return reduce(DataFrame.unionByName, parts)
