"""Licence scans by a positional index of rare words, in DataFrame operations only.

Document frequencies of all words of the licence templates are counted over the
whole corpus. Each template is indexed by its rarest words with their places.
A document looks up all its indexed words; the postings are brought to
relative places (document place less template place), and a template is a
candidate where several of its words agree on one. It is a label of the document
where all of the template's key phrases stand at their places from there.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Phrases and the labels that they stand for.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Fixed values: (label, text, key phrases), the wording of public licences and of the notices that name them.
TEMPLATES = (
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""", ("apache license version 2 0", "governing permissions and limitations")),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""", ("source and binary forms", "redistributions in binary form must reproduce")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("source and binary forms", "redistributions of source code must retain")),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""", ("endorse or promote products derived from this software",)),
    ("bsd-disclaimer", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", ("procurement of substitute goods or services",)),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software")
        to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software""", ("any person or organization obtaining a copy", "prepare derivative works of the software")),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc0-1.0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2.0", """under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""", ("gnu general public license as published", "either version 2 of the license")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", """under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", ("gnu general public license as published", "either version 3 of the license")),
    ("gpl-notice", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation""", ("gnu general public license", "free software foundation")),
    ("gpl-notice", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program""", ("in the hope that it will be useful", "see the gnu general public license")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ("with or without fee is hereby granted", "the author disclaims all warranties")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mit-named", "released under the mit license", ("under the mit license",)),
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("permission is hereby granted free of charge", "without restriction including without limitation")),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "without restriction including without limitation")),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at""", ("mozilla public license v 2 0",)),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.""", ("free and unencumbered software", "compiled binary for any purpose")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""", ("permission is granted to anyone to use this software", "alter it and redistribute it freely")),
)

#: (label, words, key phrases with their places): TEMPLATES as the scan reads them.
READ = tuple((label, (ws := re.findall("[0-9a-z]+", text.lower())), tuple((k, next(i for i in range(len(ws)) if ws[i : i + len(k.split())] == k.split())) for k in keys)) for label, text, keys in TEMPLATES)

#: Indexed words a template, and agreeing words that make a candidate.
INDEXED, AGREE = 5, 2


def words(text: Column) -> Column:
    """Runs of digits, letters and all that is not ASCII, A-Z in lower case; [] for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _quoted(items) -> str:
    return "array(" + ", ".join(f"'{x}'" for x in items) + ")"


def _places() -> str:
    """SQL: (place, label) of each phrase in w, by place."""
    cases = []
    for phrase, label in PHRASES:
        ws = phrase.split()
        cases.append("WHEN " + " AND ".join(f"get(w, i{f' + {k}' if k else ''}) = '{x}'" for k, x in enumerate(ws)) + f" THEN '{label}'")
    ends = sorted({phrase.split()[-1] for phrase, _ in PHRASES})
    some = " OR ".join(f"array_contains(w, '{x}')" for x in ends)
    return f"CASE WHEN {some} THEN filter(transform(sequence(0, size(w) - 1), i -> struct(i AS i, CASE {' '.join(cases)} END AS label)), x -> x.label IS NOT NULL) ELSE array() END"


def _starts(phrase: str) -> str:
    """SQL: the places in w where a phrase starts."""
    ws = phrase.split()
    return "filter(transform(w, (x, i) -> i), i -> " + " AND ".join(f"get(w, i{f' + {k}' if k else ''}) = '{x}'" for k, x in enumerate(ws)) + ")"


def index(docs: DataFrame) -> tuple[list[tuple[str, int, int]], dict[str, float]]:
    """Postings (word, template, place) of each template's rarest words, and every template word's IDF. docs: w."""
    vocabulary = sorted({x for _, ws, _ in READ for x in ws})
    present = docs.select(F.expr(f"array_intersect(w, {_quoted(vocabulary)})").alias("v"))
    row = present.selectExpr("explode(concat(v, array(''))) AS word").groupBy("word").count().collect()  # a row a template word
    df = {r[0]: r[1] for r in row}
    total = df.get("", 0)  # the empty word stands once in every document
    idf = {x: math.log((total + 1) / (df.get(x, 0) + 1)) for x in vocabulary}
    postings = []
    for i, (_, ws, _) in enumerate(READ):
        rare = sorted(set(ws), key=lambda x: (-idf[x], x))[:INDEXED]
        postings += [(x, i, k) for k, x in enumerate(ws) if x in rare]
    return postings, idf


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rk, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of docs.

    score: the largest share of a labelled template's indexed words that agree on one
    place, and at least 0.5 with a base label. Null, empty and wordless texts have no
    labels, score 0 and null places. Rows with null ids are scanned like others; rows
    that repeat id and text get equal results. Words of equal rarity go by the alphabet;
    of places with equal shares any gives the same score. Very long texts are read whole.
    An empty table gives an empty result.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("rk"), words(F.col(text_col)).alias("w"))
    postings, _ = index(keyed)
    indexed = sorted({p[0] for p in postings})
    phrases = sorted({k for _, _, ks in READ for k, _ in ks})
    # at most INDEXED words a template
    looked = keyed.withColumn("top", F.expr(f"array_intersect({_quoted(indexed)}, w)")).withColumn("hits", F.expr(_places()))
    looked = looked.withColumn("posts", F.expr("CASE WHEN size(top) > 0 THEN filter(transform(w, (x, i) -> struct(i AS i, x AS x)), p -> array_contains(top, p.x)) ELSE array() END"))
    looked = looked.withColumn("flat", F.expr("CASE WHEN size(posts) > 0 THEN concat(' ', array_join(w, ' '), ' ') END"))
    held = F.array_compact(F.array(*[F.when(F.col("flat").contains(f" {p} "), F.struct(F.lit(i).alias("p"), F.expr(_starts(p)).alias("at"))) for i, p in enumerate(phrases)]))
    rows = looked.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("ik"), "rk", F.size("w").cast("long").alias("n_words"), F.size("hits").cast("long").alias("n_base"), F.expr("get(hits, 0).i").cast("long").alias("first_word"), F.expr("get(hits, size(hits) - 1).i").cast("long").alias("last_word"), F.expr("array_sort(array_distinct(transform(hits, x -> x.label)))").alias("base"), "posts", F.when(F.size("posts") > 0, held).alias("phrases"))
    rows = stored(rows, "licences")
    spark = docs.sparkSession
    table = spark.createDataFrame([(x, t, k) for x, t, k in postings], "x string, t int, k int")
    size = {i: len({p[0] for p in postings if p[1] == i}) for i in range(len(READ))}
    facts = spark.createDataFrame([(i, label, size[i], min(AGREE, size[i]), [(phrases.index(k), at) for k, at in ks]) for i, (label, _, ks) in enumerate(READ)], "t int, label string, size int, least int, keys array<struct<p:int,k:int>>")
    # both tables are bounded by the templates
    places = rows.where("size(phrases) > 0").select("ik", "rk", "phrases", F.explode("posts").alias("p")).join(F.broadcast(table), F.col("p.x") == F.col("x"))
    agreed = places.groupBy("ik", "rk", "t", (F.col("p.i") - F.col("k")).alias("delta")).agg(F.count_distinct("k").alias("n"), F.count_distinct("x").alias("d"), F.first("phrases").alias("phrases"))
    verified = F.forall("keys", lambda k: F.exists("phrases", lambda x: (x["p"] == k["p"]) & F.array_contains(x["at"], F.col("delta") + k["k"])))
    found = agreed.join(F.broadcast(facts), "t").where((F.col("d") >= F.col("least")) & verified)
    per = found.groupBy("ik", "rk").agg(F.array_sort(F.collect_set("label")).alias("own"), F.max(F.col("d") / F.col("size")).alias("share"))
    out = rows.join(per, ["ik", "rk"], "left")
    labels = F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))), ",")
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", "rk", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))
