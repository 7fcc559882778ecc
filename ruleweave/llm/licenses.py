"""License scans with DataFrame functions only.

Templates are licences' notices and texts. Shingles are five words. A template
of up to S / 1.25 words belongs to the size class S, a power of two; documents
are cut into windows of 2 * S words that begin every S words, so that each
occurrence lies within one.

1. The shingles of documents that stand in some template are found by one pass
   (a bitmap test, then equality; see decontam.occurrences). Others can't count
   for any containment, so a window is the set of those that remain.
2. Each window has a MinHash signature of one value a band. Two sets meet in a
   band with a probability of their Jaccard similarity J. A window of class S
   holds at most W shingles, however many licences meet in it, so a template of
   n shingles of which it holds a share of 0.8 has J >= 0.8 n / (W + 0.2 n). The
   number of bands follows from the least n of the class: such a pair is missed
   with a probability of MISS at most.
3. Windows and templates that meet in a band are verified: a match is a window
   with 80 % of the distinct shingles of the template, counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm.common import cut
from ruleweave.llm.decontam import BROADCAST_WINDOWS, occurrences, words

SHINGLE, SHARE, MISS = 5, 0.8, 1e-9

#: Lines, notices and whole texts (without the copyright line) of public licences, as they are commonly written. BSD-3-Clause is BSD-2-Clause
#: and one more clause, and each whole text has over 80 % of the other, so that clause is a template of its own.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause-endorsement": "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TEMPLATES.items()), "license_id string, text string")


def template_shingles(templates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(license, size, m, shingle) without repeats; a template of fewer words is one shingle, one of none has none."""
    worded = templates.select(F.col(id_col).cast("string").alias("license"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.size("w") * 1.25, F.lit(8.0))))).cast("int")
    worded = worded.select("license", size.alias("size"), "w", F.least(F.size("w"), F.lit(SHINGLE)).alias("m"))
    each = worded.select("license", "size", "m", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("m"))).alias("at"))
    return each.select("license", "size", "m", F.array_join(F.slice("w", F.col("at") + 1, F.col("m")), " ").alias("shingle")).distinct()


def bands_of(size: int, lengths: list[int], least: int) -> int:
    """Bands by which a window of 2 * size words that holds SHARE of `least` shingles or more is missed with probability MISS."""
    widest = sum(max(0, 2 * size - m + 1) for m in lengths)
    return math.ceil(math.log(MISS) / math.log1p(-min(0.999, SHARE * least / (widest + (1 - SHARE) * least))))


def signature(hashes: Column, bands: Column) -> Column:
    """The least value of each band's hash function over a set of hashes."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", template_id_col: str = "license_id", template_text_col: str = "text") -> DataFrame:
    """Return id_col, n_words, n_licenses, licenses (ids, sorted, comma-joined), containment (the best, 0 if none) and first_word (of the first window that matches, else null) of every row.

    Null and empty texts match nothing; repeated rows give repeated results; a
    null template id reads as `?`; templates of one id are one template; with no
    templates nothing matches; other columns are dropped. The templates' shingles
    and bands are broadcast up to decontam.BROADCAST_WINDOWS rows, and the joins
    are shuffled beyond. Windows are written to the checkpoint folder once, so
    that all that follows reads the same rows.
    """
    named = templates.withColumn(template_id_col, F.coalesce(F.col(template_id_col).cast("string"), F.lit("?")))
    shingles = cut(template_shingles(named, template_id_col, template_text_col))
    classes = shingles.groupBy("license", "size").agg(F.count("*").alias("n"), F.collect_set("m").alias("ms"))
    classes = classes.groupBy("size").agg(F.min("n").alias("least"), F.array_distinct(F.flatten(F.collect_list("ms"))).alias("ms")).collect()  # a row per power of two
    bands = {r["size"]: bands_of(r["size"], r["ms"], r["least"]) for r in classes}
    bands_of_size = F.coalesce(*[F.when(F.col("size") == s, F.lit(n)) for s, n in bands.items()], F.lit(1))

    by_shingle = shingles.groupBy(F.col("shingle").alias("window"), "m").agg(F.collect_set("size").alias("sizes"), F.first("shingle").alias("shingle"))
    seen = occurrences(docs, by_shingle, id_col, text_col)
    rows = seen.select("row", "id", "n_words", "at", "shingle", F.explode_outer("sizes").alias("size"))
    which = F.floor(F.col("at") / F.col("size")).cast("int")
    windows = F.when(F.col("size").isNotNull(), F.filter(F.array(which - 1, which), lambda k: k >= 0))
    rows = rows.select("row", "id", "n_words", "shingle", "size", F.explode_outer(windows).alias("k"))
    sets = cut(rows.groupBy("row", "id", "n_words", "size", "k").agg(F.collect_set("shingle").alias("held")))

    known = shingles.groupBy("license", "size").agg(F.collect_set("shingle").alias("whole"))
    hashes = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    tokens = cut(known.select("license", "size", "whole", F.explode(signature(hashes("whole"), bands_of_size)).alias("token")))
    small = tokens.count() <= BROADCAST_WINDOWS
    placed = sets.where("size is not null").select("row", "id", "n_words", "size", "k", "held", F.explode(signature(hashes("held"), bands_of_size)).alias("token"))
    met = placed.join((F.broadcast if small else lambda d: d)(tokens.select("license", "size", "token")), ["size", "token"])
    met = met.groupBy("row", "id", "n_words", "size", "k", "license").agg(F.first("held").alias("held"))
    known = known.select("license", "size", "whole")
    met = met.join((F.broadcast if small else lambda d: d)(known), ["license", "size"])
    share = F.size(F.array_intersect("held", "whole")) / F.size("whole")
    met = met.select("row", "id", "n_words", "license", (F.col("k") * F.col("size")).alias("first_word"), share.alias("share")).where(F.col("share") >= SHARE)
    none = sets.select("row", "id", "n_words", F.lit(None).cast("string").alias("license"), F.lit(None).cast("int").alias("first_word"), F.lit(None).cast("double").alias("share"))
    found = met.unionByName(none).groupBy("row", "id", "n_words").agg(F.array_sort(F.collect_set("license")).alias("ids"), F.max("share").alias("share"), F.min("first_word").alias("first_word"))
    return found.select(
        F.col("id").alias(id_col), F.col("n_words").cast("bigint").alias("n_words"), F.size("ids").cast("bigint").alias("n_licenses"), F.array_join("ids", ",").alias("licenses"), F.round(F.coalesce("share", F.lit(0.0)), 6).alias("containment"), "first_word"
    )
