"""License scans: normalised text against licence templates by the Dice coefficient of word bigrams.

Three kinds of unit are compared: lines with short notices, whole texts with licence texts, and windows of a longer text
with the licence texts that may be inside it.  A unit is compared with a template only if the sizes of their bigram sets
allow the threshold: 2 |A and B| / (|A| + |B|) >= t needs |B| between |A| t / (2 - t) and |A| (2 - t) / t, and
|A and B| >= |B| t / (2 - t).  Lines meet their templates in a join on bigrams; lines that share none meet nothing.  A
text is compared with those licence texts of which it holds that many bigrams anywhere, which a set of bigram hashes
tells while the text is read.  Windows are as many words long as the template and start every eighth of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short notices and short licence texts, as published.
NOTICES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License v3.0"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License v2.0"],
    "lgpl-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "bsd-3-clause": ["Released under the BSD 3-Clause License.", "Licensed under the 3-Clause BSD License."],
    "bsd-2-clause": ["Released under the BSD 2-Clause License.", "Licensed under the 2-Clause BSD License."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0-1.0": ["Released into the public domain under CC0 1.0 Universal."],
}
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY
THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the
copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "lgpl-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and
to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}


def template_rows() -> list[tuple[int, str, str, str]]:
    """(template, licence, scope, text); scope is what a template is compared with: lines or whole texts."""
    rows = [(k, "line", t) for k, texts in NOTICES.items() for t in texts] + [(k, "text", t) for k, t in TEXTS.items()]
    return [(i, k, scope, t) for i, (k, scope, t) in enumerate(rows)]


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, "[^a-z0-9]+"), "")


def _bigrams(words: Column, low: float) -> Column:
    """Distinct word bigrams; none where there are too few words for ``low`` of them."""
    pairs = F.transform(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(words))), lambda i: F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1))
    )
    return F.when((F.size(words) > 1) & (F.size(words) > low), F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def templates(spark: SparkSession) -> DataFrame:
    """(template, license, size, gram): one row a bigram of a notice.  The table is fixed, a few hundred rows."""
    rows = [(i, k, len(g), x) for i, k, s, t in template_rows() if s == "line" for g in [template_bigrams(t)] for x in g]
    values = ", ".join(f"({i}, '{k}', {n}, '{x}')" for i, k, n, x in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(template, license, size, gram)")


def _bounds(scope: str, threshold: float) -> tuple[float, float]:
    sizes = [len(template_bigrams(t)) for _, _, s, t in template_rows() if s == scope]
    return min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold


def long_templates() -> list[tuple[int, str, int, list[str]]]:
    """(template, licence, words, bigrams) of the licence texts."""
    return [(i, k, len(template_words(t)), template_bigrams(t)) for i, k, s, t in template_rows() if s == "text"]


def _pairs(words: Column, first: Column, last: Column, of) -> Column:
    """``of`` each pair of successive words, the earlier one at ``first`` to ``last`` (0-based)."""
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: of(F.get(words, i), F.get(words, i + 1))))


def _possible(spark: SparkSession, words: Column, threshold: float) -> Column:
    """The numbers of the licence texts of which a text holds enough bigrams."""
    known = long_templates()
    pairs = ", ".join("('{}', '{}')".format(*g.split()) for g in sorted({g for *_, grams in known for g in grams}))
    code = {f"{r.a} {r.b}": r.h for r in spark.sql(f"SELECT a, b, xxhash64(a, b) AS h FROM VALUES {pairs} AS t(a, b)").collect()}
    array = lambda values: F.array(*(F.lit(v) for v in values)).cast("array<bigint>")
    hashes = _pairs(words, F.lit(0), F.size(words) - 2, lambda a, b: F.xxhash64(a, b))
    least = [len(g) * threshold / (2 - threshold) for *_, g in known]

    def enough(found: Column) -> Column:
        fits = [F.when(F.size(F.array_intersect(found, array([code[x] for x in g]))) >= n, i) for (i, _, _, g), n in zip(known, least)]
        return F.array_compact(F.array(*fits))

    none = F.array().cast("array<int>")
    shared = F.array_intersect(hashes, array(sorted(set(code.values()))))
    some = F.transform(F.array(shared), lambda x: F.when(F.size(x) >= min(least), enough(x)).otherwise(none))[0]
    return F.when(F.size(words) > min(least), some).otherwise(none)


def _texts(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, line_no, scope, license, dice, shared, size): the best licence text for a whole text (line_no -1), and
    the best window for each licence text inside a longer one (line_no is the number of its first word).  Of windows
    that overlap the best one counts."""
    spark = docs.sparkSession
    bound = F.transform(F.array(_words(F.col("text"))), lambda w: F.struct(w.alias("words"), _possible(spark, w, threshold).alias("templates")))
    met = docs.select("doc_id", "key", F.explode(F.filter(bound, lambda x: F.size(x["templates"]) > 0)).alias("x"))
    values = ", ".join(f"({i}, '{k}', {n}, array({', '.join(repr(x) for x in g)}))" for i, k, n, g in long_templates())
    known = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, license, n, grams)")
    met = met.select("doc_id", "key", "x.words", F.explode("x.templates").alias("template")).join(F.broadcast(known), "template")
    last, step = F.size("words") - F.col("n"), F.greatest(F.lit(1), F.floor(F.col("n") / 8).cast("int"))

    def measured(start: Column, pairs: Column) -> Column:
        grams = F.array_distinct(_pairs(F.col("words"), start, start + pairs - 1, lambda a, b: F.concat_ws(" ", a, b)))
        sizes = F.transform(F.array(grams), lambda g: F.struct(F.size(F.array_intersect(g, F.col("grams"))).alias("shared"), F.size(g).alias("own")))[0]
        return F.transform(F.array(sizes), lambda x: F.struct((2.0 * x["shared"] / (x["own"] + F.size("grams"))).alias("dice"), (-start).alias("back"), x["shared"].alias("shared")))[0]

    window = F.array_max(F.transform(F.array_union(F.sequence(F.lit(0), last, step), F.array(last)), lambda i: measured(i, F.col("n") - 1)))
    whole = F.struct(F.lit("text").alias("scope"), measured(F.lit(0), F.size("words") - 1).alias("b"))
    inside = F.when(last > 0, F.struct(F.lit("window").alias("scope"), window.alias("b")))
    tried = met.select("doc_id", "key", "template", "license", "n", F.size("grams").alias("size"), F.explode(F.array_compact(F.array(whole, inside))).alias("x"))
    found = tried.where(F.col("x.b.dice") >= threshold)
    one = F.struct(
        F.col("x.b.dice").alias("dice"), (-F.col("template")).alias("rank"), F.col("x.scope").alias("scope"), (-F.col("x.b.back")).alias("start"), "n", "license",
        F.col("x.b.shared").alias("shared"), "size",
    )
    # a text has two findings for each template at most
    all_ = found.groupBy("doc_id", "key").agg(F.collect_set(one).alias("all"))

    def better(x: Column, y: Column) -> Column:
        near = (y["start"] < x["start"] + x["n"]) & (x["start"] < y["start"] + y["n"])
        return (x["scope"] == y["scope"]) & ((x["scope"] == "text") | near) & (F.struct(y["dice"], y["rank"]) > F.struct(x["dice"], x["rank"]))

    kept = all_.select("doc_id", F.explode(F.filter("all", lambda x: ~F.exists("all", lambda y: better(x, y)))).alias("x"))
    line_no = F.when(F.col("x.scope") == "text", -1).otherwise(F.col("x.start"))
    return kept.select("doc_id", line_no.alias("line_no"), "x.scope", "x.license", "x.dice", "x.shared", "x.size")


def scan(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, line_no, scope, license, dice, shared, size): per document and line (0-based; -1 for a whole text) the
    licence of the best template, if that reaches ``threshold``, of equal templates the first in the table; and per
    document the licence texts that are inside it (scope "window"), with the number of the window's first word.

    A licence text that starts between two windows has a Dice coefficient that is up to 1/16 less than its own.

    Needs doc_id and text; other columns are ignored.  Null and empty texts match nothing; rows that repeat a doc_id and
    its text are one document, different texts under one id are scanned apart; null ids are left out, as a finding must
    be addressable.  An empty table gives no rows.
    """
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("key"), "text")
    low, high = _bounds("line", threshold)
    units = base.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line_no", "unit"))
    # the words are bound to a lambda's variable, and sizes are tested before the rows are made: as columns, both
    # would be copied into every filter that Catalyst moves down to the scan
    sets = F.transform(F.array(_words(F.col("unit"))), lambda w: _bigrams(w, low))
    fitting = F.filter(sets, lambda g: F.size(g).between(low, high))
    units = units.select("doc_id", "key", "line_no", F.explode(fitting).alias("grams"))
    grams = units.select("doc_id", "key", "line_no", F.size("grams").alias("own"), F.explode("grams").alias("gram"))
    t = threshold
    fits = (F.col("own") >= F.col("size") * t / (2 - t)) & (F.col("own") <= F.col("size") * (2 - t) / t)
    met = grams.join(F.broadcast(templates(docs.sparkSession)), "gram").where(fits)
    counted = met.groupBy("doc_id", "key", "line_no", "license", "template", "own", "size").agg(F.count_distinct("gram").alias("shared"))
    scored = counted.withColumn("dice", 2.0 * F.col("shared") / (F.col("own") + F.col("size"))).where(F.col("dice") >= t)
    best = F.max(F.struct("dice", (-F.col("template")).alias("rank"), "license", "shared", "size"))
    found = scored.groupBy("doc_id", "key", "line_no").agg(best.alias("b"))
    return found.select("doc_id", "line_no", F.lit("line").alias("scope"), "b.license", "b.dice", "b.shared", "b.size").unionByName(_texts(base, threshold))
