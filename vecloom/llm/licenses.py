"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Only DataFrame functions. Words are runs of letters and digits, lower-cased; shingles are five words; a shingle's hash
is XXH64. A template of m shingles belongs to the width class W, the least power of two with W >= 2m: windows of W
shingles begin every W / 2, so that a passage of the template's length lies whole in one window. A window and a
template meet if they agree in one of BANDS bands of one MinHash each. A window that contains at least CONTAINED of a
template has a Jaccard similarity of CONTAINED / (4 + 1 - CONTAINED) = 0.19 at least, and meets it with probability
1 - 0.81 ** BANDS, over 0.99999. Then the share of the template's shingles that the window holds decides, exactly.

Pushdown: with one row a band, a window can only meet a template if it holds one of the shingles that give the
template's MinHashes. Up to MAX_SHINGLES shingles of templates, these key shingles are literals, so one pass without
shuffle finds the windows worth a signature; the others cannot meet anything. Larger sets of templates find them by a
join of the documents' shingles with the keys, and lead to the same result. Matches are shuffled by document and license.

Templates: the notices and whole licenses below (paragraphs too, so that a part of a text is found), or any table of
names and texts, such as a folder of license files (`templates_from`). White space, line breaks, case and punctuation
play no part.

Defined results. Null and empty texts, and texts under five words, match nothing; neither do templates under five
words. Repeated rows (equal id and text) are reported once; rows with a null id are reported with a null id. Texts are
read whole. In one window the license contained most fully is reported, with ties all of them. Extra columns are
ignored. A table without templates finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.base import materialize

SHINGLE, BANDS, CONTAINED = 5, 60, 0.8
MAX_SHINGLES = 50_000

# The words of public licenses.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
    "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE.",
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
    "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
    "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may "
    "not be removed or altered from any source distribution."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
    "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
    "under the License."
)


def _gnu(version: str, kind: str = "GNU General Public License") -> str:
    """The notice that a file under one of the GNU licenses carries."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is "
        f"distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details."
    )


TEMPLATES = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the terms of the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy", " ".join(_MIT), _MIT[0], _MIT[2]],
    "ISC": [" ".join(_ISC), _ISC[0], _ISC[1]],
    "Zlib": [_ZLIB],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License 2.0", _APACHE],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License version 2", _gnu("2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License version 3", _gnu("3")],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3", _gnu("3", "GNU Lesser General Public License")],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", _gnu("3", "GNU Affero General Public License")],
    "MPL-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License", " ".join(_BSD), _BSD[3]],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License", " ".join((*_BSD[:3], _BSD[4]))],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0"],
    "CC0-1.0": ["dedicated to the public domain under CC0 1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", _UNLICENSE],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced"],
}


def let(value: Column, body) -> Column:
    """body(x) with x evaluated once, wherever the optimiser moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column) -> Column:
    """The hash of every five-word shingle of the text, in order."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    none = F.array().cast("array<bigint>")

    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(w[i + k] for k in range(SHINGLE))))
        return F.when(F.size(w) >= SHINGLE, each).otherwise(none)

    return F.coalesce(let(words, grams), none)


def signature(hashes: Column) -> Column:
    """BANDS MinHashes of distinct shingle hashes."""
    return let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(h, lambda x: F.xxhash64(x, j)))))


def templates(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """license, template text from a table of names and notices."""
    return spark.createDataFrame([(k, t) for k, v in (known or TEMPLATES).items() for t in v], "license string, text string")


def templates_from(spark: SparkSession, folder: str) -> DataFrame:
    """license, text from a folder of whole license texts; a file's name is its license."""
    files = spark.read.text(folder, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.txt|\.md)?$", 1).alias("license"), F.col("value").alias("text"))


def prepare(known: DataFrame) -> DataFrame:
    """license, template, shingles, m, width, sig and key shingles of templates (license, text)."""
    rows = known.select("license", "text").distinct().withColumn("shingles", F.array_distinct(shingle_hashes(F.col("text")))).withColumn("m", F.size("shingles")).filter("m > 0")
    # the shingles that give the MinHashes
    keys = F.filter("shingles", lambda x: F.exists(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(x, j) == F.col("sig")[j]))
    width = F.pow(F.lit(2), F.ceil(F.log2(F.col("m") * 2))).cast("int")
    return rows.select("license", F.xxhash64("license", "text").alias("template"), "shingles", "m", width.alias("width"), signature(F.col("shingles")).alias("sig")).withColumn("keys", keys)


def _starts(hits: Column, half: int) -> Column:
    return F.array_distinct(F.flatten(F.transform(hits, lambda p: F.filter(F.array(F.floor(p / half) * half, (F.floor(p / half) - 1) * half), lambda s: s >= 0))))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, license, containment, n_windows, first_word: the licenses that documents (doc_id, text) contain."""
    table = materialize(prepare(known), "templates")
    sizes = table.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.collect_set("width").alias("widths")).first()  # widths are powers of two
    widths, few = sorted(sizes["widths"]), sizes["m"] <= MAX_SHINGLES
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), shingle_hashes(F.col("text")).alias("hs"))
    if few:
        keys = sorted({h for r in table.select("keys").collect() for h in r["keys"]})  # BANDS a template at most
        hits = let(F.col("hs"), lambda hs: F.when(F.size(hs) > 0, F.filter(F.sequence(F.lit(0), F.size(hs) - 1), lambda i: hs[i].isin(keys))))
        near = rows.withColumn("hits", hits).filter(F.size("hits") > 0)
    else:
        keys = table.select(F.explode("keys").alias("key")).distinct()
        found = rows.select("doc_id", "h", F.posexplode("hs").alias("at", "key")).join(keys, "key").groupBy("doc_id", "h").agg(F.collect_set("at").alias("hits"))
        near = rows.join(found.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "hits"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).drop("d", "g")
    # windows of each class that hold a hit: the one that begins at or before it, and the one before that
    starts = [_starts(F.col("hits"), w // 2) for w in widths]
    windows = near.select("doc_id", "h", "hs", F.explode(F.array(*(F.struct(F.lit(w).alias("width"), s.alias("starts")) for w, s in zip(widths, starts, strict=True))) if widths else F.array().cast("array<struct<width:int,starts:array<bigint>>>")).alias("c"))
    windows = windows.select("doc_id", "h", "hs", "c.width", F.explode("c.starts").alias("start")).withColumn("start", F.col("start").cast("int"))
    windows = windows.select("doc_id", "h", "width", "start", F.array_distinct(F.slice("hs", F.col("start") + 1, F.col("width"))).alias("own"))
    windows = windows.withColumn("own_sig", signature(F.col("own")))
    bands = windows.select("*", F.posexplode("own_sig").alias("band", "value"))
    of = table.select("license", "template", "shingles", "m", "sig", F.col("width").alias("w"), F.posexplode("sig").alias("b", "v"))
    met = bands.join(F.broadcast(of) if few else of, (F.col("width") == F.col("w")) & (F.col("band") == F.col("b")) & (F.col("value") == F.col("v")))  # BANDS rows a template
    # of the bands in which a pair meets, the first reports it
    first = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.col("own_sig")[i] == F.col("sig")[i]))
    share = F.size(F.array_intersect("own", "shingles")) / F.col("m")
    found = met.filter(F.col("band") == first).withColumn("share", share).filter(F.col("share") >= CONTAINED)
    # notices that differ in a word or two lie within CONTAINED of each other: in one window the fullest match counts
    fullest = F.max("share").over(Window.partitionBy("doc_id", "h", "width", "start"))
    found = found.withColumn("fullest", fullest).filter("share = fullest")
    return found.groupBy("doc_id", "h", "license").agg(F.round(F.max("share"), 6).alias("containment"), F.countDistinct("width", "start").alias("n_windows"), F.min("start").alias("first_word")).drop("h")


def oracle(known: dict[str, list[str]] | None = None) -> str:
    """DuckDB SQL for scan() over documents: containment in the same windows by brute force, without MinHash."""
    rows = ", ".join("('{}', '{}')".format(k.replace("'", "''"), t.replace("'", "''")) for k, v in (known or TEMPLATES).items() for t in v)
    words = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
with t as (select license, text, {words} as w from (values {rows}) v(license, text)),
ts as (select distinct license, text as template, array_to_string(w[i + 1:i + 5], ' ') as g from (select *, unnest(range(0, len(w) - 4)) as i from t)),
tm as (select *, count(*) over (partition by license, template) as m from ts),
tw as (select *, pow(2, ceil(log2(m * 2)))::bigint as width from tm),
d as (select distinct doc_id, text, {words} as w from documents where text is not null),
s as (select doc_id, text, i, array_to_string(w[i + 1:i + 5], ' ') as g from (select *, unnest(range(0, len(w) - 4)) as i from d)),
hit as (select doc_id, text, i, license, template, m, width, g from s join tw using (g)),
win as (
  select doc_id, text, license, template, m, width, g, (i // (width // 2)) * (width // 2) as start from hit
  union all select doc_id, text, license, template, m, width, g, (i // (width // 2) - 1) * (width // 2) from hit),
c as (select doc_id, text, license, template, width, start, count(distinct g) / m as share from win where start >= 0 group by doc_id, text, license, template, width, start, m having count(distinct g) / m >= {CONTAINED}),
f as (select *, max(share) over (partition by doc_id, text, width, start) as fullest from c)
select doc_id, license, round(max(share), 6) as containment, count(distinct (width, start)) as n_windows, min(start)::int as first_word
from f where share = fullest group by doc_id, text, license
"""
