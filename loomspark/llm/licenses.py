"""Operator 8: licence scans by canonical digest lookup.

A text is canonical after: lower case; copyright lines dropped; equivalent spellings made
one; everything but letters and digits made one space; title lines at its beginning dropped.
The SHA-256 of that is looked up among the digests of known licence texts.  The lookup is made
for the entire text, for each of its lines, and for its runs of one paragraph and more (lines
joined, as blank lines part them), as long as the known texts are, so that a notice or a whole
licence standing in a longer document is found as well, however its lines are wrapped.  All are
equi-joins on the digest.

Scale: one scan, one canonical form a text, from which its parts are cut; a part whose length no
known text has is neither hashed nor joined (equal digests have equal lengths).  The licence
table is a parameter; it is broadcast only if it was counted and is small.  Only rows that match
are aggregated, so common ordinary lines never meet in one task.

Defined results: null and empty texts, and texts with nothing but copyright lines, have no
digest (null) and no licence; a notice that repeats in a text counts each time; a very long text
is scanned once; repeated rows are kept as they are; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Equivalent spellings, replaced wherever they stand (variant, canonical).
SPELLINGS = (
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sub-licens", "sublicens"),
    ("non-commercial", "noncommercial"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("fulfill", "fulfil"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("https", "http"),
)

#: Licence identifiers with the texts and notices known for them.
LICENSES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("LicenseRef-AllRightsReserved", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
)

#: Title lines, in canonical form.
TITLES = ("mit license", "the mit license", "the mit license mit", "mit license mit", "isc license", "the isc license", "bsd 2 clause license", "bsd 3 clause license", "the 2 clause bsd license", "the 3 clause bsd license", "simplified bsd license", "new bsd license", "bsd zero clause license", "zero clause bsd", "zlib license", "the zlib license", "the unlicense", "unlicense", "license")

#: Lines that name a copyright holder; they differ from copy to copy.  (A wrapped line may begin
#: with the word as well: a year, a sign, a name behind "by" or a place to fill in must follow.)
COPYRIGHT_LINE = r"(?m)^[\x20\t*#/;-]*(?:copyright[\x20\t:,]*(?:\(c\)|©|\d|by\b|\[|<|\{)|\(c\)|©)[^\n]*$"


def spelled(text):
    """Lower case, without copyright lines, spellings made one, only letters, digits and line
    feeds with single spaces between; lines are still apart."""
    c = F.lower(F.coalesce(text, F.lit("")))
    marked = c.contains("copyright") | c.contains("(c)") | c.contains("©")
    c = F.when(marked, F.regexp_replace(c, COPYRIGHT_LINE, " ")).otherwise(c)
    for variant, spelling in SPELLINGS:
        c = F.replace(c, F.lit(variant), F.lit(spelling))
    # single spaces stay as they are: few places have to be replaced
    return F.regexp_replace(c, r"\x20?[^\p{L}\p{N}\n\x20][^\p{L}\p{N}\n]*|\x20{2,}", " ")


def flat(c):
    """The lines of a spelled text as one."""
    return F.trim(F.regexp_replace(c, r"\x20?\n[\x20\n]*", " "))


def untitled(c):
    """A spelled text without title lines (and blank ones) at its beginning."""
    titles = "|".join(sorted(TITLES, key=len, reverse=True))
    return F.regexp_replace(c, rf"^(?:[\x20\n]*(?:(?:{titles})\x20?(?:\n|$)))+", "")


def canonical(text):
    """Canonical form of a text column; '' if nothing is left."""
    return flat(untitled(spelled(text)))


def digest(text):
    """SHA-256 in hexadecimal of the canonical form, null if that is empty."""
    c = canonical(text)
    return F.when(c != "", F.sha2(c, 256))


#: Blank lines part paragraphs (in a spelled text).
PARAGRAPH = r"\n\x20?(?:\n\x20?)+"


def known_digests(spark: SparkSession, licenses=LICENSES) -> DataFrame:
    """(k_digest, license_id, k_chars, k_paragraphs): one row per digest; entries whose digests
    agree keep the least id."""
    known = spark.createDataFrame(list(licenses), "license_id string, text string").withColumn("c", untitled(spelled(F.col("text"))))
    parts = F.size(F.filter(F.split("c", PARAGRAPH), lambda p: F.trim(p) != ""))
    known = known.select(flat(F.col("c")).alias("c"), "license_id", parts.alias("parts")).filter("c != ''")
    return known.groupBy(F.sha2("c", 256).alias("k_digest")).agg(F.min("license_id").alias("license_id"), F.min(F.length("c")).alias("k_chars"), F.array_distinct(F.collect_set("parts")).alias("k_paragraphs"))


def scan(docs: DataFrame, known: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """doc_id, digest, license_id (entire text), notice_ids and n_notices (its lines, and its runs
    of paragraphs that are no single line) for every row."""
    # lengths and numbers of paragraphs: at most as many as the longest known text has
    sizes = known.agg(F.array_sort(F.collect_set("k_chars")).alias("chars"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("k_paragraphs")))).alias("parts")).first()
    fits = lambda n: n.isin(sizes["chars"]) if sizes["chars"] else F.lit(False)
    known = known.select("k_digest", "license_id")
    known = F.broadcast(known) if known.limit(most_broadcast + 1).count() <= most_broadcast else known
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("mark"), spelled(F.col("text")).alias("c"))
    lines = F.filter(F.transform(F.split("c", "\n"), lambda x: F.trim(x)), lambda x: fits(F.length(x)))
    # a paragraph: whether it is one line, and its canonical form
    parts = F.transform(F.split("c", PARAGRAPH), lambda p: F.struct(F.contains(F.trim(p, F.lit(" \n")), F.lit("\n")).alias("lines"), flat(p).alias("c")))
    rows = rows.select("doc_id", "mark", flat(untitled(F.col("c"))).alias("whole"), lines.alias("lines"), F.filter(parts, lambda p: p["c"] != "").alias("parts"))
    rows = rows.withColumn("sizes", F.transform("parts", lambda p: F.length(p["c"])))
    n = F.size("parts")

    def of(k: int):
        """Runs of ``k`` paragraphs; only those of a known length are put together."""
        length = lambda i: sum((F.get("sizes", i + j) for j in range(1, k)), F.get("sizes", i)) + (k - 1)
        first = F.filter(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: fits(length(i)) & ((F.get("parts", i)["lines"]) if k == 1 else F.lit(True)))
        return F.when(n >= k, F.transform(first, lambda i: F.array_join(F.transform(F.slice("parts", i + 1, k), lambda p: p["c"]), " ")))

    none = F.array().cast("array<string>")
    pieces = F.concat("lines", *[F.coalesce(of(k), none) for k in sizes["parts"] or []])
    # the entire text is piece -1, which every row has
    rows = rows.select("doc_id", "mark", F.posexplode(F.concat(F.array("whole"), pieces)).alias("pos", "piece"))
    rows = rows.select("doc_id", "mark", (F.col("pos") - 1).alias("pos"), F.when(F.col("piece") != "", F.sha2("piece", 256)).alias("l_digest"))
    found = rows.join(known, F.col("l_digest") == F.col("k_digest"), "left")
    entire = F.col("pos") == -1
    hit = F.when(~entire & F.col("license_id").isNotNull(), F.struct("pos", "license_id"))
    # rows that agree in doc_id and text are alike: they are counted, and told apart again below
    per = found.filter(entire | F.col("license_id").isNotNull()).groupBy("doc_id", "mark").agg(F.count_if(entire).alias("copies"), F.max(F.when(entire, F.col("l_digest"))).alias("digest"), F.max(F.when(entire, F.col("license_id"))).alias("license_id"), F.collect_set(hit).alias("hits"))
    ids = F.array_join(F.array_sort(F.array_distinct(F.col("hits.license_id"))), ",")
    out = per.select("doc_id", "digest", "license_id", ids.alias("notice_ids"), F.size("hits").cast("long").alias("n_notices"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.drop("copy")


def op8_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))
