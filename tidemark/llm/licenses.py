"""License scans by canonical digest lookup; DataFrame operations only.

A text is brought to canonical form: ASCII lower case, copyright statements (with a year or a sign, or of a
holder in the head) dropped, equivalent spellings made one, and runs of ASCII punctuation and white space made one blank. The digest of the whole form is
looked up among the digests of known licenses, by a hash join with that fixed table.
A document is looked up as a whole. Corpora also state a license in a line of its own: each line is looked up by
the same join, among ``NOTICES`` and the whole texts. Patterns are of the kind that both Spark's and the checking SQL's engine know, so both have one rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as one, and the texts of known licenses and notices.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("authorised", "authorized"),
    ("merchantability", "merchantability"), ("whilst", "while"), ("non-commercial", "noncommercial"), ("sub-license", "sublicense"), ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"), ("per cent", "percent"), ("https", "http"),
]
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
UNLICENSE_REST = """

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
TEXTS = [
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC),
    ("BSD-2-Clause", BSD_CONDITIONS + BSD_DISCLAIMER), ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_CONDITIONS + BSD_DISCLAIMER),
    ("BSD-3-Clause", BSD_CONDITIONS + BSD_THIRD + BSD_DISCLAIMER), ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_CONDITIONS + BSD_THIRD + BSD_DISCLAIMER),
    ("Unlicense", UNLICENSE), ("Unlicense", UNLICENSE + UNLICENSE_REST), ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB),
]
#: One-line notices that name a license.
NOTICES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
]

KNOWN = [*TEXTS, *NOTICES] + [(name, re.sub(r"\n[123]\. ", "\n* ", text)) for name, text in TEXTS if name.startswith("BSD")]
# Digests of the canonical forms of long license texts, as they are commonly distributed: the whole
# file, its terms with the line that ends them, and its terms without that line; of Apache-2.0 also the file with the holder filled in.
DIGESTS = [
    ("Apache-2.0", "b200db14d43f341836ccc14296f66944"), ("Apache-2.0", "d44d7dd7bb33c43e91c9d5e48b1d489e"), ("Apache-2.0", "2907559bf696d33fdfdc7da57023e979"), ("Apache-2.0", "77e1a2c8e9671a8095fa8108104daeae"),
    ("Artistic-1.0-Perl", "c1b81bf4478b19597097b63e59382266"), ("BSD-3-Clause", "ddcd765ed0a3236bf96e15f76c36983a"), ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "46854b8246da92c7dbbd4e61312d796c"), ("GFDL-1.3", "0910c7ce68a828123e8374e5df51820c"),
    ("GPL-1.0", "b37a688f44419d3168b23775b65749eb"), ("GPL-1.0", "42c3900f3df27526919a45781fcfaa40"), ("GPL-1.0", "144621ef5a09b5f767fa0f7461f93009"),
    ("GPL-2.0", "422f821c6c0b1812cbde7c1c3be04922"), ("GPL-2.0", "26f606e3d78ac5cd21540a2d8adde537"), ("GPL-2.0", "955e1d1ea98abc4e1f72a0bf6055582b"),
    ("GPL-3.0", "dd25740036eafeeb440b379ece56a8ae"), ("GPL-3.0", "2048533964f4a556d38eb2de2a0efac8"), ("GPL-3.0", "d868dcf55392e5f0012215d4d54644c4"),
    ("LGPL-2.0", "ebf358251bfe9161668a8c8251261977"), ("LGPL-2.0", "ca1c6e193db1a4bac45393f980357c55"), ("LGPL-2.0", "31cdd18a73ea38d4ddf246a095937b20"),
    ("LGPL-2.1", "1ff066c677365f47fea81c911a7c822e"), ("LGPL-2.1", "678176bc76eced93c061414ea9afa263"), ("LGPL-2.1", "5510b1a34afecb1c98ea298fa37ca7ec"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"), ("MPL-1.1", "9fa8ae3e869a929215034d82982372b5"), ("MPL-2.0", "b5b7a0cf4994910cd0204fba4637d6ec"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line with a copyright and a year or sign, or the words that go with it; holders without either, in the head.
STATEMENT = r"(^|\n)[ \t]*(?:(?:copyright|\(c\)|©)(?:[ \t:,]|\(c\)|©|copyright){0,20}(?:19|20)[0-9][0-9]|copyright[ \t:]*(?:\(c\)|©)|©)[^\n]*"
#: Lines that follow one another share a line end, so this is put in force twice.
RESERVED = r"(^|\n)[ \t]*all rights reserved\.?[ \t\r]*(\n|\z)"
HOLDER = r"^([ \t\r\n\f\x0b]*(?:[^\n]*licen[sc]e[^\n]*\n[ \t\r\n\f\x0b]*)?)(?:copyright[ \t][^\n]*(?:\n[ \t\r\n\f\x0b]*|\z)){1,50}"
STEPS = [(STATEMENT, 1), (RESERVED, 2), (RESERVED, 2), (HOLDER, 1)]
OTHER = r"[\x00-/:-`{-\x7f]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text; a null text counts as empty."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, groups in STEPS:
        out = F.regexp_replace(out, pattern, "".join(f"${k + 1}" for k in range(groups)))
    out = F.concat(F.lit(" "), F.regexp_replace(out, OTHER, " "), F.lit(" "))
    for a, b in spellings():
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def spellings() -> list[tuple[str, str]]:
    return [(a.replace("-", " "), b) for a, b in SPELLINGS if a != b]


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license and digest of each known text: a table of fixed size, digested by the same expressions.

    Without ``known`` these are the texts of ``KNOWN`` and the ready ``DIGESTS``.
    """
    rows = spark.createDataFrame(KNOWN if known is None else known, "license string, text string").select("license", F.md5(canonical(F.col("text"))).alias("digest"))
    if known is None:
        rows = rows.union(spark.createDataFrame(DIGESTS, "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest, license (of the whole text, or null) and line_licenses of every row.

    ``line_licenses`` names, sorted and joined by commas, the licenses that single lines are
    known texts of; it is empty if there are none. Empty and null texts have the digest of the
    empty form. Repeated rows are looked up one by one; extra columns are ignored.
    """
    table = F.broadcast(known_licenses(docs.sparkSession, known))  # of fixed size
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_key"), "text")
    whole = keyed.select("doc_id", "_key", F.md5(canonical(F.col("text"))).alias("digest")).join(table, "digest", "left")
    lines = keyed.select("_key", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).select("_key", F.md5(canonical(F.col("line"))).alias("digest"))
    named = lines.join(table, "digest").groupBy("_key").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"))  # as many names as licenses are known
    return whole.join(named, "_key", "left").select("doc_id", "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def canonical_sql(text: str) -> str:
    """``canonical`` for DuckDB."""
    out = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    for pattern, groups in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{''.join(chr(92) + str(k + 1) for k in range(groups))}', 'g')"
    out = f"concat(' ', regexp_replace({out}, '{OTHER}', ' ', 'g'), ' ')"
    for a, b in spellings():
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out})"


def scan_sql() -> str:
    values = ", ".join(f"('{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in KNOWN)
    ready = ", ".join(f"('{a}', '{b}')" for a, b in DIGESTS)
    return f"""
    WITH texts(license, t) AS (VALUES {values}),
    known AS MATERIALIZED (SELECT digest, min(license) AS license FROM (SELECT md5({canonical_sql("t")}) AS digest, license FROM texts UNION ALL SELECT d, l FROM (VALUES {ready}) r(l, d)) GROUP BY 1),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
    named AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM lines JOIN known ON md5({canonical_sql("t")}) = digest GROUP BY doc_id)
    SELECT d.doc_id, md5({canonical_sql("d.text")}) AS digest, known.license, coalesce(line_licenses, '') AS line_licenses
    FROM documents d LEFT JOIN known ON md5({canonical_sql("d.text")}) = known.digest LEFT JOIN named ON d.doc_id = named.doc_id"""
