"""License scan: canonical digest lookup.

A text is brought into canonical form: lower case; lines that state a copyright (and "all rights
reserved" lines) dropped; punctuation of any kind one space; equivalent spellings made one
(licence / license, organisation / organization, holder / owner, sub-license / sublicense, ...). The
MD5 digests of entire canonical texts are joined with the digests of known licenses. Units are the
document as a whole and each of its lines, as notices usually are lines of their own.

Known are the texts and notices of KNOWN, and whole published texts by their digests (WHOLE).
A line states a copyright if it begins with a copyright sign, with "(c)" and a year, with "copyright" and a sign, a year, a placeholder, a colon or "by", or
if it begins with "copyright" and ends with a year or a holder's kind (authors, inc, foundation, ...); other lines that happen to begin
with the word, as wrapped texts have them, stay.

Result: (doc_id, unit, license, times): unit is "document" or "line", times the number of units of
the document with that license. Defined results: null texts and texts that are canonically empty
match nothing; a document of one line counts as document and as line; rows that repeat a doc_id are
counted together; if two names have equal canonical texts the name that sorts first is given. Columns
beside doc_id and text don't matter. All of it is JVM expressions; the registry, whose size doesn't
depend on the data, is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import P

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

#: License name -> texts of it or of its usual notices.
KNOWN: dict[str, list[str]] = {
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT, "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "ISC": [_ISC, "ISC License\n\n" + _ISC, "Licensed under the ISC License.", "Released under the ISC License."],
    "BSD-2-Clause": [_BSD_TOP + "\n" + _BSD_END, "BSD 2-Clause License\n\n" + _BSD_TOP + "\n" + _BSD_END, "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": [_BSD_TOP + _BSD_3 + "\n" + _BSD_END, "BSD 3-Clause License\n\n" + _BSD_TOP + _BSD_3 + "\n" + _BSD_END, "Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
    ],
    "GPL-3.0": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ],
    "GPL-2.0": [
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "AGPL-3.0": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "LGPL-2.1": [
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA""",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
        "Released into the public domain under the Unlicense.",
    ],
    "BSL-1.0": [
        """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Distributed under the Boost Software License, Version 1.0.",
    ],
    "0BSD": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    ],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.", "Licensed under CC0 1.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
    ],
}

#: License name -> MD5 of the canonical forms of whole published texts: as they are, and without the appendix that tells how to apply them.
WHOLE: dict[str, list[str]] = {
    "Apache-2.0": ["e32aea965561f41a8390221b29af2726", "5d2795cb35f13d3f170c4a82e7d9f97f"],
    "Artistic-1.0-Perl": ["2fe792d1191a708e71b9beca097682bd"],
    "CC0-1.0": ["d2a76f70ce19809695b7fb93c6241c23"],
    "GFDL-1.2": ["8d0843544e24727fdc5e9df92d1f8263"],
    "GFDL-1.3": ["93019451609b1c5343aaffc95cde060b"],
    "GPL-1.0": ["b37a688f44419d3168b23775b65749eb", "42c3900f3df27526919a45781fcfaa40"],
    "GPL-2.0": ["422f821c6c0b1812cbde7c1c3be04922", "26f606e3d78ac5cd21540a2d8adde537"],
    "GPL-3.0": ["dd25740036eafeeb440b379ece56a8ae", "2048533964f4a556d38eb2de2a0efac8"],
    "LGPL-2.0": ["ebf358251bfe9161668a8c8251261977", "ca1c6e193db1a4bac45393f980357c55"],
    "LGPL-2.1": ["1ff066c677365f47fea81c911a7c822e", "678176bc76eced93c061414ea9afa263"],
    "LGPL-3.0": ["b31b7335bc37919e8cdd79154e04d88d"],
    "MPL-1.1": ["4ed6600fcf5321eb9dcd2181cde18632"],
    "MPL-2.0": ["b5b7a0cf4994910cd0204fba4637d6ec"],
}

#: Patterns for both Java and RE2, applied in this order to lower-case text.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}©\n]*(?:©[^\n]*|\(c\) *(?:copyright|[0-9]{4})[^\n]*|(?:portions )?copyrights? *(?:©|\(c\)|:|[\[<{]|[0-9]{4}|by )[^\n]*|copyright [^\n]*(?:[0-9]{4}|authors|inc|ltd|llc|foundation|corporation)[.,;]?[ \t\r]*|all rights reserved[^\n]*)$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
EQUIVALENT = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("acknowledgement", "acknowledgment"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("merchantibility", "merchantability"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("https", "http"),
)


def by_line(text: Column) -> Column:
    """Words of a text whose lines are still apart."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), PUNCTUATION, " ")


def joined(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def alike(words: Column) -> Column:
    """Equivalent spellings made one; they may stand across lines, so lines are joined before."""
    for a, b in EQUIVALENT:
        words = F.replace(words, F.lit(a), F.lit(b))
    return words


def canonical(text: Column) -> Column:
    return alike(joined(by_line(text)))


def registry(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license)."""
    rows = [(name, text) for name, texts in (known or KNOWN).items() for text in texts]
    out = spark.createDataFrame(rows, "license string, text string").select(canonical(F.col("text")).alias("c"), "license").where("c != ''").select(F.md5("c").alias("digest"), "license")
    if known is None:
        out = out.union(spark.createDataFrame([(d, name) for name, digests in WHOLE.items() for d in digests], "digest string, license string"))
    return out.groupBy("digest").agg(F.min("license").alias("license"))


def scan(spark: SparkSession, docs: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, unit, license, times)."""
    rows = docs.where("text is not null").select("doc_id", by_line(F.col("text").cast("string")).alias("c"))
    unit = F.concat(F.array(F.struct(F.lit("document").alias("unit"), joined(F.col("c")).alias("c"))), F.transform(F.split("c", "\n"), lambda x: F.struct(F.lit("line").alias("unit"), F.trim(x).alias("c"))))
    units = rows.select("doc_id", F.explode(unit).alias(P + "u")).select("doc_id", P + "u.*").where("c != ''")
    found = units.select("doc_id", "unit", F.md5(alike(F.col("c"))).alias("digest")).join(F.broadcast(registry(spark, known)), "digest")
    return found.groupBy("doc_id", "unit", "license").agg(F.count(F.lit(1)).alias("times"))


def sql() -> str:
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rows = ", ".join(f"({text(name)}, {text(t)})" for name, texts in KNOWN.items() for t in texts)

    whole_texts = ", ".join(f"({text(d)}, {text(name)})" for name, digests in WHOLE.items() for d in digests)

    def lines(c: str) -> str:
        return f"regexp_replace(regexp_replace(lower({c}), {text(COPYRIGHT_LINE)}, '', 'g'), {text(PUNCTUATION)}, ' ', 'g')"

    def alike(c: str) -> str:
        for a, b in EQUIVALENT:
            c = f"replace({c}, {text(a)}, {text(b)})"
        return c

    whole = "trim(regexp_replace({}, '[ \n]+', ' ', 'g'))"
    return f"""
WITH known AS (SELECT digest, min(license) AS license FROM (SELECT md5(c) AS digest, license FROM (SELECT {alike(whole.format(lines("t")))} AS c, license FROM (VALUES {rows}) v(license, t)) WHERE c <> '' UNION ALL SELECT digest, license FROM (VALUES {whole_texts}) w(digest, license)) GROUP BY digest),
canonical AS (SELECT doc_id, {lines("text")} AS c FROM documents WHERE text IS NOT NULL),
units AS (
    SELECT doc_id, 'document' AS unit, {whole.format("c")} AS c FROM canonical
    UNION ALL SELECT doc_id, 'line' AS unit, trim(unnest(string_split(c, chr(10)))) AS c FROM canonical
)
SELECT doc_id, unit, license, count(*) AS times FROM units JOIN known ON md5({alike('units.c')}) = known.digest WHERE units.c <> '' GROUP BY doc_id, unit, license
"""
