"""Licence scans by canonical digests (DataFrame operations only).

A text is brought to canonical form: A-Z lower-cased, copyright notices dropped (lines, told by their form from a
licence's own sentences), everything in ASCII that is neither a letter nor a digit turned into one space, and words of
equivalent spelling written in one way, also across lines. The SHA-256 of the whole canonical text, and of each of its
lines, is looked up by a hash join among the digests of known licence texts and notices. The known table is built here
from short texts, digests of long ones, names and forms; it has a fixed number of rows, and is broadcast.

Defined cases: null and blank texts have the digest of the empty string, which no licence has; repeated rows stay,
each with its own result; a text that is one notice and nothing else matches both as a whole and as a line; further
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that make a line which begins with "copyright" a sentence of a licence and no notice.
_SENTENCE = (
    r"notices?|holders?|owners?|ownership|laws?|licen[cs]es?|statements?|and|or|in|is|are|to|of|on|for|as|under|if|any|this|that|you|a|an|with|which|by"
    r"|interests?|rights?|protection|permissions?|disclaimers?|treaty|treaties|may|shall|must|will|has|have|can|be|not|also|from|work|works|software|library|program"
)
_YEAR = r"(?:(?:19|20)\d\d\b|[\[<{(]?(?:yyyy|years?)\b)"
#: Notices, by form: copyright and a sign or year; a sign and a year (or © alone); copyright and a short name that ends
#: the line; all rights reserved.
COPYRIGHT = (
    rf"(?m)^[^a-z0-9\n]*(?:copyright\b[ \t:,]*(?:\(c\)|©|{_YEAR})[^\n]*|(?:\(c\)[ \t]*{_YEAR}|©)[^\n]*"
    rf"|copyright\b[ \t]*:?[ \t]+(?![^\n]*\b(?:{_SENTENCE})\b)[^\s]+(?:[ \t]+[^\s]+){{0,5}}(?:(?<=\b(?:inc|ltd|llc|co|corp)\.)|(?<![.,;:]))[ \t]*$"
    r"|copyright\b[^\n]*\ball rights reserved[^\n]*|(?<![a-z0-9])all rights reserved[^\n]*)"
)
#: The oracle's own rule, as it was: it drops every line that begins so.
_SQL_COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
NOT_WORD = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

#: Spellings that count as equal, on words divided by single spaces.
SPELLINGS = {
    "licence": "license", "licenced": "licensed", "licences": "licenses", "licencing": "licensing", "sub license": "sublicense",
    "sub licence": "sublicense", "organisation": "organization", "organisations": "organizations", "favour": "favor",
    "judgement": "judgment", "labour": "labor", "offence": "offense", "programme": "program", "whilst": "while",
    "wilful": "willful", "non commercial": "noncommercial", "per cent": "percent", "copyright owner": "copyright holder",
    "copyright owners": "copyright holders", "merchantability": "merchantability", "http": "https", "initialise": "initialize",
    "authorise": "authorize", "authorised": "authorized", "recognise": "recognize", "analogue": "analog", "centre": "center",
}

#: Texts of short licences.
_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WARRANTY_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>
"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
TEXTS = {
    "MIT": ["MIT License\n" + _MIT + _WARRANTY_MIT, _MIT + _WARRANTY_MIT, "The MIT License (MIT)\n" + _MIT + _WARRANTY_MIT],
    "BSD-2-Clause": [_BSD_2 + _WARRANTY_BSD, "BSD 2-Clause License\n" + _BSD_2 + _WARRANTY_BSD],
    "BSD-3-Clause": [_BSD_2 + _BSD_3 + _WARRANTY_BSD, "BSD 3-Clause License\n" + _BSD_2 + _BSD_3 + _WARRANTY_BSD],
    "ISC": [head + "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY_ISC for head in ("", "ISC License\n")],
    "Unlicense": [_UNLICENSE],
    "Zlib": [head + _ZLIB for head in ("", "zlib License\n")],
    "BSL-1.0": [_BOOST],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _WARRANTY_ISC],
}
#: Digests of the canonical texts of longer licences: the whole file, and where it has one, all up to the
#: end of its terms without the appendix behind them.
DIGESTS = {
    "Apache-2.0": ["45c5565dedc03ff2a570c67c5af611f8a3d0a0227c6e81d9fb11fbf0c004b959", "6530dac82be99e5bbcc128a6caf5bfdd0451a21fe23ac3df15ed85a1c550c859"],
    "Artistic-1.0-Perl": ["08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "GFDL-1.2": ["5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"],
    "GFDL-1.3": ["93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"],
    "GPL-1.0": ["8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"],
    "GPL-2.0": ["efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"],
    "GPL-3.0": ["a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"],
    "LGPL-2.0": ["61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"],
    "LGPL-2.1": ["4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"],
    "MPL-2.0": ["9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"],
}
#: Names that notices use, and the forms of notices.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "the Apache 2.0 License", "Apache-2.0"],
    "MIT": ["the MIT License", "MIT License", "MIT"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD-3-Clause"],
    "GPL-2.0": ["the GNU General Public License, version 2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "GPL-3.0", "GPLv3"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, Version 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"],
}
FORMS = ["Licensed under {}.", "This work is licensed under {}.", "Released under {}.", "Distributed under {}.", "SPDX-License-Identifier: {}"]


def _spelled(text: Column, spellings: dict[str, str]) -> Column:
    """``text`` with each of ``spellings`` written in its one way, longer ones first; looked for before it is rewritten."""
    out = text
    for a in sorted(spellings, key=lambda x: (-len(x), x)):
        out = F.regexp_replace(out, rf"\b{a}\b", spellings[a])
    return F.when(text.rlike(rf"\b(?:{'|'.join(sorted(spellings))})\b"), out).otherwise(text)


def canonical_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``lines``, the canonical lines of ``text`` that are not empty, and ``whole``, the lines joined.

    Spellings of several words are looked for once more in ``whole``, where no line break parts them.
    """
    other = {a: b for a, b in SPELLINGS.items() if a != b}
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    out = docs.withColumn("_c", F.regexp_replace(F.regexp_replace(low, COPYRIGHT, ""), NOT_WORD, " "))
    out = out.withColumn("_c", _spelled(F.col("_c"), other))
    out = out.withColumn("lines", F.filter(F.transform(F.split("_c", "\n"), lambda x: F.trim(x)), lambda x: x != "")).drop("_c")
    out = out.withColumn("whole", F.array_join("lines", " "))
    return out.withColumn("whole", _spelled(F.col("whole"), {a: b for a, b in other.items() if " " in a}))


def known(spark: SparkSession) -> DataFrame:
    """(digest, license_id): the fixed table, less than 300 rows; the first id of a digest counts."""
    rows = [(i, t) for i, ts in TEXTS.items() for t in ts] + [(i, f.format(n)) for i, ns in NAMES.items() for n in ns for f in FORMS]
    table = canonical_lines(spark.createDataFrame(rows, "license_id string, text string"))
    table = table.select(F.sha2("whole", 256).alias("digest"), "license_id")
    table = table.unionByName(spark.createDataFrame([(d, i) for i, ds in DIGESTS.items() for d in ds], "digest string, license_id string"))
    return table.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, canonical_sha256, license_id, notices, n_notice_lines) for every row of ``docs``.

    license_id is the licence that the whole text is, or null; notices has the distinct ids of lines that are known
    texts, sorted.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = canonical_lines(rows).select("row", "doc_id", "lines", "whole")
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.sha2("whole", 256).alias("d")))
    each = F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(x, 256).alias("d")))
    units = rows.select("row", "doc_id", F.explode(F.concat(whole, each)).alias("u"))
    table = F.broadcast(known(docs.sparkSession))
    found = units.select("row", "doc_id", "u.whole", "u.d").join(table, F.col("d") == F.col("digest"), "left")
    found = found.filter(F.col("whole") | F.col("license_id").isNotNull())
    line = F.when(~F.col("whole"), F.col("license_id"))
    return found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(F.col("whole"), F.col("d"))).alias("canonical_sha256"),
        F.max(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_sort(F.collect_set(line)).alias("notices"),
        F.count(line).alias("n_notice_lines"),
    ).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the licences and licence notices in every document."""
    return scan(read(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


def _sql_canonical(text: str) -> str:
    got = f"regexp_replace(regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{_SQL_COPYRIGHT}', '', 'g'), '{NOT_WORD}', ' ', 'g')"
    other = {a: b for a, b in SPELLINGS.items() if a != b}
    for a in sorted(other, key=lambda x: (-len(x), x)):
        got = f"regexp_replace({got}, '\\b{a}\\b', '{other[a]}', 'g')"
    return f"list_filter(list_transform(string_split({got}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _sql_known() -> str:
    rows = [(i, t) for i, ts in TEXTS.items() for t in ts] + [(i, f.format(n)) for i, ns in NAMES.items() for n in ns for f in FORMS]
    return ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in rows)


def _sql_digests() -> str:
    return ", ".join(f"('{d}', '{i}')" for i, ds in DIGESTS.items() for d in ds)


ORACLE_SQL = f"""
WITH raw(license_id, text) AS (VALUES {_sql_known()}),
dg(digest, license_id) AS (VALUES {_sql_digests()}),
kn AS (SELECT digest, min(license_id) AS license_id
       FROM (SELECT sha256(array_to_string({_sql_canonical('text')}, ' ')) AS digest, license_id FROM raw UNION ALL SELECT digest, license_id FROM dg) GROUP BY 1),
c AS (SELECT doc_id, {_sql_canonical('text')} AS lines FROM documents),
w AS (SELECT doc_id, sha256(coalesce(array_to_string(lines, ' '), '')) AS canonical_sha256 FROM c),
l AS (SELECT doc_id, license_id FROM (SELECT doc_id, unnest(lines) AS line FROM c) JOIN kn ON sha256(line) = digest),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n FROM l GROUP BY 1)
SELECT w.doc_id, canonical_sha256, kn.license_id, coalesce(notices, '') AS notices, coalesce(n.n, 0)::BIGINT AS n_notice_lines
FROM w LEFT JOIN kn ON canonical_sha256 = digest LEFT JOIN n ON w.doc_id = n.doc_id
"""
