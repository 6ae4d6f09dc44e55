"""Licence scan by canonical digests, in DataFrame functions only.

A text is made canonical: lower case, lines that are copyright notices and "all rights reserved" out,
every run of punctuation and white space one blank, equivalent spellings one spelling.
The SHA-256 of the whole canonical text, and of each of its lines, is joined to the
digests of the known licence texts, which are made canonical the same way. Lines are joined
before the whole text is spelled alike, so where a text was wrapped makes no difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Known licences that may be broadcast (an id and 32 bytes each); a larger table is shuffled.
BROADCAST_LICENSES = 100_000
#: Lengths of known texts that are listed in the plan to spare hashing; with more, their range is.
LISTED_SIZES = 1000

#: Spellings that count as equal, and what each becomes.
SPELLINGS = {
    "licence": "license",
    "acknowledgement": "acknowledgment",
    "judgement": "judgment",
    "favour": "favor",
    "honour": "honor",
    "organisation": "organization",
    "authorisation": "authorization",
    "authorised": "authorized",
    "initialise": "initialize",
    "merchantibility": "merchantability",
    "non commercial": "noncommercial",
    "sub license": "sublicense",
    "per cent": "percent",
    "copyright owner": "copyright holder",
    "http www": "https www",
}

#: Characters of punctuation beyond ASCII.
QUOTES = " ©«®·»‐‑‒–—‘’“”•…"
#: A line that starts with 'copyright' is wrapped licence text, not a notice, where one of these or nothing follows.
PROSE = (
    r"notices?|holders?|owners?|ownership|and|or|laws?|acts?|licen[sc]es?|statements?|interests?|disclaimers?|protections?|permissions?|patents?|lines?|doctrines?|treaty|"
    r"is|are|in|to|of|on|if|it|also|like|those|resulting|related|the (?:software|library|program|work)"
)
#: What follows on from 'copyright' in a notice doesn't match this; nor does a notice that begins with (c) go without a year or a placeholder.
_ON = r"[^\p{L}\p{N}\n(<\[\x{a9}]*(?:(?:" + PROSE + r")(?:[^\p{L}\p{N}]|$)|$)"
_SIGN = r"\(c\)\s*(?:copyright|[\d<\[{])|\x{a9}"
COPYRIGHT_LINE = r"(?md)^[^\p{L}\n]*(?:copyright(?![\p{L}\p{N}])(?!" + _ON + r")|" + _SIGN + r")[^\n]*$"
PUNCTUATION = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f" + QUOTES + r"]+"

_MIT = """MIT License
Copyright (c) <year> <copyright holders>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License
Copyright (c) <year> <owner>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_BSD_HEAD = """Copyright (c) <year>, <owner>
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """Copyright (c) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: Licence texts and the one-line notices that stand for them.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", _MIT.partition("\n")[2]),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", _ISC.partition("\n")[2]),
    ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

#: Canonical size and SHA-256 of the full texts of long licences, as their publishers give them.
KNOWN_DIGESTS = [
    ("Apache-2.0", 9889, "45c5565dedc03ff2a570c67c5af611f8a3d0a0227c6e81d9fb11fbf0c004b959"),
    ("Artistic-1.0-Perl", 5833, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 19579, "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", 22015, "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", 33409, "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22448, "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", 14342, "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
]


def canonical_lines(text):
    """The canonical lines of a text column that aren't empty, as an array."""
    body = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    body = F.regexp_replace(body, PUNCTUATION, " ")
    return F.filter(F.transform(F.split(_spelled(body), "\n"), lambda x: F.trim(F.replace(x, F.lit("  "), F.lit(" ")))), lambda x: x != "")


def _spelled(body):
    for old, new in SPELLINGS.items():
        body = F.replace(body, F.lit(old), F.lit(new))
    return F.replace(body, F.lit("all rights reserved"), F.lit(""))


def canonical_text(lines):
    """Canonical lines as one canonical text."""
    return F.trim(F.replace(_spelled(F.array_join(lines, " ")), F.lit("  "), F.lit(" ")))


def _digest(x):
    return F.sha2(x.cast("binary"), 256)


def license_digests(known: DataFrame) -> DataFrame:
    """known(license, text) -> license, digest, size; texts with nothing canonical never match."""
    text = known.select("license", canonical_text(canonical_lines(F.col("text"))).alias("body"))
    text = text.where("body <> ''").select(_digest(F.col("body")).alias("digest"), F.length("body").alias("size"), "license")
    return text.groupBy("digest", "size").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, known_digests: DataFrame | None = None) -> DataFrame:
    """One row per document, licence and unit found: doc_id, license, unit ('text': the whole
    text is the licence, 'line': a line is), hits.

    known(license, text) are texts, known_digests(license, size, digest) those of which only the
    canonical length and digest are kept. A licence of several lines is found as a whole text.
    Null and empty texts and documents without a known licence give no rows; rows that repeat
    a doc_id are counted together, and so are rows without one; of licences with the same text
    the first by name counts. Only texts and lines of
    a known length are hashed."""
    digests = license_digests(known)
    if known_digests is not None:
        both = digests.unionByName(known_digests.select("digest", "size", "license"))
        digests = both.groupBy("digest", "size").agg(F.min("license").alias("license"))
    sizes = [r["size"] for r in digests.select("size").distinct().limit(LISTED_SIZES + 1).collect()]
    low, high = digests.agg(F.min("size"), F.max("size")).first()
    listed = F.array(*map(F.lit, sizes)).cast("array<int>")
    fits_one = (lambda n: F.array_contains(listed, n)) if len(sizes) <= LISTED_SIZES else (lambda n: n.between(low, high))
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.col("text")).alias("lines"))
    whole = F.struct(F.lit("text").alias("unit"), canonical_text(F.col("lines")).alias("body"))
    lines = F.transform("lines", lambda x: F.struct(F.lit("line").alias("unit"), x.alias("body")))
    fits = F.filter(F.concat(F.array(whole), lines), lambda u: fits_one(F.length(u.body)))
    found = units.select("doc_id", F.explode(fits).alias("u")).select("doc_id", "u.unit", _digest(F.col("u.body")).alias("digest"))
    side = digests.select("digest", "license")
    side = F.broadcast(side) if digests.count() <= BROADCAST_LICENSES else side
    return found.join(side, "digest").groupBy("doc_id", "license", "unit").agg(F.count("*").alias("hits"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(KNOWN, "license string, text string")
    digests = spark.createDataFrame(KNOWN_DIGESTS, "license string, size int, digest string")
    return scan_licenses(table(spark, sf_dir, "documents"), known, digests)


def _sql_spelled(body: str) -> str:
    for old, new in SPELLINGS.items():
        body = f"replace({body}, '{old}', '{new}')"
    return f"replace({body}, 'all rights reserved', '')"


def _sql_lines(column: str) -> str:
    word = r"^[^\p{L}\n]*copyright"
    notice = rf"regexp_matches(x, '{word}(?:[^\p{{L}}\p{{N}}]|$)') AND NOT regexp_matches(x, '{word}{_ON}') OR regexp_matches(x, '^[^\p{{L}}\n]*(?:{_SIGN})')"
    lines = f"list_filter(string_split(lower(coalesce({column}, '')), chr(10)), lambda x: NOT ({notice}))"
    plain = _sql_spelled(f"regexp_replace(x, '{PUNCTUATION}', ' ', 'g')")
    return f"list_filter(list_transform({lines}, lambda x: trim(replace({plain}, '  ', ' '))), lambda x: x <> '')"


def _sql_text(lines: str) -> str:
    return "trim(replace(" + _sql_spelled(f"array_to_string({lines}, ' ')") + ", '  ', ' '))"


_VALUES = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
_DIGEST_VALUES = ", ".join(f"('{d}', '{k}')" for k, _, d in KNOWN_DIGESTS)
OP7_SQL = f"""
WITH known(license, text) AS (VALUES {_VALUES}),
digests AS (SELECT digest, min(license) AS license FROM (SELECT sha256({_sql_text(_sql_lines("text"))}) AS digest, license FROM known
  UNION ALL SELECT * FROM (VALUES {_DIGEST_VALUES}) v(digest, license)) GROUP BY digest),
docs AS (SELECT doc_id, {_sql_lines("text")} AS lines FROM documents),
units AS (
  SELECT doc_id, 'text' AS unit, sha256({_sql_text("lines")}) AS digest FROM docs
  UNION ALL SELECT doc_id, 'line', sha256(unnest(lines)) FROM docs
)
SELECT doc_id, license, unit, count(*) AS hits FROM units JOIN digests USING (digest) GROUP BY ALL
"""
