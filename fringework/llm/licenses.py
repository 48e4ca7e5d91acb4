"""License scans by canonical digest lookup.

A text is canonicalised (case, copyright lines, list marks, quotes and all other
punctuation, white space, equivalent spellings of whole words) and its SHA-256 is
joined to the digests of known licence texts. The join takes entire texts: the
whole document, and each of its lines as a text of its own, so a notice that
stands alone on a line is found wherever it is. A text is canonicalised once,
with its line breaks; of the lines only those whose number of words some known
text has are hashed, since no other can match.

Cases: null and empty texts match nothing (a text without a letter or digit has
no digest). Repeated rows are scanned each and all keep an output row; a null key
is kept, whatever the keys' type. Known texts of equal digests count as the one
with the least id. Very long texts are canonicalised whole, like any other. Extra
columns are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.llm.shared import table, written

#: Spellings that count as equal: whole words of the lower-cased text, replaced in this order.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("authorise", "authorize"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("colour", "color"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organisations", "organizations"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("programmes", "programs"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("sub license", "sublicense"), ("sub licenses", "sublicenses"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("https", "http"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_0 = _MIT.split("\n\n")[0].replace(", subject to the following conditions:", ".") + "\n\n" + _MIT.split("\n\n")[2]
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def _gnu_header(name: str, version: str, work: str = "This program", later: bool = True) -> str:
    """The notice that this family of licences asks to put into each file."""
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"""{work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {which}.

{work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with {work.lower()}. If not, see <http://www.gnu.org/licenses/>."""


#: Known texts by licence; entire licences, standard headers and one-line notices.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", f"{_BSD_2}\n\n{_BSD_END}"), ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_2}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_END}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_END}"),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("Unlicense", _UNLICENSE), ("BSL-1.0", _BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST),
    ("MIT-0", _MIT_0), ("MIT-0", "MIT No Attribution\n\n" + _MIT_0), ("0BSD", _0BSD), ("0BSD", "BSD Zero Clause License\n\n" + _0BSD), ("MPL-2.0", _MPL_HEADER),
    *((f"{short}-{v}-{'or-later' if later else 'only'}", _gnu_header(f"GNU {kind}General Public License", v2, later=later)) for short, kind, v, v2 in (
        ("GPL", "", "3.0", "3"), ("GPL", "", "2.0", "2"), ("LGPL", "Lesser ", "3.0", "3"), ("LGPL", "Lesser ", "2.1", "2.1"), ("AGPL", "Affero ", "3.0", "3")) for later in (True, False)),
)

#: The digest table may be broadcast up to this many known texts (about 100 bytes each).
BROADCAST_TEXTS = 50_000

#: A line that begins with a copyright mark.
_MARK = r"(?i:copyright|copr\.|\(c\)|©)"
_COPYRIGHT = rf"^(?:[^A-Za-z0-9(©]*(?i:portions))?[^A-Za-z0-9(©]*{_MARK}"
#: Unless what follows shows that the line is a sentence about copyright.
_SENTENCE = (
    rf"^[^A-Za-z0-9(©]*(?:{_MARK}[^A-Za-z0-9(©]*)+(?i:holders?|owners?|notices?|laws?|licen[cs]es?|interests?|statements?|protection|treat(?:y|ies)|and|or|is|are|in|to|of|as|"
    r"for|this|that|which|shall|must|may|can|will|be|on|an?|act)(?:[^A-Za-z0-9]|$)"
)
#: Lines that only reserve all rights.
_RESERVED = r"(?i)^[^A-Za-z0-9]*all rights reserved[^A-Za-z0-9]*$"
#: Numbers and letters before the items of a list; other marks are punctuation.
_ITEM = r"(?m)^[ \t]*(?:[0-9]{1,2}|[a-z])[.)][ \t]"
_PUNCTUATION = r"[^\p{L}\p{N}\n]+"


_UNIX_LINES = _ITEM.replace("(?m)", "(?md)")


def _one_spelling(words: Column) -> Column:
    """One spelling for words that stand between single spaces; line breaks stand between spaces too."""
    spaced = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for there, here in EQUIVALENT:
        spaced = F.replace(spaced, F.lit(f" {there.replace(' ', '  ')} "), F.lit(f" {here.replace(' ', '  ')} "))
    return F.trim(F.replace(spaced, F.lit("  "), F.lit(" ")))


def _trie(words: Sequence[str]) -> str:
    """A pattern for any of the words that looks at each letter once."""
    ends, goes = "" in words, {}
    for w in words:
        if w:
            goes.setdefault(w[0], []).append(w[1:])
    arms = [c + _trie(rest) for c, rest in sorted(goes.items())]
    if not arms:
        return ""
    return ("(?:" + "|".join(arms) + ")" if len(arms) > 1 or ends else arms[0]) + ("?" if ends else "")


#: Whether any of the spellings may stand in a text; most texts have none and skip the replacements.
_ANY_SPELLING = r"\b" + _trie([there.split(" ")[0] if there.split(" ")[0] in ("sub", "non", "per") else there for there, _ in EQUIVALENT])


def with_canonical(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the canonical text in place of ``text``, its lines parted by " \\n ".

    In steps of their own, so that what several branches need is computed once.
    """
    about, bare = F.col("_low"), F.col("_bare")
    marked = F.contains(about, F.lit("copyright")) | F.contains(about, F.lit("copr.")) | F.contains(about, F.lit("(c)")) | F.contains(about, F.lit("©")) | F.contains(about, F.lit("all rights reserved"))
    names = lambda line: (line.rlike(_COPYRIGHT) & ~line.rlike(_SENTENCE)) | line.rlike(_RESERVED)
    others = F.lower(F.array_join(F.filter(F.split(text, "\n"), lambda line: ~names(line)), "\n"))
    rows = rows.withColumn("_low", F.lower(text)).withColumn("_low", F.when(marked, others).otherwise(about))
    words = F.regexp_replace(F.regexp_replace("_low", _UNIX_LINES, " "), _PUNCTUATION, " ")
    rows = rows.withColumn("_bare", F.regexp_replace(F.trim(words), " ?\n[ \n]*", " \n "))
    return rows.withColumn(text, F.when(bare.rlike(_ANY_SPELLING), _one_spelling(bare)).otherwise(bare)).drop("_low", "_bare")


def _flat(canonical_text: Column) -> Column:
    """The canonical text of all lines together; a spelling of two words may have been parted by a line break."""
    flat = F.trim(F.replace(F.replace(canonical_text, F.lit(" \n "), F.lit(" ")), F.lit("\n"), F.lit("")))
    return F.when(F.contains(canonical_text, F.lit("\n")) & flat.rlike(_ANY_SPELLING), _one_spelling(flat)).otherwise(flat)


def _digest(plain: Column) -> Column:
    return F.when(plain != "", F.sha2(plain, 256))


def _n_words(plain: Column) -> Column:
    return F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """(digest, license_id, n_words) of the known texts, each digest once; ``known`` may be a table (license_id, text)."""
    texts = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license_id string, text string")
    plain = with_canonical(texts.select("license_id", F.coalesce("text", F.lit("")).alias("lines")), "lines").select("license_id", _flat(F.col("lines")).alias("plain"))
    rows = plain.where("plain <> ''").groupBy(_digest(F.col("plain")).alias("digest")).agg(F.min("license_id").alias("license_id"), F.max(_n_words(F.col("plain"))).alias("n_words"))
    return written(rows, "known-licenses")


def scanned(docs: DataFrame, known: Sequence[tuple[str, str]] | DataFrame = KNOWN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: key, digest, license_id (of the whole text), n_license_lines, line_licenses.

    Texts are read once and never move: what leaves the scan is a digest a row
    and those of its lines that have as many words as a known text.
    """
    digests = known_digests(docs.sparkSession, known)
    counts = [r["n_words"] for r in digests.select("n_words").distinct().collect()]
    if digests.count() <= BROADCAST_TEXTS:
        digests = F.broadcast(digests)
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    may = lambda line: _n_words(F.trim(line)).isin(counts) if counts else F.lit(False)
    lines = F.filter(F.transform(F.split("_lines", "\n"), lambda line, at: F.struct(at.alias("at"), F.when(may(line), F.sha2(F.trim(line), 256)).alias("digest"))), lambda x: x["digest"].isNotNull())
    rows = with_canonical(docs.select(F.col(key).alias("_key"), F.xxhash64(own).alias("_row"), own.alias("_lines")), "_lines")
    seen = written(rows.select("_key", "_row", _digest(_flat(F.col("_lines"))).alias("digest"), F.when(F.contains("_lines", F.lit("\n")) | may(F.col("_lines")), lines).alias("lines")), "license-scan")
    found = seen.select("_key", "_row", F.explode("lines").alias("line")).select(F.col("_key").alias("_its_key"), F.col("_row").alias("_its_row"), "line.at", "line.digest").join(digests, "digest")
    hits = found.groupBy("_its_key", "_its_row").agg(F.countDistinct("at").alias("n_license_lines"), F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("line_licenses"))
    whole = seen.drop("lines").join(digests, "digest", "left")
    out = whole.join(hits, F.col("_key").eqNullSafe(F.col("_its_key")) & (F.col("_row") == F.col("_its_row")), "left")
    return out.select(F.col("_key").alias(key), "digest", "license_id", F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"), "line_licenses")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def spelt(words: str) -> str:
        out = f"concat(' ', replace({words}, ' ', '  '), ' ')"
        for there, here in EQUIVALENT:
            out = f"replace({out}, {quoted(' ' + there.replace(' ', '  ') + ' ')}, {quoted(' ' + here.replace(' ', '  ') + ' ')})"
        return f"trim(replace({out}, '  ', ' '))"

    def steps(name: str, source: str, keys: str) -> str:
        names = f"((regexp_matches(x, {quoted(_COPYRIGHT)}) AND NOT regexp_matches(x, {quoted(_SENTENCE)})) OR regexp_matches(x, {quoted(_RESERVED)}))"
        low = f"lower(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT {names}), chr(10)))"
        bare = f"regexp_replace(regexp_replace({low}, {quoted(_ITEM)}, ' ', 'g'), {quoted(_PUNCTUATION)}, ' ', 'g')"
        return f"""
{name}_bare AS (SELECT {keys}, regexp_replace(trim({bare}), ' ?\n[ \n]*', ' ' || chr(10) || ' ', 'g') AS b FROM {source}),
{name}_lines AS (SELECT {keys}, {spelt('b')} AS c FROM {name}_bare),
{name}_flat AS (SELECT {keys}, c, trim(replace(replace(c, ' ' || chr(10) || ' ', ' '), chr(10), '')) AS f FROM {name}_lines),
{name} AS (SELECT {keys}, c, {spelt('f')} AS plain FROM {name}_flat)"""

    known = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)
    return f"""
WITH given(license_id, text) AS (VALUES {known}),
{steps('listed', 'given', 'license_id')},
known AS (SELECT sha256(plain) AS digest, min(license_id) AS license_id FROM listed WHERE plain <> '' GROUP BY 1),
{steps('whole', 'documents', 'doc_id')},
lines AS (SELECT doc_id, trim(unnest(string_split(c, chr(10)))) AS plain FROM whole),
hits AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses
  FROM lines JOIN known ON sha256(plain) = digest WHERE plain <> '' GROUP BY doc_id
), told AS (SELECT doc_id, CASE WHEN plain <> '' THEN sha256(plain) END AS digest FROM whole)
SELECT told.doc_id, told.digest, license_id, coalesce(n, 0) AS n_license_lines, line_licenses
FROM told LEFT JOIN known ON told.digest = known.digest LEFT JOIN hits ON told.doc_id = hits.doc_id
"""


QUERIES = {"op5_licenses": op5_licenses}
ORACLE_SQL = {"op5_licenses": _sql()}
