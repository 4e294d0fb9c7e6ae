"""License scans by canonical digest: texts that are a known licence or notice but for case, punctuation and the like.

A text is brought to canonical form: lower case, no copyright lines, equivalent spellings made equal, letters and
digits only, single spaces. The digest of the whole form is joined with those of the known texts. The same is done
with every line, since documents carry notices as lines of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatrends.llm.common import job, materialize

# Licence texts and the usual notices.
KNOWN = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This work is licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        "Licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License, Version 2.0",
        "This work is licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
}

# Spellings that count as equal; the first form becomes the second.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "unlicence": "unlicense", "sub license": "sublicense", "non commercial": "noncommercial", "non infringement": "noninfringement",
    "merchantibility": "merchantability", "copyright owner": "copyright holder", "organisation": "organization", "authorised": "authorized",
    "recognised": "recognized", "favour": "favor", "honour": "honor", "fulfil": "fulfill", "per cent": "percent", "acknowledgement": "acknowledgment",
    "judgement": "judgment", "modernise": "modernize", "https": "http", "v 2 0": "version 2 0", "v3": "version 3",
}

COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for a text of marks and copyright lines only."""
    form = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    # two spaces between words, so that each has one of its own on both sides
    form = F.concat(F.lit(" "), F.regexp_replace(form, PUNCTUATION, "  "), F.lit(" "))
    for old, new in SPELLINGS.items():
        form = F.replace(form, F.lit(_apart(old)), F.lit(_apart(new)))
    return F.trim(F.regexp_replace(form, " +", " "))


def _apart(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def known_digests(spark, known: dict[str, list[str]] = KNOWN) -> DataFrame:
    """``license`` and ``digest`` of the known texts: one row per text."""
    rows = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, texts in known.items() for text in texts]
    each = spark.range(1).select(F.explode(F.array(*rows)).alias("known"))
    return each.select("known.license", F.sha2(canonical(F.col("known.text")), 256).alias("digest")).distinct()


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """The licence of every row of ``docs`` whose whole text is a known one, and the notices that it carries as lines.

    ``id_col``, ``digest`` (of the whole canonical text), ``license`` (null if the text is none) and ``notices`` (the licences
    of its lines in order of name, comma-joined, empty if none). Texts that differ in canonical form are different. Null
    and empty texts are no licence. Repeated rows get the same result.
    """
    with job(docs.sparkSession) as scope:
        known = known_digests(docs.sparkSession) if known is None else known
        known = materialize(known.groupBy("digest").agg(F.min("license").alias("license")), "known_digests")
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
        lines = F.filter(F.array_distinct(F.transform(F.split("text", "\n"), canonical)), lambda line: line != "")
        scanned = rows.select("row", "id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.transform(lines, lambda x: F.sha2(x, 256)).alias("lines"))
        scanned = materialize(scanned, "digests")
        # the known digests are broadcast by Spark if they are few; else the digests are shuffled
        noted = scanned.select("row", F.explode("lines").alias("digest")).join(known, "digest")
        notices = noted.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
        whole = scanned.select("row", "id", "digest").join(known, "digest", "left")
        result = whole.join(notices, "row", "left").select(
            F.col("id").alias(id_col), "digest", "license", F.coalesce("notices", F.lit("")).alias("notices")
        )
        return scope.keep(materialize(result, "licenses"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_form(text: str) -> str:
    form = rf"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', chr(10), 'g')"
    form = rf"' ' || regexp_replace({form}, '{PUNCTUATION}', '  ', 'g') || ' '"
    for old, new in SPELLINGS.items():
        form = f"replace({form}, '{_apart(old)}', '{_apart(new)}')"
    return f"trim(regexp_replace({form}, ' +', ' ', 'g'))"


_KNOWN_SQL = ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, texts in KNOWN.items() for text in texts)

SQL = rf"""
WITH known AS (SELECT sha256({_sql_form('text')}) AS digest, min(license) AS license FROM (VALUES {_KNOWN_SQL}) AS k(license, text) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
forms AS (SELECT DISTINCT doc_id, {_sql_form('line')} AS form FROM lines),
noted AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM forms JOIN known ON known.digest = sha256(form) WHERE form <> '' GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({_sql_form("coalesce(text, '')")}) AS digest FROM documents)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices FROM whole LEFT JOIN known USING (digest) LEFT JOIN noted USING (doc_id)
"""
