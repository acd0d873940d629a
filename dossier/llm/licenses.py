"""License scans by canonical digest lookup.

A text is brought to a canonical form (lower case, copyright lines out, punctuation to single spaces, equivalent
spellings to one) and hashed. Whole texts and, so that notices inside a document are found too, each of their lines and
of their paragraphs of several lines are looked up by one hash join with the digests of known licence texts and notices. The known side is small and its size is
checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.storage import broadcast_if_small, read_table

#: Spellings that licence matching guidelines hold equal, British and other forms to one.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("centre", "center"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("modelled", "modeled"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("percent", "per cent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.\n\n"
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission.\n\n"
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
    "restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
    "the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
    "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity "
    "of all present and future rights to this software under copyright law.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
    "For more information, please refer to <https://unlicense.org/>"
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n\n"
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
    "\"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
    "Software is furnished to do so, all subject to the following:\n\n"
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies "
    "of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
    "generated by a source language processor.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
    "You may obtain a copy of the License at"
)
_MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
    "{}://mozilla.org/MPL/2.0/."
)
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version 3 of the "
    "License, or (at your option) any later version."
)
#: Full texts and notices, each with the SPDX identifier it stands for. Longer licences (Apache-2.0, GPL, LGPL, MPL
#: in full) come by a table of the same two columns, which ``scan`` takes.
KNOWN_TEXTS = (
    ("MIT", "MIT License\n" + _MIT_GRANT),
    ("MIT", _MIT_GRANT),
    ("ISC", "ISC License\n" + _ISC_GRANT + "\n" + _ISC_WARRANTY),
    ("ISC", _ISC_GRANT + "\n" + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_START + _BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_START + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_START + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_START + _BSD_NAMES + _BSD_WARRANTY),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("Apache-2.0", _APACHE_HEADER),
    ("MPL-2.0", _MPL_HEADER.format("http")),
    ("MPL-2.0", _MPL_HEADER.format("https")),
    ("GPL-3.0-or-later", _GNU_HEADER.format("General Public License")),
    ("LGPL-3.0-or-later", _GNU_HEADER.format("Lesser General Public License")),
    ("AGPL-3.0-or-later", _GNU_HEADER.format("Affero General Public License")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(?m)^[^\n]{0,20}(copyright|\(c\)|©)[^\n]*(19|20)[0-9][0-9][^\n]*$|^[^\n]{0,20}all rights reserved\.?[\x20\r]*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical_lines(text: Column) -> Column:
    """The lines of a text in lower case (A-Z only), without copyright lines, words one space apart; empty ones stay.

    A copyright line has a copyright sign or word within its first 20 characters and names a year.
    """

    def line(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(x, COPYRIGHT_LINE, ""), PUNCTUATION, " "))

    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n"), line)


def one_spelling(form: Column, spellings: tuple[tuple[str, str], ...] = SPELLINGS) -> Column:
    """A canonical form, with a space around it, in which equivalent spellings are one; null for a form of no words.

    Spaces are doubled first, so that every word has its own and two old spellings side by side are both replaced.
    """
    found = F.replace(form, F.lit(" "), F.lit("  "))
    for old, new in spellings:
        found = F.replace(found, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    any_old = r"\x20(?:" + "|".join(old for old, _ in spellings) + r")\x20"
    return F.when(form.rlike(any_old), F.replace(found, F.lit("  "), F.lit(" "))).when(form != "  ", form)


def paragraphs_of(lines: Column) -> Column:
    """The forms of a text's paragraphs: of its canonical ``lines`` those of several with no empty one between."""
    joined = F.array_join(F.transform(lines, lambda x: F.when(x == "", F.lit("\n\n")).otherwise(x)), "\n")
    several = F.filter(F.transform(F.split(joined, r"\n{2,}"), lambda p: F.trim(p, F.lit("\n"))), lambda p: F.instr(p, "\n") > 0)
    return F.transform(several, lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))


def with_digests(df: DataFrame, text: str) -> DataFrame:
    """One row for a text (at = 0), each of its lines and each of its paragraphs of several lines (at from 1), with
    ``digest``: the SHA-256 of the canonical form, null if there are no words. The whole text and its paragraphs are
    its lines' forms joined, so every text is worked over once."""
    rest = [c for c in df.columns if c != text]
    lines = df.select(*rest, canonical_lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    whole = F.array_join(F.filter("lines", lambda x: x != ""), " ")
    parts = lines.select(*rest, F.posexplode(F.concat(F.array(whole), F.col("lines"), paragraphs_of(F.col("lines")))).alias("at", "part"))
    forms = parts.select(*rest, "at", one_spelling(F.concat(F.lit(" "), "part", F.lit(" "))).alias("form"))
    return forms.select(*rest, "at", F.sha2("form", 256).alias("digest"))


def known_digests(known: DataFrame) -> DataFrame:
    """Rows (digest, license) of ``known`` (license, text); texts without words go, of equal ones the first license stays."""
    return with_digests(known.select("license", "text"), "text").filter("at = 0 AND digest IS NOT NULL AND license IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license"))


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN_TEXTS), "license string, text string")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_digest, license, notices, n_notices), one for each row of ``docs``, repeated rows included.

    ``license`` is that of the whole text, null if it is not known; ``notices`` are the licences that any of its lines,
    or of its paragraphs of several lines, is the text of, sorted, distinct and comma-joined, and ``n_notices`` is the
    number of such lines and paragraphs. Null texts and texts without words have a null digest and no licence; of known
    texts that are equal the first licence by name is told. An empty table gives no rows; a very long text has one row
    for each of its lines while it is looked up. Other columns are not read.
    """
    digests = broadcast_if_small(known_digests(known))
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    looked = with_digests(plain, "text").join(digests, "digest", "left")
    whole, line = F.col("at") == 0, (F.col("at") > 0) & F.col("license").isNotNull()
    found = looked.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(whole, F.col("digest"))).alias("text_digest"),
        F.max(F.when(whole, F.col("license"))).alias("license"),
        F.collect_set(F.when(line, F.col("license"))).alias("named"),
        F.count_if(line).alias("n_notices"),
    )
    return found.select("doc_id", "text_digest", "license", F.array_join(F.sort_array("named"), ",").alias("notices"), "n_notices")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"), built_in(spark))


def _sql_canonical(column: str) -> str:
    found = f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"
    found = f"regexp_replace({found}, '{COPYRIGHT_LINE}', '', 'g')"
    found = f"regexp_replace(' ' || {found} || ' ', '{PUNCTUATION}', ' ', 'g')"
    found = f"replace({found}, ' ', '  ')"
    for old, new in SPELLINGS:
        found = f"replace({found}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"replace({found}, '  ', ' ')"


def sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN_TEXTS)
    return f"""
WITH known AS (SELECT sha256({_sql_canonical("text")}) AS digest, min(license) AS license FROM (VALUES {values}) AS k(license, text) GROUP BY 1),
plain AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
whole AS (SELECT r, doc_id, {_sql_canonical("text")} AS form FROM plain),
lines AS (SELECT r, {_sql_canonical("line")} AS form FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM plain)),
numbered AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM plain),
marked AS (SELECT r, n, line, trim({_sql_canonical("line")}) = '' AS blank FROM numbered),
runs AS (SELECT r, n, line, blank, sum(blank::INT) OVER (PARTITION BY r ORDER BY n) AS g FROM marked),
paragraphs AS (SELECT r, {_sql_canonical("body")} AS form FROM (SELECT r, string_agg({_sql_canonical("line")}, ' ' ORDER BY n) AS body FROM runs WHERE NOT blank GROUP BY r, g HAVING count(*) > 1)),
parts AS (SELECT r, form FROM lines UNION ALL SELECT r, form FROM paragraphs),
named AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n FROM parts JOIN known ON sha256(form) = digest WHERE trim(form) <> '' GROUP BY r)
SELECT doc_id, CASE WHEN trim(form) <> '' THEN sha256(form) END AS text_digest, CASE WHEN trim(form) <> '' THEN license END AS license,
       coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notices
FROM whole LEFT JOIN known ON sha256(form) = digest LEFT JOIN named USING (r)
"""
