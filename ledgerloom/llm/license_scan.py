"""License scan by canonical digest lookup, in DataFrame operations only.

A unit (a whole text, or one whole line of it) is brought to a canonical form:
A-Z lower-cased, copyright lines and list markers dropped, punctuation turned
into single spaces, spellings that the licence matching guidelines hold equal
replaced by one of them.  The SHA-256 of that form is joined by equality with
the digests of the known licence texts and notices.  Nothing fuzzy: a unit
matches when all of it is a known text.

Known are the notices and short texts of ``KNOWN`` and ``BODIES``, the latter
with and without their title, and the full texts whose digests are in ``FULL``.
These digests are a fixed table (tens of rows), so the join broadcasts it.  Each
known canonical form holds one of ``MARKS``; a unit without any of these cannot
match and is not normalised.

Copyright lines are those that begin with a copyright sign, or with the word
before a sign, a year or a placeholder; others may be wrapped text of a licence.

Defined cases: null and empty texts match nothing (digest null); a text that
matches as a whole reports its lines too; repeated rows each get a row; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, UPPER, ascii_lower, column, free, fresh, total

#: The short notices and the permissive licence texts known, copyright lines left out.
KNOWN: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released under the CC0 1.0 Universal license."),
)
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Short licences in full, (id, titles, body); each is known with any of its titles and without.
BODIES: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("MIT", ("MIT License", "The MIT License (MIT)", "The MIT License"), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", ("ISC License", "The ISC License", "ISC License (ISC)"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License"), _BSD + _AS_IS),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License"), _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _AS_IS),
    ("Zlib", ("zlib License", "The zlib/libpng License"), "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003",), "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", ("The Unlicense",), "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"),
)
#: Digests of the canonical forms of longer licences' full texts.
FULL: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "d02c7f302cb1e70c031e65725b26bc56e7c827c3f55bad590c1ced231bbb72a0"),
    ("Apache-2.0", "8fc9d71407306a5fbad2e0865b5702aa768fdc96dd35c976acc15e77c1be3e88"),  # without what follows the terms
    ("Apache-2.0", "f5baf41519167f464a3e4499534eb0100ca5b5a99157e0676db6e944bd653759"),
    ("Artistic-1.0-Perl", "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49"),
    ("CC0-1.0", "888ab175b43ed137ae3c3f8f32a1f0e1677fe31f7a9f09890c39b11b1934ad6c"),
    ("GFDL-1.2-only", "7bd3a9b625b0b9c72d575e34948a31aa1d9a92600e54323c0abd84a9844ce82d"),
    ("GFDL-1.3-only", "3e03599855be6f5154c1bba1c4189768a3518f5863527559438fa78fa2262af5"),
    ("GPL-1.0-only", "a1e281b5860906ac34adfc687178ad5a5f7f109db71be06b6210e78006f1cd99"),
    ("GPL-2.0-only", "27982b3e1c5613b5cdffed315a24943be9bbb1f93b8a21b3cf300d3b117e1a88"),
    ("GPL-3.0-only", "d5fce40843af1beaf5d0bd33c7d02608e173b680744665921cdbb9ffc22680f0"),
    ("LGPL-2.0-only", "eb59a5d2d6fb2b314cc4385c9b40bd3e2dd8cfb8f1c07709dc7c436380c98765"),
    ("LGPL-2.1-only", "79768c87bd162e294ed85c054cac2c7cada9f731db4aada7fd50c6e9d636bd15"),
    ("LGPL-3.0-only", "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45"),
    ("MPL-1.1", "05e230fb3903daa7bacb63df4e9f5d53481cc06aceb4e8eb1e071083eb69798a"),
    ("MPL-2.0", "2679d8adefa007797fdba64dfa8f0dc1d11981245c546ba2d9c2b2ea7341fd3e"),
)
#: Spellings held equal, each pair (seen, kept); both in canonical form.
EQUIVALENT: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("merchantability or fitness", "merchantability and fitness"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("offence", "offense"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("per cent", "percent"),
    ("https", "http"),
)
#: Each known form holds one of these.
MARKS = ("licen", "warrant")
#: Lines that are a copyright statement and no more, and the marks of list items.
_COPYRIGHT = r"(^|\n)[ \t/*#;-]*((copyright[ \t:]+)?(\(c\)|©)|copyright[ \t:]+[0-9<\[{]|all rights reserved)[^\n]*"
_ITEM = r"(^|\n)[ \t/*#;-]*(([0-9]{1,2}|[a-z])[.)]|\([a-z0-9]{1,2}\))[ \t]"
_NOISE = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f‘’“”–—]+"


def canonical(text: str) -> str:
    """The canonical form in Python, of the known texts."""
    text = text.translate(str.maketrans(UPPER, LOWER))
    text = re.sub(_NOISE, " ", re.sub(_ITEM, "\n", re.sub(_COPYRIGHT, "\n", text)))
    text = f" {text.strip(' ')} "
    for seen, kept in EQUIVALENT:
        text = text.replace(f" {seen} ", f" {kept} ")
    return text.strip(" ")


def canonical_column(text: Column) -> Column:
    """``canonical`` as an expression."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(ascii_lower(text), _COPYRIGHT, "\n"), _ITEM, "\n"), _NOISE, " ")
    text = F.concat(F.lit(" "), F.trim(text), F.lit(" "))
    for seen, kept in EQUIVALENT:
        text = F.replace(text, F.lit(f" {seen} "), F.lit(f" {kept} "))
    return F.trim(text)


def texts() -> list[tuple[str, str]]:
    """(license_id, text) of the texts that stand here."""
    return [*KNOWN, *((name, t) for name, titles, body in BODIES for t in (body, *(f"{title}\n\n{body}" for title in titles)))]


def known() -> list[tuple[str, str]]:
    """(license_id, digest) of the known texts."""
    return sorted({*FULL, *((name, hashlib.sha256(canonical(text).encode()).hexdigest()) for name, text in texts())})


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with license_digest (of the whole text), license_id (of the whole text, or null) and line_licenses (sorted distinct ids of whole lines).

    A column that docs has by such a name stays, and the new one gets another name (``fresh``).
    """
    digest, name, listed = (free(docs, n) for n in ("license_digest", "license_id", "line_licenses"))
    (key,) = fresh(docs, "key")
    digests = docs.sparkSession.createDataFrame(known(), f"{name} string, {key} string")
    # the table is fixed and small: as a map literal it needs no join by line, and the whole text is hash-joined
    by_digest = F.create_map(*[F.lit(x) for license_id, known_digest in known() for x in (known_digest, license_id)])
    body = column(text)
    marked = lambda x: total([F.translate(x, UPPER, LOWER).contains(m).cast("int") for m in MARKS]) > 0
    lines = F.filter(F.split(body, "\n", -1), marked)
    found = F.transform(lines, lambda x: F.try_element_at(by_digest, F.sha2(canonical_column(x), 256)))
    whole = F.when(marked(body), F.sha2(canonical_column(body), 256))
    ids = F.when(marked(body), F.array_sort(F.array_distinct(F.array_compact(found)))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn(digest, whole).withColumn(listed, ids)
    return out.join(F.broadcast(digests), F.col(digest) == F.col(key), "left").drop(key)


def _sql_canonical(text: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    sql = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), {q(_COPYRIGHT)}, chr(10), 'g')"
    sql = f"regexp_replace(regexp_replace({sql}, {q(_ITEM)}, chr(10), 'g'), {q(_NOISE)}, ' ', 'g')"
    sql = f"(' ' || trim({sql}, ' ') || ' ')"
    for seen, kept in EQUIVALENT:
        sql = f"replace({sql}, {q(f' {seen} ')}, {q(f' {kept} ')})"
    return f"trim({sql}, ' ')"


def oracle() -> str:
    rows = ", ".join(f"('{name}', '{digest}')" for name, digest in known())
    marked = lambda x: " OR ".join(f"contains(translate({x}, '{UPPER}', '{LOWER}'), '{m}')" for m in MARKS)
    return f"""
WITH known(license_id, digest) AS (VALUES {rows}),
marked AS (
  SELECT doc_id, text FROM documents WHERE {marked("text")}
),
whole AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS license_digest FROM marked),
lines AS (
  SELECT DISTINCT doc_id, k.license_id
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM marked) m
  JOIN known k ON k.digest = sha256({_sql_canonical("line")}) WHERE {marked("line")}
),
listed AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS line_licenses FROM lines GROUP BY doc_id)
SELECT d.doc_id, w.license_digest, k.license_id, coalesce(l.line_licenses, '') AS line_licenses
FROM documents d LEFT JOIN whole w USING (doc_id)
LEFT JOIN known k ON k.digest = w.license_digest LEFT JOIN listed l USING (doc_id)
"""
