"""Licence scans: canonical digests of whole texts and lines, looked up in SQL functions only."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_3_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE_END = "\n\nFor more information, please refer to <https://unlicense.org/>"

#: Known licences and notices (fixed values): name, text.
KNOWN: list[tuple[str, str]] = [
    ("MIT", MIT),
    ("MIT-0", MIT.replace(", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "")),
    ("ISC", ISC),
    ("ISC", ISC.replace("and/or distribute", "and distribute")),
    ("0BSD", ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("BSD-2-Clause", BSD_2 + WARRANTY_BSD),
    ("BSD-3-Clause", BSD_2 + BSD_3_CLAUSE + WARRANTY_BSD),
    ("BSL-1.0", BOOST),
    ("Zlib", ZLIB),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE + UNLICENSE_END),
    ("Apache-2.0", APACHE_NOTICE),
    ("GPL-3.0-or-later", GPL3_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "MIT-0", "ISC", "0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "Zlib", "Unlicense", "MPL-2.0", "CC0-1.0")),
    *((name, f"SPDX-License-Identifier: {name}{end}") for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("", "-only", "-or-later")),
]
#: Digests of the normal form of longer published texts, as ``digest_of`` gives them (fixed values): digest, name.
PUBLISHED: list[tuple[str, str]] = [
    ("40caab92ca091f360e5ea0629695fc54296cd158b2d536661d443793d1767909", "Apache-2.0"),
    ("a38d4339af3585e40533e847797921b895d0c5fec6a0c3d7f51cc5c78a9b133f", "Apache-2.0"),
    ("d17807891a60fd52336aca04c6557ce47f4a2c88a07aae4b8eab4b1ca65d82d0", "Apache-2.0"),
    ("8413e03a17537a3125d92631d8f2aa16de5dfd0a259bb970bc5af59dd429bda7", "GPL-1.0"),
    ("cfbe3bf03f7a266a4292f1334471296ecf0b2d2a4d7e8424c1e4bccf1cbe30e4", "GPL-2.0"),
    ("8af6a5c1083cf2aa340fb2e2826574c990637087e0e637498b7a45113dbc286e", "GPL-3.0"),
    ("51daf1902ea85b4b8fa54993d268e5faf3dd63b038a2eafe79d4901554bf5982", "LGPL-2.0"),
    ("2f7d91a8e8fffc2c28f1ce8706acc589fa0701bddfa5b30b347badb65c00e239", "LGPL-2.1"),
    ("cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45", "LGPL-3.0"),
    ("356542917be9959d1853554027ed0edc9b2625ae62badbd183279510113cba79", "MPL-1.1"),
    ("0807f218a9dba9a0f1cdf683f6fadac07d8dda25692df7fe506a62a76a0d019b", "MPL-2.0"),
    ("888ab175b43ed137ae3c3f8f32a1f0e1677fe31f7a9f09890c39b11b1934ad6c", "CC0-1.0"),
    ("3d9bf3a065f1080c628eb87c5968112a39cc0fd65a4ae365e7868e038270b9df", "GFDL-1.2"),
    ("35512239eaac2a4e5e03537d6d4b2209cc440033860fa8acc3e693b727a341d3", "GFDL-1.3"),
    ("4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651", "Artistic-1.0-Perl"),
    ("dbcca991b2c1fae85cf16705b74a9c2ba398b650695a5dca134e0bfcac508cc9", "GPL-2.0"),
    ("8cac72c4340f781ad4c72c9b7f746044f4ab2208f161d2737d173a98b124ae2e", "GPL-3.0"),
    ("e766808e5bbfb018cf2dfb2dfd98eb8386f16e9d15706e69229e1b4b330fb0be", "LGPL-2.1"),
    ("e52a3149c7976fdb64748aa7b95fb7e6462b42300129c03595db904f7214b54c", "MPL-2.0"),
]

#: Steps of the normal form: pattern, replacement.  Each means the same in Java, RE2 and Python.
STEPS: list[tuple[str, str]] = [
    # Lines that say who holds the copyright: with a year, a sign or a place for a name behind the word.
    (r"(?m)^[ \t#*/;%-]*(copyright[^\n]*([0-9]{4}|\(c\)|[©<{\[])|\(c\)[ \t]*(copyright|[0-9]{4}|[©<{\[])|©)[^\n]*$", ""),
    (r"(?m)^[ \t#*/;%-]*all rights reserved\.?[ \t]*$", ""),
    # Titles that stand alone in a line.
    (r"(?m)^[ \t#*/;%-]*(the )?(mit|isc|x11|expat|zlib|(new |modified |revised |simplified )?bsd( [023][ -]clause)?)( license| licence)( \([a-z0-9 ]+\))?:?[ \t]*$", ""),
    # Numbers of list items.
    (r"(?m)^[ \t#*/;%-]*\(?([0-9]{1,2}|[a-z])[.)][ \t]+", ""),
    (r"https?://(www\.)?", ""),
    (r"&", " and "),
    (r"[^a-z0-9\n]+", " "),
    (r" ?\n ?", "\n"),
]
#: Spellings that count as one, word by word, after the steps (fixed values).
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("acknowledgement", "acknowledgment"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("copyright holders", "copyright holder"),
    ("authors disclaim all", "author disclaims all"),
    ("the authors be liable", "the author be liable"),
    ("whilst", "while"),
    ("per cent", "percent"),
]
#: Those of several words, which line ends may part: once more for the whole text, lines joined.
OF_WORDS = [(old, new) for old, new in SPELLINGS if " " in old]
#: The same for a clause that names the holder.
HOLDER = (r"neither the names? of [a-z0-9 ]{1,200}? nor the names of (its|their|any) contributors", "neither the name of the copyright holder nor the names of its contributors")


def normal_text(text: str) -> str:
    """The normal form of a known text, as ``normal`` computes it for a column."""
    out = text.lower()
    for pattern, new in STEPS:
        out = re.sub(pattern, new, out)
    for old, new in SPELLINGS:
        out = out.replace(old, new)
    return out


def whole_text(normal: str) -> str:
    out = re.sub(r"[ \n]+", " ", normal).strip(" ")
    for old, new in OF_WORDS:
        out = out.replace(old, new)
    return re.sub(*HOLDER, out)


def digest_of(text: str) -> str:
    """The SHA-256 of a text's normal form, lines joined."""
    return hashlib.sha256(whole_text(normal_text(text)).encode()).hexdigest()


def digests(known: Sequence[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """(digest, licence) of the known texts, more (name, text) included; the first name wins."""
    found: dict[str, str] = {}
    for name, text in [*KNOWN, *known]:
        found.setdefault(digest_of(text), name)
    for digest, name in PUBLISHED:
        found.setdefault(digest, name)
    return sorted(found.items())


def normal(text: Column) -> Column:
    """Lower case; no copyright lines; punctuation as spaces; one spelling; lines kept apart."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, line_licenses, n_license_lines) for every document.

    license: the known licence that the whole text is, by a hash join of its canonical
    digest, else null.  line_licenses: known licences that single lines of it are, sorted
    and joined by commas (empty: none).  n_license_lines: how many lines are.  Known are
    the texts and digests of this module and the (name, text) of ``known``.  A null or
    empty text has no licence; repeated rows, and rows with a null id, return as often as
    given; an empty table gives none.  The known digests are a table of the size of what
    is given, some dozens of rows, which is sent to all tasks; no text moves.
    """
    found = digests(known)
    table = docs.sparkSession.createDataFrame(found, "digest string, license string")
    by_digest = F.create_map(*(F.lit(x) for pair in found for x in pair))
    lengths = sorted(len(whole_text(normal_text(t))) for _, t in [*KNOWN, *known])
    rows = documents(docs, id_col, text_col).select("doc_id", normal(F.col("text")).alias("normal"))
    joined = F.trim(F.regexp_replace("normal", "[ \n]+", " "))
    for old, new in OF_WORDS:
        joined = F.replace(joined, F.lit(old), F.lit(new))
    whole = F.when(joined.contains("neither the name"), F.regexp_replace(joined, *HOLDER)).otherwise(joined)
    lines = F.filter(F.split("normal", "\n"), lambda x: F.char_length(x).between(lengths[0], lengths[-1] + 2))
    of_lines = F.filter(F.transform(lines, lambda x: F.try_element_at(by_digest, F.sha2(F.trim(x), 256))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.sha2(whole, 256).alias("digest"), of_lines.alias("found"))
    out = rows.join(F.broadcast(table), "digest", "left")
    return out.select("doc_id", "license", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("line_licenses"), F.size("found").cast("long").alias("n_license_lines"))


def oracle_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The same scan for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    escape = lambda s: "e" + quote(s.replace("\\", "\\\\").replace("\n", "\\n"))
    out = f"lower(coalesce({text_col}, ''))"
    for pattern, new in STEPS:
        out = f"regexp_replace({out}, {escape(pattern)}, {escape(new)}, 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {quote(old)}, {quote(new)})"
    joined = "trim(regexp_replace(normal, '[ \\n]+', ' ', 'g'), ' ')"
    for old, new in OF_WORDS:
        joined = f"replace({joined}, {quote(old)}, {quote(new)})"
    values = ", ".join(f"({quote(d)}, {quote(n)})" for d, n in digests())
    return f"""
    WITH known(digest, license) AS (VALUES {values}),
    lookup AS (SELECT map(list(digest), list(license)) AS m FROM known),
    rows AS (SELECT {id_col} AS doc_id, {out} AS normal FROM {table}),
    found AS (SELECT doc_id, sha256(regexp_replace({joined}, {escape(HOLDER[0])}, {escape(HOLDER[1])}, 'g')) AS digest,
        list_filter(list_transform(string_split(normal, chr(10)), lambda x: m[sha256(trim(x, ' '))]), lambda x: x IS NOT NULL) AS found
        FROM rows, lookup)
    SELECT doc_id, license, array_to_string(list_sort(list_distinct(found)), ',') AS line_licenses, CAST(len(found) AS BIGINT) AS n_license_lines
    FROM found LEFT JOIN known USING (digest)"""
