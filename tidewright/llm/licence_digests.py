"""Licence scans by canonical digest: whole texts, lines and runs of lines, normalised, are hash-joined to the digests of known licences.

Normalising lower-cases, drops copyright lines, brings equivalent spellings to one form and leaves words only. The register is
a few texts and is broadcast after its size is checked; documents are not shuffled. A text, line or run of lines is hashed only
where it starts with the first words of a known text and is as long as that text.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices by SPDX name.
LICENCES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
]
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT %s OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_GPL = """This program is free software%s you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License as published by the Free Software Foundation, either version %s of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU %sGeneral Public License for more details."""
_SPDX = ["MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"]
_NAMES = [("MIT", "MIT License"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache 2.0 License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License 2.0"), ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-3.0", "GNU General Public License v3.0"), ("LGPL-3.0", "GNU Lesser General Public License v3.0"), ("AGPL-3.0", "GNU Affero General Public License v3.0")]
# Further headers and texts, with those of ``licences/``; LICENCES is what the query's SQL has.
FURTHER = [
    ("BSD-2-Clause", _BSD % ("", "HOLDER")), ("BSD-2-Clause", _BSD % ("", "OWNER")),
    ("BSD-3-Clause", _BSD % (_THIRD, "HOLDER")), ("BSD-3-Clause", _BSD % (_THIRD, "OWNER")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *[(f"{kind}GPL-{v}.0", _GPL % (":", name, v, name)) for kind, name in (("", ""), ("L", "Lesser "), ("A", "Affero ")) for v in ("2", "3") if v == "3" or not kind],
    *[(i, f"SPDX-License-Identifier: {i}") for i in _SPDX],
    *[(i, f"This {what} is {how} under the {name}") for i, name in _NAMES for what in ("project", "software", "code", "work", "file") for how in ("licensed", "released")],
    *[(i, f"{how} under the {name}") for i, name in _NAMES for how in ("Licensed", "Released", "Distributed")],
]
HEAD = 3  # words by which a start is looked up
# Equivalent spellings.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("organisation", "organization"), ("authoris", "authoriz"), ("owner", "holder"), ("&", " and "), ("“", '"'), ("”", '"')]
# A copyright line is one that starts with the word or its mark, and then has a mark, a year, a bracket or a name; a sentence that was
# wrapped before "copyright holder", and an item "(c) You must ...", are none. Comment marks may stand before it.
NO_NAMES = ["License", "Licence", "Law", "Holder", "Owner", "Notice", "Act", "Treaty"]  # that follow "Copyright" in titles
COPYRIGHT = (
    r"(?m)^[^A-Za-z0-9©(\n]*((?i:copyright)[ \t:]*(\([cC]\)|©|[0-9]{4}|[\[<{])|Copyright[ \t]+(by[ \t]+)?[A-Z]|\([cC]\)[ \t]*([0-9]{4}|[\[<{]|(?i:copyright))|©)[^\n]*$"
    r"|^[^A-Za-z0-9\n]*(?i:all rights reserved)\.?[ \t]*$"
)
NO_WORD = r"[^a-z0-9\n]+"
MOST_LICENCES = 100_000  # broadcast up to so many


def canonical(text: Column) -> Column:
    """Words of the text, line by line, in canonical form."""
    out = F.replace(text, F.lit("\r"), F.lit(""))
    for name in NO_NAMES:
        out = F.replace(out, F.lit(f"Copyright {name}"), F.lit(f"copyright {name}"))
    out = F.lower(F.regexp_replace(out, COPYRIGHT, ""))
    for before, after in SPELLINGS:
        out = F.replace(out, F.lit(before), F.lit(after))
    return F.regexp_replace(out, NO_WORD, " ")


def known() -> list[tuple[str, str]]:
    """All registered (license_id, text)."""
    texts = sorted((Path(__file__).parent / "licences").glob("*.txt"))
    return LICENCES + FURTHER + [(f.stem, f.read_text("utf-8")) for f in texts]


def register(spark: SparkSession, licences=None) -> DataFrame:
    """(license_id, digest, head, n_words) of licence texts, one row a digest; head is the text's first words."""
    rows = spark.createDataFrame(known() if licences is None else licences, "license_id string, text string")
    told = rows.select("license_id", F.trim(F.regexp_replace(canonical(F.col("text")), "[ \n]+", " ")).alias("body")).filter("body <> ''")
    told = told.select("license_id", F.md5("body").alias("digest"), F.split("body", " ").alias("w"))
    told = told.select("license_id", "digest", F.array_join(F.slice("w", 1, HEAD), " ").alias("head"), F.size("w").alias("n_words"))
    return told.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("head").alias("head"), F.min("n_words").alias("n_words"))


def _units(sizes: dict[tuple, set]):
    """(doc_id, line, digest) of whole texts, lines and runs of lines that start like a known text and are as long."""
    widths = sorted({len(h) for h in sizes}, reverse=True)
    firsts = {h[0] for h in sizes}

    def run(batches):
        for batch in batches:
            out = []
            for doc, canon in zip(*(c.to_pylist() for c in batch.columns)):
                lines = canon.split("\n")
                if not any(x.split(None, 1)[0] in firsts for x in lines if x and not x.isspace()):
                    continue
                words, at, ends = [], [], set()
                for line, text in enumerate(lines, 1):
                    w = text.split()
                    if w:
                        at.append((line, len(words), len(w)))
                        words += w
                        ends.add(len(words))
                for line, start, n in at:
                    if words[start] not in firsts:
                        continue
                    for size in {k for width in widths for k in sizes.get(tuple(words[start : start + width]), ())}:
                        if start + size in ends:
                            digest = hashlib.md5(" ".join(words[start : start + size]).encode()).hexdigest()
                            if size == len(words):
                                out.append((doc, 0, digest))
                            if size == n or size < len(words):
                                out.append((doc, line, digest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string()])], ["doc_id", "line", "digest"])

    return run


def licence_scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """(doc_id, line, license_id, digest) of each text (line 0), line (from 1) or run of lines (its first) that is a known licence, all of it.

    ``licences`` is what ``register`` gives, at most ``MOST_LICENCES`` of them (more raise ValueError): they are broadcast, with their first words.
    Blank and copyright lines inside a run do not count, so that any wrapping of a text is found that leaves its own copyright lines alone and starts no line with such a notice inside a sentence. Lines count from 1 in the text as it is.
    Null, blank or wordless texts and lines match nothing. A text of one line is reported as text and as line. Repeated rows are reported for
    each, a null doc_id with null; an empty table gives an empty result; other columns are ignored.
    """
    if licences.count() > MOST_LICENCES:
        raise ValueError(f"more than {MOST_LICENCES} licences")
    sizes: dict[tuple, set] = {}
    for head, n in licences.select("head", "n_words").distinct().collect():
        sizes.setdefault(tuple(head.split(" ")), set()).add(n)
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text")).alias("canon")).filter("canon is not null")
    units = told.mapInArrow(_units(sizes), "doc_id long, line long, digest string")
    return units.join(F.broadcast(licences.select("digest", "license_id")), "digest").select("doc_id", "line", "license_id", "digest")
