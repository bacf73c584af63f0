"""Licence scan by canonical digests, in DataFrame functions alone.

Texts are normalised by case, punctuation, copyright lines and equivalent spellings, and the digests of whole units (the
text, its paragraphs and its lines) are joined to the digests of known licence texts.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST = 100_000

# Equivalent spellings, in the order of their application to lower-case text.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"), ("organisation", "organization"), ("authorisation", "authorization"), ("favour", "favor"), ("fulfil ", "fulfill "),
    ("judgement", "judgment"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("whilst", "while"), ("wilful", "willful"), ("https://", "http://"),
)

# Licence texts and notices, by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
LICENSES = (
    ("MIT", _MIT), ("MIT", "The MIT License\n\n" + _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_WARRANTY),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
)

# Redistribution terms of the BSD family, whose holder is named in some versions.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ITEMS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of {owner} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT {holders} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {holder} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _bsd() -> list[tuple[str, str]]:
    out = []
    for items, name in ((2, "BSD-2-Clause"), (3, "BSD-3-Clause")):
        for owner in ("the copyright holder", "the copyright holders", "the author", "the organization", "the University")[: 1 if items == 2 else None]:
            for mark in ("{}. ", "* ", "") if items == 2 else ("{}. ", "* "):
                for holders, holder in (("HOLDERS", "HOLDER"), ("HOLDERS", "OWNER"), ("HOLDERS", "HOLDERS")):
                    terms = [mark.format(i + 1) + x.format(owner=owner) for i, x in enumerate(_BSD_ITEMS[:items])]
                    body = "\n\n".join([_BSD_HEAD, *terms, _BSD_WARRANTY.format(holders=holders, holder=holder)])
                    out += [(name, start + body) for start in ("", "All rights reserved.\n\n", f"BSD {items}-Clause License\n\n", f"BSD {items}-Clause License\n\nAll rights reserved.\n\n")]
    return out


# Whole texts beside this module, by SPDX identifier; each also without its appendix on how to apply it.
_FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2-only", "GFDL-1.3": "GFDL-1.3-only", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only",
    "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
_END = "END OF TERMS AND CONDITIONS"


def _files() -> list[tuple[str, str]]:
    out = []
    for file, name in _FILES.items():
        text = (Path(__file__).parent / "licenses" / f"{file}.txt").read_text()
        out.append((name, text))
        if _END in text:
            terms = text[: text.index(_END)]
            out += [(name, terms), (name, terms + _END)]
    return out


def _names() -> list[tuple[str, str]]:
    """How notices call the licences, by family and version."""
    out = [(i, n) for i, names in (("MIT", ("the MIT License", "MIT", "MIT License", "the MIT")), ("ISC", ("the ISC License", "ISC")), ("0BSD", ("the Zero-Clause BSD License", "0BSD")), ("Zlib", ("the zlib License", "zlib"))) for n in names]
    families = (
        ("Apache", ("Apache License", "Apache"), {"2.0": "Apache-2.0"}), ("MPL", ("Mozilla Public License", "MPL"), {"1.1": "MPL-1.1", "2.0": "MPL-2.0"}),
        ("GPL", ("GNU General Public License", "GNU GPL", "GPL"), {"1": "GPL-1.0-only", "2": "GPL-2.0-only", "3": "GPL-3.0-only"}),
        ("LGPL", ("GNU Lesser General Public License", "GNU LGPL", "LGPL"), {"2.1": "LGPL-2.1-only", "3": "LGPL-3.0-only"}),
        ("AGPL", ("GNU Affero General Public License", "GNU AGPL", "AGPL"), {"3": "AGPL-3.0-only"}), ("GFDL", ("GNU Free Documentation License", "GFDL"), {"1.2": "GFDL-1.2-only", "1.3": "GFDL-1.3-only"}),
    )
    for _, names, versions in families:
        for number, name in versions.items():
            for full in {number, number if "." in number else number + ".0"}:
                out += [(name, f"{the}{n}{by}{full}") for n in names for by in (", version ", " version ", " v", ", v", " ") for the in ("the ", "")]
                out += [(name, f"the {n} {full} License") for n in names if not n.endswith("License")]
    for items in ("2", "3"):
        out += [(f"BSD-{items}-Clause", n) for n in (f"the BSD {items}-Clause License", f"the {items}-Clause BSD License", f"BSD {items}-Clause")]
    words = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        long = "-".join(words[w] for w in kind.split("-"))
        for number, more in (("3.0", "Unported"), ("4.0", "International")):
            base = (f"CC {kind} {number}", f"Creative Commons {long} {number}", f"Creative Commons {long} {number} {more}")
            out += [(f"CC-{kind}-{number}", n) for b in base for n in (b, f"the {b} License", f"a {b} License")]
    return out + [("CC0-1.0", n) for n in ("CC0 1.0", "CC0 1.0 Universal", "CC0", "Creative Commons Zero 1.0")] + [("Unlicense", "the Unlicense")]


_PHRASES = tuple(f"{start}{verb} under " for start in ("", "This work is ", "This project is ", "This software is ", "This program is ", "This file is ", "This code is ") for verb in ("licensed", "released", "distributed"))
LICENSES += tuple(_bsd() + _files() + [(i, f"{phrase}{name}.") for i, name in _names() for phrase in _PHRASES])
_TAGS = sorted({i for i, _ in LICENSES} | {f"{f}-{v}-or-later" for f, vs in (("GPL", ("1.0", "2.0", "3.0")), ("LGPL", ("2.0", "2.1", "3.0")), ("AGPL", ("3.0",))) for v in vs})
LICENSES += tuple((i, f"SPDX-License-Identifier: {i}") for i in _TAGS)

_COPYRIGHT = "(?m)^[^a-z0-9\\n]*(copyright|\\(c\\)|©)( .*)?$"
_PUNCTUATION = "[!-/:-@\\[-`{-~]+"  # of ASCII
_BLANKS = "[ \\t\\x0b\\x0c\\r]+"


def canonical(text: Column) -> Column:
    """The text in lower case without copyright lines, spellings unified, punctuation and blanks as single spaces, line
    breaks kept, no spaces beside them. A copyright line starts with that word or sign, after punctuation at most."""
    out = F.replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit("\r\n"), F.lit("\n"))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, _COPYRIGHT, "")
    out = F.regexp_replace(out, _PUNCTUATION, " ")
    out = F.regexp_replace(out, _BLANKS, " ")
    return F.regexp_replace(out, "(?m)^ | $", "")


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\n]+", " "))


def units(docs: DataFrame) -> DataFrame:
    """``(doc_id, unit, number, content)``: each line that is not blank, each paragraph of several lines and each text of several paragraphs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", F.split("norm", "\\n").alias("lines"), F.split(F.regexp_replace("norm", "^\\n+|\\n+$", ""), "\\n\\n+").alias("paragraphs"))
    unit = lambda kind, n, content: F.struct(F.lit(kind).alias("unit"), n.cast("int").alias("number"), content.alias("content"))
    lines = F.transform("lines", lambda x, i: unit("line", i, x))
    paragraphs = F.transform("paragraphs", lambda x, i: unit("paragraph", i, F.when(F.contains(x, F.lit("\n")), F.replace(x, F.lit("\n"), F.lit(" "))).otherwise("")))
    whole = F.when(F.size("paragraphs") > 1, F.array(unit("text", F.lit(0), F.array_join("paragraphs", " ")))).otherwise(F.array().cast("array<struct<unit:string,number:int,content:string>>"))
    return rows.select("doc_id", F.inline(F.concat(lines, paragraphs, whole))).withColumn("content", F.replace("content", F.lit("\n"), F.lit(" "))).filter("content <> ''")


def known_digests(spark: SparkSession, licenses: DataFrame | None = None) -> DataFrame:
    """``(license_id, digest, chars)`` of known licences; ``licenses(license_id, text)`` replaces the built-in ones."""
    texts = licenses if licenses is not None else spark.createDataFrame(list(LICENSES), "license_id string, text string")
    flat = texts.select("license_id", _flat(canonical(F.col("text"))).alias("content")).filter("content <> ''")
    return flat.select("license_id", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), F.octet_length("content").alias("bytes")).distinct()


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """``(doc_id, unit, number, license_id, digest)`` for each unit of a text that is a known licence.

    ``number`` counts the lines or paragraphs of the canonical text from 0. A unit that belongs to several licences gives a
    row for each. Null and empty texts give none; rows with null or repeated doc_ids are scanned like others; other
    columns are not read. Only units as long as some known text are hashed, which loses no match.
    """
    known = known_digests(docs.sparkSession, licenses)
    count = known.count()
    lengths = known.agg(F.sort_array(F.collect_set("bytes"))).first()[0] if count <= MAX_BROADCAST else None
    found = units(docs)
    if lengths is not None:
        found, known = found.filter(F.octet_length("content").isin(lengths or [0])), F.broadcast(known)
    found = found.withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    return found.join(known, "digest").select("doc_id", "unit", "number", "license_id", "digest")


def scan_sql() -> str:
    """DuckDB SQL with the same rows for table ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    breaks = "chr(10)"
    expression = f"replace(lower(coalesce(text, '')), chr(13) || {breaks}, {breaks})"
    for old, new in SPELLINGS:
        expression = f"replace({expression}, {quote(old)}, {quote(new)})"
    for pattern, new in ((_COPYRIGHT, ""), (_PUNCTUATION, " "), (_BLANKS, " "), ("(?m)^ | $", "")):
        expression = f"regexp_replace({expression}, {quote(pattern)}, {quote(new)}, 'g')"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in LICENSES)
    return f"""
WITH known AS (SELECT DISTINCT license_id, sha256(trim(regexp_replace({expression}, '[ \\n]+', ' ', 'g'))) AS digest FROM (VALUES {values}) t(license_id, text)),
norm AS (SELECT doc_id, {expression} AS norm FROM documents),
parts AS (SELECT doc_id, string_split(norm, {breaks}) AS lines, regexp_split_to_array(regexp_replace(norm, '^\\n+|\\n+$', '', 'g'), '\\n\\n+') AS paragraphs FROM norm),
units AS (
    SELECT doc_id, 'line' AS unit, unnest(range(len(lines)))::INT AS number, unnest(lines) AS content FROM parts
    UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(paragraphs)))::INT, unnest(paragraphs) AS content FROM parts) WHERE contains(content, {breaks})
    UNION ALL SELECT doc_id, 'text', 0, array_to_string(paragraphs, ' ') FROM parts WHERE len(paragraphs) > 1)
SELECT doc_id, unit, number, license_id, digest FROM (SELECT doc_id, unit, number, sha256(replace(content, {breaks}, ' ')) AS digest FROM units WHERE content <> '') JOIN known USING (digest)"""
