"""License scan: canonical digests of entire texts, hash-joined to those of known licences.

A text is canonical after lower-casing, removing copyright statements, turning every run of punctuation
and white space into one space, and bringing equivalent spellings together. The SHA-256 of the canonical
text is joined to the digests of the known texts, so only documents that are a licence (or a licence
notice) as a whole match; a longer text that quotes one does not.

A copyright statement is a line that begins with "copyright" (or "(c)") and a year, "(c)" or a placeholder
for them, or holds nothing but "all rights reserved"; prose whose wrapped lines begin with "copyright
holders" stays, so a text matches however its paragraphs are wrapped. The Free Software Foundation's statement,
which prose can follow in its paragraph, goes with its address wherever it stands, and so do the placeholders of appendices. A holder's name that
runs on to a second line stays, and such a text then matches nothing.

Known are the texts in ``license_texts`` (each also without the appendix after "END OF TERMS AND
CONDITIONS"), the short licences below with the usual titles or none, and four one-line notices. Callers can
give a table of their own.

Null and empty texts, and texts of nothing but punctuation, match nothing. One row in, one row out, also for
repeated rows; of several known names for a digest the smallest is given. An empty table gives an empty one, and
extra columns are ignored. Only DataFrame functions are used. The known table is broadcast: its size is that of the
list given (checked against ``MAX_KNOWN``, beyond which the join is left to Spark's choice).
"""

from __future__ import annotations

from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_KNOWN = 10_000

# Public licence texts (SPDX names), their usual titles, and one-line notices.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
SHORT = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    f"Software.\n\n{_AS_IS}IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
    "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    f"that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC}",
    "BSD-2-Clause": f"{_BSD}\n{_BSD_END}",
    "BSD-3-Clause": f"{_BSD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    f"from this software without specific prior written permission.\n\n{_BSD_END}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software.\n3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to "
    "the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
    "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    f"{_AS_IS}IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
    "For more information, please refer to <https://unlicense.org/>",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:MIT": "Released under the MIT License.",
}
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "The 3-Clause BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
APPENDIX = "END OF TERMS AND CONDITIONS"

_GAP = r"[ \t\r\n]+"
_ADDRESS = ("51 franklin st(reet)?", "59 temple pl(ace)?", "675 mass(achusetts)? ave(nue)?", "fifth floor", "suite 330", "cambridge", "boston", "ma", "02110-1301", "02111-1307", "02139", "usa?")
FOUNDATION = f"copyright{_GAP}(\\(c\\)|©){_GAP}([0-9]{{4}}[, \\t\\r\\n-]*)+free{_GAP}software{_GAP}foundation,?{_GAP}inc\\.?,?({_GAP}<?https?://fsf\\.org/?>?)?([, \\t\\r\\n]+({'|'.join(_ADDRESS).replace(' ', _GAP)}))*\\.?"
PLACEHOLDER = f"copyright{_GAP}(\\(c\\){_GAP})?([\\[<]?(yyyy|year|19yy)[\\]>]?{_GAP}[\\[<]?(your{_GAP}name|name{_GAP}of{_GAP}(author|copyright{_GAP}(owner|holder)))[\\]>]?|[_ \t\r\n]+\\.{_GAP}all{_GAP}rights{_GAP}reserved\\.?)"
_ADORNED = r"[ \t#*/;%-]*"
_DATED = r"(\(c\)|©|&copy;|[0-9]{4}|[\[<{]? ?(yyyy|years?)\b)"
COPYRIGHT_LINE = f"\n{_ADORNED}((portions )?copyright[ \t:,]*(by )?{_DATED}|(\\(c\\)|©)[ \t]*(copyright|{_DATED}))[^\n]*"
RESERVED_LINE = f"\n{_ADORNED}all rights reserved[.! \t\r]*\n"
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{a0}-\x{a9}\x{ab}-\x{b1}\x{b4}\x{b6}-\x{b8}\x{bb}\x{bf}\x{2000}-\x{206f}\x{3000}-\x{3003}\x{feff}]+"
#: Equivalent spellings of canonical words, and of marks before they go.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("https ", "http "),
    ("franklin street", "franklin st"),
)
# End of the fixed values.


@cache
def known_texts() -> tuple[tuple[str, str], ...]:
    """(name, text) of every known licence, notice and variant."""
    out = []
    for name, text in SHORT.items():
        out += [(name, text), *((name, f"{title}\n\n{text}") for title in TITLES.get(name, ()))]
    for f in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        name, text = f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")
        out.append((name, text))
        terms, found, _ = text.partition(APPENDIX)
        out += [(name, terms), (name, terms + found)] if found else []
    return tuple(out)


def canonical(text: Column) -> Column:
    out = F.concat(F.lit("\n"), F.lower(text), F.lit("\n"))
    for pattern, other in ((FOUNDATION, " "), (PLACEHOLDER, " "), (COPYRIGHT_LINE, ""), (RESERVED_LINE, "\n")):
        out = F.regexp_replace(out, pattern, other)
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), PUNCTUATION, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def scan(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, canonical_sha256 (null for a text without content), license (null if none) for each document."""
    spark = documents.sparkSession
    given = spark.createDataFrame(known_texts(), "name string, text string") if known is None else known.select("name", "text")
    few = known is None or given.limit(MAX_KNOWN + 1).count() <= MAX_KNOWN
    digests = given.select(_digest(F.col("text")).alias("canonical_sha256"), F.col("name").cast("string").alias("license"))
    digests = digests.where(F.col("canonical_sha256").isNotNull()).groupBy("canonical_sha256").agg(F.min("license").alias("license"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("canonical_sha256"))
    return rows.join(F.broadcast(digests) if few else digests, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license")


def _digest(text: Column) -> Column:
    plain = canonical(text.cast("string"))
    return F.when(plain != "", F.sha2(plain.cast("binary"), 256))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"chr(10) || lower({text}) || chr(10)"
    for pattern, other in ((FOUNDATION, "' '"), (PLACEHOLDER, "' '"), (COPYRIGHT_LINE, "''"), (RESERVED_LINE, "chr(10)")):
        out = f"regexp_replace({out}, {quoted(pattern)}, {other}, 'g')"
    out = f"regexp_replace(replace({out}, '&', ' and '), {quoted(PUNCTUATION)}, ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {quoted(old)}, {quoted(new)})"
    return f"trim({out})"


def oracle() -> str:
    texts = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known_texts())
    return f"""
WITH known AS (SELECT sha256({_sql_canonical("body")}) AS digest, min(name) AS license FROM (VALUES {texts}) AS k(name, body) GROUP BY 1),
plain AS (SELECT doc_id, {_sql_canonical("text")} AS body FROM documents),
digested AS (SELECT doc_id, CASE WHEN body <> '' THEN sha256(body) END AS canonical_sha256 FROM plain)
SELECT doc_id, canonical_sha256, license FROM digested LEFT JOIN known ON canonical_sha256 = digest"""
