"""Licence scans by canonical digest lookup; built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table
from .licence_digests import DIGESTS

#: Texts of well-known licences, by SPDX id.
LICENCES = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """BSD Zero Clause License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """BSD 2-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
    "Zlib": """zlib License

Copyright (c) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Copyright (C) 2004 Sam Hocevar <sam@hocevar.net>

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
LICENCES["BSD-3-Clause"] = LICENCES["BSD-2-Clause"].replace("2-Clause", "3-Clause").replace(
    "\n\nTHIS SOFTWARE",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE",
)
#: Spellings that licence matching guidelines count as equal.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("wilful", "willful"),
)
LICENCES["MIT-0"] = LICENCES["MIT"].replace("MIT License", "MIT No Attribution").replace(", subject to the following conditions:", ".").replace(
    "\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ""
)


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else "[ \\t]+" if c == " " else c for c in words)


#: Whole lines that give a holder, after comment signs: copyright with a sign, a year, a placeholder or a name in
#: capitals; a sign with a year or a placeholder; and all rights reserved. Lines of running text stay.
_YEAR = r"(?:[12][0-9]{3}|[<\[{]|" + _any_case("year") + ")"
COPYRIGHT_LINES = (
    r"\n(?:[ \t*#/;-]*(?:"
    + _any_case("copyright") + r"[ \t:]*(?:\([cC]\)|©|" + _YEAR + "|" + _any_case("by") + r"[ \t])[^\n]*"
    + r"|Copyright(?:[ \t]+(?:[A-Z][a-z][^ \t\n\r]*|&|and))+[ \t\r.]*"
    + r"|(?:\([cC]\)|©)[^\n]*" + _YEAR + r"[^\n]*"
    + "|" + _any_case("all rights reserved") + r"[ \t\r.]*)\n)+"
)
#: Everything in ASCII but letters and digits, general punctuation and the no-break space.
GAP = r"[\x00-/:-`{-\x7F\x{A0}\x{2000}-\x{206F}]+"


def canonical(col) -> F.Column:
    """Lower case (A-Z), without copyright lines, punctuation and white space as single spaces, one spelling of each word."""
    text = F.coalesce(col, F.lit(""))
    lines = F.regexp_replace(F.concat(F.lit("\n"), text, F.lit("\n")), COPYRIGHT_LINES, "\n")
    text = ascii_lower(F.when(ascii_lower(text).rlike(r"copyright|\(c\)|©|reserved"), lines).otherwise(text))
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, GAP, " ")), F.lit(" "))
    for other, one in SPELLINGS:
        text = F.replace(text, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(text)


def forms(licences: dict[str, str]) -> list[tuple[str, str]]:
    """(licence_id, text) of each licence, and of each without the title, its first paragraph, where that is a line."""
    short = [(k, rest) for k, (title, _, rest) in ((k, v.strip().partition("\n\n")) for k, v in licences.items()) if rest and "\n" not in title and len(title) < 80]
    return sorted([*licences.items(), *short])


def known_digests(spark: SparkSession, licences: dict[str, str], digests: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(licence_id, canonical_sha256) of the known texts in all their forms and of further digests, each digest once, with the least id."""
    texts = spark.createDataFrame(forms(licences), "licence_id string, text string").select("licence_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    more = spark.createDataFrame(list(digests), "licence_id string, canonical_sha256 string")
    return texts.unionByName(more).groupBy("canonical_sha256").agg(F.min("licence_id").alias("licence_id"))


def scan_licences(docs: DataFrame, licences: dict[str, str] = LICENCES, digests: tuple[tuple[str, str], ...] = DIGESTS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which documents are, as a whole, the text of a known licence: (doc_id, canonical_sha256, n_words, licence_id).

    licences are texts, digests (licence_id, canonical_sha256) those of longer ones; both are parameters and
    a fixed list of the caller's, held in memory by the driver already, and are broadcast; texts
    are neither shuffled nor sorted. licence_id is null for any other document, also an empty or null one.
    Rows that repeat give a row each, an empty table none; other columns are ignored.
    """
    text = canonical(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("canon")).select(
        "doc_id", F.sha2("canon", 256).alias("canonical_sha256"), F.when(F.col("canon") == "", 0).otherwise(F.char_length("canon") - F.char_length(F.replace("canon", F.lit(" "))) + 1).cast("long").alias("n_words"),
    )
    known = known_digests(docs.sparkSession, licences, digests)
    return rows.join(F.broadcast(known), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "n_words", "licence_id")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _canonical_sql(col: str) -> str:
    text = f"regexp_replace(chr(10) || coalesce({col}, '') || chr(10), '{COPYRIGHT_LINES}', chr(10), 'g')"
    text = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    text = f"(' ' || trim(regexp_replace({text}, '{GAP}', ' ', 'g')) || ' ')"
    for other, one in SPELLINGS:
        text = f"replace({text}, ' {other} ', ' {one} ')"
    return f"trim({text})"


ORACLE_SQL = f"""
WITH k(licence_id, text) AS (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in forms(LICENCES))}),
m(licence_id, digest) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in DIGESTS)}),
known AS (SELECT digest, min(licence_id) AS licence_id FROM (SELECT licence_id, sha256({_canonical_sql("text")}) AS digest FROM k UNION ALL SELECT licence_id, digest FROM m) GROUP BY 1),
d AS (SELECT doc_id, {_canonical_sql("text")} AS canon FROM documents)
SELECT doc_id, sha256(canon) AS canonical_sha256, CAST(CASE WHEN canon = '' THEN 0 ELSE len(canon) - len(replace(canon, ' ', '')) + 1 END AS BIGINT) AS n_words, licence_id
FROM d LEFT JOIN known ON sha256(canon) = digest
"""
