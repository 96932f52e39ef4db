"""Licence scan by canonical digests. DataFrame functions only.

A text is brought to a canonical form: copyright lines left out, with or without a year, lower case, equivalent spellings made one,
punctuation and line breaks to single blanks. The digest of the whole form is hash-joined to the digests of known
texts, which went through the very same expression. A document is looked up as a whole, and so is each of its lines
and each of its paragraphs (parts between empty lines), since notices stand in lines of their own.

Every known text holds one of a few marker words (checked when the table of digests is made), so only texts and lines
with a marker are normalised. The table of known digests is a constant of the package, about two hundred
rows, and so may be broadcast. Nothing else is shuffled. Long licences are known by their digests alone.

Null or empty texts match nothing; ids, ties and repeated rows keep one result a row; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def _gnu_notice(name: str, version: str, what: str = "program") -> str:
    own = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.\n\n"
    return own + f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.\n\nYou should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."


#: Names of licences in texts, and identifiers.
NAMES = {
    "MIT": ("MIT",), "Apache-2.0": ("Apache", "Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0"), "BSD-2-Clause": ("BSD 2-Clause", "BSD-2-Clause", "Simplified BSD"), "BSD-3-Clause": ("BSD 3-Clause", "BSD-3-Clause", "New BSD", "Modified BSD"), "ISC": ("ISC",),
    "GPL-2.0": ("GPLv2", "GPL-2.0", "GNU GPL v2", "GNU General Public License v2.0"), "GPL-3.0": ("GPLv3", "GPL-3.0", "GNU GPL v3", "GNU General Public License v3.0"), "LGPL-2.1": ("LGPLv2.1", "LGPL-2.1"), "LGPL-3.0": ("LGPLv3", "LGPL-3.0"), "AGPL-3.0": ("AGPLv3", "AGPL-3.0", "GNU Affero General Public License v3.0"),
    "MPL-2.0": ("MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0"), "EPL-2.0": ("EPL 2.0", "EPL-2.0", "Eclipse Public License 2.0"), "CC0-1.0": ("CC0", "CC0 1.0", "CC0-1.0"), "CC-BY-4.0": ("CC BY 4.0", "CC-BY-4.0"), "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0"), "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0"), "Unlicense": ("Unlicense",),
}
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "0BSD", "Zlib", "BSL-1.0")
#: Licence, form, text: whole texts and the notices that stand for them.
KNOWN = (
    *(("MIT", "text", title + _MIT) for title in ("", "MIT License\n\n", "The MIT License (MIT)\n\n", "The MIT License\n\n")),
    *(("BSD-2-Clause", "text", title + _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_TAIL) for title in ("", "BSD 2-Clause License\n\n", "The BSD 2-Clause License\n\n")),
    *(("BSD-3-Clause", "text", title + _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_TAIL) for title in ("", "BSD 3-Clause License\n\n", "The BSD 3-Clause License\n\n")),
    *(("ISC", "text", title + _ISC) for title in ("", "ISC License\n\n", "The ISC License\n\n")),
    ("Unlicense", "text", _UNLICENSE),
    ("Apache-2.0", "notice", _APACHE_NOTICE),
    ("MPL-2.0", "notice", _MPL_NOTICE),
    *((i, "notice", _gnu_notice(name, v, what)) for i, name, v in (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")) for what in ("program", "library", "file")),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    *(("-".join(i.split("-")[:2]) if i.endswith(("only", "later")) else i, "notice", "SPDX-License-Identifier: " + i) for i in SPDX),
    *((i, "notice", form.format(name)) for i, names in NAMES.items() for name in names for form in ("Licensed under {}.", "Licensed under the {} License.", "Released under the {} License.")),
)
#: SHA-256 of the canonical form of whole licences that are too long to be kept as text; "terms" ends with the terms, without the
#: advice on how to apply them.
DIGESTS = (
    ("Apache-2.0", "text", "4db164cc277b72e3d03f4161513c53b32de1cf3a402162a025e00d038383a74f"),
    ("Apache-2.0", "terms", "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93"),
    ("Apache-2.0", "terms", "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809"),
    ("Artistic-1.0-Perl", "text", "f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915"),
    ("CC0-1.0", "text", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "text", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "text", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "text", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "terms", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "terms", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "text", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "terms", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "terms", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "text", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "terms", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "terms", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", "text", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "terms", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "terms", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "text", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "terms", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "terms", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "text", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "text", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "text", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
)
MARKERS = ("licen", "permission", "redistribution")
#: Spellings that count as one.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("organisation", "organization"), ("copyright owner", "copyright holder"), ("merchantibility", "merchantability"), ("v2 0", "version 2 0"), ("http", "https"))


#: Lines that name a holder, of the text in lower case: with a year, or beginning as a notice does. A line of licence text that happens to begin with the word goes on with one of the
#: words below.
COPYRIGHT = (
    r"(?m)^[^{alnum}\n]*(?:copyright|\(c\)|©)[^\n]*\d{{4}}[^\n]*$",
    r"(?m)^[^{alnum}\n]*copyright[ \t]+(?:\(c\)|©)[^\n]{{0,80}}$",
    r"(?m)^[^{alnum}\n]*all rights reserved\.?\s*$",
)
#: A line that begins with "copyright" and a name: everything but the words that licence texts go on with.
NAMED = r"(?m)^[^{alnum}\n]*copyright[ \t]+(?:by |the )?[{letters}][^\n]{{0,80}}$"
#: Words that follow "copyright" in the licences' own sentences.
SENTENCES = ("and", "are", "disclaimer", "doctrines", "holder", "holders", "if", "interest", "law", "laws", "licence", "licences", "license", "licenses", "notice", "notices", "of", "on", "or", "owner", "owners", "ownership", "permission", "protection", "resulting", "statement", "statements", "treaty")


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, one spelling for equivalent ones."""
    x = F.lower(text)
    for line in COPYRIGHT:
        x = F.regexp_replace(x, line.format(alnum=r"\p{Alnum}"), " ")
    # a sentence of the licence is marked before lines of holders go, and comes back after them
    x = F.regexp_replace(x, sentences(), "copyright\u0001 $1")
    x = F.regexp_replace(x, NAMED.format(alnum=r"\p{Alnum}", letters=r"\p{L}"), " ")
    x = F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))
    for a, b in SPELLINGS:
        x = F.regexp_replace(x, rf"\b{a}\b", b)
    return x


def sentences() -> str:
    return rf"copyright[ \t]+({'|'.join(sorted(SENTENCES, key=len, reverse=True))})\b"


def marked(text: Column) -> Column:
    low = F.lower(text)
    found = F.contains(low, F.lit(MARKERS[0]))
    for m in MARKERS[1:]:
        found = found | F.contains(low, F.lit(m))
    return found


def known_digests(spark: SparkSession) -> DataFrame:
    """digest, license, form of the known texts."""
    assert all(any(m in text.lower() for m in MARKERS) for _, _, text in KNOWN)
    one = F.explode(F.array(*(F.struct(F.lit(a).alias("license"), F.lit(b).alias("form"), F.lit(t).alias("text")) for a, b, t in KNOWN)))
    rows = spark.range(1).select(one.alias("k")).select("k.*").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license", "form")
    long = F.explode(F.array(*(F.struct(F.lit(d).alias("digest"), F.lit(a).alias("license"), F.lit(b).alias("form")) for a, b, d in DIGESTS)))
    rows = rows.union(spark.range(1).select(long.alias("k")).select("k.digest", "k.license", "k.form"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.min("form").alias("form"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: licenses (sorted ids, comma-joined), n_units (lines, paragraphs or whole text that are a known
    text), whole_text (the licence that the whole document is, else null)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    parts = F.filter(F.split("t", r"\r?\n"), marked)
    blocks = F.when(F.col("t").rlike(r"\n[ \t\r]*\n"), F.filter(F.split("t", r"\n(?:[ \t\r]*\n)+"), lambda p: marked(p) & F.contains(F.trim(p), F.lit("\n")))).otherwise(F.expr("cast(array() as array<string>)"))
    unit = lambda kind, x: F.struct(F.lit(kind).alias("kind"), F.sha2(canonical(x), 256).alias("digest"))
    lines = F.when(F.contains("t", F.lit("\n")), F.transform(parts, lambda x: unit("line", x))).otherwise(F.expr("cast(array() as array<struct<kind:string,digest:string>>)"))
    units = F.concat(F.array(unit("document", F.col("t"))), F.transform(blocks, lambda x: unit("paragraph", x)), lines)
    none = F.expr("cast(array() as array<struct<kind:string,digest:string>>)")
    rows = rows.select("doc_id", F.when(marked(F.col("t")), units).otherwise(none).alias("units"))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "licenses")
    each = rows.where(F.size("units") > 0).select("row", F.explode("units").alias("u")).select("row", "u.*")
    found = each.join(F.broadcast(known_digests(spark)), "digest")
    found = found.groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.count("*").alias("n_units"),
        F.max(F.when(F.col("kind") == "document", F.col("license"))).alias("whole_text"),
    )
    return rows.select("row", "doc_id").join(found, "row", "left").select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), "whole_text")
