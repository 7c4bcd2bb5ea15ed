r"""Licence scans by lookup of canonical digests.

A text is made canonical: lower case, copyright lines dropped, punctuation and white space reduced to single blanks,
equivalent spellings unified. The SHA-256 of the canonical text is joined with the digests of known licences. The same
digest of each line of a document is joined with those of known notices (the one-sentence grants that documents carry),
since a line is then an entire text, however short. One pass over a text makes its canonical lines, of which the
canonical text is put together; its digest, and those of lines as long as some notice, are a table that both joins read. Expressions stay in the JVM; the known digests are parameters, and are broadcast up to
MAX_BROADCAST of them. A hot line is slim when joined: its document and digest.

Known texts count with and without each of their usual title lines, and with and without list numbers. Long licences
are known by the digests of their canonical forms alone.

Defined cases: null, empty and blank texts have the digest of the empty text and match nothing; several known texts of
one digest give the least license_id; a known text without letters or digits is no text; repeated rows give a row each;
null doc_ids are kept, without notices; rows that share a doc_id share their notices; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from casebook.llm.shared import written

#: Equivalent spellings, as licence matching guidelines list them.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("honour", "honor"), ("judgement", "judgment"), ("organisation", "organization"), ("organisations", "organizations"),
    ("practise", "practice"), ("programme", "program"), ("recognised", "recognized"), ("whilst", "while"), ("wilful", "willful"),
    ("http", "https"),
]
#: Short public licence texts.
LICENSES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>",
}
#: Notices, one sentence each.
NOTICES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."), ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Title lines that such texts begin with.
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"], "ISC": ["ISC License", "The ISC License"], "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"], "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"], "Unlicense": ["The Unlicense"],
}
#: SHA-256 of the canonical forms of long public licence texts, entire, without the appendix on
#: how to apply them, and without the line that ends their terms.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "65bfb6f56a10dc6dd6135cf4adeee0f5bc238b3d404067ac48dbf48c0ced3b32"),
    ("Apache-2.0", "769f6cd740fe13ac62c8d735e4f75a44231f944dc392325d819290d7fb6b07e1"),
    ("Apache-2.0", "ed44d69699f98d45c0c3e52ef4574fb05d6045eb6e2cd0e5e3810f6177e87f84"),
    ("Apache-2.0", "ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
]
COPYRIGHT = r"(^|\n)[ \t]*(copyright[ \t]*(\(c\)|©|<?year|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*"
SIGNS = r"[^\p{L}\p{N}\n]+"
MAX_BROADCAST = 10_000


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines, without blank ones."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "$1")
    out = F.replace(F.replace(F.regexp_replace(out, SIGNS, " "), F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n "))
    out = F.concat(F.lit(" "), out, F.lit(" "))  # every word has a blank of its own on either side
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    lines = F.transform(F.split(out, "\n", -1), lambda x: F.btrim(F.replace(x, F.lit("  "), F.lit(" "))))
    return F.filter(lines, lambda x: x != "")


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    return F.array_join(canonical_lines(text), " ")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def variants(license_id: str, text: str) -> list[tuple[str, str]]:
    """A text with and without its usual titles and its list numbers."""
    bodies = dict.fromkeys([text, re.sub(r"(?<= )\d\. ", "", text)])
    return [(license_id, f"{title}\n{body}") for body in bodies for title in ("", *TITLES.get(license_id, []))]


def known(spark, texts: list[tuple[str, str]], digests: list[tuple[str, str]] = ()) -> DataFrame:
    """(digest, license_id) of known texts and digests."""
    rows = spark.createDataFrame(texts, "license_id string, text string").select(canonical(F.col("text")).alias("form"), "license_id")
    every = rows.where("form <> ''").select(digest(F.col("form")).alias("digest"), "license_id")
    if digests:
        every = every.unionByName(spark.createDataFrame(list(digests), "license_id string, digest string"))
    out = every.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return F.broadcast(out) if len(texts) + len(digests) <= MAX_BROADCAST else out


def scan(docs: DataFrame, licenses: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None, digests: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, text_digest, license_id, n_notices, notices) of each document: the licence that the entire text is, and
    the licences that lines of it are notices of (comma-joined, in order). ``licenses`` are (license_id, text), ``digests``
    (license_id, digest of the canonical form); the defaults are LICENSES with their variants, and DIGESTS."""
    spark = docs.sparkSession
    if licenses is None:
        licenses, digests = [v for x in LICENSES.items() for v in variants(*x)], DIGESTS if digests is None else digests
    whole = known(spark, licenses, digests or ())
    single = known(spark, NOTICES if notices is None else notices)
    # a line whose canonical form is as long as no notice's is none; the others' digests go to a table with the texts'
    sizes = [r.n for r in spark.createDataFrame(NOTICES if notices is None else notices, "license_id string, text string").select(F.char_length(canonical(F.col("text"))).alias("n")).distinct().collect()]
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    fitting = F.transform(F.filter("lines", lambda x: F.char_length(x).isin(sizes)), digest)
    digested = written(lines.select("doc_id", digest(F.array_join("lines", " ")).alias("text_digest"), fitting.alias("fitting")), "license-digests")
    noted = digested.where("doc_id IS NOT NULL").select("doc_id", F.explode("fitting").alias("digest")).join(single, "digest")
    by_doc = noted.groupBy("doc_id").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    out = digested.select("doc_id", "text_digest").join(whole.withColumnRenamed("digest", "text_digest"), "text_digest", "left").join(by_doc, "doc_id", "left")
    return out.select("doc_id", "text_digest", "license_id", F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """A row per document of the whole table."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql(text: str) -> str:
    """Canonical lines in SQL."""
    out = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT}', '\\1', 'g'), '{SIGNS}', ' ', 'g')"
    out = f"' ' || replace(replace({out}, ' ', '  '), chr(10), ' ' || chr(10) || ' ') || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(replace(x, '  ', ' '))), lambda x: x <> '')"


def _values(rows) -> str:
    return ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in rows)


OP8_SQL = f"""
WITH known AS (SELECT sha256(array_to_string({_sql('t')}, ' ')) AS digest, i FROM (VALUES {_values(v for x in LICENSES.items() for v in variants(*x))}) v(i, t)
  UNION ALL SELECT d, i FROM (VALUES {_values(DIGESTS)}) v(i, d)),
whole AS (SELECT digest, min(i) AS license_id FROM known GROUP BY 1),
single AS (SELECT sha256(array_to_string({_sql('t')}, ' ')) AS digest, min(i) AS license_id FROM (VALUES {_values(NOTICES)}) v(i, t) GROUP BY 1),
d AS (SELECT doc_id, {_sql('text')} AS lines FROM documents),
noted AS (SELECT doc_id, sha256(unnest(lines)) AS digest FROM d),
by_doc AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM noted JOIN single USING (digest) GROUP BY doc_id),
t AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS text_digest FROM d)
SELECT t.doc_id, t.text_digest, w.license_id, coalesce(b.n, 0)::BIGINT AS n_notices, coalesce(b.notices, '') AS notices
FROM t LEFT JOIN whole w ON w.digest = t.text_digest LEFT JOIN by_doc b ON b.doc_id = t.doc_id
"""
