"""Licences by canonical digest: entire texts, hash-joined to the digests of known ones.

A text's canonical form has lower case, no copyright statements that begin a line, one spelling of equivalent words, and one
blank for any run of other characters than letters and digits. Entire texts are whole documents and whole lines
(a notice is a line). Their SHA-256 digests are joined to those of the known texts, which go through the same form.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published licence notices and short licences, and spellings that mean the same.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"], "0BSD": ["BSD Zero Clause License"]}
#: Files of ``license_texts``: whole texts as they are published.
WHOLE = ["0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib"]
KNOWN += [(name, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()) for name in WHOLE]
KNOWN += [(name, f"{title}\n{text}") for name, text in KNOWN if len(text) > 500 for title in TITLES.get(name, [])]
SPELLINGS = [
    (r"\blicen[cs]e([sd]?)\b", "license$1"),
    (r"\bsub-license", "sublicense"),
    (r"\bnon-infringement\b", "noninfringement"),
    (r"\bnon-commercial\b", "noncommercial"),
    (r"https?://", ""),
]
# a line's copyright statement, up to a notice that follows in the line; a wrapped sentence's "copyright notice" is none
_COPYRIGHT = r"(?m)^[ \t]*(copyright(?![ \t]*$|[ \t]+(notice|holder|owner|law|licen|interest|act|and|or|in|statement|treaty)s?\b)|\(c\)(?=[ \t]*(copyright|\d{4}))|©|all rights reserved)[^\n]*?(?=\b(licen[cs]ed?|released|permission|this (project|work|software|file))\b|$)"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, " ")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """doc_id, digest of the whole text, text_license (null: none), line_licenses (distinct, ascending), n_license_lines.

    A null or empty text has the digest of the empty form and no licence. Rows that share a ``doc_id`` and text give equal
    rows. The known digests are a fixed list, so they are broadcast: no row is shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = spark.createDataFrame(known, "license string, text string").select("license", F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("text_license"))
    rows = table.collect()  # as many as ``known`` at most
    whole = docs.select("doc_id", "text", F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest")).join(F.broadcast(spark.createDataFrame(rows, table.schema)), "digest", "left")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(?i)licen[cs]e|permission|copyright|warrant"))
    whole = whole.withColumn("lines", lines).drop("text")
    # a line's digest is looked up in the row: no explode and no shuffle, whatever the number of lines
    license_of = F.create_map(*[F.lit(x) for r in rows for x in r])
    hits = F.filter(F.transform("lines", lambda x: F.element_at(license_of, F.sha2(canonical(x).cast("binary"), 256))), lambda x: x.isNotNull())
    return whole.withColumn("hits", hits).select("doc_id", "digest", "text_license", F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("line_licenses"), F.size("hits").cast("long").alias("n_license_lines"))
