"""Licence texts by canonical digest: texts that say the same hash the same.

A text is brought into a canonical form (case, punctuation, copyright lines, equivalent
spellings) and hashed; an equality join with the digests of known licences finds it. Whole
documents are looked up, and each of their lines as a text of its own, as a notice is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.common import staged
from kindred.llm.words import ascii_lower

#: Spellings that licence matching treats as one (word on the left -> words on the right). Fixed values.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
             "organisation": "organization", "organisations": "organizations", "analyse": "analyze",
             "behaviour": "behavior", "favour": "favor", "fulfil": "fulfill", "initialise": "initialize",
             "owner": "holder", "owners": "holders", "v2": "version 2", "v3": "version 3", "https": "http"}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known texts: (SPDX-style id, text). Fixed values; more can be given as a table.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC0-1.0", "Released under CC0 1.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
)
#: A lower-cased line that only says whose work it is; it differs in every copy and goes.
COPYRIGHT_LINE = r"^[\x20\t]*((copyright[\x20\t]*)?(\(c\)|©)|copyright[\x20\t]*[0-9]|all rights reserved)"
#: What ends no word (removed) and what separates words (one space).
INNER, BETWEEN = "['’`]", r"[^\p{L}\p{N}]+"


def canonical_line(line: Column) -> Column:
    """Canonical words of one line, joined by one space; '' for a copyright line."""
    t = ascii_lower(line)
    words = F.regexp_replace(F.regexp_replace(t, INNER, ""), BETWEEN, " ")
    words = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    for a, b in SPELLINGS.items():
        old, new = F.lit(f" {a} "), F.lit(f" {b} ")
        words = F.replace(F.replace(words, old, new), old, new)  # twice: neighbours share the space between them
    return F.when(t.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(F.trim(words))


def canonical_lines(text: Column) -> Column:
    """Canonical lines that have a word; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line), lambda x: x != "")


def digest(lines: Column) -> Column:
    """SHA-256 (hex) of canonical lines as one text, however it is wrapped; null where nothing is left."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, licence) of known texts; of several licences with one digest the first by name."""
    df = spark.createDataFrame(list(known), "licence string, text string")
    return (df.select(digest(canonical_lines(F.col("text"))).alias("digest"), "licence").where("digest IS NOT NULL")
            .groupBy("digest").agg(F.min("licence").alias("licence")))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, digest, licence of the whole text, line_licences, n_lines.

    ``line_licences``: licences of single lines, distinct, in order, comma-joined (null: none);
    ``n_lines``: canonical lines with a word. ``known``: a table (digest, licence) with one row per digest,
    joined as Spark sees fit by its size; the built-in list (some dozens of rows) is broadcast. A null or empty text
    has a null digest and no licence. Repeated rows are looked up each for itself; an empty table
    gives an empty one; further columns are ignored.
    """
    known = F.broadcast(known_digests(docs.sparkSession)) if known is None else known
    rows = staged(docs.select("doc_id", F.col("text").alias("__text")),
                  {"row": F.xxhash64("doc_id", "__text"), "lines": canonical_lines(F.col("__text"))})
    whole = rows.select("doc_id", "row", digest(F.col("lines")).alias("digest"), F.size("lines").cast("long").alias("n_lines"))
    by_line = (rows.select("row", F.explode(F.array_distinct("lines")).alias("line"))
               .select("row", F.sha2("line", 256).alias("digest")).join(known, "digest")
               .groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("line_licences")))
    return whole.join(known, "digest", "left").join(by_line, "row", "left").select(
        "doc_id", "digest", "licence", "line_licences", "n_lines")
