"""Licence scan: canonical digests of whole texts and of their lines, joined with digests of known licences.

Canonical form: lines that name a copyright holder go; A-Z is lower-cased; every run of characters that are neither letters nor
digits is one blank; equivalent spellings become one; blanks at the ends go. A line's canonical form is
hashed, and so is the whole text's, which is the blank-joined forms of its lines, once without and once with its
copyright lines: the second digest is the same however a text is wrapped, as it depends on its words alone. Everything is
DataFrame expressions; no text leaves the JVM.

Output, one row per distinct (id, text digest): doc_id, text_digest, whole_license (known text that is the whole
document, or null), n_license_lines, licenses (known ids found, sorted, comma-joined).

Defined cases. Null or empty text: the digest of the empty string, no licence. Null id: one row per digest. Rows
that repeat id and canonical text give one row; a copy that differs in canonical text gives its own. Ties: a digest
with several names lists them all. Empty table: no rows. Other columns of the input are ignored.

The table of known licences is a fixed list, so it may be broadcast: the texts and notices of KNOWN, and the digests
of whole texts in license_digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitpanel.llm.license_digests import WHOLE

# Spellings that count as one, patterns of the canonical form, public licence texts and notices.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("favour", "favor"), ("merchantibility", "merchantability"), ("recognise", "recognize"), ("authorised", "authorized"), ("noncommercial", "non commercial"), ("https", "http"),
]
#: A line that only names the holder: the word or mark with a year or another mark right after it, or the usual closing words alone.
YEAR = r"([12][0-9]{3}|19yy|[<\[({]?(year|yyyy)|\(c\)|©)"
COPYRIGHT = rf"^[^a-z0-9(©]*((copyright|copr[.]?|\(c\)|©)[ \t]*{YEAR}|all rights reserved[^a-z0-9]*$)"
OTHER = r"[^a-z0-9\x80-\x{10FFFF}]+"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = {
    "MIT": [MIT, "MIT License\n" + MIT, "The MIT License (MIT)\n" + MIT, "Released under the MIT License.", "Licensed under the MIT License."],
    "ISC": [ISC, "ISC License\n" + ISC],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
}


def lowered(line: Column) -> Column:
    return F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical(line: Column) -> Column:
    """Canonical form of one line."""
    out = F.concat(F.lit(" "), F.regexp_replace(lowered(line), OTHER, "  "), F.lit(" "))
    for odd, usual in SPELLINGS:
        out = F.replace(out, F.lit(f" {odd} "), F.lit(f" {usual} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def canonical_lines(text: Column) -> Column:
    """Canonical lines that have a word, each with whether it only names the copyright holder."""
    one = lambda x: F.struct(canonical(x).alias("line"), lowered(x).rlike(COPYRIGHT).alias("holder"))
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), one), lambda x: x["line"] != "")


def body(lines: Column) -> Column:
    return F.transform(F.filter(lines, lambda x: ~x["holder"]), lambda x: x["line"])


def digest_of(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def known_table(docs: DataFrame, known: dict[str, list[str]], whole: dict[str, list[str]] | None = None) -> DataFrame:
    """digest, license: one row per distinct pair of fixed lists of texts and of digests."""
    rows = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(k).alias("license")) for k, texts in known.items() for t in texts])
    one = docs.sparkSession.range(1).select(F.inline(rows))
    names = one.select(digest_of(body(canonical_lines(F.col("text")))).alias("digest"), "license")
    if whole:
        pairs = F.split(F.lit(" ".join(f"{d}:{k}" for k, digests in whole.items() for d in digests)), " ")
        pair = docs.sparkSession.range(1).select(F.explode(pairs).alias("p"))
        names = names.union(pair.select(F.substring_index("p", ":", 1), F.substring_index("p", ":", -1)))
    return names.distinct()


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, text_digest, whole_license, n_license_lines, licenses."""
    names = F.broadcast(known_table(docs, KNOWN, WHOLE) if known is None else known_table(docs, known))
    let = lambda value, use: F.transform(F.array(value), use)[0]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = texts.select(
        "doc_id",
        let(canonical_lines(F.col("text")), lambda x: F.struct(
            digest_of(body(x)).alias("whole"), digest_of(F.transform(x, lambda s: s["line"])).alias("every"), F.transform(body(x), lambda s: F.sha2(s, 256)).alias("lines"),
        )).alias("d"),
    )
    # The whole text, with its copyright lines too where it has some, and every line, each once per row; a text of one line is both.
    unit = lambda whole, digest: F.struct(F.lit(whole).alias("whole"), digest.alias("digest"))
    units = hashed.select("doc_id", F.col("d.whole").alias("text_digest"), F.explode(F.concat(
        F.array(unit(True, F.col("d.whole"))),
        F.filter(F.array(unit(True, F.col("d.every"))), lambda x: x["digest"] != F.col("d.whole")),
        F.transform("d.lines", lambda x: unit(False, x)),
    )).alias("u")).select("doc_id", "text_digest", "u.whole", "u.digest")
    found = units.join(names, "digest", "left").filter("whole or license is not null")
    once = found.groupBy("doc_id", "text_digest", "whole", "digest", "license").agg(F.count("*").alias("n"))
    return once.groupBy("doc_id", "text_digest").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("license")))), ",").alias("w"),
        F.max(F.when(F.col("whole"), F.col("n"))).alias("copies"),
        F.sum(F.when(~F.col("whole"), F.col("n"))).alias("hits"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    ).select(
        "doc_id", "text_digest", F.when(F.col("w") != "", F.col("w")).alias("whole_license"),
        F.coalesce((F.col("hits") / F.col("copies")).cast("long"), F.lit(0)).alias("n_license_lines"), "licenses",
    )
