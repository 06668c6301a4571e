"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text is reduced to a canonical form: lower case, copyright lines dropped, every
run of characters other than a-z and 0-9 as one space, equivalent spellings made
one.  The SHA-256 of that form is looked up, by a hash join, in a table of the
digests of known licence texts that were reduced in the same way.  Whole texts
are looked up, and each line too, as notices are often a line within a document.
``scan_passages`` looks up notices that are wrapped over several lines.

Known are short notices and full texts; the latter with and without the usual
title lines, numbered clauses, "all rights reserved" and appendices, so that the
canonical form itself need not guess what a title is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm.common import docs_of
from blotter.llm.license_texts import FULL

#: Spellings that licence comparisons treat as equal, left made into right, in canonical form.
EQUIVALENT = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("per cent", "percent"), ("copyright holder", "copyright owner"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("organisation", "organization"), ("whilst", "while"), ("wilful", "willful"),
    ("https", "http"), ("favour", "favor"),
)

#: Known notices and short texts (SPDX id, text).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
     "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
     "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
     'notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT '
     "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
     "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
     "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
     "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     'provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND '
     "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
     "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
     "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
     "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # first paragraphs of notices that are set in several
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
     "with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
     "whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
)
#: The clause that BSD-3-Clause has more, and title lines by SPDX id.
THIRD = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
         "from this software without specific prior written permission.")
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Lines after which a text may end, and the first lines of a text that may be missing.
_ENDS = ("END OF TERMS AND CONDITIONS", "For more information, please refer to")
_HEADS = ("Apache License\n", "Version 2.0, January 2004\n", "http://www.apache.org/licenses/\n", "GNU GENERAL PUBLIC LICENSE\n",
          "GNU LESSER GENERAL PUBLIC LICENSE\n", "Version 2, June 1991\n", "Version 2.1, February 1999\n", "Version 3, 29 June 2007\n",
          "Mozilla Public License Version 2.0\n", "Mozilla Public License, version 2.0\n", "=" * 34 + "\n", "Creative Commons Legal Code\n",
          "CC0 1.0 Universal\n", "Attribution-ShareAlike 4.0 International\n")


def _forms(text: str) -> set[str]:
    """A full text with and without what follows its terms, its title lines and the appendix's copyright line."""
    out = {text}
    for end in _ENDS:
        if end in text:
            terms = text[:text.index(end)]
            out |= {terms, f"{terms}\n{end}"}
    out |= {t.replace("Copyright [yyyy] [name of copyright owner]", "") for t in out}
    for t in list(out):
        left = t.lstrip("\n ")
        while head := next((h for h in _HEADS if left.startswith(h)), None):
            left = left[len(head):].lstrip("\n ")
            out.add(left)
    return out


def known_texts() -> tuple[tuple[str, str], ...]:
    """(SPDX id, text): notices, full texts and their usual forms."""
    full = list(FULL)
    bsd = next(t for i, t in FULL if i == "BSD-2-Clause")
    clauses, rest = bsd.split("THIS SOFTWARE", 1)
    full.append(("BSD-3-Clause", f"{clauses}3. {THIRD}\n\nTHIS SOFTWARE{rest}"))
    full += [(i, re.sub(r"(?m)^[123]\. ", "* ", t)) for i, t in full if i.startswith("BSD")]
    found = dict.fromkeys(NOTICES)
    for license_, text in full:
        found.update(dict.fromkeys((license_, t) for t in sorted(_forms(text))))
    for license_, titles in TITLES.items():
        for text in [t for i, t in found if i == license_ and len(t) > 500]:
            bare = [text, f"All rights reserved.\n\n{text}"]
            found.update(dict.fromkeys((license_, t) for t in [*bare, *(f"{title}\n\n{b}" for title in titles for b in bare)]))
    return tuple(found)


#: Known licence texts and notices (SPDX id, text).
TEXTS = known_texts()
#: Each known text holds one of these in lower case; passages without any are not looked up.
KEYS = ("licen", "permission", "permitted", "redistribut", "software", "universal")
#: A line that names a holder or year; "copyright notice" or "copyright holders" at the start of a wrapped line is text.
COPYRIGHT_LINE = r"(?:^|\n)[ \t#*/;-]*(?:copyright[ \t]*(?:\(c\)|©|by |:|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)[^\n]*"


def canonical(text: Column) -> Column:
    """The canonical form of a text, '' if nothing is left."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, "[^a-z0-9]+", " "), F.lit(" "))
    out = F.regexp_replace(out, " +", " ")
    for left, right in EQUIVALENT:
        out = F.replace(out, F.lit(f" {left}"), F.lit(f" {right}"))
    return F.trim(out)


def known_licenses(spark: SparkSession, texts=TEXTS) -> DataFrame:
    """digest, license: distinct, as many rows as ``texts`` at most."""
    table = spark.createDataFrame(list(texts), "license string, text string")
    return table.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, texts=TEXTS) -> DataFrame:
    """doc_id, text_digest, license (of the whole text, else null), notices (licences of single lines, comma-joined,
    '' if none), n_notices; a row per input row.

    A text or line that is empty in canonical form matches nothing.  Repeated rows give the same row again.
    The table of known texts is a constant of this module or a parameter, so it is broadcast.
    """
    spark = docs.sparkSession
    known = F.broadcast(known_licenses(spark, texts))
    rows = docs_of(docs)
    raw = F.sha2("text", 256).alias("raw")
    found = (rows.select("doc_id", raw, F.explode(F.split("text", "\n")).alias("line"))
             .select("doc_id", "raw", F.sha2(canonical(F.col("line")), 256).alias("digest"))
             .join(known, "digest").groupBy("doc_id", "raw")
             .agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.count("*").alias("n"))
             .select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"), "notices", "n"))
    whole = rows.select("doc_id", raw, F.sha2(canonical(F.col("text")), 256).alias("digest")).join(known, "digest", "left")
    return (whole.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw")), "left")
            .select("doc_id", F.col("digest").alias("text_digest"), "license", F.coalesce("notices", F.lit("")).alias("notices"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_notices")))


def scan_passages(docs: DataFrame, texts=TEXTS) -> DataFrame:
    """doc_id, passages (licences of paragraphs of several lines, comma-joined, '' if none), n_passages; a row per input
    row.  What is set in a single line is a notice of ``scan_licenses``.

    A paragraph ends at a line without a letter or digit, so the bare comment signs of a source file end one too.
    """
    known = F.broadcast(known_licenses(docs.sparkSession, texts))
    raw = F.sha2("text", 256).alias("raw")
    several = F.filter(F.split("text", r"\n[^\p{L}\p{N}]*\n"), lambda p: F.contains(p, F.lit("\n")) & F.lower(p).rlike("|".join(KEYS)))
    rows = docs_of(docs)
    found = (rows.select("doc_id", raw, F.explode(several).alias("passage"))
             .select("doc_id", "raw", F.sha2(canonical(F.col("passage")), 256).alias("digest"))
             .join(known, "digest").groupBy("doc_id", "raw")
             .agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("passages"), F.count("*").alias("n_passages"))
             .select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"), "passages", "n_passages"))
    return (rows.select("doc_id", raw).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw")), "left")
            .select("doc_id", F.coalesce("passages", F.lit("")).alias("passages"), F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages")))
