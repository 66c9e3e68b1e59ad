"""License scan: canonical digests of entire texts, looked up among those of known license texts and notices.

Canonical form, line by line: A-Z lower-cased; lines that state a copyright dropped; equivalent spellings unified; all
that is no ASCII letter or digit turned into single spaces. Two units of every document are digested: the whole
text, and each line as a text of its own, since notices stand alone on a line. Digests are hash-joined to the known
ones. Known texts are few, so Spark sends them to every task when their measured size allows, and otherwise joins
by digest; lines leave their task only when joined.

Defined results: a null text, or one whose canonical form is empty, has no license; a known text with an empty
canonical form is left out; when two known texts share a digest, the first name in order counts; rows that share an id
are judged one by one, exact repeats alike. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices and license texts as their publishers word them.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
)
TEXTS = (
    (
        "MIT",
        """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
)
# Spellings that license texts use for one another.
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("noninfringement", "non infringement"),
    ("and/or", "and or"),
)
COPYRIGHT = r"^\W*(copyright\b|\(c\)|©|all rights reserved\b)"


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, without empty ones; null for null."""

    def canonical(line: Column) -> Column:
        for spelling, unified in SPELLINGS:
            line = F.replace(line, F.lit(spelling), F.lit(unified))
        return F.trim(F.regexp_replace(line, r"[^a-z0-9]+", " "))

    lines = F.split(F.lower(text), "\n", -1)
    stated = F.filter(lines, lambda line: ~line.rlike(COPYRIGHT))
    return F.array_remove(F.transform(stated, canonical), "")


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = NOTICES + TEXTS) -> DataFrame:
    """Rows (digest, license)."""
    listed = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in known])
    rows = spark.range(1).select(F.explode(listed).alias("k")).select("k.license", F.array_join(canonical_lines(F.col("k.text")), " ").alias("c"))
    return rows.where("c <> ''").groupBy(F.md5("c").alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, license (of the whole text), n_notices (lines that are known texts), licenses (sorted)."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    lined = source.select("id", "th", canonical_lines(F.col("text")).alias("lines"))
    units = F.concat(
        F.transform("lines", lambda line: F.struct(F.lit(0).alias("whole"), F.md5(line).alias("digest"))),
        F.array(F.struct(F.lit(1).alias("whole"), F.md5(F.array_join("lines", " ")).alias("digest"))),
    )
    # The outer form keeps the optimizer from making the units a second time to test for empty arrays. A text without
    # lines has the digest of the empty text, which no known text has.
    found = lined.select("id", "th", F.posexplode_outer(units).alias("place", "u"))
    found = found.select("id", "th", "place", "u.whole", "u.digest").join(known, "digest")
    # The place tells lines of a document apart, and makes exact repeats of a row count once.
    per_text = (
        found.select("id", "th", "place", "whole", "license")
        .distinct()
        .groupBy(F.col("id").alias("i"), F.col("th").alias("t"))
        .agg(
            F.min(F.when(F.col("whole") == 1, F.col("license"))).alias("license"),
            F.sum(1 - F.col("whole")).alias("n_notices"),
            F.array_sort(F.collect_set("license")).alias("licenses"),
        )
    )
    joined = source.select("id", "th").join(per_text, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "license",
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
    )
