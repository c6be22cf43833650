"""License scans: texts that say the same have one canonical digest, which is joined with those of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known licence texts, and statements that name a licence.
LICENSES = (
    ("MIT", """MIT License
Copyright (c) <year> <copyright holders>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License
Copyright (c) <year> <owner>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """BSD Zero Clause License
Copyright (c) <year> <owner>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Copyright (c) <year> <owner>
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Copyright (c) <year> <owner>
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""),
)
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("proprietary", "All rights reserved."),
)
# Spellings that count as one, as patterns and what takes their place, in order. Known texts are written so
# too, so a rule may also change words that it was not made for.
SPELLINGS = (
    (r"(\w)is(e|es|ed|ing|ation|ations)\b", "$1iz$2"),
    (r"our\b", "or"),
    (r"ogue\b", "og"),
    (r"ence(s|d)?\b", "ense$1"),
    (r"dgement\b", "dgment"),
    (r"ll(ed|ing)\b", "l$1"),
    (r"\bsub (license)", "sub$1"),
    (r"\bnon (infringement|commercial|exclusive)", "non$1"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bhttps\b", "http"),
)
# MD5 of the canonical texts of long licences.
DIGESTS = (
    ("Apache-2.0", "b951fe2f7db8aead131def500e09b5b7"),
    ("CC0-1.0", "0b7e59216b1c06911450ab8bc74519c4"),
    ("GFDL-1.3", "8447b66469bfca7aead6379e4d7396d7"),
    ("GPL-1.0", "839654f088adc29343ff768976f45bac"),
    ("GPL-2.0", "9553f6636f6a26d6df2d5d49bfbc8722"),
    ("GPL-3.0", "d0a176a3aa79342fd246ef0961e5f0c4"),
    ("LGPL-2.0", "38255d7d6108eb97843ef880b0b0ab8b"),
    ("LGPL-2.1", "e3e043f806acb1162374abd40ef853d9"),
    ("LGPL-3.0", "8b41c31bc087368d6409990d5b6a5712"),
    ("MPL-1.1", "c21f07b297f1c75c6cadd69623073dc8"),
    ("MPL-2.0", "fe2f0ab120bd49ea631be9339a312366"),
)

#: A line that only says whose work it is: a word or sign of copyright and a year or what stands for one. Lines are canonical here.
HOLDER_LINE = (
    r"^(portions )?(copyright|c)( copyright| c)*( by)? ([0-9]{4}|year|yyyy)\b.*$"
    r"|^all rights reserved$"
)
#: A line that only names a licence which is as well known without it.
TITLE_LINE = (
    r"^(the )?(mit|isc|0bsd|bsd|bsd [023] clause|bsd zero clause|zero clause bsd|(simplified|new|modified|revised) bsd) license"
    r"( mit| isc| bsd| x11| expat)*$"
)
LEFT_OUT = f"{HOLDER_LINE}|{TITLE_LINE}"


def canonical_lines(text: Column) -> Column:
    """The lines of a text in lower case, marks as blanks, blanks as one, spellings as one; without empty lines."""
    words = F.regexp_replace(F.replace(F.lower(text), F.lit("©"), F.lit(" copyright ")), r"[^\p{L}\p{N}\n]+", " ")
    for spelling, usual in SPELLINGS:
        words = F.regexp_replace(words, spelling, usual)
    return F.filter(F.transform(F.split(words, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def canonical_text(lines: Column) -> Column:
    """All lines as one, however they are wrapped, without those that only name the holder or the licence."""
    return F.concat_ws(" ", F.filter(lines, lambda line: ~line.rlike(LEFT_OUT)))


def known(spark: SparkSession, entries, whole: bool = True) -> DataFrame:
    """`license, digest` of whole texts, or of single lines. The list is a constant of this module or the caller's, and small either way."""
    rows = spark.createDataFrame(list(entries), "license string, text string")
    lines = canonical_lines(F.col("text"))
    text = canonical_text(lines) if whole else F.concat_ws(" ", lines)
    return rows.select("license", F.md5(text.cast("binary")).alias("digest")).distinct()


def scan(docs: DataFrame, licenses=LICENSES, notices=NOTICES, digests=DIGESTS) -> DataFrame:
    """`doc_id, license, n_notices, notices` for each row of `docs` (`doc_id, text`).

    license: the known licence that the whole text is, by its text or its digest, else NULL (of equal digests the first
    name). A title, holders, wrapping, marks, case and spellings make no difference. notices: licences that
    whole lines of it state, distinct and in order, joined by commas; n_notices counts the lines. NULL and empty texts have
    neither. Rows and ids may repeat, ids may be NULL; equal texts get equal results. The known digests are constants, so
    their table is broadcast.
    """
    names = sorted({name for name, _ in (*licenses, *notices, *digests)})
    spark = docs.sparkSession
    number = F.array_position(F.array(*(F.lit(name) for name in names)), F.col("license"))
    texts = known(spark, licenses).unionByName(spark.createDataFrame(list(digests), "license string, digest string"))
    kinds = [
        entries.select("digest", F.lit(whole).alias("whole"), number.alias("number"))
        .groupBy("digest", "whole").agg(F.min("number").alias("number"))
        for entries, whole in ((texts, True), (known(spark, notices, whole=False), False))
    ]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", canonical_lines(F.coalesce("text", F.lit(""))).alias("lines")
    )
    digest = lambda text, whole: F.struct(F.lit(whole).alias("whole"), F.md5(text.cast("binary")).alias("digest"))
    own = F.array(digest(canonical_text(F.col("lines")), True))
    each = rows.select("row", "doc_id", F.explode(F.concat(own, F.transform("lines", lambda line: digest(line, False)))).alias("one"))
    each = each.select("row", "doc_id", "one.whole", "one.digest")
    # The lines of a text are rows of one task only: they are added up there, and one row for each text is shuffled.
    joined = each.join(F.broadcast(kinds[0].unionByName(kinds[1])), ["digest", "whole"], "left")
    stated = F.when(~F.col("whole"), F.col("number"))
    found = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max(F.when(F.col("whole"), F.col("number"))).alias("license"),
        F.count(stated).alias("n_notices"), *(F.max(stated == k + 1).alias(f"n{k}") for k in range(len(names))),
    )
    listed = F.array(*(F.when(F.col(f"n{k}"), F.lit(name)) for k, name in enumerate(names)))
    name_of = F.get(F.array(*(F.lit(name) for name in names)), F.col("license").cast("int") - 1)
    return found.select("doc_id", name_of.alias("license"), "n_notices", F.array_join(F.array_compact(listed), ",").alias("notices"))
