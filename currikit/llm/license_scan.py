"""Licence scans: cosine to templates, then the nearest directory above."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from currikit.llm.common import SPACE, WORD, checkpointed, let

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HOLDERS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_GNU_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see http://www.gnu.org/licenses/."
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_REST = " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_GENERAL, _LESSER, _AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
#: Public licences' texts and notices, several wordings each.
TEMPLATES = (
    ("AGPL-3.0", f"This work is licensed under the GNU {_AFFERO}, version 3."),
    ("AGPL-3.0", _GNU.format(_AFFERO)),
    ("AGPL-3.0", _GNU.format(_AFFERO) + _GNU_REST.format(_AFFERO)),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", f"{_BSD} {_HOLDERS}"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_HOLDERS}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", f"This work is licensed under the GNU {_GENERAL}, version 3."),
    ("GPL-3.0", _GNU.format(_GENERAL)),
    ("GPL-3.0", _GNU.format(_GENERAL) + _GNU_REST.format(_GENERAL)),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-3.0", f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU {_LESSER}, version 3."),
    ("LGPL-3.0", _GNU.format(_LESSER) + _GNU_REST.format(_LESSER)),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", f"MIT License {_MIT} {_AS_IS}"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", f"{_MPL} If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + _UNLICENSE_REST),
)
#: What a text must have at all to be read for notices (a line may break within), and the words by which its windows are placed.
CUES = r"(?i)licen[sc]e|spdx|copyright|public\W{1,8}domain|permission\W{1,8}is\W{1,8}hereby|is\W{1,8}hereby\W{1,8}granted|redistribution\W{1,8}and\W{1,8}use"
CUE_WORDS = r"(?i)licen[sc]e|spdx|copyright|domain|hereby|redistribution"
#: Words before and after a cue word in its windows. In a run of cue words every so many are taken.
WIDTHS, RUN = (0, 3, 8, 20, 45), 4
#: Where one paragraph ends and the next begins.
BLANK_LINE = r"\n[^\n\p{L}\p{N}]*\n"
FILE_NAMES = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
#: Least cosine of a header, and the share of a text's words, in percent, that makes a text without such a name a licence file.
LEAST_COSINE, FILE_PERCENT = 0.6, 10
#: Tasks among which a directory's files are dealt.
SALTS = 32


def terms_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _windows(text: Column) -> Column:
    """Windows of words around the cue words of a text, across its lines."""

    def around(words: Column) -> Column:
        cue = lambda k: F.coalesce(F.rlike(F.get(words, k), F.lit(CUE_WORDS)), F.lit(False))
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda k: cue(k) & ((k % RUN == 0) | ~cue(k - 1)))
        first = lambda k, a: F.greatest(k - a, F.lit(0))
        window = lambda k, a, b: F.array_join(F.slice(words, first(k, a) + 1, k - first(k, a) + b + 1), " ")
        return F.flatten(F.transform(places, lambda k: F.array(*(window(k, a, b) for a in WIDTHS for b in WIDTHS))))

    return let(F.split(text, SPACE), around)


VOCABULARY = sorted({t for _, text in TEMPLATES for t in terms_of(text)})


def _match(headers: DataFrame, n_files: int, frequency: dict[str, int]) -> DataFrame:
    """The best template and piece for each file of ``(file, piece, terms, others)``: cosine of TF-IDF vectors.

    The templates' terms, which bound both sides of the join, weigh by their
    document frequencies. ``others``, a piece's number of terms that no template
    has, lengthen its vector: each weighs as the templates' terms do in the median.
    """
    from math import log
    from statistics import median

    idf = {t: log((1 + n_files) / (1 + frequency.get(t, 0))) + 1 for t in VOCABULARY}
    rows = []
    for k, (name, text) in enumerate(TEMPLATES):
        tf = terms_of(text)
        norm = sum((tf.count(t) * idf[t]) ** 2 for t in set(tf)) ** 0.5
        rows += [(t, k, name, tf.count(t) * idf[t] * idf[t] / norm) for t in sorted(set(tf))]
    spark = headers.sparkSession
    small = lambda names, values: F.broadcast(spark.createDataFrame(pa.table(dict(zip(names, zip(*values), strict=True)))))  # noqa: E731  as many rows as the templates have terms
    weights = small(("term", "template", "licence", "weight"), rows)
    idfs = small(("term", "idf"), idf.items())
    other = median(idf.values())
    key = ["file", "piece"]
    terms = headers.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf")).join(idfs, "term")
    squares = terms.groupBy(*key).agg(F.sum(F.col("tf") * F.col("tf") * F.col("idf") * F.col("idf")).alias("square"))
    norms = squares.join(headers.select(*key, "others"), key).select(*key, F.sqrt(F.col("square") + F.col("others") * (other * other)).alias("norm"))
    dots = terms.join(weights, "term").groupBy(*key, "template", "licence").agg(F.sum(F.col("tf") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, key).select(*key, "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score"), "template")
    return scored.groupBy("file").agg(F.max_by(F.struct("licence", "score", "piece"), F.struct("score", -F.col("piece"), -F.col("template"))).alias("best")).select("file", "best.*")


def license_scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", least_cosine: float = LEAST_COSINE, file_percent: int = FILE_PERCENT) -> DataFrame:
    """The licence of each row of files: ``(doc_id, path, license, score, origin, licensed_dir)``.

    A licence file by name is one piece. Of another text with a cue anywhere
    the pieces are its header, which is all before the first blank line, its
    paragraphs with a cue, all together and one by one, and windows of words
    around each cue word, across lines, so that wrapped notices and those within
    long lines count as well. A piece's TF-IDF vector over all its terms, with document
    frequencies of the templates' terms over all whole texts, is held against
    each template; the best cosine over all pieces, of ``least_cosine`` or more,
    is the file's own licence (origin ``header``, or ``file`` for a licence
    file: one by name, or a text of which the best piece is ``file_percent`` of
    the words). Other files take the licence of the nearest directory at or above
    theirs that holds a licence file (origin ``inherited``; several there: the
    best score, then the first name). Otherwise license, score and licensed_dir
    are null and origin is ``none``.

    Directories, not files, are joined with those above them, so a directory
    with any share of all files is one row there. A null or empty text has no
    header; a null path has no directory above; a null id stays null; equal
    rows give equal rows; other columns are ignored; an empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), text.alias("text")).withColumn("named", F.coalesce(F.rlike("path", F.lit(FILE_NAMES)), F.lit(False)))
    cued = F.rlike("text", F.lit(CUES))

    def blocks(paragraphs: Column) -> Column:
        speaking = let(F.filter(paragraphs, lambda x: F.rlike(x, F.lit(CUES))), lambda xs: F.concat(F.array(F.array_join(xs, "\n")), xs))
        return F.concat(F.slice(paragraphs, F.lit(1), F.lit(1)), speaking)

    pieces = F.when(F.col("named"), F.array("text")).when(cued, F.array_distinct(F.concat(let(F.split("text", BLANK_LINE), blocks), _windows(F.col("text"))))).otherwise(F.array().cast("array<string>"))
    known = F.array(*map(F.lit, VOCABULARY))
    present = F.array_intersect(known, F.split(F.lower("text"), "[^a-z0-9]+"))
    count = lambda x: F.regexp_count(x, F.lit(WORD))
    row_hash = lambda *c: F.xxhash64(*c, "doc_id", "path", "text")
    facts = rows.select(
        "doc_id",
        "path",
        "named",
        present.alias("present"),
        F.transform(pieces, lambda p: let(_terms(p), lambda ts: let(F.filter(ts, lambda t: F.array_contains(known, t)), lambda mine: F.struct(mine.alias("terms"), (F.size(ts) - F.size(mine)).alias("others"), count(p).alias("n"))))).alias("pieces"),
        count(F.col("text")).alias("n_words"),
        F.regexp_replace("path", "/?[^/]*$", "").alias("dir"),
        F.struct(row_hash().alias("a"), row_hash(F.lit("second")).alias("b")).alias("file"),
    )
    facts = checkpointed(facts)  # terms and paths only
    n_files = facts.count()
    frequency = {r[0]: r[1] for r in facts.select(F.explode("present").alias("t")).groupBy("t").count().collect()}  # a row a term of the templates
    read = facts.dropDuplicates(["file"]).select("file", F.posexplode("pieces").alias("piece", "p")).select("file", "piece", "p.terms", "p.others").where(F.size("terms") > 0)
    best = _match(read, n_files, frequency).where(F.col("score") >= least_cosine)
    mostly = F.get(F.col("pieces"), F.col("piece"))["n"] * 100 >= F.col("n_words") * file_percent
    found = facts.select("doc_id", "path", "dir", "file", "named", "n_words", "pieces").join(best, "file", "left").withColumn("is_file", F.col("licence").isNotNull() & (F.col("named") | mostly))
    own = checkpointed(found.drop("pieces", "n_words", "piece"))

    better = F.struct((-F.col("score")).alias("s"), F.col("licence").alias("l"))
    holders = own.where("is_file AND dir IS NOT NULL").groupBy("dir").agg(F.min(better).alias("b")).select(F.col("dir").alias("above"), F.col("b.l").alias("d_licence"), (-F.col("b.s")).alias("d_score"))
    dirs = own.where("licence IS NULL AND dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    nearest = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above")).join(holders, "above").groupBy("dir").agg(F.max_by(F.struct("above", "d_licence", "d_score"), F.length("above")).alias("n")).select("dir", "n.*")
    # a directory may hold any share of the files: its files are dealt to several tasks, each with the directory's row
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = own.withColumn("salt", F.pmod(F.col("file.a"), F.lit(SALTS)).cast("int")).join(salted, ["dir", "salt"], "left")
    has = F.col("licence").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("licence", "d_licence").alias("license"),
        F.coalesce("score", "d_score").alias("score"),
        F.when(F.col("is_file"), "file").when(has, "header").when(F.col("above").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("is_file"), F.col("dir")).when(~has, F.col("above")).alias("licensed_dir"),
    )

