import re
from collections import Counter
from math import log
from statistics import median

import pytest
from pyspark.sql import functions as F

from currikit.llm import queries
from currikit.llm.license_scan import TEMPLATES, license_scan


def terms_of(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def weights(texts):
    df = Counter(t for x in texts for t in set(terms_of(x)))
    return {t: log((1 + len(texts)) / (1 + df[t])) + 1 for t in {t for _, x in TEMPLATES for t in terms_of(x)}}


def plain_pieces(text):
    """Header, paragraphs with a cue (together and each), and windows of words around cue words; the cues as the operator's docstring means them."""
    cue = re.compile(r"licen[sc]e|spdx|copyright|public\W{1,8}domain|(permission\W{1,8})?is\W{1,8}hereby(\W{1,8}granted)?|redistribution\W{1,8}and\W{1,8}use", re.I | re.A)
    strict = lambda x: any(m[1] or m[2] or "hereby" not in m[0].lower() for m in cue.finditer(x))
    if not strict(text):
        return []
    paragraphs = re.split(r"\n[^\n\w]*\n", text)
    mine = [p for p in paragraphs if strict(p)]
    out = [paragraphs[0], "\n".join(mine), *mine]
    words = re.split("[ \t\n\x0b\x0c\r]+", text)
    hits = [bool(re.search("licen[sc]e|spdx|copyright|domain|hereby|redistribution", w, re.I)) for w in words]
    for k, hit in enumerate(hits):
        if hit and (k % 4 == 0 or not (k and hits[k - 1])):
            out += [" ".join(words[max(0, k - a) : k + b + 1]) for a in (0, 3, 8, 20, 45) for b in (0, 3, 8, 20, 45)]
    return out


def plain_best(text, idf):
    other = median(idf.values())
    best = (0, None)
    for piece in plain_pieces(text):
        tf = Counter(terms_of(piece))
        norm = (sum((n * idf[t]) ** 2 for t, n in tf.items() if t in idf) + sum(n for t, n in tf.items() if t not in idf) * other * other) ** 0.5
        for name, template in TEMPLATES:
            v = {t: n * idf[t] for t, n in Counter(terms_of(template)).items()}
            dot = sum(n * idf[t] * v.get(t, 0) for t, n in tf.items() if t in idf)
            if dot:
                best = max(best, (round(dot / norm / sum(x * x for x in v.values()) ** 0.5, 6), name), key=lambda x: x[0])
    return best


def files(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("term", F.lit("clash"))


def test_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    body = "\n".join("words of a text that says nothing of rights." for _ in range(30))
    rows = [
        (1, "a/LICENSE", mit),
        (2, "a/b/COPYING.txt", apache),
        (3, "a/x.py", body),
        (4, "a/b/c/d/y.py", body),
        (5, "a/b/z.py", f"{body}\n{mit}\n{body}"),
        (6, "other/w.py", body),
        (7, None, body),
        (8, "a/b2/v.py", None),
        (8, "a/b2/v.py", None),
        (None, "top.py", ""),
        (9, "ab/c.py", body),
    ]
    got = sorted(((r.doc_id or -1), r.license, r.origin, r.licensed_dir) for r in license_scan(files(spark, rows), F.col("path")).collect())
    assert got == [
        (-1, None, "none", None),
        (1, "MIT", "file", "a"),
        (2, "Apache-2.0", "file", "a/b"),
        (3, "MIT", "inherited", "a"),
        (4, "Apache-2.0", "inherited", "a/b"),
        (5, "MIT", "header", None),
        (6, None, "none", None),
        (7, None, "none", None),
        (8, "MIT", "inherited", "a"),
        (8, "MIT", "inherited", "a"),
        (9, None, "none", None),
    ]
    assert license_scan(files(spark, []), F.col("path")).collect() == []


def test_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op5_license_scan(spark, "/root/testdata/sf0.01").collect()}
    assert rows.keys() == texts.keys()
    found, idf = 0, weights(list(texts.values()))
    for i, text in texts.items():
        score, name = plain_best(text, idf)
        own = rows[i].origin in ("file", "header")
        assert own == (score >= 0.6)
        if own:
            found += 1
            assert rows[i].license == name and rows[i].score == pytest.approx(score, abs=2e-6)
    assert found > 20


def test_wrapped_and_within_long_lines(spark):
    """A notice counts where its lines are wrapped, and within a line of other words, which isn't a licence file for that."""
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"
    free = "# This is free and unencumbered software released into the public\n# domain."
    prose = " ".join("the terms of use and the work of any person in this form are free to you and to a copy of it".split() * 12)
    plain_prose = "the weather of this and that day was to be the best for a walk\n" * 40
    rows = [(1, "a/1.txt", f"{mpl}\n{plain_prose}"), (2, "b/2.txt", f"{free}\n{plain_prose}"), (3, "c/3.txt", f"{prose} Released under the MIT License. {prose}"), (4, "c/4.txt", prose), (5, "d/5.txt", f"{prose} a driver must carry a license at all times {prose}")]
    got = {r.doc_id: (r.license, r.origin) for r in license_scan(files(spark, rows), F.col("path")).collect()}
    assert [got[1][0], got[2][0]] == ["MPL-2.0", "Unlicense"]
    assert [got[3], got[4], got[5]] == [("MIT", "header"), (None, "none"), (None, "none")]


def test_other_licences_and_whole_texts(spark):
    """A licence that words outside the notice's change is not taken for its namesake; whole texts are told apart."""
    whole = dict((name, text) for name, text in TEMPLATES if len(text) > 600)
    plain_prose = "the weather of this and that day was to be the best for a walk\n" * 40
    rows = [
        (1, "a/1.txt", f"# Licensed under the GNU Affero General Public\n# License, version 3.\n\n{plain_prose}"),
        (2, "b/2.txt", f"/*\n * Copyright 2020 Somebody Else\n *\n * {whole['BSD-3-Clause']}\n */\n{plain_prose}"),
        (3, "c/LICENSE", f"Copyright (c) 2021 Some Person\n\n{whole['MIT']}"),
        (4, "d/4.txt", f"Copyright 2019 A. Person\n\n{whole['ISC']}\n\n{plain_prose}"),
        (5, "e/5.txt", f"Copyright 2019 A. Person. All of the work is mine, and a license must be asked for by letter.\n\n{plain_prose}"),
        (6, "f/6.txt", f"{whole['BSD-2-Clause']}\n\n{plain_prose}"),
        (7, "g/7.txt", f"{plain_prose}\n// Copyright 2012 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\n{plain_prose}"),
    ]
    got = {r.doc_id: r.license for r in license_scan(files(spark, rows), F.col("path")).collect()}
    assert got == {1: "AGPL-3.0", 2: "BSD-3-Clause", 3: "MIT", 4: "ISC", 5: None, 6: "BSD-2-Clause", 7: "BSD-3-Clause"}
