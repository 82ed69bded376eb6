"""Every licence rule fires on the notice as it is published, plain and in comments."""

import oracle
import pytest
from pyspark.sql import functions as F

from tidemark.llm import license_scan as L

BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
GPL = '''it under the terms of the GNU General Public License as published by
the Free Software Foundation{0} either version {1} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    {0}://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''
NOTICES = {
    "mit-text": '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
''',
    "isc-text": '''Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
''',
    "bsd-2-text": BSD,
    "bsd-3-text": BSD + '''3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
''',
    "apache-header": APACHE.format("http"),
    "apache-header-s": APACHE.format("https"),
    "gpl-2-header": "This program is free software; you can redistribute it and/or modify\n" + GPL.format(";", 2),
    "gpl-3-header": "This program is free software: you can redistribute it and/or modify\n" + GPL.format(",", 3),
    "mpl-2-header": '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
''',
    "unlicense-dedication": '''This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
''',
    "lgpl-2.1-header": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
""",
    "agpl-3-header": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.
""",
    "zlib-text": """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented;
""",
    "epl-2-header": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
""",
    "gpl-3-text": """  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  The licenses for most software and other practical works are designed
to take away your freedom to share and change the works.
""",
    "gpl-2-text": """  The licenses for most software are designed to take away your
freedom to share and change it.  By contrast, the GNU General Public
License is intended to guarantee your freedom to share and change free
software--to make sure the software is free for all its users.  This
""",
    "lgpl-3-text": """  This version of the GNU Lesser General Public License incorporates
the terms and conditions of version 3 of the GNU General Public
License, supplemented by the additional permissions listed below.
""",
}


NUMBERS, RULES = L.known()


def commented(text, mark):
    return "\n".join(f"{mark} {x}".rstrip() if mark else x for x in f"Copyright 2020 A. Person\n\n{text}\n\nimport x".split("\n"))


@pytest.mark.parametrize("mark", ["", "#", " *", "//", ";;", "--"])
def test_every_rule_fires_on_its_notice_and_no_other(docs, mark):
    sentences = {n: s for s, n in NUMBERS.items()}
    texts = NOTICES | {r: "\n".join(sentences[i] for i in ids) for r, _, ids, _ in RULES if r not in NOTICES}
    assert set(texts) == {r for r, *_ in RULES}
    got = {r["doc_id"]: r for r in L.scan(docs([(i, commented(texts[r[0]], mark)) for i, r in enumerate(RULES)])).collect()}
    assert [r for i, (r, lic, *_) in enumerate(RULES) if (got[i]["rules"], got[i]["licenses"]) != (r, lic)] == []


def test_known_sentences_survive_their_own_cutting(spark):
    rows = [(i, s + end) for i, s in enumerate(NUMBERS) for end in ("", ".", ".\n")]
    df = spark.createDataFrame(rows, "i int, t string")
    for wrapped in (False, True):
        for r, (_, t) in zip(df.select("i", L._cut(F.col("t"), wrapped).alias("c")).collect(), rows):
            assert [x for x in r["c"] if x] == [list(NUMBERS)[r["i"]]] and [x for x in L.sentences_of(t, wrapped) if x] == [x for x in r["c"] if x]


def test_both_cuts_are_one(spark):
    """The notices' cut and the texts' cut give the same sentences."""
    texts = [commented(t, mark).lower() for _, t in L._NOTICES.values() for mark in ("", "#", " *")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for wrapped in (False, True):
        for r, t in zip(df.select(L._cut(F.col("t"), wrapped).alias("c")).collect(), texts):
            assert [x for x in r["c"] if x] == [x for x in L.sentences_of(t, wrapped) if x]


def test_longer_rules_absorb_shorter_ones(docs):
    three = NOTICES["bsd-3-text"]
    other = three.replace("the copyright holder nor", "the Regents of X, Y and Z nor")
    rows = [(1, three), (2, other), (3, BSD), (4, f"{three}\n\n{BSD}"), (5, f"{BSD}\n\nNotes.\n\n{three}")]
    got = {r["doc_id"]: r["licenses"] for r in L.scan(docs(rows)).collect()}
    assert got == {1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: "BSD-2-Clause", 4: "BSD-2-Clause,BSD-3-Clause", 5: "BSD-2-Clause,BSD-3-Clause"}


def test_the_sql_agrees_on_notices(spark, tmp_path):
    """What the query gives for notices, its SQL gives too."""
    rows = [(i, commented(t, mark)) for i, (t, mark) in enumerate((t, mark) for t in [*NOTICES.values(), None, "", "plain"] for mark in ("", "#", " *"))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    oracle.check(spark, L.query, L.SQL, str(tmp_path))


def test_very_long_texts(docs):
    rows = [(1, "prose without end. " * 200_000), (2, "licensed " * 100_000), (3, "license at " * 50_000 + "\n\n" + NOTICES["isc-text"]), (4, "# \n" * 200_000 + NOTICES["mpl-2-header"])]
    assert {r["doc_id"]: r["licenses"] for r in L.scan(docs(rows)).collect()} == {1: "", 2: "", 3: "ISC", 4: "MPL-2.0"}
