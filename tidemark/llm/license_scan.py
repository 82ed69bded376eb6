"""Licence scan by sentence rules, in DataFrame operations only.

A text is cut into sentences twice: at line ends and sentence ends, and at
sentence ends and blank lines alone, for notices that are wrapped over lines.
A sentence, in lower case with every run of other characters than a-z and 0-9
as one space, is looked up among the known licence sentences; what remains of
a text is one sequence of identifiers for each way of cutting. Lines that hold
nothing but comment marks are blank; the full stop of "v. 2.0" ends nothing;
an address that a notice sets on a line of its own belongs to the sentence
before it; the first item of a list begins a sentence; and the holder that a
no-endorsement clause names is as good as any. A rule is an ordered sequence
of identifiers that must stand in one of the two without another known
sentence in between; what a longer rule has matched, a shorter one that is
part of it cannot match again. Known sentences are cut from the notices below
by the same patterns. All is one projection: no row is moved.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GPL = "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version.\n\n{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2}General Public License for more details."
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    {0}://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
_TO_FREEDOM = "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public {0} intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."
# Public licences and notices, as they are written; of long ones the sentences that tell them.
_NOTICES = {
    "mit-text": ("MIT", _MIT + ", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _MIT_WARRANTY),
    "mit-0-text": ("MIT-0", _MIT + ".\n\n" + _MIT_WARRANTY),
    "mit-line": ("MIT", "Released under the MIT License."),
    "mit-line-2": ("MIT", "Licensed under the MIT License."),
    "mit-line-3": ("MIT", "This project is licensed under the MIT License."),
    "isc-text": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "0bsd-text": ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "postgresql-text": ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    "bsd-2-text": ("BSD-2-Clause", _BSD),
    "bsd-3-text": ("BSD-3-Clause", _BSD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "zlib-text": ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    "bsl-text": ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    "bsl-line": ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    "apache-line": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "apache-header": ("Apache-2.0", _APACHE.format("http")),
    "apache-header-s": ("Apache-2.0", _APACHE.format("https")),
    "apache-text": ("Apache-2.0", """"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.\n\n"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."""),
    "gpl-2-header": ("GPL-2.0-or-later", _GPL.format("This program", ";", "", ";", "2")),
    "gpl-2-only-header": ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    "gpl-3-header": ("GPL-3.0-or-later", _GPL.format("This program", ":", "", ",", "3")),
    "gpl-2-text": ("GPL-2.0-only", _TO_FREEDOM.format("License is")),
    "gpl-3-text": ("GPL-3.0-only", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    "lgpl-2.1-header": ("LGPL-2.1-or-later", _GPL.format("This library", ";", "Lesser ", ";", "2.1")),
    "lgpl-3-header": ("LGPL-3.0-or-later", _GPL.format("This program", ":", "Lesser ", ",", "3")),
    "lgpl-3-library-header": ("LGPL-3.0-or-later", _GPL.format("This library", ";", "Lesser ", ";", "3")),
    "lgpl-2.1-text": ("LGPL-2.1-only", _TO_FREEDOM.format("Licenses are")),
    "lgpl-3-text": ("LGPL-3.0-only", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    "agpl-3-header": ("AGPL-3.0-or-later", _GPL.format("This program", ":", "Affero ", ",", "3")),
    "agpl-3-text": ("AGPL-3.0-only", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    "mpl-2-header": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "epl-1-header": ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    "epl-2-header": ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "cc0-line": ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    "ofl-line": ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    "wtfpl-text": ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    "artistic-2-text": ("Artistic-2.0", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."),
    "unlicense-text": ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    "unlicense-dedication": ("Unlicense", "This is free and unencumbered software released into the public domain."),
}
_TAGS = ("MIT", "MIT-0", "ISC", "0BSD", "Zlib", "BSL-1.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC0-1.0", "OFL-1.1", "Unlicense", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later")
#: Every known sentence holds one of these.
ANCHORS = ("licens", "permission", "redistribut", "copyright", "warrant", "unencumbered")
_MARKS = r"[ \t#*/;%'!<>|-]"
#: What is put for what before a text is cut, in this order; the same in every dialect.
_BEFORE = [
    ("\r\n?", "\n"),
    (r"\bv\.[^a-z0-9]+([0-9])", r"v \1"),
    (r"(license[^a-z0-9]+at)[^a-z0-9]+(https?://www\.apache\.org/licenses/license-2\.0)(\.txt|\.html)?([^a-z0-9]|$)", "\\1 \\2\n\n\\4"),
    (rf":[ \t]*\n{_MARKS}*([0-9]{{1,2}}[.)][ \t])", ":\n\n\\1"),
    ("([.!?])[ \t\n\f]+", "\\1\n\n"),
]
_SPLITS = ("\n+", rf"\n{_MARKS}*\n[\n{_MARKS[1:]}*")
_OTHER = "[^a-z0-9]+"
#: Whoever is named in a clause.
_AFTER = (r"^neither the name of .* nor the names of (its|their) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used")


def sentences_of(text: str, wrapped: bool = True) -> list[str]:
    """The normalised sentences of a text, as _cut gives them."""
    text = text.lower()
    for pattern, put in _BEFORE:
        text = re.sub(pattern, put, text)
    parts = re.compile(_SPLITS[wrapped]).sub("\0", text).split("\0")
    return [re.sub(*_AFTER, re.sub(_OTHER, " ", p).strip(" ")) for p in parts]


def known() -> tuple[dict[str, int], list[tuple[str, str, list[int], list[list[int]]]]]:
    """(identifier by normalised sentence, (rule, licence, identifiers, those of longer rules that hold them)): the notices above, and lines made for versions and tags."""
    notices = dict(_NOTICES)
    for name, versions in (("GPL", ("2", "3")), ("LGPL", ("2.1", "3")), ("AGPL", ("3",))):
        long = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}[name]
        for v in versions:
            notices[f"{name.lower()}-line-{v}"] = (f"{name}-{v if '.' in v else v + '.0'}-only", f"This work is licensed under the {long}, version {v}.")
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for v in ("2.0", "2.5", "3.0", "4.0"):
            notices[f"cc-{kind.lower()}-{v}"] = (f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}.")
    for tag in _TAGS:
        notices[f"tag-{tag}"] = (tag, f"SPDX-License-Identifier: {tag}")
    number: dict[str, int] = {}
    rules = []
    for rule, (licence, text) in notices.items():
        ids = [number.setdefault(s, len(number) + 1) for s in sentences_of(text) if any(a in s for a in ANCHORS)]
        assert ids, rule
        rules.append((rule, licence, ids))
    within = lambda a, b: len(a) < len(b) and any(b[i : i + len(a)] == a for i in range(len(b)))
    assert len({tuple(ids) for _, _, ids in rules}) == len(rules)
    return number, [(r, lic, ids, sorted((b for _, _, b in rules if within(ids, b)), key=len, reverse=True)) for r, lic, ids in rules]


def _joined(ids: list[int]) -> str:
    return "".join(f",{i}," for i in ids)


def _cut(text: Column, wrapped: bool) -> Column:
    """Normalised sentences of a text in lower case; lines end sentences unless wrapped."""
    for pattern, put in _BEFORE:
        text = F.regexp_replace(text, pattern, re.sub(r"\\([0-9])", r"$\1", put))
    plain = lambda s: F.trim(F.regexp_replace(s, _OTHER, " "))
    return F.transform(F.split(text, _SPLITS[wrapped]), lambda s: F.regexp_replace(plain(s), *_AFTER))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: n_known (known sentences, the better way of cutting), sequence (their identifiers), rules and licenses (sorted, comma-joined).

    Defined results: null and empty texts have no sentences; rows that repeat,
    ids included, stay rows of their own; an empty table gives no rows; other
    columns of docs are not returned.
    """
    number, rules = known()
    base = docs.select(F.col(id_col).alias("__id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    anchored = lambda x: F.rlike(x, F.lit("|".join(ANCHORS)))
    table = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    none = F.array().cast("array<int>")
    # texts without such a word are not cut, sentences without one not looked up
    found = lambda k: F.when(anchored(F.col("t")), F.filter(F.transform(F.filter(_cut(F.col("t"), bool(k)), anchored), lambda s: F.try_element_at(table, s)), lambda n: n.isNotNull())).otherwise(none)
    seen = base.select("__id", found(0).alias("seen0"), found(1).alias("seen1"))
    text = lambda k: F.array_join(F.transform(f"seen{k}", lambda n: F.concat(F.lit(","), n.cast("string"), F.lit(","))), "")
    cut = seen.select("__id", F.size("seen0").alias("n0"), F.size("seen1").alias("n1"), text(0).alias("q0"), text(1).alias("q1"))
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(lic).alias("license"), F.lit(_joined(ids)).alias("q"), F.array(*[F.lit(_joined(b)) for b in over]).cast("array<string>").alias("over")) for r, lic, ids, over in rules])
    left = lambda q, r: F.aggregate(r["over"], q, lambda t, longer: F.replace(t, longer, F.lit(";")))
    hits = F.when(F.col("n0") + F.col("n1") > 0, F.filter(listed, lambda r: F.contains(left(F.col("q0"), r), r["q"]) | F.contains(left(F.col("q1"), r), r["q"])))
    cut = cut.withColumn("hits", hits)
    names = lambda f: F.coalesce(F.array_join(F.sort_array(F.array_distinct(F.transform("hits", lambda h: h[f]))), ","), F.lit(""))
    best = F.when(F.col("n1") > F.col("n0"), F.col("q1")).otherwise(F.col("q0"))
    return cut.select(F.col("__id").alias(id_col), F.greatest("n0", "n1").cast("long").alias("n_known"), F.replace(F.trim(best, F.lit(",")), F.lit(",,"), F.lit(",")).alias("sequence"), names("rule").alias("rules"), names("license").alias("licenses"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the licences that each document of `documents` names or quotes."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    number, rules = known()
    text = lambda x: "'" + x.replace("'", "''") + "'" if "\n" not in x else " || ".join("chr(10)" if p == "\n" else text(p) for p in re.split("(\n)", x) if p)
    values = lambda rows: ", ".join("(" + ", ".join(text(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    cut = "lower(coalesce(text, ''))"
    for pattern, put in _BEFORE:
        pattern = pattern.replace("\r", "\\r").replace("\n", "\\n").replace("\t", "\\t").replace("\f", "\\f")
        cut = f"regexp_replace({cut}, {text(pattern)}, {text(put)}, 'g')"
    splits = [text(x.replace("\n", "\\n").replace("\t", "\\t")) for x in _SPLITS]
    depth = max(len(over) for *_, over in rules)
    left = "q.q"
    for i in range(depth):
        left = f"replace({left}, rule.o{i}, ';')"
    listed = [(r, lic, _joined(ids), *[_joined(over[i]) if i < len(over) else "~" for i in range(depth)]) for r, lic, ids, over in rules]
    return rf"""
WITH known(s, number) AS (VALUES {values(number.items())}),
rule(rule, license, q, {", ".join(f"o{i}" for i in range(depth))}) AS (VALUES {values(listed)}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {cut} AS t FROM documents),
c AS (SELECT rid, 0 AS k, string_split_regex(t, {splits[0]}) AS parts FROM d UNION ALL SELECT rid, 1 AS k, string_split_regex(t, {splits[1]}) AS parts FROM d),
p AS (SELECT rid, k, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM c),
f AS (SELECT rid, k, pos, number FROM (SELECT rid, k, pos, regexp_replace(trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')), {text(_AFTER[0])}, {text(_AFTER[1])}) AS s FROM p) x JOIN known ON x.s = known.s),
q AS (SELECT rid, k, count(*) AS n, string_agg(',' || CAST(number AS VARCHAR) || ',', '' ORDER BY pos) AS q FROM f GROUP BY rid, k),
hit AS (SELECT DISTINCT rid, rule.rule, license FROM q JOIN rule ON contains({left}, rule.q)),
r AS (SELECT rid, string_agg(rule, ',' ORDER BY rule) AS rules FROM (SELECT DISTINCT rid, rule FROM hit) GROUP BY rid),
l AS (SELECT rid, string_agg(license, ',' ORDER BY license) AS licenses FROM (SELECT DISTINCT rid, license FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(greatest(coalesce(q0.n, 0), coalesce(q1.n, 0)) AS BIGINT) AS n_known,
  replace(trim(CASE WHEN coalesce(q1.n, 0) > coalesce(q0.n, 0) THEN q1.q ELSE coalesce(q0.q, '') END, ','), ',,', ',') AS sequence, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN (SELECT * FROM q WHERE k = 0) q0 ON d.rid = q0.rid LEFT JOIN (SELECT * FROM q WHERE k = 1) q1 ON d.rid = q1.rid LEFT JOIN r ON d.rid = r.rid LEFT JOIN l ON d.rid = l.rid
"""


SQL = _sql()
