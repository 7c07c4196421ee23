"""op6 on hand-made texts and against its DuckDB twin."""

import re
import textwrap

import duckdb

from docmill.llm import license_scan as L

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_texts(spark):
    rows = [
        (1, MIT, 4, "MIT", True),
        (2, "Prose here. Released under the MIT License.\nAll rights reserved.", 2, "MIT+proprietary", False),
        (3, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", 3, "Apache-2.0", True),
        (4, "Nothing of the kind. Licences are discussed, released under the MIT license they are not", 0, "", None),
        (5, None, 0, "", None),
        (6, "", 0, "", None),
        (7, "Licensed under CC BY-NC 4.0.\n" * 3000, 3000, "CC-BY-NC-4.0", False),
        (None, "Licensed under the Apache License, Version 2.0.", 1, "Apache-2.0", True),
    ]
    df = spark.createDataFrame([(r[0], r[1], 9) for r in rows], "doc_id long, text string, licenses int")
    got = {r.doc_id: (r.n_license_sentences, r.licenses, r.reusable) for r in L.scan(df).collect()}
    assert got == {r[0]: r[2:] for r in rows}
    assert L.scan(df.limit(0)).collect() == []


def test_equals_sql_and_runs_no_python(spark):
    d = "/root/testdata/sf0.01"
    df = L.query(spark, d)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(con.sql(L.oracle()).fetchall())
    assert sorted(map(tuple, df.collect())) == want
    assert sum(r[3] for r in want) > 10


GPL = """    {0}
    This program is free software{1} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version.

    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
BSD = """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
NAME = "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def wrapped(text, mark=""):
    return "\n".join(textwrap.fill(p, 78, initial_indent=mark, subsequent_indent=mark) if p.strip() else mark for p in text.split("\n"))


LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Lesser General Public License for more details."""
AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/

SPDX-License-Identifier: EPL-2.0"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
TEXTS = {
    "MIT": (MIT, 4),
    "GPL-2.0-or-later": (GPL.format("A program.", ";", ";", 2), 5),
    "GPL-3.0-or-later": (GPL.format("A program", ":", ",", 3), 4),
    "MPL-2.0": (MPL, 1),
    "BSD-2-Clause": (BSD, 3),
    "BSD-3-Clause": (BSD + NAME, 4),
    "LGPL-2.1-or-later": (LGPL, 4),
    "AGPL-3.0-or-later": (AGPL, 2),
    "Apache-2.0": (APACHE, 4),
    "EPL-2.0": (EPL, 3),
    "BSL-1.0": (BOOST, 1),
    "Zlib": (ZLIB, 2),
    "ISC": ("x.c\n\nSPDX-License-Identifier: ISC\n\ncode", 2),
}
TEXTS |= {
    "GPL-3.0": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation\n\n The GNU General Public License is a free, copyleft license for software and other kinds of works.", 2),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\n Preamble", 1),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", 1),
    "LGPL-2.1-only": ("SPDX-License-Identifier: LGPL-2.1-only", 2),
    "LGPL-3.0-or-later": ("SPDX-License-Identifier: LGPL-3.0-or-later", 2),
    "GPL-2.0-only": ("SPDX-License-Identifier: GPL-2.0", 2),
    "MIT OR Apache-2.0": ("SPDX-License-Identifier: MIT OR Apache-2.0", 2),
}
MARKS = ["", "# ", " * ", "    "]


def real_texts():
    rows = [(k * 10 + m, wrapped(text, mark)) for k, (text, _) in enumerate(TEXTS.values()) for m, mark in enumerate(MARKS)]
    return rows + [(k * 10 + 9, text) for k, (text, _) in enumerate(TEXTS.values())]


def test_real_texts_as_they_are_wrapped(spark):
    got = {r.doc_id: (r.licenses, r.n_license_sentences) for r in L.scan(spark.createDataFrame(real_texts(), "doc_id long, text string")).collect()}
    assert got == {i: (list(TEXTS)[i // 10], list(TEXTS.values())[i // 10][1]) for i, _ in real_texts()}


def test_real_texts_give_the_same_in_sql(spark):
    every = real_texts() + [(1000 + k, v.upper()) for k, v in enumerate(L.SENTENCES.values())] + [(2000, None), (2001, ""), (2002, "a\x0b\n\n\nMIT\x0b"), (2003, "\u0130 \u212a mit.\u2028MIT.\n")]
    docs = spark.createDataFrame(every, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = L.scan(docs).select("doc_id", "n_license_sentences", "licenses", "n_licenses", "reusable")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(L.oracle()).fetchall())


def test_each_sentence_is_found_alone_and_no_two_are_equal(spark):
    docs = spark.createDataFrame(list(enumerate(L.SENTENCES.values())), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in docs.select("doc_id", L.sentence_ids(docs.text).alias("ids")).collect()}
    assert got == {k: f"{k:02d}," for k in range(len(L.SENTENCES))} and len(L.SENTENCES) < 100


def test_hint_misses_no_sentence():
    assert all(re.search(L._hint(), s) for s in L.SENTENCES.values())


def test_more_forms(spark):
    """A licence's own title, the university's form of a clause, lesser licences by identifier."""
    rows = {
        "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions",
        "BSD-3-Clause": BSD + NAME.replace("copyright holder", "University"),
        "LGPL-2.1-or-later": "// SPDX-License-Identifier: LGPL-2.1-or-later",
        "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007",
        "MIT": "SPDX-License-Identifier: MIT",
    }
    docs = spark.createDataFrame(list(enumerate(rows.values())), "doc_id long, text string")
    assert [r.licenses for r in L.scan(docs).orderBy("doc_id").collect()] == list(rows)
