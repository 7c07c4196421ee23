"""License scans by sentence rules: normalised sentences are looked up among known licence sentences, and the ids in a row are matched with ordered rules.

A rule is a sequence of sentence ids; it matches where its ids stand in a document's known sentences one after the other (sentences that are not known may
stand between). Blank lines (also of comment marks) and sentence ends part sentences. A line feed within a sentence is white space: of the lines up to a
sentence's end, the longest run that is a known sentence is taken, and lines before it are looked up one by one. A rule whose place lies within that of a
longer one is not reported. DataFrame functions only; a row needs no other row, so there is no shuffle and nothing grows with the corpus but the scan.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm._common import ID

#: Sentences of public licences and licence notices, normalised (small letters and digits, single spaces), by id.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "no-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-long": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc0-notice": "licensed under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "rights-reserved": "all rights reserved",
    # wordings that have a colon, semicolon or full stop inside, as a sentence's end cuts them
    "free-software": "this program is free software",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2-later": "either version 2 of the license or at your option any later version",
    "gpl3-later": "either version 3 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-only": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "hope-library": "this library is distributed in the hope that it will be useful but without any warranty",
    "no-warranty": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-version": "this source code form is subject to the terms of the mozilla public license v",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl21-later": "either version 2 1 of the license or at your option any later version",
    "lgpl3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "apache-title": "apache license version 2 0 january 2004",
    "apache-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl1-notice": "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "boost-notice": "distributed under the boost software license version 1 0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "gpl-preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "mpl2-title": "mozilla public license version 2 0",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "bsd-university": "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "spdx": "spdx license identifier",
    "spdx-gpl-2-bare": "gpl 2 0",
    "spdx-gpl-3-bare": "gpl 3 0",
    "spdx-lgpl-21": "lgpl 2 1 only",
    "spdx-lgpl-21-later": "lgpl 2 1 or later",
    "spdx-lgpl-3": "lgpl 3 0 only",
    "spdx-lgpl-3-later": "lgpl 3 0 or later",
    "spdx-agpl-3": "agpl 3 0 only",
    "spdx-agpl-3-later": "agpl 3 0 or later",
    "spdx-mit-or-apache": "mit or apache 2 0",
    "spdx-apache-or-mit": "apache 2 0 or mit",
    "spdx-cc0": "cc0 1 0",
    "spdx-mit": "mit",
    "spdx-apache-2": "apache 2 0",
    "spdx-bsd-2": "bsd 2 clause",
    "spdx-bsd-3": "bsd 3 clause",
    "spdx-gpl-2": "gpl 2 0 only",
    "spdx-gpl-2-later": "gpl 2 0 or later",
    "spdx-gpl-3": "gpl 3 0 only",
    "spdx-gpl-3-later": "gpl 3 0 or later",
    "spdx-mpl-2": "mpl 2 0",
    "spdx-epl-2": "epl 2 0",
    "spdx-isc": "isc",
    "spdx-boost": "bsl 1 0",
    "spdx-zlib": "zlib",
}

#: Fixed values: (licence, its sentence ids in order, whether it permits reuse).
RULES = [
    ("MIT", ("mit-notice",), True),
    ("MIT", ("mit-notice-2",), True),
    ("MIT", ("mit-grant", "mit-keep", "as-is", "no-liability"), True),
    ("MIT", ("mit-grant", "mit-keep"), True),
    ("Apache-2.0", ("apache-notice",), True),
    ("Apache-2.0", ("apache-notice-long", "apache-use", "apache-copy"), True),
    ("Apache-2.0", ("apache-notice-long",), True),
    ("GPL-3.0", ("gpl3-notice",), False),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope"), False),
    ("GPL-3.0-or-later", ("gpl-free",), False),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope"), False),
    ("GPL-2.0-or-later", ("gpl2-free",), False),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), True),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), True),
    ("ISC", ("isc-grant",), True),
    ("MPL-2.0", ("mpl-notice",), False),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",), False),
    ("CC-BY-4.0", ("cc-by-4",), True),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",), False),
    ("CC0-1.0", ("cc0-notice",), True),
    ("Unlicense", ("unlicense",), True),
    ("proprietary", ("rights-reserved",), False),
    ("GPL-2.0-or-later", ("gpl2-terms",), False),
    ("GPL-2.0-or-later", ("gpl-terms", "gpl2-later"), False),
    ("GPL-2.0-only", ("gpl2-only",), False),
    ("GPL-3.0-or-later", ("gpl3-terms",), False),
    ("GPL-3.0-or-later", ("gpl-terms", "gpl3-later"), False),
    ("LGPL-2.1-or-later", ("lgpl-terms", "lgpl21-later"), False),
    ("LGPL-3.0-or-later", ("lgpl3-terms",), False),
    ("LGPL-3.0-or-later", ("lgpl-terms", "gpl3-later"), False),
    ("AGPL-3.0-or-later", ("agpl3-terms",), False),
    ("AGPL-3.0-or-later", ("agpl-terms", "gpl3-later"), False),
    ("MPL-2.0", ("mpl-version",), False),
    ("Apache-2.0", ("apache-notice-long", "apache-use", "apache-copy", "apache-as-is"), True),
    ("Apache-2.0", ("apache-title",), True),
    ("Apache-2.0", ("apache-title", "apache-grant"), True),
    ("EPL-2.0", ("epl2-notice",), False),
    ("EPL-1.0", ("epl1-notice",), False),
    ("BSL-1.0", ("boost-notice",), True),
    ("BSL-1.0", ("boost-grant",), True),
    ("Zlib", ("zlib-as-is", "zlib-grant"), True),
    ("Zlib", ("zlib-grant",), True),
    ("MIT", ("spdx", "spdx-mit"), True),
    ("Apache-2.0", ("spdx", "spdx-apache-2"), True),
    ("BSD-2-Clause", ("spdx", "spdx-bsd-2"), True),
    ("BSD-3-Clause", ("spdx", "spdx-bsd-3"), True),
    ("GPL-2.0-only", ("spdx", "spdx-gpl-2"), False),
    ("GPL-2.0-or-later", ("spdx", "spdx-gpl-2-later"), False),
    ("GPL-3.0-only", ("spdx", "spdx-gpl-3"), False),
    ("GPL-3.0-or-later", ("spdx", "spdx-gpl-3-later"), False),
    ("MPL-2.0", ("spdx", "spdx-mpl-2"), False),
    ("EPL-2.0", ("spdx", "spdx-epl-2"), False),
    ("ISC", ("spdx", "spdx-isc"), True),
    ("BSL-1.0", ("spdx", "spdx-boost"), True),
    ("Zlib", ("spdx", "spdx-zlib"), True),
    ("GPL-3.0", ("gpl3-title",), False),
    ("GPL-3.0", ("gpl3-title", "gpl-preamble"), False),
    ("GPL-2.0", ("gpl2-title",), False),
    ("LGPL-3.0", ("lgpl3-title",), False),
    ("AGPL-3.0", ("agpl3-title",), False),
    ("MPL-2.0", ("mpl2-title",), False),
    ("CC-BY-4.0", ("cc-by-4-work",), True),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-work",), False),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-work",), False),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-university"), True),
    ("GPL-2.0-only", ("spdx", "spdx-gpl-2-bare"), False),
    ("GPL-3.0-only", ("spdx", "spdx-gpl-3-bare"), False),
    ("LGPL-2.1-only", ("spdx", "spdx-lgpl-21"), False),
    ("LGPL-2.1-or-later", ("spdx", "spdx-lgpl-21-later"), False),
    ("LGPL-3.0-only", ("spdx", "spdx-lgpl-3"), False),
    ("LGPL-3.0-or-later", ("spdx", "spdx-lgpl-3-later"), False),
    ("AGPL-3.0-only", ("spdx", "spdx-agpl-3"), False),
    ("AGPL-3.0-or-later", ("spdx", "spdx-agpl-3-later"), False),
    ("MIT OR Apache-2.0", ("spdx", "spdx-mit-or-apache"), True),
    ("MIT OR Apache-2.0", ("spdx", "spdx-apache-or-mit"), True),
    ("CC0-1.0", ("spdx", "spdx-cc0"), True),
]

_BREAK = r"[.!?:;]+(?:[ \t\n\x0B\f\r]+|\z)|\n(?:[^A-Za-z0-9\n]*\n)+"
_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
LONGEST = max(len(s.split()) for s in SENTENCES.values())  # words, and so lines: every line between breaks has one
BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1]))  # longer rules first


def _hint() -> str:
    """Words one of which stands in every known sentence, those of most sentences first."""
    left, words = list(SENTENCES.values()), []
    while left:
        count = Counter(w for s in left for w in set(s.split()))
        words.append(max(count, key=lambda w: (len(w) > 4, count[w], len(w), w)))
        left = [s for s in left if words[-1] not in s.split()]
    return f"(?i)(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])"


def normal(sentence: Column) -> Column:
    """Small ASCII letters and digits of a sentence, all else one space."""
    return F.btrim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), "[^a-z0-9]+", " "))


WIDTH = max(2, len(str(len(SENTENCES) - 1)))  # digits of a code


def _codes() -> dict[str, str]:
    return {s: f"{k:0{WIDTH}d}" for k, s in enumerate(SENTENCES)}


#: What stands in place of the sentences that a rule has matched.
_TAKEN = "-" * WIDTH + ","


def sentence_ids(text: Column) -> Column:
    """The known sentences of a text, in order, as codes of WIDTH digits each with a comma behind it: '00,04,'."""
    table = F.create_map(*[F.lit(x) for name, code in _codes().items() for x in (SENTENCES[name], code)])
    code = lambda s: F.get(F.array(F.element_at(table, normal(s))), F.lit(0))
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda s: s.rlike(_hint()))
    lines = F.transform(pieces, lambda s: F.split(s, "\n"))
    runs = lambda x: F.sequence(F.greatest(F.size(x) - LONGEST, F.lit(0)), F.size(x) - 1)
    ends = lambda x: F.transform(runs(x), lambda i: F.struct(i.alias("i"), code(F.array_join(F.slice(x, i + 1, F.size(x)), " ")).alias("code")))
    last = F.transform(lines, lambda x: F.struct(x.alias("x"), F.get(F.filter(ends(x), lambda e: e.code.isNotNull()), F.lit(0)).alias("e")))
    codes = F.transform(last, lambda p: F.concat(F.transform(F.slice(p.x, 1, F.coalesce(p.e.i, F.size(p.x))), code), F.array(p.e.code)))
    return F.array_join(F.transform(F.array_compact(F.flatten(codes)), lambda c: F.concat(c, F.lit(","))), "")


_IDS, _HITS = "sentence ids of the scan", "rules of the scan"  # no names of columns that a caller has


def _matches(ids: Column) -> Column:
    """The rules that match, longer ones first; what one has matched is taken out."""
    code = _codes()
    rules = F.array(*[F.struct(F.lit("".join(code[s] + "," for s in of)).alias("ids"), F.lit(name).alias("name"), F.lit(reuse).alias("reuse")) for name, of, reuse in BY_LENGTH])
    none = F.filter(rules, lambda r: F.lit(False))
    step = lambda a, r: F.struct(F.replace(a["ids"], r["ids"], F.lit(_TAKEN)).alias("ids"), F.when(F.contains(a["ids"], r["ids"]), F.array_append(a["hits"], r)).otherwise(a["hits"]).alias("hits"))
    return F.when(ids == "", none).otherwise(F.aggregate(rules, F.struct(ids.alias("ids"), none.alias("hits")), step, lambda a: a["hits"]))


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with n_license_sentences, licenses (names, ascending, joined by '+'; '' if none), n_licenses and reusable.

    reusable: whether all that was found permits reuse; null if nothing was found. A null or empty text has none. Rows are judged one by one, so null or
    repeated ids do not matter; columns of these names are replaced.
    """
    # A generator of one row: a projection could be merged with each of the uses below, and the text be split for each.
    df = documents.select("*", F.inline(F.array(F.struct(sentence_ids(F.col(text)).alias(_IDS)))))
    df = df.select("*", F.inline(F.array(F.struct(_matches(F.col(_IDS)).alias(_HITS)))))
    names = F.array_sort(F.array_distinct(F.transform(_HITS, lambda h: h["name"])))
    out = {"n_license_sentences": F.coalesce(F.length(_IDS) / (WIDTH + 1), F.lit(0)).cast("long"), "licenses": F.array_join(names, "+"), "n_licenses": F.size(names).cast("long")}
    out["reusable"] = F.when(F.size(_HITS) > 0, F.forall(_HITS, lambda h: h["reuse"]))
    own = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in out]
    return df.select(*own, *[c.alias(n) for n, c in out.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_license_scan: every document of the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(ID, "text")
    return scan(docs).select(ID, "n_license_sentences", "licenses", "n_licenses", "reusable")


def oracle() -> str:
    """The same in DuckDB SQL."""
    code, rules = _codes(), BY_LENGTH
    known = ", ".join(f"('{SENTENCES[s]}', '{c}')" for s, c in code.items())
    names = sorted({r[0] for r in rules})
    steps = []
    for k, (_, ids, _) in enumerate(rules):
        pattern = "".join(code[s] + "," for s in ids)
        steps.append(f"SELECT * EXCLUDE (ids), contains(ids, '{pattern}') AS f{k}, replace(ids, '{pattern}', '{_TAKEN}') AS ids FROM " + (f"s{k - 1}" if k else "each"))
    steps = ", ".join(f"s{k} AS ({step})" for k, step in enumerate(steps))
    hits = ", ".join("CASE WHEN " + " OR ".join(f"f{k}" for k, r in enumerate(rules) if r[0] == n) + f" THEN '{n}' END" for n in names)
    number = " + ".join("CAST((" + " OR ".join(f"f{k}" for k, r in enumerate(rules) if r[0] == n) + ") AS INT)" for n in names)
    closed = " OR ".join(f"f{k}" for k, r in enumerate(rules) if not r[2])
    norm = lambda x: f"trim(regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH known(sentence, code) AS (VALUES {known}),
cut AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{_BREAK}') AS pieces FROM documents),
piece AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p FROM cut),
lined AS (SELECT doc_id, p, string_split(piece, chr(10)) AS x FROM piece),
tail AS (SELECT doc_id, p, x, unnest(range(greatest(len(x) - {LONGEST}, 0), len(x))) AS i FROM lined),
last AS (SELECT doc_id, p, min(i) AS i, arg_min(code, i) AS code FROM tail JOIN known ON known.sentence = {norm("array_to_string(x[i + 1:], ' ')")} GROUP BY doc_id, p),
single AS (SELECT doc_id, p, x, unnest(range(0, coalesce(last.i, len(x)))) AS i FROM lined LEFT JOIN last USING (doc_id, p)),
hit AS (SELECT doc_id, p, i, code FROM last UNION ALL SELECT doc_id, p, i, code FROM single JOIN known ON known.sentence = {norm("x[i + 1]")}),
row_ids AS (SELECT doc_id, string_agg(code || ',', '' ORDER BY p, i) AS ids FROM hit GROUP BY doc_id),
each AS (SELECT d.doc_id, coalesce(h.ids, '') AS ids, CAST(length(coalesce(h.ids, '')) / {WIDTH + 1} AS BIGINT) AS n_license_sentences FROM documents d LEFT JOIN row_ids h USING (doc_id)),
{steps},
named AS (SELECT *, concat_ws('+', {hits}) AS licenses, CAST({number} AS BIGINT) AS n_licenses FROM s{len(rules) - 1})
SELECT doc_id, n_license_sentences, licenses, n_licenses, CASE WHEN n_licenses > 0 THEN NOT ({closed}) END AS reusable FROM named"""
