"""Licence recognition by sentence rules.

Texts are cut into sentences, normalised, and mapped to the identifiers of known licence sentences;
the sequence of identifiers is then matched against ordered rules. It is one projection of built-in
functions over the text: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import GAP

# Sentences of widely used licence notices and texts, by identifier.
SENTENCES: dict[int, str] = {
    1: "Licensed under the Apache License, Version 2.0",
    2: 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    3: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    4: 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    5: "See the License for the specific language governing permissions and limitations under the License",
    6: "SPDX-License-Identifier: Apache-2.0",
    10: "Released under the MIT License",
    11: "Licensed under the MIT License",
    12: "This project is licensed under the MIT License",
    13: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    14: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    15: 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    16: "SPDX-License-Identifier: MIT",
    20: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    21: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    22: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    23: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    24: "Released under the BSD 3-Clause License",
    25: "Released under the BSD 2-Clause License",
    26: "SPDX-License-Identifier: BSD-3-Clause",
    27: "SPDX-License-Identifier: BSD-2-Clause",
    30: "This work is licensed under the GNU General Public License, version 3",
    31: "This work is licensed under the GNU General Public License, version 2",
    32: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    33: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    34: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    35: "See the GNU General Public License for more details",
    36: "SPDX-License-Identifier: GPL-3.0-or-later",
    37: "SPDX-License-Identifier: GPL-2.0-only",
    38: "This work is licensed under the GNU Affero General Public License, version 3",
    39: "This work is licensed under the GNU Lesser General Public License, version 3",
    40: "Licensed under CC BY-NC 4.0",
    41: "Licensed under CC BY 4.0",
    42: "Licensed under CC BY-SA 4.0",
    43: "Licensed under CC BY-NC-SA 4.0",
    44: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    45: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    46: "Licensed under CC0 1.0",
    50: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    51: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    52: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    53: "This is free and unencumbered software released into the public domain",
    54: "All rights reserved",
    60: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    61: "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    62: "See the GNU Lesser General Public License for more details",
    63: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    64: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    65: "Distributed under the Boost Software License, Version 1.0",
    66: "This software is provided 'as-is', without any express or implied warranty",
    67: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
}

def normalised(sentence: str) -> str:
    """Words and numbers of a sentence in lower case, single blanks between."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower())
    return " ".join(kept.split())


#: Every known sentence holds one of these, so a text without any needs no look at its sentences.
#: Each is within one word: blanks, marks and line breaks between words differ from text to text.
MARKERS = ("licen", "permission", "redistribution", "mozilla", "unencumbered", "reserved", "merchantability", "warranty")

#: Licences by their names: SPDX identifier, what it allows, and names in notices.
LICENSES = (
    ("MIT", "permissive", ("MIT License", "MIT")),
    ("Apache-2.0", "permissive", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0")),
    ("BSD-2-Clause", "permissive", ("BSD 2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", "permissive", ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause License")),
    ("ISC", "permissive", ("ISC License",)),
    ("Zlib", "permissive", ("zlib License",)),
    ("BSL-1.0", "permissive", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("Unlicense", "permissive", ("Unlicense",)),
    ("CC0-1.0", "permissive", ("CC0 1.0 Universal",)),
    ("CC-BY-4.0", "permissive", ("Creative Commons Attribution 4.0 International License",)),
    ("CC-BY-SA-4.0", "copyleft", ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0")),
    ("CC-BY-NC-4.0", "noncommercial", ("Creative Commons Attribution-NonCommercial 4.0 International License",)),
    ("GPL-2.0-only", "copyleft", ("GNU General Public License v2.0", "GNU GPL version 2", "GPLv2")),
    ("GPL-2.0-or-later", "copyleft", ("GPLv2 or later", "GNU GPL version 2 or later")),
    ("GPL-3.0-only", "copyleft", ("GNU General Public License v3.0", "GNU GPL version 3", "GPLv3")),
    ("GPL-3.0-or-later", "copyleft", ("GPLv3 or later", "GNU GPL version 3 or later")),
    ("LGPL-2.1-only", "copyleft", ("GNU Lesser General Public License v2.1", "LGPLv2.1")),
    ("LGPL-2.1-or-later", "copyleft", ("LGPLv2.1 or later",)),
    ("LGPL-3.0-only", "copyleft", ("GNU Lesser General Public License v3.0", "LGPLv3")),
    ("LGPL-3.0-or-later", "copyleft", ("LGPLv3 or later",)),
    ("AGPL-3.0-only", "copyleft", ("GNU Affero General Public License v3.0", "AGPLv3")),
    ("AGPL-3.0-or-later", "copyleft", ("AGPLv3 or later",)),
    ("MPL-2.0", "copyleft", ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0")),
    ("EPL-2.0", "copyleft", ("Eclipse Public License 2.0", "Eclipse Public License v2.0")),
)
#: Sentences that state a licence by its name; the last one takes the identifier.
STATEMENTS = (
    "Licensed under {the}{name}",
    "Released under {the}{name}",
    "Distributed under {the}{name}",
    "This project is licensed under {the}{name}",
    "This project is licensed under the terms of {the}{name}",
    "This software is licensed under {the}{name}",
    "SPDX-License-Identifier: {name}",
)
#: The reservation of rights, and what it gives unless another known sentence follows it: notices such as
#: the BSD licences begin with one.
RESERVATION, RESERVED = 54, "LicenseRef-all-rights-reserved"


def _stated() -> tuple[dict[int, str], dict[int, tuple[str, str]]]:
    """Sentences of ``STATEMENTS`` that are not in ``SENTENCES``, numbered from 100 on, and their licences."""
    known = {normalised(s) for s in SENTENCES.values()}
    sentences, licenses = {}, {}
    for name, kind, names in LICENSES:
        said = [t.format(the=the, name=n) for t in STATEMENTS[:-1] for n in names for the in ("the ", "")] + [STATEMENTS[-1].format(name=name)]
        for sentence in said:
            if normalised(sentence) not in known and any(m in sentence.lower() for m in MARKERS):
                known.add(normalised(sentence))
                sentences[100 + len(sentences)] = sentence
                licenses[99 + len(sentences)] = name, kind
    return sentences, licenses


_MORE, _STATED = _stated()
SENTENCES = SENTENCES | _MORE

#: Ordered rules: the sentences that must follow one another, the licence, and what it allows. A
#: sentence used by one rule is not there for later ones, so longer rules stand first.
RULES: tuple[tuple[tuple[int, ...], str, str], ...] = (
    ((60, 61, 62), "LGPL-2.1-or-later", "copyleft"),
    ((60,), "LGPL-2.1-or-later", "copyleft"),
    ((63,), "LGPL-3.0-or-later", "copyleft"),
    ((64,), "EPL-2.0", "copyleft"),
    ((65,), "BSL-1.0", "permissive"),
    ((66, 67), "Zlib", "permissive"),
    ((67,), "Zlib", "permissive"),
    ((2, 3, 4, 5), "Apache-2.0", "permissive"),
    ((2, 3), "Apache-2.0", "permissive"),
    ((13, 14, 15), "MIT", "permissive"),
    ((13, 14), "MIT", "permissive"),
    ((20, 21, 22, 23), "BSD-3-Clause", "permissive"),
    ((20, 21, 22), "BSD-2-Clause", "permissive"),
    ((32, 34, 35), "GPL-3.0-or-later", "copyleft"),
    ((33, 34, 35), "GPL-2.0-or-later", "copyleft"),
    ((32,), "GPL-3.0-or-later", "copyleft"),
    ((33,), "GPL-2.0-or-later", "copyleft"),
    ((50, 51), "MPL-2.0", "copyleft"),
    ((50,), "MPL-2.0", "copyleft"),
    ((1,), "Apache-2.0", "permissive"),
    ((6,), "Apache-2.0", "permissive"),
    ((10,), "MIT", "permissive"),
    ((11,), "MIT", "permissive"),
    ((12,), "MIT", "permissive"),
    ((16,), "MIT", "permissive"),
    ((24,), "BSD-3-Clause", "permissive"),
    ((25,), "BSD-2-Clause", "permissive"),
    ((26,), "BSD-3-Clause", "permissive"),
    ((27,), "BSD-2-Clause", "permissive"),
    ((30,), "GPL-3.0-only", "copyleft"),
    ((31,), "GPL-2.0-only", "copyleft"),
    ((36,), "GPL-3.0-or-later", "copyleft"),
    ((37,), "GPL-2.0-only", "copyleft"),
    ((38,), "AGPL-3.0-only", "copyleft"),
    ((39,), "LGPL-3.0-only", "copyleft"),
    ((43,), "CC-BY-NC-SA-4.0", "noncommercial"),
    ((40,), "CC-BY-NC-4.0", "noncommercial"),
    ((45,), "CC-BY-NC-4.0", "noncommercial"),
    ((42,), "CC-BY-SA-4.0", "copyleft"),
    ((41,), "CC-BY-4.0", "permissive"),
    ((44,), "CC-BY-4.0", "permissive"),
    ((46,), "CC0-1.0", "permissive"),
    ((52,), "ISC", "permissive"),
    ((53,), "Unlicense", "permissive"),
    *(((i,), name, kind) for i, (name, kind) in _STATED.items()),
    ((54,), RESERVED, "proprietary"),
)

#: Runs that end a sentence, also before a closing mark; a line's end does so too (see below).
ENDS = r"[.!?:;][\x22\x27)]*[\x20\x09-\x0D]+"
COMMENT = r"\n[\x20\x09]*(//+|#+|[*]+|--+)"


def _sentence_parts() -> list[tuple[str, int, int]]:
    """Normalised pieces of the known sentences as cutting makes them: text, identifier, size."""
    return sorted((normalised(s), i, len(normalised(s).split())) for i, s in SENTENCES.items())


def _ids(text: Column, wrapped: bool) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A sentence ends at its mark or with its line; with ``wrapped`` lines of a paragraph are joined
    first, so that a sentence may run over several lines. Known sentences with marks inside are
    found because pieces are joined again: a known sentence is looked for from each piece on.
    """
    known = F.create_map(*[F.lit(v) for t, i, _ in _sentence_parts() for v in (t, i)])
    body = F.regexp_replace(F.concat(F.lit("\n"), F.lower(text)), COMMENT, "\n")
    if wrapped:
        body = F.regexp_replace(body, r"([^\n])\n(?=[^\n])", "$1 ")
    cut = F.split(F.regexp_replace(body, ENDS, "\n"), "\n")
    plain = F.transform(cut, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    pieces = F.filter(plain, lambda s: s != "")

    def found(parts: Column) -> Column:
        joined = lambda k, n: F.array_join(F.slice(parts, k + 1, n), " ")
        at = F.transform(parts, lambda s, k: F.coalesce(*[F.try_element_at(known, joined(k, n)) for n in range(MOST_PIECES, 0, -1)]))
        return F.filter(at, lambda i: i.isNotNull())

    return F.transform(F.array(pieces), found)[0]


#: Most pieces that a known sentence is cut into at its inner marks.
MOST_PIECES = max(len(re.split(ENDS, s)) for s in SENTENCES.values())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_ids and paragraph_ids (identifier sequences), licenses, category of every row.

    ``licenses`` (array, order of the rules) joins what both sequences give; a reservation of
    rights that another known sentence follows gives nothing of its own. ``category`` is the most restrictive: proprietary,
    noncommercial, copyleft, permissive, or none without a licence. Null and empty texts have empty
    sequences. Repeated rows are scanned each; other columns are ignored; an empty table gives an empty
    result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    marked = F.lit(False)
    low = F.lower(F.col("text"))
    for m in MARKERS:
        marked = marked | low.contains(m)
    none = F.array().cast("array<int>")
    rows = rows.withColumn("marked", marked)
    rows = rows.withColumns({n: F.when(F.col("marked"), _ids(F.col("text"), w)).otherwise(none) for n, w in (("line_ids", False), ("paragraph_ids", True))})
    whole = F.array_contains("paragraph_ids", RESERVATION)  # then paragraphs tell what follows it
    of_lines = _matched(F.when(whole, F.array_remove("line_ids", RESERVATION)).otherwise(F.col("line_ids")))
    both = F.concat(of_lines, _matched(F.col("paragraph_ids")))
    names = list(dict.fromkeys(name for _, name, _ in RULES))
    return (
        rows.select("doc_id", "line_ids", "paragraph_ids", F.when((F.size("line_ids") > 0) | (F.size("paragraph_ids") > 0), both).otherwise(F.array().cast("array<string>")).alias("found"))
        .withColumn("licenses", F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains("found", n)))
        .select("doc_id", "line_ids", "paragraph_ids", "licenses", _category(F.col("licenses")).alias("category"))
    )


def _pattern(ids: tuple[int, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def _matched(ids: Column) -> Column:
    """Licences of an identifier sequence: each rule in order takes the sentences it matches."""
    sequence = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")
    sequence = F.replace(sequence, F.lit(f"<{RESERVATION}><"), F.lit("<"))
    rules = F.array(*[F.struct(F.lit(_pattern(i)).alias("pattern"), F.lit(n).alias("name")) for i, n, _ in RULES])
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        hit = state["left"].contains(rule["pattern"])
        return F.when(
            hit,
            F.struct(F.replace(state["left"], rule["pattern"], F.lit("|")).alias("left"), F.array_append(state["found"], rule["name"]).alias("found")),
        ).otherwise(state)

    return F.aggregate(rules, start, apply, lambda s: s["found"])


def _category(licenses: Column) -> Column:
    found = F.lit("none")
    for kind in ("permissive", "copyleft", "noncommercial", "proprietary"):
        names = sorted({n for _, n, k in RULES if k == kind})
        found = F.when(F.arrays_overlap(licenses, F.array(*[F.lit(n) for n in names])), F.lit(kind)).otherwise(found)
    return found


def scan_sql(table: str = "documents") -> str:
    """DuckDB SQL for ``scan`` over ``table``, with the arrays as joined texts."""
    known = "MAP {" + ", ".join(f"'{t}': {i}" for t, i, _ in _sentence_parts()) + "}"
    sequences = []
    for name, body in (("line_ids", "body"), ("paragraph_ids", r"regexp_replace(body, '([^\n])\n([^\n])', '\1 \2', 'g')")):
        joined = ", ".join(f"{known}[array_to_string(parts[k:k + {n - 1}], ' ')]" for n in range(MOST_PIECES, 0, -1))
        if name == "paragraph_ids":  # twice, as matches of a one-letter line share that letter
            body = r"regexp_replace(" + body + r", '([^\n])\n([^\n])', '\1 \2', 'g')"
        sequences.append(
            f"{name[0]}s AS (SELECT r, list_filter(list_transform(string_split(regexp_replace({body}, '{ENDS.replace(chr(39), chr(39) * 2)}', chr(10), 'g'), chr(10)), "
            f"lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS parts FROM t), "
            f"{name[0]} AS (SELECT r, list(id ORDER BY k) AS {name} FROM (SELECT r, k, coalesce({joined}) AS id "
            f"FROM (SELECT r, parts, unnest(range(1, len(parts) + 1)) AS k FROM {name[0]}s)) WHERE id IS NOT NULL GROUP BY r)"
        )
    steps, last = [], "m0"
    both = "SELECT r, list_transform({0}, lambda i: '<' || i || '>') AS ids FROM {1} WHERE {0} IS NOT NULL"
    own = f"CASE WHEN list_contains(coalesce(paragraph_ids, []), {RESERVATION}) THEN list_filter(line_ids, lambda i: i <> {RESERVATION}) ELSE line_ids END"
    steps.append(
        f"m0 AS (SELECT r, replace(array_to_string(ids, ''), '<{RESERVATION}><', '<') AS rest, CAST([] AS VARCHAR[]) AS found "
        f"FROM ({both.format('line_ids', f'(SELECT r, {own} AS line_ids FROM l LEFT JOIN p USING (r))')} UNION ALL {both.format('paragraph_ids', 'p')}))"
    )
    for k, (ids, name, _) in enumerate(RULES, 1):
        steps.append(f"m{k} AS (SELECT r, replace(rest, '{_pattern(ids)}', '|') AS rest, CASE WHEN contains(rest, '{_pattern(ids)}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})")
        last = f"m{k}"
    names = ", ".join(f"'{n}'" for n in dict.fromkeys(name for _, name, _ in RULES))
    cases = "".join(
        f" WHEN list_has_any(licenses, [{', '.join(repr(n) for n in sorted({n for _, n, k in RULES if k == kind}))}]) THEN '{kind}'"
        for kind in ("proprietary", "noncommercial", "copyleft", "permissive")
    )
    return rf"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_replace(chr(10) || lower(coalesce(text, '')), '{COMMENT}', chr(10), 'g') AS body FROM {table}
), {", ".join(sequences)}, {", ".join(steps)}, g AS (
  SELECT r, flatten(list(found)) AS found FROM {last} GROUP BY r
), o AS (
  SELECT doc_id, coalesce(array_to_string(line_ids, ','), '') AS line_ids, coalesce(array_to_string(paragraph_ids, ','), '') AS paragraph_ids,
         list_filter([{names}], lambda n: list_contains(coalesce(found, []), n)) AS licenses
  FROM t LEFT JOIN l USING (r) LEFT JOIN p USING (r) LEFT JOIN g USING (r)
)
SELECT doc_id, line_ids, paragraph_ids, array_to_string(licenses, ',') AS licenses, CASE{cases} ELSE 'none' END AS category
FROM o
"""
