"""Real licence notices with the licence a reader would give them, and URL trees of any depth."""

import pytest

from attesta.llm import license_scan, url_filter
from oracle_check import compare
from test_llm import docs_of

BSD = """Copyright (c) 2015, The Authors. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
   disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.
"""
THIRD = """
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
MIT = """Copyright 2020 Somebody. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
"""
LGPL = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""
NOTICES = [
    (BSD, "BSD-2-Clause", "permissive"),
    (BSD + THIRD, "BSD-3-Clause", "permissive"),
    (MIT, "MIT", "permissive"),
    (LGPL, "LGPL-2.1-or-later", "copyleft"),
    ("This project is licensed under the terms of the MIT license.", "MIT", "permissive"),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", None, None),
    ("Licensed under GPLv3.", "GPL-3.0-only", "copyleft"),
    ("// Licensed under GPLv2 or later\n", "GPL-2.0-or-later", "copyleft"),
    ("# SPDX-License-Identifier: LGPL-2.1-only\nimport os\n", "LGPL-2.1-only", "copyleft"),
    ("/* SPDX-License-Identifier: EPL-2.0 */\n", "EPL-2.0", "copyleft"),
    ("SPDX-License-Identifier: BSL-1.0", "BSL-1.0", "permissive"),
    ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0-or-later", "copyleft"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)", "BSL-1.0", "permissive"),
    ("This program and the accompanying materials are made available under the terms of the\nEclipse Public License 2.0.", "EPL-2.0", "copyleft"),
    ("Licensed under the Apache License 2.0.", "Apache-2.0", "permissive"),
    ("Released under the ISC License.", "ISC", "permissive"),
    ("This software is licensed under the GNU Lesser General Public License v3.0.", "LGPL-3.0-only", "copyleft"),
    ("Licensed under Mozilla Public License, version 2.0.", "MPL-2.0", "copyleft"),
    ("Released under the Unlicense.", "Unlicense", "permissive"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", "noncommercial"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0", "permissive"),
    ("Copyright 2021 A Company. All rights reserved.", "LicenseRef-all-rights-reserved", "proprietary"),
    ("All rights\nreserved.", "LicenseRef-all-rights-reserved", "proprietary"),
    ("Copyright 2021. All rights reserved. Licensed under the MIT License.", "MIT", "permissive"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
     "and redistribute it freely, subject to the following restrictions:", None, None),
    ("You need a licence to drive.", None, None),
]


def test_notices_have_their_licence(spark):
    rows = [(k, t, "en", "a", 1) for k, (t, _, _) in enumerate(NOTICES)]
    for r in license_scan.scan(docs_of(spark, rows)).collect():
        text, name, kind = NOTICES[r["doc_id"]]
        assert (list(r["licenses"]), r["category"]) == (([name], kind) if name else ([], "none")), text


def test_every_stated_sentence_is_found(spark):
    sentences = sorted(license_scan.SENTENCES.items())
    rows = [(i, f"Before it. {s}. After it.", "en", "a", 1) for i, s in sentences]
    found = {r["doc_id"]: list(r["line_ids"]) for r in license_scan.scan(docs_of(spark, rows)).collect()}
    assert [i for i, _ in sentences if i not in found[i]] == []


@pytest.mark.parametrize("depth", [0, 4, 8])
def test_url_trees_of_any_depth(spark, tmp_path, depth):
    above = "".join(f"/p{k}" for k in range(depth))
    rows, labels = [], []
    for k in range(400):
        good = k % 2
        rows.append((k, f"https://a.org{above}/{'ok' if good else 'bad'}/slug{chr(97 + k % 26)}{k}"))
        labels.append((k, good))
    rows += [(400, None), (401, "no scheme"), (402, "https://b.org/x"), (402, "https://b.org/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").coalesce(1)
    known = spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    got = url_filter.judge(pages, url_filter.page_labels(pages, known)).cache()
    verdicts = {r["page_id"]: r["verdict"] for r in got.collect()}
    assert all(verdicts[k] == ("allow" if k % 2 else "block") for k in range(400)) and got.count() == len(rows)
    con = duck_of(tmp_path)
    assert compare(got, con, url_filter.judge_sql(levels=depth + 3)) is None


def duck_of(folder):
    import duckdb

    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return con
