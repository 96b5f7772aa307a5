"""Licence headers as files carry them: semicolons inside sentences, choices of two, and wrapped lines, in Spark and in SQL."""

import duckdb
from civiledger.llm import license_scan
from comparing import duck_rows, rows_of

GNU = """This {what} is free software; you can redistribute it and/or
modify it under the terms of the GNU {kind} Public
License as published by the Free Software Foundation; either
version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{kind} Public License for more details.

You should have received a copy of the GNU {kind} Public License along
with this {what}; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""
CASES = {
    GNU.format(what="program", kind="General", version="2"): "GPL-2.0-or-later",
    "/*\n * " + GNU.format(what="library", kind="Lesser General", version="2.1").replace("\n", "\n * ") + "\n */": "LGPL-2.1-or-later",
    "# " + GNU.format(what="program", kind="Affero General", version="3").replace("\n", "\n# "): "AGPL-3.0-or-later",
    GNU.format(what="program", kind="General", version="2").replace("\n", "\r\n"): "GPL-2.0-or-later",
    GNU.format(what="program", kind="General", version="3").replace("; either", ", either"): "GPL-3.0-or-later",
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0,MIT",
    "This project is dual-licensed under the MIT and Apache 2.0 licenses.": "Apache-2.0,MIT",
    "This crate is licensed under either the MIT license or the Apache License 2.0 at your option.": "Apache-2.0,MIT",
    "Licensed under the MIT or\nBSD 3-Clause license.": "MIT,BSD-3-Clause",
    "// Copyright 2009 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.": "BSD",
    "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.": "MIT",
    "Use of this file is governed by the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the Apache License, Version 2.0 (the\n\"License\"); you may not use this file except in compliance\nwith the License.": "Apache-2.0",
    "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.": "Artistic-1.0-Perl",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without\nfee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").": "CDDL-1.0",
    "A foundation; either version of the story is licensed.": "",
    "Licensed under either of nothing or something.": "",
    "A licensed driver and\n\nthe MIT chapel": "", "": "",
}


def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id bigint, text string")


def test_headers(spark):
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(rows(spark)).collect()}
    assert {t: got[i] for i, t in enumerate(CASES)} == CASES
    assert all(license_scan.known_sentences().values()) and len(license_scan.PUBLISHED) >= 120


def test_sql_reads_wrapped_headers_alike(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(CASES)))
    got = license_scan.scan(rows(spark))
    names, want = duck_rows(con, license_scan.ORACLE)
    assert sorted(got.columns) == names and rows_of(got) == want
