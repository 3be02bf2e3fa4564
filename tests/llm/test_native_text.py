import os

import duckdb
import pandas as pd
import pytest
from oracle import database, same

from stageledger.llm import chat_format, license_scan, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert same(queries.queries()[name](spark, SF), database(SF), queries.oracle_sql()[name])


def test_rotation_by_hand(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|>"), (1, 70, "ann", None), (1, 1, "ann", "hi"), (None, None, None, "x"), (2, 1, "system", "alone")]
    got = {(r.conv_id, r.perspective, r.chunk): r for r in chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got.keys() == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", 0)}
    ann = got[1, "ann", 0]
    assert ann.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [ann.text[s.start : s.stop] for s in ann.spans] == ["hi<|im_end|>", "<|im_end|>"] and ann.n_turns == 4 and ann.n_own == 2
    assert [got[1, "bob", 0].text[s.start : s.stop] for s in got[1, "bob", 0].spans] == ["yo < |im_end|><|im_end|>"]
    assert chat_format.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversations_and_ties(spark, tmp_path):
    rows = [(1, None, f"s{i % 3}", f"text {i}", "x") for i in range(500)] + [(1, None, "s0", "text 0", "y")] + [(None, 7, "a", "" if i else None, "x") for i in range(3)]
    rows += [(2, i % 4, "b", f"t{i}", "x") for i in range(200)] + [(3, 0, None, "w " * 50_000, "x"), (3, 1, "system", None, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk string")
    found = chat_format.rotate(frame).collect()
    assert max(r.n_turns for r in found) == chat_format.CHUNK
    for conv, speaker, n in [(1, "s0", 500), (2, "b", 200), (None, "a", 1), (3, "unknown", 2)]:
        own = sorted((r for r in found if r.conv_id == conv and r.perspective == speaker), key=lambda r: r.chunk)
        assert [r.chunk for r in own] == list(range(len(own))) and sum(r.n_turns for r in own) == n
        assert "".join(r.text for r in own).count("<|im_start|>") == n
    frame.toPandas().to_parquet(f"{tmp_path}/conversations.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet'")
    assert same(chat_format.op1_perspective_rotation(spark, str(tmp_path)), connection, chat_format.ORACLE)


def test_licences_by_hand(spark, odd, none):
    full = "Permission is hereby granted, free of charge"
    rows = [
        (1, "Some text.\nReleased under the MIT License."),
        (2, "ALL RIGHTS RESERVED!  Licensed under the Apache License, Version 2.0. more words"),
        (3, "Licensed under the Apache License, Version 2.0.\nnoise\nAll rights reserved."),
        (4, full),
        (5, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License"),
    ]
    got = {r.doc_id: (r.rules, r.licences) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        1: (["mit"], ["MIT"]),
        2: (["apache-2-all-rights"], ["Apache-2.0"]),
        3: (["apache-2", "all-rights-reserved"], ["Apache-2.0", "Proprietary"]),
        4: ([], []),
        5: (["cc-by-nc-4", "cc-by-nc-4", "mit"], ["CC-BY-NC-4.0", "MIT"]),
    }
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(none).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Copyright (c) A. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_wrapped_notices(spark):
    notices = [(APACHE, "Apache-2.0"), (MIT, "MIT"), (GPL, "GPL-3.0-or-later"), (BSD, "Proprietary,BSD-3-Clause"), (MPL, "MPL-2.0")]
    ways = [
        lambda t: t,
        lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")),
        lambda t: t.replace("\n", "\r\n"),
        lambda t: "/*\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n */\nint x;",
        lambda t: "\n\n".join(" ".join(x.split()) for x in t.split("\n\n")),
        lambda t: " ".join(t.split()),
    ]
    rows = [(100 * i + j, way(t)) for i, (t, _) in enumerate(notices) for j, way in enumerate(ways)]
    rows.append((900, "Permission is hereby\n\ngranted, free of charge"))
    rows.append((901, "words before\nAll rights reserved\nReleased under the MIT License\nwords after"))
    got = {r.doc_id: (",".join(r.licences), r.rules) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one_line = 5  # there the MIT and BSD sentences of several paragraphs run into one
    for i, (_, licence) in enumerate(notices):
        for j in range(len(ways)):
            if j != one_line or licence in ("Apache-2.0", "GPL-3.0-or-later", "MPL-2.0"):
                assert got[100 * i + j][0] == licence, (i, j, got[100 * i + j])
    assert all(len(got[j][1]) == 1 for j in range(len(ways))) and got[100][1] == ["mit-text"] and got[200][1] == ["gpl-3-notice"]
    assert got[900] == ("", []) and got[901][1] == ["all-rights-reserved", "mit"]


GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
ENDORSE = """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""


def test_more_notices_and_the_sql_twin(spark, tmp_path):
    lesser = lambda v: GPL2.replace("GNU General", "GNU Lesser General").replace("This program", "This library").replace("version 2", f"version {v}")
    notices = [
        (GPL2, "GPL-2.0-or-later"), (GPL2.replace("\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.", "\nversion 2 as published by the Free Software Foundation."), "GPL-2.0-only"),
        (GPL.replace("GNU General Public License as", "GNU Affero General Public License as"), "AGPL-3.0-or-later"), (lesser("2.1"), "LGPL-2.1-or-later"), (lesser("3"), "LGPL-3.0-or-later"),
        (BSD3, "BSD-2-Clause"), (BSD3 + ENDORSE, "BSD-3-Clause"), (ISC, "ISC"), (EPL, "EPL-2.0"), (UNLICENSE, "Unlicense"), (ZLIB, "Zlib"), (" ".join(MIT.split()), "MIT"),
        ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", "GPL-2.0-only"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        (APACHE, "Apache-2.0"), (MIT, "MIT"), (GPL, "GPL-3.0-or-later"), (MPL, "MPL-2.0"), (None, ""), ("", ""), ("All rights reserved\n\n\nAll rights reserved", "Proprietary"),
    ]
    rows = [(i, t) for i, (t, _) in enumerate(notices)] + [(100 + i, t and "/*\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n */") for i, (t, _) in enumerate(notices)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: ",".join(r.licences) for r in license_scan.scan(docs).collect()}
    assert got == {100 * k + i: n for k in (0, 1) for i, (_, n) in enumerate(notices)}
    docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert same(license_scan.op4_sentence_rules(spark, str(tmp_path)), connection, license_scan.ORACLE) == len(rows)


_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
_GPL = """{} is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
SLOTTED = [
    (_BSD + "3. Neither the name of the Free Widget\n   Society, Inc. nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.", "BSD-3-Clause"),
    (_BSD + "The name of Jane Doe may not be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
    (_BSD, "BSD-2-Clause"),
    (_GPL.format("Foo"), "GPL-3.0-or-later"),
    (_GPL.format("The Bar Tool Chain"), "GPL-3.0-or-later"),
    (_GPL.format("This program"), "GPL-3.0-or-later"),
    ("libfoo is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("// SPDX-License-Identifier: Apache-2.0 OR MIT\nint main;", "Apache-2.0,MIT"),
    ("# SPDX-License-Identifier: MIT AND Apache-2.0 AND BSD-3-Clause", "MIT,Apache-2.0,BSD-3-Clause"),
    ("Nobody said that this is free software or that you can use it", ""),
]


def test_slots_of_sentences(spark, tmp_path):
    frame = pd.DataFrame({"doc_id": range(len(SLOTTED)), "text": [t for t, _ in SLOTTED]})
    frame.to_parquet(tmp_path / "documents.parquet")
    df = queries.queries()["op4_sentence_rules"](spark, str(tmp_path))
    assert {r.doc_id: r.licences for r in df.collect()} == {i: licences for i, (_, licences) in enumerate(SLOTTED)}
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert same(df, c, license_scan.ORACLE) == len(SLOTTED)
