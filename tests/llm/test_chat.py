"""Preference formatting and licence scans against plain Python."""

from pyspark.sql import functions as F

from corpusloom.llm import preference
from corpusloom.llm.license_rules import Rule, scanned
from corpusloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def render(turns):
    out, spans = "", []
    for role, text in turns:
        out += f"<|{role}|>\n"
        start = len(out)
        out += f"{text}<|end|>\n"
        if role == "assistant":
            spans.append((start, len(out)))
    return out, spans


def plain(key, chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    return (key, n, render(chosen[:n])[0], *render(chosen[n:]), *render(rejected[n:]))


def rows_of(df):
    return sorted(
        (r[0], r["n_prompt_turns"], r["prompt"], r["chosen"], [tuple(x) for x in r["chosen_mask"]], r["rejected"], [tuple(x) for x in r["rejected_mask"]])
        for r in df.collect()
    )


def test_query(spark):
    held = {}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        held.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    held = {k: [(b, c) for _, b, c in sorted(v)] for k, v in held.items()}
    last = {k: max((i for i, t in enumerate(v) if t[0] == "assistant"), default=None) for k, v in held.items()}
    want = []
    for k, v in held.items():
        if last[k] is not None and last.get(k ^ 1) is not None:
            cut = v[: last[k] + 1]
            want.append(plain(k, cut, [*cut[:-1], ("assistant", held[k ^ 1][last[k ^ 1]][1])]))
    conversations = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    assert rows_of(preference.formatted(preference.neighbour_pairs(conversations))) == sorted(want)


def test_pairs(spark):
    a, b, c = ("user", "Hé?"), ("assistant", "yes"), ("assistant", "no\n")
    cases = [([a, b], [a, c]), ([a, b], [a, b]), ([a], [a, b]), ([], [b]), ([b, a], [c, a]), ([("system", ""), a, b, a], [("system", ""), a, b, a, c])]
    turn = lambda side: [(i, *t) for i, t in enumerate(side)]
    kind = "array<struct<at:bigint,role:string,text:string>>"
    pairs = spark.createDataFrame([(i, turn(x), turn(y)) for i, (x, y) in enumerate(cases)], f"key long, chosen {kind}, rejected {kind}")
    assert rows_of(preference.formatted(pairs)) == sorted(plain(i, x, y) for i, (x, y) in enumerate(cases))
    none = spark.createDataFrame([(1, None, None)], pairs.schema)
    assert rows_of(preference.formatted(none)) == [(1, 0, "", "", [], "", [])]
    assert preference.formatted(pairs.limit(0)).count() == 0


def test_turns(spark):
    rows = [(1, 1, "user", "b", 0), (1, 0, None, None, 0), (1, 0, None, None, 0), (None, 0, "user", "x", 0), (2, None, "user", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = [(r["key"], [tuple(t) for t in r["turns"]]) for r in preference.turns_of(df).collect()]
    assert got == [(1, [(0, "", ""), (1, "user", "b")])]


NOTICES = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "Some text.\nThis work is licensed under the GNU General Public License, version 3. More text",
    3: "Released under the MIT License.\nLicensed under CC BY-NC 4.0.",
    4: "Copyright (c) 2020 A B. All rights reserved.\nRedistribution and use in source and binary forms, with or without modification, are permitted.\n"
       "1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce it.",
    5: None, 6: "", 7: "A license for nothing that is known.", 8: "the word mit license inside words is no notice",
    9: "// Permission is hereby granted, free of charge, to any person obtaining a copy of this.\n// The above copyright notice and this permission notice shall be included in all copies.",
}


def test_licences(spark):
    docs = spark.createDataFrame([(k, v, "x") for k, v in NOTICES.items()] * 2, "doc_id long, text string, licences string")
    rows = scanned(docs).collect()
    assert len(rows) == 2 * len(NOTICES)
    got = {r["doc_id"]: (r["licences"], r["unmatched"]) for r in rows}
    assert got == {
        1: (["Apache-2.0"], []), 2: (["GPL-3.0-only"], []), 3: (["MIT", "CC-BY-NC"], []), 4: (["BSD-2-Clause", "proprietary"], ["copyright"]),
        5: ([], []), 6: ([], []), 7: ([], []), 8: ([], []), 9: (["MIT"], []),
    }
    rule = (Rule("both", ("mit_name", "apache2"), gap=0),)
    two = spark.createDataFrame([(1, NOTICES[3].split("\n")[0] + "\n" + NOTICES[1]), (2, NOTICES[1] + "\n" + NOTICES[3])], "doc_id long, text string")
    assert {r["doc_id"]: r["licences"] for r in scanned(two, rules=rule).collect()} == {1: ["both"], 2: []}
    assert scanned(docs.limit(0)).count() == 0


BSD = """Copyright (c) 2020, A B
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
"""
MIT = """MIT License
Copyright (c) 2020 A B
Permission is hereby granted, free of charge, to any person obtaining a
copy of this software, subject to the following conditions:

The above copyright notice and this permission notice shall be
included in all copies.
"""
APACHE = """# Licensed under the Apache
# License, Version 2.0 (the "License");
# you may not use this file except in compliance with the
# License. You may obtain a copy of the License at
"""
WRAPPED = {
    "bsd": (BSD, {"BSD-3-Clause", "proprietary"}), "bsd crlf": (BSD.replace("\n", "\r\n"), {"BSD-3-Clause", "proprietary"}),
    "bsd (1)": (BSD.replace("1.", "(1)").replace("2. ", "(2) ").replace("3.", "(3)"), {"BSD-3-Clause", "proprietary"}),
    "bsd in one line": (" ".join(BSD.split()), {"BSD-3-Clause"}), "gpl": (GPL, {"GPL-2.0-or-later"}),
    "gpl 3": (GPL.replace("version 2", "version 3"), {"GPL-3.0-or-later"}), "mpl": (MPL, {"MPL-2.0"}), "mit": (MIT, {"MIT"}), "apache": (APACHE, {"Apache-2.0"}),
    "rights": ("all rights\nreserved", {"proprietary"}), "lines without stops": ("A title\nLicensed under the MIT License\nB is licensed under CC BY-NC 4.0\nCC0", {"MIT", "CC-BY-NC", "CC0-1.0"}),
    "spdx": ("// SPDX-License-Identifier: Apache-2.0\nint main;", {"Apache-2.0"}), "spdx or": ("# SPDX-License-Identifier: (MIT OR GPL-2.0+)", {"MIT", "GPL-2.0-or-later"}),
    "spdx comment": ("/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note */", {"GPL-2.0-only"}), "spdx bsd": ("SPDX-License-Identifier: BSD-3-Clause", {"BSD-3-Clause"}),
    "spdx nd": ("SPDX-License-Identifier: CC-BY-NC-ND-4.0", set()), "spdx lgpl": ("SPDX-License-Identifier: LGPL-2.0+", set()), "hyphens": ("Shared under CC-BY-SA-4.0.", {"CC-BY-SA"}),
}


def test_wrapped_licences(spark):
    docs = spark.createDataFrame([(k, v[0]) for k, v in WRAPPED.items()], "doc_id string, text string")
    assert {r["doc_id"]: set(r["licences"]) for r in scanned(docs).collect()} == {k: v[1] for k, v in WRAPPED.items()}


def test_licence_query(spark):
    text = F.col("text")
    marks = {"Apache-2.0": "Apache License, Version 2.0.", "MIT": "under the MIT License.", "CC-BY-NC": "CC BY-NC 4.0.", "GPL-3.0-only": "General Public License, version 3.", "proprietary": "ll rights reserved"}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", *[text.contains(v).alias(k) for k, v in marks.items()]).collect()
    got = {r["doc_id"]: set(r["licences"]) for r in QUERIES["op3_licence_sentences"](spark, FOLDER).collect()}
    assert got == {r["doc_id"]: {k for k in marks if r[k]} for r in docs}
    assert any(got.values())
