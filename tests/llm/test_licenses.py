"""Licence scans: lines, full texts, wrapped and commented texts, rule order, a plain matcher and edge rows."""

import itertools
import re
import textwrap

import duckdb
from pyspark.sql import functions as F

from shopcast.llm import licenses, queries
from shopcast.llm.common import table

S = licenses.SENTENCES
MIT = f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{S['mit_grant'][0]}\n\n{S['mit_notice'][0]}\n\n{S['as_is'][0]}"


def one(spark, text):
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    return r["licenses"], r["sentences"], r["unmatched"]


def test_lines_and_texts(spark):
    assert one(spark, "Some words. More.\nReleased under the MIT License.")[0] == "MIT"
    assert one(spark, "no mark before\nLicensed under CC BY-NC 4.0.\nno mark behind")[0] == "CC-BY-NC-4.0"
    assert one(spark, MIT) == ("MIT", "mit_grant,mit_notice,as_is", "")
    wrapped = re.sub(r"((?:\S+ ){8})", r"\1\n * ", MIT)
    assert one(spark, wrapped)[0] == "MIT"
    apache = ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance "
              "with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n")
    assert one(spark, apache) == ("Apache-2.0", "apache2_ref,apache2_comply,apache2_copy", "")
    assert one(spark, "// SPDX-License-Identifier: GPL-3.0-only\nx")[0] == "GPL-3.0"


def test_order_and_rest(spark):
    assert one(spark, S["as_is"][0]) == ("", "as_is", "as_is")
    assert one(spark, f"{S['mit_notice'][0]} {S['mit_grant'][0]}") == ("", "mit_notice,mit_grant", "mit_notice,mit_grant")
    two = "Released under the MIT License. Licensed under the Apache License, Version 2.0. Released under the MIT License."
    assert one(spark, two) == ("Apache-2.0,MIT", "mit_ref,apache2_ref,mit_ref", "")


FORMS = {
    "one line": lambda parts: "A Title Copyright (c) 2020 A Person " + " ".join(parts) + " And so on.",
    "wrapped": lambda parts: "A Title\nCopyright (c) 2020 A Person\n" + "\n".join(textwrap.fill(p, 40) for p in parts) + "\nEnd.",
    "blank lines": lambda parts: "A Title\n\n" + "\n\n".join(textwrap.fill(p, 60) for p in parts) + "\n\nEnd.",
    "commented": lambda parts: "/*\n" + "".join(textwrap.indent(textwrap.fill(p, 50), " * ") + "\n" for p in parts) + " */\ncode();",
    "other comment": lambda parts: "x\n" + "".join(textwrap.indent(textwrap.fill(p, 50), ";; ") + "\n" for p in parts) + "(code)",
}


def test_every_sentence_and_rule_in_every_form(spark):
    def told(i, s):
        alone = licenses.stands_alone(i, s)
        return f"Well. {s}{'' if s[-1] in '.:;' else '.'}" if alone else s
    wants = [([told(i, s)], i, None) for i, many in S.items() for s in many]
    wants += [([told(i, S[i][k % len(S[i])]) for i in seq], ",".join(seq), name)
              for name, seq in licenses.RULES for k in range(max(len(S[i]) for i in seq))]
    rows = [(f"{form}: {parts}", render(parts), ids, name) for parts, ids, name in wants for form, render in FORMS.items()]
    docs = spark.createDataFrame(rows, "doc_id string, text string, ids string, name string").coalesce(1)
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for label, _, ids, name in rows:
        assert got[label]["sentences"] == ids, label
        assert name is None or (got[label]["licenses"], got[label]["unmatched"]) == (name, ""), label


def test_near_licences_are_kept_apart(spark):
    bsd2 = "\n".join(f"{n}. {S[i][0]}" if n else S[i][0] for n, i in enumerate(("bsd_grant", "bsd_source", "bsd_binary")))
    bsd3 = f"{bsd2}\n3. Neither the name of Some Lab nor the names of its contributors may be {S['bsd_endorse'][0]}"
    assert one(spark, bsd2)[0] == "BSD-2-Clause" and one(spark, bsd3)[0::2] == ("BSD-3-Clause", "")
    rows = [(f"# SPDX-License-Identifier: {n}\nx = 1", n) for n in (
        "GPL-3.0-or-later", "GPL-2.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "CC0-1.0",
        "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "BSD-2-Clause", "BSD-3-Clause", "MIT", "Apache-2.0")]
    rows += [(f"SPDX-License-Identifier: {n}-only", n) for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")]
    rows += [(f"SPDX-License-Identifier: {n}", n) for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "AGPL-3.0", "BSD-4-Clause")]
    rows += [(f"SPDX-License-Identifier: {n}+", f"{n}-or-later") for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0")]
    lesser = S["lgpl21_free"][1]
    rows += [(lesser, "LGPL-2.1-or-later"), (lesser.replace("This library", "Foo"), "LGPL-2.1-or-later"),
             (S["gpl2_only"][0], "GPL-2.0"), (S["mpl2_notice"][0], "MPL-2.0"), (S["isc_grant"][0], "ISC"), (S["unlicense_free"][0], "Unlicense")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame([(t, t) for t, _ in rows], "doc_id string, text string")).collect()}
    assert got == dict(rows)


ASF = """/*
 * Licensed to the Apache Software Foundation (ASF) under one or more
 * contributor license agreements.  See the NOTICE file distributed with
 * this work for additional information regarding copyright ownership.
 * The ASF licenses this file to You under the Apache License, Version 2.0
 * (the "License"); you may not use this file except in compliance with
 * the License.  You may obtain a copy of the License at
 *
 *    http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */
package x;"""
#: text, licenses, unmatched
PLANTED = [
    (ASF, "Apache-2.0", ""), (ASF.replace("\n * ", " "), "Apache-2.0", ""),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT", ""),
    ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */ int x;", "Apache-2.0,BSD-3-Clause,MIT", ""),
    ("// SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note\nint x;", "GPL-2.0", ""),
    ("# SPDX-License-Identifier: (GPL-2.0+ AND Foo-1.0) or  MIT\n", "GPL-2.0-or-later,MIT", ""),
    ("SPDX-License-Identifier:ISC", "ISC", ""), ("SPDX-License-Identifier: MIT, or Apache-2.0", "", ""),
    ("Mine.\nlicensed under the terms of the MIT license\nx", "MIT", ""), ("Distributed under the MIT License.", "MIT", ""),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT", ""),
    ("Released under the GNU GPL v3. Released under GPLv2!", "GPL-2.0,GPL-3.0", ""), ("Distributed under GPLv30.", "", ""),
    (f"{S['isc_grant'][0]}\n\n{textwrap.fill(S['isc_warranty'][0], 40)}", "ISC", ""), (S["isc_warranty"][1], "", "isc_warranty"),
    ("we or they and SPDX-License-Identifier: MIT\nhere or there", "MIT", ""), ("1+1 is 2+ and C++ is 17+.", "", ""),
]


def test_planted_forms(spark, tmp_path):
    rows = [(n, *r) for n, r in enumerate([*PLANTED, (None, "", ""), ("", "", ""), ("|", "", ""), ("MIT", "", "")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string, unmatched string").coalesce(1)
    got = {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in licenses.scan(docs).collect()}
    assert got == {n: (name, rest) for n, _, name, rest in rows}
    # the SQL of the query finds the same
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select doc_id, text from '{tmp_path}/documents/*.parquet'")
    con.execute(queries.ORACLE_SQL["op10_licenses"])
    told = {r[0]: r[2:] for r in con.fetchall()}
    assert told == got


def test_documents_match_brute_force(spark):
    """Every known sentence is searched in every normalised text; matches inside longer ones go."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    known, whole = licenses.known_sentences(), licenses.whole_sentences()
    want = {}
    for r in docs.collect():
        runs = [licenses.normalised(x).split() for x in re.split(r"\n|[.!?;:](?=[\s*#/])|\*/|-->|(?=spdx-license-identifier:)", r["text"].lower())]
        ends = {0, *itertools.accumulate(map(len, runs))}
        text, hits = f" {' '.join(w for run in runs for w in run)} ", []
        for s in known if "licen" in text else ():
            hits += [(len(text[:m.start() + 1].split()), len(s.split()), s) for m in re.finditer(f"(?={re.escape(f' {s} ')})", text)]
        hits = [(p, p + n, s) for p, n, s in hits if s not in whole or {p, p + n} <= ends]
        want[r["doc_id"]] = ",".join(known[s] for p, e, s in sorted(hits) if not any(
            q <= p and e <= f and (q, f) != (p, e) for q, f, _ in hits))
    got = {r["doc_id"]: r["sentences"] for r in licenses.scan(docs).collect()}
    assert got == want and sum(map(bool, want.values())) > 10


def test_a_very_long_text_of_references(spark):
    text = "Released under the MIT License.\n" * 5000 + "license word " * 20000
    assert one(spark, text) == ("MIT", ",".join(["mit_ref"] * 5000), "")


def test_references_are_whole_sentences(spark):
    assert one(spark, "This is not licensed under the MIT License.") == ("", "", "")
    assert one(spark, "Licensed under the MIT License or so.") == ("", "", "")
    assert one(spark, "Licence: Released under the\n  MIT License.")[0] == "MIT"


def test_cues_cover_every_sentence():
    known = licenses.known_sentences()
    cues = licenses.cue_words(known)
    assert all(any(c in s.split() for c in cues) for s in known) and len(cues) < 8


def test_documents_match_a_plain_matcher(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    known = licenses.known_sentences()
    want = {}
    for r in docs.collect():
        ids = []
        for block in re.split(r"\n[\s*#/]*\n|(?<=[.!?;])[\s*#/]+", r["text"]):
            whole = [known[x] for x in [licenses.normalised(block)] if x in known]
            ids += whole or [known[x] for x in map(licenses.normalised, block.split("\n")) if x in known]
        want[r["doc_id"]] = ",".join(ids)
    got = {r["doc_id"]: r["sentences"] for r in licenses.scan(docs).collect()}
    assert got == want and sum(map(bool, want.values())) > 50


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "Released under the MIT License."), (4, "license " * 50000), (4, "x")],
                                 "doc_id long, text string").withColumn("_ids", F.lit(1)).withColumn("licenses", F.lit(2))
    rows = licenses.scan(docs).collect()
    assert len(rows) == 5 and {r["doc_id"]: r["licenses"] for r in rows} == {1: "", 2: "", None: "MIT", 4: ""}
    assert licenses.scan(docs.limit(0)).count() == 0
