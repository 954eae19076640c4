"""Licence recognition by sentences and ordered rules.

A text is normalised to words with the places where a sentence or line ends
(``. ! ? ; :`` before white space or a comment sign, line ends, the end of a
comment, and before an SPDX tag).  Where the
first words of a known sentence stand, the words that follow are looked up by
hash in the table of known sentences, once for each length that a sentence with
this beginning has; the longest one found gives its identifier.  The identifier
sequence is then matched against an ordered list of rules; a rule that matches
consumes its part of the sequence, so the specific rules come first.  DataFrame
functions only, and nothing is shuffled: sentences stay in their row.

Normalised: lower case; runs of anything but letters and digits are one space;
``+`` behind a digit reads ``or later``.  Line ends, comment signs and marks
inside a known sentence do not count.  A reference (one line that names a
licence) must be a whole sentence or line; words of a licence text also count
behind a heading or before an address without a mark, as when white space is
collapsed.  Each member of an SPDX expression (``or``, ``and``, ``with``,
brackets) is read as an SPDX line of its own; exceptions and unknown members
give nothing.

Defined results: null, empty and other texts without a known sentence have no
identifiers and no licence; repeated sentences count each time; a known sentence
inside a longer one does not count; known sentences that no rule takes are
listed as ``unmatched``.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A known sentence is sought where its first words stand.
OPENER_WORDS = 3
SPDX_TAG = "spdx-license-identifier:"

# How a line names a licence, and what may follow the name.
REFERENCES = ("Licensed under", "Released under", "Distributed under", "Available under", "Licensed under the terms of",
              "Released under the terms of", "Distributed under the terms of", "This project is licensed under",
              "This project is licensed under the terms of", "This software is licensed under", "This code is licensed under",
              "This work is licensed under")
REFERENCE_ENDS = ("", " - see the LICENSE file for details")


def _spdx(*names: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {n}" for n in names)


def _named(*names: str, spdx: Sequence[str] = ()) -> tuple[str, ...]:
    """Every usual line that refers to a licence by one of its names, and its SPDX lines."""
    return (*(f"{start} {n}{end}." for n in names for start in REFERENCES for end in REFERENCE_ENDS), *_spdx(*spdx))


def _gnu(kind: str, version: str) -> tuple[str, ...]:
    """Names of one version of a GNU licence."""
    full = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}[kind]
    names = (f"the GNU {full} Public License, version {version}", f"the GNU {full} Public License v{version}",
             f"the GNU {kind} v{version}", f"the {kind} v{version}")
    return (*names, f"{kind}v{version}")


def _notice(license_name: str, version: str) -> tuple[str, ...]:
    """The notice of a GNU licence with any later version, in its usual marks, from the work's name or behind it."""
    parts = ("you can redistribute it and/or modify it under the terms of the GNU " + license_name + " as published by the Free "
             "Software Foundation", f"either version {version} of the License, or (at your option) any later version.")
    return (*(f"This {work} is free software{a} {parts[0]}{b} {parts[1]}" for work in ("program", "library")
              for a, b in ((":", ","), (";", ";"))), f"{parts[0]}, {parts[1]}", f"{parts[0]}; {parts[1]}")


def _creative_commons(short: str, long: str) -> tuple[str, ...]:
    names = (short, *(f"{a} Creative Commons {long} International License" for a in ("the", "a")))
    return _named(*names, spdx=(short.replace("CC ", "CC-").replace(" ", "-"),))


# Known sentences of public licence texts, by identifier.
SENTENCES = {
    "apache2_ref": ("Licensed under the Apache License, Version 2.0 (the \"License\");",
                    *_named("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0",
                            spdx=("Apache-2.0",))),
    "apache2_asf": ("The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\");",),
    "apache2_comply": ("you may not use this file except in compliance with the License.",),
    "apache2_copy": ("You may obtain a copy of the License at",),
    "mit_ref": _named("the MIT License", "the MIT License (MIT)", "MIT", spdx=("MIT",)),
    "mit_grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
                  "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                  "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
                  "following conditions:",),
    "mit_notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial "
                   "portions of the Software.",),
    "as_is": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
              "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",),
    "gpl3_ref": _named(*_gnu("GPL", "3"), spdx=("GPL-3.0-only", "GPL-3.0")),
    "gpl3_later_ref": _spdx("GPL-3.0-or-later"),
    "gpl2_ref": _named(*_gnu("GPL", "2"), spdx=("GPL-2.0-only", "GPL-2.0")),
    "gpl2_later_ref": _spdx("GPL-2.0-or-later"),
    "gpl_free": _notice("General Public License", "3"),
    "gpl2_free": _notice("General Public License", "2"),
    "gpl2_only": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                  "Public License version 2 as published by the Free Software Foundation.",
                  "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                  "Public License as published by the Free Software Foundation; version 2 of the License."),
    "gpl_warranty": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
                     "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    "lgpl3_ref": _named(*_gnu("LGPL", "3"), spdx=("LGPL-3.0-only", "LGPL-3.0")),
    "lgpl3_later_ref": _spdx("LGPL-3.0-or-later"),
    "lgpl21_ref": _named(*_gnu("LGPL", "2.1"), spdx=("LGPL-2.1-only", "LGPL-2.1")),
    "lgpl21_later_ref": _spdx("LGPL-2.1-or-later"),
    "lgpl2_ref": _spdx("LGPL-2.0-only", "LGPL-2.0"),
    "lgpl2_later_ref": _spdx("LGPL-2.0-or-later"),
    "lgpl3_free": _notice("Lesser General Public License", "3"),
    "lgpl21_free": _notice("Lesser General Public License", "2.1"),
    "lgpl2_free": _notice("Library General Public License", "2"),
    "agpl3_ref": _named(*_gnu("AGPL", "3"), spdx=("AGPL-3.0-only", "AGPL-3.0")),
    "agpl3_later_ref": _spdx("AGPL-3.0-or-later"),
    "agpl3_free": _notice("Affero General Public License", "3"),
    "mpl2_ref": _named("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "MPL 2.0",
                       spdx=("MPL-2.0",)),
    "mpl2_notice": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "mpl2_copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "isc_ref": _named("the ISC License", "ISC", spdx=("ISC",)),
    "isc_grant": tuple(f"Permission to use, copy, modify, {a} distribute this software for any purpose with or without fee is hereby "
                       "granted, provided that the above copyright notice and this permission notice appear in all copies."
                       for a in ("and/or", "and")),
    "isc_warranty": tuple(f"THE SOFTWARE IS PROVIDED \"AS IS\" AND {a} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
                          "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS." for a in ("THE AUTHOR", "ISC")),
    "unlicense_ref": _named("the Unlicense", spdx=("Unlicense",)),
    "unlicense_free": ("This is free and unencumbered software released into the public domain.",),
    "unlicense_grant": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
                        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "cc0_ref": _named("CC0 1.0", "CC0 1.0 Universal", spdx=("CC0-1.0",)),
    "cc0_notice": tuple(f"To the extent possible under law, the author{a} dedicated all copyright and related and neighboring "
                        "rights to this software to the public domain worldwide." for a in ("(s) have", " has", "s have")),
    "ccbync4_ref": _creative_commons("CC BY-NC 4.0", "Attribution-NonCommercial 4.0"),
    "ccby4_ref": _creative_commons("CC BY 4.0", "Attribution 4.0"),
    "ccbysa4_ref": _creative_commons("CC BY-SA 4.0", "Attribution-ShareAlike 4.0"),
    "ccbyncsa4_ref": _creative_commons("CC BY-NC-SA 4.0", "Attribution-NonCommercial-ShareAlike 4.0"),
    "ccbynd4_ref": _creative_commons("CC BY-ND 4.0", "Attribution-NoDerivatives 4.0"),
    "ccbyncnd4_ref": _creative_commons("CC BY-NC-ND 4.0", "Attribution-NonCommercial-NoDerivatives 4.0"),
    "bsd2_ref": _named("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", spdx=("BSD-2-Clause",)),
    "bsd3_ref": _named("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", spdx=("BSD-3-Clause",)),
    "bsd4_ref": _spdx("BSD-4-Clause"),
    "bsd_grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                  "that the following conditions are met:",),
    "bsd_source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                   "following disclaimer.",),
    "bsd_binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                   "following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd_advert": ("All advertising materials mentioning features or use of this software must display the following "
                   "acknowledgement:",),
    # Behind the holder's name, and for "may be" and "may not be".
    "bsd_endorse": ("used to endorse or promote products derived from this software without specific prior written permission.",),
}
# Rules in order, the longer sequences of a licence before its single sentences.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advert", "bsd_endorse")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    *(("Apache-2.0", (first, "apache2_comply", *more)) for more in (("apache2_copy",), ()) for first in ("apache2_ref", "apache2_asf")),
    *((name, (free, *more)) for more in (("gpl_warranty",), ()) for name, free in (
        ("GPL-3.0-or-later", "gpl_free"), ("GPL-2.0-or-later", "gpl2_free"), ("GPL-2.0", "gpl2_only"),
        ("LGPL-3.0-or-later", "lgpl3_free"), ("LGPL-2.1-or-later", "lgpl21_free"), ("LGPL-2.0-or-later", "lgpl2_free"),
        ("AGPL-3.0-or-later", "agpl3_free"))),
    ("MPL-2.0", ("mpl2_notice", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_notice",)),
    ("ISC", ("isc_grant", "isc_warranty")),
    ("ISC", ("isc_grant", "as_is")),
    ("ISC", ("isc_grant",)),
    ("Unlicense", ("unlicense_free", "unlicense_grant", "as_is")),
    ("Unlicense", ("unlicense_free", "unlicense_grant")),
    ("Unlicense", ("unlicense_free",)),
    ("CC0-1.0", ("cc0_notice",)),
    ("Apache-2.0", ("apache2_ref",)),
    ("Apache-2.0", ("apache2_asf",)),
    ("MIT", ("mit_ref",)),
    ("GPL-3.0", ("gpl3_ref",)),
    ("GPL-3.0-or-later", ("gpl3_later_ref",)),
    ("GPL-2.0", ("gpl2_ref",)),
    ("GPL-2.0-or-later", ("gpl2_later_ref",)),
    ("LGPL-3.0", ("lgpl3_ref",)),
    ("LGPL-3.0-or-later", ("lgpl3_later_ref",)),
    ("LGPL-2.1", ("lgpl21_ref",)),
    ("LGPL-2.1-or-later", ("lgpl21_later_ref",)),
    ("LGPL-2.0", ("lgpl2_ref",)),
    ("LGPL-2.0-or-later", ("lgpl2_later_ref",)),
    ("AGPL-3.0", ("agpl3_ref",)),
    ("AGPL-3.0-or-later", ("agpl3_later_ref",)),
    ("MPL-2.0", ("mpl2_ref",)),
    ("ISC", ("isc_ref",)),
    ("Unlicense", ("unlicense_ref",)),
    ("CC0-1.0", ("cc0_ref",)),
    ("CC-BY-NC-4.0", ("ccbync4_ref",)),
    ("CC-BY-4.0", ("ccby4_ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4_ref",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4_ref",)),
    ("CC-BY-ND-4.0", ("ccbynd4_ref",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd4_ref",)),
    ("BSD-2-Clause", ("bsd2_ref",)),
    ("BSD-3-Clause", ("bsd3_ref",)),
    ("BSD-4-Clause", ("bsd4_ref",)),
)


def normalised(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def stands_alone(identifier: str, sentence: str) -> bool:
    """A reference must be a whole sentence or line; words of a licence text (or a reference that goes on) count wherever they stand."""
    return identifier.endswith("_ref") and not sentence.endswith(";")


def known_sentences(sentences: Mapping[str, Sequence[str]] = SENTENCES) -> dict[str, str]:
    return {normalised(s): i for i, many in sentences.items() for s in many}


def whole_sentences(sentences: Mapping[str, Sequence[str]] = SENTENCES) -> set[str]:
    """Normalised sentences that only count as whole sentences or lines."""
    return {normalised(s) for i, many in sentences.items() for s in many if stands_alone(i, s)}


def opener_width(known: Mapping[str, str]) -> int:
    return min([OPENER_WORDS, *(len(s.split()) for s in known)])


def openers(sentences: Mapping[str, Sequence[str]] = SENTENCES) -> dict[str, dict]:
    """By first words: ``ids`` (sentence to identifier, ``!`` before those that stand alone) and ``lengths`` in words, most first."""
    known, whole = known_sentences(sentences), whole_sentences(sentences)
    width, out = opener_width(known), {}
    for s, i in known.items():
        out.setdefault(" ".join(s.split()[:width]), {})[s] = f"!{i}" if s in whole else i
    return {o: {"lengths": sorted({len(s.split()) for s in ids}, reverse=True), "ids": ids} for o, ids in out.items()}


def cue_words(known: Mapping[str, str]) -> list[str]:
    """A few words such that each known sentence has one of them (greedy cover, words of six letters first): a text without any has no match."""
    left, cues = [set(s.split()) for s in known], []
    while left:
        count = Counter(w for s in left for w in s)
        cues.append(max(count, key=lambda w: (len(w) >= 6, count[w], len(w), w)))
        left = [s for s in left if cues[-1] not in s]
    return cues


def cut(text: Column) -> Column:
    """The words of a text with one space between; ``|`` stands before the first word of a sentence or line, and at the end."""
    member = r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?"
    tagged = F.regexp_replace(F.lower(text), rf"({SPDX_TAG}|(?!^)\G)([ \t(]*{member})[ \t)]+(?:or|and|with)[ \t(]+(?=[a-z0-9])",
                              f"$1$2\n{SPDX_TAG} ")
    later = F.regexp_replace(F.replace(tagged, F.lit(SPDX_TAG), F.lit(f"\n{SPDX_TAG}")), r"([0-9])\+([^a-z0-9]|$)", "$1 or later$2")
    ends = F.regexp_replace(later, r"[.!?;:](?=[ \t\n\x0b\f\r*#/])|\*/|-->", "\n")
    plain = F.concat(F.lit("\n"), F.regexp_replace(ends, "[^a-z0-9\n]+", " "), F.lit("\n"))
    return F.trim(F.regexp_replace(plain, "(?: ?\n)+ ?", " |"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def sentence_ids(text: Column, sentences: Mapping[str, Sequence[str]]) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known, starts = known_sentences(sentences), openers(sentences)
    width, longest = opener_width(known), max(len(s.split()) for s in known)
    table = F.from_json(F.lit(json.dumps(starts)), "map<string,struct<lengths:array<int>,ids:map<string,string>>>")

    def words(x: Column, i: Column, n: Column) -> Column:
        return F.array_join(F.slice(x["words"], i, n), " ")

    def at(x: Column, i: Column) -> Column:
        """The longest known sentence that begins with word i, or none."""
        tried = _let(F.element_at(x["table"], words(x, i, F.lit(width))), lambda known_here: F.transform(
            known_here["lengths"], lambda n: F.struct((i + n).alias("end"), F.element_at(known_here["ids"], words(x, i, n)).alias("id"))))

        def counts(h: Column) -> Column:
            ends = F.startswith(x["cut"][i - 1], F.lit("|")) & F.startswith(x["cut"][h["end"] - 1], F.lit("|"))
            return h["id"].isNotNull() & (~F.startswith(h["id"], F.lit("!")) | ends)
        return F.slice(F.filter(tried, counts), 1, 1)

    def found(x: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(x["words"])), lambda i: words(x, i, F.lit(width)).isin(list(starts)))
        return _let(F.flatten(F.transform(places, lambda i: at(x, i))), lambda hits: F.transform(
            F.filter(hits, lambda h, k: ~F.exists(F.slice(hits, F.greatest(F.lit(1), k + 1 - longest), F.least(k, F.lit(longest))),
                                                  lambda g: g["end"] >= h["end"])),
            lambda h: F.ltrim(h["id"], F.lit("!"))))
    return _let(cut(text), lambda c: _let(F.struct(F.split(c, " ").alias("cut"), F.split(F.translate(c, "|", ""), " ").alias("words"),
                                                   table.alias("table")), found))


def match_rules(ids: Column, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> Column:
    """struct(rest, licenses): each rule in turn takes all its places in the sequence."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in seq)).alias("seq")) for name, seq in rules])
    whole = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["seq"])
        return F.when(hit, F.struct(F.replace(state["rest"], rule["seq"], F.lit("")).alias("rest"),
                                    F.array_union(state["licenses"], F.array(rule["name"])).alias("licenses"))).otherwise(state)
    return F.aggregate(table, F.struct(whole.alias("rest"), F.array().cast("array<string>").alias("licenses")), step)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: Mapping[str, Sequence[str]] = SENTENCES,
         rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> DataFrame:
    """doc_id, sentences (identifiers in order), licenses and unmatched identifiers of every row."""
    known = known_sentences(sentences)
    low = F.lower(F.col(text))
    cue = F.lit(False)
    for word in cue_words(known):
        cue = cue | F.contains(low, F.lit(word))
    ids = F.when(cue, sentence_ids(F.col(text), sentences)).otherwise(F.array().cast("array<string>"))
    found = docs.select(F.col(doc_id), F.coalesce(ids, F.array().cast("array<string>")).alias("_ids"))
    ruled = found.withColumn("_rules", match_rules(F.col("_ids"), rules))
    return ruled.select(doc_id, F.array_join("_ids", ",").alias("sentences"),
                        F.array_join(F.sort_array("_rules.licenses"), ",").alias("licenses"),
                        F.translate(F.replace("_rules.rest", F.lit("><"), F.lit(",")), "<>", "").alias("unmatched"))
