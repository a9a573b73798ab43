r"""Licence scans (operator 3) by sentence rules, in SQL expressions only.

A text is cut into sentences, each is normalised (A-Z in lower case, every run of ASCII
characters other than letters and digits is one space), and known licence sentences become
identifiers. The identifiers in order form a sequence; ordered rules, longer ones first,
each name a licence by a run of identifiers, and what a rule has matched is taken out of
the sequence before the next one looks. Nothing is shuffled, and the tables of sentences
and rules are constants of the plan.

A second look is for the genuine notices, which are wrapped over lines and stand in comments:
lines are joined, and cut again at blank lines (or lines of signs only), sentence ends and
colons at line ends. NOTICES has the full wording of standard headers and texts; SPDX lines
name their licences themselves. What this look finds is added to the licences, it changes
neither n_sentences nor the sequence. The SQL has the first look only.

Null and empty texts have no sentences. Sentences that repeat count each time. Repeated
rows, null ids and other columns are passed on; columns of the output's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, table

#: Known sentences of licence notices and texts, normalised.
SENTENCES = (
    "licensed under the apache license version 2 0",
    "you may not use this file except in compliance with the license",
    "released under the mit license",
    "licensed under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "this work is licensed under the gnu general public license version 3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "either version 3 of the license or at your option any later version",
    "licensed under the gnu lesser general public license version 3",
    "licensed under the gnu affero general public license version 3",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "licensed under cc by nc 4 0",
    "licensed under cc by nd 4 0",
    "dedicated to the public domain under cc0 1 0",
    "licensed under the bsd 2 clause license",
    "licensed under the bsd 3 clause license",
    "redistribution and use in source and binary forms with or without modification are permitted",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    "licensed under the mozilla public license version 2 0",
    "all rights reserved",
)
#: Rules in order (licence, kind, numbers of sentences from 0, in sequence).
RULES = (
    ("Apache-2.0", "permissive", (0, 1)),
    ("GPL-3.0-or-later", "copyleft", (6, 7)),
    ("BSD-3-Clause", "permissive", (17, 18)),
    ("MIT", "permissive", (3, 4)),
    ("Apache-2.0", "permissive", (0,)),
    ("MIT", "permissive", (2,)),
    ("MIT", "permissive", (3,)),
    ("MIT", "permissive", (4,)),
    ("GPL-3.0-only", "copyleft", (5,)),
    ("LGPL-3.0-only", "copyleft", (8,)),
    ("AGPL-3.0-only", "copyleft", (9,)),
    ("CC-BY-4.0", "permissive", (10,)),
    ("CC-BY-SA-4.0", "copyleft", (11,)),
    ("CC-BY-NC-4.0", "restricted", (12,)),
    ("CC-BY-ND-4.0", "restricted", (13,)),
    ("CC0-1.0", "permissive", (14,)),
    ("BSD-2-Clause", "permissive", (15,)),
    ("BSD-3-Clause", "permissive", (16,)),
    ("BSD-2-Clause", "permissive", (17,)),
    ("MPL-2.0", "copyleft", (19,)),
    ("Proprietary", "restricted", (20,)),
)
#: Full wordings, as patterns of whole joined sentences (a line break parts two sentences).
_BSD = r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"
_NEITHER = r"neither the name of [^\n]+ nor the names of (?:its|any) contributors may be used to endorse or promote products(?: derived from this software without specific prior written permission)?"
_FREE = r"[^\n]{1,200} is free software you can redistribute it and or modify it under the terms of(?: version {v} of)? the gnu {g}general public license(?: version {v})? as published by the free software foundation"
_LATER = r"(?: either version {v} of the license)? or at your option any later version"
_ONLY = r"(?: either| only)?(?: version {v}(?: of the license)?)?"


def _gnu(short: str, long: str, v: str, title: str) -> list[tuple[str, str, str]]:
    free = _FREE.replace("{g}", long)
    words = v.removesuffix(".0").replace(".", " ")
    # the version stands before or after the foundation's name, and must stand somewhere
    later = f"{free}{_LATER}".replace("{v}", words)
    only = f"{free}{_ONLY}".replace("{v}", words)
    named = rf"(?=[^\n]* version {words} (?:of|as|or)|[^\n]* version {words}\n)"
    text = f"gnu {long}general public license version {words} {title}(?: [^\n]*)?"
    return [(f"{short}-{v}-or-later", "copyleft", f"{named}{later}"), (f"{short}-{v}-only", "copyleft", f"{named}{only}|{text}")]


def _creative() -> list[tuple[str, str, str]]:
    parts = (("BY", "", "permissive"), ("BY-SA", " share ?alike", "copyleft"), ("BY-NC", " non ?commercial", "restricted"), ("BY-ND", " no ?deriv(?:ative)?s", "restricted"), ("BY-NC-SA", " non ?commercial share ?alike", "restricted"), ("BY-NC-ND", " non ?commercial no ?deriv(?:ative)?s", "restricted"))
    return [(f"CC-{n}-{v}.0", kind, rf"(?:[^\n]{{1,200}} (?:is|are) )?licensed under (?:a|the) creative commons attribution{words} {v} 0(?: international| unported| generic)?(?: public)?(?: license)?(?: (?:http|to view)[^\n]*)?") for n, words, kind in parts for v in (4, 3, 2)]


def _eclipse() -> list[tuple[str, str, str]]:
    made = "this program and the accompanying materials are made available under the terms of the "
    where = r"(?: which (?:is available|accompanies) [^\n]*)?"
    return [(f"EPL-{v}.0", "copyleft", rf"(?:{made})?eclipse public license (?:v ?|version )?{v} 0{where}") for v in (2, 1)]


_ZLIB = "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
_BOOST = r"distributed under the boost software license version 1 0(?: see [^\n]*)?|boost software license version 1 0 august 17th 2003"
#: Titles that stand alone over a licence's text, or in its place.
TITLES = (("MIT", "mit license"), ("ISC", "isc license"), ("BSD-2-Clause", "bsd 2 clause license"), ("BSD-3-Clause", "bsd 3 clause license"))
#: Licence, kind, pattern. Single sentences of RULES count here too, so that they may be wrapped.
NOTICES = (
    ("Apache-2.0", "permissive", r"(?:licensed|[^\n]{1,80} licenses this file to you) under the apache license version 2 0 the license you may not use [^\n]{1,60} except in compliance with the license|apache license version 2 0 january 2004(?: http[^\n]*)?"),
    ("MIT", "permissive", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("ISC", "permissive", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD-3-Clause", "permissive", _NEITHER),
    ("BSD-2-Clause", "permissive", _BSD),
    *_gnu("GPL", "", "3.0", "29 june 2007"), *_gnu("GPL", "", "2.0", "june 1991"),
    *_gnu("LGPL", "lesser ", "3.0", "29 june 2007"), *_gnu("LGPL", "lesser ", "2.1", "february 1999"),
    *_gnu("AGPL", "affero ", "3.0", "19 november 2007"),
    ("MPL-2.0", "copyleft", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)?[\n ]2 0|mozilla public license version 2 0"),
    ("Unlicense", "permissive", r"this is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "permissive", r"to the extent possible under law [^\n]{1,200} waived all copyright and related or neighboring rights to [^\n]+|[^\n]{1,200} is (?:marked with|licensed under) cc0 1 0(?: universal)?"),
    *_creative(),
    *_eclipse(),
    ("Zlib", "permissive", _ZLIB),
    ("BSL-1.0", "permissive", _BOOST),
    ("LicenseRef-BSD-style", "permissive", r"use of this source code is governed by a bsd style license that can be found in the license file(?: [^\n]*)?"),
    *((name, "permissive", f"(?:the )?{title}") for name, title in TITLES),
    *((name, kind, SENTENCES[numbers[0]]) for name, kind, numbers in RULES if len(numbers) == 1 and name not in ("BSD-2-Clause", "Proprietary")),
)
#: Beside these grants "all rights reserved" is part of the notice.
GRANTS = ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0")
HINT = "licen[sc]e|permission|redistribution|public domain|copyright|cc0"
#: Kinds of identifiers on SPDX lines; those not listed are restricted, as nobody has read their terms.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)"
SPDX_PERMISSIVE = r"(Apache|MIT|BSD|ISC|Zlib|BSL|CC0|CC-BY-[0-9]|Unlicense|0BSD|PSF|Python|PostgreSQL|NCSA|X11|WTFPL|Artistic-2).*"
SPDX_COPYLEFT = r"(GPL|LGPL|AGPL|MPL|EPL|EUPL|CDDL|CC-BY-SA|OSL|CECILL).*"
#: What counts most when a text has several licences.
ORDER = ("restricted", "copyleft", "permissive")
#: A dot behind these words ends no joined sentence where a small letter, a digit or a bracket follows, and one behind an initial ends none.
ABBREVIATED = r"(?<!\b[A-Z]\.)(?!(?<=\bInc\.|\bLtd\.|\bCo\.|\bCorp\.|\bv\.)[ \t\r\n*#/;]+[a-z0-9(])"
END = r"[.!?]+([ \t\r\n]|\z)"
BETWEEN = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mark(numbers: tuple[int, ...]) -> str:
    return "".join(f"<{n}>" for n in numbers)


def sentences(text: Column) -> Column:
    """The normalised sentences that hold anything."""
    broken = F.regexp_replace(F.coalesce(text, F.lit("")), END, "\n")
    flat = F.regexp_replace(F.translate(broken, UPPER, LOWER), BETWEEN, " ")
    return F.filter(F.transform(F.split(flat, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def joined(text: Column) -> Column:
    """The normalised sentences of joined lines, each between line breaks."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[.!?]+(?=[ \t\r\n]|\z){ABBREVIATED}|:[ \t\r]*(?=\n)|\n[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n", "\x01")
    flat = F.regexp_replace(F.translate(cut, UPPER, LOWER), r"[\x00\x02-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit("\n"), F.regexp_replace(flat, r" *\x01[ \x01]*", "\n"), F.lit("\n"))


def notices(flat: Column, text: Column) -> Column:
    """(name, kind) of the notices of joined sentences and of the SPDX lines of a text."""
    kind = "array<struct<name string, kind string>>"
    said = lambda pattern: flat.rlike(rf"\n *(?:{pattern}) *\n")
    found = [F.when(said(p) & (~said(_NEITHER) if p == _BSD else said(_BSD) if p == _NEITHER else F.lit(True)), F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"))) for n, k, p in NOTICES]
    plain = lambda line: F.regexp_replace(F.regexp_replace(line, r"\*/.*|-->.*", ""), r"(?i)\bWITH[ \t]+[A-Za-z0-9.-]+", "")
    ids = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda x: F.filter(F.regexp_extract_all(plain(x), F.lit(r"([A-Za-z0-9][A-Za-z0-9.+-]*)"), F.lit(1)), lambda y: ~F.upper(y).isin("AND", "OR", "WITH"))))
    spdx = F.transform(ids, lambda y: F.struct(y.alias("name"), F.when(y.rlike(f"^{SPDX_COPYLEFT}"), "copyleft").when(y.rlike(f"^{SPDX_PERMISSIVE}"), "permissive").otherwise("restricted").alias("kind")))
    none = F.array().cast(kind)
    return F.concat(F.when(flat.rlike(HINT), F.array_compact(F.array(*found)).cast(kind)).otherwise(none), F.when(F.contains(flat, F.lit("spdx license identifier")), F.coalesce(spdx.cast(kind), none)).otherwise(none))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_sentences, sequence (identifiers in order), licenses (comma-joined, in the rules' order) and license_kind."""
    known = F.array(*[F.lit(s) for s in SENTENCES])
    rows = once(df.drop("n_sentences", "sequence", "licenses", "license_kind"), "_sentences", sentences(F.col(text)))
    found = F.filter(F.transform("_sentences", lambda s: F.array_position(known, s)), lambda k: k > 0)
    rows = once(rows, "sequence", F.array_join(F.transform(found, lambda k: F.concat(F.lit("<"), (k - 1).cast("string"), F.lit(">"))), ""))
    rest, names, kinds = F.col("sequence"), [], []
    for name, kind, numbers in RULES:
        hit = F.contains(rest, F.lit(_mark(numbers)))
        names.append(F.when(hit, F.lit(name)))
        kinds.append(F.when(hit, F.lit(kind)))
        rest = F.replace(rest, F.lit(_mark(numbers)), F.lit("-"))
    matched = once(rows, "_found", F.when(F.col("sequence") == "", F.struct(F.array().cast("array<string>").alias("n"), F.array().cast("array<string>").alias("k"))).otherwise(F.struct(F.array_distinct(F.array_compact(F.array(*names))).alias("n"), F.array_distinct(F.array_compact(F.array(*kinds))).alias("k"))))
    matched = once(matched, "_flat", joined(F.col(text)))
    matched = once(matched, "_notices", notices(F.col("_flat"), F.col(text)))
    # a granted text's "all rights reserved" says nothing about its licence
    granted = F.exists("_notices", lambda x: x["name"].isin(*GRANTS)) & F.col("_flat").rlike(rf"\n *(?:{NOTICES[0][2]}|{NOTICES[1][2]}|{NOTICES[2][2]}|{_BSD}) *\n")
    names = F.array_distinct(F.concat(F.when(granted, F.array_remove("_found.n", "Proprietary")).otherwise(F.col("_found.n")), F.col("_notices.name")))
    kinds = F.concat(F.when(granted & F.array_contains("_found.n", "Proprietary") & ~F.exists("_found.n", lambda x: x.rlike("^CC-BY-N")), F.array_remove("_found.k", "restricted")).otherwise(F.col("_found.k")), F.col("_notices.kind"))
    kind = F.coalesce(*[F.when(F.array_contains(kinds, k), F.lit(k)) for k in ORDER], F.lit("none"))
    return matched.select(*[c for c in df.columns if c not in ("n_sentences", "sequence", "licenses", "license_kind")], F.size("_sentences").cast("long").alias("n_sentences"), "sequence", F.array_join(names, ",").alias("licenses"), kind.alias("license_kind"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' licence sentences and licences."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _oracle() -> str:
    known = "[" + ", ".join(f"'{s}'" for s in SENTENCES) + "]"
    steps, before = [], "s0"
    for k, (_, _, numbers) in enumerate(RULES):
        steps.append(f"s{k + 1} AS (SELECT *, contains(r{k}, '{_mark(numbers)}') AS h{k}, replace(r{k}, '{_mark(numbers)}', '-') AS r{k + 1} FROM {before})")
        before = f"s{k + 1}"
    names = "[" + ", ".join(f"CASE WHEN h{k} THEN '{n}' END" for k, (n, _, _) in enumerate(RULES)) + "]"
    kinds = "CASE " + " ".join("WHEN " + " OR ".join(f"h{k}" for k, (_, kind, _) in enumerate(RULES) if kind == want) + f" THEN '{want}'" for want in ORDER) + " ELSE 'none' END"
    return rf"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(translate(regexp_replace(coalesce(text, ''), '[.!?]+([ \t\r\n]|\z)', chr(10), 'g'), '{UPPER}', '{LOWER}'), '{BETWEEN}', ' ', 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ss FROM documents),
s0 AS (SELECT doc_id, len(ss) AS n, array_to_string(list_transform(list_filter(list_transform(ss, lambda s: coalesce(list_position({known}, s), 0)), lambda k: k > 0), lambda k: '<' || CAST(k - 1 AS VARCHAR) || '>'), '') AS r0 FROM t),
{", ".join(steps)}
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, r0 AS sequence, array_to_string(list_filter(list_transform(range(1, {len(RULES) + 1}), lambda i: CASE WHEN list_position({names}, ({names})[i]) = i THEN ({names})[i] END), lambda x: x IS NOT NULL), ',') AS licenses, {kinds} AS license_kind
FROM {before}
"""


ORACLE = _oracle()
