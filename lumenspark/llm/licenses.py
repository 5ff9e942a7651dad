"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into pieces at line ends and after sentence marks, and normalised (lower case, runs of
anything but letters and digits as one blank).  A known licence sentence is found where it begins and
ends with a piece; it may go on over line ends and marks inside it, but not over a blank line.  A notice ("licensed
under ...") also counts where it begins a piece that goes on with other words.  At one
place the longest known sentence is taken, and what it covers is not looked at again.  The identifiers
that are found, in order, are matched against the ordered rules: a rule fires where its identifiers
stand next to each other in that sequence, whatever other sentences are between them in the text, unless they
are part of a longer rule that fires there.  No shuffle is needed.

Tags ``SPDX-License-Identifier: expression`` are read as expressions: each licence that stands in one, in parentheses or
joined by AND or OR, is an identifier of its own, after those of the sentences; what follows WITH is an exception
and no licence.  Old names, as GPL-2.0 and GPL-2.0+, count as what they mean.

Rows: a null or blank text has no sentences and no licences; repeated rows and null ids are kept as
they are; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.llm.common import only

# Sentences of licences and their notices, normalised, with an identifier.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this software is released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "licensed under the apache license version 2 0": "apache2-notice",
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-condition",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache2-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-grant",
    "either version 3 of the license or at your option any later version": "gpl3-version",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "licensed under cc by nc 4 0": "ccbync4-notice",
    "licensed under cc by 4 0": "ccby4-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-name",
    "all rights reserved": "rights-reserved",
}

# The rules, in the order in which they are reported; each is a sequence of identifiers.
RULES = [
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache2-notice", "apache2-condition"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl3-version"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("CC-BY-NC-4.0", ["ccbync4-notice"]),
    ("CC-BY-4.0", ["ccby4-notice"]),
]

_GPL_GRANT = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
_GNU = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation"
_LATER = " either version {} of the license or at your option any later version"
_CC = "this work is licensed under {} creative commons attribution {}4 0 international license"

# Sentences of the standard texts in full, which go on where those above stop.  The SQL
# of the query, which looks at one piece at a time, does not have them.
FULL_SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    f"{_GPL_GRANT} either version 3 of the license or at your option any later version": "gpl3-or-later-grant",
    f"{_GPL_GRANT} version 3": "gpl3-only-grant",
    f"{_GPL_GRANT} version 3 of the license": "gpl3-only-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    f"{_GPL_GRANT}{_LATER.format('2')}": "gpl2-or-later-grant",
    f"{_GPL_GRANT} version 2": "gpl2-only-grant",
    f"{_GPL_GRANT} version 2 of the license": "gpl2-only-grant",
    f"{_GNU.format('library', 'lesser')}{_LATER.format('2 1')}": "lgpl21-or-later-grant",
    f"{_GNU.format('program', 'lesser')}{_LATER.format('2 1')}": "lgpl21-or-later-grant",
    f"{_GNU.format('library', 'lesser')}{_LATER.format('3')}": "lgpl3-or-later-grant",
    f"{_GNU.format('program', 'lesser')}{_LATER.format('3')}": "lgpl3-or-later-grant",
    f"{_GNU.format('program', 'affero')}{_LATER.format('3')}": "agpl3-or-later-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl1-grant",
    "this project is licensed under the mit license": "mit-notice",
    "this project is licensed under the apache license version 2 0": "apache2-notice",
    _CC.format("a", "sharealike "): "ccbysa4-notice",
    _CC.format("the", "sharealike "): "ccbysa4-notice",
    _CC.format("a", ""): "ccby4-notice",
    _CC.format("the", ""): "ccby4-notice",
    _CC.format("a", "noncommercial "): "ccbync4-notice",
    _CC.format("the", "noncommercial "): "ccbync4-notice",
    "apache license version 2 0 january 2004": "apache2-title",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "mozilla public license version 2 0": "mpl2-title",
    "the content of this page is licensed under cc by 4 0": "ccby4-notice",
    "dual licensed under the mit license or the apache license version 2 0": "mit-or-apache2-notice",
    "dual licensed under the apache license version 2 0 or the mit license": "mit-or-apache2-notice",
    "licensed under either of apache license version 2 0 or mit license at your option": "mit-or-apache2-notice",
}

FULL_RULES = [
    ("GPL-3.0-or-later", ["gpl3-or-later-grant"]),
    ("GPL-3.0-only", ["gpl3-only-grant"]),
    ("GPL-2.0-or-later", ["gpl2-or-later-grant"]),
    ("GPL-2.0-only", ["gpl2-only-grant"]),
    ("LGPL-2.1-or-later", ["lgpl21-or-later-grant"]),
    ("LGPL-3.0-or-later", ["lgpl3-or-later-grant"]),
    ("AGPL-3.0-or-later", ["agpl3-or-later-grant"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-notice"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["bsl1-grant"]),
    ("CC-BY-SA-4.0", ["ccbysa4-notice"]),
    ("Apache-2.0", ["apache2-title"]),
    ("GPL-3.0-only", ["gpl3-title"]),
    ("GPL-2.0-only", ["gpl2-title"]),
    ("LGPL-3.0-only", ["lgpl3-title"]),
    ("LGPL-2.1-only", ["lgpl21-title"]),
    ("AGPL-3.0-only", ["agpl3-title"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("MIT", ["mit-or-apache2-notice"]),
    ("Apache-2.0", ["mit-or-apache2-notice"]),
]

# Names of licences that a tag "SPDX-License-Identifier: name" may give.
SPDX = """
0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0
GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later
MIT MPL-2.0 Unlicense Zlib
""".split()
# Families whose names were once given without "-only" or with "+" for "-or-later".
SPDX_FAMILIES = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
SPDX_NAMES = {name.lower(): name for name in SPDX} | {f.lower(): f"{f}-only" for f in SPDX_FAMILIES} | {f"{f.lower()}+": f"{f}-or-later" for f in SPDX_FAMILIES}
FULL_RULES += [(name, [f"spdx-{name.lower()}"]) for name in SPDX]

# How sentences begin that also count where more words follow.
NOTICES = ("licensed under", "released under", "dual licensed under", "this software is released under")

#: Where pieces end: line ends, and white space after a sentence mark.
SENTENCE_END = r"[.!?;:][ \t]+|[\r\n]+"
# Capitals, which no lower-case text has, mark the ends of pieces (S) and of paragraphs (P).
_PIECE, _PARAGRAPH = "S", "P"
#: In the standard text a name stands here, of 300 characters at most.
_OWNER = r"(?<=[ SP])(neither[ S]the[ S]name[ S]of[ S])[a-z0-9 S]{1,300}?([ S]nor[ S]the[ S]names[ S]of)(?=[ SP])"
#: List marks that are no piece of their own, as in "(1) Redistributions".
_LIST_MARK = r"(?:(?:[0-9]{1,2}|[a-z]) (?=redistributions[ S]|neither[ S]))?"


def marked(text: Column) -> Column:
    """A text of which each run of anything but letters and digits is one blank, S or P; it begins and ends with P."""
    lines = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    blank = F.regexp_replace(lines, r"\n[^a-z0-9\n]*+\n", _PARAGRAPH)
    pieces = F.regexp_replace(blank, SENTENCE_END, _PIECE)
    gaps = F.regexp_replace(pieces, r"[^a-z0-9SP]+", " ")
    gaps = F.regexp_replace(gaps, r" ?S[ S]*", _PIECE)
    return F.regexp_replace(F.concat(F.lit(_PARAGRAPH), gaps, F.lit(_PARAGRAPH)), r"[ S]*P[ SP]*", _PARAGRAPH)


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    # only texts with the first three words of some known sentence are looked through
    starts = "|".join(sorted({"[^a-z0-9]++".join(s.split(" ")[:3]) for s in sentences}))
    longest = "|".join(s.replace(" ", "[ S]") for s in sorted(sentences, key=len, reverse=True))
    named = F.regexp_replace(marked(text), _OWNER, "$1the copyright holder$2")
    amid = "|".join(s.replace(" ", "[ S]") for s in sorted(sentences, key=len, reverse=True) if s.startswith(NOTICES))
    # where a piece is no known sentence as a whole, a notice at its beginning counts, and what follows it not
    part = rf"|[SP](?:{amid})(?= )" if amid else ""
    hits = F.regexp_extract_all(named, F.lit(rf"[SP]{_LIST_MARK}(?:{longest})(?=[SP]){part}"), F.lit(0))
    hits = F.transform(hits, lambda s: F.trim(F.regexp_replace(F.translate(s, "SP", "  "), rf"^ *{_LIST_MARK.replace('S', ' ')}", "")))
    found = F.transform(hits, lambda s: F.try_element_at(known, s))
    return F.when(F.lower(text).rlike(rf"(?<![a-z0-9])(?:{starts})(?![a-z0-9])"), found).otherwise(F.array().cast("array<string>"))


def tag_ids(text: Column) -> Column:
    """Identifiers of the licences in the tags of a text, in order."""
    known = F.create_map(*[F.lit(x) for name, meant in SPDX_NAMES.items() for x in (name, f"spdx-{meant.lower()}")])
    tags = F.regexp_extract_all(F.lower(text), F.lit(r"spdx-license-identifier:[ \t]*([a-z0-9.+() \t-]+)"), F.lit(1))
    names = F.flatten(F.transform(tags, lambda t: F.split(F.regexp_replace(t, r"\bwith[ \t]+[a-z0-9.-]+", " "), r"[() \t]+")))
    return F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier:")), F.filter(F.transform(names, lambda n: F.try_element_at(known, n)), lambda i: i.isNotNull())).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_sentences, sentence_ids, licenses, n_licenses).

    sentence_ids is the sequence of known sentences; licenses are the distinct names of the rules
    that fire, in the order of the rules; n_sentences counts pieces with a letter or digit.
    """
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    found = rows.select(
        "doc_id",
        F.size(F.filter(F.split("text", SENTENCE_END), lambda s: s.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_sentences"),
        F.concat(sentence_ids(F.col("text"), sentences or SENTENCES | FULL_SENTENCES), tag_ids(F.col("text"))).alias("sentence_ids"),
    )
    line = F.concat(F.lit("|"), F.array_join("sentence_ids", "|"), F.lit("|"))
    rules = rules or RULES + FULL_RULES

    def fires(name: str, ids: list[str]) -> Column:
        own, rest = "|" + "|".join(ids) + "|", line
        for other, more in rules:
            longer = "|" + "|".join(more) + "|"
            if other != name and own in longer and own != longer:
                rest = F.replace(rest, F.lit(longer), F.lit("|"))
        return F.contains(rest, F.lit(own))

    fired = F.array(*[F.when(fires(name, ids), F.lit(name)) for name, ids in rules])
    licenses = F.array_distinct(F.filter(fired, lambda x: x.isNotNull()))
    return found.select("*", licenses.alias("licenses")).select("*", F.size("licenses").cast("long").alias("n_licenses"))
