"""Licence recognition in DataFrame functions only: sentences to identifiers, identifier sequences to licences.

A text is cut into sentences after . ! ? ; : before white space (not in "v. 2"), at empty lines and around the address
of the Apache licence; a sentence is normalised to its lower-case letters and digits with single spaces.  Known
sentences are found as one or more whole lines or parts of lines, so wrapped texts count as unwrapped ones do, and a
single line needs no stop.  They have identifiers; the others are passed over.
A licence is found where its identifiers occur in order, with any others between.

All is one projection of each row, so nothing is shuffled.  Texts without any of ANCHORS, one of which each of the
fixed sentences contains, are not cut at all; a caller's own sentences need no anchor.

Defined results: null and empty texts have no sentence and no licence; licences are named once and in alphabetical
order, so there are no ties; repeated rows are judged each; texts of any length count whole; an empty table gives an
empty one; other columns are not looked at; ids may be of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of public licence texts and notices.
SENTENCES = {
    "apache2_header": "licensed under the apache license version 2 0",
    "apache2_header_long": "licensed under the apache license version 2 0 the license",
    "apache2_comply": "you may not use this file except in compliance with the license",
    "apache2_obtain": "you may obtain a copy of the license at",
    "apache2_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit_notice": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl_free": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl_even": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2_header": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc_by_nc4": "licensed under cc by nc 4 0",
    "cc_by4": "licensed under cc by 4 0",
    "cc_by_sa4": "licensed under cc by sa 4 0",
    "cc_by4_long": "this work is licensed under a creative commons attribution 4 0 international license",
    "all_rights": "all rights reserved",
}
#: Licence and the identifiers that must occur, in this order.
RULES = [
    ("Apache-2.0", ["apache2_header"]),
    ("Apache-2.0", ["apache2_header_long", "apache2_comply", "apache2_obtain", "apache2_basis"]),
    ("MIT", ["mit_notice"]),
    ("MIT", ["mit_licensed"]),
    ("MIT", ["mit_grant", "mit_condition", "mit_warranty"]),
    ("GPL-3.0-only", ["gpl3_work"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_even"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("ISC", ["isc_grant"]),
    ("MPL-2.0", ["mpl2_header"]),
    ("CC-BY-NC-4.0", ["cc_by_nc4"]),
    ("CC-BY-4.0", ["cc_by4"]),
    ("CC-BY-4.0", ["cc_by4_long"]),
    ("CC-BY-SA-4.0", ["cc_by_sa4"]),
    ("LicenseRef-All-Rights-Reserved", ["all_rights"]),
]
ANCHORS = ["license", "permission", "warrant", "redistribution", "rights reserved", "this program"]
#: What stands between the words of a normalised sentence, and what ends a sentence.
GAP = "[^a-z0-9]+"
BREAK = r"([.!?;:])[ \t]+"
#: In lower-case text: what always ends a sentence (marked H), while one line break may stand in a sentence (marked S).
HARD = r"(?:https?://www\.apache\.org/licenses/license-2\.0|(?!(?<=\bv)\.[ \t\r\n]{1,9}[0-9])[.!?;:](?:[ \t]|\r?\n)|\n[^a-z0-9\n]*\n)"

for _s in SENTENCES.values():
    if not any(a in _s for a in ANCHORS):
        raise ValueError(f"no anchor in {_s!r}")


def anchor_pattern() -> str:
    return "(?i)" + "|".join(a.replace(" ", "[^A-Za-z0-9]+") for a in ANCHORS)


def rule_pattern(identifiers: list[str]) -> str:
    """Of the sequence, written ",a,b,c,": the identifiers in order."""
    return "," + ",(?:.*,)?".join(identifiers) + ","


def marked(text: Column) -> Column:
    """The text's words with H, S or a blank between them, and H at both ends."""
    out = F.regexp_replace(F.lower(text), HARD, "H")
    for pattern, mark in (("[^a-z0-9H\n]+", " "), (" *\n[ \n]*", "S"), ("[ S]*H[ SH]*", "H")):
        out = F.regexp_replace(out, pattern, mark)
    return F.regexp_replace(F.concat(F.lit("H"), out, F.lit("H")), "[ S]*H[ SH]*", "H")


def sentence_pattern(sentences: list[str]) -> str:
    """Any of the sentences between marks, the longest first."""
    each = [s.replace(" ", "[ S]") for s in sorted(sentences, key=len, reverse=True)]
    return "(?<=[HS])(?:" + "|".join(each) + ")(?=[HS])"


def sentence_ids(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    gate = text.rlike(anchor_pattern()) if sentences is None else F.lit(True)  # the fixed sentences all hold an anchor
    sentences = SENTENCES if sentences is None else sentences
    if not sentences:
        return F.array().cast("array<string>")
    known = F.create_map(*[F.lit(x) for i, s in sentences.items() for x in (s, i)])
    met = F.regexp_extract_all(marked(text), F.lit(sentence_pattern(list(sentences.values()))), F.lit(0))
    found = F.transform(met, lambda s: F.try_element_at(known, F.translate(s, "S", " ")))
    return F.when(gate, found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Per document: id, sentences (identifiers in order), licenses (names)."""
    rules = RULES if rules is None else rules
    out = docs.select(F.col(id_col), sentence_ids(F.coalesce(F.col(text_col), F.lit("")), sentences).alias("sentences"))
    line = F.concat(F.lit(","), F.array_join("sentences", ","), F.lit(","))
    named = F.array(*[F.when(line.rlike(rule_pattern(ids)), F.lit(name)) for name, ids in rules])
    return out.select(id_col, "sentences", F.array_sort(F.array_distinct(F.array_compact(named))).alias("licenses"))
