"""License scan by sentence rules, with DataFrame functions only.

A text is cut into pieces at line ends and at stops before white space, without the marks of comments and lists that begin or
end a line. A known license sentence is found where its words fill one piece or several that follow each other, so that lines
may be broken anywhere; the identifiers found, in order, make a sequence. Ordered rules, longest first, are sequences of
identifiers: a rule that occurs names its license and takes its identifiers out, so that what a full license says is not
counted again as a mere reference. What no rule takes stays listed.

The SQL twin knows ``SENTENCES`` and ``RULES`` only, and a sentence only as a single piece: it agrees on texts of such lines.

Nothing is shuffled: each row is scanned for itself, and only texts with one of a few telling words are cut at all.

Defined cases: null and empty texts have no sentences and no license. A license named twice counts once in ``licenses`` and
twice in ``n_matched``. Rows that repeat are scanned each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketlake.llm.common import text_or_empty

__all__ = ["RULES", "SENTENCES", "WHOLE_RULES", "WHOLE_SENTENCES", "scan", "scan_sql", "normal"]

# Known license sentences in normal form, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "provided as is without warranty of any kind express or implied": "AsIs",
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted": "IscGrant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdPre",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BsdBinary",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu lesser general public license version 3": "Lgpl3Ref",
    "licensed under the gnu affero general public license version 3": "Agpl3Ref",
    "you should have received a copy of the gnu general public license along with this program": "GplReceived",
    "licensed under the mozilla public license version 2.0": "Mpl2Ref",
    "licensed under cc by 4.0": "CcByRef",
    "licensed under cc by-sa 4.0": "CcBySaRef",
    "licensed under cc by-nc 4.0": "CcByNcRef",
    "licensed under cc by-nd 4.0": "CcByNdRef",
    "spdx-license-identifier mit": "SpdxMit",
    "spdx-license-identifier apache-2.0": "SpdxApache",
    "spdx-license-identifier gpl-3.0-only": "SpdxGpl3",
    "all rights reserved under copyright": "Reserved",
}

#: License and the sequence of identifiers that says it; earlier rules go first.
RULES = [
    ("MIT", ("MitGrant", "MitNotice", "AsIs")),
    ("BSD-2-Clause", ("BsdPre", "BsdSource", "BsdBinary")),
    ("Apache-2.0", ("ApacheRef", "ApacheComply", "ApacheCopy", "ApacheSee")),
    ("Apache-2.0", ("ApacheRef", "ApacheComply")),
    ("ISC", ("IscGrant", "AsIs")),
    ("GPL-3.0", ("Gpl3Ref", "GplReceived")),
    ("MIT", ("MitRef",)), ("Apache-2.0", ("ApacheRef",)), ("GPL-2.0", ("Gpl2Ref",)), ("GPL-3.0", ("Gpl3Ref",)),
    ("LGPL-3.0", ("Lgpl3Ref",)), ("AGPL-3.0", ("Agpl3Ref",)), ("MPL-2.0", ("Mpl2Ref",)),
    ("CC-BY-4.0", ("CcByRef",)), ("CC-BY-SA-4.0", ("CcBySaRef",)), ("CC-BY-NC-4.0", ("CcByNcRef",)), ("CC-BY-ND-4.0", ("CcByNdRef",)),
    ("MIT", ("SpdxMit",)), ("Apache-2.0", ("SpdxApache",)), ("GPL-3.0", ("SpdxGpl3",)),
]

_MIT_GRANT = next(s for s, i in SENTENCES.items() if i == "MitGrant")
_ISC_GRANT = next(s for s, i in SENTENCES.items() if i == "IscGrant")
_NOT_ENDORSED = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"

#: The licenses' own sentences where these are longer than the short forms above, and those that tell licenses apart.
WHOLE_SENTENCES = {
    "licensed under the apache license version 2.0 the license": "ApacheRef",
    "you may obtain a copy of the license at http //www.apache.org/licenses/license-2.0": "ApacheCopy",
    "you may obtain a copy of the license at https //www.apache.org/licenses/license-2.0": "ApacheCopy",
    "apache license version 2.0 january 2004": "ApacheTitle",
    f"{_MIT_GRANT} including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MitNotice",
    "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIs",
    f"{_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies": "IscGrantNotice",
    f"{_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies".replace("and/or", "and"): "IscGrantNotice",
    "provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "Disclaims",
    "provided as is and isc disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "Disclaims",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BsdAdvert",
    _NOT_ENDORSED: "BsdNotEndorsed",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "Mpl2Ref",
}

#: License and the sequence of identifiers that says it; these go before ``RULES``.
WHOLE_RULES = [
    ("BSD-4-Clause", ("BsdPre", "BsdSource", "BsdBinary", "BsdAdvert", "BsdNotEndorsed")),
    ("BSD-3-Clause", ("BsdPre", "BsdSource", "BsdBinary", "BsdNotEndorsed")),
    ("ISC", ("IscGrantNotice", "Disclaims")), ("0BSD", ("IscGrant", "Disclaims")), ("Apache-2.0", ("ApacheTitle",)),
]

# (license, identifier of a reference, GNU name, version, date of the license's own title)
for _license, _id, _name, _version, _date in (
    ("GPL-2.0", "Gpl2", "general", "2", "june 1991"), ("GPL-3.0", "Gpl3", "general", "3", "29 june 2007"),
    ("LGPL-2.1", "Lgpl21", "lesser general", "2.1", "february 1999"), ("LGPL-3.0", "Lgpl3", "lesser general", "3", "29 june 2007"),
    ("AGPL-3.0", "Agpl3", "affero general", "3", "19 november 2007"),
):
    _received = _id.rstrip("123") + "Received"
    _terms = f"free software you can redistribute it and/or modify it under the terms of the gnu {_name} public license"
    WHOLE_SENTENCES |= {
        f"licensed under the gnu {_name} public license version {_version}": f"{_id}Ref",
        f"{_terms} as published by the free software foundation either version {_version} of the license or at your option any later version": f"{_id}Ref",
        f"{_terms} as published by the free software foundation version {_version} of the license": f"{_id}Ref",
        f"{_terms} version {_version} as published by the free software foundation": f"{_id}Ref",
        f"gnu {_name} public license version {_version} {_date}": f"{_id}Title",
    } | {f"you should have received a copy of the gnu {_name} public license along with this {what}": _received for what in ("program", "library", "software")}
    WHOLE_RULES += [(_license, (f"{_id}Ref", _received)), (_license, (f"{_id}Ref",)), (_license, (f"{_id}Title",))]

for _license, _names in {
    "MIT": ("mit",), "Apache-2.0": ("apache-2.0",), "ISC": ("isc",), "0BSD": ("0bsd",), "BSD-2-Clause": ("bsd-2-clause",), "BSD-3-Clause": ("bsd-3-clause",),
    "GPL-2.0": ("gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later"), "GPL-3.0": ("gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later"),
    "LGPL-2.1": ("lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later"), "LGPL-3.0": ("lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"),
    "AGPL-3.0": ("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"), "MPL-2.0": ("mpl-2.0",),
    "CC-BY-4.0": ("cc-by-4.0",), "CC-BY-SA-4.0": ("cc-by-sa-4.0",), "CC-BY-NC-4.0": ("cc-by-nc-4.0",), "CC-BY-ND-4.0": ("cc-by-nd-4.0",),
}.items():
    for _name in _names:
        _known = SENTENCES.get(f"spdx-license-identifier {_name}")
        _id = _known or "Spdx" + _license.replace("-", "").replace(".", "")
        WHOLE_SENTENCES[f"spdx-license-identifier {_name}"] = _id
        if (_license, (_id,)) not in RULES + WHOLE_RULES:
            WHOLE_RULES.append((_license, (_id,)))

#: Every known sentence has one of these; a text without any is not cut.
TELLING = ("licen", "permission", "redistribution", "copyright", "warrant", "acknowledgement")

_STOPS, _OTHER = r"([.;:!?])[ \t\r\n]+", r"[^A-Za-z0-9./-]+"
_EDGES, _LEAD = r"^[ .]+|[ .]+$", r"^(this|the) (work|file|software|program|document|code|library|text) is "

# what begins or ends a line of a comment or a list
_MARKS = r"(?m)^[ \t]*(?:<!--|/\*+|\*+/|//+|#+|\*+|;+|--?|%+|>+|\(?[0-9]{1,2}\)|\([a-z]\))(?=\s|$)|^[ \t]*(?:/\*+|//+|#+|;+|--)|(?:\*/|-->)[ \t\r]*$"
_GAP = r"[ \n]"
#: The clause against endorsement, whoever is named in it.
_ENDORSE = r"(?<![^\n])(?:neither the name|neither the names|the name|the names) of [a-z0-9 \n./-]{1,400}? endorse or promote products derived from this software(?: without (?:specific )?prior written permission)?(?![^\n])".replace("[a-z0-9 \\n./-]", "@").replace(" ", _GAP).replace("@", "[a-z0-9 \\n./-]")


def _sentence_pattern() -> str:
    """Known sentences, longest first, between ends of pieces; "this work is" may lead."""
    lead = _LEAD[1:].replace("(", "(?:").replace(" ", _GAP)
    some = "|".join(s.replace(".", r"\.").replace(" ", _GAP) for s in sorted(SENTENCES | WHOLE_SENTENCES, key=len, reverse=True))
    return rf"(?<![^\n])(?:{lead})?({some})(?![^\n])"


def normal(sentence: Column) -> Column:
    """Words in lower case, other marks as single blanks; stops at the ends and a leading "this work is" go."""
    words = F.regexp_replace(F.lower(F.regexp_replace(sentence, _OTHER, " ")), _EDGES, "")
    return F.regexp_replace(words, _LEAD, "")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, sentences (identifiers in order, joined by commas), licenses (named ones, sorted and
    joined by commas), n_matched (rules that matched, with repeats), unmatched (identifiers that no rule took)."""
    own = text_or_empty(text)
    telling = F.lit(False)
    for word in TELLING:
        telling = telling | F.contains(F.lower(own), F.lit(word))
    known = F.create_map(*[F.lit(x) for pair in (SENTENCES | WHOLE_SENTENCES).items() for x in pair])
    cut = F.regexp_replace(F.regexp_replace(own, _MARKS, " "), _STOPS, "$1\n")
    words = F.lower(F.regexp_replace(cut, _OTHER.replace("./", r"./\n"), " "))
    # no known sentence has such a run; left as it is, each of its characters would start a search
    words = F.regexp_replace(words, "[ .]{16,}", " . ")
    pieces = F.regexp_replace(F.regexp_replace(words, r"[ .]*\n[ .\n]*", "\n"), r"^[ .\n]+|[ .\n]+$", "")
    found = F.regexp_extract_all(F.regexp_replace(pieces, _ENDORSE, _NOT_ENDORSED), F.lit(_sentence_pattern()), F.lit(1))
    said = F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " ")))
    rows = docs.select(F.col(doc_id), F.when(telling, said).otherwise(F.array().cast("array<string>")).alias("_said"))
    # each identifier stands between two bars, so that sequences neither touch nor overlap
    state = rows.select(doc_id, F.array_join("_said", ",").alias("sentences"), F.concat_ws("", F.transform("_said", lambda x: F.concat(F.lit("|"), x, F.lit("|")))).alias("_left"), F.array().cast("array<string>").alias("_named"), F.lit(0).alias("n_matched"))
    for license_id, sequence in WHOLE_RULES + RULES:
        shown = "".join(f"|{s}|" for s in sequence)
        after = F.replace(F.col("_left"), F.lit(shown), F.lit(""))
        times = ((F.length("_left") - F.length(after)) / len(shown)).cast("int")
        state = state.select(
            doc_id, "sentences", after.alias("_left"), (F.col("n_matched") + times).alias("n_matched"),
            F.when(times > 0, F.array_union("_named", F.array(F.lit(license_id)))).otherwise(F.col("_named")).alias("_named"),
        )
    return state.select(
        doc_id, "sentences", F.array_join(F.array_sort("_named"), ",").alias("licenses"), "n_matched",
        F.replace(F.replace(F.regexp_replace("_left", r"^\||\|$", ""), F.lit("||"), F.lit(",")), F.lit("|"), F.lit(",")).alias("unmatched"),
    )


def scan_sql() -> str:
    """The same scan in DuckDB SQL."""
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    known = "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in SENTENCES.items()) + "}"
    norm = f"regexp_replace(regexp_replace(lower(regexp_replace(s, {text(_OTHER)}, ' ', 'g')), {text(_EDGES)}, '', 'g'), {text(_LEAD)}, '')"
    steps = [f"""said AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), {text(_STOPS)}, '\\1' || chr(10), 'g'), chr(10)),
  lambda s: element_at({known}, {norm})[1]), lambda x: x IS NOT NULL) AS said FROM documents)""",
        "s0 AS (SELECT doc_id, array_to_string(said, ',') AS sentences, coalesce(array_to_string(list_transform(said, lambda x: '|' || x || '|'), ''), '') AS rest, []::VARCHAR[] AS named, 0 AS n FROM said)"]
    for i, (license_id, sequence) in enumerate(RULES):
        shown = text("".join(f"|{x}|" for x in sequence))
        times = f"((length(rest) - length(replace(rest, {shown}, ''))) // length({shown}))"
        steps.append(f"s{i + 1} AS (SELECT doc_id, sentences, replace(rest, {shown}, '') AS rest, CASE WHEN {times} > 0 THEN list_append(named, {text(license_id)}) ELSE named END AS named, n + {times} AS n FROM s{i})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, coalesce(sentences, '') AS sentences, coalesce(array_to_string(list_sort(list_distinct(named)), ','), '') AS licenses, n::INTEGER AS n_matched,
  replace(replace(regexp_replace(rest, '^\\||\\|$', '', 'g'), '||', ','), '|', ',') AS unmatched
FROM s{len(RULES)}"""
