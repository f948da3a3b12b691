"""Licence recognition from sentences, with DataFrame functions only.

A text is cut into sentences, each is normalised (A-Z lower-cased, runs of other characters than a-z and 0-9 become one
space) and looked up among the known licence sentences. The identifiers found, in text order, are matched against ordered
rules: a rule holds if its identifiers occur in its order, others between them allowed; of each family the first rule wins.
A known sentence begins and ends where a sentence or line does and may be wrapped, its lines indented or behind comment
marks. One that holds sentence ends itself ("SPDX-License-Identifier: MIT") is known by all its parts in their order, never by
one of them. Where known sentences overlap the first one counts, of several from one place the longest.

Null and empty texts have no sentences and no licences. Repeated sentences count each time; repeated rows keep a row each;
ties cannot arise, as rules have a fixed order; extra columns, whatever their names, are ignored; an empty table gives no
rows; texts of any length are read whole, in one pass and without recursion. Null doc_ids stay null. No shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands in a known sentence for a name of 1 to 12 words.
ANYONE = "zzanyone"
# Sentences of public licences and licence notices, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-name": "MIT License",
    "mit-name3": "The MIT License (MIT)",
    "mit-ref": "Released under the MIT License",
    "mit-ref2": "Licensed under the MIT License",
    "isc-name": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of zzanyone nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse2": "The name of zzanyone may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY zzanyone \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "apache-ref": "Licensed under the Apache License, Version 2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-head": "Apache License Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl-head3": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-head2": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl-head3": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-head21": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl-head3": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2-later": "either version 2 of the License, or (at your option) any later version",
    "gpl3-later": "either version 3 of the License, or (at your option) any later version",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-warranty": "See the GNU General Public License for more details",
    "lgpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21-later": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl2-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-head": "Mozilla Public License Version 2.0",
    "epl2-avail": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1-avail": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "epl1-all": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "bsl-ref": "Distributed under the Boost Software License, Version 1.0",
    "bsl-name": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cc-by-ref": "Licensed under CC BY 4.0",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0",
    "cc0-ref": "Licensed under CC0 1.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
}
# SPDX identifiers known in tags, by family.
TAGS = {
    "mit": ["MIT"],
    "isc": ["ISC"],
    "bsd": ["0BSD", "BSD-2-Clause", "BSD-3-Clause"],
    "apache": ["Apache-2.0"],
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"],
    "mpl": ["MPL-2.0"],
    "epl": ["EPL-1.0", "EPL-2.0"],
    "bsl": ["BSL-1.0"],
    "zlib": ["Zlib"],
    "unlicense": ["Unlicense"],
    "cc": ["CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0"],
}
SENTENCES |= {f"spdx-{t.lower()}": f"SPDX-License-Identifier: {t}" for tags in TAGS.values() for t in tags}
# Rules in order: licence, family, identifiers in order. Of a family the first that holds is reported.
RULES = [
    ("MIT", "mit", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", "mit", ["mit-grant", "mit-notice"]),
    ("MIT", "mit", ["mit-ref"]),
    ("MIT", "mit", ["mit-ref2"]),
    *((t, f, [f"spdx-{t.lower()}"]) for f, tags in TAGS.items() for t in tags),
    ("MIT-name-only", "mit", ["mit-name"]),
    ("MIT-name-only", "mit", ["mit-name3"]),
    ("ISC", "isc", ["isc-grant"]),
    ("ISC-name-only", "isc", ["isc-name"]),
    ("0BSD", "bsd", ["0bsd-grant"]),
    ("BSD-4-Clause", "bsd", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"]),
    ("BSD-3-Clause", "bsd", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", "bsd", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse2"]),
    ("BSD-2-Clause", "bsd", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-1-Clause", "bsd", ["bsd-grant", "bsd-source"]),
    ("Apache-2.0", "apache", ["apache-header", "apache-comply", "apache-copy"]),
    ("Apache-2.0", "apache", ["apache-head", "apache-terms"]),
    ("Apache-2.0", "apache", ["apache-ref"]),
    ("Apache-2.0", "apache", ["apache-header"]),
    ("AGPL-3.0-only", "agpl", ["agpl-head3"]),
    ("AGPL-3.0-or-later", "agpl", ["agpl3-terms"]),
    ("AGPL-3.0-or-later", "agpl", ["agpl-redistribute", "gpl3-later"]),
    ("LGPL-3.0-only", "lgpl", ["lgpl-head3"]),
    ("LGPL-2.1-only", "lgpl", ["lgpl-head21"]),
    ("LGPL-3.0-or-later", "lgpl", ["lgpl3-terms"]),
    ("LGPL-3.0-or-later", "lgpl", ["lgpl-redistribute", "gpl3-later"]),
    ("LGPL-2.1-or-later", "lgpl", ["lgpl-redistribute", "lgpl21-later"]),
    ("GPL-3.0-only", "gpl", ["gpl3-ref"]),
    ("GPL-3.0-or-later", "gpl", ["gpl-redistribute"]),
    ("GPL-3.0-or-later", "gpl", ["gpl3-terms"]),
    ("GPL-3.0-or-later", "gpl", ["gpl2-redistribute", "gpl3-later"]),
    ("GPL-2.0-or-later", "gpl", ["gpl2-redistribute", "gpl2-later"]),
    ("GPL-2.0-only", "gpl", ["gpl2-only"]),
    ("GPL-3.0-only", "gpl", ["gpl-head3"]),
    ("GPL-2.0-only", "gpl", ["gpl-head2"]),
    ("MPL-2.0", "mpl", ["mpl2-subject", "mpl2"]),
    ("MPL-2.0", "mpl", ["mpl2-subject", "mpl2-https"]),
    ("MPL-2.0", "mpl", ["mpl2-head"]),
    ("EPL-2.0", "epl", ["epl2-avail"]),
    ("EPL-1.0", "epl", ["epl1-avail"]),
    ("EPL-1.0", "epl", ["epl1-all"]),
    ("BSL-1.0", "bsl", ["bsl-grant"]),
    ("BSL-1.0", "bsl", ["bsl-ref"]),
    ("BSL-1.0", "bsl", ["bsl-name"]),
    ("Zlib", "zlib", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", "zlib", ["zlib-grant"]),
    ("Unlicense", "unlicense", ["unlicense"]),
    ("WTFPL", "wtfpl", ["wtfpl"]),
    ("CC-BY-NC-4.0", "cc", ["cc-by-nc-ref"]),
    ("CC-BY-NC-4.0", "cc", ["cc-by-nc-long"]),
    ("CC-BY-SA-4.0", "cc", ["cc-by-sa-ref"]),
    ("CC-BY-SA-4.0", "cc", ["cc-by-sa-long"]),
    ("CC-BY-4.0", "cc", ["cc-by-ref"]),
    ("CC-BY-4.0", "cc", ["cc-by-long"]),
    ("CC0-1.0", "cc", ["cc0-ref"]),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A comment mark that isn't a run of other characters; where sentences end but for a line's.
COMMENT, MARKS = r"(^|\n)[ \t]*(?:;+|(?:dnl|DNL|rem|REM)[ \t])", r"[.!?;:]+[ \t\r\n]+|[.!?;:]+\z"
#: The number or letter of a list item, which belongs to no sentence.
ITEM = r"([\x01\x02]|^)(?:[0-9]{1,2}|[a-d])[\x01\x02]"


def normalised(sentence: str) -> str:
    """A known sentence as marked() leaves it in a text, on one line; \x01 where it holds a sentence end."""
    body = re.sub(MARKS.replace(r"\z", r"\Z"), "\x01", sentence.translate(str.maketrans(UPPER, LOWER)))
    return re.sub(r" ?\x01 ?", "\x01", re.sub(r"[^a-z0-9\x01]+", " ", body)).strip(" \x01")


def known() -> dict[str, str]:
    """Identifier of each normalised sentence, whole; no two are equal and none is a single word."""
    out = {normalised(s): k for k, s in SENTENCES.items()}
    if len(out) < len(SENTENCES) or any(len(re.split(r"[ \x01]", s)) < 2 for s in out):
        raise ValueError("licence sentences must be distinct and of two words or more")
    return out


def pattern(sentence: str) -> str:
    """A normalised sentence in marked text: each space may be a line's end, a name any words."""
    return re.sub(" ", r"[ \\x02]", sentence).replace(ANYONE, r"[a-z0-9]+(?:[ \x02][a-z0-9]+){0,11}").replace("\x01", r"\x01")


def marked(text: Column) -> Column:
    """The normalised sentences; \x01 stands where one ends, \x02 where only a line does, after which a sentence may go on."""
    body = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "  "), COMMENT, "$1 ")
    body = F.translate(F.regexp_replace(F.translate(body, UPPER, LOWER), MARKS, "\x01"), "\n", "\x02")
    body = F.regexp_replace(body, r"[^a-z0-9\x01\x02]+", " ")  # with it go indentation and most comment marks
    body = F.regexp_replace(body, r"\x02 ?(?:\x02 ?)+", "\x01")  # no sentence goes on behind an empty line
    return F.regexp_replace(F.trim(F.regexp_replace(body, r" ?([\x01\x02]) ?", "$1")), ITEM, "$1")


def heads(ids: dict[str, str]) -> list[str]:
    """What sentences that begin a known one begin with: its first two words, or the first alone where a line may end behind it."""
    out = set()
    for s in ids:
        one, two = re.split(r"[ \x01]", s)[:2]
        if ANYONE in (one, two):
            raise ValueError("a known sentence must begin with two words of its own")
        out |= {one, f"{one} {two}"}
    return sorted(out)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (lines count as such), n_known, sentence_ids and licences (comma-joined, in text and rule order), n_licences."""
    ids = known()
    names = F.create_map(*(F.lit(x) for kv in ids.items() if ANYONE not in kv[0] for x in kv))
    longest = sorted(ids, key=lambda s: (-len(s), s))
    one = F.lit(r"(?<![^\x01\x02])(" + "|".join(map(pattern, longest)) + r")(?![^\x01\x02])")

    def name(hit: Column) -> Column:
        out = names[F.translate(hit, "\x02", " ")]
        for s in longest:
            if ANYONE in s:
                out = F.coalesce(out, F.when(hit.rlike(f"^{pattern(s)}$"), F.lit(ids[s])))
        return out

    found = docs.select("doc_id", marked(F.col("text")).alias("body"))
    found = found.withColumn("pieces", F.filter(F.split("body", r"[\x01\x02]"), lambda s: s != ""))
    # sentences are looked up by their first words; only texts in which one begins like a known sentence are read for whole ones
    maybe = F.arrays_overlap(F.transform("pieces", lambda s: F.substring_index(s, " ", 2)), F.array(*map(F.lit, heads(ids))))
    hits = F.when(maybe, F.regexp_extract_all("body", one, F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = found.select("doc_id", F.size("pieces").alias("n_sentences"), hits.alias("hits"))
    found = found.withColumn("hits", F.transform("hits", name))
    line = F.concat(F.lit("<"), F.array_join("hits", "><"), F.lit(">"))
    picks, earlier = [], {}
    for name, family, seq in RULES:
        holds = line.like("%" + "%".join(f"<{i}>" for i in seq) + "%")
        first = holds & ~earlier[family] if family in earlier else holds
        picks.append(F.when(first, F.lit(name)))
        earlier[family] = earlier[family] | holds if family in earlier else holds
    got = found.withColumn("found", F.when(F.size("hits") > 0, F.array_compact(F.array(*picks))).otherwise(F.array().cast("array<string>")))
    return got.select("doc_id", F.col("n_sentences").cast("long").alias("n_sentences"), F.size("hits").cast("long").alias("n_known"), F.array_join("hits", ",").alias("sentence_ids"), F.array_join("found", ",").alias("licences"), F.size("found").cast("long").alias("n_licences"))


def op6_licences(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The SQL twin. It has its own way: it normalises the known sentences itself and joins them to the places where lines and sentences begin."""
    seen, picks = {}, []
    for name, family, seq in RULES:
        holds = "line LIKE " + _q("%" + "%".join(f"<{i}>" for i in seq) + "%")
        picks.append(f"CASE WHEN {holds}" + "".join(f" AND NOT ({h})" for h in seen.get(family, [])) + f" THEN {_q(name)} END")
        seen.setdefault(family, []).append(holds)

    def marked(text: str) -> str:
        body = f"regexp_replace(translate({text}, chr(1) || chr(2), '  '), {_q(COMMENT)}, '\\1 ', 'g')"
        body = f"translate(regexp_replace(translate({body}, {_q(UPPER)}, {_q(LOWER)}), {_q(MARKS)}, chr(1), 'g'), chr(10), chr(2))"
        body = f"regexp_replace({body}, '[^a-z0-9\\x01\\x02]+', ' ', 'g')"
        body = f"regexp_replace({body}, '\\x02 ?(?:\\x02 ?)+', chr(1), 'g')"
        return f"regexp_replace(trim(regexp_replace({body}, ' ?([\\x01\\x02]) ?', '\\1', 'g'), ' '), {_q(ITEM)}, '\\1', 'g')"

    return f"""
    WITH raw(id, sentence) AS (VALUES {', '.join(f'({_q(i)}, {_q(s)})' for i, s in SENTENCES.items())}),
    known AS (SELECT id, trim({marked('sentence')}, chr(1)) AS norm FROM raw),
    spec AS (SELECT id, norm, left(norm, 9) AS head, '^(' || replace(replace(norm, ' ', '[ \\x02]'), {_q(ANYONE)}, '[a-z0-9]+(?:[ \\x02][a-z0-9]+){{0,11}}') || ')(?:[\\x01\\x02]|$)' AS re FROM known),
    body AS (SELECT row_number() OVER () AS r, doc_id, {marked("coalesce(text, '')")} AS b FROM documents),
    piece AS (SELECT r, b, unnest(pieces) AS s, generate_subscripts(pieces, 1) AS k FROM (SELECT r, b, string_split_regex(b, '[\\x01\\x02]') AS pieces FROM body)),
    place AS (SELECT r, b, s, 1 + coalesce(sum(length(s) + 1) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM piece),
    counted AS (SELECT r, count(*) FILTER (WHERE s <> '') AS n_sentences FROM piece GROUP BY r),
    cand AS (SELECT r, p, id, norm, length(regexp_extract(substr(b, p::BIGINT, 2000), re, 1)) AS n FROM place JOIN spec ON translate(substr(b, p::BIGINT, 9), chr(2), ' ') = head),
    longest AS (SELECT r, p, arg_min(id, (-length(norm), norm)) AS id, arg_min(n, (-length(norm), norm)) AS n FROM cand WHERE n > 0 GROUP BY r, p),
    listed AS (SELECT r, list(struct_pack(p := p::BIGINT, n := n::BIGINT, id := id) ORDER BY p) AS c FROM longest GROUP BY r),
    kept AS (SELECT r, list_reduce(list_concat([struct_pack(e := 0::BIGINT, ids := []::VARCHAR[])], list_transform(c, lambda x: struct_pack(e := x.p, ids := [x.id, (x.p + x.n)::VARCHAR]))),
      lambda a, x: CASE WHEN x.e >= a.e THEN struct_pack(e := x.ids[2]::BIGINT, ids := list_append(a.ids, x.ids[1])) ELSE a END).ids AS hits FROM listed),
    l AS (SELECT doc_id, n_sentences, coalesce(hits, []) AS hits, '<' || array_to_string(coalesce(hits, []), '><') || '>' AS line FROM body JOIN counted USING (r) LEFT JOIN kept USING (r)),
    f AS (SELECT *, list_filter([{', '.join(picks)}], lambda x: x IS NOT NULL) AS found FROM l)
    SELECT doc_id, n_sentences::BIGINT AS n_sentences, len(hits)::BIGINT AS n_known, coalesce(array_to_string(hits, ','), '') AS sentence_ids,
      coalesce(array_to_string(found, ','), '') AS licences, len(found)::BIGINT AS n_licences FROM f"""
