"""Licence scans by sentence rules: known sentences become identifiers, identifier sequences become licences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences as they are published, with the identifier of each.
SENTENCES = [
    ("Licensed under the Apache License, Version 2.0.", "ref-apache-2.0"),
    ('Licensed under the Apache License, Version 2.0 (the "License")', "ref-apache-2.0"),
    ("you may not use this file except in compliance with the License.", "apache-compliance"),
    ("You may obtain a copy of the License at", "apache-copy"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache-url"),
    ("Released under the MIT License.", "ref-mit"),
    ("Licensed under the MIT License.", "ref-mit"),
    ("This project is licensed under the MIT License.", "ref-mit"),
    ("The MIT License (MIT)", "mit-title"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit-notice"),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', "mit-warranty"),
    ("This work is licensed under the GNU General Public License, version 3.", "ref-gpl-3.0"),
    ("Licensed under the GNU General Public License, version 3.", "ref-gpl-3.0"),
    ("Licensed under the GNU General Public License, version 2.", "ref-gpl-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0-or-later"),
    ("This program is free software", "free-software"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl-terms"),
    ("either version 2 of the License, or (at your option) any later version.", "gpl-2.0-later"),
    ("either version 3 of the License, or (at your option) any later version.", "gpl-3.0-later"),
    ("Licensed under the GNU Lesser General Public License, version 3.", "ref-lgpl-3.0"),
    ("Licensed under the GNU Affero General Public License, version 3.", "ref-agpl-3.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "ref-mpl-2.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd-grant"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd-source"),
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "bsd-binary"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-names"),
    ("Licensed under the BSD 3-Clause License.", "ref-bsd-3-clause"),
    ("Licensed under the BSD 2-Clause License.", "ref-bsd-2-clause"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc-grant"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Licensed under CC BY 4.0.", "ref-cc-by-4.0"),
    ("Licensed under CC BY-SA 4.0.", "ref-cc-by-sa-4.0"),
    ("Licensed under CC BY-NC 4.0.", "ref-cc-by-nc-4.0"),
    ("Licensed under CC BY-ND 4.0.", "ref-cc-by-nd-4.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "ref-cc-by-nc-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "ref-cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "ref-cc-by-sa-4.0"),
    ("All rights reserved.", "rights-reserved"),
    ("SPDX-License-Identifier: Apache-2.0", "ref-apache-2.0"),
    ("SPDX-License-Identifier: MIT", "ref-mit"),
    ("SPDX-License-Identifier: GPL-3.0-only", "ref-gpl-3.0"),
    ("SPDX-License-Identifier: MPL-2.0", "ref-mpl-2.0"),
    ("SPDX-License-Identifier: BSD-3-Clause", "ref-bsd-3-clause"),
]
#: Ordered rules: the identifiers, one after another, that make a licence. Earlier rules take their sentences first.
RULES = [
    (["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"], "BSD-3-Clause"),
    (["bsd-grant", "bsd-source", "bsd-binary"], "BSD-2-Clause"),
    (["mit-title", "mit-notice", "mit-warranty"], "MIT"),
    (["mit-notice", "mit-warranty"], "MIT"),
    (["ref-apache-2.0", "apache-compliance", "apache-copy", "apache-url"], "Apache-2.0"),
    (["ref-apache-2.0"], "Apache-2.0"),
    (["ref-mit"], "MIT"),
    (["mit-title"], "MIT"),
    (["gpl-3.0-or-later"], "GPL-3.0-or-later"),
    (["free-software", "gpl-terms", "gpl-3.0-later"], "GPL-3.0-or-later"),
    (["free-software", "gpl-terms", "gpl-2.0-later"], "GPL-2.0-or-later"),
    (["ref-gpl-3.0"], "GPL-3.0-only"),
    (["ref-gpl-2.0"], "GPL-2.0-only"),
    (["ref-lgpl-3.0"], "LGPL-3.0-only"),
    (["ref-agpl-3.0"], "AGPL-3.0-only"),
    (["ref-mpl-2.0"], "MPL-2.0"),
    (["ref-bsd-3-clause"], "BSD-3-Clause"),
    (["ref-bsd-2-clause"], "BSD-2-Clause"),
    (["isc-grant"], "ISC"),
    (["unlicense"], "Unlicense"),
    (["ref-cc-by-nc-sa-4.0"], "CC-BY-NC-SA-4.0"),
    (["ref-cc-by-nc-4.0"], "CC-BY-NC-4.0"),
    (["ref-cc-by-nd-4.0"], "CC-BY-ND-4.0"),
    (["ref-cc-by-sa-4.0"], "CC-BY-SA-4.0"),
    (["ref-cc-by-4.0"], "CC-BY-4.0"),
]
#: Characters of other text (in normal form) that may stand between two identifiers of a rule: a paragraph, such as the grant of the MIT licence.
GAP = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain(sentence: str) -> str:
    """The normal form of a known sentence: lower case, letters and digits, single spaces."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def sentences(text: Column) -> Column:
    """Normal forms of a text's sentences, in order; empty ones dropped."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?;])[ \t\r\f]+", "$1\n"), "\n")
    plain = F.transform(lines, lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " ")))
    return F.filter(plain, lambda s: s != "")


def _pattern(known: Sequence[str]) -> str:
    """Matches the known sentences among pieces that newlines part: a sentence can go over pieces or stand inside one.

    Longer sentences are tried first. An SPDX line ends its piece or goes on with an operator, so
    MIT is not read out of MIT-0.
    """
    some = []
    for s in sorted(known, key=lambda s: (-len(s), s)):
        end = r"(?=$|\n| (?:or|and|with) )" if s.startswith("spdx ") else ""
        some.append(s.replace(" ", r"[ \n]") + end)
    return r"(?<![^ \n])(?:" + "|".join(some) + r")(?![^ \n])"


def scan_licenses(docs: DataFrame, known: Sequence[tuple[str, str]] = SENTENCES, rules: Sequence[tuple[Sequence[str], str]] = RULES, gap: int = GAP) -> DataFrame:
    """One row per document: doc_id, n_sentences, sentence_ids, licenses, unmatched.

    ``sentence_ids`` lists the known sentences in order, joined by ``|``, wherever they stand: wrapped
    over lines, behind comment signs, inside a longer sentence, or cut by their own full stops. Rules apply in order: each
    run of a rule's identifiers, none further than ``gap`` characters from the last, is taken out and adds its licence; ``licenses`` lists distinct
    licences in rule order, ``unmatched`` the identifiers that no rule took. Known sentences and
    rules are tables of the program (a few hundred), not data: they are literals of the plan. All in
    expressions on the row: no shuffle.

    A null or empty text has no sentences; a null doc_id is kept; repeated rows repeat; empty
    tables give no rows; other columns are ignored.
    """
    ids = {_plain(s): i for s, i in known}
    table = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    d = docs.select("doc_id", sentences(F.col("text")).alias("s"))
    # Normal forms hold no control characters, so these two can mark where a known sentence begins and ends.
    d = d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.regexp_replace(F.array_join("s", "\n"), _pattern(list(ids)), "\x01$0\x02").alias("m"))
    whole, after = (F.regexp_extract_all("m", F.lit(p), F.lit(1)) for p in ("\x01([^\x02]*)\x02", "\x02([^\x01]*)"))
    found = F.transform(whole, lambda s: F.element_at(table, F.translate(s, "\n", " ")))
    d = d.select("doc_id", "n_sentences", found.alias("f"), after.alias("a"))
    # Identifiers stand as <a><b>; a long gap, and a rule's run that is cut out, leave <> so that the neighbours don't join.
    left = F.array_join(F.zip_with("f", "a", lambda i, g: F.concat(F.lit("<"), i, F.when(F.length(g) > gap, "><>").otherwise(">"))), "")
    d = d.select("doc_id", "n_sentences", F.array_join("f", "|").alias("sentence_ids"), left.alias("u"), F.array().cast("array<string>").alias("l"))
    hit = F.col("u") != ""
    for run, name in rules:
        pattern = "".join(f"<{i}>" for i in run)
        has = F.col("u").contains(pattern)
        d = d.select("doc_id", "n_sentences", "sentence_ids", F.replace("u", F.lit(pattern), F.lit("<>")).alias("u"), F.when(hit & has, F.array_append("l", F.lit(name))).otherwise(F.col("l")).alias("l"))
    rest = F.filter(F.split(F.regexp_replace("u", "^<|>$", ""), "><"), lambda i: i != "")
    return d.select("doc_id", "n_sentences", "sentence_ids", F.array_join(F.array_distinct("l"), "|").alias("licenses"), F.array_join(rest, "|").alias("unmatched"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: licences named in every text of ``documents``."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    ids = {_plain(s): i for s, i in SENTENCES}
    known = ", ".join(f"('{s}', '{i}')" for s, i in ids.items())
    step = "u0"
    parts = []
    for n, (run, name) in enumerate(RULES):
        pattern = "".join(f"<{i}>" for i in run)
        parts.append(f"r{n} AS (SELECT doc_id, n_sentences, sentence_ids, replace(u, '{pattern}', '<>') AS u, CASE WHEN contains(u, '{pattern}') THEN list_append(l, '{name}') ELSE l END AS l FROM {step})")
        step = f"r{n}"
    return f"""
WITH known(s, id) AS (VALUES {known}),
d AS (SELECT doc_id, row_number() OVER () AS n, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \\t\\r\\f]+', '\\1' || chr(10), 'g'), chr(10)),
  lambda s: trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS ss FROM documents),
p AS (SELECT n, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM d),
o AS (SELECT n, s, i, sum(length(s) + 1) OVER (PARTITION BY n ORDER BY i) AS past FROM p),
g AS (SELECT n, i, id, past - length(s) - lag(past) OVER (PARTITION BY n ORDER BY i) AS gap FROM o JOIN known USING (s)),
k AS (SELECT n, string_agg(id, '|' ORDER BY i) AS ids, string_agg(CASE WHEN gap > {GAP} THEN '<>' ELSE '' END || '<' || id || '>', '' ORDER BY i) AS u FROM g GROUP BY n),
u0 AS (SELECT doc_id, len(ss)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(u, '') AS u, []::VARCHAR[] AS l FROM d LEFT JOIN k USING (n)),
{", ".join(parts)}
SELECT doc_id, n_sentences, sentence_ids,
  coalesce(array_to_string(list_transform(list_sort(list_distinct(list_transform(l, lambda x: lpad(list_position(l, x)::VARCHAR, 4, '0') || x))), lambda x: substr(x, 5)), '|'), '') AS licenses,
  coalesce(array_to_string(list_filter(string_split(regexp_replace(u, '^<|>$', '', 'g'), '><'), lambda x: x <> ''), '|'), '') AS unmatched
FROM {step}
"""


SQL = _sql()
