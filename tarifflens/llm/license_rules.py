"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, which are normalised (lower case, single blanks, no punctuation but inner dots). A known
licence sentence has an identifier; the others are passed over. The sequence of identifiers is then matched against
ordered rules: a rule names a licence and the identifiers that must follow one another. Where a rule is a stretch of a
longer one, identifiers that the longer one covers do not count for it; those elsewhere in the text do, so a text that
holds two licences gives both.

Everything happens inside the row, so the scan has no shuffle at any size, and a text of any length is one row. The
tables of sentences and rules are parameters; they are literals of the plan (some dozen entries).

Edge cases: a null or empty text has no sentences and no licence. A sentence may be wrapped over lines; a line break
ends a sentence unless the next line goes on in lower case or in capitals after capitals, or the line ends with a word
such as "the" or inside the name of a licence. Marks of comments at line starts are left out before lines are joined.
Semicolons and colons end a sentence, other than those inside a known one. Of an SPDX expression the first identifier
counts. Copyright lines are known by their first word. Repeated rows get equal results; the operator adds columns and
replaces those of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, as they read after normalisation, with their identifiers.
SENTENCES = {
    "notice-mit": "released under the mit license",
    "notice-mit-2": "licensed under the mit license",
    "notice-apache-2": "licensed under the apache license version 2.0",
    "notice-gpl-3": "this work is licensed under the gnu general public license version 3",
    "notice-gpl-2": "this work is licensed under the gnu general public license version 2",
    "notice-cc-by-4": "licensed under cc by 4.0",
    "notice-cc-by-sa-4": "licensed under cc by sa 4.0",
    "notice-cc-by-nc-4": "licensed under cc by nc 4.0",
    "notice-cc-by-nd-4": "licensed under cc by nd 4.0",
    "notice-cc-by-nc-sa-4": "licensed under cc by nc sa 4.0",
    "notice-cc0": "released under cc0 1.0",
    "notice-reserved": "all rights reserved",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-sa-4-work": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "mit-title": "mit license",
    "mit-title-2": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not "
    "limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
    "software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee "
    "is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software "
    "including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and "
    "the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions "
    "and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied "
    "warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
    "purpose are disclaimed",
    "apache-grant": "licensed under the apache license version 2.0 the license you may not use this file except in "
    "compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license "
    "is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation either version 3 of the license or at your "
    "option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even "
    "the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation either version 2 of the license or at your "
    "option any later version",
    "lgpl-2.1-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu "
    "lesser general public license as published by the free software foundation either version 2.1 of the license or at "
    "your option any later version",
    "lgpl-3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu "
    "lesser general public license as published by the free software foundation either version 3 of the license or at "
    "your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even "
    "the implied warranty of merchantability or fitness for a particular purpose",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "affero general public license as published by the free software foundation either version 3 of the license or at "
    "your option any later version",
    "unlicense-public": "this is free and unencumbered software released into the public domain",
}

# Ordered rules: a licence and the identifiers that follow one another. Longer rules stand before their parts.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["notice-mit"]),
    ("MIT", ["notice-mit-2"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", ["notice-apache-2"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl-2-free", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-free", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl-3-free", "lgpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope"]),
    ("GPL-3.0", ["notice-gpl-3"]),
    ("GPL-2.0", ["notice-gpl-2"]),
    ("MPL-2.0", ["mpl-terms"]),
    ("CC-BY-4.0", ["notice-cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-4-work"]),
    ("CC-BY-SA-4.0", ["notice-cc-by-sa-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-work"]),
    ("CC-BY-NC-4.0", ["notice-cc-by-nc-4"]),
    ("CC-BY-ND-4.0", ["notice-cc-by-nd-4"]),
    ("CC-BY-NC-SA-4.0", ["notice-cc-by-nc-sa-4"]),
    ("CC0-1.0", ["notice-cc0"]),
    ("Unlicense", ["unlicense-public"]),
    ("all-rights-reserved", ["notice-reserved"]),
]

# Identifiers that stand alone on an SPDX line.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
SENTENCES |= {f"spdx-{x}": "spdx license identifier " + x.lower().replace("-", " ") for x in SPDX}
RULES += [(x, [f"spdx-{x}"]) for x in SPDX]

# Identifiers of lines known by their start alone, and titles, which no rule needs, are skipped between sentences.
SKIPPED = ("copyright", "mit-title", "mit-title-2")

# The steps of normalisation: pattern and replacement (the dialects of Spark and DuckDB agree on these).
STEPS = [
    # An SPDX line is a sentence of its own, whatever stands around it.
    (r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)", ". SPDX-License-Identifier $1. "),
    # Marks of comments at line starts (a star at the margin is a list).
    (r"(\A|\n)[ \t]*(?://+|#+|/\*+|--+|;+|%+|<!--)!?[ \t]*", "$1"),
    (r"(\n)[ \t]+\*+/?[ \t]*", "$1"),
    (r"\n\t[ \t]*", "\n"),
    # Lines that go on in the next one: in lower case, in capitals after capitals, after a word that ends no sentence,
    # and inside the names of licences.
    (r"([a-zA-Z0-9,()\"]) *\r?\n *([(\"]?[a-z])", "$1 $2"),
    (r"([A-Z,]\"?,?) *\r?\n *(\"?[A-Z][A-Z]|A PARTICULAR)", "$1 $2"),
    (r"([ (\n](?:the|of|under|a|an|or|but|by|to|version)) *\r?\n *([(\"]?[A-Z0-9])", "$1 $2"),
    (
        r"((?:Apache|GNU|Lesser|Affero|General|Public|Mozilla|Creative|Commons|Free|Software|Source|Code|MIT|License,|Version|"
        r"CC|CC0|BY|BY-SA|BY-NC|BY-ND|BY-NC-SA|Attribution|ShareAlike|International|[0-9]\.0)) *\r?\n *"
        r"((?:License|Lesser General|Affero General|General Public|Public License|Commons|Attribution|ShareAlike|Software Foundation|Foundation|Code Form|"
        r"Form|Version|International|BY|[0-9]\.0)\b)",
        "$1 $2",
    ),
    # Marks that do not end the known sentence they stand in.
    (r"([ ,]v)\.[ \t\r\n]+([0-9])", "$1 $2"),
    (r"[;:][ \t\r\n]+(you may not use|you can redistribute|either version|without even the implied)", " $1"),
    # A copyright line or an address that runs into the next sentence, where all stands on one line.
    (
        r" +(Licensed under the Apache License, Version 2\.0 \(the|Permission is hereby granted, free|"
        r"Permission to use, copy, modify|Redistribution and use in source)",
        ". $1",
    ),
    (r"(apache\.org/licenses/LICENSE-2\.0)(?:\.html|\.txt)?[ \t\r\n]+", "$1. "),
    (r"( at):?[ \t\r\n]+https?://", "$1 http://"),
]
CUTS = [
    (r"[.!?;:]+([ \x09-\x0D]+|\z)", "\n"),
    (r"[^a-z0-9.\n]+", " "),
]


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, in order."""
    for pattern, by in STEPS:
        text = F.regexp_replace(text, pattern, by)
    text = F.lower(text)
    for pattern, by in CUTS:
        text = F.regexp_replace(text, pattern, by)
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def identifiers(found: Column, known: dict[str, str]) -> Column:
    """Identifiers of the known ones among normalised sentences, in order."""
    by_sentence = F.create_map(*(F.lit(x) for name, sentence in known.items() for x in (sentence, name)))
    named = F.transform(
        found, lambda s: F.coalesce(by_sentence[s], F.when(s.startswith("copyright "), F.lit("copyright")))
    )
    return F.filter(named, lambda name: name.isNotNull())


def longer_rules(needle: str, rules: list[tuple[str, list[str]]]) -> list[str]:
    """The sequences of the rules of which this one is a stretch, longest first."""
    every = {"|" + "||".join(rule) + "|" for _, rule in rules}
    return sorted((x for x in every if needle in x and needle != x), key=lambda x: (-len(x), x))


def licences(sequence: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Distinct licences whose rule matches the sequence, in the order of the rules.

    ``sequence`` holds identifiers, each between bars.
    """
    matched = []
    for licence, rule in rules:
        needle = "|" + "||".join(rule) + "|"
        rest = sequence
        for other in longer_rules(needle, rules):
            rest = F.replace(rest, F.lit(other), F.lit("/"))
        matched.append(F.when(F.contains(rest, F.lit(needle)), F.lit(licence)))
    return F.array_distinct(F.filter(F.array(*matched), lambda x: x.isNotNull()))


def scan(
    docs: DataFrame, known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None
) -> DataFrame:
    """The documents with ``n_sentences``, ``sentence_ids`` and ``licences`` (arrays of strings)."""
    known, rules = known or SENTENCES, rules or RULES
    found = docs.withColumn("__sentences", sentences(F.coalesce(F.col("text"), F.lit(""))))
    named = found.withColumns(
        {
            "n_sentences": F.size("__sentences").cast("long"),
            "sentence_ids": identifiers(F.col("__sentences"), known),
        }
    ).drop("__sentences")
    telling = F.filter("sentence_ids", lambda x: ~x.isin(*SKIPPED))
    sequence = F.array_join(F.transform(telling, lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "")
    return named.withColumn("licences", licences(sequence, rules))


def scan_sql() -> str:
    """The DuckDB twin of the query: doc_id, n_sentences, sentence_ids and licences as joined text."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def replaced(text: str, pattern: str, by: str) -> str:
        by = quoted(by.replace("$", "\\")) if by != "\n" else "chr(10)"
        return f"regexp_replace({text}, {quoted(pattern)}, {by}, 'g')"

    text = "coalesce(text, '')"
    for pattern, by in STEPS:
        text = replaced(text, pattern, by)
    text = f"lower({text})"
    for pattern, by in CUTS:
        text = replaced(text, pattern, by)
    known = ", ".join(f"({quoted(s)}, {quoted(n)})" for n, s in SENTENCES.items())
    cases = []
    for licence, rule in RULES:
        needle, rest = "|" + "||".join(rule) + "|", "sequence"
        for other in longer_rules(needle, RULES):
            rest = f"replace({rest}, {quoted(other)}, '/')"
        cases.append(f"case when contains({rest}, {quoted(needle)}) then {quoted(licence)} end")
    skipped = ", ".join(map(quoted, SKIPPED))
    order = [x for i, (x, _) in enumerate(RULES) if x not in [y for y, _ in RULES[:i]]]
    listed = ", ".join(f"({i}, {quoted(x)})" for i, x in enumerate(order))
    return f"""
with known(sentence, name) as (values {known}),
cut as (select doc_id, string_split({text}, chr(10)) as parts from documents),
each as (select doc_id, trim(unnest(parts)) as sentence, unnest(range(len(parts))) as place from cut),
named as (
    select doc_id, place, sentence,
        coalesce(name, case when starts_with(sentence, 'copyright ') then 'copyright' end) as name
    from each left join known using (sentence) where sentence <> ''),
rows as (
    select doc_id, count(*) as n_sentences,
        coalesce(string_agg(name, ',' order by place) filter (name is not null), '') as sentence_ids,
        coalesce(string_agg('|' || name || '|', '' order by place)
            filter (name is not null and name not in ({skipped})), '') as sequence
    from named group by doc_id),
hits as (select doc_id, n_sentences, sentence_ids, unnest([{', '.join(cases)}]) as licence from rows),
ranked(rank, licence) as (values {listed})
select d.doc_id, cast(coalesce(max(n_sentences), 0) as bigint) as n_sentences,
    coalesce(max(sentence_ids), '') as sentence_ids,
    coalesce((select string_agg(licence, ',' order by rank) from ranked
        where licence in (select licence from hits h where h.doc_id = d.doc_id)), '') as licences
from documents d left join rows using (doc_id) group by d.doc_id
"""
