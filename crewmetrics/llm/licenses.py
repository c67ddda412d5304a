"""Licence scans: sentences to identifiers, sequences of identifiers to licences.

A text is cut into sentences, each sentence is normalised and looked up among known licence sentences.
The identifiers of a text, in order, are matched against ordered rules; a rule that matches takes its
identifiers out, so that a longer rule goes before the shorter ones it contains.
Built-in expressions only; a text without any word that all known sentences need is not cut.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence texts and notices, and what they are called.
SENTENCES = {
    # Apache
    "licensed under the apache license version 2 0": "apache2",
    "licensed under the apache license version 2 0 the license": "apache2",
    "you may not use this file except in compliance with the license": "apacheUse",
    "you may obtain a copy of the license at": "apacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apacheWarranty",
    "see the license for the specific language governing permissions and limitations under the license": "apacheSee",
    # MIT, ISC, BSD
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "this project is licensed under the mit license": "mit",
    "the mit license mit": "mit",
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mitWarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mitLiable",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "iscGrant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsdName",
    # GNU
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 3": "gpl3",
    "this work is licensed under the gnu general public license version 2": "gpl2",
    "licensed under the gnu general public license version 2": "gpl2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3Later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnuWarranty",
    "see the gnu general public license for more details": "gplSee",
    "you should have received a copy of the gnu general public license along with this program": "gplCopy",
    "licensed under the gnu lesser general public license version 3": "lgpl3",
    "licensed under the gnu affero general public license version 3": "agpl3",
    # Mozilla, Creative Commons, public domain
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2",
    "licensed under cc by 4 0": "ccBy4",
    "licensed under cc by sa 4 0": "ccBySa4",
    "licensed under cc by nc 4 0": "ccByNc4",
    "licensed under cc by nd 4 0": "ccByNd4",
    "licensed under cc by nc sa 4 0": "ccByNcSa4",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccBy4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccBySa4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccByNc4",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "released into the public domain": "publicDomain",
    "this work is in the public domain": "publicDomain",
    # Identifiers on a line of their own
    "spdx license identifier mit": "mit",
    "spdx license identifier isc": "isc",
    "spdx license identifier apache 2 0": "apache2",
    "spdx license identifier bsd 2 clause": "bsd2",
    "spdx license identifier bsd 3 clause": "bsd3",
    "spdx license identifier gpl 2 0 only": "gpl2",
    "spdx license identifier gpl 2 0 or later": "gpl2Later",
    "spdx license identifier gpl 3 0 only": "gpl3",
    "spdx license identifier gpl 3 0 or later": "gpl3Later",
    "spdx license identifier mpl 2 0": "mpl2",
}
# Rules in the order they are tried. A star marks an identifier that may be missing.
RULES = [
    ("MIT", "mit* mitGrant mitNotice mitWarranty mitLiable"),
    ("ISC", "isc* iscGrant mitWarranty*"),
    ("BSD-3-Clause", "bsdGrant bsdSource bsdBinary bsdName"),
    ("BSD-2-Clause", "bsdGrant bsdSource bsdBinary"),
    ("Apache-2.0", "apache2 apacheUse apacheCopy* apacheWarranty apacheSee*"),
    ("GPL-2.0-or-later", "gpl2Later gnuWarranty* gplSee* gplCopy*"),
    ("GPL-3.0-or-later", "gpl3Later gnuWarranty* gplSee* gplCopy*"),
    ("GPL-2.0-only", "gpl2"),
    ("GPL-3.0-only", "gpl3"),
    ("LGPL-3.0-only", "lgpl3"),
    ("AGPL-3.0-only", "agpl3"),
    ("Apache-2.0", "apache2"),
    ("MIT", "mit"),
    ("ISC", "isc"),
    ("BSD-2-Clause", "bsd2"),
    ("BSD-3-Clause", "bsd3"),
    ("MPL-2.0", "mpl2"),
    ("CC-BY-4.0", "ccBy4"),
    ("CC-BY-SA-4.0", "ccBySa4"),
    ("CC-BY-NC-4.0", "ccByNc4"),
    ("CC-BY-ND-4.0", "ccByNd4"),
    ("CC-BY-NC-SA-4.0", "ccByNcSa4"),
    ("Unlicense", "unlicense"),
    ("Public-Domain", "publicDomain"),
]

#: Each known sentence has one of these words.
NEEDED = "licen|software|copyright|redistribut|public domain|governing permissions|merchantability"
#: What precedes the text of a comment line; a line that goes
#: on in lower case, or in capitals; the end of a sentence; other characters.
COMMENT = r"(^|\n)[ \t]*(?:#+|//+|/?\*+/?|--+|;+)[ \t]*"
GOES_ON = r"([^.!?:;\n])[ \t]*\r?\n[ \t]*([a-z])"
SHOUTS_ON = r"([A-Z]+,? +[A-Z]+,?)[ \t]*\r?\n[ \t]*([A-Z]+[ ,])"
ENDS = r"[.!?;]+[ \t\r]+|[.!?:;]*[ \t\r]*\n"
OTHER = r"[^a-z0-9]+"
#: Wraps of verbatim notices that the patterns above leave apart, and ends of sentences that are none. No known sentence
#: begins with what is joined here.
WRAPS = [
    r"([A-Z]+[\"'”]?,? +[A-Z]+[\"'”]?,?)[ \t]*\r?\n[ \t]*(WITHOUT|WARRANT|CONDITIONS|OF|EXPRESS|BASIS)\b",
    r"\b(an|provided|PROVIDED)[ \t]*\r?\n[ \t]*([\"“']?AS IS\b)",
    r"(\"?AS IS[\"”']?,?)[ \t]*\r?\n[ \t]*(BASIS|WITHOUT)\b",
    r"(?i)(license, or)[ \t]*\r?\n[ \t]*(\(at your option)",
    r"\b(of|or|but|A)[ \t]*\r?\n[ \t]*(MERCHANTABILITY|FITNESS|WITHOUT ANY WARRANTY|PARTICULAR)\b",
    r"\b(the|by)[ \t]*\r?\n[ \t]*(GNU|Mozilla Public|Apache License|Free Software Foundation)\b",
    r"\b(GNU|General|Public|Mozilla|Apache|Free|Software)[ \t]*\r?\n[ \t]*(General|Public|License,|License as|Software Foundation|Foundation)",
    r"(?i)(license, (?:version|v\.))[ \t]*\r?\n[ \t]*(\d)",
    r"(?i)(free software);\s+(you can redistribute)",
    r"(?i)(software foundation);\s+(either version \d)",
    r"(?i)(any warranty);\s+(without even)",
    r"(?i)(license, v)\.[ \t]*(\d)",
    r"([A-Z]{2,}[\"”']?,?)[ \t]*\r?\n[ \t]*([\"“']?[A-Z]{2,}[ ,.;\"”])",
]
#: A colon that ends a known sentence where the text goes on in the same line.
CUTS = r"(?i)(following conditions(?: are met)?):[ \t]+"
#: Beginnings of texts that a copyright line without an end may stand before.
BEGINS = r"[ \t](Permission is hereby granted,|Permission to use, copy,|Redistribution and use in source)"


def rule_patterns() -> list[tuple[str, str]]:
    """For each rule what it is called and what matches ``;id;id;`` sequences, each identifier with its ``;``."""
    made = []
    for name, rule in RULES:
        parts = [f"(?:{i[:-1]};)?" if i.endswith("*") else f"{i};" for i in rule.split()]
        made.append((name, ";" + "".join(parts)))
    return made


def _sentences(text: Column) -> Column:
    text = F.regexp_replace(text, COMMENT, "$1")
    for pattern in (GOES_ON, SHOUTS_ON):
        text = F.regexp_replace(text, pattern, "$1 $2")
    for pattern in WRAPS:
        text = F.regexp_replace(text, pattern, "$1 $2")
    text = F.regexp_replace(F.regexp_replace(text, CUTS, "$1\n"), BEGINS, "\n$1")
    parts = F.split(F.regexp_replace(text, ENDS, "\n"), "\n")
    plain = lambda s: F.trim(F.regexp_replace(F.lower(s), OTHER, " "))
    return F.transform(parts, plain)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses, n_sentences, n_unknown of every row of ``docs`` (doc_id, text).

    ``sentence_ids`` are the identifiers of known sentences in order and ``licenses`` the rules that matched, in
    order too, both comma-joined and empty if there are none; ``n_sentences`` counts the identifiers, and
    ``n_unknown`` the other sentences that speak of a licence. A null text is empty. Repeated rows and null ids are
    returned as they are, no documents give no rows; other columns are not read.
    """
    text = F.when(F.coalesce("text", F.lit("")).rlike(f"(?i){NEEDED}"), F.col("text"))
    known = F.create_map(*map(F.lit, chain.from_iterable(SENTENCES.items())))
    needs = lambda s: s.rlike(NEEDED)
    cut = docs.select("doc_id", F.filter(_sentences(text), needs).alias("s"))
    named = cut.select(
        "doc_id",
        F.transform("s", lambda s: F.struct(F.try_element_at(known, s).alias("id"), s.rlike("licen[cs]").alias("speaks"))).alias("s"),
    )
    ids = F.transform(F.filter("s", lambda s: s["id"].isNotNull()), lambda s: s["id"])
    unknown = F.size(F.filter("s", lambda s: s["id"].isNull() & s["speaks"]))
    found = named.select(
        "doc_id",
        F.coalesce(F.array_join(ids, ","), F.lit("")).alias("sentence_ids"),
        F.coalesce(F.size(ids), F.lit(0)).cast("long").alias("n_sentences"),
        F.when(F.col("s").isNotNull(), unknown).otherwise(F.lit(0)).cast("long").alias("n_unknown"),
    )
    left = F.concat(F.lit(";"), F.replace(F.col("sentence_ids"), F.lit(","), F.lit(";")), F.lit(";"))
    for name, pattern in rule_patterns():
        left = F.regexp_replace(left, pattern, f";<{name}>;")
        left = F.regexp_replace(left, pattern, f";<{name}>;")  # neighbours share a ;
    licenses = F.array_join(F.regexp_extract_all(left, F.lit("<([^>]*)>"), F.lit(1)), ",")
    return found.select(
        "doc_id", "sentence_ids", F.when(F.col("n_sentences") > 0, licenses).otherwise("").alias("licenses"), "n_sentences", "n_unknown"
    )


def oracle() -> str:
    """The scan as DuckDB SQL."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    left = "';' || replace(sentence_ids, ',', ';') || ';'"
    for name, pattern in rule_patterns():
        for _ in range(2):
            left = f"regexp_replace({left}, '{pattern}', ';<{name}>;', 'g')"
    text = f"regexp_replace(text, '{COMMENT}', '\\1', 'g')"
    for pattern in (GOES_ON, SHOUTS_ON, *WRAPS):
        pattern = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '\\1 \\2', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{CUTS}', '\\1' || chr(10), 'g'), '{BEGINS}', chr(10) || '\\1', 'g')"
    return f"""
with known(sentence, id) as (values {known}
), parts as (
  select rid, string_split(regexp_replace({text}, '{ENDS}', chr(10), 'g'), chr(10)) as parts
  from (select row_number() over () as rid, * from documents) where regexp_matches(text, '(?i){NEEDED}')
), cut as (
  select rid, unnest(parts) as s, generate_subscripts(parts, 1) as k from parts
), plain as (
  select rid, k, trim(regexp_replace(lower(s), '{OTHER}', ' ', 'g')) as s from cut
), named as (
  select rid, k, id, regexp_matches(s, 'licen[cs]') as speaks from plain left join known on s = sentence
  where regexp_matches(s, '{NEEDED}')
), found as (
  select rid, coalesce(string_agg(id, ',' order by k), '') as sentence_ids, count(id) as n_sentences,
    count(*) filter (id is null and speaks) as n_unknown
  from named group by rid
)
select d.doc_id, coalesce(sentence_ids, '') as sentence_ids,
  case when n_sentences > 0 then array_to_string(regexp_extract_all({left}, '<([^>]*)>', 1), ',') else '' end as licenses,
  coalesce(n_sentences, 0) as n_sentences, coalesce(n_unknown, 0) as n_unknown
from (select row_number() over () as rid, doc_id from documents) d left join found using (rid)
"""
