"""License scans by sentence rules.

A text is cut into sentences, each sentence normalised and looked up among known licence sentences; the identifiers in
order, with a mark for each run of other sentences, are then matched against licence rules, the most specific first.
Everything is built-in functions over arrays in the row: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.llm.common import ascii_lower, table

# Identifiers of sentences of public licence texts and notices, in normal form, as BREAK cuts them.
_APACHE = ("http www.apache.org licenses license-2.0", "https www.apache.org licenses license-2.0")
_APACHE_ASIS = "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
SENTENCES = {
    "mit-line": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-asis": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "mit-liability": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "apache-line": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "released under the apache license version 2.0"],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-obtain": ["you may obtain a copy of the license at", *(f"you may obtain a copy of the license at {u}" for u in _APACHE)],
    "apache-url": list(_APACHE),
    "apache-asis": [_APACHE_ASIS, *(f"you may obtain a copy of the license at {u} {_APACHE_ASIS}" for u in _APACHE)],
    "gpl3-line": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl2-line": ["licensed under the gnu general public license version 2"],
    "gpl-free": ["this program is free software"],
    "gpl3-later": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "gpl2-later": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ],
    "gpl-asis": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "this program is distributed in the hope that it will be useful but without any warranty",
    ],
    "gpl-implied": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd-grant": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    ],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "bsd-asis": [
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    ],
    # The cut is behind v.; only version 2.0 speaks of the Source Code Form.
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license v", "this source code form is subject to the terms of the mozilla public license v.2.0"],
    "ccbync4-line": ["licensed under cc by-nc 4.0", "this work is licensed under cc by-nc 4.0"],
    "ccby4-line": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0"],
    "ccbysa4-line": ["licensed under cc by-sa 4.0", "this work is licensed under cc by-sa 4.0"],
    "public-domain": ["this work is dedicated to the public domain"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc0-deed": [
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law"
    ],
    "cc0-line": ["licensed under cc0 1.0", "this work is licensed under cc0 1.0 universal", "this work is licensed under the creative commons cc0 1.0 universal license"],
    "bsd-names": [
        f"neither the name of {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
        for who in ("the copyright holder", "the copyright holders", "the author", "the organization", "the university")
    ],
    "isc-grant": [
        f"permission to use copy modify and {both} this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        for both in ("or distribute", "distribute")
    ],
    "isc-asis": [
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "the software is provided as is and isc disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ],
    "lib-free": ["this library is free software"],
    "lgpl-grant": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "v2.1-later": ["either version 2.1 of the license or at your option any later version"],
    "lgpl2.1-later": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"
    ],
    "lgpl3-later": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "agpl3-later": [
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "gpl-grant": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "v2-later": ["either version 2 of the license or at your option any later version"],
    "lib-asis": ["this library is distributed in the hope that it will be useful but without any warranty"],
    "epl2-notice": [
        f"this program and the accompanying materials are made available under the terms of the eclipse public license {v}{where}"
        for v in ("v2.0", "2.0") for where in ("", " which accompanies this distribution", " which is available at https www.eclipse.org legal epl-2.0", " which accompanies this distribution and is available at https www.eclipse.org legal epl-2.0")
    ],
}
#: Tried in this order; what a rule matched isn't matched again.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-asis", "mit-liability"]),
    ("MIT-partial", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-line", "apache-comply", "apache-obtain", "apache-url", "apache-asis"]),
    ("Apache-2.0", ["apache-line", "apache-comply", "apache-obtain", "apache-asis"]),
    ("Apache-2.0", ["apache-line", "apache-comply", "apache-asis"]),
    ("Apache-2.0", ["apache-line", "apache-comply", "apache-obtain", "apache-url"]),
    ("Apache-2.0", ["apache-line", "apache-comply", "apache-obtain"]),
    ("Apache-2.0", ["apache-line", "apache-comply"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-asis"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-asis"]),
    ("ISC", ["isc-grant", "isc-asis"]),
    ("ISC", ["isc-grant"]),
    *(("LGPL-2.1-or-later", ["lib-free", *grant, *asis]) for asis in (["lib-asis", "gpl-implied"], ["lib-asis"], []) for grant in (["lgpl-grant", "v2.1-later"], ["lgpl2.1-later"])),
    *(("LGPL-3.0-or-later", ["lib-free", "lgpl3-later", *asis]) for asis in (["lib-asis", "gpl-implied"], ["lib-asis"], [])),
    *(("LGPL-3.0-or-later", ["gpl-free", "lgpl3-later", *asis]) for asis in (["gpl-asis", "gpl-implied"], ["gpl-asis"], [])),
    *(("AGPL-3.0-or-later", ["gpl-free", "agpl3-later", *asis]) for asis in (["gpl-asis", "gpl-implied"], ["gpl-asis"], [])),
    *(("GPL-2.0-or-later", ["gpl-free", "gpl-grant", "v2-later", *asis]) for asis in (["gpl-asis", "gpl-implied"], ["gpl-asis"], [])),
    *((f"GPL-{v}.0-or-later", [*free, f"gpl{v}-later", *asis]) for asis in (["gpl-asis", "gpl-implied"], ["gpl-asis"], []) for free in (["gpl-free"], []) for v in (3, 2)),
    ("MIT", ["mit-line"]),
    ("Apache-2.0", ["apache-line"]),
    ("GPL-3.0-only", ["gpl3-line"]),
    ("GPL-2.0-only", ["gpl2-line"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("CC-BY-NC-4.0", ["ccbync4-line"]),
    ("CC-BY-SA-4.0", ["ccbysa4-line"]),
    ("CC-BY-4.0", ["ccby4-line"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("CC0-1.0", ["cc0-deed"]),
    ("CC0-1.0", ["cc0-line"]),
    ("Unlicense", ["unlicense"]),
    ("Public-Domain", ["public-domain"]),
]
#: Every known sentence holds one of these, so a text without any has none.
GATES = ["licen", "warrant", "copyright", "permission", "permitted", "free software", "public domain", "merchantability"]
GATE = "(?i)(" + "|".join(g.replace(" ", r"\s+") for g in GATES) + ")"
#: A bare list number that begins a sentence goes with the cut before it.
_ITEM = r"(?:[*#/]*\s*\(?\d{1,2}[.)]\s+)?"
BREAK = rf"[.;:!?]+(?:\s+{_ITEM}|$)|\n\s*\n\s*{_ITEM}"



def pieces(text: str) -> list[str]:
    """What the cuts leave of a text, in normal form: sentence_ids() without Spark."""
    plain = lambda s: re.sub("[^a-z0-9.+-]+", " ", re.sub("[A-Z]", lambda c: c[0].lower(), s)).strip(" .-")
    return [x for x in map(plain, re.split(BREAK, text)) if x]


_ID = {s: name for name, group in SENTENCES.items() for s in group}
for _s in _ID:
    if pieces(_s) != [_s] or not any(g in _s for g in GATES):
        raise ValueError(f"this known sentence doesn't come through the cuts whole: {_s}")
for _name, _ids in RULES:
    if not SENTENCES.keys() >= set(_ids):
        raise ValueError(f"a rule for {_name} names sentences that aren't known")
#: Between a rule's sentences other text may stand, such as copyright lines.
_SEQUENCES = [(name, "(?:<[?]>)?".join(f"<{re.escape(i)}>" for i in ids)) for name, ids in RULES]


def normal(sentence: Column) -> Column:
    """Lower case; what isn't a letter, digit or a dot, plus or hyphen inside a word becomes one space; outer dots and hyphens go."""
    return F.btrim(F.regexp_replace(ascii_lower(sentence), r"[^a-z0-9.+-]+", " "), F.lit(" .-"))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs.items() for x in p))


def sentence_ids(text: Column) -> Column:
    """Identifiers in order, <id> or <?> for a run of other sentences, as one string. A sentence over several lines counts as a whole if known, else line by line."""
    known = _map(_ID)
    name = lambda s: F.coalesce(F.try_element_at(known, normal(s)), F.lit("?"))
    sentences = F.filter(F.split(text, BREAK, -1), lambda s: F.length(normal(s)) > 0)
    ids = F.flatten(F.transform(sentences, lambda s: F.when(name(s) != "?", F.array(name(s))).otherwise(F.transform(F.split(s, "\n", -1), name))))
    # Copyright lines stand before and between a licence's sentences and don't part them; an unknown line is one mark however long the run.
    return F.regexp_replace(F.concat(F.lit("<"), F.array_join(ids, "><"), F.lit(">")), r"(<\?>)+", "<?>")


def scan_licenses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with sentence_ids (string), n_known (sentences known), licenses (string: distinct names in order of the rules, comma-joined) and n_unruled (known sentences no rule took).

    Null, empty and licence-free texts: "", 0, "", 0. Rows pass through, repeated ones too; columns of df with these
    names are replaced. Empty input: empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("ids")) for n, p in _SEQUENCES))
    start = F.struct(F.col("sentence_ids").alias("left"), F.array().cast("array<string>").alias("names"))

    def apply(acc: Column, rule: Column) -> Column:
        hit = F.regexp_like(acc["left"], rule["ids"])
        return F.struct(
            F.when(hit, F.regexp_replace(acc["left"], rule["ids"], F.lit("<!>"))).otherwise(acc["left"]).alias("left"), F.when(hit, F.array_append(acc["names"], rule["name"])).otherwise(acc["names"]).alias("names")
        )

    ids = F.when(text.rlike(GATE), sentence_ids(text)).otherwise(F.lit(""))
    rows = df.withColumn("sentence_ids", F.when(ids == "<?>", F.lit("")).otherwise(ids))
    rows = rows.withColumn("__end", F.when(F.col("sentence_ids") == "", start).otherwise(F.aggregate(rules, start, apply)))
    count = lambda c: F.regexp_count(c, F.lit("<[a-z]")).cast("long")
    return rows.withColumns(
        {"n_known": count(F.col("sentence_ids")), "licenses": F.array_join(F.array_distinct("__end.names"), ","), "n_unruled": count(F.col("__end.left"))}
    ).drop("__end")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "sentence_ids", "n_known", "licenses", "n_unruled")


def _sql_normal(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.+-]+', ' ', 'g'), ' .-')"


def _sql_id(x: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN '{i}'" for s, i in _ID.items())
    return f"(CASE {_sql_normal(x)} {cases} ELSE '?' END)"


def _sql_rules() -> str:
    steps, seq = [], "seq0"
    for i, (name, ids) in enumerate(_SEQUENCES):
        steps.append(f"r{i} AS (SELECT *, regexp_matches(s{i}, '{ids}') AS h{i}, regexp_replace(s{i}, '{ids}', '<!>', 'g') AS s{i + 1} FROM {'start' if not i else f'r{i - 1}'})")
    return ",\n".join(steps)


_N = len(RULES)
_NAMES = ", ".join(f"CASE WHEN h{i} THEN '{name}' END" for i, (name, _) in enumerate(_SEQUENCES))
_FIRST = ", ".join(f"'{n}'" for n in dict.fromkeys(n for n, _ in RULES))
ORACLE_SQL = f"""
WITH parts AS (
  SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '{BREAK}')) AS s,
    unnest(range(len(regexp_split_to_array(coalesce(text, ''), '{BREAK}')))) AS i FROM documents
), named AS (SELECT doc_id, i, s, {_sql_id("s")} AS id FROM parts WHERE {_sql_normal("s")} <> ''
), lined AS (
  SELECT doc_id, i, 0 AS j, id FROM named WHERE id <> '?'
  UNION ALL
  SELECT doc_id, i, j, {_sql_id("l")} AS id FROM (
    SELECT doc_id, i, unnest(string_split(s, chr(10))) AS l, unnest(range(len(string_split(s, chr(10))))) AS j FROM named WHERE id = '?')
), joined AS (
  SELECT doc_id, regexp_replace('<' || string_agg(id, '><' ORDER BY i, j) || '>', '(<\\?>)+', '<?>', 'g') AS q FROM lined GROUP BY doc_id
), start AS (
  SELECT doc_id, CASE WHEN coalesce(q, '<?>') = '<?>' THEN '' ELSE q END AS s0 FROM documents LEFT JOIN joined USING (doc_id)
), {_sql_rules()}
SELECT doc_id, s0 AS sentence_ids, CAST(len(regexp_extract_all(s0, '<[a-z]')) AS BIGINT) AS n_known,
  array_to_string(list_filter([{_FIRST}], lambda x: list_contains([{_NAMES}], x)), ',') AS licenses,
  CAST(len(regexp_extract_all(s{_N}, '<[a-z]')) AS BIGINT) AS n_unruled FROM r{_N - 1}
"""
