"""License scan by sentence rules.

Texts are cut into sentences, sentences are normalised (A-Z lower-cased, everything but letters and digits
becomes one space) and matched with known licence sentences. A sentence ends at a blank line, at . ! ? ; before white space
and at : before a line end; of a sentence over several lines, any run of whole lines may be a known sentence, so wrapped
texts and one-line notices are both found. Marks before a line's first letter or digit (of comments, say) and a
list number before a sentence do not count. The identifiers that remain, in text order,
are matched against ordered licence rules: the first rule whose identifiers stand side by side takes them, and what
it took cannot serve a later rule. Everything is DataFrame expressions without a join, exchange or
Python, so a document is never grouped.

Known sentences: a rule combines notice forms with licence names, and identifier lines with licence identifiers; fixed sentences of
licence texts follow. A notice that is only part of a sentence is not known.

Cases: null and empty texts have no sentences; a sentence that is not known takes no part; repeated sentences
all count, a licence is named once; sentences of a recognised kind that no rule takes are
reported as ``UNKNOWN``; repeated rows give repeated rows; whole texts are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of public licences as notices write them (normalised), by identifier.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "MIT": ["mit license", "mit licence"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "modified bsd license", "new bsd license"],
    "GPL-2.0": ["gnu general public license version 2", "gnu gpl version 2", "gpl v2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu gpl version 3", "gpl v3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3"],
    "AGPL-3.0": ["gnu affero general public license version 3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0"],
    "ISC": ["isc license"],
    "BSL-1.0": ["boost software license version 1 0"],
    "Zlib": ["zlib license"],
    "CC0-1.0": ["cc0", "cc0 1 0", "creative commons zero license"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
}
# Forms of licence notices (normalised).
FORMS = ["licensed under", "licensed under the", "released under the", "released under", "distributed under the", "this work is licensed under the", "this work is licensed under", "this software is licensed under the", "this file is licensed under the"]
# Sentences of published licence texts (normalised), by identifier.
SENTENCES: dict[str, list[str]] = {
    "ApacheUse": ["you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at"],
    "MitGrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "BsdIntro": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdBinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BsdNames": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "IscGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "Gpl3Grant": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "Gpl2Grant": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "PublicDomain": ["this work is in the public domain", "released into the public domain"],
    "AllRights": ["all rights reserved"],
}
#: Licence rules in the order in which they are tried: licence and the identifiers that stand side by side.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["Apache-2.0", "ApacheUse", "ApacheCopy"]),
    ("Apache-2.0", ["ApacheUse", "ApacheCopy"]),
    ("BSD-3-Clause", ["BsdIntro", "BsdSource", "BsdBinary", "BsdNames"]),
    ("BSD-2-Clause", ["BsdIntro", "BsdSource", "BsdBinary"]),
    ("MIT", ["MIT", "MitGrant", "MitNotice"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("ISC", ["IscGrant"]),
    ("GPL-3.0-or-later", ["Gpl3Grant"]),
    ("GPL-2.0-or-later", ["Gpl2Grant"]),
    ("Public-Domain", ["PublicDomain"]),
    *[(name, [name]) for name in NAMES],
    ("All-Rights-Reserved", ["AllRights"]),
]
#: Every known sentence holds one of these, so other sentences need no look-up.
KEYS = "licens|licenc|permission|permitted|redistribut|copyright|public domain|rights reserved|cc0|cc by|gpl"


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    out = {f"{form} {name}": key for key, names in NAMES.items() for name in names for form in FORMS}
    # identifier lines, as in source files
    plain = {key: re.sub("[^a-z0-9]+", " ", key.lower()) for key in NAMES}
    out |= {f"spdx license identifier {name}{only}": key for key, name in plain.items() for only in ("", " only")}
    out |= {"spdx license identifier gpl 2 0 or later": "Gpl2Grant", "spdx license identifier gpl 3 0 or later": "Gpl3Grant"}
    out |= {text: key for key, texts in SENTENCES.items() for text in texts}
    return out


def _marked(t: Column) -> Column:
    """The text normalised, with a line feed at each line end inside a sentence and | at each end of a sentence."""
    t = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ|", "abcdefghijklmnopqrstuvwxyz ")
    t = F.regexp_replace(t, r"\n[^a-z0-9\n]+", "\n")
    # the GPL's grant starts after ; or : and holds a ; itself
    t = F.regexp_replace(t, r"[.!?](?=[ \t\r\n])|;(?=[ \t\r\n])(?!\s+either\s+version\s)|:(?=[ \t\r]*\n|\s+you\s+can\s+redistribute\s)", "|")
    t = F.regexp_replace(t, r"[^a-z0-9\n|]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n\n+", "|")
    return F.btrim(F.regexp_replace(t, r" ?\|[ \n|]*", "|"), F.lit(" \n"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``sentence_ids`` (known sentences in text order) and ``licenses``, comma-joined.

    Licences stand in the order of the rules; documents without any have two empty strings.
    """
    sentences = known_sentences()
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    # the longest first; words may be parted by a line end
    told = "|".join(sorted(sentences, key=lambda x: (-len(x), x))).replace(" ", "[ \n]")
    pattern = rf"(?<![a-z0-9 ])(?:[0-9]{{1,2}} )?({told})(?![a-z0-9 ])"
    likely = "(?i)" + KEYS.replace(" ", "[^a-z0-9]+")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("t"))
    found = F.transform(F.regexp_extract_all(_marked(F.col("t")), F.lit(pattern), F.lit(1)), lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))
    rows = rows.select("id", F.when(F.col("t").rlike(likely), found).otherwise(F.array().cast("array<string>")).alias("ids"))
    rows = rows.select("id", F.array_join("ids", ",").alias("sentence_ids"), F.size("ids").alias("n"), F.when(F.size("ids") > 0, F.concat(F.lit(";"), F.array_join("ids", ";;"), F.lit(";"))).otherwise("").alias("left0"))
    # each rule takes its identifiers out, leaving a mark that no later rule can reach across
    hits, left = [], F.col("left0")
    for k, (name, ids) in enumerate(RULES):
        told = ";" + ";;".join(ids) + ";"
        hits.append(F.when(F.contains(F.col(f"left{k}"), F.lit(told)), F.lit(name)))
        left = F.replace(F.col(f"left{k}"), F.lit(told), F.lit("|"))
        rows = rows.withColumn(f"hit{k}", hits[-1]).withColumn(f"left{k + 1}", F.when(F.col("n") > 0, left).otherwise("")).drop(f"left{k}")
    rest = F.when(F.contains(F.col(f"left{len(RULES)}"), F.lit(";")), F.lit("UNKNOWN"))
    named = F.array_distinct(F.array_compact(F.array(*[F.col(f"hit{k}") for k in range(len(RULES))], rest)))
    return rows.select(F.col("id").alias(id_col), "sentence_ids", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_sentences"), F.array_join(named, ",").alias("licenses"))
