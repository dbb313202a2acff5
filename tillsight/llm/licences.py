"""Licence recognition from sentences, with DataFrame functions only.

A text is cut into sentences (after ``. ! ? ; :`` with white space behind, and at blank lines, but not behind
the words of ``NO_BREAK``); a sentence is lower-cased and reduced to words.  Known sentences have identifiers; a text
becomes the sequence of the identifiers found in it, in text order.  A rule is an ordered
list of identifiers; it matches where they follow one another in the sequence.  Rules are tried
in the order of ``RULES``; the identifiers that a rule has used are gone for later rules, and
what no rule uses is reported as left over.

Licence texts wrap lines anywhere, prose lines end anywhere too: a text is read once with line
ends as spaces and once with line ends as sentence ends, and the reading that knows more
sentences counts (the first on a tie).  Every document is handled in its own row, without
a shuffle.  Null, empty and unlicensed texts have an empty sequence and no licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier of each known sentence, as normalised words.  One letter-and-number
# identifier may have several wordings.
SENTENCES = {
    "apache2-name": ["licensed under the apache license version 2 0",
                     "licensed under the apache license version 2 0 the license"],
    "apache2-use": ["you may not use this file except in compliance with the license"],
    "copy-at": ["you may obtain a copy of the license at"],
    "as-is-dist": ["unless required by applicable law or agreed to in writing software distributed under the license is "
                   "distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "see-license": ["see the license for the specific language governing permissions and limitations under the license"],
    "gpl2-name": ["licensed under the gnu general public license version 2"],
    "gpl3-name": ["licensed under the gnu general public license version 3"],
    "gpl2-later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu "
                   "general public license as published by the free software foundation either version 2 of the license "
                   "or at your option any later version"],
    "gpl3-later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu "
                   "general public license as published by the free software foundation either version 3 of the license "
                   "or at your option any later version"],
    "free-software": ["this program is free software"],
    "gpl2-terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as "
                   "published by the free software foundation"],
    "either-2": ["either version 2 of the license or at your option any later version"],
    "either-3": ["either version 3 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "gpl-merchant": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-details": ["see the gnu general public license for more details"],
    "only-2": ["version 2 of the license"],
    "free-library": ["this library is free software"],
    "lgpl-terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
                   "published by the free software foundation"],
    "either-21": ["either version 2 1 of the license or at your option any later version"],
    "lgpl3-later": [f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu lesser "
                    "general public license as published by the free software foundation either version 3 of the license "
                    "or at your option any later version" for what in ("library", "program")],
    "lgpl-hope": ["this library is distributed in the hope that it will be useful but without any warranty"],
    "lgpl-details": ["see the gnu lesser general public license for more details"],
    "agpl3-later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
                    "general public license as published by the free software foundation either version 3 of the license "
                    "or at your option any later version"],
    "agpl-terms": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as "
                   "published by the free software foundation"],
    "agpl-details": ["see the gnu affero general public license for more details"],
    "lgpl21-name": ["licensed under the gnu lesser general public license version 2 1"],
    "lgpl3-name": ["licensed under the gnu lesser general public license version 3"],
    "agpl3-name": ["licensed under the gnu affero general public license version 3"],
    "mpl2-name": ["this source code form is subject to the terms of the mozilla public license v 2 0",
                  "licensed under the mozilla public license version 2 0"],
    "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
                  "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "mit-name": ["licensed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction including without "
                  "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
                  "software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial "
                   "portions of the software"],
    "mit-as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited "
                  "to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided "
                  "that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the "
                   "following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                   "following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                    "promote products derived from this software without specific prior written permission"],
    "bsd-name": ["licensed under the bsd license", "licensed under the bsd 3 clause license"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
                  "granted provided that the above copyright notice and this permission notice appear in all copies"],
    "cc-by4": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa4": ["licensed under cc by sa 4 0",
                  "licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc4": ["licensed under cc by nc 4 0",
                  "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-nd4": ["licensed under cc by nd 4 0"],
    "cc-by-nc-sa4": ["licensed under cc by nc sa 4 0"],
    "cc-by-nc-nd4": ["licensed under cc by nc nd 4 0"],
    "cc0": ["licensed under cc0 1 0", "to the extent possible under law the author has waived all copyright and related or "
            "neighboring rights to this work"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "all-rights": ["all rights reserved"],
    "boost-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software "
                    "and accompanying documentation covered by this license the software to use reproduce display distribute "
                    "execute and transmit the software and to prepare derivative works of the software and to permit third "
                    "parties to whom the software is furnished to do so all subject to the following"],
    "boost-name": ["licensed under the boost software license version 1 0"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to "
                   "alter it and redistribute it freely subject to the following restrictions"],
    "epl2-grant": ["this program and the accompanying materials are made available under the terms of the eclipse public license "
                   "2 0 which is available at https www eclipse org legal epl 2 0"],
    "epl2-name": ["licensed under the eclipse public license version 2 0"],
    "gfdl-grant": ["permission is granted to copy distribute and or modify this document under the terms of the gnu free "
                   "documentation license version 1 3 or any later version published by the free software foundation"],
}
# Short identifiers; "SPDX-License-Identifier: <identifier>" is a known sentence and a rule of its own.
SPDX = ("Apache-2.0 MIT MIT-0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later "
        "LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 BSD-2-Clause BSD-3-Clause 0BSD ISC Zlib "
        "BSL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 Artistic-2.0 WTFPL Unlicense CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 "
        "CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0").split()
# Older spellings of the identifiers.
SPDX_OLD = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only",
            "AGPL-3.0": "AGPL-3.0-only"}
# A sentence "licensed under ..." is also known with these beginnings.
SUBJECTS = ["", "this work is ", "this file is ", "this software is ", "this project is ", "this program is ",
            "this code is ", "this document is "]
VERBS = ["licensed", "released", "distributed"]
# Ordered rules, a licence and the identifiers it takes, the more specific first.
RULES = [
    ("Apache-2.0", ["apache2-name", "apache2-use", "copy-at", "as-is-dist", "see-license"]),
    ("Apache-2.0", ["apache2-name", "apache2-use"]),
    ("Apache-2.0", ["apache2-name"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-hope", "gpl-merchant", "gpl-details"]),
    ("GPL-3.0-or-later", ["free-software", "gpl2-terms", "either-3", "gpl-hope", "gpl-merchant", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-merchant", "gpl-details"]),
    ("GPL-2.0-or-later", ["free-software", "gpl2-terms", "either-2", "gpl-hope", "gpl-merchant", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "lgpl-hope", "gpl-merchant", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["free-library", "lgpl-terms", "either-21", "lgpl-hope", "gpl-merchant", "lgpl-details"]),
    ("AGPL-3.0-or-later", ["agpl3-later", "gpl-hope", "gpl-merchant", "agpl-details"]),
    ("GPL-2.0-only", ["free-software", "gpl2-terms", "only-2", "gpl-hope", "gpl-merchant", "gpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("LGPL-2.1-or-later", ["free-library", "lgpl-terms", "either-21"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("AGPL-3.0-or-later", ["free-software", "agpl-terms", "either-3"]),
    ("GPL-2.0-only", ["free-software", "gpl2-terms", "only-2"]),
    ("GPL-3.0-or-later", ["free-software", "gpl2-terms", "either-3"]),
    ("GPL-2.0-or-later", ["free-software", "gpl2-terms", "either-2"]),
    ("GPL-3.0-only", ["gpl3-name"]),
    ("GPL-2.0-only", ["gpl2-name"]),
    ("LGPL-2.1-only", ["lgpl21-name"]),
    ("LGPL-3.0-only", ["lgpl3-name"]),
    ("AGPL-3.0-only", ["agpl3-name"]),
    ("MPL-2.0", ["mpl2-name", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-name"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-name"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD", ["bsd-name"]),
    ("ISC", ["isc-grant"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa4"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4"]),
    ("CC-BY-ND-4.0", ["cc-by-nd4"]),
    ("CC-BY-4.0", ["cc-by4"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-name"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("EPL-2.0", ["epl2-grant"]),
    ("EPL-2.0", ["epl2-name"]),
    ("GFDL-1.3-or-later", ["gfdl-grant"]),
] + [(name, [f"spdx-{name}"]) for name in SPDX]
# Every known sentence holds one of these, however its words are divided, so a text without them needs no cutting.
HINT = "licen|cc0|permi|redistribut|warrant|copyright|cc by|general public|free software|public domain|rights reserved|" \
       "either version|mpl".replace(" ", "[^a-z0-9]+")
BREAK = "([.!?;:])[ \\t\\r\\n]+"
# Signs behind these words end no sentence: "SPDX-License-Identifier: MIT", "free software: you can", "License, v. 2.0".
NO_BREAK = "(spdx-license-identifier|free[ \\t\\r\\n]+software):|(license, v)[.]"


def _wordings(words: str) -> list[str]:
    if not words.startswith("licensed under "):
        return [words]
    return [f"{s}{v} {words.removeprefix('licensed ')}" for s in SUBJECTS for v in VERBS]


def _spdx(name: str) -> str:
    return "spdx license identifier " + name.lower().replace("-", " ").replace(".", " ")


_KNOWN = {w: name for name, all_words in SENTENCES.items() for words in all_words for w in _wordings(words)}
_KNOWN |= {_spdx(name): f"spdx-{name}" for name in SPDX} | {_spdx(old): f"spdx-{name}" for old, name in SPDX_OLD.items()}


def _sequence(body: Column) -> Column:
    """Known sentences of a text whose sentences are divided by line ends, as normalised words."""
    words = F.transform(F.split(body, "\n"), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    return F.filter(words, lambda s: s.isin(list(_KNOWN)))


def pattern(ids: list[str]) -> str:
    """A rule as part of a sequence written as text."""
    return "".join(f";{i};" for i in ids)


def with_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_ids``: the identifiers found, in text order."""
    low = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), NO_BREAK, "$1$2")
    cut = F.regexp_replace(low, BREAK, "$1\n")
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        F.regexp_replace(low, "\r", ""), "\n[ \t]*\n", "\x01"), "\n", " "), "\x01", "\n")
    wrapped = F.regexp_replace(joined, BREAK, "$1\n")
    none = F.array().cast("array<string>")
    # a carriage return may stand inside a word in the reading that leaves it out
    whole = F.replace(low, F.lit("\r"), F.lit(""))
    held = docs.withColumn("_hint", low.rlike(HINT) | (low.contains("\r") & whole.rlike(HINT)))
    held = held.withColumn("_a", F.when(F.col("_hint"), _sequence(wrapped)).otherwise(none))
    held = held.withColumn("_b", F.when(F.col("_hint"), _sequence(cut)).otherwise(none))
    found = F.when(F.size("_b") > F.size("_a"), F.col("_b")).otherwise(F.col("_a"))
    name = F.create_map(*[F.lit(x) for pair in _KNOWN.items() for x in pair])
    return held.withColumn("_ids", F.transform(found, lambda s: F.element_at(name, s))).drop("_a", "_b", "_hint")


def recognise(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by what it says about licences, in every row of ``docs``.

    ``sentences``: identifiers in text order, comma-joined; ``licences``: licences of the matched rules,
    each once, in rule order; ``n_matches``: rule matches; ``left_over``: identifiers that no
    rule used.  Columns of ``docs`` with these names are replaced, the others stay.
    """
    added = ("sentences", "licences", "n_matches", "left_over")
    kept = [c for c in docs.columns if c not in (*added, text)]
    held = with_sentences(docs.select(*[f"`{c}`" for c in kept], F.col(text).alias("_text")), "_text").drop("_text")
    held = held.withColumn("sentences", F.array_join("_ids", ","))
    # the sequence as text, every identifier between its own semicolons: a rule is a plain part of it
    held = held.withColumn("_rest", F.array_join(F.transform("_ids", lambda i: F.concat(F.lit(";"), i, F.lit(";"))), ""))
    rules = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(pattern(ids)).alias("pattern")) for name, ids in RULES])
    start = F.struct(F.col("_rest").alias("rest"), F.lit(0).cast("bigint").alias("n"),
                     F.array().cast("array<string>").alias("found"))

    def apply(acc: Column, rule: Column) -> Column:
        # a used stretch leaves a bar, so that what stood on its two sides doesn't meet
        rest = F.replace(acc["rest"], rule["pattern"], F.lit("|"))
        n = ((F.length(acc["rest"]) - F.length(rest)) / (F.length(rule["pattern"]) - 1)).cast("bigint")
        return F.struct(rest.alias("rest"), (acc["n"] + n).alias("n"),
                        F.when(n > 0, F.array_append(acc["found"], rule["licence"])).otherwise(acc["found"]).alias("found"))

    held = held.withColumn("_end", F.when(F.size("_ids") > 0, F.aggregate(rules, start, apply)).otherwise(start))
    left = F.regexp_replace(F.regexp_replace(F.col("_end.rest"), "[|;]+", ","), "^,|,$", "")
    return held.select(*[f"`{c}`" for c in kept], "sentences",
                       F.array_join(F.array_distinct("_end.found"), ",").alias("licences"),
                       F.col("_end.n").alias("n_matches"), left.alias("left_over"))


def oracle_sql(key: str = "doc_id") -> str:
    """The same over the table documents, in DuckDB SQL."""
    known = ", ".join(f"('{w}', '{name}')" for w, name in _KNOWN.items())
    steps = ", ".join(f"replace(r{k}, '{pattern(ids)}', '|') AS r{k + 1}" for k, (_, ids) in enumerate(RULES))
    hit = [f"(length(r{k}) - length(r{k + 1})) // {len(pattern(ids)) - 1}" for k, (_, ids) in enumerate(RULES)]
    named = ", ".join(f"CASE WHEN r{k} <> r{k + 1} THEN '{name}' END" for k, (name, _) in enumerate(RULES))
    order = list(dict.fromkeys(name for name, _ in RULES))
    place = "[" + ", ".join(f"'{n}'" for n in order) + "]"
    clean = "list_filter(list_transform(string_split({}, chr(10)), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), " \
            "lambda s: map_contains(k.known, s))"
    cut = "regexp_replace({}, '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g')"
    joined = "replace(replace(regexp_replace(replace(low, chr(13), ''), '\\n[ \\t]*\\n', chr(1), 'g'), chr(10), ' '), chr(1), chr(10))"
    return f"""
WITH k AS (SELECT map_from_entries(list((w, name))) AS known FROM (VALUES {known}) t(w, name)),
t AS (SELECT {key}, regexp_replace(lower(coalesce(text, '')), '{NO_BREAK}', '\\1\\2', 'g') AS low FROM documents),
s AS (SELECT {key}, k.known AS known, {clean.format(cut.format(joined))} AS a, {clean.format(cut.format('low'))} AS b FROM t, k),
q AS (SELECT {key}, list_transform(CASE WHEN len(b) > len(a) THEN b ELSE a END, lambda x: known[x]) AS ids FROM s),
r AS (SELECT {key}, ids, coalesce(array_to_string(list_transform(ids, lambda i: ';' || i || ';'), ''), '') AS r0 FROM q),
z AS (SELECT *, {steps} FROM r)
SELECT {key}, coalesce(array_to_string(ids, ','), '') AS sentences,
  coalesce(array_to_string(list_filter({place}, lambda p: list_contains([{named}], p)), ','), '') AS licences,
  CAST({" + ".join(hit)} AS BIGINT) AS n_matches,
  regexp_replace(regexp_replace(r{len(RULES)}, '[|;]+', ',', 'g'), '^,|,$', '', 'g') AS left_over
FROM z"""
