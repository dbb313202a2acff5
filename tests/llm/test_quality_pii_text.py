"""Quality rules and network, personal data, licences, preference pairs."""

from __future__ import annotations

import collections
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tillsight.llm import licences, pii, preference, quality_net, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(t):
    t = t or ""
    w = WORD.findall(t)
    grams = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def labelled(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(["the", "ing", "er", "on", "at", "and"]) for _ in range(rng.randint(1, 3)))
                 for _ in range(rng.randint(20, 80))]
        good = k % 4 != 0
        rows.append((k, " ".join(words) if good else " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in words), "x"))
        labels.append((k, int(good)))
    return rows, labels


def test_rules_match_brute_force_and_reject_junk(spark):
    rows, labels = labelled(400)
    rng = random.Random(9)
    odd = [None, "", " \n\t", "a b", "a b c d e f g h i j", "a b c d e " * 4, "l one\nl one\n l one\r\n\nl one", "#*$%&|<> x",
           " ".join(rng.choice("ab") for _ in range(3000)), "é\x0bü\x0cö x  y"]
    rows += [(1000 + i, t, "x") for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, llr string")
    marks = spark.createDataFrame(labels + [(1, None), (5000, 1)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, marks).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                r["base_failed"]) == brute_rules(t), t
    fair = [(i, g) for i, g in labels if not got[i]["base_failed"]]
    assert sum(got[i]["kept"] == bool(g) for i, g in fair) >= 0.99 * len(fair)
    assert not any(r["kept"] for r in got.values() if r["base_failed"])
    none = quality_rules.quality_rules(docs, marks.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)
    assert quality_rules.quality_rules(docs.limit(0), marks).count() == 0


def test_rules_fit_on_every_labelled_document(spark, monkeypatch):
    rows, labels = labelled(120, seed=3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, llr string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    whole = {r["doc_id"]: r["llr"] for r in quality_rules.quality_rules(docs, marks).collect()}
    monkeypatch.setattr(quality_rules, "SAMPLE", 1, raising=False)
    again = {r["doc_id"]: r["llr"] for r in quality_rules.quality_rules(docs, marks).collect()}
    assert again == pytest.approx(whole)


def test_network_learns_and_never_sees_the_held_out_fold(spark):
    from pyspark.sql import functions as F

    rows, labels = labelled(600)
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "word " * 30_000, "x"), (1002, "word " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    seen = F.col("doc_id") % 3 != 1
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality_net.quality_scores(docs, marks, seen).collect()}
    assert len(got) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [(i, g) for i, g in labels if i % 3 == 1]
    assert sum(got[i]["predicted"] == g for i, g in held) >= 0.97 * len(held)
    # labels of the held-out fold don't change a score
    other = spark.createDataFrame([(i, 1 - g if i % 3 == 1 else g) for i, g in labels], "doc_id bigint, quality int")
    again = {r["doc_id"]: r["score"] for r in quality_net.quality_scores(docs, other, seen).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    assert quality_net.quality_scores(docs.limit(0), marks, seen).count() == 0
    assert {r["score"] for r in quality_net.quality_scores(docs, marks.limit(0), seen).collect()} == {0.5}


def brute_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum((2 * x - 9 if x > 4 else 2 * x) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return ",".join("%s:%d:%d" % x for x in out)


def pii_texts():
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab@..--++ 0123456789() é😀\n_") for _ in range(rng.randint(0, 100))) for _ in range(500)]
    texts += [None, "", "1.2.3.4.5.6.7.8 a@b.co_x@y.z.w@q.r 4111 1111 1111 1111 000000255.1.1.1 +1+12345678", "a@b.c " * 700,
              "x\x01\x02 a@b.c", "4111-1111-1111-1111 " * 300, "1 " * 9000, "9" * 9000, "a.b@" + "c." * 9000 + "d"]
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    # one in eight has another name before it: the trees know the format, not the keyword
    return texts + [f'words {"token" if k % 8 else "value"} = "{h}" words' for k, h in enumerate(hexes)]


def test_spans_match_brute_force_and_trees_add_secrets(spark):
    texts = pii_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    model = pii.learn(docs, "text")
    got = pii.find_spans(docs.drop("spans"), model).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        assert got.base_spans[i] == brute_spans(t), t and t[:80]
        assert got.spans[i].startswith(got.base_spans[i])
    # the last 60 texts hold a secret each
    assert sum("secret" in s for s in got.spans[-60:]) >= 55
    clean = pii.redact(docs, model).toPandas().set_index("doc_id").text
    assert clean[-60:].str.contains("[SECRET]", regex=False).sum() >= 55
    assert not any(re.search(r"[a-z]@[a-z]+\.[a-z]", x or "") for x in clean)
    assert clean[500] is None and clean[501] == ""
    assert pii.find_spans(docs.drop("spans").limit(0), pii.learn(docs.limit(0), "text")).count() == 0


def test_licence_sequences(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
           "documentation files (the \"Software\"), to deal\nin the Software without restriction, including without "
           "limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the "
           "Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following "
           "conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or "
           "substantial portions of the Software.\n")
    rows = [(0, None), (1, ""), (2, "Foo bar. Licensed under the Apache License, Version 2.0.\nMore."), (3, mit),
            (4, "no stop here\nAll rights reserved.\nThis work is licensed under the GNU General Public License, version 3."),
            (5, "LICENSED UNDER CC BY-NC 4.0! Licensed under CC BY-NC 4.0."), (5, "x " * 20_000 + ". All rights reserved.")]
    docs = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id bigint, text string, licences string")
    got = sorted((r["doc_id"], r["sentences"], r["licences"], r["n_matches"], r["left_over"])
                 for r in licences.recognise(docs).collect())
    assert got == [
        (0, "", "", 0, ""), (1, "", "", 0, ""), (2, "apache2-name", "Apache-2.0", 1, ""),
        (3, "mit-grant,mit-notice", "MIT", 1, ""), (4, "all-rights,gpl3-name", "GPL-3.0-only", 1, "all-rights"),
        (5, "all-rights", "", 0, "all-rights"), (5, "cc-by-nc4,cc-by-nc4", "CC-BY-NC-4.0", 2, "")]
    assert all(re.search(licences.HINT, w) for w in licences._KNOWN)


def test_preference_pairs(spark):
    rows = [(1, 0, 0, "user", "hi"), (1, 0, 1, "assistant", "good"), (1, 1, 0, "user", "hi"), (1, 1, 1, "assistant", "bad"),
            (1, 1, 2, "user", None), (2, 0, 0, "user", "alone"), (3, 0, 0, "user", "a"), (3, 1, 0, "user", "a"),
            (4, 1, 0, None, "only rejected"), (4, 1, 0, None, "only rejected")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "pair_id int, side int, turn int, role string, text string, prompt string")
    got = {r["pair_id"]: r for r in preference.format_pairs(turns).collect()}
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi<|end|>\n" and one["prompt_turns"] == 1
    assert one["chosen"] == "<|assistant|>\ngood<|end|>\n" and one["chosen_mask"] == "14:0,12:1"
    assert one["rejected"] == "<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n" and one["rejected_mask"] == "14:0,11:1,17:0"
    for r in (one,):
        for side in ("chosen", "rejected"):
            assert sum(int(x.split(":")[0]) for x in r[f"{side}_mask"].split(",")) == len(r[side])
    assert got[2]["rejected"] is None and got[2]["prompt"] == "" and got[2]["chosen"] == "<|user|>\nalone<|end|>\n"
    assert got[3]["prompt_turns"] == 1 and got[3]["chosen"] == got[3]["rejected"] == ""
    assert got[4]["chosen"] is None and got[4]["rejected"].count("only rejected") == 2
    assert preference.format_pairs(turns.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_licences", "op2_preference_pairs"])
def test_oracles(spark, name):
    import duckdb

    from tillsight.llm.queries import ORACLES, QUERIES

    where, key = "/root/testdata/sf0.001", "doc_id" if name == "op1_licences" else "pair_id"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{where}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df().sort_values(key).reset_index(drop=True)
    got = QUERIES[name](spark, where).toPandas().sort_values(key).reset_index(drop=True)
    assert ((got == want[got.columns]) | (got.isna() & want[got.columns].isna())).all().all()


def test_licences_in_raw_spellings(spark):
    """Every known sentence is found however its words are divided: the hint looks at the raw text."""
    rows = [(s, w, s.join(w.split())) for w in licences._KNOWN for s in (" ", "-", "\n", "\r\n", "/ ")]
    rows += [("cr", "all rights reserved", "all rights res\rerved"), (".", "licensed under cc by 4 0", "Licensed under CC-BY 4.0."),
             (".", "this work is distributed under cc by sa 4 0", "This work is distributed under CC-BY-SA 4.0."),
             (".", "released under cc0 1 0", "Released under CC0-1.0.")]
    docs = spark.createDataFrame(rows, "how string, words string, text string")
    got = licences.recognise(docs).collect()
    assert len(got) == len(rows)
    assert [(r["how"], r["words"], r["sentences"]) for r in got if r["sentences"] != licences._KNOWN[r["words"]]] == []


def test_secrets_need_no_digit(spark):
    rng = random.Random(3)
    keys = ["".join(rng.choice("abcdefXYZQRS") for _ in range(24)) for _ in range(60)]
    texts = [f"words password: {k} words" for k in keys] + [f"in the year 5 password: {k} words" for k in keys] + ["plain words"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = pii.learn(docs, "text")
    spans = [r["spans"] for r in pii.find_spans(docs, model).orderBy("doc_id").collect()]
    assert all("secret:16:40" in s for s in spans[:60]) and all("secret:" in s for s in spans[60:120])
    assert not any(spans[120:])
    clean = [r["text"] for r in pii.redact(docs, model).orderBy("doc_id").collect()]
    assert not any(k in t for k, t in zip(keys * 2, clean))


# Notices as their licences word them.
GPL_TAIL = """
This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind} Public License for more details.
"""
NOTICES = {
    "GPL-3.0-or-later": """
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
""" + GPL_TAIL.format(what="program", kind="General"),
    "GPL-2.0-or-later": """
This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
""" + GPL_TAIL.format(what="program", kind="General"),
    "GPL-2.0-only": """
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; version 2 of the License.
""",
    "LGPL-2.1-or-later": """
This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
""" + GPL_TAIL.format(what="library", kind="Lesser General"),
    "AGPL-3.0-or-later": """
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
""" + GPL_TAIL.format(what="program", kind="Affero General"),
    "Apache-2.0": """
   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
""",
    "MPL-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "Zlib": """
This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
""",
    "EPL-2.0": """
This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0
""",
    "ISC": """
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "BSD-2-Clause": """
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
}


def test_notices_as_their_licences_word_them(spark):
    rows = [(name, text) for name, text in NOTICES.items()]
    rows += [(name, f"{sign} SPDX-License-Identifier: {name}{end}") for name in licences.SPDX
             for sign, end in (("//", ""), ("#", "\n# more"), ("/*", " */"), ("", "."))]
    rows += [(name, f"int x;\n// SPDX-License-Identifier: {old}\nint y;") for old, name in licences.SPDX_OLD.items()]
    got = licences.recognise(spark.createDataFrame(rows, "want string, text string")).collect()
    assert [(r["want"], r["sentences"], r["left_over"]) for r in got if r["licences"] != r["want"] or r["left_over"]] == []


def test_every_rule_is_reached_by_its_sentences(spark):
    words = {}
    for w, name in licences._KNOWN.items():
        words.setdefault(name, w)
    rows = [(k, name, ". ".join(words[i] for i in ids) + ".") for k, (name, ids) in enumerate(licences.RULES)]
    got = {r["k"]: r for r in licences.recognise(spark.createDataFrame(rows, "k int, want string, text string")).collect()}
    assert [(name, got[k]["licences"]) for k, name, _ in rows if got[k]["licences"] != name] == []
    assert all(got[k]["n_matches"] == 1 and not got[k]["left_over"] for k, _, _ in rows)


def _overlap(a, b):
    return a[1] < b[2] and b[1] < a[2]


def test_added_spans_and_redaction_equal_a_plain_selection(spark):
    """Candidates scored one by one; overlaps and regions found pair by pair."""
    texts = [t for t in pii_texts() if t] + ["a\x01b mail x@y.zz and \x02", "call +1 (555) 123 45 67, 4111 1111 1111 1111 x@y.zz",
                                             "x@y.zz" * 3, "x\U0001F600@y.zz é +49 30 1234567 \U0001F600"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    model = pii.learn(docs, "text")
    held = pii.with_matches(docs.select("doc_id", pii._plain("text").alias("_t")), pii.WIDE, "_t").select(
        "doc_id", F.explode(pii._wide()).alias("c")).select("doc_id", "c.s", "c.e", "c.f.*").collect()
    scored = {}
    for r in held:
        if model.margin(r.asDict()) >= model.thresholds[r["kind"]] - 1e-5:
            scored.setdefault(r["doc_id"], []).append((r["kind"], r["s"], r["e"]))
    got = {r["doc_id"]: r for r in pii.find_spans(docs, model).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    n_more = 0
    for i, t in enumerate(texts):
        base = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in brute_spans(t).split(",") if x)]
        free = [c for c in scored.get(i, []) if not any(_overlap(c, b) for b in base)]
        more = sorted(c for c in free if not any(o[0] < c[0] and _overlap(c, o) for o in free))
        more = [(pii.WIDE[k].name, s, e) for k, s, e in more]
        n_more += len(more)
        assert got[i]["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in base + more)
        order = [k.name for k in (*pii.BASE, *pii.WIDE)]
        regions = []
        for s, e, k in sorted((s, e, order.index(k)) for k, s, e in base + more):
            if regions and s < regions[-1][1]:
                regions[-1] = [regions[-1][0], max(e, regions[-1][1]), min(k, regions[-1][2])]
            else:
                regions.append([s, e, k])
        want, at = [], 0
        for s, e, k in regions:
            want += [t[at:s], f"[{order[k].upper()}]"]
            at = e
        assert clean[i] == "".join(want) + t[at:]
    assert n_more > 50


def test_many_matches_in_one_text_and_clashing_columns(spark):
    text = " ".join(f"+1 555 {k:07d} user{k}@example.com token: {k:024x}" for k in range(7000))
    docs = spark.createDataFrame([(1, text, "x", 5, "y"), (None, None, "x", 5, "y"), (2, "", "x", 5, "y")],
                                 "doc_id int, text string, spans string, n_ip int, _t string")
    small = spark.createDataFrame([(k, f"user token: {k:024x} words") for k in range(200)], "doc_id int, text string")
    model = pii.learn(small, "text")
    out = pii.find_spans(docs, model)
    assert sorted(out.columns) == sorted({"doc_id", "text", "_t", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"})
    start = time.time()
    got = {r["doc_id"]: r for r in out.collect()}
    assert time.time() - start < 30, time.time() - start
    assert (got[1]["n_email"], got[1]["n_phone"], got[1]["_t"]) == (7000, 7000, "y") and got[1]["spans"].count("secret") == 7000
    assert got[None]["spans"] == got[2]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert clean[1] == " ".join(["[PHONE] [EMAIL] token: [SECRET]"] * 7000) and clean[None] is None and clean[2] == ""
