import re

from tidemark.llm import licenses

TEXTS = [
    None, "", "...", "plain words only", "MIT License", "the mit  licenses", "Released under the MIT License.", "x" * 100_000 + " mit license",
    "This work is licensed under the GNU General Public License, version 3.", "gnu general public license gnu general public license!",
    "Licensed under CC BY-NC 4.0.", "cc by cc by cc-by", "Licensed under the Apache License, Version 2.0. Apache\nLicense", "été CC BY é 日本 mit license",
    "gnu affero general public license v3", "ccby cc  bye cc by", "copyright 2020 all rights reserved", "GNU lesser general public license version 2.1 or later",
    "mit\x7flicense", "KIT License mit licensé", ("word " * 3000 + "apache license ") * 3,
]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in hits]
    norm = " " + " ".join(words) + " "
    found = []
    for priority, keyword, expression, label, confidence in licenses.rules():
        if keyword in norm:
            found += [(m.start(), m.end(), priority, label, confidence) for m in re.finditer(expression, norm)]
    kept = [
        d for d in found
        if not any(e[0] <= d[0] and e[1] >= d[1] and (e[1] - e[0] > d[1] - d[0] or e[2] < d[2]) for e in found)
    ]
    base = sorted({x for _, x in hits})
    score = max([0.5 if hits else 0.0] + [d[4] for d in kept])
    spans = sorted((norm[: d[0]].count(" ") - 1, norm[d[0] : d[1]].count(" ") + 1, d[3]) for d in kept)
    every = ",".join(sorted({*base, *(d[3] for d in kept)}))
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(base), every, score, spans


def test_scan_matches_brute_force(spark):
    rows = [(i, t, "n", 1) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "n", 1)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, norm string, n_words int")).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = sorted((d.first_word, d.n_words, d.label) for d in r.licenses)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, spans) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id][:60]


def test_many_notices_in_one_text(spark):
    unit = "Released under the MIT License. Licensed under the Apache License, Version 2.0. gnu general public license version 3 cc by-nc 4.0 filler words here. "
    texts = [unit * n for n in (1, 7, 150)]
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        spans = [(d.first_word, d.n_words, d.label) for d in r.licenses]
        assert spans == sorted(spans)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, spans) == brute(texts[r.doc_id])


def test_specific_reading_wins():
    assert brute("This work is licensed under the GNU General Public License, version 3.")[5] == "gpl,gpl-3"
    assert brute("Licensed under CC BY-NC 4.0.")[5] == "cc-by,cc-by-nc-4.0"
    assert brute("gnu affero general public license v3")[5] == "agpl-3"
    assert len(licenses.rules()) > 300


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_rule_needs_its_keyword():
    """Each alternative of each expression holds its keyword as words of their own, outside optional parts."""
    rows = licenses.rules()
    assert len(licenses.TEXTS) > 180 and len({e for _, _, e in licenses.TEXTS}) == len(licenses.TEXTS)
    for _, keyword, expression, _, _ in rows:
        body = expression.removeprefix("(?<= )").removesuffix("(?= )")
        while body.startswith("(?:") and body.endswith(")") and _closes_last(body):
            body = body[3:-1]
        for part in _alternatives(body):
            fixed = part
            while fixed != (fixed := re.sub(r"\((?:\?:)?[^()]*\)(?:\?|\*|\{[^}]*\})", "", fixed)):
                pass
            options = re.findall(r"\(\?:([^()]*)\)", fixed)
            words = f" {re.sub(r'[^a-z0-9 ]', ' ', fixed)} "
            assert f" {keyword} " in words or any(all(f" {keyword} " in f" {x} " for x in o.split("|")) for o in options), (keyword, part)


def _closes_last(body):
    depth = 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return i == len(body) - 1


def _alternatives(body):
    parts, depth = [""], 0
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


GRANTS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl,gpl-3-or-later",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache,apache-2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "See https://creativecommons.org/licenses/by-sa/4.0/ for terms": "cc-by-sa-4.0",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2.0,mit",
    "SPDX-License-Identifier: GPL-2.0 OR BSD-3-Clause": "bsd-3-clause,gpl-2",
    "He read the mitten library; all the general public came.": "",
}


def test_texts_of_licenses(spark):
    rows = [(i, t) for i, t in enumerate(GRANTS)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i].labels == brute(t)[5] == GRANTS[t], t
        spans = sorted((d.first_word, d.n_words, d.label) for d in got[i].licenses)
        assert spans == brute(t)[7]


def test_plain_and_full_branch_count_words_alike(spark):
    texts = ["", "a", ".a.", "a b", " a,b ", "é—è", "\u2014", "a\u00a0b", "1.2.3", "\t\n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"{t} mit") for i, t in enumerate(texts)]
    got = {r.doc_id: r.n_words for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == brute(t)[0] for i, t in rows)
