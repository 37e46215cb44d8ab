"""Licence families: wordings that no template has, families that are no class, whole notices, and the joins against plain Python."""

import math
import random
import re
import time

import pytest

from quernstone.llm import licences as L

PROBES = {
    "This program is under the GNU Affero General Public License v3.": "agpl", "SPDX-License-Identifier: AGPL-3.0-only": "agpl", "AGPL-3.0": "agpl",
    "Distributed under the 2-clause BSD licence.": "bsd", "MIT License": "mit", "This code is available under the MIT license.": "mit",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "mit",
    'Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.': "apache",
    "You may use this under the terms of the GNU Lesser General Public License version 3.": "lgpl", "Subject to the Mozilla Public License 1.1.": "mpl",
    "Licensed under the ISC License.": None, "Licensed under the Eclipse Public License, version 2.0.": None, "SPDX-License-Identifier: EUPL-1.2": None,
    "Licensed under the Artistic License 2.0.": None, "The general public may use the work under the law.": None,
}

# Notices as they stand in files.
AGPL_NOTICE = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

You should have received a copy of the GNU Affero General Public License
along with this program."""
BSD_NOTICE = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
MIT_NOTICE = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def fitted(docs):
    """The model, and what it was calibrated on."""
    seen, real = [], L._calibrate
    L._calibrate = lambda held: (seen.extend(held), real(held))[1]
    try:
        return L.fit_licences(docs), seen
    finally:
        L._calibrate = real


def test_wordings_without_a_template(spark, fitted):
    made = spark.createDataFrame(list(enumerate(PROBES)), "doc_id long, text string")
    got = {r.doc_id: r.licence for r in L.scan_licences(made, fitted[0]).collect()}
    assert {t: got[i] for i, t in enumerate(PROBES)} == PROBES


def test_whole_notices(spark, fitted):
    texts = {"agpl": AGPL_NOTICE, "bsd": BSD_NOTICE, "mit": MIT_NOTICE}
    got = {r.doc_id: (r.families, r.licence, r.n_licences) for r in L.scan_licences(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string"), fitted[0]).collect()}
    assert [got[i] for i in range(3)] == [("agpl", "agpl", 2), ("bsd", "bsd", 3), ("mit", "mit", 3)]


def test_calibration_sees_every_family(fitted):
    model, held = fitted
    counts = [sum(y == i for _, y in held) for i in range(len(model.labels))]
    assert counts[0] > 100 and all(counts[1:])
    shown = {f: len(ts) + len(L.TITLES.get(f, [])) for f, ts in L.TEMPLATES.items()}
    assert all(counts[model.labels.index(f)] >= n for f, n in shown.items())


def test_left_out_rows_do_not_score_themselves():
    rows = [(("a", "b"), 1), (("a",), 1), (("c",), 0), (("d",), 0)]
    weights, bias = L._logistic(rows[1:], ["a", "b", "c", "d"], 2)
    scores, label = L._left_out(rows, {0}, ["a", "b", "c", "d"], 2)[0]
    assert label == 1 and scores.tolist() == (bias + weights[0] + weights[1]).tolist() and weights[1].tolist() == [0, 0]


def test_joins_equal_plain_python(spark, docs, fitted):
    """Every paragraph of all documents and of the probes, scored and compared with the templates one by one."""
    model = fitted[0]
    texts = [r.text or "" for r in docs.select("text").collect()] + list(PROBES) + [AGPL_NOTICE, BSD_NOTICE, MIT_NOTICE]
    words = lambda p: [w for w in re.split("[^a-z0-9]+", p) if w]
    pairs = lambda ws: list(dict.fromkeys(f"{a} {b}" for a, b in zip(ws, ws[1:])))
    templates = [(f, set(pairs(words(t.lower())))) for f, ts in L.TEMPLATES.items() for t in ts]
    homes: dict[str, set[str]] = {}
    for f, ps in templates:
        for p in ps:
            homes.setdefault(p, set()).add(f)

    def judged(paragraph):
        ws = words(paragraph)
        ps = set(pairs(ws))
        if set(model.cues).isdisjoint(ws) and set(model.pair_cues).isdisjoint(ps):
            return None
        grams = [g for g in {*ws, *ps} if g in model.weights]
        if not grams:
            return None
        z = [(b + sum(model.weights[g][i] for g in grams)) / model.temperature for i, b in enumerate(model.bias)]
        best = max(range(len(z)), key=lambda i: z[i])
        probability = 1 / sum(math.exp(v - z[best]) for v in z)
        if best == 0 or probability < model.threshold:
            return None
        family = model.labels[best]
        own = [(len(ps & t), len(t)) for f, t in templates if f == family]
        single = any(homes.get(p) == {family} for p in ps)
        overlap = max((n / min(len(ps), size) for n, size in own if n > 1 or n and len(ps) == 1), default=0.0) if single else 0.0
        return family, round(probability, 6), round(overlap, 6), overlap >= L.CONFIRM

    want = []
    for i, text in enumerate(texts):
        for unit in re.split(r"\n(?: *\n)+|(?<=[.!?])[ \n]+", text.lower()):
            lines = re.split(r"\n+", unit)
            whole, single = judged(unit), [(p, judged(p)) for p in lines]
            joined = len(lines) > 1 and whole and whole[3] and not any(j and j[3] for _, j in single)
            want += [(i, unit, *whole)] if joined else [(i, p, *j) for p, j in single if j]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, r.paragraph, r.family, round(r.probability, 6), round(r.overlap, 6), r.confirmed) for r in L.scan_paragraphs(made, model).collect()]
    assert len(want) > 20 and sorted(got) == sorted(want)


def test_cue_pattern_finds_the_words():
    rng, cues = random.Random(4), ["gpl", "gplv3", "mit", "license v2", "license", "in the", "the"]
    text = ["gpl", "gplv", "gplv3", "mit", "permit", "license", "licenses", "v2", "in", "the", "é", "", "x1"]
    assert not re.search(L.cue_pattern([]), "mit")
    for some in (cues, ["in the"], ["mit", "license v2"]):
        for _ in range(2000):
            t = "".join(rng.choice(text) + rng.choice([" ", "", "-", "  ", "\n", "##"]) for _ in range(rng.randrange(6)))
            words = re.split("[^a-z0-9]+", t)
            want = any(c in words or c.split() in [words[i:i + 2] for i in range(len(words))] for c in some)
            assert bool(re.search(L.cue_pattern(some), t)) == want, (t, some)
    long = "in" + "#" * 1_000_000 + "x " + "in " * 100_000
    start = time.perf_counter()
    assert not re.search(L.cue_pattern(["in the"]), long) and time.perf_counter() - start < 20
