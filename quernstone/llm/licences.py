"""Licence families of paragraphs by a sparse n-gram logistic regression, with DataFrame functions only."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import guarded, materialize, read_table, sampled_docs, text_or_empty

UNKNOWN = "unknown"

# Wordings of licence notices by family.
TEMPLATES = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Released under the GNU AGPL v3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 licence.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Released under the 2-clause BSD licence.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under CC BY 3.0 unless otherwise noted.",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
        "Licensed under CC BY 2.0.",
        "Licensed under CC BY 2.5.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under CC0 1.0 Universal, dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU General Public License, version 2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it and or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Library General Public License, version 2.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Released under the GNU LGPL v3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "This project is licensed under the terms of the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved. No part of this work may be reproduced without prior written permission.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
# Titles and short names by family. They are learned from but confirm nothing, as prose names licences too.
TITLES = {
    "agpl": ["GNU Affero General Public License", "AGPL v3", "AGPL-3.0"], "apache": ["Apache License", "Apache 2.0", "Apache-2.0"], "bsd": ["BSD License", "BSD 3-Clause License", "BSD-2-Clause"],
    "cc-by": ["Creative Commons Attribution 4.0", "CC BY 4.0"], "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0"], "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0"],
    "cc0": ["CC0 1.0 Universal", "CC0 1.0"], "gpl": ["GNU General Public License", "GPL v2", "GPL v3", "GPL-3.0"], "lgpl": ["GNU Lesser General Public License", "LGPL v2.1", "LGPL-3.0"],
    "mit": ["MIT License", "The MIT License"], "mpl": ["Mozilla Public License", "MPL 2.0"],
}
#: Sentences that share words with notices and are none.
NOT_LICENCES = [
    "The driver was licensed under the old rules of the city.", "She studied at MIT and released a paper.", "The public library is free and open to any person.",
    "A general version of the work is found in the file.", "The apache helicopter flew over the common.", "The copyright office moved to a new address.",
    "He has a license to sell wine without restriction.", "The software version 2.0 was published by the company in 2019.", "Creative people commonly share their work with the public.",
    "The terms of the contract permit use by the author only.", "The museum reserved all rooms for the conference.", "The committee released its report under the law.",
]
#: At most so many paragraphs, of the FIT_DOCS documents with the lowest hash, join the templates in fitting and calibration.
FIT_DOCS, FIT_PARAGRAPHS = 400, 4000
#: A word of the templates is a cue if at most this share of the sampled paragraphs has it, and so is a pair of other words; every feature holds a cue, and every template one at least.
CUE_SHARE = 0.002
#: Share of a template's or paragraph's word pairs, whichever are fewer, that confirms a prediction; and that labels a sampled paragraph.
CONFIRM = 0.5
FALSE_SHARE = 0.002
#: Calibration sees every template as scored by a fit without a part of them that holds it.
PARTS = 3


def paragraphs(text: Column) -> Column:
    """Lines and sentences of a text, lower case."""
    return F.split(F.lower(text), r"\n+|(?<=[.!?]) +")


def units(text: Column) -> Column:
    """Sentences of a text, lower case, and what empty lines part; a unit's lines are paragraphs."""
    return F.split(F.lower(text), r"\n(?: *\n)+|(?<=[.!?])[ \n]+")


def words_of(paragraph: Column) -> Column:
    return F.filter(F.split(paragraph, "[^a-z0-9]+"), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def grams_of(words: Column) -> Column:
    """Distinct words and word pairs."""
    return F.array_distinct(F.concat(words, pairs_of(words)))


@dataclass
class LicenceModel:
    """cues, and pair_cues of words that are none; table of (gram, one weight for each label); bias; temperature and threshold of the calibration."""

    labels: list[str]
    cues: list[str]
    pair_cues: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    threshold: float

    def weight_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(g, w) for g, w in self.weights.items()], "gram string, w array<double>")


def _template_table(spark: SparkSession) -> DataFrame:
    """family, template (number), pair, size, single (no other family's templates have the pair): the distinct word pairs of each template."""
    rows = [(f, i, t.lower()) for i, (f, t) in enumerate((f, t) for f, own in TEMPLATES.items() for t in own)]
    made = spark.createDataFrame(rows, "family string, template int, t string").withColumn("_p", F.array_distinct(pairs_of(words_of(F.col("t")))))
    each = made.select("family", "template", F.size("_p").alias("size"), F.explode("_p").alias("pair"))
    return each.join(each.groupBy("pair").agg((F.count_distinct("family") == 1).alias("single")), "pair")


def template_overlap(found: DataFrame, spark: SparkSession, lone: bool = False) -> DataFrame:
    """seg, family, overlap: for rows of found (seg, words), the best share of common word pairs with a template of each family it touches.

    One common pair says nothing, but with lone it does for a paragraph that has no other. One of the common pairs must be of
    no other family's templates, as notices of families that are no class share the rest.
    """
    pairs = found.select("seg", F.array_distinct(pairs_of(F.col("words"))).alias("_p")).select("seg", F.size("_p").alias("own"), F.explode("_p").alias("pair"))
    both = pairs.join(F.broadcast(_template_table(spark)), "pair")  # a constant table
    shares = both.groupBy("seg", "own", "family", "template", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.least("own", "size"))
    singles = both.where("single").select("seg", "family").distinct()
    return shares.join(singles, ["seg", "family"], "left_semi").where("n > 1 or own = 1" if lone else "n > 1").groupBy("seg", "family").agg(F.max("share").alias("overlap"))


def fit_licences(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_paragraphs: int = FIT_PARAGRAPHS) -> LicenceModel:
    """Fits on templates, counterexamples and a bounded sample of paragraphs, a third of which, by hash, calibrates instead, beside each template as a fit without it scores it.

    A sampled paragraph takes the family whose template it overlaps by CONFIRM, is unknown if it overlaps none by
    half of that, and is left out in between.
    """
    spark = docs.sparkSession
    some = sampled_docs(docs, fit_docs)
    split = some.select(F.explode(paragraphs(F.col("text"))).alias("p")).distinct().withColumn("words", words_of(F.col("p"))).where(F.size("words") > 0)
    sampled = materialize(split.orderBy(F.xxhash64("p"), "p").limit(fit_paragraphs).withColumn("seg", F.monotonically_increasing_id()), "licence-sample")
    near = template_overlap(sampled, spark).groupBy("seg").agg(F.max("overlap").alias("top"), F.max_by("family", F.struct("overlap", "family")).alias("family"))
    marked = sampled.join(near, "seg", "left").withColumn("label", F.when(F.col("top") >= CONFIRM, F.col("family")).when(F.coalesce("top", F.lit(0.0)) < CONFIRM / 2, F.lit(UNKNOWN)))
    labels = [UNKNOWN, *sorted(TEMPLATES)]
    corpus = [(tuple(r.grams), labels.index(r.label), r.third == 0) for r in marked.where("label is not null").select(grams_of(F.col("words")).alias("grams"), "label", F.pmod(F.xxhash64("p"), F.lit(3)).alias("third"), "p").orderBy("p").collect()]
    own = [(t, labels.index(f)) for known in (TEMPLATES, TITLES) for f, ts in known.items() for t in ts] + [(t, 0) for t in NOT_LICENCES]
    shown = [(_grams(t), y) for t, y in own]
    plain = [set(g) for g, y, _ in corpus if y == 0]
    counts = Counter(w for g in plain for w in g)
    often = {w for w, n in counts.items() if n > max(2, CUE_SHARE * len(plain))}
    seen = sorted({g for gs, y in shown if y for g in gs})
    cues = sorted({w for g in seen for w in g.split() if w not in often and not w.isdigit()})
    pair_cues = {g for g in seen if " " in g and g not in often and set(cues).isdisjoint(g.split()) and not g.replace(" ", "").isdigit()}
    for gs, y in shown:
        if y and pair_cues.isdisjoint(gs) and set(cues).isdisjoint(gs):
            pair_cues.add(min((g for g in gs if " " in g), key=lambda g: (counts[g], g)))
    vocabulary = [g for g in seen if g in pair_cues or not set(cues).isdisjoint(g.split())]
    rows = shown + [(g, y) for g, y, held in corpus if not held]
    weights, bias = _logistic(rows, vocabulary, len(labels))
    unseen = [pair for part in range(PARTS) for pair in _left_out(rows, {i for i, (_, y) in enumerate(shown) if y and i % PARTS == part}, vocabulary, len(labels))]
    kept = np.flatnonzero(np.abs(weights).max(1) > 0)
    table = {vocabulary[i]: weights[i].tolist() for i in kept}
    held = [(bias + sum((np.array(table[g]) for g in gs if g in table), np.zeros(len(labels))), y) for gs, y, out in corpus if out]
    temperature, threshold = _calibrate(held + unseen)
    return LicenceModel(labels, cues, sorted(pair_cues), table, bias.tolist(), temperature, threshold)


def _grams(text: str) -> tuple[str, ...]:
    """grams_of(words_of()) of a template."""
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    return tuple(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))


def _logistic(rows: list[tuple[tuple[str, ...], int]], vocabulary: list[str], labels: int, l1: float = 2e-5, l2: float = 1e-5, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression with elastic net by accelerated proximal gradient; licences and the rest weigh the same in all."""
    at = {g: i for i, g in enumerate(vocabulary)}
    alike = Counter((frozenset(at[g] for g in gs if g in at), y) for gs, y in rows)  # most paragraphs have no feature
    x = np.zeros((len(alike), len(vocabulary) + 1))
    x[:, -1] = 1
    for i, (on, _) in enumerate(alike):
        x[i, list(on)] = 1
    y = np.array([label for _, label in alike])
    n = np.array(list(alike.values()), dtype=float)
    share = n * np.where(y > 0, 0.5 / max(1.0, n[y > 0].sum()), 0.5 / max(1.0, n[y == 0].sum()))
    goal = np.eye(labels)[y]
    step = 1 / (0.5 * float(share @ (x * x).sum(1)) + l2)
    w = ahead = np.zeros((x.shape[1], labels))
    t = 1.0
    for _ in range(steps):
        z = x @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        moved = ahead - step * (x.T @ ((p - goal) * share[:, None]) + l2 * ahead)
        new = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1)
        new[-1] = moved[-1]
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return w[:-1], w[-1]


def _left_out(rows: list[tuple[tuple[str, ...], int]], out: set[int], vocabulary: list[str], labels: int) -> list[tuple[np.ndarray, int]]:
    """Scores and label of the rows numbered out, by a fit on the others."""
    weights, bias = _logistic([row for i, row in enumerate(rows) if i not in out], vocabulary, labels)
    at = {g: i for i, g in enumerate(vocabulary)}
    return [(bias + weights[[at[g] for g in rows[i][0] if g in at]].sum(0), rows[i][1]) for i in sorted(out)]


def _calibrate(held: list[tuple[np.ndarray, int]]) -> tuple[float, float]:
    """Temperature with the least log loss on held-out paragraphs, notices and the rest weighing the same in all, and the threshold that FALSE_SHARE of the rest pass at most."""
    if not held:
        return 1.0, 0.5
    z, y = np.array([row for row, _ in held]), np.array([label for _, label in held])
    share = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y == 0).sum()))

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    best = min((1.0, 1.5, 2.0, 3.0), key=lambda t: -(share * np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-12))).sum())
    top = np.sort(probabilities(best)[y == 0, 1:].max(1))
    allowed = top[max(0, len(top) - 1 - int(FALSE_SHARE * len(top)))] if len(top) else 0.5
    return best, float(min(0.9, max(0.5, allowed)))


def cue_pattern(cues: list[str]) -> str:
    """A pattern that finds any cue, a word or a pair of words, in lower-case text. Cues share their beginnings, so that a word is read once, whatever their number."""
    if not cues:
        return "(?!)"
    tree: dict = {}
    for cue in cues:
        node = tree
        for c in cue:
            node = node.setdefault(c, {})
        node[""] = {}

    def said(node: dict) -> str:
        parts = ["(?![a-z0-9])" if c == "" else ("[^a-z0-9]++" if c == " " else c) + said(node[c]) for c in sorted(node)]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""

    return "(?<![a-z0-9])" + said(tree)


def scan_paragraphs(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """doc_id, _th, paragraph (lower case), family, probability, overlap, confirmed: for every paragraph that the model gives a family.

    A paragraph without a cue has no feature, so the bias alone makes it unknown; the others are scored by a join
    with the weights, which the templates bound. A sentence over several lines is a paragraph too, in place of its
    lines where it is confirmed and none of them is.
    """
    spark = docs.sparkSession
    cued = cue_pattern([*model.cues, *model.pair_cues])
    texts = docs.select("doc_id", text_or_empty().alias("text")).where(F.lower("text").rlike(cued))  # others have no unit with a cue
    split = texts.select("doc_id", F.xxhash64("text").alias("_th"), F.explode(units(F.col("text"))).alias("_whole"))
    whole = materialize(split.where(F.col("_whole").rlike(cued)).withColumn("_unit", F.monotonically_increasing_id()), "licence-units")
    lines = F.split("_whole", r"\n+")
    each = whole.select("doc_id", "_th", "_unit", F.posexplode(F.when(F.size(lines) > 1, F.concat(F.array("_whole"), lines)).otherwise(F.array("_whole"))).alias("_at", "paragraph"), (F.size(lines) > 1).alias("_many"))
    found = each.withColumn("words", words_of(F.col("paragraph"))).withColumn("_joined", F.col("_many") & (F.col("_at") == 0)).drop("_many", "_at")
    found = materialize(found.withColumn("seg", F.monotonically_increasing_id()), "licence-cues")
    grams = found.select("seg", F.explode(grams_of(F.col("words"))).alias("gram"))
    n = len(model.labels)
    sums = grams.join(F.broadcast(model.weight_table(spark)), "gram").groupBy("seg").agg(F.array(*(F.sum(F.col("w")[i]) for i in range(n))).alias("z"))
    bias = F.array(*map(F.lit, model.bias))
    scored = sums.select("seg", F.zip_with("z", bias, lambda z, b: (z + b) / model.temperature).alias("z"))
    top = F.array_max("z")
    label = F.element_at(F.array(*map(F.lit, model.labels)), F.array_position("z", top).cast("int"))
    likely = scored.select("seg", label.alias("family"), (1 / F.aggregate("z", F.lit(0.0), lambda sum_, z: sum_ + F.exp(z - top))).alias("probability"))
    named = materialize(likely, "licence-scores").where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold))
    overlap = template_overlap(found, spark, lone=True)
    both = found.join(named, "seg").join(overlap, ["seg", "family"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    both = materialize(both.withColumn("confirmed", F.col("overlap") >= CONFIRM), "licence-named")
    units_ = both.groupBy("_unit").agg(F.bool_or(F.col("confirmed") & F.col("_joined")).alias("_by_whole"), F.bool_or(F.col("confirmed") & ~F.col("_joined")).alias("_by_line"))
    kept = both.join(units_, "_unit").where(F.col("_joined") == (F.col("_by_whole") & ~F.col("_by_line")))
    return kept.select("doc_id", "_th", "paragraph", "family", "probability", "overlap", "confirmed")


@guarded
def scan_licences(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """Each row of docs (doc_id, text, others) without text, with n_licences, n_unconfirmed, families and licence.

    n_licences counts confirmed paragraphs, families names their families in order, joined by commas, and licence is
    the commonest (ties: the first by name; null if there is none). Null and empty texts have none. Documents are
    told apart by doc_id (null is a value) and a hash of the text; repeated rows get each the sum over their copies
    divided by their number. Columns named like a result are replaced. An empty table gives none.
    """
    model = model or fit_licences(docs)
    hits = scan_paragraphs(docs, model).groupBy("doc_id", "_th", "family").agg(F.count_if("confirmed").alias("n"), F.count_if(~F.col("confirmed")).alias("other"))
    sums = hits.groupBy("doc_id", "_th").agg(
        F.sum("n").alias("_n"), F.sum("other").alias("_other"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.col("family")))), ",").alias("_families"),
        F.min_by("family", F.struct(-F.col("n"), "family")).alias("_licence"),
    )
    sums = materialize(sums.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_h"), "_n", "_other", "_families", "_licence"), "licence-hits")
    keep = [c for c in docs.columns if c not in ("text", "n_licences", "n_unconfirmed", "families", "licence")]
    base = docs.select(*keep, F.xxhash64(text_or_empty()).alias("_th"))
    copies = base.join(sums.select("_id", "_h"), base["doc_id"].eqNullSafe(F.col("_id")) & (base["_th"] == F.col("_h")), "left_semi").groupBy("doc_id", "_th").agg(F.count(F.lit(1)).alias("_copies"))
    each = sums.join(copies, sums["_id"].eqNullSafe(copies["doc_id"]) & (sums["_h"] == copies["_th"])).drop("doc_id", "_th")
    joined = base.join(each, base["doc_id"].eqNullSafe(each["_id"]) & (base["_th"] == each["_h"]), "left")
    count = lambda c: F.coalesce((F.col(c) / F.col("_copies")).cast("long"), F.lit(0).cast("long"))
    return joined.select(*keep, count("_n").alias("n_licences"), count("_other").alias("n_unconfirmed"), F.coalesce("_families", F.lit("")).alias("families"), F.when(F.col("_n") > 0, F.col("_licence")).alias("licence"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
