"""Results of the ten operators against brute force, exact laws or held-out accuracy, on the smallest tables."""

import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quernstone.llm import entries, lattice, licences, line_crf, lm_score, near_dups, pii, sharding
from quernstone.llm.common import read_table
from quernstone.llm.host_rules import text_stats
from quernstone.llm.html_text import main_text
from quernstone.llm.mixing import subset_counts
from quernstone.llm.shingles import normal, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {i: t for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


def rows(spark, name):
    return entries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", list(entries.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entries.QUERIES[name](spark, SF)
    want = c.sql(entries.ORACLES[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert sorted(map(str, (tuple(r[x] for x in order) for r in got.collect()))) == sorted(map(str, want.select(*order).fetchall()))


def test_near_dups(spark, texts):
    idf = near_dups.inverse_frequencies(read_table(spark, SF, "documents"))
    ids = list(texts)
    own = [near_dups.weights(h, idf) for h in shingles([normal(texts[i]) for i in ids])]
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if normal(texts[ids[a]]) == normal(texts[ids[b]]) or near_dups.similarity(own[a], own[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want, got = defaultdict(set), defaultdict(set)
    for k, i in enumerate(ids):
        want[root(k)].add(i)
    for r in rows(spark, "op1_near_dups"):
        got[r.class_id].add(r.doc_id)
    assert {frozenset(v) for v in want.values()} == {frozenset(v) for v in got.values()}
    assert all(min(v) == k for k, v in got.items())


def test_bands_follow_similarity():
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    idf = near_dups.Frequencies(np.zeros((near_dups.TABLES, near_dups.CLASSES)), 0)
    shared, truth = [], []
    for k in range(120):
        other = [w if rng.random() > 0.03 else f"x{rng.randrange(9999)}" for w in base]
        pair = [" ".join(base).encode(), " ".join(other).encode()]
        one, two = near_dups.bands_of(pair, idf)
        a, b = (near_dups.weights(h, idf) for h in shingles(pair))
        truth.append(near_dups.similarity(a, b) ** near_dups.ROWS)
        shared.append(sum(x == y for x, y in zip(one, two)) / near_dups.BANDS)
    assert abs(np.mean(shared) - np.mean(truth)) < 0.06


def test_large_groups_link(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(200)] = f"edit{i}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(f"v{i}x{j}" for j in range(100))) for i in range(50)]
    got = {r.doc_id: r.class_id for r in near_dups.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(300)} == {0} and all(got[1000 + i] == 1000 + i for i in range(50))


def test_near_dups_of_a_middle_original(spark):
    """Copies that are like their original only; it is neither first nor last of its bands."""
    rng = random.Random(5)
    original = [f"w{i}" for i in range(300)]
    copies = []
    for _ in range(60):
        own = list(original)
        for i in rng.sample(range(10, 290, 10), 3):
            own[i] = f"x{rng.random()}"
        copies.append(" ".join(own))
    others = [" ".join(f"v{rng.random()}" for _ in range(300)) for _ in range(40)]
    docs = list(enumerate([*copies[:30], " ".join(original), *copies[30:], *others]))
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    idf = near_dups.inverse_frequencies(frame)
    own = [near_dups.weights(h, idf) for h in shingles([normal(t) for _, t in docs])]
    bands = near_dups.bands_of([normal(t) for _, t in docs], idf)
    parent = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if any(x == y for x, y in zip(bands[a], bands[b])) and near_dups.similarity(own[a], own[b]) >= 0.8 and parent[a] != parent[b]:
                low, high = sorted((parent[a], parent[b]))
                parent = [low if p == high else p for p in parent]
    got = {r.doc_id: r.class_id for r in near_dups.classes(frame).collect()}
    assert len({parent[i] for i in range(61)}) < 10
    assert got == dict(enumerate(parent))


def test_frequencies_stand_out_of_full_classes():
    """Classes with 2,000 others each; 300 shingles of 1,000 documents."""
    rng = np.random.default_rng(3)
    counts = rng.poisson(2000, (near_dups.TABLES, near_dups.CLASSES)).astype(float)
    common, rare = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64)
    for t in range(near_dups.TABLES):
        np.add.at(counts[t], near_dups._class_of(common, t), 1000)
    docs = 15_000_000
    idf = near_dups.Frequencies(counts, docs)
    want = 1 + np.log(docs / 1000) / np.log(docs / 2)
    assert np.abs(idf(common) - want).max() < 0.02 and (idf(rare) == 2).mean() > 0.99


def test_near_dups_on_a_template(spark):
    """Texts of 600 shared and 44 own words, and for each one with six edits: like each other, not like the rest."""
    rng = random.Random(8)
    shared, docs = [f"s{i}" for i in range(600)], []
    for k in range(200):
        words = shared[:300] + [f"o{k}x{i}" for i in range(44)] + shared[300:]
        other = list(words)
        for i in rng.sample(range(644), 6):
            other[i] = f"e{k}x{i}"
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    idf = near_dups.inverse_frequencies(frame)
    own = [near_dups.weights(h, idf) for h in shingles([normal(t) for _, t in docs])]
    links = [(2 * k, 2 * k + 1) for k in range(200) if near_dups.similarity(own[2 * k], own[2 * k + 1]) >= 0.8]
    assert len(links) > 150
    got = {r.doc_id: r.class_id for r in near_dups.classes(frame).collect()}
    assert sum(got[a] == got[b] for a, b in links) >= 0.95 * len(links)
    truly = {(a, b) for a in range(0, 400, 7) for b in range(a) if near_dups.similarity(own[a], own[b]) >= 0.8}
    assert sum(got[a] == got[b] for a, b in truly) >= 0.95 * len(truly)


def test_lattice_sums_all_segmentations():
    pieces = lattice.Pieces([b" ", b"a", b"b", b"ab", b" a", b"\xc3", b"\xa9", b"\xc3\xa9"], np.log([0.1, 0.2, 0.1, 0.15, 0.1, 0.1, 0.1, 0.15]))
    table = dict(zip(pieces.pieces, pieces.logp))

    def every(word):
        if not word:
            yield 0.0, []
        for n in range(1, len(word) + 1):
            if word[:n] in table:
                for p, cut in every(word[n:]):
                    yield p + table[word[:n]], [word[:n], *cut]

    words = [b"ab", b"aab", "é".encode(), b"b" * 9, b"abab" * 3]
    found = lattice.word_logp(words, pieces)
    uses = lattice.expected_pieces(words, np.ones(len(words)), pieces)
    want = Counter()
    for w, p in zip(words, found):
        all_of = list(every(b" " + w))
        total = math.log(sum(math.exp(x) for x, _ in all_of))
        assert abs(total - p) < 1e-9
        for x, cut in all_of:
            for piece in cut:
                want[piece] += math.exp(x - total)
    assert np.allclose(uses, [want[p] for p in pieces.pieces])


def test_lm_base(spark, texts):
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*lm_score.tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    for r in rows(spark, "op2_lm_score"):
        own = [*lm_score.tokens(texts[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-6


def test_lm_scores_sum_all_segmentations(spark):
    train, other = ["ab abc", "Cab ab ab", "the cat"], ["abcab the", "", "zq é"]
    docs = spark.createDataFrame([(i, t, t in other) for i, t in enumerate(train + other)], "doc_id int, text string, held_out boolean")
    start = lattice.from_sentencepiece(lm_score.VOCABULARY)
    logp = dict(zip(start.pieces, start.logp))

    def every(word, table):
        if not word:
            yield 0.0, []
        for n in range(1, len(word) + 1):
            if word[:n] in table:
                for p, cut in every(word[n:], table):
                    yield p + table[word[:n]], [word[:n], *cut]

    uses = {p: 100 * math.exp(x) for p, x in logp.items()}
    for word in " ".join(train).lower().split():
        cuts = list(every(b" " + word.encode(), logp))
        z = math.log(sum(math.exp(x) for x, _ in cuts))
        for x, cut in cuts:
            for piece in cut:
                uses[piece] += math.exp(x - z)
    whole = sum(uses.values())
    learned = {p: math.log(n / whole) for p, n in uses.items()}
    end = 3.5 / (7 + 3 + 1)
    for r in lm_score.score_documents(docs).collect():
        own = (train + other)[r.doc_id].lower().split()
        words = sum(math.log10(sum(math.exp(x) for x, _ in every(b" " + w.encode(), learned)) * (1 - end)) for w in own)
        assert abs(r.score - words - math.log10(end)) < 1e-6


def test_calibration_weighs_notices_and_the_rest():
    rng = np.random.default_rng(5)
    rest = [(np.array([4.0, 0.0, 0.0]) + rng.normal(0, 0.5, 3), 0) for _ in range(900)]
    sure = [(np.array([0.0, 6.0, 0.0]), 1)] * 30
    wrong = [(np.array([0.0, 6.0, 0.0]), 2)] * 15
    assert licences._calibrate(rest + sure)[0] == 1.0 and licences._calibrate(rest + sure + wrong)[0] > 1.5
    assert licences._calibrate(rest)[1] == 0.5 and licences._calibrate(sure) == (1.0, 0.5) and licences._calibrate([]) == (1.0, 0.5)
    false = [(np.array([0.0, 1.5, 0.0]), 0)] * 9
    assert licences._calibrate(rest + false)[1] > 0.5


def test_learned_pieces_raise_held_out_scores(spark, texts):
    from pyspark.sql import functions as F

    docs = read_table(spark, SF, "documents").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).alias("held_out"))
    flat = lattice.from_sentencepiece(lm_score.VOCABULARY)
    learned = lm_score.learn_pieces(lm_score.word_counts(docs), flat)
    held = [w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 == 1 for w in lm_score.tokens(t)]
    assert lattice.word_logp(held, learned).sum() > lattice.word_logp(held, flat).sum()


def test_packing_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(40):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 120))]
        bins, want = [], []
        for s in sorted(sizes, reverse=True):
            fits = [(left, i) for i, left in enumerate(bins) if left >= s]
            if not fits:
                bins.append(100)
                fits = [(100, len(bins) - 1)]
            i = min(fits)[1]
            bins[i] -= s
            want.append((s, i))
        runs = sharding.best_fit_decreasing(Counter(sizes).items(), 100)
        assert sorted((s, b) for s, lo, hi, b in runs for _ in range(hi - lo)) == sorted(want)


def test_shards(spark, texts):
    got = rows(spark, "op3_shards")
    sums = Counter()
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sums[r.shard] += r.size
    assert max(sums.values()) <= max(1.02 * sum(sums.values()) / 16, max(n for n in Counter(texts[r.doc_id] for r in got).values()) * max(r.size for r in got))
    by_text = defaultdict(set)
    for r in got:
        by_text[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_base_spans_equal_plain_search():
    plain = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]
    fits = [
        lambda s: True, lambda s: all(int(x) < 256 for x in s.split(".")), lambda s: 14 <= len(pii.only_digits(s)) <= 19 and pii.luhn(pii.only_digits(s)), lambda s: 10 <= len(pii.only_digits(s)) <= 15,
    ]
    rng = random.Random(1)
    parts = ["a", "@", ".", "b.c", "1", "25", "255", "4111111111111111", "-", " ", "+", "(", ")", "%", "\n", "é", "4111 1111 1111 1111", "+1 (017) 555-7713", "x@y.zz"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(plain) for m in p.finditer(text) if fits[k](m[0]))
        assert pii.base_spans(text) == want, text


def test_beliefs_by_enumeration():
    """A tree is exact, a circle close."""
    import itertools

    rng = np.random.default_rng(5)
    for keys, within in (([["=1"], [], ["=2"]], 1e-4), ([["=1"], [], ["=1"]], 0.05)):
        graph, local, chain, agree = pii.Graph([(3, keys)]), rng.normal(size=(3, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)) / 2, np.array([0.7, 0.3])
        tables = graph.tables(chain, agree)
        got = pii._shares(graph.beliefs(local, tables, 200))
        p = np.zeros((3, pii.LABELS))
        for y in itertools.product(range(pii.LABELS), repeat=3):
            linked = agree[0] * (y[0] == y[2]) if keys[0] == keys[2] else 0.0
            p[range(3), list(y)] += math.exp(sum(local[i, y[i]] for i in range(3)) + chain[y[0], y[1]] + chain[y[1], y[2]] + linked)
        assert np.abs(got - p / p.sum(1, keepdims=True)).max() < within


def test_skip_chain_labels_repeats():
    graphs = []
    for i in range(120):
        graphs += pii.training_graphs(f"call +1 (0{i % 10}7) 555-{1000 + i} or write user.{i}@mail{i}.example; card 4111111111111111; order {10 ** 20 + i}, on 2023-01-{i % 28 + 1:02d}, number {4000000 + i}")
    model = pii.SkipChain.fit(graphs)
    text = "call +1 (017) 555-1007 now; order 2023-01-15 12345678; later 555-1007 again, or 017 555 1007; ask jo.smith7, jo.smith7@x.example"
    _, spans = pii.find_spans(text, model)
    assert [(text[a:b], k) for a, k, b in spans] == [("+1 (017) 555-1007", 3), ("555-1007", 3), ("017 555 1007", 3), ("jo.smith7", 0), ("jo.smith7@x.example", 0)]
    for clean in ("nothing here 2023-01-15 and 12345678", "555-1007 alone", "jo.smith7 alone", "from 10.00 to 11.30, 1000 2000 3000 items", "1,234,567.89 and 978-3-16-148410-0"):
        assert pii.find_spans(clean, model)[1] == [], clean
    cut = "4111 1111 1111 1111 2024"
    assert [cut[a:b] for a, b in pii.other_tokens(cut, pii.base_spans(cut))] == ["4111 1111 1111 1111"]


def test_pii_query(spark, texts):
    import hashlib

    for r in rows(spark, "op4_pii"):
        base = pii.base_spans(texts[r.doc_id] or "")
        assert [r[f"n_{x}"] for x in pii.KINDS] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        own = [x for x in r.spans.split(",") if x]
        assert set(pii.joined(base).split(",")) - {""} <= set(own) and len(own) == len(base) + r.n_added


def test_licences_in_legal_prose(spark):
    """A corpus where every word of a notice is common; a wrapped notice; elsewhere, a notice of two words."""
    rng = random.Random(3)
    common = ["license", "licensed", "released", "mit", "under", "the"]
    prose = [" ".join([*(f"w{rng.randrange(5000)}" for _ in range(4)), c, *(f"w{rng.randrange(5000)}" for _ in range(4))]) + "." for c in common for _ in range(40)]
    model = licences.fit_licences(spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string"))
    assert set(common).isdisjoint(model.cues)
    notices = ["Released under the MIT License.", "Licensed under the MIT License.", "Foo.\nReleased under\nthe MIT\nLicense.\nBar"]
    got = {r.doc_id: (r.licence, r.n_licences) for r in licences.scan_licences(spark.createDataFrame(list(enumerate([*notices, *prose])), "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(3)] == [("mit", 1)] * 3 and all(got[3 + i] == (None, 0) for i in range(len(prose)))
    other = licences.fit_licences(spark.createDataFrame([(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(9)) + ".") for i in range(200)], "doc_id long, text string"))
    heading = spark.createDataFrame([(1, "Notes\n\nMIT License\n\nSome text"), (2, "Under the")], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in licences.scan_licences(heading, other).collect()} == {1: "mit", 2: None}


def test_licences(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    model = licences.fit_licences(docs)
    notices = {"mit": "Foo.\nReleased under the MIT License.\n", "apache": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "x\nLicensed under CC BY-NC 4.0.", "gpl": "This work is licensed under the GNU General Public License, version 3."}
    plain = ["He is a licensed driver of the public bus under the bridge.", "Mit und die der mit.", "The general public is free to use the work of the library.", "Version 2 of the software was released."]
    made = spark.createDataFrame([(i, t) for i, t in enumerate([*notices.values(), *plain])], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan_licences(made, model).collect()}
    assert [got[i] for i in range(4)] == list(notices) and all(got[4 + i] is None for i in range(len(plain)))
    want = {i: sum(t.count(n.strip().split("\n")[-1]) for n in notices.values()) for i, t in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()}
    assert {r.doc_id: r.n_licences for r in licences.scan_licences(docs, model).collect()} == want


def test_quality_on_held_out(spark):
    got = {r.doc_id: r for r in entries.QUERIES["op7_line_quality"](spark, "/root/testdata/sf0.01").collect()}
    truth = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(got[i].predicted, q) for i, q in truth if got[i].held_out]
    assert len(held) > 50 and sum(p == q for p, q in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    scores, chain = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
    p = np.zeros((6, 2))
    for k in range(64):
        y = [k >> i & 1 for i in range(6)]
        p[range(6), y] += math.exp(sum(scores[i, y[i]] for i in range(6)) + sum(chain[a, b] for a, b in zip(y, y[1:])))
    assert np.allclose(line_crf.marginals(scores, chain), p[:, 1] / p.sum(1))


def test_lines_of_both_kinds_in_a_document():
    """Bad documents are half prose and half junk; no line has a label of its own."""
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice("the a house river walks over under green old and speaks slowly".split()) for _ in range(12)) + "."
    junk = lambda: " ".join(rng.choice(("$$$", "BUY!!!", "###", "x|x|x", "%%%")) for _ in range(12))
    docs, texts = [], []
    for i in range(200):
        texts.append("\n".join([prose() for _ in range(6)] + [(junk if i % 2 else prose)() for _ in range(6)]))
        docs.append((*line_crf.document_features(texts[-1]), 1 - i % 2))
    field = line_crf.LineField.fit([(f, n.tolist(), y) for f, n, y in docs])
    good, bad = texts[0], texts[1]
    own = line_crf.marginals(line_crf.document_features(bad)[0] @ field.w, field.chain)
    assert own[:5].min() > 0.6 and own[7:].max() < 0.2
    assert line_crf.marginals(line_crf.document_features(good)[0] @ field.w, field.chain).min() > 0.6
    assert field.score(good) > 0.9 and field.score(bad) < 0.1
    assert field.score("\n".join([prose()] * 3 + [prose() for _ in range(250)] + [junk() for _ in range(250)])) < field.score("\n".join(prose() for _ in range(500)))


def test_subset_sums():
    rng = np.random.default_rng(4)
    for _ in range(300):
        lengths = np.unique(rng.integers(1, 40, rng.integers(1, 8)))
        counts = rng.integers(1, 6, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 3))
        take = subset_counts(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        reached, best = int((take * lengths).sum()), max(s for s in sums if s <= budget)
        assert reached == best


def test_mix(spark):
    got = entries.QUERIES["op9_mix"](spark, "/root/testdata/sf0.01").collect()
    sources = dict(duckdb.sql("SELECT doc_id, source FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        s = sources[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"])
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    want, total, free = {}, 1.5 * sum(size.values()), set(size)
    while True:
        level = (total - sum(want.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * size[s]}
        if not over:
            break
        want |= {s: 2.0 * size[s] for s in over}
        free -= over
    want |= {s: level * weights[s] for s in free}
    assert all(abs(want[s] - target[s]) < 1e-6 * want[s] for s in size)
    assert all(abs(taken[s] - target[s]) <= max(5, 0.01 * target[s]) for s in size)
    assert sorted(map(tuple, got)) == sorted(map(tuple, entries.QUERIES["op9_mix"](spark, "/root/testdata/sf0.01").collect()))


def test_pages_keep_the_article(spark):
    pages = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for i, page in pages:
        inside = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside[1].replace("<br>", " "))] if inside else []
        assert main_text(page or "") == "\n".join(x for x in blocks if x), i


def test_boilerplate_goes():
    page = """<html><body><header><h1>Site</h1></header><div id="main-menu"><a href=x>Home</a></div><div class="cookie-notice">We use cookies, accept.</div><div id="content"><h2>Title</h2>
    <p>Long paragraph text, with many words. And more of it, so that it counts.</p><p>Second <a href="q">link</a> &amp; para.</p><ul><li>item one</li></ul></div>
    <div class="comments"><p>Nice post, thanks a lot for it!</p></div><form><label>Name</label></form><script>var x = "<p>no</p>";</script><footer>c</footer></body></html>"""
    assert main_text(page) == "Title\nLong paragraph text, with many words. And more of it, so that it counts.\nSecond link & para.\nitem one"


def test_layout_words_keep_the_article():
    page = """<body class="menu"><div class="layout no-sidebar has-comments"><nav><a href=x>Home</a></nav><article><div class="post-header"><h1>Title</h1></div><p>Some text, and more.</p>
    <aside>Aside.</aside><div class="share-buttons">Share</div><section id="comments"><article class="comment"><p>A reader says a lot, at length.</p></article></section></article></div></body>"""
    assert main_text(page) == "Title\nSome text, and more."
    assert main_text("<nav><a>Menu</a></nav><div class='ad'>Buy now.</div><article></article><footer>c</footer>") == ""


def test_short_parts_stay_in_the_article():
    para = "x" * 293 + ", a, b. c."
    items, cells = [f"item number {i:08}" for i in range(10)], [str(i) for i in range(12)]
    shown = "".join(f"<li>{x}</li>" for x in items), "".join(f"<tr><td>{x}</td></tr>" for x in cells)
    page = f"<body><nav><a href=x>Home</a></nav><article>{f'<p>{para}</p>' * 10}<ul>{shown[0]}</ul><table>{shown[1]}</table><aside>Aside.</aside></article><footer>c</footer></body>"
    assert main_text(page) == "\n".join([para] * 10 + items + cells)


@pytest.mark.parametrize("body", ["<body>", ""])
def test_head_without_end_tag(body):
    page = f"<html><head><meta charset=utf-8><title>No <b>title</b></title><script>var x = '<p>no</p>';</script><style>p {{}}</style>{body}<article><p>Some text, and more.</p></article></html>"
    assert main_text(page) == "Some text, and more."
    assert main_text(page.replace("</style>", "</style></head>")) == "Some text, and more."


ARTICLE = "<article><h1>Title</h1><p>Some text, and more of it.</p></article>"
SHOWN = "Title\nSome text, and more of it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<script>if(a<b){x('</p>')}</script>" + ARTICLE, SHOWN),
        ("<style>a<b{}</style><!-- <p>no</p> -->" + ARTICLE + "<script>unclosed <p>no</p>", SHOWN),
        ("<html><head><title>x</title><meta charset=q>" + ARTICLE, SHOWN),
        ("<article><p>Long, long text, here it is. And more.</p><ul><li>a<li>b</ul><p>x y, z.</p><table><tr><td>1<td>2<tr><td>3</table><section><h2>S</h2><p>t</p></section></article>", "Long, long text, here it is. And more.\na\nb\nx y, z.\n1\n2\n3\nS\nt"),
        ('<article class="promo-feature"><p>Text, text.</p></article>', "Text, text."),
        ('<div class="article-share-wrap">' + ARTICLE + "</div><div><p>other</p></div>", SHOWN),
        ('<div class="related"><article><a href=x>Card</a></article></div>' + ARTICLE, SHOWN),
        ("<form><div>" + ARTICLE + "</div></form>", SHOWN),
        ('<article><p>One, two.</p><div class="ad-slot">Buy.</div><div class="notice-of-rights">Kept.</div><div class="comment-list"><p>Reader.</p></div></article>', "One, two.\nKept."),
        ("<div id=c><section><h2>S</h2><p>t</p></section><section><p>A long paragraph, with text. And so on.</p><ul><li><a href=x>ref</a></ul></section></div><div><a href=1>Home</a> <a href=2>Next</a></div>", "S\nt\nA long paragraph, with text. And so on.\nref"),
        ('<p title="x>y">a < b and c > d</p><p title="unclosed>z</p>', "a < b and c > d\nz"),
        ("<p>a <svg><title>q</title><svg>in</svg>x</svg> b</p><p>c <svg>unclosed</p><p>d <button>Go</button> e</p>", "a b\nc unclosed\nd e"),
    ],
)
def test_page_shapes(page, text):
    assert main_text(page) == text


def test_deep_pages_take_linear_time():
    import time

    start = time.perf_counter()
    assert main_text("<div>x" * 20_000) == "\n".join("x" * 20_000)
    for page in ("<div" * 200_000, "<div x='\"" * 100_000 + ">", "<button>x" * 100_000 + "</p>", "<svg><svg></svg>" * 50_000, "<x-a>" * 20_000 + "<dd></dd>" * 20_000):
        main_text(page)
    assert time.perf_counter() - start < 15


def test_proximity(spark):
    from quernstone.llm import decontaminate

    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon zeta eta theta iota kappa y"), (2, "alpha beta new gamma delta epsilon zeta eta theta iota kappa"), (3, "alpha " + "pad " * 40 + "beta gamma")], "doc_id long, text string")
    index = decontaminate.build_index(docs, bench)
    exact = {(r.doc_id, r.start, r["len"]) for r in decontaminate.exact_matches(index).collect()}
    assert exact == {(1, 1, 10)}
    near = {(r.doc_id, r.start) for r in decontaminate.proximity_matches(index, slop=3).collect()}
    assert (1, 1) in near and {d for d, _ in near} == {1, 2}
    got = {r.doc_id: (r.n_items, r.n_near) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (1, 1), 2: (0, 1), 3: (0, 0)}


def test_text_stats():
    words = "a b c d a b c e".split()
    assert text_stats(" ".join(words)) == (8, 8, 0, 0, 6)
    assert text_stats("x\n \nx\ny#") == (3, 4, 1, 1, 0)
    assert text_stats("") == (0, 0, 0, 0, 0)
