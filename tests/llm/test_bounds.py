"""Work that used to grow out of hand, and fits that one long document used to empty."""

import random
import time

import numpy as np
import pytest

from quernstone.llm import lattice, line_crf, lm_score, near_dups, pii
from quernstone.llm.mixing import least_gap, subset_counts


@pytest.fixture(scope="module")
def pieces():
    return lattice.from_sentencepiece(lm_score.VOCABULARY)


def test_single_words_as_groups(pieces, monkeypatch):
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcdefgtheinxyz") for _ in range(rng.randrange(1, 60))) for _ in range(200)] + ["这是一个没有空格的中文段落。" .encode() * 20, b"z" * 900]
    counts = np.arange(1.0, len(words) + 1)
    monkeypatch.setattr(lattice, "BLOCK", 50)
    got = []
    for few in (0, 10**9):
        monkeypatch.setattr(lattice, "FEW", few)
        got.append((lattice.word_logp(words, pieces), lattice.expected_pieces(words, counts, pieces)))
    assert (got[0][0] == got[1][0]).all() and np.allclose(got[0][1], got[1][1], rtol=1e-9)


def test_one_long_word(pieces):
    word = bytes(random.Random(2).choice(b"abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    start = time.perf_counter()
    assert lattice.word_logp([word], pieces)[0] < -1e6
    lattice.expected_pieces([word], np.ones(1), pieces)
    assert time.perf_counter() - start < 60


def test_page_without_spaces(spark):
    page = "自然语言处理是人工智能的一个重要方向。" * 3000
    docs = spark.createDataFrame([(1, page, False), (2, "a short one", True)], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r for r in lm_score.score_documents(docs).collect()}
    assert got[1].n_tokens == 2 and got[1].score < got[2].score < 0


def test_one_length_meets_what_can_be_met():
    for lengths, counts, budget in (([1000], [400_000], 133_333_337), ([1000, 3], [10**6, 1], 333_333_333), ([700, 1000], [10**5, 10**6], 12_345_678), ([6, 10, 15], [10**6] * 3, 9_999_999)):
        start = time.perf_counter()
        taken = subset_counts(np.array(lengths), np.array(counts), budget)
        gap = budget - int((np.array(lengths) * taken).sum())
        assert (taken >= 0).all() and (taken <= counts).all() and gap == least_gap(np.array(lengths), np.array(counts), budget)
        assert time.perf_counter() - start < 1


def test_gap_is_a_bound():
    rng = random.Random(3)
    for _ in range(300):
        lengths = sorted(rng.sample(range(1, 12), rng.randrange(1, 4)))
        counts = [rng.randrange(1, 5) for _ in lengths]
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        budget = rng.randrange(max(sums) + 1)
        best = budget - max(s for s in sums if s <= budget)
        assert least_gap(np.array(lengths), np.array(counts), budget) <= best
        assert budget - int((np.array(lengths) * subset_counts(np.array(lengths), np.array(counts), budget)).sum()) == best


def test_fits_pass_over_long_documents(spark):
    good, bad = "A plain sentence of some words stands here, and it ends well.\n" * 6, "$$$ BUY NOW !!! $$$\n#### click click click ####\n" * 6
    docs = [(i, good if i % 2 else bad) for i in range(60)] + [(100 + i, good * 400) for i in range(4)]
    labels = spark.createDataFrame([(i, int(i >= 100 or i % 2)) for i, _ in docs], "doc_id long, quality int")
    field = line_crf.fit_field(spark.createDataFrame(docs, "doc_id long, text string"), labels, fit_lines=900)
    assert field.score(good) > 0.9 and field.score(bad) < 0.1
    mails = [(i, f"write to name{i}@mail{i}.example or name{i}@mail{i}.example now") for i in range(30)]
    huge = [(500, " ".join(f"a{i}@b{i}.example" for i in range(3000)))]
    model = pii.fit_model(spark.createDataFrame(mails + huge, "doc_id long, text string"), fit_nodes=400)
    assert model is not None


PARAGRAPHS = [f"Paragraph {i} of the article says something at some length, and it goes on for a while. It ends here." for i in range(6)]
P = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
READERS = "<p>Great post, I liked it a lot.</p><p>So did I, really, every word of it.</p>"


@pytest.mark.parametrize(
    ("page", "first"),
    [
        (f'<h1>Title of it</h1><div class="post comments-open">{P}</div>', "Title of it"), (f'<h1>Title of it</h1><div class="left-sidebar-layout">{P}</div>', "Title of it"),
        (f'<h1>Title of it</h1><div class="post header-image">{P}</div>', "Title of it"), (f'<div id="header-less-page">{P}</div>', None), (f'<div class="two-column-sidebar-page">{P}</div><p>Skip.</p>', None),
        (f'<div class="banner-story">{P}</div><div class="my-comments-x">{READERS}</div>', None),
        (f'<article>{P}<ol class="commentlist">{READERS}</ol></article>', None), (f'<article>{P}<div class="comment-thread">{READERS}</div></article>', None),
        (f'<article>{P}<section class="reader-comments">{READERS}</section></article>', None), (f'<article>{P}<div class="story-comments-v2">{READERS * 3}</div></article>', None),
        (f'<article>{P}<div class="sharedaddy">Share this</div><div class="google-ad">Buy.</div><div class="social-media-share">Tweet</div><div class="newsletter-promo-inline">Sign up.</div></article>', None),
        (f'<article>{P}</article><div id="secondary"><ul><li>Recent one</li></ul></div><article class="teaser"><p>Another story, in short. Read it.</p></article>', None),
        (f'<article>{P}<div hidden>Hidden words, some of them.</div><div style="display: none">More.</div></article>', None),
        (f'<article class="post has-comments">{P}<section class="related-work"></section></article>', None),
    ],
)
def test_article_stays_and_asides_go(page, first):
    from quernstone.llm.html_text import main_text

    page = f"<body><nav><a href=x>Home</a></nav>{page}<footer>c</footer></body>"
    got = main_text(page).split("\n")
    assert [x for x in got if x not in (first, "Skip.")] == PARAGRAPHS


def test_words_of_a_section_keep_its_text():
    from quernstone.llm.html_text import main_text

    page = f'<article>{P}<section class="related-work"><p>Others did so before, as we say here.</p></section><div class="search-results-table"><p>A table of it, row by row.</p></div></article>'
    assert main_text(page).split("\n") == [*PARAGRAPHS, "Others did so before, as we say here.", "A table of it, row by row."]


@pytest.mark.parametrize("by_line", [0, 256])
def test_chains_of_any_length(monkeypatch, by_line):
    monkeypatch.setattr(line_crf, "BY_LINE", by_line)
    rng = np.random.default_rng(4)
    sizes = [1, 2, 3, 17, 64, 130]
    u, chain = rng.standard_normal((len(sizes), 130, 2)) * 2, rng.standard_normal((2, 2))
    mask = np.arange(130) < np.array(sizes)[:, None]
    p, pairs = line_crf._expected(u, chain, mask)
    for k, n in enumerate(sizes):
        fore, back = u[k, :n].copy(), np.zeros((n, 2))
        for t in range(1, n):
            fore[t] += np.logaddexp(fore[t - 1, 0] + chain[0], fore[t - 1, 1] + chain[1])
        for t in range(n - 2, -1, -1):
            nxt = back[t + 1] + u[k, t + 1]
            back[t] = np.logaddexp(nxt[0] + chain[:, 0], nxt[1] + chain[:, 1])
        z = np.logaddexp(*fore[-1])
        assert np.allclose(p[k, :n], np.exp(fore + back - z)) and not p[k, n:].any()
        assert np.allclose(p[k, :n, 1], line_crf.marginals(u[k, :n], chain))
        both = sum((np.exp(fore[t, :, None] + chain + (u[k, t + 1] + back[t + 1])[None, :] - z) for t in range(n - 1)), np.zeros((2, 2)))
        assert np.allclose(pairs[k], both)


def test_a_lone_odd_line_is_smoothed():
    rng = random.Random(5)
    good, bad = "Here is a plain line of some length, as prose goes.", "$$$ BUY now !!! %%% click"
    docs = []
    for i in range(80):
        lines = [rng.choice([good, good, good, bad]) if i % 2 else rng.choice([bad, bad, bad, good]) for _ in range(12)]
        features, n = line_crf.document_features("\n".join(lines))
        docs.append((features, n.tolist(), i % 2))
    field = line_crf.LineField.fit(docs)
    assert abs(field.chain).max() > 0.05
    pulled = field.w.copy()
    alone = line_crf.LineField(pulled, np.zeros((2, 2)), 0.0, 1.0)
    features, n = line_crf.document_features("\n".join([good] * 5 + [bad] + [good] * 5))
    with_chain = line_crf.marginals(features @ field.w, np.array([[1.5, -1.5], [-1.5, 1.5]]))[5]
    assert with_chain > line_crf.marginals(features @ alone.w, alone.chain)[5]


def test_arguments_name_odd_columns(spark):
    from quernstone.llm import host_rules, mixing, sharding

    docs = spark.createDataFrame([(1, "a b c", "x", "x"), (2, "d e f g", "y", "y")], "doc_id long, _t string, _host string, _s string")
    assert {r.shard for r in sharding.shard_texts(docs, 2, text="_t").collect()} <= {0, 1}
    judged = host_rules.judge(docs.withColumnRenamed("_t", "text"), host="_host").collect()
    assert len(judged) == 2 and {r._host for r in judged} == {"x", "y"}
    mixed = mixing.mix(docs.withColumn("text", docs["_t"]), mixing.word_count(), source="_s").collect()
    assert {r._s for r in mixed} == {"x", "y"} and sum(r.copies for r in mixed) > 0


def test_near_dups_take_few_steps(spark, monkeypatch):
    """Chains of near copies, in which no text is like both ends: few tables are written, and every link is found."""
    words = [f"w{i}" for i in range(4000)]
    rows = [(100 * c + i, " ".join(words[300 * c + 6 * i:300 * c + 6 * i + 120])) for c in range(6) for i in range(25)]
    names, made = [], near_dups.materialize
    monkeypatch.setattr(near_dups, "materialize", lambda df, name: names.append(name) or made(df, name))
    got = {r.doc_id: r.class_id for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 100 * (i // 100) for i, _ in rows}
    assert len([x for x in names if x == "near-links"]) == 2 and len(names) <= 30
