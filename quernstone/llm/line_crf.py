"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import SPACES, arrow_map, crc_rest, guarded, lowest, read_table, text_or_empty

#: So many labels, those with the lowest hash of doc_id, fit the model, but for documents with which they would have more than FIT_LINES lines together; texts are never cut.
FIT_DOCS, FIT_LINES = 3000, 300_000
#: Chains of so many lines are followed line by line; for longer ones blocks of lines take fewer steps, with the same sums.
BY_LINE = 256
#: Lines of the chains that the fit takes together, padded to one length; a longer chain is taken alone, and whole.
TOGETHER = 50_000
#: What a document's label says of the length-weighted share of its good lines: at least, and at most.
GOOD_SHARE, BAD_SHARE = 0.9, 0.5
THRESHOLD = 0.7
#: Characters of a line whose share of it says something.
MARKS = "#*$%&|<>=_~^{}[]\\/@+"
#: Steps of the gradient while every line has its document's label, then in each round of expectation maximisation.
STEPS, ROUNDS, ROUND_STEPS = 100, 4, 25
#: Half the interval of a line's log odds in which the tilt towards its document's label is looked for, and how often it is halved.
TILT, HALVINGS = 12.0, 9


def line_features(line: str) -> list[float]:
    """Features of one line by itself."""
    n = len(line)
    words = line.split()
    k = len(words)
    if not k:
        return [1.0] + [0.0] * 15
    shown = n - line.count(" ")
    unique = len(set(words))
    upper = sum(map(str.isupper, words))
    marks = sum(map(line.count, MARKS))
    last = line.rstrip(SPACES)[-1:]
    repeats = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        1.0, 1.0, math.log1p(k) / 5, unique / k, upper / k, marks / shown, min(3.0, marks / k), (line.count("!") + line.count("?")) / k, repeats / k,
        1 - pairs / max(1, k - 1) if k > 1 else 0.0, shown / k / 10, float(last in ".!?\"…"), float(k < 4), sum(map(line.count, "0123456789")) / shown, (line.count(".") + line.count(",")) / k, float(line[:1].islower()),
    ]


FEATURES = 16


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line with a word, with the means of its neighbours and whether the same line came before; and the lines' lengths."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)] or [""]
    own = np.array([line_features(x) for x in lines])
    seen: set[str] = set()
    again = np.array([[float(x in seen or seen.add(x) is not None)] for x in lines])
    before = np.vstack([np.zeros((1, FEATURES)), own[:-1]])
    after = np.vstack([own[1:], np.zeros((1, FEATURES))])
    return np.hstack([own, (before + after) / 2, again]), np.array([len(x) or 1 for x in lines], dtype=float)


WIDTH = 2 * FEATURES + 1


def marginals(scores: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Probability that each line is good, by forward and backward recursion in log space. scores: lines by (bad, good)."""
    n = len(scores)
    if n == 1:
        return 1 / (1 + np.exp(scores[:, 0] - scores[:, 1]))
    # Only log odds matter: a, b are the odds of good over bad that reach a line from before and after it.
    (t00, t01), (t10, t11) = np.exp(chain).tolist()
    odds = (scores[:, 1] - scores[:, 0]).clip(-50, 50).tolist()
    fore, back = [0.0] * n, [0.0] * n
    for i in range(1, n):
        r = math.exp(fore[i - 1] + odds[i - 1])
        fore[i] = math.log((t01 + t11 * r) / (t00 + t10 * r))
    for i in range(n - 2, -1, -1):
        r = math.exp(back[i + 1] + odds[i + 1])
        back[i] = math.log((t10 + t11 * r) / (t00 + t01 * r))
    return 1 / (1 + np.exp(-(np.array(fore) + np.array(odds) + np.array(back))))


class LineField:
    """w: features by (bad, good); chain: weights of neighbouring labels; a, b: calibration of a document's mean marginal."""

    def __init__(self, w: np.ndarray, chain: np.ndarray, a: float, b: float) -> None:
        self.w, self.chain, self.a, self.b = w, chain, a, b

    def mean_marginal(self, features: np.ndarray, lengths: np.ndarray) -> float:
        return float((marginals(features @ self.w, self.chain) * lengths).sum() / lengths.sum())

    def score(self, text: str) -> float:
        mean = self.mean_marginal(*document_features(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a + self.b * _logit(mean)))))

    @classmethod
    def fit(cls, docs: list[tuple[np.ndarray, list[float], int]]) -> LineField:
        """Maximum conditional likelihood where the lines' labels are hidden, both document labels weighing the same; then Platt's calibration on the documents.

        At first every line has its document's label, and neighbours say nothing, as they never differ. Then, in each round, lines take their marginals under the model, tilted
        no more than it takes to give a good document a length-weighted share of good lines of GOOD_SHARE, and a bad one
        BAD_SHARE at most (posterior regularisation); the model moves towards those. So a document of both kinds of lines
        keeps both. With one label or no rows the model is flat, and scores are the label's smoothed share.
        """
        good = sum(y for _, _, y in docs)
        if not 0 < good < len(docs):
            p = (good + 1) / (len(docs) + 2)
            return cls(np.zeros((WIDTH, 2)), np.zeros((2, 2)), _logit(p), 0.0)
        weight = {0: 0.5 / (len(docs) - good), 1: 0.5 / good}
        y = np.array([d[2] for d in docs])
        groups = _chains(docs, weight)
        w, chain = np.zeros((WIDTH, 2)), np.zeros((2, 2))
        m1, m2 = np.zeros(2 * WIDTH + 4), np.zeros(2 * WIDTH + 4)
        step = 0
        for turn in range(ROUNDS + 1):
            tilts = np.where(y == 1, 1e3, -1e3) if not turn else _tilts(w, chain, groups, y)
            # what the hidden labels say: fixed while the model moves
            goals = [_counts(x, *_expected(x @ w, chain, mask, tilts[doc][:, None] * share), scale) for x, mask, doc, share, scale in groups]
            for _ in range(ROUND_STEPS if turn else STEPS):
                step += 1
                g = sum(_counts(x, *_expected(x @ w, chain, mask), scale) - goal for (x, mask, _, _, scale), goal in zip(groups, goals))
                g[:2 * WIDTH] += 1e-4 * w.ravel()
                g[2 * WIDTH:] = g[2 * WIDTH:] + 1e-3 * chain.ravel() if turn else 0.0
                m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
                move = 0.08 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
                w, chain = w - move[:2 * WIDTH].reshape(WIDTH, 2), chain - move[2 * WIDTH:].reshape(2, 2)
        field = cls(w, chain, 0.0, 1.0)
        x = np.array([_logit(field.mean_marginal(np.array(f), np.array(n))) for f, n, _ in docs])
        # Platt's targets keep the calibration finite when the labels can be told apart
        target = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(docs) - good + 2))
        ab = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(ab[0] + ab[1] * x)))
            s = np.maximum(p * (1 - p), 1e-6)
            h = np.array([[s.sum(), (s * x).sum()], [(s * x).sum(), (s * x * x).sum()]]) + 1e-3 * np.eye(2)
            ab = ab - np.linalg.solve(h, np.array([(p - target).sum(), ((p - target) * x).sum()]) + 1e-3 * ab)
        return cls(w, chain, float(ab[0]), float(ab[1]))


def _logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def _chains(docs: list, weight: dict[int, float]) -> list[tuple[np.ndarray, ...]]:
    """Groups of chains of about one length, each a whole text: features, mask, document, a line's length by its document's mean, and a line's weight. A document counts once, however many lines it has."""
    order = sorted(range(len(docs)), key=lambda i: (len(docs[i][0]), i))
    groups, start = [], 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end + 1 - start) * len(docs[order[end]][0]) <= TOGETHER:
            end += 1
        own, longest = order[start:end], len(docs[order[end - 1]][0])
        x, mask, share = np.zeros((len(own), longest, WIDTH)), np.zeros((len(own), longest), bool), np.zeros((len(own), longest))
        for k, i in enumerate(own):
            f, n, _ = docs[i]
            x[k, :len(f)], mask[k, :len(f)], share[k, :len(f)] = f, True, np.array(n) / (sum(n) / len(n))
        groups.append((x, mask, np.array(own), share, np.array([weight[docs[i][2]] / len(docs[i][0]) for i in own])))
        start = end
    return groups


def _through(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Log of sums over the first of the last two axes of m, from what a says of it."""
    return np.logaddexp(a[..., 0, None] + m[..., 0, :], a[..., 1, None] + m[..., 1, :])


def _messages(u: np.ndarray, chain: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of padded chains, line by line or, if these are long, by blocks."""
    n, longest, _ = u.shape
    if longest > BY_LINE:
        return _by_blocks(u, chain, mask)
    fore, back = np.zeros((2, n, longest, 2))
    fore[:, 0] = u[:, 0]
    for t in range(1, longest):
        fore[:, t] = np.where(mask[:, t, None], _through(fore[:, t - 1], chain) + u[:, t], fore[:, t - 1])
    for t in range(longest - 2, -1, -1):
        back[:, t] = np.where(mask[:, t + 1, None], _through(back[:, t + 1] + u[:, t + 1], chain.T), 0.0)
    return fore, back


def _by_blocks(u: np.ndarray, chain: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_messages() of long chains.

    Lines are dealt into blocks of about the root of their number: first all blocks at once, line by line, for either label on the far side of
    their edge; then block by block. So a chain of any length takes steps in proportion to the root of it.
    """
    n, longest, _ = u.shape
    size = max(1, math.isqrt(longest))
    blocks = -(-longest // size)
    pad = ((0, 0), (0, blocks * size - longest))
    u, mask = np.pad(u, (*pad, (0, 0))).reshape(n, blocks, size, 2), np.pad(mask, pad).reshape(n, blocks, size)
    with np.errstate(divide="ignore"):
        same = np.log(np.eye(2))
    fore, back = np.empty((2, n, blocks, size, 2, 2))
    at = np.broadcast_to(same, (n, blocks, 2, 2))
    for t in range(size):
        step = _through(at, chain) + u[:, :, t, None, :]
        if not t:
            step[:, 0] = u[:, 0, 0, None, :]  # nothing stands before the first line
        at = fore[:, :, t] = np.where(mask[:, :, t, None, None], step, at)
    at = back[:, :, -1] = np.broadcast_to(same, (n, blocks, 2, 2))
    for t in range(size - 2, -1, -1):
        step = np.logaddexp((chain[:, 0] + u[:, :, t + 1, 0, None])[..., None] + at[:, :, 0, None, :], (chain[:, 1] + u[:, :, t + 1, 1, None])[..., None] + at[:, :, 1, None, :])
        at = back[:, :, t] = np.where(mask[:, :, t + 1, None, None], step, at)
    into, out = np.zeros((2, n, blocks, 2))
    into[:, 0] = [0.0, -np.inf]
    for k in range(1, blocks):
        into[:, k] = _through(into[:, k - 1], fore[:, k - 1, -1])
    for k in range(blocks - 2, -1, -1):
        nxt = np.logaddexp(back[:, k + 1, 0, :, 0] + out[:, k + 1, None, 0], back[:, k + 1, 0, :, 1] + out[:, k + 1, None, 1]) + u[:, k + 1, 0]
        out[:, k] = np.where(mask[:, k + 1, 0, None], np.logaddexp(nxt[:, 0, None] + chain[:, 0], nxt[:, 1, None] + chain[:, 1]), 0.0)
    forward = _through(into[:, :, None, :], fore)
    backward = np.logaddexp(back[..., 0] + out[:, :, None, 0, None], back[..., 1] + out[:, :, None, 1, None])
    return forward.reshape(n, -1, 2)[:, :longest], backward.reshape(n, -1, 2)[:, :longest]


def _expected(u: np.ndarray, chain: np.ndarray, mask: np.ndarray, tilt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of lines (chains, lines, label) and of neighbours (chains, label, label, summed) of padded chains; tilt is added to the log odds of good."""
    u = u * mask[:, :, None]
    if tilt is not None:
        u[:, :, 1] += tilt * mask
    fore, back = _messages(u, chain, mask)
    z = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
    p = np.exp(fore + back - z[:, None, None]) * mask[:, :, None]
    pairs = np.zeros((len(u), 2, 2))
    if u.shape[1] > 1:
        joint = np.exp(fore[:, :-1, :, None] + chain + (u + back)[:, 1:, None, :] - z[:, None, None, None])
        pairs = (joint * mask[:, 1:, None, None]).sum(1)
    return p, pairs


def _counts(x: np.ndarray, p: np.ndarray, pairs: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Expected features by label, and neighbouring labels, weighed."""
    return np.r_[np.einsum("ntf,ntk->fk", x, p * scale[:, None, None]).ravel(), (pairs * scale[:, None, None]).sum(0).ravel()]


def _tilts(w: np.ndarray, chain: np.ndarray, groups: list, y: np.ndarray) -> np.ndarray:
    """The least tilt of each document with which its share of good lines is what its label says, by bisection."""
    scores = [x @ w for x, *_ in groups]

    def shares(tilt: np.ndarray) -> np.ndarray:
        top, below = np.zeros(len(y)), np.zeros(len(y))
        for u, (_, mask, doc, share, _) in zip(scores, groups):
            p = _expected(u, chain, mask, tilt[doc][:, None] * share)[0]
            np.add.at(top, doc, (p[:, :, 1] * share).sum(1))
            np.add.at(below, doc, share.sum(1))
        return top / below

    meets = lambda s: np.where(y == 1, s >= GOOD_SHARE, s <= BAD_SHARE)
    low, high = np.zeros(len(y)), np.where(y == 1, TILT, -TILT)
    high = np.where(meets(shares(low)), 0.0, high)
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        fine = meets(shares(middle))
        low, high = np.where(fine, low, middle), np.where(fine, middle, high)
    return high


def fit_field(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES) -> LineField:
    """docs: doc_id, text. labels: doc_id, quality, of which the fit_docs with the lowest hash of doc_id are used.

    Labels other than 0 and 1, and labels without a document, don't count. The driver gets features of whole texts, never
    texts, in the order of the hash, and passes over a document with which they would have more than fit_lines lines; the
    first is always taken.
    """
    chosen = lowest(labels.select("doc_id", "quality").where("quality in (0, 1)"), F.xxhash64("doc_id", "quality"), fit_docs)
    some = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # fit_docs rows at most

    def features(batch: pa.RecordBatch) -> dict:
        made = [document_features(x) for x in batch.column("text").to_pylist()]
        return {"f": pa.array([zlib.compress(f.astype("<f4").tobytes(), 1) for f, _ in made], pa.binary()), "n": pa.array([n.tolist() for _, n in made], pa.list_(pa.float64()))}

    rows = arrow_map(some, [T.StructField("f", T.BinaryType()), T.StructField("n", T.ArrayType(T.DoubleType()))], features, drop=("text",))
    taken, lines = [], 0
    for r in rows.orderBy(F.xxhash64("doc_id"), F.col("doc_id").cast("string"), F.size("n"), "quality").toLocalIterator():
        if taken and lines + len(r.n) > fit_lines:
            continue
        lines += len(r.n)
        taken.append((np.frombuffer(zlib.decompress(r.f), "<f4").reshape(-1, WIDTH).astype(float), list(r.n), r.quality))
    return LineField.fit(taken)


@guarded
def score_quality(docs: DataFrame, field: LineField) -> DataFrame:
    """docs without text, with score (0 to 1). A null or empty text is one empty line. Repeated rows give the same. A column named score is replaced."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"score": pa.array([field.score(x or "") for x in batch.column("text").to_pylist()], pa.float64())}

    return arrow_map(docs, [T.StructField("score", T.DoubleType())], run, drop=("text",))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels come only from rows whose crc32(doc_id) mod 4 is not 2."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_rest("doc_id", 4) != 2)
    scored = score_quality(docs, fit_field(docs, labels))
    return scored.select("doc_id", (crc_rest("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
