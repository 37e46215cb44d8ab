"""Personal data by patterns, and by a skip-chain conditional random field that carries their labels to repeated and similar tokens."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import arrow_map, guarded, read_table, sampled_docs, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: So many documents, those with the lowest hash, fit the model, as long as they have FIT_NODES tokens of the field together at most; texts are never cut.
FIT_DOCS, FIT_NODES = 3000, 60_000
#: Steps of the gradient, rounds of messages in each (which go on from those of the step before), and the weight decay.
STEPS, STEP_ROUNDS, DECAY = 250, 4, 2e-3
#: Rounds of loopy message passing at most; it stops once no message moves by TOLERANCE.
ROUNDS, TOLERANCE, DAMPING = 50, 1e-4, 0.5

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: Groups of digits, a separator or two apart.
GROUPS = re.compile(r"\(?[0-9]+\)?(?:[ .-]?\(?[0-9]+\)?)+")
TRIM = ".,;:!?\"'()[]{}<>|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each @ and so in linear time."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append((start, last := m.end()))
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every pattern match, sorted; kind indexes KINDS."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return sorted(spans)


def _card_cut(run: str) -> tuple[int, int] | None:
    """The first and longest part of a run of digit groups, groups kept whole, that is a card number."""
    groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", run)]
    for i, (start, _) in enumerate(groups):
        fits = None
        digits = ""
        for a, b in groups[i:]:
            digits += run[a:b]
            if len(digits) > 19:
                break
            if len(digits) >= 14 and luhn(digits):
                fits = (start, b)
        if fits:
            return fits
    return None


def other_tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the field may label besides the spans, which nothing of it touches, in order and apart.

    Tokens with an @ or seven digits, without punctuation at their ends; groups of 7 to 15 digits with separators, or the part of
    more that is a card number; and tokens that are the name of an address in the same text, if they are no plain word.
    """
    found: list[tuple[int, int]] = []
    if DIGIT.search(text):
        for m in GROUPS.finditer(text):
            n = len(DIGIT.findall(m[0]))
            if n >= 14 and (cut := _card_cut(m[0])):
                found.append((m.start() + cut[0], m.start() + cut[1]))
            elif 7 <= n <= 15:
                found.append(m.span())
    names = {text[a:b].partition("@")[0].casefold() for a, k, b in spans if k == 0}
    names = {x for x in names if re.search(r"[0-9._%+-]", x)}
    if names or "@" in text or DIGIT.search(text):
        for m in TOKEN.finditer(text):
            core = m[0].strip(TRIM)
            if core and ("@" in core or len(DIGIT.findall(core)) >= 7 or core.casefold() in names):
                start = m.start() + len(m[0]) - len(m[0].lstrip(TRIM))
                found.append((start, start + len(core)))
    edges, out, i, last = sorted((a, b) for a, _, b in spans), [], 0, 0
    reach = [b for _, b in edges]
    for k in range(1, len(reach)):
        reach[k] = max(reach[k], reach[k - 1])
    for start, end in sorted(set(found), key=lambda x: (x[0], -x[1])):
        while i < len(edges) and edges[i][0] < end:
            i += 1
        if start >= last and not (i and reach[i - 1] > start):
            out.append((start, end))
            last = end
    return out


FEATURES = 20


def shape(token: str) -> np.ndarray:
    """Loose features of a token; none says whether a pattern matches it."""
    d = only_digits(token)
    n, parts = len(d), token.split(".")
    local, _, domain = token.rpartition("@")
    on = [
        1, n == 0, 1 <= n < 7, 7 <= n < 10, 10 <= n <= 13, 14 <= n <= 19, n > 19, "+" in token, "(" in token, "-" in token, " " in token,
        len(parts) == 4, len(parts) == 4 and all(p.isdigit() and len(p) < 4 for p in parts), "@" in token, bool(local) and "." in domain, "." in token,
        14 <= n <= 19 and luhn(d), any(c.isalpha() for c in token), n == len(token), 7 <= n <= 15 and token[:1] in "+(0",
    ]
    return np.array(on, dtype=float)


def alike(token: str) -> list[str]:
    """Keys of a token; tokens that share one are repeated or similar: equal digits, equal last seven digits, or equal names before the @."""
    if "@" in token:
        return ["@" + token.casefold().partition("@")[0].lstrip(".")] if token.partition("@")[0] else []
    d = only_digits(token)
    if len(d) >= 7 and not any(c.isalpha() for c in token):
        return [f"={d}", *([f"~{d[-7:]}"] if 7 <= len(d) <= 15 else [])]
    return ["@" + token.casefold()] + ([f"={d}"] if len(d) >= 7 else [])


LABELS = len(KINDS) + 1


def links(keys: list[list[str]]) -> list[tuple[int, int, int]]:
    """Each token with the next one that shares a key, and what they share: 0 for equal digits or names, 1 for the last digits. A token that occurs n times takes n - 1 links."""
    last: dict[str, int] = {}
    found: dict[tuple[int, int], int] = {}
    for j, own in enumerate(keys):
        for k in own:
            if k in last:
                pair = last[k], j
                found[pair] = min(found.get(pair, 1), int(k[0] == "~"))
            last[k] = j
    return sorted((i, j, kind) for (i, j), kind in found.items())


class Graph:
    """Tokens of texts with the edges between neighbours (kind 2) and along links (0, 1), and the messages on them."""

    def __init__(self, docs: list[tuple[int, list[list[str]]]]) -> None:
        """docs: number of tokens, their keys."""
        edges, at = [], 0
        for n, keys in docs:
            edges += [(at + i, at + i + 1, 2) for i in range(n - 1)] + [(at + i, at + j, kind) for i, j, kind in links(keys)]
            at += n
        self.n, one = at, np.array(edges, dtype=int).reshape(-1, 3)
        self.src, self.dst, self.kind = np.r_[one[:, 0], one[:, 1]], np.r_[one[:, 1], one[:, 0]], np.r_[one[:, 2], one[:, 2]]
        self.half = len(one)
        self.back = np.r_[self.half:2 * self.half, :self.half]
        self.sent = np.zeros((2 * self.half, LABELS))

    def tables(self, chain: np.ndarray, agree: np.ndarray) -> np.ndarray:
        every = np.array([np.eye(LABELS) * agree[0], np.eye(LABELS) * agree[1], chain])
        out = every[self.kind]
        out[self.half:] = out[self.half:].transpose(0, 2, 1)
        return out

    def beliefs(self, local: np.ndarray, tables: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Log beliefs of the tokens after so many rounds of sum-product messages, or once none moves by TOLERANCE; exact on trees."""
        for _ in range(rounds if self.half else 0):
            belief = self._gather(local)
            inner = (belief[self.src] - self.sent[self.back])[:, :, None] + tables
            top = inner.max(1)
            new = top + np.log(np.exp(inner - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - self.sent).max()
            self.sent = DAMPING * self.sent + (1 - DAMPING) * new
            if moved < TOLERANCE:
                break
        return self._gather(local)

    def _gather(self, local: np.ndarray) -> np.ndarray:
        belief = local.copy()
        np.add.at(belief, self.dst, self.sent)
        return belief

    def pairs(self, belief: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Beliefs of the two ends of each edge together."""
        h = self.half
        z = (belief[self.src[:h]] - self.sent[h:])[:, :, None] + tables[:h] + (belief[self.dst[:h]] - self.sent[:h])[:, None, :]
        p = np.exp(z - z.max((1, 2), keepdims=True)) if h else np.zeros((0, LABELS, LABELS))
        return p / p.sum((1, 2), keepdims=True) if h else p


def _shares(belief: np.ndarray) -> np.ndarray:
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class SkipChain:
    """Weights of token shapes, of neighbouring labels, and of agreeing labels of equal and of similar tokens. Label 0 is none, k + 1 is KINDS[k]."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, agree: np.ndarray) -> None:
        self.unary, self.chain, self.agree = unary, chain, agree

    @classmethod
    def fit(cls, docs: list[tuple[list[list[float]], list[int], list[list[str]]]]) -> SkipChain:
        """All weights together by the gradient of the likelihood: beliefs with the known labels held, less beliefs without. Labels of -1 are not known.

        docs: shapes, labels, keys; see training_graphs(). Without any personal data all weights are 0.
        """
        unary, chain, agree = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(2)
        if not any(y > 0 for _, ys, _ in docs for y in ys):
            return cls(unary, chain, agree)
        x = np.array([row for xs, _, _ in docs for row in xs], dtype=float)
        y = np.array([v for _, ys, _ in docs for v in ys])
        free, held = (Graph([(len(xs), keys) for xs, _, keys in docs]) for _ in range(2))
        clamp = np.where((y[:, None] < 0) | (np.arange(LABELS) == y[:, None]), 0.0, -50.0)
        size = float(len(x))
        m1, m2 = np.zeros(FEATURES * LABELS + LABELS**2 + 2), np.zeros(FEATURES * LABELS + LABELS**2 + 2)
        for step in range(1, STEPS + 1):
            tables, local = free.tables(chain, agree), x @ unary
            got = []
            for graph, own in ((held, local + clamp), (free, local)):
                belief = graph.beliefs(own, tables, STEP_ROUNDS)
                both = graph.pairs(belief, tables)
                kind = graph.kind[:graph.half]
                same = np.einsum("eaa->e", both)
                got.append(np.r_[(x.T @ _shares(belief)).ravel(), both[kind == 2].sum(0).ravel(), same[kind == 0].sum(), same[kind == 1].sum()])
            g = (got[0] - got[1]) / size - DECAY * np.r_[unary.ravel(), chain.ravel(), agree]
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
            unary = unary + move[:FEATURES * LABELS].reshape(FEATURES, LABELS)
            chain = chain + move[FEATURES * LABELS:-2].reshape(LABELS, LABELS)
            agree = np.maximum(0.0, agree + move[-2:])  # alike tokens never repel each other
        return cls(unary, chain, agree)

    def label(self, shapes: list[np.ndarray], fixed: list[int], keys: list[list[str]]) -> list[int]:
        """The likeliest label of each token by loopy belief propagation; fixed is a label that stays, or -1."""
        local = np.array([x @ self.unary for x in shapes])
        known = np.array(fixed)[:, None]
        graph = Graph([(len(shapes), keys)])
        return graph.beliefs(local + np.where((known < 0) | (np.arange(LABELS) == known), 0.0, -50.0), graph.tables(self.chain, self.agree)).argmax(1).tolist()


def partial(kind: int, token: str) -> str | None:
    """A form of a span that no pattern matches and only its whole form elsewhere in the text explains."""
    d = only_digits(token)
    if kind == 0:
        return token.partition("@")[0]
    if kind == 2:
        return ".".join(d[i:i + 4] for i in range(0, len(d), 4))
    return f"{d[-7:-4]}-{d[-4:]}" if kind == 3 else None


def near_miss(kind: int, token: str) -> str:
    """What looks like a span and is none."""
    d = only_digits(token)
    return (token.partition(".")[0] if "@" in token.partition(".")[0] else token.partition("@")[0] + "@host", ".".join(["999", *token.split(".")[1:]]), d[:-1] + str((int(d[-1]) + 1) % 10) if d else token, d)[kind]


def training_graphs(text: str) -> list[tuple[list[list[float]], list[int], list[list[str]]]]:
    """Shapes, labels and keys of a text's tokens for the fit, and of single tokens.

    Spans have the label of their pattern; of the other tokens those that share a key with a span are left open, the rest is none.
    Every span is mentioned once more in a partial form, which has its label by its link alone: the same form by itself, like a
    near miss of the span, is none.
    """
    nodes = _nodes(text)[1]
    rows = [(text[a:b], k, alike(text[a:b])) for a, b, k in nodes]
    known = {key for _, k, keys in rows if k > 0 for key in keys}
    whole = [(shape(t).tolist(), k if k > 0 else 0 if known.isdisjoint(keys) else -1, keys) for t, k, keys in rows]
    graphs = []
    for t, k, keys in rows:
        if k > 0:
            if part := partial(k - 1, t):
                whole.append((shape(part).tolist(), k, keys[-1:]))
                graphs.append([(shape(part).tolist(), 0, [])])
            graphs.append([(shape(near_miss(k - 1, t)).tolist(), 0, [])])
    return [tuple(map(list, zip(*g))) for g in ([whole] if whole else []) + graphs]


def _nodes(text: str) -> tuple[list, list]:
    """Base spans, and all tokens of the field as (start, end, base label or -1) in order."""
    spans = base_spans(text)
    tokens = other_tokens(text, spans)
    return spans, sorted([(a, b, k + 1) for a, k, b in spans] + [(a, b, -1) for a, b in tokens])


def find_spans(text: str, model: SkipChain) -> tuple[list, list]:
    """Base spans, and all spans: those of the base and the tokens that the field labels."""
    spans, nodes = _nodes(text)
    if all(k >= 0 for _, _, k in nodes):
        return spans, spans
    cut = [text[a:b] for a, b, _ in nodes]
    found = model.label([shape(x) for x in cut], [k for _, _, k in nodes], [alike(x) for x in cut])
    return spans, sorted(spans + [(a, y - 1, b) for (a, b, k), y in zip(nodes, found) if k < 0 and y > 0])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def fit_model(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_nodes: int = FIT_NODES) -> SkipChain:
    """Fits on the tokens of the fit_docs documents with the lowest hash, as the patterns label them; the driver passes over a document with which it would have more than fit_nodes tokens, the first apart."""
    some = sampled_docs(docs, fit_docs)

    def graphs(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column("text").to_pylist():
            out.append([{"x": xs, "y": ys, "k": ks} for xs, ys, ks in training_graphs(text)])
        kind = pa.struct([("x", pa.list_(pa.list_(pa.float64()))), ("y", pa.list_(pa.int32())), ("k", pa.list_(pa.list_(pa.string())))])
        return {"graphs": pa.array(out, pa.list_(kind))}

    nested = lambda t: T.ArrayType(T.ArrayType(t))
    kind = T.ArrayType(T.StructType([T.StructField("x", nested(T.DoubleType())), T.StructField("y", T.ArrayType(T.IntegerType())), T.StructField("k", nested(T.StringType()))]))
    taken, nodes = [], 0
    for r in arrow_map(some, [T.StructField("graphs", kind)], graphs, drop=("text",)).where(F.size("graphs") > 0).orderBy("_h").toLocalIterator():
        own = sum(len(g.y) for g in r.graphs)
        if taken and nodes + own > fit_nodes:
            continue
        nodes += own
        taken += [(g.x, g.y, g.k) for g in r.graphs]
    return SkipChain.fit(taken)


@guarded
def find_pii(docs: DataFrame, model: SkipChain | None = None) -> DataFrame:
    """docs without text, with n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans, and n_added.

    A null text is empty: no spans. Repeated rows give the same each; rows with tied hashes fit the model alike.
    A token is added only where nothing of the base touches it. Columns named like a result are replaced.
    An empty table fits an empty model and gives no rows.
    """
    model = model or fit_model(docs)

    def run(batch: pa.RecordBatch) -> dict:
        base, every, counts = [], [], defaultdict(list)
        for text in batch.column("text").to_pylist():
            spans, found = find_spans(text or "", model)
            base.append(hashlib.sha256(joined(spans).encode()).hexdigest())
            every.append(joined(found))
            for i, kind in enumerate(KINDS):
                counts[f"n_{kind}"].append(sum(k == i for _, k, _ in spans))
            counts["n_added"].append(len(found) - len(spans))
        return {k: pa.array(counts[k], pa.int64()) for k in (*(f"n_{x}" for x in KINDS), "n_added")} | {"base_sha256": pa.array(base, pa.string()), "spans": pa.array(every, pa.string())}

    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in (*KINDS, "added")), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return arrow_map(docs, fields, run, drop=("text",))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    return find_pii(docs).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")
