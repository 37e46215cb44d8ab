"""Probability of words summed over all their segmentations into pieces of an existing vocabulary."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from math import exp, inf, log1p

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_SLOTS = 20
NONE = -1
#: Words of about one length that are worth taking together, position by position; fewer, as long words are, go one at a time, all positions of a block together.
FEW, BLOCK = 48, 1 << 16


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.full(n, _P, np.uint64)
    p[0] = 1
    q = np.full(n, pow(_P, -1, 2**64), np.uint64)
    q[0] = 1
    return np.cumprod(p), np.cumprod(q)


_BYTES = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)


class Pieces:
    """Pieces (bytes; a leading space marks the start of a word) with natural log probabilities; every byte is a piece."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray) -> None:
        self.pieces, self.logp = pieces, np.asarray(logp, dtype=float)
        self.lengths = sorted({len(p) for p in pieces})
        power, _ = _powers(max(self.lengths))
        own = np.array([int((_BYTES[np.frombuffer(p, np.uint8)] * power[:len(p)]).sum(dtype=np.uint64)) for p in pieces], dtype=np.uint64)
        # A flag for each slot says whether any piece has it; two direct tables then tell which. Pieces whose slot in
        # the first is taken go to the second, where none collide.
        for seed in range(1, 1000):
            self.mix = [np.uint64((0xD6E8FEB86659FD93 * (2 * seed + k) | 1) % 2**64) for k in (0, 1)]
            self.flag = np.zeros(2**_SLOTS, np.uint8)
            self.key = [np.zeros(2**_SLOTS, np.uint64) for _ in (0, 1)]
            self.id = [np.full(2**_SLOTS, NONE, np.int32) for _ in (0, 1)]
            if self._fill((own * self.mix[0]).tolist()):
                return
        raise ValueError("the pieces can't be hashed apart")

    def _fill(self, own: list[int]) -> bool:
        for i, h in enumerate(own):
            for k, slot in enumerate((h >> (64 - _SLOTS), (h * int(self.mix[1]) % 2**64) >> (64 - _SLOTS))):
                if self.id[k][slot] == NONE:
                    self.key[k][slot], self.id[k][slot] = h, i
                    self.flag[h >> (64 - _SLOTS)] = 1
                    break
                if self.key[k][slot] == h:
                    return False
            else:
                return False
        return True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where h, a hash times mix[0], is a piece's; and which piece's."""
        slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int32)
        some = np.flatnonzero(self.flag[slot])
        h, slot = h[some], slot[some]
        out = np.where(self.key[0][slot] == h, self.id[0][slot], NONE)
        if len(rest := np.flatnonzero(out == NONE)):
            other = h[rest]
            slot = (other * self.mix[1] >> np.uint64(64 - _SLOTS)).astype(np.int32)
            out[rest] = np.where(self.key[1][slot] == other, self.id[1][slot], NONE)
            keep = np.flatnonzero(out >= 0)
            some, out = some[keep], out[keep]
        return some, out

    def with_logp(self, logp: np.ndarray) -> Pieces:
        other = object.__new__(Pieces)
        other.__dict__.update(self.__dict__, logp=np.asarray(logp, dtype=float))
        return other


def from_sentencepiece(path: str) -> Pieces:
    """Vocabulary of a file; its scores are ranks of merges, taken as the ranks of Zipf's law. Bytes come last."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = {}
    for i in range(model.vocab_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.get_score(i) < -1e8):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:] and piece:
                ranked[piece] = max(ranked.get(piece, -1e9), model.get_score(i))
    last = min(ranked.values()) - 1
    for b in range(256):
        ranked.setdefault(bytes([b]), last)
    pieces = sorted(ranked, key=lambda p: (-ranked[p], p))
    weight = np.array([1 / (2.7 - ranked[p]) for p in pieces])
    return Pieces(pieces, np.log(weight / weight.sum()))


def _chunks(words: list[bytes]):
    """Indices of words of about one length, and their bytes after a space, padded to one length."""
    flat = np.frombuffer(b"".join(words) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    ranked, at = sizes[order], 0
    while at < len(order):
        limit = max(8, int(ranked[at]) * 5 // 4)
        end = min(int(np.searchsorted(ranked, limit, "right")), at + max(1, 200_000 // (limit + 1)))
        some = order[at:end]
        column = np.arange(int(ranked[end - 1]))
        grid = np.full((len(some), len(column) + 1), 32, np.uint8)
        grid[:, 1:] = np.where(column < sizes[some, None], flat[np.minimum(starts[some, None] + column, len(flat) - 1)], 0)
        yield some, grid, sizes[some] + 1
        at = end


def _edges(pieces: Pieces, grid: np.ndarray):
    """(end, length, words that have a piece there, their pieces) for every span of a piece's length."""
    n, width = grid.shape
    power, inverse = _powers(width)
    inverse = inverse * pieces.mix[0]
    prefix = np.zeros((width + 1, n), np.uint64)
    np.cumsum((_BYTES[grid] * power).T, axis=0, dtype=np.uint64, out=prefix[1:])
    for end in range(1, width + 1):
        for length in pieces.lengths:
            if length > end:
                break
            yield end, length, *pieces.find((prefix[end] - prefix[end - length]) * inverse[end - length])


def _forward(pieces: Pieces, grid: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Log of the summed probability of all segmentations of each prefix of each word."""
    n, width = grid.shape
    alpha = np.full((width + 1, n), -np.inf)
    alpha[0] = 0.0
    for end, length, some, ids in _edges(pieces, grid):
        if len(some):
            alpha[end, some] = np.logaddexp(alpha[end, some], alpha[end - length, some] + pieces.logp[ids])
            if keep is not None:
                keep.append((end, length, some, ids))
    return alpha


class _Single:
    """The lattice of one word, of any length: edges are found a block of positions at a time and never held for the whole word."""

    def __init__(self, pieces: Pieces, grid: np.ndarray) -> None:
        self.pieces, self.width = pieces, len(grid)
        power, inverse = _powers(self.width)
        self.inverse = inverse * pieces.mix[0]
        self.prefix = np.zeros(self.width + 1, np.uint64)
        np.cumsum(_BYTES[grid] * power, dtype=np.uint64, out=self.prefix[1:])
        self.starts = range(1, self.width + 1, BLOCK)

    def edges(self, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends, lengths and pieces of the edges that end in a block, by end, then length."""
        ends, found = np.arange(start, min(start + BLOCK, self.width + 1)), []
        for length in self.pieces.lengths:
            own = ends[ends >= length]
            at, ids = self.pieces.find((self.prefix[own] - self.prefix[own - length]) * self.inverse[own - length])
            found.append((own[at], np.full(len(at), length), ids))
        end, size, ids = map(np.concatenate, zip(*found))
        order = np.argsort(end, kind="stable")
        return end[order], size[order], ids[order]

    def forward(self) -> np.ndarray:
        """As a column of _forward()."""
        alpha = array("d", [0.0]) + array("d", [-inf]) * self.width
        for start in self.starts:
            end, size, ids = self.edges(start)
            for e, s, lp in zip(end.tolist(), (end - size).tolist(), self.pieces.logp[ids].tolist()):
                alpha[e] = _either(alpha[e], alpha[s] + lp)
        return np.array(alpha)

    def uses(self, weight: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces and their expected uses, weighed, block after block from the end."""
        alpha = self.forward()
        beta = array("d", [-inf]) * self.width + array("d", [0.0])
        for start in reversed(self.starts):
            end, size, ids = self.edges(start)
            for e, s, lp in zip(end[::-1].tolist(), (end - size)[::-1].tolist(), self.pieces.logp[ids][::-1].tolist()):
                beta[s] = _either(beta[s], lp + beta[e])
            through = np.array(beta[start : start + BLOCK])[end - start] + self.pieces.logp[ids]
            yield ids, np.exp(alpha[end - size] + through - alpha[-1]) * weight


def _either(a: float, b: float) -> float:
    """Log of the sum of two probabilities by their logs."""
    d = b - a
    return b if a == -inf else b + log1p(exp(-d)) if d > 0 else a + log1p(exp(d))


def word_logp(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Natural log of each word's probability, marginal over its segmentations."""
    out = np.zeros(len(words))
    for some, grid, sizes in _chunks(words):
        if len(some) < FEW:
            out[some] = [_Single(pieces, row[:n]).forward()[-1] for row, n in zip(grid, sizes)]
        else:
            out[some] = _forward(pieces, grid)[sizes, np.arange(len(some))]
    return out


def expected_pieces(words: list[bytes], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected number of uses of each piece over the words, each counted so often, by forward and backward recursion."""
    total = np.zeros(len(pieces.pieces))
    for some, grid, sizes in _chunks(words):
        if len(some) < FEW:
            for row, n, weight in zip(grid, sizes, counts[some]):
                for ids, use in _Single(pieces, row[:n]).uses(weight):
                    total += np.bincount(ids, use, len(total))
            continue
        edges: list = []
        alpha = _forward(pieces, grid, edges)
        rows = np.arange(len(some))
        z = alpha[sizes, rows]
        beta = np.full_like(alpha, -np.inf)
        beta[sizes, rows] = 0.0
        weight = counts[some]
        for end, length, own, ids in reversed(edges):
            through = pieces.logp[ids] + beta[end, own]
            use = np.exp(alpha[end - length, own] + through - z[own]) * weight[own]
            total += np.bincount(ids, use, len(total))
            beta[end - length, own] = np.logaddexp(beta[end - length, own], through)
    return total
