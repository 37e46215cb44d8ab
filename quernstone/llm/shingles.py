"""Five-word shingles of texts, hashed a chunk of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text hashed together; a longer text is a chunk by itself.
CHUNK = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2**64."""
    size = 1 << max(CHUNK.bit_length(), n.bit_length())
    if size not in _tables:
        _tables.clear()
        p, q = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 2**64), np.uint64)
        p[0] = q[0] = 1
        _tables[size] = np.cumprod(p), np.cumprod(q)
    return _tables[size]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    return h ^ (h >> np.uint64(29))


def normal(text: str | None) -> bytes:
    """Words between ASCII white space, A-Z in lower case, one space apart."""
    return b" ".join((text or "").encode().lower().split())


def _chunk(texts: list[bytes]) -> list[np.ndarray]:
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    power, inverse = _powers(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTES[buffer] * power[:len(buffer)], dtype=np.uint64, out=sums[1:])
    ends = np.flatnonzero((buffer == 32) | (buffer == 10))
    starts = np.r_[0, ends[:-1] + 1]
    words = mixed((sums[ends] - sums[starts]) * inverse[starts])
    last = np.flatnonzero(buffer[ends] == 10) + 1
    whole = words[:max(0, len(words) - WORDS + 1)] * _MIX[0]
    for j in range(1, WORDS):
        whole = whole + words[j:j + len(whole)] * _MIX[j]
    whole = mixed(whole)
    out, at = [], 0
    for end in last.tolist():
        if end - at >= WORDS:
            out.append(whole[at:end - WORDS + 1])
        else:  # a shorter text is one shingle
            out.append(mixed((words[at:end] * _MIX[:end - at]).sum(dtype=np.uint64, keepdims=True) + np.uint64(end - at)))
        at = end
    return out


def shingles(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Shingle hashes of each normal text in order, repeated as they occur; a text without words has none."""
    chunk: list[bytes] = []
    size = 0

    def done():
        found = iter(_chunk([x for x in chunk if x]) if any(chunk) else [])
        for x in chunk:
            yield next(found) if x else np.zeros(0, np.uint64)

    for text in texts:
        if chunk and size + len(text) > CHUNK:
            yield from done()
            chunk, size = [], 0
        chunk.append(text)
        size += len(text) + 1
    yield from done()
