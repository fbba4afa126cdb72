"""Words, word hashes and shingles of many texts at once, with numpy over one byte buffer.

Texts are UTF-8, so a class of ASCII separators can be told byte by byte. Buffers are cut at ``CHUNK`` bytes
(a longer text is a buffer of its own), which bounds the memory of a task by its longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

CHUNK = 500_000
#: Rows of a column that are Python strings at a time.
ROWS = 256
#: What gives freed memory back, where the C library has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Any odd multiplier has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of the class [\x20\x09-\x0D], and of the class [\x00-\x2F\x3A-\x60\x7B-\x7F].
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + CHUNK // 4)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE, np.uint64)]))
            _powers["down"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, INVERSE, np.uint64)]))
    return _powers["up"], _powers["down"]


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        z = z ^ (z >> np.uint64(30))
        z = z * np.uint64(0xBF58476D1CE4E5B9)
        z = z ^ (z >> np.uint64(27))
        z = z * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def give_back() -> None:
    """Hands memory that a task has freed back to the machine, as its Python worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def chunks(texts: list[str | None] | pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts as bytes); nulls are empty. A column is read some rows at a time."""
    first, held, size = 0, [], 0
    rows = texts if isinstance(texts, list) else chain.from_iterable(texts.slice(a, ROWS).to_pylist() for a in range(0, len(texts), ROWS))
    for i, text in enumerate(rows):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


class Words:
    """The words of some texts: where they are, whose they are, and a 64-bit hash of each."""

    def __init__(self, raws: list[bytes], separators: np.ndarray):
        lens = np.fromiter(map(len, raws), np.int64, len(raws))
        self.buf = LOWER[np.frombuffer(b" ".join(raws) + b" ", np.uint8)]
        self.text_at = np.concatenate([[0], np.cumsum(lens + 1)])
        gap = separators[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap])))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_at)  # words of text i: first[i] to first[i + 1]
        self.n = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        up, down = _power_tables(len(self.buf) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)])])
            raw = (total[self.end] - total[self.start]) * down[self.start]
            return mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive items."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:m].copy()
        for j in range(1, k):
            out = out * np.uint64(BASE) + h[j : j + m]
        return mix(out + np.uint64(k))


def shingle_sets(raws: list[bytes], k: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its k-word shingles; of fewer words, the whole sequence as one."""
    words = Words(raws, WHITE)
    h = words.hashes()
    grams = combine(h, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(combine(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
