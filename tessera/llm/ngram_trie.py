"""A compact n-gram trie with quantised smoothed probabilities.

The n-grams of one part of all contexts make two levels: the contexts in order, and the words behind each, in order
too, so the words behind a context are one range of the next level. The starts of these ranges grow from node to node:
they are kept in Elias-Fano form (low bits in full, high bits in unary with a directory of counts). A word is found by a
successor search that starts at its context's range. All levels are flat arrays in one block of bytes that is mapped
from a file.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

STEP = 1 / 3000  # of log10
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
_NTH = np.array([[([j for j in range(8) if i >> j & 1] + [8] * 8)[n] for n in range(8)] for i in range(256)], np.int64)


class Monotone:
    """A non-decreasing sequence in Elias-Fano form: access to many places at once."""

    @staticmethod
    def pack(values: np.ndarray) -> dict[str, np.ndarray]:
        n, top = len(values), int(values[-1]) + 1
        low = max(int(np.log2(max(top // max(n, 1), 1))), 0)
        high = (values >> low) + np.arange(n)
        bits = np.zeros((int(high[-1]) // 8 + 1) * 8, np.uint8)
        bits[high] = 1
        unary = np.packbits(bits, bitorder="little")
        lows = np.zeros((n * low + 7) // 8 * 8 + 64, np.uint8)
        for b in range(low):
            lows[np.arange(n) * low + b] = values >> b & 1
        counts = np.concatenate(([0], np.cumsum(_ONES[unary]))).astype(np.uint32)
        return {"low": np.array([low], np.int64), "lows": np.packbits(lows, bitorder="little"), "unary": unary, "counts": counts[::8].copy()}

    def __init__(self, low: np.ndarray, lows: np.ndarray, unary: np.ndarray, counts: np.ndarray) -> None:
        self.low, self.lows, self.unary, self.counts = int(low[0]), lows, unary, counts

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at places i: select in the unary part, beside the low bits."""
        block = np.searchsorted(self.counts, i, side="right") - 1
        rest, byte = i - self.counts[block].astype(np.int64), block * 8
        while True:  # at most eight bytes further
            here = _ONES[self.unary[np.minimum(byte, len(self.unary) - 1)]]
            go = rest >= here
            if not go.any():
                break
            rest, byte = np.where(go, rest - here, rest), byte + go
        high = byte * 8 + _NTH[self.unary[byte], rest] - i
        value = high << self.low
        if self.low:
            bit = i * self.low
            window = np.zeros(len(i), np.int64)
            for k in range(5):
                window |= self.lows[(bit >> 3) + k].astype(np.int64) << (8 * k)
            value |= window >> (bit & 7) & ((1 << self.low) - 1)
        return value


def shares(codes: np.ndarray) -> np.ndarray:
    """The shares in (0, 1] of codes as quantise() makes them; 0 for code 0."""
    return np.where(codes > 0, 10.0 ** (STEP * (1.0 - codes)), 0.0)


def whole_numbers(codes: np.ndarray) -> np.ndarray:
    """The numbers from 1 of codes as quantise() makes them of their inverses; 0 for code 0."""
    return np.where(codes > 0, 10.0 ** (STEP * (codes - 1.0)), 0.0)


def quantise(share: np.ndarray) -> np.ndarray:
    """Codes from 1 of shares in (0, 1], on a scale of logarithms."""
    return (1 + np.clip(np.rint(-np.log10(share) / STEP), 0, 65534)).astype(np.uint16)


def written(parts: dict[str, np.ndarray]) -> bytes:
    """Named arrays in one block of bytes."""
    head, body, at = [], [], 0
    for name, array in parts.items():
        raw = array.tobytes()
        raw += b"\0" * (-len(raw) % 8)
        head.append(f"{name} {array.dtype.str} {len(array)} {at}")
        body.append(raw)
        at += len(raw)
    text = "\n".join(head).encode()
    text += b" " * (-len(text) % 8)
    return b"".join((len(text).to_bytes(8, "little"), text, *body))


def mapped(raw: bytes) -> dict[str, np.ndarray]:
    """The arrays of written().

    The bytes go to an unnamed file and are mapped: the system may page them out, and nothing is left behind.
    """
    with tempfile.TemporaryFile() as f:
        f.write(raw)
        f.flush()
        held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(held[:8], "little")
    parts = {}
    for line in held[8 : 8 + size].decode().split("\n"):
        name, kind, n, at = line.split()
        parts[name] = np.frombuffer(held, np.dtype(kind), int(n), 8 + size + int(at))
    return parts


class WordTrie:
    """Smoothed shares of the n-grams of one part of all contexts, by Witten-Bell.

    Of a context: the code of its uses u, and of the weight k / (u + k) that it gives to the next shorter context, where
    k kinds of words stand behind it. Of an n-gram with n uses: the code of n / (u + k).
    """

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
        """From entries in any order; equal ones are added."""
        order = np.lexsort((word, context))
        context, word, n = context[order], word[order], n[order]
        first = np.flatnonzero(fresh(context, word))
        n = np.add.reduceat(n, first) if len(first) else n
        context, word = context[first], word[first]
        start = np.flatnonzero(fresh(context))
        kinds = np.diff(np.append(start, len(word)))
        uses = np.add.reduceat(n, start) if len(start) else n
        both = (uses + kinds).astype(float)
        starts = Monotone.pack(np.append(start, len(word)).astype(np.int64))
        parts = {"context": context[start], "uses": quantise(1 / np.maximum(uses, 1)), "weight": quantise(kinds / both), "word": word, "share": quantise(n / np.repeat(both, kinds))}
        return written(parts | {f"ptr.{k}": v for k, v in starts.items()})

    def __init__(self, raw: bytes) -> None:
        parts = mapped(raw)
        self.context, self.uses, self.weight, self.word, self.share = (parts[x] for x in ("context", "uses", "weight", "word", "share"))
        self.starts = Monotone(*(parts[f"ptr.{x}"] for x in ("low", "lows", "unary", "counts")))

    def find(self, context: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the uses and weights of contexts, and of the shares of the sizes words asked for behind each; 0 where there is none."""
        if not len(self.context):
            return np.zeros(len(context), np.int64), np.zeros(len(context), np.int64), np.zeros(len(word), np.int64)
        node = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        known = self.context[node] == context
        lo, hi = self.starts.at(node), self.starts.at(node + 1)
        uses, weight = np.where(known, self.uses[node], 0), np.where(known, self.weight[node], 0)
        known, lo, end = (np.repeat(x, sizes) for x in (known, lo, hi))
        hi = end
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (self.word[np.minimum(mid, len(self.word) - 1)] < word)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        at = np.minimum(lo, len(self.word) - 1)
        return uses, weight, np.where(known & (lo < end) & (self.word[at] == word), self.share[at], 0)


def fresh(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns is unlike the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return out
