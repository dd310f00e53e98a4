"""Word shingles and MinHash signatures, computed over the bytes of many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is taken alone.
SLICE = 500_000

_rng = np.random.default_rng(20_240_601)
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLD = bytes(range(256)).lower()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each white-space-separated word, and where each text's words start.

    With running sums of byte value times power, a word's hash is a difference
    of two sums, moved back to the word's start.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    new = np.zeros(n + 1, bool)
    new[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | new[:-1]))
    after = np.concatenate([solid[1:], [False]])
    ends = np.flatnonzero(solid & (~after | new[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_STEP, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_BACK, n)[starts]
    return _mixed(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_hashes(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per text, the hashes of all its shingles in order, repeats included.

    A shingle is `width` consecutive words, A-Z lower-cased; a text with fewer
    words is one shingle, one without words has none. Null is empty.
    """
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    factors = _powers(np.uint64(0x2545F4914F6CDD1D), width + 1)[1:]
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        base = offsets[at]
        words, first = _word_hashes(data[base : offsets[upto]], offsets[at : upto + 1] - base)
        full = max(0, len(words) - width + 1)
        rolled = np.zeros(full, np.uint64)
        for k in range(width):
            rolled += words[k : k + full] * factors[k]
        rolled = _mixed(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield rolled[a : b - width + 1]
            else:
                few = words[a:b]
                whole = (few * factors[: len(few)]).sum(dtype=np.uint64) + np.uint64(len(few))
                yield _mixed(np.full(min(1, len(few)), whole, np.uint64))
        at = upto


class MinHash:
    """Signatures of `size` 32-bit minima under as many fixed permutations."""

    def __init__(self, size: int) -> None:
        rng = np.random.default_rng(5)
        self.factor = (rng.integers(0, 1 << 31, size, dtype=np.uint32) * 2 + 1)[:, None]
        self.shift = rng.integers(0, 1 << 32, size, dtype=np.uint32)[:, None]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 1024):
            turned = self.factor * low[None, at : at + 1024]
            turned += self.shift
            np.minimum(least, turned.min(axis=1), out=least)
        return least


def sequence_digest(text: str) -> bytes:
    """Digest of the words of a text in order."""
    return hashlib.blake2b(b" ".join(text.encode().translate(_FOLD).split()), digest_size=16).digest()
