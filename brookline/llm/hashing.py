"""64-bit hashes of words, word runs and byte ranges of whole texts.

Where equal hashes are taken for equal strings, they are BLAKE2b digests of byte ranges, or hashes of words by blocks whose step cannot
be solved for a block: texts that collide are found by chance alone. The polynomial sums modulo 2 ** 64 are fast, but texts can be built
that collide under any base, so they only propose: whoever uses them compares bytes or a digest afterwards.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i < n at least."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


#: A random-looking number for each byte value.
PLAIN = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = sum of PLAIN[data[k]] * BASE ** k over i <= k < j."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(PLAIN[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes other than space and 9 to 13)."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def digest(data: bytes) -> int:
    """64 bits of a cryptographic digest."""
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little")


def compressed(h: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The next state of a hash. The block goes in on both sides of a sum of two bijections, so no block can be worked out for a wanted state."""
    return mixed(h ^ (block * FIRST)) + mixed((h << np.uint64(23) | h >> np.uint64(41)) + block * SECOND)


FIRST, SECOND = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)
#: The lowest 0 to 8 bytes of a block.
LOWEST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """One hash for each word; equal words have equal hashes. Eight bytes of every word at a time."""
    raw = (text.lower() if lower else text) + bytes(8)
    start, end = word_spans(np.frombuffer(raw, dtype=np.uint8)[:-8])
    size = end - start
    eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))  # the eight bytes from every byte on
    out = compressed(mixed(size.astype(np.uint64) + np.uint64(1)), eight[start] & LOWEST[np.minimum(size, 8)])
    some = np.flatnonzero(size > 8)
    done = 8
    while len(some):
        out[some] = compressed(out[some], eight[start[some] + done] & LOWEST[np.minimum(size[some] - done, 8)])
        done += 8
        some = some[size[some] > done]
    return out


def range_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One digest for each byte range."""
    raw = data.tobytes()
    return np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())), dtype=np.uint64, count=len(start))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words, in order; a shorter text is one run."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mixed(out + words[i : len(words) - n + 1 + i] + np.uint64(i + 1))
    return out
