"""Hashes of runs of words, computed with numpy over many texts at once."""

from __future__ import annotations

import numpy as np

#: On UTF-8: A-Z to a-z, other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and all but word bytes (digits, a-z, 0x80 and above) to a space.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER)
#: Bytes hashed at once; longer texts are cut into overlapping parts.
PART_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def words_of(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return (raw or b"").translate(FOLD).split()


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to the exponent n."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        out = []
        for step in (_BASE, _INVERSE):
            x = np.ones(size, np.uint64)
            x[1:] = np.uint64(step)
            out.append(np.multiply.accumulate(x))
        _powers = out[0], out[1]
    return _powers


def gram_hashes(lines: list[bytes], n: int, *, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of every run of n words, in order; how many each line has).

    A line is its words with one space between; a word has neither space nor line feed. A line of
    fewer words has no run or, if ``whole``, the one run of all its words, if any. Equal runs have
    equal hashes everywhere; the hash of a run is a polynomial over random byte values modulo 2^64.
    """
    if sum(map(len, lines)) > PART_BYTES:
        if len(lines) > 1:
            half = len(lines) // 2
            parts = [gram_hashes(x, n, whole=whole) for x in (lines[:half], lines[half:])]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        words = lines[0].split(b" ")
        step = max(n, len(words) // (2 + 2 * len(lines[0]) // PART_BYTES))
        if len(words) > step + n:
            own = [gram_hashes([b" ".join(words[i : i + step + n - 1])], n)[0] for i in range(0, len(words) - n + 1, step)]
            return np.concatenate(own), np.array([sum(map(len, own))])
    buf = b"\n".join(lines) + b"\n" if lines else b""
    a = np.frombuffer(buf, np.uint8)
    ends = np.flatnonzero((a == 32) | (a == 10))
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    last = a[ends] == 10
    line = np.cumsum(last) - last
    real = ends > starts
    starts, ends, line = starts[real], ends[real], line[real]
    up, down = _upto(len(a) + 1)
    prefix = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_TABLE[a] * up[: len(a)], out=prefix[1:])
    k = max(0, len(starts) - n + 1)
    full = line[:k] == line[n - 1 : n - 1 + k]
    first, stop, own = starts[:k][full], ends[n - 1 : n - 1 + k][full], line[:k][full]
    if whole:
        count = np.bincount(line, minlength=len(lines))
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            at = np.searchsorted(line, short)
            first, stop, own = np.concatenate([first, starts[at]]), np.concatenate([stop, ends[at + count[short] - 1]]), np.concatenate([own, short])
            order = np.argsort(own, kind="stable")
            first, stop, own = first[order], stop[order], own[order]
    hashes = mix((prefix[stop] - prefix[first]) * down[first])
    return hashes, np.bincount(own, minlength=len(lines)) if len(lines) else np.zeros(0, np.int64)
