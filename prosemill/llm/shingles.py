"""Hashed words and word n-grams of batches of whole texts, in numpy."""

from __future__ import annotations

import re

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANK = re.compile(rb"[\t-\r ]")
CUT = 1 << 20
_POWERS: list[np.ndarray] = []
#: Bits of a shingle's hash; the others hold the document's place in its batch while sorting.
HASH_BITS = 54
MASK = np.uint64((1 << HASH_BITS) - 1)
BATCH_DOCS, BATCH_BYTES = 1 << (64 - HASH_BITS - 1), 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        both = []
        for base in (_B, _BINV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def words(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text): runs of characters other than ASCII white space.

    Works on pieces of about CUT bytes, long texts being cut at white space, so that its memory doesn't grow with a text."""
    groups: list[list[bytes]] = [[]]
    owner, size = [], 0
    for i, t in enumerate(texts):
        raw, at = t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace"), 0
        while at <= len(raw):
            cut = _BLANK.search(raw, at + CUT) if len(raw) - at > CUT else None
            end = cut.start() if cut else len(raw)
            if size + end - at > CUT and groups[-1]:
                groups.append([])
                size = 0
            groups[-1].append(raw[at:end])
            owner.append(i)
            size, at = size + end - at, end if cut else len(raw) + 1
    done = [_words(g) for g in groups]
    counts = np.bincount(owner, weights=np.concatenate([c for _, c in done]), minlength=len(texts)) if owner else np.zeros(0)
    return np.concatenate([h for h, _ in done]), counts.astype(np.int64)


def _words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    space = SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    p, inv = _powers(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p, out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inv[starts])
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    return h, np.diff(np.searchsorted(starts, bounds + 1))


def ngrams(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all windows of n words; a text of fewer words, but one at least, has one window of them all."""
    doc = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))  # words up to the end of the text
    first = np.zeros(len(h), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    out = np.zeros(len(h), np.uint64)
    for k in range(n):
        out = out * _B + np.where(left > k, padded[k : k + len(h)], np.uint64(k + 1))
    keep = (left >= n) | first
    return mix(out[keep]), doc[keep]


def batched(texts: list[str | None]) -> list[slice]:
    """Slices of a list of texts with bounded documents and, but for single long texts, bytes."""
    out, at, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and (i - at >= BATCH_DOCS or size + n > BATCH_BYTES):
            out.append(slice(at, i))
            at, size = i, 0
        size += n
    if at < len(texts):
        out.append(slice(at, len(texts)))
    return out


def bags(texts: list[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct n-word shingles of each text, by text and hash."""
    g, doc = ngrams(*words(texts), n)
    key = np.sort((doc.astype(np.uint64) << np.uint64(HASH_BITS)) | (g & MASK))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return (key[at] >> np.uint64(HASH_BITS)).astype(np.int64), key[at] & MASK, np.diff(np.append(at, len(key)))
