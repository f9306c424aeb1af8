"""Vectorised 64-bit hashes of byte ranges and word windows, for use inside Arrow batches."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: The first hash works modulo 2**64, which is fast, but texts made for it collide whatever its base (the Thue-Morse
#: sequence and its complement). The second is a pair modulo a prime, where two strings of n bytes collide for n of the
#: 2**31 bases of either at most; what is removed rests on it.
PRIME = (1 << 31) - 1
_BASE, _PRIME_BASES = 0x9E3779B97F4A7C15, (0x1F83D9AB, 0x5BE0CD19)
#: Random values for each byte; fixed seeds, so all tasks agree.
BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
PRIME_BYTES = np.random.default_rng(19).integers(0, PRIME, (2, 256), np.uint64)
_grown_powers: dict[tuple[int, int], np.ndarray] = {}
_U = np.uint64


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number that is the same modulo PRIME."""
    return (x & _U(PRIME)) + (x >> _U(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _folded(_folded(_folded(x)))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


def _powers_of(step: int, n: int, modulus: int) -> np.ndarray:
    values = _grown_powers.get((step, modulus), np.ones(1, np.uint64))
    while len(values) < n:
        more = values * _U(pow(step, len(values), modulus))
        values = np.concatenate([values, _reduced(more) if modulus == PRIME else more])
    _grown_powers[step, modulus] = values
    return values


def inverses(n: int) -> np.ndarray:
    return _powers_of(pow(_BASE, -1, 1 << 64), n, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit value over all others."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of a uint8 array, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * _powers_of(_BASE, len(data), 1 << 64)[: len(data)], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range [start, end): equal bytes give equal hashes, wherever they stand."""
    return mix((sums[end] - sums[start]) * inverses(len(sums))[start] ^ (end - start).astype(np.uint64))


def prime_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the pair of hashes modulo PRIME; their terms are below 2**32, so no sum of a text overflows."""
    out = np.zeros((2, len(data) + 1), np.uint64)
    for k, base in enumerate(_PRIME_BASES):
        np.cumsum(_folded(PRIME_BYTES[k][data] * _powers_of(base, len(data), PRIME)[: len(data)]), out=out[k, 1:])
    return out


def prime_ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The pair of each byte range, in one number, with its length mixed in."""
    pair = []
    for k, base in enumerate(_PRIME_BASES):
        back = _powers_of(pow(base, -1, PRIME), sums.shape[1], PRIME)[start]
        pair.append(_reduced(_reduced(sums[k][end] - sums[k][start]) * back))
    return mix((pair[0] << _U(31) | pair[1]) ^ mix((end - start).astype(np.uint64)))


def byte_set(of: bytes) -> np.ndarray:
    """True at the numbers of these bytes."""
    held = np.zeros(256, bool)
    held[list(of)] = True
    return held


SPACE, UPPER = byte_set(b" \t\n\x0b\x0c\r"), byte_set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = np.arange(256, dtype=np.uint8) + 32 * UPPER.astype(np.uint8)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words of a uint8 array."""
    edge = np.flatnonzero(np.diff(SPACE[data], prepend=True, append=True))
    return edge[::2], edge[1::2]


def owners(texts: list[bytes], start: np.ndarray) -> np.ndarray:
    """Which of ``texts``, joined by a line feed, each of these places is in."""
    return np.searchsorted(np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), start, "right")


#: Words whose hashes a Python worker remembers.
REMEMBERED = 300_000
_word_hashes: dict[bytes, int] = {}
_PLACES = np.random.default_rng(23).integers(0, 1 << 63, 64, np.uint64) * _U(2) + _U(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, cut from a cryptographic one, so that no text is known to make two words collide."""
    known = _word_hashes
    new = set(words).difference(known)
    if new:
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        known.update((w, int.from_bytes(blake2b(w, digest_size=8).digest(), "little")) for w in new)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word windows of a text, A-Z lower-cased.

    With fewer words, the whole sequence is one shingle; without words there is none. ``bytes.split`` separates at
    space and 0x09-0x0D, and ``bytes.lower`` changes A-Z only. A window's hash sums its words' hashes, each times
    a number of its place.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    n = min(size, len(words))
    folded = np.full(len(words) - n + 1, n, np.uint64)
    for at in range(n):
        folded += hashes[at : at + len(folded)] * _PLACES[at]
    return np.unique(mix(folded))
