"""Words of many texts as 64-bit hashes, computed by array operations over their UTF-8 bytes.

A word's hash is a polynomial over its bytes (modulo 2**64, from prefix sums), then mixed. Equal words have
equal hashes in every process. Two of a billion distinct words share a hash with a chance of about 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once (a longer text is taken alone).
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)

_space = [0x20, *range(0x09, 0x0E)]


def _table(separators: list[int]) -> np.ndarray:
    """For each byte: 0 if it separates words, else its value plus one, A-Z lower-cased."""
    t = np.arange(1, 257, dtype=np.uint16)
    t[ord("A") : ord("Z") + 1] += 32
    t[separators] = 0
    t[255] = 255  # no byte of UTF-8
    return t.astype(np.uint8)


#: Words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased.
SPACED = _table(_space)
#: Words are runs of ASCII letters, digits and non-ASCII bytes.
ALNUM = _table([b for b in range(128) if not chr(b).isalnum()])
#: Words are runs of ASCII letters and non-ASCII bytes.
LETTERS = _table([b for b in range(128) if not chr(b).isalpha()])

_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        made = np.full(size, base, np.uint64)
        made[0] = 1
        made = np.multiply.accumulate(made)
        if size > 8 * SLICE_BYTES:
            return made[:n]
        _powers[which] = have = made
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def hash_words(texts: list[bytes], table: np.ndarray = SPACED, head: int = 0):
    """Hashes of all words (uint64) and, for each text, where its words begin there (one entry more than texts).

    With ``head``, also the hashes of each word's first ``head`` bytes (0 for words that aren't longer).
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    a = table[np.frombuffer(b"\n".join(texts), np.uint8)]
    if not len(a):
        return (np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64), *([np.empty(0, np.uint64)] * bool(head)))
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = a != 0
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a * _power("up", _BASE, len(a)), out=total[1:])
    down = _power("down", _INVERSE, len(a))[starts]
    out = mix((total[ends] - total[starts]) * down), np.searchsorted(starts, begins)
    if head:
        stop = np.minimum(starts + head, ends)
        out += (np.where(stop < ends, mix((total[stop] - total[starts]) * down + np.uint64(head)), np.uint64(0)),)
    return out


def hash_runs(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` consecutive words: a Karp-Rabin value over word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for i in range(1, k):
        acc *= _MIX
        acc += h[i : i + n]
    return mix(acc)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text its sorted distinct ``k``-word shingles; with fewer words, the whole sequence as one; else none."""
    h, at = hash_words(texts)
    runs = hash_runs(h, k)
    out = []
    for i in range(len(texts)):
        lo, hi = int(at[i]), int(at[i + 1])
        if hi - lo >= k:
            out.append(np.unique(runs[lo : hi - k + 1]))
        elif hi > lo:
            out.append(hash_runs(h[lo:hi], hi - lo) ^ np.uint64(hi - lo))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Consecutive texts of at most ``limit`` bytes together, as (first, one past the last, UTF-8 bytes); null is empty."""
    texts = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= limit:
            size += len(texts[j])
            j += 1
        yield i, j, texts[i:j]
        i = j
