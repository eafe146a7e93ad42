"""Words, word hashes and shingles of whole texts in numpy, a slice of a batch at a time.

Words are hashed in the bytes of the slice itself: running sums of a random value a byte times powers of an odd number.
Nothing is kept from one slice to the next, so a worker's memory is that of a few slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text handled at once; words from LONG bytes on are hashed by the library.
SLICE, LONG = 1 << 18, 64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]  # A-Z count as a-z
_BASE = 0x9FB21C651E98DF25 | 3
#: Powers of the base and of its inverse, for the places of a slice.
_POWER = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * SLICE, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    return x ^ (x >> np.uint64(29))


def word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of ``buf``, at most 2 * SLICE bytes but for a longer word."""
    raw = np.frombuffer(buf, np.uint8)
    word = np.zeros(len(raw) + 2, bool)
    np.logical_not(_BLANK[raw], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    size = end - start
    out = np.empty(len(start), np.uint64)
    short = size < LONG
    if len(raw) <= 2 * SLICE:
        upto = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * _POWER[0][: len(raw)], out=upto[1:])
        out = mixed((upto[end] - upto[start]) * _POWER[1][start] + size.astype(np.uint64) * _ODD[2])
    else:
        short[:] = False
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]].lower())
    return out, start


def _chunks(text: bytes) -> Iterator[bytes]:
    """A long text cut at blanks."""
    a = 0
    while a < len(text):
        b = min(len(text), a + SLICE)
        while b < len(text) and not _BLANK[text[b]]:
            b += 1
        yield text[a:b]
        a = b


def _runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, number of words of each text) of runs of texts of about SLICE bytes; a longer text is a run of its own."""
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b]) < SLICE):
            held += len(texts[b]) + 1
            b += 1
        if held <= 2 * SLICE:
            h, start = word_hashes(b"\n".join(texts[a:b]))
            ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
            yield h, np.diff(np.searchsorted(start, ends), prepend=0)
        else:
            h = np.concatenate([word_hashes(c)[0] for c in _chunks(texts[a])])
            yield h, np.array([len(h)])
        a = b


def shingle_runs(texts: list[bytes | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, sizes) of runs of texts: each text's sorted distinct shingle hashes (A-Z lower-cased), one text after another.

    A text of fewer words than ``width`` has one shingle, the whole sequence; a text without words has none.
    """
    for flat, sizes in _runs([t or b"" for t in texts]):
        n = len(flat) - width + 1
        wide = np.zeros(max(n, 0), np.uint64)
        for k in range(width if n > 0 else 0):
            wide = mixed(wide * _ODD[0] + flat[k : k + n])
        ends = np.cumsum(sizes)
        many = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
        upto = np.cumsum(many)
        out = np.empty(int(upto[-1]) if len(upto) else 0, np.uint64)
        for size, end, a, b in zip(sizes.tolist(), ends.tolist(), (upto - many).tolist(), upto.tolist(), strict=True):
            if size >= width:
                out[a:b] = wide[end - size : end - width + 1]
                out[a:b].sort()
            elif size:
                own = np.array([size], np.uint64) * _ODD[4]
                for h in flat[end - size : end]:
                    own = mixed(own * _ODD[1] + h)
                out[a] = own[0]
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[(upto - many)[many > 0]] = True
        whose = np.repeat(np.arange(len(sizes)), many)
        yield out[new], np.bincount(whose[new], minlength=len(sizes))


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for values, sizes in shingle_runs(texts, width):
        yield from np.split(values, np.cumsum(sizes)[:-1])
