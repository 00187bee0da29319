"""Word shingles of whole texts as 64-bit fingerprints, computed for a batch of texts at a time.

A batch is one byte buffer. Words are runs of bytes outside space and \\t..\\r, A-Z counts as a-z. A word's key is its
bytes, up to 15 of them, beyond that a cryptographic digest; its fingerprint mixes the two halves of the key, and a shingle's fingerprint
mixes those of its words in order. So words can only be confused by chance: among n different shingles of a corpus, n^2 / 2^65 pairs are
expected to share a fingerprint (0.7 for the five billion shingles of 30 GB).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0xD1342543DE82EF95)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Bytes handled at once; longer batches are cut between texts.
BLOCK = 1 << 20
#: Bytes up to which a unit is its own key.
SHORT = 15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(data: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key, in two halves, of each range of bytes: up to SHORT bytes these themselves and their number, beyond that a digest."""
    view = np.ndarray(len(data) + 9, "<u8", data + bytes(16), strides=(1,))
    size = stop - start
    high = view[start] & _MASK[np.minimum(size, 8)]
    low = view[np.minimum(start + 8, len(data))] & _MASK[np.clip(size - 8, 0, 7)] | (np.minimum(size, 255).astype(np.uint64) << np.uint64(56))
    for i in np.flatnonzero(size > SHORT).tolist():
        digest = hashlib.blake2b(data[start[i]:stop[i]], digest_size=16).digest()
        high[i], low[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 0xFF << 56
    return high, low


def fold_keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64 bits of a key; every bit of both halves counts for all of them."""
    return mix(mix(high + _STEP) ^ low)


def word_prints(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and fingerprint of each word in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end, fold_keys(*keys(data.translate(_FOLD), start, end))


def segments(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """A text in consecutive portions of about ``size`` bytes that end at a space, or later where no word ends."""
    start = 0
    while start < len(data):
        stop = len(data)
        if stop - start > size:
            found = [i for i in (data.rfind(c, start, start + size) for c in (b" ", b"\n")) if i > start] or \
                [i for i in (data.find(c, start + size) for c in (b" ", b"\n")) if i > 0][:1]
            stop = max(found) if found else stop
        yield data[start:stop]
        start = stop


def _grams(word: np.ndarray, size: int) -> np.ndarray:
    n = len(word) - size + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        grams = (grams + word[k:k + n]) * _STEP
    return mix(grams)


def _short(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle has."""
    one = np.uint64(len(words))
    for w in words:
        one = (one + w) * _STEP
    return mix(np.array([one] if len(words) else [], np.uint64))


def _block(texts: list[bytes], size: int) -> list[np.ndarray]:
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    start, _, word = word_prints(b" ".join(texts))
    first = np.searchsorted(start, begin)
    grams = _grams(word, size)
    return [np.unique(grams[a:b - size + 1]) if b - a >= size else _short(word[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _long(text: bytes, size: int) -> np.ndarray:
    """The shingles of one long text, whose words are found portion by portion."""
    word = np.concatenate([word_prints(t)[2] for t in segments(text)])
    return np.unique(_grams(word, size)) if len(word) >= size else _short(word)


def shingle_sets(texts: list[str | bytes | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text; a text with fewer words than ``size`` has its
    whole word sequence as one shingle, a null or wordless text none."""
    raw = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
    out, block, held = [], [], 0
    with np.errstate(over="ignore"):
        for t in raw:
            if block and held + len(t) > BLOCK:
                out += _block(block, size)
                block, held = [], 0
            if len(t) > BLOCK:
                out.append(_long(t, size))
                continue
            block.append(t)
            held += len(t) + 1
        if block:
            out += _block(block, size)
    return out
