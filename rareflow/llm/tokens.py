"""Token ids of whole texts by a byte-level BPE of the ``tokenizers`` library, encoding each distinct word once.

A byte-level BPE splits a text before it merges, and never joins what stands left and right of a single
space or line feed between two characters that are no white space. So a text may be cut before each such
character, and equal units between the cuts have equal ids wherever they stand. Texts go through in blocks of bounded size, cut
inside a text if it is longer: cuts and keys of the units are array operations, the library encodes the units not met before,
and the ids of a text are gathered from those of its units. Units are looked up by a 64-bit hash, and their 128-bit keys (the bytes
themselves up to 15 of them, beyond that a digest) are compared before ids are taken over. The ids are those that the library gives for the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from rareflow.llm.shingles import fold_keys, keys

#: Units that a worker keeps from block to block (about 45 bytes each); only memory and time depend on it.
MOST_UNITS = 1_000_000
#: Bytes handled at once.
BLOCK = 1 << 20
#: Units encoded in one call of the library's batch item.
GROUP = 64
#: All bytes but white space and the lead bytes of what may be.
_NO_BLANK = bytes(b for b in range(256) if b > 32 and b not in (0x7F, 0xC2, 0xE1, 0xE2, 0xE3))


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Positions of the single spaces and line feeds before which a text may be cut. Next to a character whose
    lead byte could be that of a Unicode white space, no cut is made."""
    n = len(data)
    solid = (data > 32) & (data != 127)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at + 1 < n)]
    before, after = data[at - 1], data[at + 1]
    good = solid[at - 1] & solid[at + 1]
    lead = np.zeros(256, bool)
    lead[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    good &= ~lead[after]
    wide = before >= 0x80
    good &= ~(wide & (at >= 2) & (data[np.maximum(at - 2, 0)] == 0xC2))
    good &= ~(wide & (at >= 3) & lead[data[np.maximum(at - 3, 0)]])
    return at[good]


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[list[tuple[int, bytes]]]:
    """Portions of texts, (number of the text, bytes), with about ``size`` bytes at once. A longer text is cut at the last safe place
    within ``size`` bytes, or at the first one after them; one without such a place is a portion whole."""
    held, many = [], 0
    for i, text in enumerate(texts):
        start = 0
        while start < len(text):
            room, stop = size - many if many else size, len(text)
            if stop - start > room:
                if many:  # what is held goes first
                    yield held
                    held, many = [], 0
                    continue
                reach = room
                while start + reach < len(text):
                    cut = safe_cuts(np.frombuffer(text, np.uint8, min(reach + 1, len(text) - start), start))
                    if len(cut):
                        stop = start + int(cut[-1])
                        break
                    reach *= 2
            held.append((i, text[start:stop]))
            many += stop - start
            start = stop
    if held:
        yield held


class UnitEncoder:
    """Encodes batches of texts; keeps the ids of the units it has met."""

    def __init__(self, library):
        """``library``: a Tokenizer, or the path of its file."""
        from tokenizers import Tokenizer

        self.tokenizer = library = Tokenizer.from_file(library) if isinstance(library, str) else library
        if hasattr(library.model, "_resize_cache"):
            library.model._resize_cache(0)  # each unit comes once
        self.opens = np.zeros(library.get_vocab_size(with_added_tokens=True), bool)  # ids whose text begins with a space or a line feed
        for piece, i in library.get_vocab(with_added_tokens=True).items():
            self.opens[i] = piece[:1] in ("Ġ", "Ċ")
        self.kind = np.uint16 if len(self.opens) <= 1 << 16 else np.uint32
        #: Of the units met so far, by ascending hash: hash, both halves of the key, where their ids begin in the last array, how many there are.
        self.known = *(np.zeros(0, np.uint64) for _ in range(3)), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def _library(self, items: list[bytes]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast([b.decode("utf-8", "replace") for b in items], add_special_tokens=False)
        return [x.ids for x in found]

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, lengths): the units' ids one after the other, in an order of the units that is returned. Plain units begin with a space
        or a line feed and hold no other white space: many are encoded in one call and told apart by the ids that open them."""
        done, flat, lengths = [], [], []
        plain = [i for i, u in enumerate(units) if len(u) > 1 and u[0] in b" \n" and not u.translate(None, _NO_BLANK)[1:]]
        groups = [plain[i:i + GROUP] for i in range(0, len(plain), GROUP)]
        alone = list(set(range(len(units))).difference(plain))
        for group, ids in zip(groups, self._library([b"".join([units[i] for i in g]) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            start = np.flatnonzero(self.opens[ids])
            if len(start) != len(group) or start[0] != 0:
                alone += group
                continue
            done += group
            flat.append(ids)
            lengths.append(np.diff(np.append(start, len(ids))))
        for i, ids in zip(alone, self._library([units[i] for i in alone]), strict=True):
            done.append(i)
            flat.append(np.array(ids, np.uint32))
            lengths.append(np.array([len(ids)]))
        return np.array(done), np.concatenate(flat), np.concatenate(lengths)

    def _block(self, portions: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each portion has)."""
        joined = b"".join([t for _, t in portions])
        ends = np.cumsum([len(t) for _, t in portions])
        heads = np.append(0, ends)[:-1]
        data = np.frombuffer(joined, np.uint8)
        cut = safe_cuts(data)
        # no cut at or next to the border between two texts
        inner = np.ones(len(data) + 2, bool)
        for k in (-1, 0):
            inner[np.maximum(heads + k, 0)] = False
        begins = np.zeros(len(data), bool)
        begins[heads] = begins[cut[inner[cut]]] = True
        start = np.flatnonzero(begins)
        stop = np.append(start[1:], len(data))
        high, low = keys(joined, start, stop)
        fresh, first, back = np.unique(fold_keys(high, low), return_index=True, return_inverse=True)
        own = high[first], low[first]
        prints, highs, lows, begin, length, flat = self.known
        at = np.searchsorted(prints, fresh)
        there = np.minimum(at, max(len(prints) - 1, 0))
        known = (at < len(prints)) & (prints[there] == fresh) if len(prints) else np.zeros(len(fresh), bool)
        met = there[known]
        if (high != own[0][back]).any() or (low != own[1][back]).any() or (highs[met] != own[0][known]).any() or (lows[met] != own[1][known]).any():
            return self._whole(portions)  # two units with one hash
        new = first[~known]
        if len(new):
            order, ids, sizes = self._encode_units([joined[a:b] for a, b in zip(start[new].tolist(), stop[new].tolist(), strict=True)])
            place, begins = np.argsort(order), len(flat) + np.cumsum(sizes) - sizes  # the new units' hashes ascend
            slot = at[~known]
            prints = np.insert(prints, slot, fresh[~known])
            highs, lows = np.insert(highs, slot, own[0][~known]), np.insert(lows, slot, own[1][~known])
            begin, length = np.insert(begin, slot, begins[place]), np.insert(length, slot, sizes[place])
            flat = np.concatenate([flat, ids.astype(self.kind)])
            if len(prints) <= MOST_UNITS:
                self.known = prints, highs, lows, begin, length, flat
        at = np.searchsorted(prints, fresh)[back]
        length, begin = length[at].astype(np.int64), begin[at]
        upto = np.cumsum(length)
        ids = flat[np.repeat(begin - (upto - length), length) + np.arange(upto[-1])].astype(np.uint32)
        before = np.append(0, upto)
        return ids, np.diff(before[np.searchsorted(start, np.append(heads, len(data)))])

    def _whole(self, portions: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_block``, each portion encoded by the library at once."""
        found = self._library([t for _, t in portions])
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text ``i`` has ``ids[bounds[i]:bounds[i + 1]]``. Bytes that are no UTF-8 are read as U+FFFD."""
        length = np.zeros(len(texts) + 1, np.int64)
        out = [np.zeros(0, np.uint32)]
        for portions in blocks(texts):
            ids, many = self._block(portions)
            out.append(ids)
            np.add.at(length, [i + 1 for i, _ in portions], many)
        return np.concatenate(out), np.cumsum(length)


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a vocabulary file; loaded once."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
