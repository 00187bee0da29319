"""Masked CRC-32C of many byte strings at once."""

from __future__ import annotations

import numpy as np

#: Fixed values of the checksum: the reflected Castagnoli polynomial, and what the mask adds after a rotation by 15 bits.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
_WIDE = 256


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1)
    return out


_TABLE = _table()


def _advance() -> list[np.ndarray]:
    """Tables by which a checksum register runs over ``_WIDE`` zero bytes, for each of its four bytes."""
    out = []
    for shift in (0, 8, 16, 24):
        state = np.arange(256, dtype=np.uint32) << np.uint32(shift)
        for _ in range(_WIDE):
            state = _TABLE[state & 0xFF] ^ (state >> 8)
        out.append(state)
    return out


_ADVANCE = _advance()


def crc32c(items: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string (four bytes or more). Each is padded in front with zeros to full rows of 256
    bytes, which a register that starts at 0 doesn't see; its usual start value goes into the first four bytes.
    All rows run side by side, and then those of a string are joined."""
    if not items:
        return np.zeros(0, np.uint32)
    size = np.array([len(x) for x in items])
    if size.min() < 4:
        raise ValueError("a checksummed string needs four bytes")
    rows = -(-size // _WIDE)
    first = np.cumsum(rows) - rows
    grid = np.zeros(rows.sum() * _WIDE, np.uint8)
    for item, row, many in zip(items, first.tolist(), rows.tolist(), strict=True):
        at = (row + many) * _WIDE - len(item)
        grid[at:at + len(item)] = np.frombuffer(item, np.uint8)
        grid[at:at + 4] ^= 0xFF
    state = np.zeros(rows.sum(), np.uint32)
    for column in np.ascontiguousarray(grid.reshape(-1, _WIDE).T):
        state = _TABLE[(state ^ column) & 0xFF] ^ (state >> 8)
    out = state[first]
    order = np.argsort(-rows, kind="stable")
    for k in range(1, rows.max()):
        live = order[:np.searchsorted(-rows[order], -k)]
        s = out[live]
        s = _ADVANCE[0][s & 0xFF] ^ _ADVANCE[1][(s >> 8) & 0xFF] ^ _ADVANCE[2][(s >> 16) & 0xFF] ^ _ADVANCE[3][s >> 24]
        out[live] = s ^ state[first[live] + k]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and shifted, so that a checksum of data that holds checksums stays useful."""
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)
