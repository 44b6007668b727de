"""Golomb codes with a power-of-two divisor (Rice codes) for sorted integers."""

from __future__ import annotations

import numpy as np

HEAD = 13  # shift (1 byte), number of values (4), bytes of the remainders (8)


def encode(values: np.ndarray) -> bytes:
    """Code strictly or weakly ascending unsigned 64-bit values as their gaps.

    Each gap is a quotient in unary and ``shift`` low bits. The shift follows
    the mean gap, so n values spread over a range R take about log2(R / n) + 1.5
    bits each. Quotients stay small: their sum is at most n plus the range
    divided by the divisor, which is at most 3 n.
    """
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    if n == 0:
        return bytes(HEAD)
    gaps = np.empty(n, np.uint64)
    gaps[0] = v[0]
    np.subtract(v[1:], v[:-1], out=gaps[1:])
    shift = max(0, (int(v[-1]) // n).bit_length() - 1)
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    if shift:
        places = np.arange(shift, dtype=np.uint64)
        bits = np.empty((n, shift), np.uint8)
        for start in range(0, n, 1 << 16):  # one slice of bits at a time
            part = gaps[start : start + (1 << 16), None]
            bits[start : start + (1 << 16)] = (part >> places) & np.uint64(1)
        low = np.packbits(bits.ravel(), bitorder="little").tobytes()
    else:
        low = b""
    head = bytes([shift]) + n.to_bytes(4, "little") + len(low).to_bytes(8, "little")
    return head + low + np.packbits(unary, bitorder="little").tobytes()


def decode(blob: bytes) -> np.ndarray:
    """The values that ``encode`` was given."""
    shift, n = blob[0], int.from_bytes(blob[1:5], "little")
    if n == 0:
        return np.empty(0, np.uint64)
    size = int.from_bytes(blob[5:HEAD], "little")
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, offset=HEAD + size), bitorder="little")
    ends = np.flatnonzero(unary)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(shift)
    if shift:
        raw = np.frombuffer(blob, np.uint8, count=size, offset=HEAD)
        bits = np.unpackbits(raw, count=n * shift, bitorder="little").reshape(n, shift)
        for place in range(shift):
            gaps |= bits[:, place].astype(np.uint64) << np.uint64(place)
    return np.cumsum(gaps, dtype=np.uint64)
