"""Places of points on a Hilbert curve."""

from __future__ import annotations


def hilbert_keys(points, bits: int):
    """Key of each row of ``points`` (unsigned ints below ``2 ** bits``, n x dims).

    Neighbouring keys are neighbouring cells. Works on all rows at once: the axes are
    turned into the curve's transposed index bit by bit, then interleaved.
    """
    import numpy as np

    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for d in range(dims):
            set_here = (x[:, d] & bit) != 0
            swap = (x[:, 0] ^ x[:, d]) & low
            x[:, 0] = np.where(set_here, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, d] = np.where(set_here, x[:, d], x[:, d] ^ swap)
        bit >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where((x[:, -1] & bit) != 0, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip[:, None]
    keys = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            keys = (keys << 1) | ((x[:, d] >> b) & 1)
    return keys
