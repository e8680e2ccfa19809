"""The weight of a term in an item, for columns and for arrays."""

from __future__ import annotations

from shortlist.constants import BM25_B, BM25_K1


def term_weight(tf, length, avg_length):
    """Saturated term frequency, damped by the length of the item."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / avg_length))
