"""Words of texts and their runs of five, as arrays over a batch of texts."""

from __future__ import annotations

import re

WORD = re.compile("[^\x20\x09-\x0d]+")
WIDTH = 5
PAD = 0x9E3779B97F4A7C15


def word_hashes(texts: list[str]):
    """(64-bit hashes of all words, words per text)."""
    import numpy as np
    import xxhash

    from shortlist.llm.pretokens import Places

    words, sizes = [], []
    for text in texts:
        got = WORD.findall(text)
        words += got
        sizes.append(len(got))
    counts = np.array(sizes, np.int64)
    if not words:
        return np.empty(0, np.uint64), counts
    distinct = Places()
    codes = distinct.of(words)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    return hashes[codes], counts


def mix(x):
    """Spreads 64-bit values over all their bits."""
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes, starts):
    """Hash of the ``WIDTH`` words from each start."""
    import numpy as np

    out = hashes[starts]
    for j in range(1, WIDTH):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[starts + j])
    return mix(out)


def padded(hashes, counts):
    """The words with texts below ``WIDTH`` words filled up, and the new counts."""
    import numpy as np

    from shortlist.llm.pretokens import ragged

    longer = np.maximum(counts, WIDTH)
    out = np.full(int(longer.sum()), PAD, np.uint64)
    out[ragged(np.cumsum(longer) - longer, counts)] = hashes
    return out, longer


def text_shingles(texts: list[str]):
    """(shingle hashes, shingles per text, word hashes, words per text).

    A text of fewer words than ``WIDTH`` has one shingle: all its words.
    """
    import numpy as np

    from shortlist.llm.pretokens import ragged

    hashes, counts = word_hashes(texts)
    filled, longer = padded(hashes, counts)
    windows = longer - WIDTH + 1
    starts = ragged(np.cumsum(longer) - longer, windows)
    return window_hashes(filled, starts), windows, hashes, counts


def repeated_words(hashes, counts):
    """Words of each text that lie in a window found twice or more in it."""
    import numpy as np
    import pandas as pd

    from shortlist.llm.pretokens import ragged

    first = np.cumsum(counts) - counts
    windows = np.maximum(counts - WIDTH + 1, 0)
    starts = ragged(first, windows)
    if not len(starts):
        return np.zeros(len(counts), np.int64)
    owner = np.repeat(np.arange(len(counts)), windows)
    # With its text in the hash, equal hashes are repeats within one text.
    own = window_hashes(hashes, starts) ^ mix(owner.astype(np.uint64) + np.uint64(1))
    twice = pd.Series(own).duplicated(keep=False).to_numpy()
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, starts[twice], 1)
    np.add.at(change, starts[twice] + WIDTH, -1)
    covered = np.cumsum(change[:-1]) > 0
    ends = np.concatenate([[0], np.cumsum(covered)])
    return ends[first + counts] - ends[first]
