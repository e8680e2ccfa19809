"""Cutting texts into the pieces that a BPE model encodes one by one.

Two public pre-tokenizations are known here, each as one compiled pattern over
characters below ``LIMIT``; texts with other characters, or that may hold a special
token, are marked and left to the tokenizers library, so results stay exact.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from itertools import islice

LIMIT = 0x180
# Starts a piece that is a whole text for the library; no pattern below yields it.
WHOLE = "\uffff"


def _letters_like(major: str) -> str:
    chars = (chr(c) for c in range(LIMIT))
    return "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == major)


# The published patterns of the two tokenizers, over explicit classes.
_SPACE = "\t\n\v\f\r \x85\xa0"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"


def _byte_level() -> str:
    letter, number = _letters_like("L"), _letters_like("N")
    return (
        rf"{_SHORT}| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+"
        rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


def _word_level() -> str:
    letter, number = _letters_like("L"), _letters_like("N")
    return rf"{_SHORT}|[{letter}]+|[{number}]|[^{_SPACE}{letter}{number}]+"


@dataclass
class Cutter:
    """Pieces of a text, in order."""

    pattern: re.Pattern
    unsafe: re.Pattern
    special: list[str]
    lower: bool

    def safe(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        try:
            text.encode("latin-1")  # much faster than the pattern, and true for most texts
        except UnicodeEncodeError:
            return not self.unsafe.search(text)
        return True

    def cut(self, text: str) -> list[str]:
        if not self.safe(text):
            return [WHOLE + text]
        return self.pattern.findall(text.lower() if self.lower else text)


def cutter_for(tokenizer_json: str) -> Cutter | None:
    """The cutter equal to a tokenizer's own steps, or None if they are others."""
    spec = json.loads(tokenizer_json)
    pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
    special = [t["content"] for t in spec["added_tokens"]]
    if pre.get("type") == "ByteLevel" and norm is None and pre["use_regex"] and not pre["add_prefix_space"]:
        return Cutter(re.compile(_byte_level()), re.compile("[^\x00-ſ]"), special, False)
    steps = [n["type"] for n in (norm or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]:
        published = _SHORT + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if parts[0]["pattern"].get("Regex") == published and parts[0]["invert"]:
            # U+0130 gives two characters in lower case, one of them above the limit.
            return Cutter(re.compile(_word_level()), re.compile("[^\x00-ſ]|İ"), special, True)
    return None


def slices(texts: list[str], chars: int = 1 << 21):
    """Runs of texts of about ``chars`` characters each, at least one text."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def ragged(starts, counts):
    """Positions ``starts[i] .. starts[i] + counts[i]`` of all rows, one after another."""
    import numpy as np

    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    shift = np.repeat(np.asarray(starts, np.int64) - (ends - counts), counts)
    return np.arange(counts.sum(), dtype=np.int64) + shift


class Places(dict):
    """Gives each distinct string the next number."""

    def __missing__(self, string: str) -> int:
        self[string] = place = len(self)
        return place

    def of(self, strings):
        """The number of each string."""
        import numpy as np

        return np.fromiter(map(self.__getitem__, strings), np.int64)


class PieceStore:
    """Ids of distinct pieces, kept for one task; forgets all when it grows too large.

    ``encode`` turns a list of unseen pieces into (flat ids, counts).
    """

    def __init__(self, encode, most: int = 400_000):
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self):
        import numpy as np

        self.index, self.ids, self.used = Places(), np.empty(1 << 20, np.uint32), 0
        self.start, self.count = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def _add(self, old: int):
        """Encodes the pieces that came to the index after the first ``old`` ones."""
        import numpy as np

        new = len(self.index)
        flat, counts = self.encode(list(islice(reversed(self.index), new - old))[::-1])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while new > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.count = np.concatenate([self.count, np.empty_like(self.count)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[old:new] = self.used + np.cumsum(counts) - counts
        self.count[old:new] = counts
        self.used += len(flat)

    def lookup(self, pieces: list[str]):
        """(flat ids, ids per piece) of a list of pieces."""
        if len(self.index) > self.most or self.used > 16 * self.most:
            self._forget()
        old = len(self.index)
        rows = self.index.of(pieces)
        if len(self.index) > old:
            self._add(old)
        counts = self.count[rows]
        return self.ids[ragged(self.start[rows], counts)], counts


def per_text(counts_per_piece, pieces_per_text):
    """Ids per text from ids per piece."""
    import numpy as np

    ends = np.concatenate([[0], np.cumsum(counts_per_piece)])
    at = np.concatenate([[0], np.cumsum(pieces_per_text)])
    return ends[at[1:]] - ends[at[:-1]]
