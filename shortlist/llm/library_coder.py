"""Ids of whole texts by the tokenizers library, distinct pieces encoded once a task."""

from __future__ import annotations

import os
from itertools import chain

from shortlist.llm.pretokens import WHOLE, PieceStore, cutter_for, per_text, slices


class LibraryCoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    A piece's ids do not depend on its neighbours, so pieces met before are looked
    up. A tokenizer with other steps than ``pretokens`` knows gets whole texts.
    """

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cutter = cutter_for(self.tokenizer.to_str())
        self.store = PieceStore(self._encode)
        self.size = self.tokenizer.get_vocab_size()
        if self.cutter is None:
            return
        # Where a word begins or ends in a run of joined words shows in its tokens.
        self.joint = " " if self.cutter.lower else ""
        mark = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            mark[i] = token.endswith("</w>") if self.cutter.lower else token.startswith("Ġ")
        self.mark = mark

    def _plain(self, piece: str) -> bool:
        if self.cutter.lower:
            return piece.isalpha()
        return piece[0] == " " and piece[1:].isalpha()

    def _encode_texts(self, texts: list[str]):
        import numpy as np

        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        return flat, counts

    def _encode(self, pieces: list[str]):
        import numpy as np

        is_plain = np.fromiter(map(self._plain, pieces), bool, len(pieces))
        plain = [p for p, yes in zip(pieces, is_plain) if yes]
        other = [p.removeprefix(WHOLE) for p, yes in zip(pieces, is_plain) if not yes]
        runs = [self.joint.join(plain[i : i + 256]) for i in range(0, len(plain), 256)]
        flat, _ = self._encode_texts(runs)
        edge = np.flatnonzero(self.mark[flat])
        if self.cutter.lower:
            counts = np.diff(np.concatenate([[-1], edge]))
        else:
            counts = np.diff(np.concatenate([edge, [len(flat)]]))
        if len(counts) != len(plain):
            raise ValueError("joined words were not cut where they were joined")
        flat2, counts2 = self._encode_texts(other)
        # Back to the order of the pieces.
        at = np.empty(len(pieces), np.int64)
        n = np.empty(len(pieces), np.int64)
        n[is_plain], n[~is_plain] = counts, counts2
        at[is_plain] = np.cumsum(counts) - counts
        at[~is_plain] = len(flat) + np.cumsum(counts2) - counts2
        both = np.concatenate([flat, flat2])
        ends = np.cumsum(n)
        shift = np.repeat(at - (ends - n), n)
        return both[np.arange(len(shift)) + shift], n

    def encode(self, texts: list[str]):
        """Yields (flat uint32 ids, ids per text) for runs of texts, in order."""
        import numpy as np

        for run in slices(texts):
            if self.cutter is None:
                yield self._encode_texts(run)
                continue
            pieces, sizes = [], []
            for text in run:
                got = self.cutter.cut(text)
                pieces += got
                sizes.append(len(got))
            flat, counts = self.store.lookup(pieces)
            yield flat, per_text(counts, np.array(sizes, np.int64))
