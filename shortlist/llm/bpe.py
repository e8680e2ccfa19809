"""BPE encoding by speculation: propose tokens fast, verify pairs, merge only failures.

A greedy longest match proposes the tokens of every distinct word. A proposal equals
the result of BPE if each token encodes to itself and every adjacent pair of tokens
stays apart, that is, no merge across their border comes before the merges that made
them. All pairs of a batch are tested at once on arrays; words that fail are merged
exactly, in order of rank.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

from shortlist.llm.pretokens import WHOLE, PieceStore, cutter_for, per_text, slices

NEVER = 1 << 40


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordBpe:
    """A BPE model with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            text = file.read()
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.cutter = cutter_for(text)
        if not self.suffix or model.get("byte_fallback") or model.get("unk_token") or self.cutter is None:
            raise ValueError("not a byte-level BPE file with word ends")
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.strings = [""] * size
        for token, i in chain(self.vocab.items(), self.special.items()):
            self.strings[i] = token
        self.steps = Tokenizer.from_str(text)  # its normalizer and pre-tokenizer only
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_at = re.compile("|".join(map(re.escape, by_length)) or r"(?!)")
        self.chars = {b: c for b, c in byte_chars().items()}
        self.merge = {}
        rank = np.full(size, -1, np.int64)
        left, right = np.arange(size), np.arange(size)
        made = np.zeros(size, np.int64)
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge[x, y] = (r, z)
            made[z] += 1
            if made[z] == 1:
                rank[z], left[z], right[z] = r, x, y
        self.rank, self.left, self.right, self.size = rank, left, right, size
        keys = np.array([a * size + b for a, b in self.merge], np.int64)
        ranks = np.array([r for r, _ in self.merge.values()], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        self._find_sound_tokens(made)
        self.whole, self.inner, self.longest = {}, {}, {}
        for token, i in self.vocab.items():
            if token.endswith(self.suffix):
                self.whole[token.removesuffix(self.suffix)] = i
            else:
                self.inner[token] = i
                key = token[:2]
                self.longest[key] = max(self.longest.get(key, 1), len(token))
        if any(c not in self.inner or c not in self.whole for c in self.chars.values()):
            raise ValueError("the vocabulary lacks a byte")
        self.longest_whole = max(map(len, self.whole))
        self.store = PieceStore(self._encode)

    def _find_sound_tokens(self, made):
        """``sound``: tokens made in one way, from sound parts, that encode to themselves."""
        import numpy as np

        own = self.rank >= 0
        # Ranks must rise from parts to wholes, or the order of merges is not the rank.
        rising = (self.rank[self.left] < self.rank) & (self.rank[self.right] < self.rank) | ~own
        keeps = np.ones(self.size, bool)
        made_of = np.flatnonzero(own)
        keeps[made_of] = self.stay_apart(self.left[made_of], self.right[made_of], own_merge=True)
        sound = (rising & keeps & (made <= 1)).tolist()
        for i in made_of[np.argsort(self.rank[made_of])].tolist():
            sound[i] = sound[i] and sound[self.left[i]] and sound[self.right[i]]
        self.sound = np.array(sound)

    def _rank_of(self, a, b):
        import numpy as np

        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def stay_apart(self, a, b, own_merge: bool = False):
        """Whether no merge joins the neighbours ``a`` and ``b`` while they are being made.

        Goes back in time: the younger of the two tokens at the border was made last;
        its merge is the deadline that a merge across the border had to miss.
        ``own_merge``: the pair itself may merge in the end.
        """
        import numpy as np

        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        deadline = np.full(len(a), -1 if own_merge else NEVER)
        while len(at):
            joins = self._rank_of(a, b) < deadline
            ok[at[joins]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~joins & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            # Equal merges run from the left, so the right one was the last.
            undo_b = rb >= ra
            deadline = np.where(undo_b, rb + 1, ra)
            a, b = np.where(undo_b, a, self.right[a]), np.where(undo_b, self.left[b], b)
        return ok

    def propose(self, word: str) -> list[int]:
        """Longest tokens from the left; the last one carries the word end."""
        out, at, n = [], 0, len(word)
        while True:
            # A rest longer than any token is no token, and hashing it would cost its length.
            i = self.whole.get(word[at:]) if n - at <= self.longest_whole else None
            if i is not None:
                out.append(i)
                return out
            end = min(n - 1, at + self.longest.get(word[at : at + 2], 1))
            while (i := self.inner.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end

    def merge_exactly(self, word: str) -> list[int]:
        """BPE in order of (rank, position), on a linked list of symbols."""
        ids = [self.inner[c] for c in word[:-1]] + [self.whole[word[-1]]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if hit := self.merge.get((ids[i], ids[i + 1])):
                heap.append((hit[0], i, ids[i], ids[i + 1], hit[1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = z, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if hit := self.merge.get((z, ids[after[i]])):
                    heapq.heappush(heap, (hit[0], i, z, ids[after[i]], hit[1]))
            if (p := before[i]) >= 0 and (hit := self.merge.get((ids[p], z))):
                heapq.heappush(heap, (hit[0], p, ids[p], z, hit[1]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]):
        """(flat ids, counts) of words in the vocabulary's characters."""
        import numpy as np

        found = [self.propose(w) for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
        word = np.repeat(np.arange(len(words)), counts)
        good = np.ones(len(words), bool)
        good[word[~self.sound[flat]]] = False
        same = np.flatnonzero(word[1:] == word[:-1])
        pairs, where = np.unique(flat[same] * self.size + flat[same + 1], return_inverse=True)
        apart = self.stay_apart(pairs // self.size, pairs % self.size)[where]
        good[word[same[~apart]]] = False
        if not good.all():
            for i in np.flatnonzero(~good).tolist():
                found[i] = self.merge_exactly(words[i])
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
        return flat, counts

    def _shown(self, piece: str) -> str:
        if piece.isascii() and piece.isalnum():
            return piece
        return "".join(map(self.chars.__getitem__, piece.encode()))

    def _words_of_text(self, text: str) -> list:
        """Words of any text, by the file's own steps; special tokens as their ids."""
        out, at = [], 0
        for hit in self.special_at.finditer(text):
            out += self._steps(text[at : hit.start()])
            out.append(self.special[hit[0]])
            at = hit.end()
        return out + self._steps(text[at:])

    def _steps(self, text: str) -> list[str]:
        plain = self.steps.normalizer.normalize_str(text)
        return [w for w, _ in self.steps.pre_tokenizer.pre_tokenize_str(plain)] if plain else []

    def _encode(self, pieces: list[str]):
        import numpy as np

        parts = [
            self._words_of_text(p[len(WHOLE) :]) if p.startswith(WHOLE) else [self._shown(p)] for p in pieces
        ]
        flat_parts = list(chain.from_iterable(parts))
        words = [w for w in flat_parts if isinstance(w, str)]
        flat, counts = self.encode_words(words)
        if len(words) < len(flat_parts):
            is_word = np.array([isinstance(w, str) for w in flat_parts])
            n = np.ones(len(flat_parts), np.int64)
            n[is_word] = counts
            out = np.empty(int(n.sum()), np.int64)
            inside = np.repeat(is_word, n)
            out[inside] = flat
            out[~inside] = [w for w in flat_parts if not isinstance(w, str)]
            flat, counts = out, n
        return flat, per_text(counts, np.fromiter(map(len, parts), np.int64, len(parts)))

    def encode(self, texts: list[str]):
        """Yields (flat ids, ids per text) for runs of texts, in order."""
        import numpy as np

        for run in slices(texts):
            pieces, sizes = [], []
            for text in run:
                got = self.cutter.cut(text)
                pieces += got
                sizes.append(len(got))
            flat, counts = self.store.lookup(pieces)
            yield flat, per_text(counts, np.array(sizes, np.int64))

    def decode(self, ids: list[int]) -> str:
        """The tokens one after another, parted by blanks: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))
