"""Personal data in documents: exact patterns, made consistent by a skip-chain field.

Base spans come from fixed patterns. The tokens of a document that hold a digit or an
``@`` are then nodes of a conditional random field over the labels none, email, ip,
card and phone. Tokens of base spans are observed. A node's potential comes from its
shape and, with those of neighbouring tokens, is counted over all texts. Tokens that
repeat each other (same text without marks, same digits, an address and its name) are
joined however far apart they are, through one hub per group, so a group of any size
costs one edge a token. Numbers written in groups are compared by their joined digits,
with and without country code: the hub of a phone or card that a base span shows has
that span's label, and takes in the tokens of each run of number tokens with its digits.
Loopy message passing gives each token's label; a token counts
as found if its label is likely and is that of an observed token of its group, or if it
continues such a token. Found tokens become spans beside the base spans.

Nulls: a null text is empty. A null ``doc_id`` stays null; repeated rows are searched
one by one; an empty table gives an empty one; other columns are kept where the
operator adds columns and ignored where it returns spans.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from itertools import chain as chained

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
SKIP, LIKELY, ROUNDS = 5.0, 0.8, 12
# Seven equal digits in a row or more are the same number, as surely as a base span is one.
SAME_NUMBER, LEAST_DIGITS, MOST_DIGITS = 30.0, 7, 19

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match of digits can only begin where a run of digits begins.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile("[0-9@]")
_TOKEN = re.compile(r"\S+")
_MARKS = "\"'.,;:!?()[]{}<>"
_DIGITS = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Matches from left to right; each ``@`` is looked at once, from its name leftwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        hit = _DOMAIN.match(text, at + 1) if start < at else None
        if hit:
            yield start, hit.end()
            done = hit.end()
        at = text.find("@", max(at + 1, done))


def _ips(text):
    for m in _IP.finditer(text):
        # Longer parts without their zeros are above 255 too; int() need not see them.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text):
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text):
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all base spans, in order."""
    if not _ANY.search(text):
        return []
    found = [(a, k, b) for k, f in enumerate((emails, _ips, _cards, _phones)) for a, b in f(text)]
    return sorted(found)


def tokens_of(text: str, spans) -> list[tuple[int, int, int]]:
    """(start, end, label) of tokens with a digit or ``@``; label 0 is none, else kind + 1.

    Base spans bound tokens: what of a run lies inside one has its label.
    """
    out, i = [], 0
    for m in _TOKEN.finditer(text):
        at, end = m.span()
        while i < len(spans) and spans[i][2] <= at:
            i += 1
        j = i
        while at < end:
            while j < len(spans) and spans[j][2] <= at:
                j += 1
            if j < len(spans) and spans[j][0] <= at:
                stop, label = min(end, spans[j][2]), spans[j][1] + 1
            else:
                stop, label = (min(end, spans[j][0]) if j < len(spans) else end), 0
            if label or _ANY.search(text, at, stop):
                out.append((at, stop, label))
            at = stop
    return out


def shape(token: str) -> str:
    """A coarse class of a token: a few hundred in all."""
    digits = min(sum(c.isdigit() for c in token), 16)
    marks = "".join(c for c in "@+(.-" if c in token)
    return f"{digits}{marks}{'a' if any(c.isalpha() for c in token) else ''}"


def keys_of(token: str) -> list[str]:
    """What two tokens must share to be taken for repeats of each other."""
    bare = token.strip(_MARKS).casefold()
    keys = []
    if len(bare) >= 6:
        keys.append("t" + bare)
        if "@" in bare and len(name := bare.partition("@")[0]) >= 6:
            keys.append("t" + name)
    digits = "".join(c for c in bare if c in "0123456789")
    if len(digits) >= 7 and not any(c.isalpha() for c in bare):
        keys.append("d" + digits)
    return keys


def number_keys(kind: int, number: str) -> set[str]:
    """Digits, without leading zeros, that a repeat of an observed phone or card may have."""
    groups = _DIGITS.findall(number)
    whole = "".join(groups)
    if KINDS[kind] == "card":
        return {whole.lstrip("0")}
    if len(groups[0]) <= 3:
        code, tails = groups[0], ["".join(groups[i:]) for i in range(1, len(groups))]
        tails.append(code + tails[0].lstrip("0") if tails else "")  # without the zero of "+49 (0)30"
    else:
        tails = [whole[i:] for i in (1, 2, 3)]  # the code is written together with the rest
    keys = {digits.lstrip("0") for digits in (whole, *tails)}
    return {digits for digits in keys if len(digits) >= LEAST_DIGITS}


def numbers_of(text: str, base, tokens) -> list[tuple[set[int], list[int]]]:
    """Kinds and tokens of each observed phone or card that is met again in other tokens."""
    kinds, members = defaultdict(set), defaultdict(set)
    starts = [t[0] for t in tokens]
    for at, kind, end in base:
        if KINDS[kind] in ("card", "phone"):
            inside = range(bisect_left(starts, at), bisect_left(starts, end))
            for key in number_keys(kind, text[at:end]):
                kinds[key].add(kind + 1)
                members[key].update(inside)
    if not kinds:
        return []
    # The digits of tokens that may be groups of a number; of others, and of observed ones, none.
    digits, joined, met = [], [], set()
    for i, (at, end, label) in enumerate(tokens):
        token = text[at:end]
        plain = not label and "@" not in token and not any(c.isalpha() for c in token)
        digits.append("".join(_DIGITS.findall(token)) if plain else "")
        joined.append(i > 0 and not text[tokens[i - 1][1] : at].strip(" \t\r\n\xa0()-./"))
    for i in range(len(tokens)):
        run, j = digits[i].lstrip("0"), i
        # Each further token adds a digit or more, so a run has few tokens.
        while run and len(run) <= MOST_DIGITS:
            if run in kinds:
                met.add(run)
                members[run].update(range(i, j + 1))
            j += 1
            if j == len(tokens) or not joined[j] or not digits[j]:
                break
            run += digits[j]
    return [(kinds[key], sorted(members[key])) for key in sorted(met)]


def _counter(batches):
    """Counts of shapes by label, and of labels of neighbouring tokens."""
    import pyarrow as pa

    counts = defaultdict(int)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            last = None
            for at, end, label in tokens_of(text, base_spans(text)):
                counts["s" + shape(text[at:end]), label] += 1
                if last is not None and at - last[0] <= 1:
                    counts[f"n{last[1]}", label] += 1
                last = end, label
    rows = [(k, v, n) for (k, v), n in counts.items()]
    columns = [[r[i] for r in rows] for i in range(3)]
    yield pa.record_batch(
        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()))], names=["what", "label", "n"]
    )


def fit(docs: DataFrame) -> dict[str, list[float]]:
    """Log-potentials by shape and by left label, fitted on all texts."""
    texts = docs.where(F.col("text").rlike("[0-9@]")).select("text")
    counted = texts.mapInArrow(_counter, "what string, label int, n long")
    # A few hundred shapes times five labels.
    rows = counted.groupBy("what", "label").agg(F.sum("n").alias("n")).collect()
    table = defaultdict(lambda: [1.0, 0.2, 0.2, 0.2, 0.2])
    for r in rows:
        table[r["what"]][r["label"]] += r["n"]
    return {k: [math.log(x / sum(v)) for x in v] for k, v in table.items()}


def _messages(unary, chain, groups, pair, hubs):
    """Label probabilities of all nodes by loopy message passing, ``ROUNDS`` damped rounds.

    ``chain``: the right nodes of neighbours (i - 1, i) with potentials ``pair``;
    ``groups``: arrays of node, hub and strength; ``hubs``: the hubs' own potentials.
    All neighbours share one matrix, and an edge to a hub only favours equal labels, so a
    message costs five numbers and no edge has a matrix of its own.
    """
    import numpy as np

    def scaled(cavity):
        return np.exp(cavity - cavity.max(1, keepdims=True))

    def passed(cavity, kernel):
        out = np.log(scaled(cavity) @ kernel)
        return out - out.max(1, keepdims=True)

    def agreed(cavity):
        p = scaled(cavity)
        out = np.log(p.sum(1, keepdims=True) + p * gain)
        return out - out.max(1, keepdims=True)

    def summed(at, messages, n):
        return np.stack([np.bincount(at, m, n) for m in messages.T], 1)

    node, hub, strength = groups
    gain, kernel = np.expm1(strength)[:, None], np.exp(pair)
    right, left, up, down = (np.zeros((len(at), 5)) for at in (chain, chain, node, node))
    belief, held = unary, hubs
    for _ in range(ROUNDS):
        right, left, up, down = (
            0.5 * right + 0.5 * passed(belief[chain - 1] - left, kernel),
            0.5 * left + 0.5 * passed(belief[chain] - right, kernel.T),
            0.5 * up + 0.5 * agreed(belief[node] - down),
            0.5 * down + 0.5 * agreed(held[hub] - up),
        )
        belief = unary + summed(node, down, len(unary))
        belief[chain] += right
        belief[chain - 1] += left
        held = hubs + summed(hub, up, len(hubs))
    p = scaled(belief)
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base, model: dict) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of what the field finds beside the base spans."""
    import numpy as np

    if not base:
        return []  # nothing observed, so nothing to be consistent with
    tokens = tokens_of(text, base)
    members = defaultdict(list)
    for i, (at, end, _) in enumerate(tokens):
        for key in keys_of(text[at:end]):
            members[key].append(i)
    labels = [t[2] for t in tokens]
    shared = [m for m in members.values() if any(labels[i] for i in m) and not all(labels[i] for i in m)]
    numbers = numbers_of(text, base, tokens)
    if not shared and not numbers:
        return []
    flat = [math.log(0.96)] + [math.log(0.01)] * 4
    unary = np.array([model.get("s" + shape(text[a:b]), flat) for a, b, _ in tokens])
    seen = np.array(labels) > 0
    unary[seen] = -30
    unary[seen, np.array(labels)[seen]] = 0
    chain = np.array([i for i in range(1, len(tokens)) if tokens[i][0] - tokens[i - 1][1] <= 1], np.int64)
    pair = np.array([model.get(f"n{k}", flat) for k in range(5)])
    met = [*shared, *(m for _, m in numbers)]
    sizes = np.array([len(m) for m in met], np.int64)
    strengths = np.repeat([SKIP, SAME_NUMBER], [len(shared), len(numbers)])
    node = np.fromiter(chained.from_iterable(met), np.int64, int(sizes.sum()))
    groups = node, np.repeat(np.arange(len(met)), sizes), np.repeat(strengths, sizes)
    hubs = np.zeros((len(shared) + len(numbers), 5))
    for hub, (kinds, _) in zip(hubs[len(shared) :], numbers):
        hub[[k for k in range(5) if k not in kinds]] = -1e9  # however many repeats say otherwise
    p = _messages(unary, chain, groups, pair, hubs)
    label = [0] * len(tokens)
    for kinds, m in [({labels[i] for i in m} - {0}, m) for m in shared] + numbers:
        for i in m:
            best = int(p[i].argmax())
            if not labels[i] and best in kinds and p[i, best] >= LIKELY:
                label[i] = best
    # Neighbours continue a found token if the field says so.
    leftwards = ((j, j - 1) for j in chain[::-1].tolist())
    for i, j in chained(leftwards, ((i - 1, i) for i in chain.tolist())):
        if label[i] and not label[j] and not labels[j] and p[j].argmax() == label[i] and p[j, label[i]] >= LIKELY:
            label[j] = label[i]
    out = []
    for (at, end, _), k in zip(tokens, label):
        if not k:
            continue
        while at < end and text[at] in _MARKS:
            at += 1
        while end > at and text[end - 1] in _MARKS:
            end -= 1
        if out and out[-1][1] == k - 1 and at - out[-1][2] <= 2:
            out[-1] = (out[-1][0], k - 1, end)
        elif at < end:
            out.append((at, k - 1, end))
    return out


def redact(text: str, spans) -> str:
    """The text with each stretch of spans replaced by its first kind's name."""
    parts, done = [], 0
    for at, kind, end in spans:
        if at >= done:
            parts += [text[done:at], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def _finder(model: dict, with_text: bool):
    def find(texts):
        import pandas as pd

        spans, clean = [], []
        for text in texts:
            base = base_spans(text)
            both = sorted([(*s, True) for s in base] + [(*s, False) for s in added_spans(text, base, model)])
            spans.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in both])
            clean.append(redact(text, [s[:3] for s in both]) if with_text else None)
        return pd.DataFrame({"spans": spans, "redacted": clean})

    return find


def personal_data(text: Column, model: dict, with_text: bool = False) -> Column:
    """A struct of ``spans``, in order, and the ``redacted`` text (null unless asked for)."""
    find = F.pandas_udf(_finder(model, with_text), f"spans {SPANS}, redacted string")
    return find(F.coalesce(text, F.lit("")))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
