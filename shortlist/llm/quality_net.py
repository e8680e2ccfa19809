"""Quality scores by random indexing and a small calibrated network.

Every token falls by hash into one of ``BUCKETS`` buckets; a bucket has a fixed sparse
index vector of -1, 0 and 1. Over all texts, a bucket's context vector sums the index
vectors of its neighbours up to ``WINDOW`` places away; scaled to unit length it is the
word vector. A document's features are the mean of its word vectors, the mean weighted
against frequent words, how close each word vector is to the one before (on average,
and how often it is the same), the share of distinct buckets, and its length. A network
of two layers in NumPy learns the label from them; its logits are divided by a
temperature that is fitted on a part of the training rows which the network has not seen.

Bounds: the table of word vectors has ``BUCKETS`` rows of ``DIM`` numbers at any corpus
size and is sent to every task; the network learns from about ``SAMPLE`` documents,
chosen by a hash of the ``doc_id``. All counts cover all texts, whole.

Nulls: a null text is an empty one; empty texts have a score too. A null ``doc_id`` is
scored but never learnt from, and is not held out. Rows that repeat a document are
scored each and learnt from once. A document with several labels is good if all say
so; null labels are ignored. Without labels of both kinds every score is their smoothed
share of good ones. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.pretokens import per_text, ragged, slices
from shortlist.llm.shingles import mix

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BUCKETS, DIM, WINDOW = 1 << 16, 40, 2
RARE = 1e-3
SAMPLE, HIDDEN, FOLDS = 20_000, 24, 5
THRESHOLD = 0.3
_TOKENS_AT_ONCE = 1 << 17
_CHARS = 1 << 20
_MOST_WORDS = 400_000


class TokenBuckets(dict):
    """Buckets of the tokens of distinct words, kept for one task; forgets all when it grows too large."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.flat, self.starts, self.counts = array("q"), array("q"), array("q")

    def __missing__(self, word: str) -> int:
        import xxhash

        got = [xxhash.xxh64_intdigest(t) % BUCKETS for t in TOKEN.findall(word)]
        self[word] = place = len(self.starts)
        self.starts.append(len(self.flat))
        self.counts.append(len(got))
        self.flat.extend(got)
        return place

    def of(self, texts: list[str]):
        """(bucket of every token, tokens per text). No token reaches over white space."""
        import numpy as np

        if len(self) > _MOST_WORDS:
            self._forget()
        words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        places = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        flat, starts, counts = (np.array(x, np.int64) for x in (self.flat, self.starts, self.counts))
        per_word = counts[places]
        return flat[ragged(starts[places], per_word)], per_text(per_word, sizes)


def index_vectors():
    """Sparse rows of -1, 0 and 1, one per bucket, and a row of zeros."""
    import numpy as np

    x = mix(mix(np.arange(1, BUCKETS * DIM + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(8)
    rows = ((x == 0).astype(np.int8) - (x == 1).astype(np.int8)).reshape(BUCKETS, DIM)
    return np.vstack([rows, np.zeros((1, DIM), np.int8)])


def add_contexts(table, counts, index, buckets, sizes) -> None:
    """Adds the neighbours of every token of some texts to its bucket's column of ``table``."""
    import numpy as np

    # Rows of zeros between texts, so that no context reaches into another text.
    ends = np.cumsum(sizes + WINDOW)
    spaced = np.full(int(ends[-1]) + WINDOW if len(ends) else 0, BUCKETS, np.int64)
    places = ragged(ends - sizes, sizes)
    spaced[places] = buckets
    counts += np.bincount(buckets, minlength=BUCKETS)
    for first in range(0, len(places), _TOKENS_AT_ONCE):
        at = places[first : first + _TOKENS_AT_ONCE]
        span = index[spaced[at[0] - WINDOW : at[-1] + WINDOW + 1]]
        size = len(span) - 2 * WINDOW
        context = np.zeros((size, DIM), np.int8)
        for step in range(2 * WINDOW + 1):
            if step != WINDOW:
                context += span[step : step + size]
        mine, columns = spaced[at], np.ascontiguousarray(context[at - at[0]].T)
        for d in range(DIM):
            table[d] += np.bincount(mine, columns[d], BUCKETS).astype(np.int64)


def _context_task(batches):
    import numpy as np

    index, tokens = index_vectors(), TokenBuckets()
    table, counts = np.zeros((DIM, BUCKETS), np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for run in slices(batch.column("text").to_pylist(), _CHARS):
            add_contexts(table, counts, index, *tokens.of(run))
    yield from _table_rows(table.T, counts)


def _table_rows(table, counts):
    """The rows of buckets that have tokens, as one record batch."""
    import numpy as np
    import pyarrow as pa

    used = np.flatnonzero(counts)
    if len(used):
        sums = pa.FixedSizeListArray.from_arrays(table[used].ravel(), DIM).cast(pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(counts[used]), sums], names=["bucket", "n", "sums"])


def _sum_task(batches):
    import numpy as np

    table, counts = np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        at = batch.column("bucket").to_numpy()
        np.add.at(counts, at, batch.column("n").to_numpy())
        np.add.at(table, at, batch.column("sums").flatten().to_numpy().reshape(-1, DIM))
    yield from _table_rows(table, counts)


def context_table(docs: DataFrame) -> DataFrame:
    """(bucket, n, sums): occurrences and context sums over all texts.

    Each task adds up its own texts; sums of a bucket are added where they meet.
    """
    schema = "bucket int, n long, sums array<long>"
    texts = docs.select("text").where("text is not null")
    return texts.mapInArrow(_context_task, schema).repartition("bucket").mapInArrow(_sum_task, schema)


@dataclass(frozen=True)
class WordVectors:
    """Unit vector and weight of each bucket."""

    vectors: object
    weights: object

    @staticmethod
    def of(table: DataFrame) -> WordVectors:
        """From ``context_table``; its at most ``BUCKETS`` rows come to the driver."""
        import numpy as np

        rows = table.toArrow()
        sums, counts = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
        at = rows["bucket"].to_numpy()
        if len(at):
            sums[at] = rows["sums"].combine_chunks().flatten().to_numpy().reshape(-1, DIM)
            counts[at] = rows["n"].to_numpy()
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        unit = sums / np.where(length > 0, length, 1)
        share = counts / max(counts.sum(), 1)
        # Without what all words share, so that frequent neighbours do not decide.
        unit -= share @ unit
        return WordVectors(unit.astype(np.float32), (RARE / (RARE + share)).astype(np.float32))

    def features(self, texts: list[str], tokens: TokenBuckets):
        """One row of features per text; zeros if it has no tokens."""
        import numpy as np

        buckets, sizes = tokens.of(texts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.zeros((len(sizes), 2, DIM))
        total, close, same = (np.zeros(len(sizes)) for _ in range(3))
        for first in range(0, len(buckets), _TOKENS_AT_ONCE):
            part = slice(first, first + _TOKENS_AT_ONCE)
            mine, vectors = owner[part], self.vectors[buckets[part]]
            weight = np.stack([np.ones(len(mine), np.float32), self.weights[buckets[part]]])
            edges = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1], [True]]))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                sums[mine[low]] += weight[:, low:high] @ vectors[low:high]
            total += np.bincount(mine, weight[1], len(sizes))
            before = np.maximum(np.arange(first, first + len(mine)) - 1, 0)
            # The first token of a text has none before it.
            follows = (owner[before] == mine) & (np.arange(first, first + len(mine)) > 0)
            dots = np.einsum("ij,ij->i", vectors, self.vectors[buckets[before]])
            close += np.bincount(mine, dots * follows, len(sizes))
            same += np.bincount(mine, follows & (buckets[before] == buckets[part]), len(sizes))
        places = np.sort(owner * BUCKETS + buckets)
        first_of = np.concatenate([places[:1] >= 0, places[1:] != places[:-1]])
        distinct = np.bincount(places[first_of] // BUCKETS, minlength=len(sizes))
        n = np.maximum(sizes, 1)
        plain, weighted = sums[:, 0] / n[:, None], sums[:, 1] / np.maximum(total, 1e-9)[:, None]
        return np.hstack([plain, weighted, np.stack([close / n, same / n, distinct / n, np.log1p(sizes)], 1)])


@dataclass(frozen=True)
class Network:
    """Two layers; without weights the score is the same for all texts."""

    base: float
    weights: tuple | None = None
    temperature: float = 1.0

    def logits(self, x):
        import numpy as np

        mean, scale, w1, b1, w2, b2 = self.weights
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def scores(self, x):
        import numpy as np

        if self.weights is None:
            return np.full(len(x), self.base)
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z):
    import numpy as np

    return 0.5 * (1 + np.tanh(z / 2))


def _loss(z, y) -> float:
    import numpy as np

    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x, y, rounds: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4):
    """Weights of a network by Adam on shuffled batches; the same for the same rows."""
    import numpy as np

    rng = np.random.default_rng(12)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for step in range(rounds):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            at = order[k : k + batch]
            hidden = np.tanh(x[at] @ w[0] + w[1])
            error = (_sigmoid(hidden @ w[2] + w[3]) - y[at]) / len(at)
            back = error[:, None] * w[2] * (1 - hidden**2)
            slopes = [x[at].T @ back + decay * w[0], back.sum(0), hidden.T @ error + decay * w[2], error.sum(keepdims=True)]
            t += 1
            now = rate * (1 - step / rounds)
            for p, m, v, g in zip(w, first, second, slopes):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return (mean, scale, *w)


def calibrated(network: Network, x, y) -> float:
    """The temperature with the least loss on rows that the network has not seen."""
    import numpy as np

    z = network.logits(x)
    grid = np.exp(np.linspace(np.log(0.2), np.log(20.0), 93))
    return float(min(grid, key=lambda t: _loss(z / t, y)))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _features(batches, sent):
    import pyarrow as pa

    tokens = TokenBuckets()
    for batch in batches:
        done = 0
        for run in slices(batch.column("text").to_pylist(), _CHARS):
            x = sent.value.features(run, tokens)
            columns = [c.slice(done, len(run)) for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
            rows = pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*columns, rows], names=["doc_id", "good", "x"])
            done += len(run)


def _scores(batches, sent):
    import numpy as np
    import pyarrow as pa

    tokens, (words, network) = TokenBuckets(), sent.value
    for batch in batches:
        done = 0
        for run in slices(batch.column("text").to_pylist(), _CHARS):
            score = np.clip(network.scores(words.features(run, tokens)), 0.0, 1.0)
            yield pa.record_batch([batch.column("doc_id").slice(done, len(run)), pa.array(score)], names=["doc_id", "score"])
            done += len(run)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of the documents that may be learnt from, once each."""
    known = labels.where("doc_id is not null and quality is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") >= 1).alias("good"))
    return known.where(fold_of(F.col("doc_id")) != 0)


def fit_network(docs: DataFrame, labels: DataFrame, words, sample: int = SAMPLE) -> Network:
    """Network of about ``sample`` labelled documents of the folds that are not held out."""
    import numpy as np

    known = labelled(labels)
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(min(1.0, sample / max(n, 1)) * (1 << 32)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # About ``sample`` pairs of an id and a flag: bounded, so sent to the documents.
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "text")
    rows = rows.mapInArrow(lambda b: _features(b, words), "doc_id long, good boolean, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "good")).alias("row"))
    found = rows.select(fold_of(F.col("doc_id")).alias("fold"), "row.*").orderBy("doc_id").toArrow()
    good = found["good"].to_numpy(zero_copy_only=False).astype(float)
    base = float((good.sum() + 1) / (len(good) + 2))
    fold = found["fold"].to_numpy()
    if not len(good) or min(good[fold > 1].sum(), (1 - good[fold > 1]).sum()) == 0:
        return Network(base)
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(len(good), -1)
    network = Network(base, train(x[fold > 1], good[fold > 1]))
    if not (fold == 1).any():
        return network
    return Network(base, network.weights, calibrated(network, x[fold == 1], good[fold == 1]))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    context = docs.sparkSession.sparkContext
    words = WordVectors.of(context_table(docs))
    sent = context.broadcast((words, fit_network(docs, labels, context.broadcast(words), sample)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.mapInArrow(lambda b: _scores(b, sent), "doc_id long, score double")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
