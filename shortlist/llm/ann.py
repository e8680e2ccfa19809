"""Approximate nearest neighbours by inverted lists and an adaptive scan of dimensions.

Vectors are scaled to unit length, rotated by one random rotation and dealt to the list
of their nearest centre. A query visits its nearest lists. Inside a list the columns
are read block by block; after each block a hypothesis test compares the distance so
far, scaled up to all dimensions, with the k-th best distance known, and drops the
candidates that are almost surely farther. Survivors are scored exactly on the original
vectors in double precision.

A list is cut into chunks of bounded size by a hash of ``vec_id``, so a list that holds
a third of all vectors is many tasks; queries go to every chunk of the lists they visit.
The centres are fitted on at most ``SAMPLE`` vectors; every vector is indexed.

Vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do vectors whose length is not the most frequent one (the shortest of such). A
``vec_id`` met in several rows is one candidate, scored by its best row; as a query it
is its smallest vector. Null ``vec_id`` take no part. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.session import materialize

SAMPLE = 20_000
MAX_LISTS = 1024
CHUNK = 4096
BLOCK = 16
EPSILON = 2.1  # the published constant of the test
SLICE = 1024
QUERIES_AT_ONCE = 256
TOLERANCE = 1e-5  # of squared distances in single precision
HITS = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector can take part, whatever its length."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors):
    import numpy as np

    # Divided by the largest component first, so that squares neither vanish nor overflow.
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosines(vectors, queries):
    """Exact cosines in double precision; equal vectors get equal values."""
    import numpy as np

    # Row by row with its own query; each sum runs in the same order.
    v, q = np.asarray(vectors, np.float64), np.asarray(queries, np.float64)
    return (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum(1)))


def fit_centres(vectors, lists: int, rounds: int = 8):
    """Centres of spherical k-means on a bounded sample."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = _unit(np.asarray(vectors, np.float64)).astype(np.float32)
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def rotation(dims: int):
    """A random rotation, the same for each call."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(5).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _part(rows, queries, cols):
    """Squared distances over some columns, each query against each row."""
    a, b = queries[:, cols], rows[:, cols]
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def _bars(bars, owner, far, k: int):
    """The k-th smallest distance of each query so far, if it has k of them."""
    import numpy as np

    order = np.lexsort((far, owner))
    own = owner[order]
    first = np.searchsorted(own, np.arange(len(bars)))
    last = np.searchsorted(own, np.arange(len(bars)), "right")
    full = last - first >= k
    out = bars.copy()
    out[full] = np.minimum(bars[full], far[order][first[full] + k - 1])
    return out


def scan(rotated, queries, k: int):
    """(query, row) pairs of which each query's ``k`` nearest rows are almost surely a part.

    The first rows are read in full and give each query a bar. Of later rows the first
    block of columns is read for all, the next only for the pairs that the test keeps,
    and so on. Pairs as near as the bar are all kept.
    """
    import numpy as np

    n, dims = rotated.shape
    owners, rows, fars = [], [], []
    bars, at, size = np.full(len(queries), np.inf), 0, max(64, 4 * k)
    while at < n:
        part = rotated[at : at + size]
        far = _part(part, queries, slice(0, BLOCK))
        seen = min(BLOCK, dims)
        while True:
            if seen == min(BLOCK, dims):
                q, r = np.nonzero(far * (dims / seen) <= (bars * (1 + EPSILON / np.sqrt(seen)) ** 2 + TOLERANCE)[:, None])
                far = far[q, r]
            else:
                scale = 1 if seen == dims else (1 + EPSILON / np.sqrt(seen)) ** 2
                stay = far * (dims / seen) <= bars[q] * scale + TOLERANCE
                q, r, far = q[stay], r[stay], far[stay]
            if seen == dims or not len(q):
                break
            cols = slice(seen, seen + BLOCK)
            d = part[r, cols] - queries[q, cols]
            far = far + np.einsum("ij,ij->i", d, d)
            seen = min(seen + BLOCK, dims)
        owners.append(q)
        rows.append(r + at)
        fars.append(far)
        bars = _bars(bars, np.concatenate(owners), np.concatenate(fars), k)
        at, size = at + size, SLICE
    q, r, far = (np.concatenate(x) for x in (owners, rows, fars))
    stay = far <= bars[q] + TOLERANCE
    return q[stay], r[stay]


def _lists_of(centres, probes: int):
    """Nearest lists of each vector, nearest first."""

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            x = _unit(flat.reshape(batch.num_rows, -1).astype(np.float64)).astype(np.float32)
            near = x @ centres.T
            m = min(probes, near.shape[1])
            top = np.argsort(-near, axis=1, kind="stable")[:, :m]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, top.size + 1, m), pa.int32()), pa.array(top.ravel(), pa.int32())
            )
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("vector"), lists], names=["vec_id", "vector", "lists"]
            )

    return assign


def _search(k: int):
    turned = {}

    def search(left, right):
        """One chunk of a list against the queries that visit it."""
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        # Equal rows count once, or they would fill the k places of a chunk.
        left = left.assign(key=left["vector"].map(lambda v: v.tobytes()))
        left = left.drop_duplicates(["vec_id", "key"]).sort_values("vec_id", kind="stable")
        ids = left["vec_id"].to_numpy()
        original = np.stack(left["vector"].to_numpy()).astype(np.float64)
        dims = original.shape[1]
        turn = turned.setdefault(dims, rotation(dims))
        rotated = (_unit(original) @ turn).astype(np.float32)
        queries = np.stack(right["vector"].to_numpy()).astype(np.float64)
        rotated_queries = (_unit(queries) @ turn).astype(np.float32)
        asked = right["query_id"].to_numpy()
        # Each id is once in a layer, so that one with many vectors fills one place of each
        # layer's k; an id that is among the k best at all is so in the layer of its best vector.
        layer = left.groupby("vec_id").cumcount().to_numpy()
        order = np.argsort(layer, kind="stable")
        layers = np.split(order, np.cumsum(np.bincount(layer))[:-1])
        out = []
        for first in range(0, len(asked), QUERIES_AT_ONCE):
            some = slice(first, first + QUERIES_AT_ONCE)
            # One more than asked: the query's own id does not count.
            met = [(q, members[r]) for members in layers for q, r in [scan(rotated[members], rotated_queries[some], k + 1)]]
            q, r = (np.concatenate(x) for x in zip(*met))
            q += first
            other = ids[r] != asked[q]
            q, r = q[other], r[other]
            found = pd.DataFrame({"query_id": asked[q], "vec_id": ids[r], "score": cosines(original[r], queries[q])})
            found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
            found = found.drop_duplicates(["query_id", "vec_id"])
            out.append(found.groupby("query_id", sort=False).head(k))
        return pd.concat(out)

    return search


def probes_for(sample, centres, k: int, target: float) -> int:
    """Lists to visit so that ``target`` of the sample's own neighbours are in them."""
    import numpy as np

    x = _unit(np.asarray(sample, np.float64)).astype(np.float32)
    queries = x[:: max(1, len(x) // 512)]
    own = (x @ centres.T).argmax(1)
    near = queries @ x.T
    near[np.arange(len(queries)), np.arange(0, len(x), max(1, len(x) // 512))] = -np.inf
    top = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(queries @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    need = np.take_along_axis(place, own[top], 1).ravel()
    return 1 + int(np.quantile(need, target, method="higher")) if len(need) else 1


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, target: float = 0.96) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), vec_id, score.

    Both tables have ``vec_id`` and ``embedding``; a query never finds its own id. The
    number of lists to visit is fitted on the sample for ``target`` recall.
    """
    spark = vectors.sparkSession

    def clean(df):
        vector = F.transform("embedding", lambda x: x.cast("double"))
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
        return rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))

    rows = clean(vectors)
    sizes = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = sizes
    rows = rows.where(F.size("vector") == dims)
    lists = max(1, min(MAX_LISTS, round(n**0.5)))
    # At most SAMPLE vectors go to the driver.
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    sample = [r.vector for r in chosen.select("vector").collect()]
    centres = fit_centres(sample, min(lists, len(sample)))
    lists = len(centres)
    schema = "vec_id long, vector array<double>, lists array<int>"
    placed = rows.mapInArrow(_lists_of(centres, 1), schema)
    placed = materialize(
        placed.select(
            "vec_id", F.transform("vector", lambda x: x.cast("float")).alias("vector"), F.col("lists")[0].alias("list")
        )
        if _narrow(vectors)
        else placed.select("vec_id", "vector", F.col("lists")[0].alias("list"))
    )
    # One row per list, at most MAX_LISTS.
    chunks = placed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunks = F.broadcast(chunks)
    # By id and vector, so that an id with very many vectors is spread as well.
    chunk = F.pmod(F.xxhash64("vec_id", "vector"), F.col("chunks")).cast("int")
    items = placed.join(chunks, "list").select("list", chunk.alias("chunk"), "vec_id", "vector")
    asked = clean(queries).where(F.size("vector") == dims).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    probes = min(lists, max(8, probes_for(sample, centres, k, target)))
    asked = asked.mapInArrow(_lists_of(centres, probes), schema)
    asked = asked.select(F.col("vec_id").alias("query_id"), "vector", F.explode("lists").alias("list"))
    asked = asked.join(chunks, "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "query_id", "vector")
    hits = items.groupBy("list", "chunk").cogroup(asked.groupBy("list", "chunk")).applyInPandas(_search(k), HITS)
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _narrow(vectors: DataFrame) -> bool:
    """Whether the components are single precision, so that shuffles can stay so."""
    return vectors.schema["embedding"].dataType.elementType.typeName() == "float"
