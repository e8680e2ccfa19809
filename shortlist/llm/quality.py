"""Quality rules with cutoffs that are certified on labelled documents.

Each document gets a few measures; fixed base rules come first. Beyond them, rules with
a cutoff (share of symbols, of repeated lines and words, mean word length) may reject a
document. In each stratum the rules become stricter along one path, cutoff by cutoff;
the stratum's bad documents alone give the order, so the good ones are fresh for the
test. For each point of the path an exact binomial test asks whether all rules together
reject less than ``risk`` of the good documents; testing stops at the first point that
fails, so the path needs no correction, and strata are corrected by Bonferroni. With
probability ``1 - delta``, in every stratum the rules together reject less than ``risk``
of the good documents. Laxer cutoffs than those of the last point that passed reject no
more; among them each rule takes the one that rejects the most further bad documents
for its good ones; the laxest of equals.

Nulls: a null text has no words; a null stratum column is a stratum of its own; labels
that are null, or of unknown documents, are ignored, and a document with several labels
is good if all say so. Rows that repeat a document are judged one by one, but count once
in the test (the row with the least stratum and measures past the base rules). Without
labels only the base rules reject. An empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.pretokens import slices
from shortlist.llm.shingles import repeated_words, word_hashes
from shortlist.llm.storage import new_folder

RISK, DELTA = 0.02, 0.05
GOOD_COST = 20
MAX_SENT_STRATA = 10_000
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
# Cutoffs of each rule from lax to strict, fixed before any label is seen.
GRIDS = {
    "symbols": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2],
    "repeats": [0.19, 0.17, 0.15, 0.13, 0.11, 0.09, 0.07, 0.05],
    "long_words": [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0],
    "short_words": [-1.2, -1.5, -1.8, -2.0, -2.2, -2.5, -2.8, -3.0],
}


def _line_counts(text: str) -> tuple[int, int]:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def measure_texts(texts: list[str]) -> list:
    """The measures of each text, as arrays in the order of ``MEASURES``."""
    import numpy as np

    out = []
    for run in slices(texts):
        hashes, n_words = word_hashes(run)
        chars = [len(t) - sum(map(t.count, SPACES)) for t in run]
        symbols = [sum(map(t.count, SYMBOLS)) for t in run]
        lines = np.array([_line_counts(t) for t in run], np.int64)
        out.append([n_words, chars, symbols, lines[:, 0], lines[:, 1], repeated_words(hashes, n_words)])
    return [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6


def _measures(text: Column) -> Column:
    @F.pandas_udf(MEASURES)
    def measured(texts):
        import pandas as pd

        names = [c.split()[0] for c in MEASURES.split(", ")]
        return pd.DataFrame(dict(zip(names, measure_texts(texts.tolist()))))

    return measured(F.coalesce(text, F.lit("")))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def rule_scores(m: Column) -> dict[str, Column]:
    """The score of each rule; larger is worse."""
    words = F.greatest(m["n_words"], F.lit(1))
    return {
        "symbols": m["n_symbols"] / words,
        "dup_lines": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
        "repeats": m["n_repeat_words"] / words,
        "long_words": m["word_chars"] / words,
        "short_words": -(m["word_chars"] / words),
    }


def with_measures(docs: DataFrame, strata: list[str]) -> DataFrame:
    """Documents with ``quality_measures`` and ``quality_stratum``; columns of these names are replaced."""
    stratum = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in strata)))
    return docs.withColumns({"quality_measures": _measures(F.col("text")), "quality_stratum": stratum})


def store(rows: DataFrame) -> DataFrame:
    """Written once, so that measures are not computed again for each use."""
    folder = new_folder(rows.sparkSession, "measured")
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def at_most_chance(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X; exact up to rounding."""
    if p <= 0 or k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified(good_above: list[int], n_good: int, risk: float, delta: float) -> int:
    """How many cutoffs, from the lax end, pass the test one after another."""
    for j, k in enumerate(good_above):
        # Beyond the risk itself no test can pass, so long sums are never made.
        if n_good == 0 or k >= risk * n_good or at_most_chance(k, n_good, risk) > delta:
            return j
    return len(good_above)


def bad_path(at, n) -> list[list[int]]:
    """Numbers of usable cutoffs of each rule, from lax to strict.

    ``at``: the laxest cutoff of each rule that rejects a bad document; ``n``: how many
    such documents. Each step goes on to the next cutoff that rejects any further
    document, in the rule where these are most.
    """
    now, path = [0] * len(GRIDS), []
    sizes = [len(grid) for grid in GRIDS.values()]
    while len(at):
        nexts = [min(int(column.min()), size) for column, size in zip(at.T, sizes)]
        gains = [int(n[at[:, r] == c].sum()) if c < sizes[r] else 0 for r, c in enumerate(nexts)]
        r = gains.index(max(gains))
        if not gains[r]:
            break
        now = [*now[:r], nexts[r] + 1, *now[r + 1 :]]
        path.append(now)
        left = at[:, r] > nexts[r]
        at, n = at[left], n[left]
    return path


def _choose(risk: float, delta: float):
    def choose(hist):
        import numpy as np
        import pandas as pd

        at, n, is_good = (hist[c].to_numpy() for c in (list(GRIDS), "n", "good"))
        good, n_good, bad, n_bad = at[is_good], n[is_good], at[~is_good], n[~is_good]
        path = bad_path(bad, n_bad)
        rejected = [int(n_good[(good < np.array(point)).any(1)].sum()) for point in path]
        path = path[: certified(rejected, int(n_good.sum()), risk, delta)]
        out = {"quality_stratum": hist["quality_stratum"].iloc[0], "n_good": int(n_good.sum())} | dict.fromkeys(GRIDS)
        # Rules in the order in which the path came to them.
        for r in sorted(range(len(GRIDS)), key=lambda r: sum(not point[r] for point in path)):
            rule, grid = list(GRIDS.items())[r]
            gain = [
                int(n_bad[bad[:, r] <= j].sum()) - GOOD_COST * int(n_good[good[:, r] <= j].sum())
                for j in range(path[-1][r] if path else 0)
            ]
            if gain and max(gain) > 0:
                j = gain.index(max(gain))
                out[rule] = grid[j]
                good, n_good, bad, n_bad = good[s := good[:, r] > j], n_good[s], bad[t := bad[:, r] > j], n_bad[t]
        return pd.DataFrame([out]).astype({r: "float64" for r in GRIDS})

    return choose


def fit_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> tuple[DataFrame, int]:
    """One row per labelled stratum with the cutoff of each rule (null: not used); their number."""
    known = labels.where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg((F.min("quality") >= 1).alias("good"))
    m = F.col("quality_measures")
    rows = measured.where(~base_failed(m)).select("doc_id", "quality_stratum", "quality_measures").join(known, "doc_id")
    # The binomial test needs each labelled document once.
    once = rows.groupBy("doc_id", "good").agg(F.min(F.struct("quality_stratum", "quality_measures")).alias("row"))
    rows = once.select("doc_id", "good", "row.*")
    # The laxest cutoff of each rule that rejects the document; their number if none does.
    at = [
        sum(((score <= cut).cast("int") for cut in GRIDS[rule]), F.lit(0)).alias(rule)
        for rule, score in rule_scores(m).items()
    ]
    # At most 33,660 rows per stratum: a mean word length is at most too long or too short.
    hist = rows.select("quality_stratum", "good", *at).groupBy("quality_stratum", "good", *GRIDS).agg(F.count("*").alias("n"))
    n_strata = rows.select("quality_stratum").distinct().count()
    part = risk, delta / max(n_strata, 1)
    schema = "quality_stratum string, n_good long, " + ", ".join(f"{r} double" for r in GRIDS)
    return hist.groupBy("quality_stratum").applyInPandas(_choose(*part), schema), n_strata


def judge(measured: DataFrame, cutoffs: DataFrame, n_strata: int) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to measured documents."""
    cut = cutoffs.select(
        F.col("quality_stratum").alias("cutoff_of"), F.struct(*GRIDS).alias("quality_cutoffs")
    )
    if n_strata <= MAX_SENT_STRATA:
        cut = F.broadcast(cut)
    rows = measured.join(cut, F.col("quality_stratum") == F.col("cutoff_of"), "left").drop("cutoff_of")
    m = F.col("quality_measures")
    rejected = F.lit(False)
    for rule, score in rule_scores(m).items():
        rejected = rejected | F.coalesce(score > F.col(f"quality_cutoffs.{rule}"), F.lit(False))
    return rows.withColumns({"base_failed": base_failed(m), "kept": ~base_failed(m) & ~rejected}).drop("quality_cutoffs")
