"""Join of rows with hot keys to a table with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def spread_join(rows: DataFrame, unique: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join ``rows`` to ``unique`` on a key that may be hot in ``rows``.

    The rows of a key are spread over ``SALTS`` tasks by a hash of the whole row
    (stable under retries), and ``unique`` is repeated that often. Equal rows share a
    salt; a part that is still too large is split by adaptive execution, which can
    split the left side of this join anywhere. Reduce ``unique`` to the keys of
    ``rows`` before. It is never broadcast: estimates do not count the repeats.
    """
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    repeated = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(repeated.hint("merge"), [on, "_salt"], how).drop("_salt")
