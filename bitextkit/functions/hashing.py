"""Portable pseudo-random keys.

``md5(concat_ws(':', seed, key...))`` orders rows the same way in Spark and in
any SQL engine with ``md5``; ``rand()``/``xxhash64`` do not port.  The key is
a pure function of the row, so task retries and repartitioning never change
a sample, a split or a batch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed, *cols) -> Column:
    """Hex md5 of ``seed:col1:col2...`` (nulls render as empty strings)."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string") if isinstance(c, str)
                                             else c.cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def coin(seed, *cols) -> Column:
    """A fair coin from the first hex digit of :func:`hash_key` (True = heads)."""
    return F.substring(hash_key(seed, *cols), 1, 1) < F.lit("8")
