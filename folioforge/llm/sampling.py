"""Bounded samples of labelled or readable rows, for fitting on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def hashed_sample(df: DataFrame, keys: Sequence[str], size: int, n_rows: int) -> list[Row]:
    """The first ``size`` rows of ``df`` in the order of a hash of their keys.

    ``n_rows`` is the number of rows of ``df`` or of a table that it is a part of. A bound on the hash, set so that
    about twice ``size`` of so many rows pass it, comes before the order: what partitions send to the driver doesn't
    grow with their number. Should too few rows pass, the bound is raised, up to all.
    """
    whole = 1 << 40
    place = F.pmod(F.xxhash64(*keys), F.lit(whole))
    share = 2.0 * size / max(n_rows, 1)
    while True:
        part = df if share >= 1 else df.where(place < int(share * whole))
        rows = part.orderBy(place, *keys).limit(size).collect()
        if len(rows) == size or share >= 1:
            return rows
        share *= 4
