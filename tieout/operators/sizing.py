"""Size-checked broadcast.

A side is broadcast only after a bounded check proves it small:
``limit(n + 1).count()`` reads at most ``n + 1`` rows, so the check itself
stays cheap even when the side turns out to be large. Otherwise the join is
left to the planner (shuffle join; AQE may still switch to a broadcast at
run time from measured shuffle sizes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
