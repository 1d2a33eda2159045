"""How a set of readings is spread over tasks, decided from its measured sizes.

Almost every series has tens of results, so a whole series fits in one array of
one row. A series longer than ``LONG_SERIES`` results takes the segmented path
(``long_series``), where no task ever holds more than one segment of it. Which
series are long is read from a per-series count (two columns, combined before
the shuffle), never assumed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtide.operators.normalise import SERIES
from labtide.operators.pair_counts import BLOCK_ROWS
from labtide.operators.segments import SEGMENT_ROWS
from labtide.session import checkpointed

LONG_SERIES = 512
HOT_PATIENT_ROWS = 2_000_000
BROADCAST_KEYS = 20_000


@dataclass(frozen=True)
class Layout:
    """``long_keys`` is null when no series is long; ``broadcastable`` says its size was checked.

    ``segment_rows`` and ``block_rows`` bound what one task holds on the segmented path.
    """

    long_keys: DataFrame | None = None
    long_rows: int = 0
    broadcastable: bool = True
    by_patient: bool = True
    segment_rows: int = SEGMENT_ROWS
    block_rows: int = BLOCK_ROWS

    def _keys(self) -> DataFrame:
        return F.broadcast(self.long_keys) if self.broadcastable else self.long_keys

    def short(self, rows: DataFrame) -> DataFrame:
        return rows if self.long_keys is None else rows.join(self._keys(), SERIES, "left_anti")

    def long(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._keys(), SERIES, "left_semi")


def measure(rows: DataFrame, limit: int = LONG_SERIES) -> Layout:
    """One counting pass over (patient_id, code)."""
    sizes = rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    is_long = F.col("n") > limit
    top = (
        sizes.groupBy("patient_id")
        .agg(
            F.sum(F.when(~is_long, F.col("n"))).alias("short_rows"),
            F.count_if(is_long).alias("long_keys"),
            F.sum(F.when(is_long, F.col("n"))).alias("long_rows"),
        )
        .agg(F.max("short_rows"), F.sum("long_keys"), F.sum("long_rows"))
        .first()
    )
    by_patient = (top[0] or 0) <= HOT_PATIENT_ROWS
    if not top[1]:
        return Layout(by_patient=by_patient)
    return Layout(
        # used several times: keep the list, not the count behind it
        long_keys=checkpointed(sizes.where(is_long).select(*SERIES)),
        long_rows=int(top[2]),
        broadcastable=top[1] <= BROADCAST_KEYS,
        by_patient=by_patient,
    )
