"""The bounded recent-events buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.operators.topk import first_rows

# Buffer capacity and page size.
CAPACITY = 500
PAGE = 100


def append_events(buffer: DataFrame, batch: DataFrame) -> DataFrame:
    """A batch behind the buffer, duplicates kept."""
    return buffer.unionByName(batch)


def recent_events(
    events: DataFrame, order: list[tuple[str, bool]], limit: int = PAGE, capacity: int = CAPACITY
) -> DataFrame:
    """The last ``limit`` buffered events, oldest insertion first.

    ``order`` lists (column, ascending) pairs of insertion order. A limit of 0 returns the whole
    buffer; a negative one leaves out that many events at its start.
    """
    forward = [F.col(name).asc() if up else F.col(name).desc() for name, up in order]
    backward = [F.col(name).desc() if up else F.col(name).asc() for name, up in order]
    kept = first_rows(events, min(limit, capacity) if limit > 0 else capacity, *backward)
    if limit < 0:
        # At most ``capacity`` rows are left here, so one task can number them.
        place = F.row_number().over(Window.orderBy(*forward))
        kept = kept.withColumn("_place", place).filter(F.col("_place") > -limit).drop("_place")
    return kept.orderBy(*forward)
