"""Numbering rows in an order, over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.sources.workdir import stored


def numbered(rows: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Rows with their place from 1 on.

    They are sorted in ranges, one a task, and numbered by the size of the ranges before and the place in their own;
    only the sizes, a number a task, meet in one place.
    """
    at = F.monotonically_increasing_id()
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ranges.withColumns({"_range": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    starts, total = [], 0
    for row in sorted(kept.groupBy("_range").count().collect()):
        starts.append((row["_range"], total))
        total += row["count"]
    first = rows.sparkSession.createDataFrame(starts, "_range bigint, _first bigint")
    place = (F.col("_first") + F.col("_at") + 1).alias(name)
    return kept.join(F.broadcast(first), "_range").select(*rows.columns, place)
