"""Dense ordinals without a global sort or a single-partition window."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: monotonically_increasing_id() keeps the partition in the bits above these.
_BITS = 33


def dense_ordinals(df: DataFrame, mid: str, out: str, start: int = 0) -> DataFrame:
    """Turns mid, a stored monotonically_increasing_id(), into start, start+1, ... in out.

    df must be stored: mid is computed once, written and read back. What comes to the driver is
    one count a partition, so it is bounded by the number of tasks that wrote the data.
    """
    part = F.shiftright(F.col(mid), _BITS)
    counts = sorted(df.groupBy(part.alias("p")).count().collect())
    offset, rows = start, []
    for p, n in counts:
        rows.append((p, offset))
        offset += n
    spark = df.sparkSession
    offsets = spark.createDataFrame(rows, "_p bigint, _o bigint")
    low = F.col(mid).bitwiseAND(F.lit((1 << _BITS) - 1))
    return df.join(offsets, part == F.col("_p")).withColumn(out, F.col("_o") + low).drop("_p", "_o", mid)
