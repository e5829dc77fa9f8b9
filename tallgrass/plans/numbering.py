"""Running numbers over an order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.plans.staging import stage


def numbered(df: DataFrame, *by: str, into: str = "number") -> DataFrame:
    """``df`` with ``into``: 1, 2, ... in the order of the columns ``by``.

    Rows are range-partitioned and counted per partition; each partition goes on where those before it end.
    The driver sees one count per partition.
    """
    along = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # The lower 33 bits of the id count the rows of a partition, the upper ones its number.
    placed = stage(along.withColumn("__id", F.monotonically_increasing_id()).select("*", F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__at")).drop("__id"), "numbered")
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "__part long, __before long")
    return placed.join(F.broadcast(offsets), "__part").withColumn(into, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")
