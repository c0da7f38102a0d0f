"""Places of rows in an order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.sources.store import cut

#: The bits of monotonically_increasing_id() that count within a partition.
WITHIN = 33


def numbered(df: DataFrame, *by: str | Column, name: str = "pos", start: int = 0) -> DataFrame:
    """Adds each row's place in the order of `by`, from start on.

    Ranges of the order lie side by side, each sorted by itself and stored with
    its rows counted off; what earlier ranges hold is added, a number for each
    range. Rows that agree in `by` stay in one range, in any order. Ranges come
    from a sample, for which the rows are made once more unless they are stored.
    """
    rows = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", WITHIN)
    total, before = start, []
    for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        before.append((r["p"], total))
        total += r["n"]
    ends = df.sparkSession.createDataFrame(before, "_p long, _before long")
    inside = F.col("_m").bitwiseAND(F.lit((1 << WITHIN) - 1))
    return rows.join(F.broadcast(ends), part == F.col("_p")).withColumn(name, F.col("_before") + inside).drop("_m", "_p", "_before")
