"""Positions under a global order, without a window over the whole table.

Rows are dealt into ranges of the order, one sort in each; a running sum over the sizes of the ranges, one number for each,
makes positions of them. Ranges grow in number with ``spark.sql.shuffle.partitions`` and not in size.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

_IN_RANGE = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column | str], out: str = "position", start: int = 0) -> DataFrame:
    """The rows with their positions (long, from ``start``) under ``order``, ascending columns or sort expressions.

    Rows that agree in all of the order stand in any order among themselves; where many may, end the order with a column
    that tells them apart, as equal rows share a range. The table is read twice (ranges are chosen from a sample of the
    keys) and written once to the shared folder, so a lost executor cannot change a position that was given. An empty
    table gives an empty one.
    """
    spark = df.sparkSession
    taken = {c.lower() for c in df.columns}
    at = "__at"
    while at in taken:
        at = "_" + at
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(at, 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a number for each range
    starts = dict(zip((p for p, _ in sizes), accumulate((m for _, m in sizes[:-1]), initial=start), strict=False))
    first = F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair])[part] if starts else F.lit(start).cast("long")
    return placed.withColumn(out, first + F.col(at).bitwiseAND(F.lit(_IN_RANGE))).drop(at)
