"""Joins that Spark has no operator for: values with intervals, and rows with rows by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: An interval is taken to be at least so wide in proportion to its place, so that cells have numbers.
_NARROW = 2.0**-30
_FAR = float(1 << 62)


def _cell(value: Column, size: Column) -> Column:
    place = value / size
    return F.when(F.abs(place) < _FAR, F.floor(place))


def range_join(df: DataFrame, value: str, intervals: DataFrame, low: str, high: str, closed: str = "left") -> DataFrame:
    """Rows of df with each interval that holds their value: any number of intervals, with gaps and overlaps.

    closed says which ends belong to an interval: left, right, both or neither. A null end is open without limit; null
    and NaN values are in no interval. An interval is dealt to the one or two cells of the grid whose cells are about
    as wide as it is; a value looks in one cell of each grid in use, at most some dozens, and the ends are tested after.
    """
    if closed not in ("left", "right", "both", "neither"):
        raise ValueError(f"closed cannot be {closed}")
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v))
    least, most = rows.agg(F.min(v), F.max(v)).first()
    if least is None:
        return rows.join(intervals, F.lit(False))
    a, b = F.col(low).cast("double"), F.col(high).cast("double")
    from_, to = F.greatest(F.coalesce(a, F.lit(least)), F.lit(least)), F.least(F.coalesce(b, F.lit(most)), F.lit(most))
    ends = intervals.withColumns({"_from": from_, "_to": to}).where("_from <= _to")
    width = F.greatest(F.col("_to") - F.col("_from"), _NARROW * F.greatest(F.abs("_from"), F.abs("_to"), F.lit(1.0)))
    ends = stored(ends.withColumn("_size", F.pow(F.lit(2.0), F.ceil(F.log2(width)))), "intervals")
    sizes = [r["_size"] for r in ends.select("_size").distinct().collect()]  # a power of two each: at most some dozens
    dealt = ends.withColumn("_cell", F.explode(F.array_distinct(F.array(_cell(F.col("_from"), F.col("_size")), _cell(F.col("_to"), F.col("_size"))))))
    looks = rows.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)))) if sizes else rows.withColumn("_size", F.lit(1.0)).where("false")
    looks = looks.withColumn("_cell", _cell(v, F.col("_size")))
    above = (v >= a) if closed in ("left", "both") else (v > a)
    below = (v <= b) if closed in ("right", "both") else (v < b)
    found = looks.join(dealt, ["_size", "_cell"]).where((F.col(low).isNull() | above) & (F.col(high).isNull() | below))
    return found.drop("_size", "_cell", "_from", "_to")


def with_row_number(df: DataFrame, order: Sequence[str], out: str = "row_number") -> DataFrame:
    """Add dense numbers from 0 in an order that should be total, without a window over all rows.

    Rows are dealt by ranges of the order and written; a row's number is its place in its range and the rows of the
    ranges before, of which there are as many as partitions.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = stored(dealt.withColumns({"_range": F.shiftright(place, 33), "_place": place.bitwiseAND((1 << 33) - 1)}), "numbered")
    before, starts = 0, []
    for r in sorted(rows.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        starts.append((r["_range"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_range long, _start long")
    return rows.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], out: str = "row_number") -> DataFrame:
    """The n-th row of left with the n-th row of right; tables of unequal length are an error."""
    a, b = with_row_number(left, left_order, out), with_row_number(right, right_order, out)
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows cannot be joined with {m} by position")
    return a.join(b, out)
