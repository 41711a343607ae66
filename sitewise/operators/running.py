"""Running totals, ranks and exact percentiles of whole tables without sending them through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stored import stored

#: Rows a task sorts at most, but for the unevenness of sampled range bounds.
ROWS = 1_000_000
COLLECTED = 10_000


def running_totals(df: DataFrame, order: str, ties: list[str], values: dict[str, Column], descending: bool = True) -> DataFrame:
    """``df`` with, for each name, the sum of its value over this row and all before it in order of ``order``, then ``ties``.

    Up to ``ROWS`` rows are one sorted range.  More are dealt to ranges of
    (``order``, ``ties``), as many as the rows need, so rows of one order value
    are split by their ties; sums run inside each range, and the totals of the
    ranges before it, one row a range, are joined.  The ranges are stored, as
    two parts of the plan must see the same.  Rows whose order value is null
    come last.
    """
    key = F.col(order).cast("double") * (-1 if descending else 1)
    place = [F.col("_k").asc_nulls_last(), *(F.col(t).asc() for t in ties)]
    rows = df.select("*", *(v.alias(f"_v_{n}") for n, v in values.items()), key.alias("_k"))
    n_ranges = -(-df.count() // ROWS)
    if n_ranges <= 1:
        rows = rows.withColumn("_range", F.lit(0))
    else:
        rows = stored(rows.repartitionByRange(n_ranges, *place).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    sums = {n: F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values}
    if n_ranges <= 1:
        return rows.select(*df.columns, *(c.alias(n) for n, c in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values))
    before = totals.select("_range", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values))
    summed = rows.select("*", *(c.alias(f"_s_{n}") for n, c in sums.items())).join(before, "_range")
    return summed.select(*df.columns, *((F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in values))


def ranked(df: DataFrame, order: str, ties: list[str], name: str = "rank", descending: bool = True) -> DataFrame:
    """``df`` with each row's number, from 1, in that order."""
    return running_totals(df, order, ties, {name: F.lit(1)}, descending)


def percentile(df: DataFrame, column: str, p: float = 0.5) -> float | None:
    """Exact percentile, linearly interpolated, of non-null values.

    Approximate quantiles narrow the interval that holds the rank, until few
    enough values are left to be sorted on the driver.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = values.count()
    if not n:
        return None

    def at(rank: int) -> float:
        low, high, below = None, None, 0
        rest, size = values, n
        while size > COLLECTED:
            q = (rank - below) / max(1, size - 1)
            a, b = rest.approxQuantile("v", [max(0.0, q - 0.02), min(1.0, q + 0.02)], 0.005)
            low, high = max(a, low) if low is not None else a, min(b, high) if high is not None else b
            counts = values.agg(F.sum((F.col("v") < low).cast("long")), F.sum(F.col("v").between(low, high).cast("long"))).first()
            if not counts[0] <= rank < counts[0] + counts[1]:  # the estimate missed: fall back to a wider interval
                low, high = values.agg(F.min("v"), F.max("v")).first()
                counts = (0, n)
            if low == high:
                return low
            if counts[1] == size:
                half = (low + high) / 2
                left = values.where(F.col("v").between(low, half)).count()
                low, high = (low, half) if rank < counts[0] + left else (values.where(F.col("v") > half).agg(F.min("v")).first()[0], high)
                counts = values.agg(F.sum((F.col("v") < low).cast("long")), F.sum(F.col("v").between(low, high).cast("long"))).first()
                if low == high:
                    return low
            below, size = counts
            rest = values.where(F.col("v").between(low, high))
        return sorted(r.v for r in rest.collect())[rank - below]

    place = (n - 1) * p
    first = int(place)
    a = at(first)
    return a if first == place else a + (at(first + 1) - a) * (place - first)
