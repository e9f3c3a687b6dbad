"""Row numbers over a whole table without putting it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Run

#: Rows of a stretch, about.
STRETCH = 100_000


def numbered(rows: DataFrame, keys: list[str], order: str, name: str = "n", total: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with their number by (order, *ties), from 0 per key, and the key's total. Nulls come first.

    Rows are dealt into ranges of (keys, order, ties) of about STRETCH rows, by a sample of them, and written with
    their range's number; ranges are counted and the counts accumulated, which is a row a range, and rows are put
    in order within their range alone. So neither an outlier nor a time that most rows share puts them into one
    task, as long as ties tell them apart; rows that agree in all of these are numbered in no certain order.
    """
    by = [F.asc_nulls_first(c) for c in (order, *ties)]
    n = rows.count()
    if n <= STRETCH:
        w = Window.partitionBy(*keys)
        out = rows.withColumn(name, F.row_number().over(w.orderBy(*by)).cast("long") - 1)
        return out.withColumn(total, F.count("*").over(w)) if total else out
    ranges = rows.repartitionByRange(-(-n // STRETCH), *[F.asc_nulls_first(k) for k in keys], *by)
    cut = Run(rows.sparkSession, "numbered").put(ranges.withColumn("__s", F.spark_partition_id()), "cut")
    sums = cut.groupBy(*keys, "__s").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__s").alias("__b"), F.coalesce(before, F.lit(0)).alias("__base"), F.sum("__c").over(Window.partitionBy(*keys)).alias("__total"))
    on = F.col("__s") == F.col("__b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    place = F.col("__base") + F.row_number().over(Window.partitionBy(*keys, "__s").orderBy(*by)) - 1
    return cut.join(sums, on).select(*rows.columns, place.cast("long").alias(name), *([F.col("__total").alias(total)] if total else []))
