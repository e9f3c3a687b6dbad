"""States of aggregates that are kept a day and merged without the rows they came from.

A state holds the count, exact sums of values and squares, both weighted and not, the extremes, and a
histogram of weights over buckets of equal ratio. All of these add up, so states merge in any order and by any
split into what all the rows would give: sums are decimals, which no order changes. Buckets are bounded
by the values' range (PER_DECADE a decade), whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a decade.
PER_DECADE = 20
_SUMS = ("n", "weight", "total", "squares", "weighted")


def bucket(value: Column) -> Column:
    """The histogram bucket of a value; values of 0 and less share one."""
    return F.when(value > 0, F.floor(F.log10(value) * PER_DECADE + 1e-9).cast("int")).otherwise(F.lit(-100_000))


def _gathered(cells: DataFrame, keys: list[str]) -> DataFrame:
    """States of rows that hold sums of one bucket each."""
    least, most = F.min("lo").alias("lo"), F.max("hi").alias("hi")
    per = cells.groupBy(*keys, "bucket").agg(*[F.sum(c).cast("long" if c == "n" else "decimal(38,12)").alias(c) for c in _SUMS], least, most)
    hist = F.sort_array(F.collect_list(F.struct("bucket", F.col("n").alias("n"), F.col("weight").alias("weight")))).alias("histogram")
    return per.groupBy(*keys).agg(*[F.sum(c).cast("long" if c == "n" else "decimal(38,12)").alias(c) for c in _SUMS], F.min("lo").alias("lo"), F.max("hi").alias("hi"), hist)


def states(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, state columns): keys hold the day. Values and weights count to six places; rows without a value or weight don't."""
    v = F.col(value).cast("decimal(18,6)")
    w = (F.col(weight) if weight else F.lit(1)).cast("decimal(18,6)")
    some = rows.select(*keys, v.alias("v"), w.alias("w")).where("v IS NOT NULL AND w IS NOT NULL")
    cells = some.groupBy(*keys, bucket(F.col("v").cast("double")).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum("w").alias("weight"), F.sum("v").alias("total"), F.sum((F.col("v") * F.col("v")).cast("decimal(38,12)")).alias("squares"),
        F.sum((F.col("v") * F.col("w")).cast("decimal(38,12)")).alias("weighted"), F.min("v").alias("lo"), F.max("v").alias("hi"),
    )
    return _gathered(cells, keys)


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """States by fewer keys (or of several tables put together) as one state each."""
    of = parts.select(*keys, *_SUMS, "lo", "hi", F.posexplode("histogram").alias("__at", "__h"))
    # Sums stand beside the first bucket alone, so that they count once.
    first = F.col("__at") == 0
    cells = of.select(*keys, F.col("__h.bucket").alias("bucket"), F.col("__h.n").alias("n"), F.col("__h.weight").alias("weight"), *[F.when(first, F.col(c)).otherwise(F.lit(0).cast("decimal(38,12)")).alias(c) for c in _SUMS[2:]], "lo", "hi")
    return _gathered(cells, keys)


def _bucket_at(share: float) -> Column:
    """The first bucket up to which the histogram holds that share of the weight."""
    goal = F.col("weight").cast("double") * share
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("int").alias("at"))

    def step(a: Column, h: Column) -> Column:
        seen = a["seen"] + h["weight"].cast("double")
        return F.struct(seen.alias("seen"), F.coalesce(a["at"], F.when(seen >= goal, h["bucket"])).alias("at"))

    return F.aggregate("histogram", start, step)["at"]


def summary(merged: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """States with mean, variance, the weighted mean and, by name, quantiles by weight (the upper edge of their bucket)."""
    n, mean = F.col("n").cast("double"), F.col("total").cast("double") / F.col("n")
    variance = F.greatest(F.col("squares").cast("double") / n - mean * mean, F.lit(0.0))
    out = merged.withColumns({"mean": mean, "variance": variance, "weighted_mean": F.when(F.col("weight") > 0, F.col("weighted").cast("double") / F.col("weight").cast("double"))})
    for name, q in (quantiles or {}).items():
        at = _bucket_at(q)
        out = out.withColumn(name, F.when(at == -100_000, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), (at + 1) / F.lit(float(PER_DECADE)))))
    return out
