"""Bootstrap of means over blocks of time, all replicates of all keys in one aggregation.

A block counts w times in a replicate, w by Poisson's law with mean 1, which is what drawing as many blocks
as there are gives for many of them. w comes from a hash of (seed, block, replicate): reruns agree, and a
block counts alike in all keys, so what they have in common stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Poisson's law with mean 1 up to the chance of k or fewer; beyond, a 52-bit number has none left.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(17)]


def weight(seed: int, block: Column, replicate: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), block.cast("string"), replicate.cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return sum((F.when(u >= c, 1).otherwise(0) for c in POISSON[1:]), F.when(u >= POISSON[0], 1).otherwise(0))


def replicates(rows: DataFrame, keys: list[str], order: str, value: str, block: int, reps: int = 300, seed: int = 1) -> DataFrame:
    """(keys, replicate, mean) of replicates that hold any value; order is a whole number, a block [k * block, (k + 1) * block)."""
    some = rows.where(F.col(value).isNotNull() & F.col(order).isNotNull())
    blocks = some.groupBy(*keys, F.floor(F.col(order) / block).alias("__b")).agg(F.count("*").alias("__n"), F.sum(F.col(value).cast("double")).alias("__s"))
    each = blocks.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    each = each.withColumn("__w", weight(seed, F.col("__b"), F.col("replicate"))).where("__w > 0")
    return each.groupBy(*keys, "replicate").agg((F.sum(F.col("__w") * F.col("__s")) / F.sum(F.col("__w") * F.col("__n"))).alias("mean"))


def bootstrap(rows: DataFrame, keys: list[str], order: str, value: str, block: int, *, quantiles: dict[str, float], reps: int = 300, seed: int = 1) -> DataFrame:
    """Per key, by name, quantiles of the replicates' means, and how many replicates hold any value."""
    made = replicates(rows, keys, order, value, block, reps, seed)
    return made.groupBy(*keys).agg(F.count("*").alias("replicates"), *[F.percentile("mean", q).alias(n) for n, q in quantiles.items()])
