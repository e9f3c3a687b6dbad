"""Which events a sampler picks: by time, by count, by cumulated flow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000


def time_bars(rows: DataFrame, keys: list[str], order: list[str], interval: int, ts: str = "ts_ns") -> DataFrame:
    """The first row of each interval that has one, but for a key's first interval."""
    w = Window.partitionBy(*keys).orderBy(*order)
    bar = F.floor(F.col(ts) / interval)
    return rows.withColumn("__last", F.lag(bar).over(w)).where(bar != F.col("__last")).drop("__last")


def event_bars(rows: DataFrame, keys: list[str], order: list[str], every: int, counted: str = "kind = 'book'") -> DataFrame:
    """Every n-th row of a key among those counted."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.where(counted).withColumn("__n", n).where(F.col("__n") % every == 0).drop("__n")


def imbalance_flags(signed: np.ndarray, threshold: float, carried: float = 0.0) -> tuple[np.ndarray, float]:
    """Where the cumulated flow reaches the threshold on either side and starts anew; and what is left."""
    out = np.zeros(len(signed), bool)
    at, level, block = 0, carried, 64
    while at < len(signed):
        levels = level + np.cumsum(signed[at : at + block])
        hit = np.flatnonzero(np.abs(levels) >= threshold)
        if len(hit):
            out[at + hit[0]] = True
            at, level, block = at + int(hit[0]) + 1, 0.0, 64
        else:  # look further, in larger blocks, from what is reached here
            at, level, block = at + block, float(levels[-1]), min(2 * block, 1 << 16)
    return out, float(level)


def imbalance_bars(rows: DataFrame, keys: list[str], order: list[str], threshold: float, signed: str = "signed_qty") -> DataFrame:
    """Rows at which the flow since the last bar reaches the threshold.

    The reset isn't associative, so a key's rows come to one task in order; they pass a batch at a time, however many
    they are, and the flow since the last bar is carried from batch to batch.
    """
    if threshold <= 0:
        raise ValueError("the threshold is positive")
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(F.sha2(F.to_json(key), 256).alias("__key"), F.coalesce(F.col(signed).cast("double"), F.lit(0.0)).alias("__flow"), *rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, level = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            own, flow = batch.column("__key").to_numpy(zero_copy_only=False), batch.column("__flow").to_numpy()
            flags = np.zeros(len(own), bool)
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                flags[a:b], level = imbalance_flags(flow[a:b], threshold, level if own[a] == last else 0.0)
                last = own[a]
            yield batch.select(batch.schema.names[2:]).filter(pa.array(flags))

    return ordered.mapInArrow(run, rows.schema)


def samples_per_hour(rows: DataFrame, ts: str = "ts_ns") -> DataFrame:
    return rows.groupBy(F.floor(F.col(ts) / HOUR_NS).alias("hour")).agg(F.count("*").alias("samples"))
