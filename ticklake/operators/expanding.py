"""Ridge regression refitted every week on all rows whose labels were known, from sums that only grow.

A refit needs the rows' count, sums and products alone. These are aggregated by the week in which a
row's label becomes known (its week + 2 horizons), accumulated in one ordering, and looked up by the weeks
that ask; each refit is then one solve of as many unknowns as there are features, in whatever task holds
that week. No task sees a key's rows, and a year more of them costs no refit more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .asof import asof


def solved(sums: np.ndarray, features: int, penalty: float) -> np.ndarray:
    """Weights of raw features and the offset, from (n, x, y, xy, products of x by pairs): as stats.ridge on the rows themselves."""
    n, x, y = sums[0], sums[1 : features + 1], sums[features + 1]
    xy, pairs = sums[features + 2 : 2 * features + 2], sums[2 * features + 2 :]
    products = np.zeros((features, features))
    products[np.triu_indices(features)] = pairs
    products = products + np.triu(products, 1).T
    mean = x / n
    cov = products - n * np.outer(mean, mean)
    var = np.diag(cov) / n
    # A feature that never changes has no more than rounding left of its variance.
    scale = np.sqrt(np.where(var > 1e-12 * np.maximum(mean * mean, 1e-300), var, 0.0))
    scale[scale == 0] = 1.0
    beta = np.linalg.solve(cov / np.outer(scale, scale) + penalty * np.eye(features), (xy - mean * y) / scale) / scale
    return np.append(beta, -(beta * mean).sum())


def expanding_ridge(rows: DataFrame, keys: list[str], features: list[str], label: str, week: str, horizon: int, *, penalty: float = 1.0, least: int = 60, name: str = "prediction") -> DataFrame:
    """rows with the prediction by a ridge of all rows of their key with week + 2 * horizon <= their own week.

    Null where fewer than least such rows are known, or where a feature is missing; a row with a missing feature or
    label teaches nothing. A key of nulls is a key.
    """
    def finite(c: str):
        return F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))

    k, x = len(features), [F.col(f).cast("double") for f in features]
    y = F.col(label).cast("double")
    whole = reduce(lambda a, b: a & b, map(finite, features))
    terms = [F.lit(1.0), *x, y, *[c * y for c in x], *[a * b for a, b in combinations_with_replacement(x, 2)]]
    by_week = rows.where(whole & finite(label)).groupBy(*keys, (F.col(week) + 2 * horizon).alias("__known")).agg(*[F.sum(t).alias(f"__s{i}") for i, t in enumerate(terms)])
    upto = Window.partitionBy(*keys).orderBy("__known").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = by_week.select(*keys, "__known", F.array(*[F.sum(f"__s{i}").over(upto) for i in range(len(terms))]).alias("sums"))
    asked = asof(rows.select(*keys, week).distinct(), sums, keys, week, "__known", ["sums"], ties=True, prefix="__")
    asked = asked.where(F.col("__sums").isNotNull() & (F.get("__sums", F.lit(0)) >= least)).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*keys, week])], "__sums")
    out = asked.withColumn("__weights", F.lit(None).cast("array<double>")).drop("__sums").schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights = [solved(np.array(s), k, penalty).tolist() for s in b.column("__sums").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(weights, pa.list_(pa.float64()))], schema=arrow)

    fits = asked.mapInArrow(run, out)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*keys, week])])
    weight = lambda i: F.get("__weights", F.lit(i))
    answer = reduce(lambda a, b: a + b, [weight(i) * c for i, c in enumerate(x)]) + weight(k)
    return rows.join(fits, on, "left").select(*rows.columns, F.when(whole, answer).alias(name))
