"""Probes for values that know the future: by changing what comes after, and by planting it.

A feature at a time may depend on rows up to that time. causality() changes every later row, once in its values
and once by leaving it out, and reports which features at or before the time differ. canary() plants the
future itself as a feature, which a model must find if its clean result is to mean anything, and
shifts labels away from their rows, after which it must find nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats


def changed_after(rows: DataFrame, ts: str, at: int, values: list[str]) -> DataFrame:
    """rows whose values after at are other ones: numbers turned and moved, anything else null."""
    def other(c: str) -> Column:
        number = rows.schema[c].dataType.typeName() in ("double", "float", "long", "integer", "short", "byte", "decimal")
        new = (F.lit(17) - 3 * F.col(c)).cast(rows.schema[c].dataType) if number else F.lit(None).cast(rows.schema[c].dataType)
        return F.when(F.col(ts) > at, new).otherwise(F.col(c)).alias(c)

    return rows.select(*[other(c) if c in values else F.col(c) for c in rows.columns])


def causality(rows: DataFrame, features: Callable[[DataFrame], DataFrame], keys: list[str], ts: str, at: int, values: list[str], *, tolerance: float = 1e-9) -> DataFrame:
    """(feature, probe, rows, changed, first_changed) for each column that features(rows) gives beside keys and ts.

    probe says what was done to the rows after at: changed or dropped. Features are held against each other at or
    before at by (keys, ts), numbers with a relative tolerance; a row that is on one side alone counts as changed.
    """
    plain = features(rows)
    names = [c for c in plain.columns if c not in (*keys, ts)]
    out = None
    for probe, other in (("changed", changed_after(rows, ts, at, values)), ("dropped", rows.where(F.col(ts) <= at))):
        a = plain.where(F.col(ts) <= at).select(*[F.col(c).alias(f"__a{i}") for i, c in enumerate([*keys, ts])], F.struct(*names).alias("__x"), F.lit(True).alias("__l"))
        b = features(other).where(F.col(ts) <= at).select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate([*keys, ts])], F.struct(*names).alias("__y"), F.lit(True).alias("__r"))
        on = reduce(lambda x, y: x & y, [F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}")) for i in range(len(keys) + 1)])
        met = a.join(b, on, "full").withColumn("__t", F.coalesce(f"__a{len(keys)}", f"__b{len(keys)}"))
        alone = F.col("__l").isNull() | F.col("__r").isNull()
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), (alone | _differ(F.col("__x")[n], F.col("__y")[n], plain.schema[n].dataType.typeName(), tolerance)).alias("differs")) for n in names]))
        found = met.select("__t", each.alias("f")).groupBy("f.feature").agg(F.count("*").alias("rows"), F.count_if("f.differs").alias("changed"), F.min(F.when(F.col("f.differs"), F.col("__t"))).alias("first_changed"))
        found = found.select("feature", F.lit(probe).alias("probe"), "rows", "changed", "first_changed")
        out = found if out is None else out.union(found)
    return out


def _differ(x: Column, y: Column, kind: str, tolerance: float) -> Column:
    if kind in ("double", "float"):
        close = F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
        return ~(x.eqNullSafe(y) | F.coalesce(close, F.lit(False)))
    return ~x.eqNullSafe(y)


def canary(rows: DataFrame, features: list[str], ret: str, split: Callable[[DataFrame], DataFrame], n_folds: int, *, shift: int, order: str, keys: list[str] | None = None, **how) -> DataFrame:
    """(probe, auc, passed) of out-of-fold predictions of whether ret is above 0.

    plain has the features alone. planted has ret itself as one more: a model that doesn't find it would find no leak
    either, so it passes at 0.95. shifted learns and scores the label of the row that comes shift rows later (by order
    in its key), of which the features know nothing: it passes within 0.1 of a half. split gives fold and is_test.
    """
    up = (F.col(ret) > 0).cast("int")
    later = F.lead(up, shift).over(Window.partitionBy(*(keys or [])).orderBy(order))
    known = rows.where(F.col(ret).isNotNull()).withColumns({"__up": up, "__later": later})
    folds = split(known)
    probes = (("plain", features, "__up"), ("planted", [*features, ret], "__up"), ("shifted", features, "__later"))
    out = None
    for name, columns, label in probes:
        scored = stats.out_of_fold(folds.where(F.col(label).isNotNull()), columns, label, n_folds, **how).withColumn("probe", F.lit(name))
        auc = stats.auc(scored, ["probe"], label, "probability").select("probe", "auc")
        out = auc if out is None else out.union(auc)
    passed = F.when(F.col("probe") == "planted", F.col("auc") >= 0.95).when(F.col("probe") == "shifted", F.abs(F.col("auc") - 0.5) <= 0.1)
    return out.withColumn("passed", passed)
