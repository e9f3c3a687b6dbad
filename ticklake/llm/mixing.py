"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

Every document gets an exponential key -ln(u) / weight, with u from a hash of its id and the seed and
weight its quality. Within a source, documents in key order form the sample: what a target holds of
whole passes over its source (epochs) is taken of every document, and of the rest the documents whose
middle lies within the remaining budget, by a prefix sum of sizes in key order. So whole documents
are taken, and a source misses its target by half a document at most.

The prefix sum has two levels: keys fall into fine ranges, ranges are summed and accumulated per
source, and only within a range rows are put in order. Ranges are cut where the source's own mixture
of weights puts equal shares of documents (its weights in steps of two), so they are even for any
weights; no task holds a source, however large.

A null or empty text has size 0 and gives no words; very long texts are counted whole. A null source
is a source of its own. A null id draws its key by its text. Rows with the same id, source, size and
weight are ties: they stand together in the order, summed map-side, and are taken alike, in the pass
that isn't whole if the middle of them all lies within the budget. Repeated texts under different ids
are different documents. An empty table gives an empty one. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_join, stored

#: Documents of a key range, about.
RANGE_ROWS = 4096
#: Sources whose cuts are broadcast at most; with more, they are joined.
SOURCES = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int, text: Column | None = None) -> Column:
    """In (0, 1), from 52 bits of md5(seed:key); for a null key, of its text's digest."""
    other = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))) if text is not None else F.lit("null")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), other)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def quality_weight(text: Column) -> Column:
    """From 0.25 to 1: the fewer symbol characters a text has among its characters, the more."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))
    return 1 - 0.75 * F.least(F.lit(1.0), 20 * symbols / F.greatest(F.char_length(t), F.lit(1)))


def targets(sizes: DataFrame, *, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """Per source of (source, source_size): target. Sources by code point, null last, weigh as listed, repeating.

    Targets add up to share of all sizes, by weight; none is above most times its source's size, and
    what is cut off is shared again by weight among the others. The sources are one row each.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = (F.row_number().over(order) - 1) % len(weights)
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), n + 1))
    w = w.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("level", level).withColumn("level", F.when(F.col("level") <= F.col("full_at"), F.col("level")))
    # The level at the first source (in filling order) that it doesn't fill holds for all; without one, all are full.
    first = F.first("level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return w.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * first, F.col("cap"))).alias("target"))


def _weight(weight: Column | None, text: str) -> Column:
    """Weights are above 0: null, zero and negative ones count as the least."""
    w = quality_weight(F.col(text)) if weight is None else weight.cast("double")
    return F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(2.0**-30))


def _rank(key: str, text: str, weight: Column | None, seed: int) -> Column:
    return -F.log(uniform(F.col(key), seed, F.col(text).cast("string"))) / _weight(weight, text)


def _sid(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _decided(docs: DataFrame, share: float, weights: tuple[int, ...], most: float, seed: int, weight: Column | None, text: str, key: str, source: str) -> DataFrame:
    """(sid, id, size, rank, n, source_size, target, epochs, more): rows that are alike, n of them, are one."""
    rows = docs.select(
        F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _rank(key, text, weight, seed).alias("rank"), F.floor(F.log2(_weight(weight, text))).cast("int").alias("step"),
    )
    rows = stored(rows, "mixing-sizes")
    steps = rows.groupBy("source", "step").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sizes = stored(steps.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("docs"), F.collect_list(F.struct(F.pow(F.lit(2.0), F.col("step")).alias("w"), "n")).alias("steps")), "mixing-sources")
    goal = targets(sizes.select("source", "source_size"), share=share, weights=weights, most=most)
    goal = goal.join(sizes.select(F.col("source").alias("s"), "docs", "steps"), F.col("source").eqNullSafe(F.col("s")))
    goal = stored(goal.select(_sid(F.col("source")).alias("sid"), "source_size", "target", "docs", "steps"), "mixing-targets")
    same = rows.select(_sid(F.col("source")).alias("sid"), "id", "size", "rank").groupBy("sid", "rank", "id", "size").agg(F.count("*").alias("n"))
    # The share of the source's documents whose keys come before, as if each weight were the power of two below it.
    below = F.aggregate("steps", F.lit(0.0), lambda acc, x: acc + x["n"] * (1 - F.exp(-x["w"] * F.col("rank")))) / F.col("docs")
    keyed = same.join(goal, "sid").withColumn("range", F.floor(below * F.ceil(F.col("docs") / RANGE_ROWS))).drop("steps", "docs")
    keyed = keyed.withColumn("all", F.col("size") * F.col("n"))
    sums = keyed.groupBy("sid", "range").agg(F.sum("all").alias("sum"))
    base = F.sum("sum").over(Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("sid", "range", F.coalesce(base, F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "range").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.withColumn("within", F.coalesce(F.sum("all").over(inside), F.lit(0))).join(sums, ["sid", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    more = (F.col("base") + F.col("within") + F.col("all") / 2 <= rest).cast("long")
    return out.select("sid", "id", "size", "rank", "n", "source_size", "target", epochs.cast("long").alias("epochs"), more.alias("more"))


def mix(docs: DataFrame, *, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0, seed: int = 11, weight: Column | None = None, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Per document: key, size (words), source_size, target (of its source) and taken (words, repeats counted)."""
    out = _decided(docs, share, weights, most, seed, weight, text, key, source)
    # Rows that are alike come back by blocks, so no list of them is long.
    out = out.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RANGE_ROWS))))
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RANGE_ROWS).cast("long"), F.col("n") - F.col("block") * RANGE_ROWS))))
    return out.select(F.col("id").alias(key), "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("more"))).cast("long").alias("taken"))


def mixed(docs: DataFrame, *, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0, seed: int = 11, weight: Column | None = None, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The documents that the mix takes, each row as often as it is taken, with all their columns. Rows without words are never taken.

    Who is taken in the pass that isn't whole comes before all others of its source in the order, so
    its last document says it for all: documents find out by themselves and aren't shuffled.
    """
    out = _decided(docs, share, weights, most, seed, weight, text, key, source)
    last = F.max(F.when((F.col("more") == 1) & (F.col("size") > 0), F.struct("rank", "id", "size")))
    cuts = stored(out.groupBy("sid").agg(F.first("epochs").alias("epochs"), last.alias("last")), "mixing-cuts")
    rows = docs.select(F.struct(*docs.columns).alias("row"), _sid(F.col(source)).alias("sid"), _rank(key, text, weight, seed).alias("rank"), F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike(WORDS))
    rows = rows.join(F.broadcast(cuts), "sid") if cuts.count() <= SOURCES else dealt_join(rows, cuts, "sid")
    at = F.col("last.rank")
    tied = F.struct("rank", "id", word_count(F.col("text")).alias("size")) <= F.col("last")  # sizes are counted in ties alone
    more = F.when(at.isNull() | (F.col("rank") > at), 0).when(F.col("rank") < at, 1).otherwise(tied.cast("int"))
    times = (F.col("epochs") + more).cast("int")
    return rows.withColumn("times", times).where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
