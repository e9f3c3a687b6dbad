"""Near-duplicate grouping: SuperMinHash signatures, banding, exact verification and union of links.

A document's set is its distinct shingles of consecutive words, as 64-bit hashes. SuperMinHash gives
element e in round j the value j + r_j(e) at slot p_e[j] of a permutation p_e of its own, and keeps
the least value of each slot: the slots of one element differ, so the estimate varies less than with
independent hashes. Slots filled in round j cannot change later, so a document is done (early stop)
once all its slots are filled; rounds here run over all elements of a chunk at once, which gives the
same least values as going element by element.

Equal sets are merged first (a map-side min), so a group of exact copies costs one row, a class with
a number of its own. Bands of the signature make buckets of the classes. In each of a few leader
rounds every member of a bucket meets one leader of that bucket and the pair is verified on full sets;
what is linked is united. Whatever still shares a bucket without being united meets by a prefix filter:
of each set only its rarest elements, as many as two sets at the threshold can't all lack, bring
candidates together, which are compared in blocks. So no pair of a bucket goes untested unless both
sides are in one group already, and no step makes all pairs of a group. Joins whose key can be
popular (a leader, a component, an element) deal such keys into pieces.

A row is known by its id and its text's 64-bit hash, so rows that repeat an id are documents of their
own unless their texts are equal too. Null texts and texts without words have empty sets and are linked
with nothing; very long texts are read whole. Rows without an id can't be named. Ties can't be: the
least id names a group, of rows with that id the one with the least hash stands for it. Only the id
and the text are read, whatever other columns are called. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, PLENTY, Texts, dealt_join, map_texts, mix, release, roll, small_batches, span_hashes, stored, word_spans

#: Slots of a signature and bands of 4 slots: a pair at the threshold 0.8 shares no band with a
#: chance of (1 - 0.8^4)^24 = 3e-6.
SLOTS, BANDS = 96, 24
#: Rounds of comparing bucket members with one leader each before the rest is compared completely; the first is free of joins.
LEADER_ROUNDS = 3
#: Sets that a task holds while it compares others with them.
BLOCK = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, flat, with offsets.

    A-Z are lower-cased. A document with fewer words than width has its whole sequence as its one
    shingle; one without words has an empty set.
    """
    data = LOWER[data]
    starts, ends, doc = word_spans(data, offsets)
    n = len(offsets) - 1
    words = span_hashes(data, starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    parts, owners = [], []
    if len(words) >= width:
        whole = doc[: len(words) - width + 1] == doc[width - 1 :]
        parts.append(roll(words, width)[whole])
        owners.append(doc[: len(words) - width + 1][whole])
    for k in range(1, width):
        short = np.flatnonzero(count == k)
        if len(short):
            h = words[first[short]]
            for i in range(1, k):
                h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + words[first[short] + i])
            parts.append(h ^ np.uint64(k))
            owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h, own = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int64)


def super_minhash(flat: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (documents x slots, uint64: the round in the upper 16 bits, the rank's fraction below)."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    sig = np.full(n * slots, np.uint64(0xFFFF) << np.uint64(48), np.uint64)
    doc = np.repeat(np.arange(n), sizes)
    live = np.arange(len(flat))
    perm = None
    for j in range(slots):
        if not len(live):
            break
        h = mix(flat[live] + np.uint64((j * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (2**64 - 1)))
        k = j + (((h & np.uint64(0xFFFFFF)) * np.uint64(slots - j)) >> np.uint64(24)).astype(np.int64)
        rank = (h >> np.uint64(16)) | (np.uint64(j) << np.uint64(48))
        if j == 0:
            slot, pick = k, k
        else:
            if perm is None:  # the permutations of elements that need more than one round
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(live), 1))
                row = np.arange(len(live))
                perm[row, 0], perm[row, pick[live_at]] = pick[live_at], 0
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
            perm[row, j] = slot
        np.minimum.at(sig, doc[live] * slots + slot, rank)
        open_ = (sig.reshape(n, slots).max(axis=1) >> np.uint64(48)) > j
        stay = open_[doc[live]]
        live_at = np.flatnonzero(stay)
        if j:
            row = row[live_at]
        live = live[live_at]
    return sig.reshape(n, slots)


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash a band, in which the band's number is mixed."""
    n, slots = sig.shape
    rows = sig.reshape(n, bands, slots // bands)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands))
    for k in range(slots // bands):
        h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + rows[:, :, k])
    return h


def _set_keys(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set: sums of two functions of its elements."""
    out = []
    for salt in (0x1234567, 0x89ABCDEF01):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)))])
        out.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, width: int, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: its key and hash, n_shingles, two halves of its set's name and band hashes."""

    def run(t: Texts) -> dict:
        flat, off = shingle_sets(t.data, t.offsets, width)
        sig = super_minhash(flat, off)
        empty = np.diff(off) == 0
        bands = band_hashes(sig).view(np.int64)
        a, b = _set_keys(flat, off)
        per = np.where(empty, 0, BANDS)
        return {
            key: t.ids,
            "hash": t.batch.column("hash"),
            "n_shingles": np.diff(off),
            "set_a": a,
            "set_b": b,
            "bands": (bands[~empty].ravel(), np.concatenate([[0], np.cumsum(per)])),
        }

    return map_texts(docs, run, f"{key} long, hash long, n_shingles long, set_a long, set_b long, bands array<long>", text=text, key=key, more=("hash",))


def full_sets(docs: DataFrame, width: int, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    def run(t: Texts) -> dict:
        flat, off = shingle_sets(t.data, t.offsets, width)
        raw = flat.tobytes()
        return {key: t.ids, "items": pa.array([raw[8 * a : 8 * b] for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())}

    return map_texts(docs, run, f"{key} long, items binary", text=text, key=key)


def _verify(percent: int):
    """a, b, items of each -> the pairs with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column("items_a"), batch.column("items_b"), strict=True)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                    continue
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                both = int(np.count_nonzero(v[np.minimum(at, len(v) - 1)] == u)) if len(v) else 0
                keep[i] = 100 * both >= percent * (len(u) + len(v) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])
        release()

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) pairs of classes, those linked on full sets. b may be in any number of pairs: its set is copied to pieces of them."""
    small_batches(pairs.sparkSession)
    pairs = stored(pairs, "minhash-pairs")
    right = dealt_join(pairs, sets.select(F.col("n").alias("b"), F.col("items").alias("items_b")), "b")
    both = right.join(sets.select(F.col("n").alias("a"), F.col("items").alias("items_a")), "a").select("a", "b", "items_a", "items_b")
    return both.mapInArrow(_verify(percent), "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, comp): a number for each group of ids that edges (a, b) join, the number of one of them.

    In a round every id goes to its least neighbour or every id to its greatest, whichever moves more
    (at least half of the ids move, as none is both the least and the greatest around it). Pointers are
    followed by doubling until they stand still, edges get the new names, and those within one name go.
    So rounds are at most the logarithm of the number of ids, and so are the steps in one. Least and
    greatest are taken map-side, and joins deal hubs into pieces.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels, named = None, 0
    while edges.head(1):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(both.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n")), f"{name}-near")
        down, up, nodes, ends = near.agg(F.count(F.when(F.col("lo") < F.col("a"), 1)), F.count(F.when(F.col("hi") > F.col("a"), 1)), F.count("*"), F.sum("n")).first()
        to = F.least("lo", "a") if down >= up else F.greatest("hi", "a")
        go, moved, named = near.select(F.col("a").alias("id"), to.alias("to")), True, named or nodes
        while moved:  # two doublings a step
            for last in (False, True):
                far = go.select(F.col("id").alias("to"), F.col("to").alias("to2"))
                go = dealt_join(go.select("id", "to"), far, "to", rows=nodes).select("id", F.col("to2").alias("to"), (F.col("to2") != F.col("to")).alias("moved"))
                if last or nodes > PLENTY:
                    go = stored(go, f"{name}-go")
            moved = go.where("moved").head(1)
        go = go.select("id", "to")
        if labels is None:
            labels = go.withColumnRenamed("to", "comp")
        else:
            # What is in no edge any more keeps its name.
            labels = dealt_join(labels, go.withColumnRenamed("id", "comp"), "comp", "left", rows=named).select("id", F.coalesce("to", "comp").alias("comp"))
            labels = stored(labels, f"{name}-labels")
        half = dealt_join(edges, go.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a", rows=ends).select("ta", "b")
        half = stored(half, f"{name}-half") if ends > PLENTY else half
        whole = dealt_join(half, go.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b", rows=ends).where("ta <> tb")
        edges = stored(whole.select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(), f"{name}-edges")
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))


def _rest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of parts, the asking ones first in each part -> links between asking and asked rows of different components.

    The overlap of an asked set with all asking sets of its part is counted at once, over the sorted
    elements of the asking sets.
    """
    part, rows, table = None, [], None
    for batch in batches:
        out_a, out_b = [], []
        for p, asking, i, comp, items in zip(*(batch.column(c).to_pylist() for c in ("part", "asking", "id", "comp")), batch.column("items"), strict=True):
            x = np.frombuffer(items.as_buffer(), np.uint64)
            if p != part:
                part, rows, table = p, [], None
            if asking:
                rows.append((i, comp, x.copy()))
                table = None
                continue
            if not rows:
                continue
            if table is None:
                sizes = np.array([len(r[2]) for r in rows])
                values, owner = np.concatenate([r[2] for r in rows]), np.repeat(np.arange(len(rows)), sizes)
                order = np.argsort(values, kind="stable")
                table = (values[order], owner[order], sizes, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
            values, owner, sizes, ids, comps = table
            lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(rows))
            hit = np.flatnonzero((100 * both >= percent * (sizes + len(x) - both)) & (comps != comp))
            out_a += [max(i, q) for q in ids[hit]]
            out_b += [min(i, q) for q in ids[hit]]
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _named(docs: DataFrame, text: str, key: str, *more) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("hash"), t.alias("text"), *more)


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row of (id, hash, text) with an id: id, hash, n_shingles, component_id, and the hash of the row with that id that stands for the group (first)."""
    docs = docs.where("id is not null")
    sig = stored(signatures(docs, width, key="id"), "minhash-signatures")
    named = ["n_shingles", "set_a", "set_b"]
    classes = sig.where("n_shingles > 0").groupBy(*named).agg(F.min(F.struct("id", "hash", "bands")).alias("rep"))
    # A class's number is written with it, so it names the class from here on.
    classes = stored(classes.select(*named, "rep.*").withColumn("n", F.monotonically_increasing_id()), "minhash-classes")
    rows = stored(classes.select("n", F.explode("bands").alias("bucket")), "minhash-bands")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("n").alias("leader")).where("members > 1")
    shared = stored(shared, "minhash-shared")
    most = shared.agg(F.coalesce(F.max("members"), F.lit(0))).first()[0]
    # The first round's leaders, the least numbers, come with the buckets.
    rows = stored(dealt_join(rows, shared.select("bucket", "leader"), "bucket", most=most).select("n", "bucket", "leader"), "minhash-buckets")
    near = classes.join(rows.select("n").distinct(), "n", "left_semi").select("id", "hash", "n")
    texts = docs.join(near.select("id", "hash"), ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"]).join(near, ["id", "hash"])
    sets = stored(full_sets(texts.select("n", "text"), width, key="n"), "minhash-sets")

    found: DataFrame | None = None
    labels: DataFrame | None = None
    for k in range(LEADER_ROUNDS + 1):
        if k == 0:
            links = verified(rows.where("n <> leader").select(F.col("n").alias("a"), F.col("leader").alias("b")).distinct(), sets, percent)
        else:
            left = rows.select("n", "bucket")
            left = left.withColumn("comp", F.col("n")) if labels is None else left.join(labels.withColumnRenamed("id", "n"), "n", "left").withColumn("comp", F.coalesce("comp", "n"))
            left = stored(left, f"minhash-members{k}")
            if k < LEADER_ROUNDS:
                # The least of a hash leads, of each bucket that isn't in one component.
                lead = left.groupBy("bucket").agg(F.min_by(F.struct("n", "comp"), F.xxhash64(F.lit(k), "n")).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
                met = dealt_join(left, stored(lead.select("bucket", F.col("lead.n").alias("leader"), F.col("lead.comp").alias("other")), f"minhash-leaders{k}"), "bucket", most=most)
                links = verified(met.where("comp <> other").select(F.col("n").alias("a"), F.col("leader").alias("b")).distinct(), sets, percent)
            else:
                links = _remaining(left, sets, percent, most)
        links = stored(links, f"minhash-links{k}")
        if not links.head(1):
            if k >= LEADER_ROUNDS:
                break
            continue
        found = links if found is None else found.union(links)
        labels = components(found, f"minhash-round{k}")
    if labels is not None:
        # Of each group, the row with the least id and of these the least hash.
        member = stored(labels.join(classes.select(F.col("n").alias("id"), F.struct(F.col("id").alias("id"), "hash").alias("row")), "id"), "minhash-members")
        best = stored(member.groupBy("comp").agg(F.min("row").alias("best")), "minhash-best")
        best = stored(dealt_join(member.select("id", "comp"), best, "comp").select(F.col("id").alias("n"), "best"), "minhash-of")
        classes = classes.join(best, "n", "left")
    else:
        classes = classes.withColumn("best", F.lit(None).cast("struct<id:bigint,hash:bigint>"))
    classes = stored(classes.select(*named, F.coalesce("best", F.struct("id", "hash")).alias("best")), "minhash-answers")
    rows = sig.select("id", "hash", *named)
    some = classes.withColumn("set", F.struct(*named)).select("set", "best")
    rows = dealt_join(stored(rows.where("n_shingles > 0").select(F.struct(*named).alias("set"), "id", "hash"), "minhash-rows"), some, "set").select(
        "id", "hash", F.col("set.n_shingles").alias("n_shingles"), F.col("best.id").alias("component_id"), F.col("best.hash").alias("first"))
    return rows.union(sig.where("n_shingles = 0").select("id", "hash", "n_shingles", F.col("id").alias("component_id"), F.col("hash").alias("first")))


def groups(docs: DataFrame, *, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, n_shingles, component_id (the least key reachable over links) and kept.

    Links are pairs with 100 * intersection >= percent * union of their shingle sets. Rows without a
    key are left out; rows that repeat one are reported each by its own text.
    """
    found = _grouped(_named(docs, text, key), width, percent)
    return found.select(F.col("id").alias(key), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, comp, items -> a row for each element of a set: h, n, comp, size."""
    for batch in batches:
        for n, comp, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = np.frombuffer(items.as_buffer(), np.int64)
            for at in range(0, len(x), 1 << 16):
                h = x[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(np.full(len(h), v)) for v in (n, comp, len(x)))], names=["h", "n", "comp", "size"])
    release()


def _prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, n, comp): the elements by which a member of (n, comp) can meet one of another component.

    A pair at the threshold shares at least percent of either set. So if a set's elements are put in one
    order, the same for all sets, the first size - ceil(percent size) + 1 of each of the two have one in
    common. Elements that only one component has come first, as they are in no such pair, and rare ones before
    frequent ones; what has more of the former than may be missing has no partner at all.
    """
    rows = stored(members.join(sets, "n").select("n", "comp", "items").mapInArrow(_elements, "h long, n long, comp long, size long"), "minhash-elements")
    shared = rows.groupBy("h").agg(F.count("*").alias("held"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    met = stored(dealt_join(rows, stored(shared.select("h", "held"), "minhash-held"), "h"), "minhash-met")
    spare = F.col("size") - F.ceil(F.col("size") * percent / F.lit(100))
    able = met.groupBy("n").agg(F.first("size").alias("size"), F.count("*").alias("of")).select("n", (spare + 1 - F.col("size") + F.col("of")).alias("first")).where("first > 0")
    order = Window.partitionBy("n").orderBy("held", "h")
    return met.join(able, "n").withColumn("place", F.row_number().over(order)).where("place <= first").select(F.col("h").alias("bucket"), "n", "comp")


def _remaining(left: DataFrame, sets: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """Links between members of buckets that still hold several components, none left out.

    Members of such buckets meet by the elements of _prefixes instead, which most of them share with few or none.
    Of those who share one, all but the largest component ask, all are asked. Asking rows of one
    neighbourhood (the largest component beside them) are dealt into blocks of about BLOCK, and every
    member meets a block once, however many elements they share; what meets a block is dealt into
    pieces, so neither side of a task grows with a group. left is a written table, most the rows of its
    largest bucket.
    """
    small_batches(left.sparkSession)
    several = left.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    members = dealt_join(left, stored(several, "minhash-several"), "bucket", most=most).select("n", "comp").distinct()
    rows = stored(_prefixes(stored(members, "minhash-open"), sets, percent), "minhash-prefixes")
    counts = rows.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    main = counts.groupBy("bucket").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    open_ = stored(dealt_join(rows, stored(main.select("bucket", "main"), "minhash-main"), "bucket").select("bucket", "n", "comp", "main"), "minhash-meeting")
    ask = stored(open_.where("comp <> main").groupBy("n", "comp").agg(F.min("main").alias("home")), "minhash-homes")
    near = ask.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    ask = stored(dealt_join(ask, near, "home").select("n", "comp", F.xxhash64("home", F.pmod(F.xxhash64("n"), "blocks")).alias("block")), "minhash-asking")
    blocks = open_.where("comp <> main").join(ask.select("n", "block"), "n").select("bucket", "block").distinct()
    meet = stored(open_.join(blocks, "bucket").select("n", "comp", "block").distinct(), "minhash-asked")
    pieces = stored(meet.groupBy("block").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("pieces")), "minhash-pieces")
    meet = meet.join(pieces, "block").select("block", F.pmod(F.xxhash64("n"), "pieces").alias("piece"), F.lit(False).alias("asking"), "n", "comp")
    ask = ask.join(pieces, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(True).alias("asking"), "n", "comp")
    rows = ask.union(meet).join(sets, "n").select(F.xxhash64("block", "piece").alias("part"), "asking", F.col("n").alias("id"), "comp", "items")
    rows = rows.repartition("part").sortWithinPartitions(F.col("part"), F.col("asking").desc())
    return rows.mapInArrow(lambda b: _rest(b, percent), "a long, b long").distinct()


def deduplicate(docs: DataFrame, *, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with one of each group, that with the least key, and all their columns.

    Rows that repeat a key are documents of their own, unless their texts are equal too: then one of
    them stays. Rows without a key or without words are linked with nothing and stay.
    """
    rows = _named(docs, text, key, F.struct(*docs.columns).alias("row")).drop("text")
    found = stored(_grouped(_named(docs, text, key), width, percent), "minhash-groups").where("n_shingles > 0")
    gone = found.where("id <> component_id OR hash <> first").select("id", "hash").distinct()
    again = found.where("id = component_id AND hash = first").groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1").select("id", "hash")
    out = rows.join(gone, ["id", "hash"], "left_anti")
    if again.head(1):
        twice = out.join(again, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
        out = out.join(again, ["id", "hash"], "left_anti").unionByName(twice)
    return out.select("row.*")
