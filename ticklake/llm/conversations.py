"""The prefix trie of conversations, family first.

Conversation c belongs to the family of its base id, c - c % 100 (the remainder has c's sign), and is
rebuilt from the base's first turns and its own later ones. Turns travel as hashes: one shuffle by the
base id brings a family together, the base's first turns ahead of the members' own, sorted (a cogroup
that holds only those first turns). A family's conversations are rebuilt in that stream and put into the
family's small trie, and only its combined nodes go on, to be merged with those of other families, map-side
first, so a turn that all families share costs a row a task.

A node is owned by its smallest member. Members only leave as a path goes on, so what a conversation
owns is the last part of its path, whole. So sums over subtrees need no rounds by level: owned nodes
with their merged counts go back to their owner's family, where every conversation passes what it owns to
all nodes before it on its own path (a running sum from its end), combined before it is merged by node.

The ids that end at a node are joined per family, then in ranges, and hashed as a stream of such pieces,
so a node where a third of all conversations end is a few long rows and never held whole.

Null roles and texts are empty strings. Turns are in order of their number, null first; rows that share
one follow the hash of their role and text, so equal rows stand side by side and any order of the input
gives the same trie. A family's trie beyond NODES nodes is passed on in parts, which merge alike, so one
very long conversation isn't held whole either. Rows without a conversation id belong to none and are left
out; an empty table gives no nodes, not even a root. Only the four columns named are read, whatever
others are called; very long texts leave the first task as a hash and a length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_join, small_batches, stored

#: Nodes of a family that a task holds before it passes them on.
NODES = 50_000
#: Bytes of joined ids in a row, about.
PIECE = 1 << 18
ROOT = b"\0" * 16
#: Turns of its base that a conversation takes are fewer than this.
HEADS = 6
NO_IDS = hashlib.sha256(b"").hexdigest()


def taken(c: int) -> int:
    """How many first turns of its base conversation c takes."""
    return zlib.crc32(str(c).encode()) % HEADS


def after(node: bytes, turn: bytes) -> bytes:
    """The name of the node that a turn leads to."""
    return hashlib.blake2b(node + turn, digest_size=16).digest()


def turns(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(base, c, turn, said, chars): every turn as a hash of its role and text, and the text's length."""
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256))
    c = F.col(conv).cast("long")
    rows = conversations.where(F.col(conv).isNotNull())
    return rows.select((c - c % 100).alias("base"), c.alias("c"), F.col(turn).alias("turn"), said.alias("said"), F.length(t).cast("long").alias("chars"))


def families(rows: DataFrame) -> DataFrame:
    """The turns with those of a family together: the base's own first, then by conversation, in order."""
    sorted_ = rows.repartition("base").sortWithinPartitions("base", F.col("c") != F.col("base"), "c", F.asc_nulls_first("turn"), "said")
    return sorted_.select("base", "c", "said", "chars")


def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rebuilt conversations of families: (base, c, depth, node, parent, chars) for the root and for every turn."""
    base = conv = None
    head: list[tuple[bytes, int]] = []
    seen = depth = take = 0
    node = ROOT
    for batch in batches:
        for b, c, said, chars in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if b != base:
                base, conv, head = b, None, []
            if c != conv:
                conv, seen, depth, node, take = c, 0, 0, ROOT, taken(c)
                yield b, c, 0, ROOT, None, 0
                for early, size in head[:take] if c != b else ():
                    parent, node, depth = node, after(node, early), depth + 1
                    yield b, c, depth, node, parent, size
            seen += 1
            if c == b and seen < HEADS:
                head.append((said, chars))
            if c == b or seen > take:  # a base's first turns are both what it takes and its own
                parent, node, depth = node, after(node, said), depth + 1
                yield b, c, depth, node, parent, chars


#: Rows of three kinds: nodes of a family's trie, ids that end at a node (joined), and the steps of paths.
NODE, ENDS, STEP = 0, 1, 2
PARTS = "kind int, base long, c long, node binary, parent binary, depth long, chars long, n long, ids string"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
_NAMES = [f.split()[0] for f in PARTS.split(", ")]


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each family's trie, the ids that end in it and its conversations' steps, in rows of PARTS."""
    rows: list[tuple] = []
    trie: dict[bytes, list] = {}
    ends: dict[bytes, list[int]] = {}
    last = (None, None, None)  # base, conversation and node of the step before

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
        rows.clear()
        return out

    def close(base):
        rows.extend((NODE, base, c, node, parent, depth, chars, n, None) for node, (parent, depth, chars, n, c) in trie.items())
        trie.clear()

    for base, c, depth, node, parent, chars in paths(batches):
        if depth == 0 and last[0] is not None:
            ends.setdefault(last[2], []).append(last[1])
        if last[0] is not None and (base != last[0] or len(trie) >= NODES):
            close(last[0])
        if last[0] is not None and base != last[0]:
            rows.extend((ENDS, last[0], None, at, None, None, None, None, ",".join(map(str, sorted(ids)))) for at, ids in ends.items())
            ends.clear()
        known = trie.get(node)
        if known is None:
            trie[node] = [parent, depth, chars, 1, c]
        else:
            known[3] += 1
            known[4] = min(known[4], c)
        rows.append((STEP, base, c, node, None, depth, None, None, None))
        last = (base, c, node)
        if len(rows) >= 4096:
            yield batch()
    if last[0] is not None:
        ends.setdefault(last[2], []).append(last[1])
        close(last[0])
        rows.extend((ENDS, last[0], None, at, None, None, None, None, ",".join(map(str, sorted(ids)))) for at, ids in ends.items())
        yield batch()


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, base, ids) in order -> the same with neighbours of one node joined up to about PIECE bytes."""
    node = first = None
    held: list[str] = []
    size = 0
    out: list[tuple] = []
    for batch in batches:
        for n, b, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if n != node or size >= PIECE:
                if held:
                    out.append((node, first, ",".join(held)))
                node, first, held, size = n, b, [], 0
            held.append(ids)
            size += len(ids)
        if len(out) >= 16:
            yield _pieces(out)
            out = []
    if held:
        out.append((node, first, ",".join(held)))
    if out:
        yield _pieces(out)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    node, base, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(base, pa.int64()), pa.array(ids, pa.string())], names=["node", "base", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, base, ids) in order -> (node, SHA-256 of all its ids, comma-joined)."""
    node, sha = None, None
    for batch in batches:
        nodes, digests = [], []
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n != node:
                if node is not None:
                    nodes.append(node)
                    digests.append(sha.hexdigest())
                node, sha = n, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])


def ends(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end. Families are ranges of ids, so their base orders them."""
    small_batches(parts.sparkSession)
    rows = parts.where(F.col("kind") == ENDS).select("node", "base", "ids")
    long = rows.repartitionByRange("node", "base").sortWithinPartitions("node", "base").mapInArrow(_longer, "node binary, base long, ids string")
    return long.repartition("node").sortWithinPartitions("node", "base").mapInArrow(_digests, "node binary, ends_sha256 string")


def subtree_sums(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens): what conversations own, passed to all nodes before it on their paths."""
    steps = parts.where(F.col("kind") == STEP).select("base", "c", "depth", "node", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    c = F.col("conv_id")
    owned = nodes.select((c - c % 100).alias("base"), c.alias("c"), "depth", F.lit(None).cast("binary").alias("node"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    met = steps.union(owned).repartition("base").groupBy("base", "c", "depth").agg(F.max("node").alias("node"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    on = Window.partitionBy("base", "c").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    passed = met.select("node", F.sum("leaf").over(on).alias("leaf"), F.sum("saved").over(on).alias("saved")).where("leaf > 0 OR saved > 0")
    return passed.groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    parts = stored(families(turns(conversations, conv=conv, turn=turn, role=role, text=text)).mapInArrow(_tries, PARTS), "trie-parts")
    nodes = parts.where(F.col("kind") == NODE).groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.sum("n").alias("n_convs"), F.min("c").alias("conv_id"))
    nodes = stored(nodes, "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-counted")
    # A node with many children (the root) is a popular key here.
    up = dealt_join(nodes.select("parent", "node"), nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent").select("node", "parent_conv_id")
    found = nodes.join(subtree_sums(parts, nodes), "node").join(ends(parts), "node", "left").join(up, "node", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))
