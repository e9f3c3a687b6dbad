"""Scoring texts by a hidden Markov language model, with a unigram model beside it.

Tokens are words (A-Z lower-cased) and one end. Counts of all training tokens are summed map-side
and by a shuffle. The model's classes are the most frequent words (WORDS of them unless asked for
more or fewer), BUCKETS classes of the other words by their last letters, and the end; states emit
classes, and a bucket emits its words by add-one counts, with one share for unknown words. So log10
P(text) is the likelihood of the class sequence, exact by the scaled forward recursion, plus what each
rarer word has within its bucket.

Baum-Welch passes run over all training texts, whole: a text's pieces of SPAN tokens are worked on at
once, with what comes before and after each carried over as products of the pieces' matrices, so
expected counts are those of the uncut text. Partitions' sums are added on executors, then on the
driver (states x classes numbers). The first pass starts from passes over a sample of about START_TOKENS
tokens, in pieces of SPAN picked by their own hash, whatever their documents' lengths and ids; passes
over all texts end early where the likelihood gains less than ENOUGH of itself. The forward recursion
of scoring runs over whole texts in the same way.

Counts of tokens that make up at least one part in KNOWN of the training tokens are broadcast (so at
most KNOWN pairs of numbers); each row lists its other tokens, which are joined with the table of
counts by the row's own number. A token that frequent everywhere never is a join key.

Null and empty texts have one token, the end; very long ones are scored whole. Rows without an id are
left out; rows that repeat one are scored each by itself; repeated texts score alike. Of words as
frequent as the last that has a class, those with the least hash have one. Without training texts all
counts are 0 and the model is the one training starts from. An empty table gives an empty one. Only
the id, the text and the condition are read, whatever other columns are called.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Texts, chunks, map_texts, mix, small_batches, span_hashes, stored, word_spans

WORDS, BUCKETS, STATES, PASSES, SPAN = 4096, 512, 8, 3, 128
KNOWN = 1 << 20
#: Passes over about so many tokens on the driver give the first full pass its starting point; and how many passes.
START_TOKENS, START_PASSES = 1 << 18, 12
#: A pass over all texts that gains less than this part of the likelihood is the last.
ENOUGH = 1e-4
END = np.uint64(0x5EED0E0D)
#: Distinct tokens that a task holds before it hands on their counts.
HELD = 1_500_000


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, buckets and documents of all words."""
    data = LOWER[t.data]
    starts, ends, doc = word_spans(data, t.offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), doc
    tail = np.zeros(len(starts), np.uint64)
    for k in (1, 2, 3):
        tail = (tail << np.uint64(8)) | np.where(ends - starts >= k, data[np.maximum(ends - k, 0)], 0).astype(np.uint64)
    return span_hashes(data, starts, ends), (mix(tail) % np.uint64(BUCKETS)).astype(np.int64), doc


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    u, first, back = np.unique(h, return_index=True, return_inverse=True)
    return u, b[first], np.bincount(back, n, len(u)).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """(h, b, c): all tokens of (doc_id, text), as hash, bucket (-1: the end) and count."""
    small_batches(docs.sparkSession)

    def run(batches):
        parts, held, texts = [], 0, 0

        def rows():
            h, b, n = _merge(parts)
            for at in range(0, len(h), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(b[s].astype(np.int32)), pa.array(n[s])], names=["h", "b", "n"])

        for t in chunks(batches):
            h, b, _ = tokens(t)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            parts.append((u, b[first], n))
            held, texts = held + len(u), texts + len(t)
            if held > HELD:
                parts = [_merge(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield from rows()
                    parts, held = [], 0
        if texts:
            parts.append((np.array([END]), np.array([-1]), np.array([texts])))
            yield from rows()

    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, b int, n long")
    return small.groupBy("h", "b").agg(F.sum("n").alias("c"))


class Lexicon:
    """What scoring needs of the counts: totals, the most frequent tokens, and totals by bucket of the words without a class."""

    def __init__(self, table: DataFrame, words: int = WORDS):
        if not 0 < words <= MOST_WORDS:
            raise ValueError(f"words with a class of their own: 1 to {MOST_WORDS}")
        self.words = words
        row = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.total, self.distinct = int(row["n"]), int(row["v"])
        # Tokens with at least one part in KNOWN of all: there can't be more than KNOWN of them.
        top = table.where(F.col("c") * F.lit(KNOWN) >= F.lit(self.total)).toArrow()
        h, b, c = (top.column(k).to_numpy().astype(np.int64) for k in ("h", "b", "c"))
        order = np.lexsort((h, -c))
        h, b, c = h[order], b[order], c[order]
        ranked = np.flatnonzero(b >= 0)[:words]
        cls = np.full(len(h), -1, np.int64)
        cls[ranked] = np.arange(len(ranked))
        order = np.argsort(h.view(np.uint64))
        self.h, self.c, self.cls = h.view(np.uint64)[order], c[order], cls[order]
        per = {r["b"]: (r["n"], r["v"]) for r in table.where("b >= 0").groupBy("b").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
        n, v = (np.array([per.get(k, (0, 0))[x] for k in range(BUCKETS)], np.float64) for x in (0, 1))
        np.subtract.at(n, b[ranked], c[ranked])
        np.subtract.at(v, b[ranked], 1)
        self.bucket_log = np.log10(n + v + 1)
        self.base_log = float(np.log10(self.total + self.distinct + 1))

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (-1: not among the most frequent) and classes (-1: none of its own)."""
        if not len(self.h):
            return np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[at] == h
        return np.where(hit, self.c[at], -1), np.where(hit, self.cls[at], -1)

    @property
    def whole(self) -> bool:
        """Whether all tokens there are are among the most frequent."""
        return self.distinct <= len(self.h)


    @property
    def classes(self) -> int:
        return self.words + BUCKETS + 1


#: Classes are packed in 16 bits.
MOST_WORDS = (1 << 16) - BUCKETS - 1


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Per document: n_tokens, what its frequent tokens add to n_known, base and score, its classes (16 bits each, packed), and its other tokens (far_h) with their counts (far_n)."""

    def run(t: Texts) -> dict:
        h, b, doc = tokens(t)
        n = len(t)
        c, cls = lex.look(h)
        end_c = int(lex.look(np.array([END]))[0][0])
        here = (c >= 0) | lex.whole
        c0 = np.maximum(c, 0)
        words = np.bincount(doc, minlength=n)
        base = np.bincount(doc, np.where(here, np.log10(c0 + 1.0), 0.0), n) - words * lex.base_log + np.log10(max(end_c, 0) + 1.0) - lex.base_log
        rare = cls < 0
        inner = np.bincount(doc[rare], np.where(here, np.log10(c0 + 1.0), 0.0)[rare] - lex.bucket_log[b[rare]], n)
        known = np.bincount(doc[here & (c > 0)], minlength=n) + (end_c > 0)
        seq = np.insert(np.where(rare, lex.words + b, cls), np.cumsum(words), lex.words + BUCKETS).astype("<u2")
        ends = np.cumsum(words + 1)
        raw = seq.tobytes()
        packed = [zlib.compress(raw[2 * a : 2 * z], 1) for a, z in zip(ends - words - 1, ends, strict=True)]
        far = ~here
        key = np.lexsort((h[far], doc[far]))
        far_h, far_doc = h[far][key], doc[far][key]
        new = np.ones(len(far_h), bool)
        new[1:] = (far_h[1:] != far_h[:-1]) | (far_doc[1:] != far_doc[:-1])
        at = np.flatnonzero(new)
        first = np.concatenate([[0], np.cumsum(np.bincount(far_doc[at], minlength=n))])
        return {
            "doc_id": t.ids, "held_out": t.batch.column("held_out"), "n_tokens": words + 1, "n_known": known, "base": base, "inner": inner, "seq": pa.array(packed, pa.binary()),
            "far_h": (far_h[at].view(np.int64), first), "far_n": (np.diff(np.append(at, len(far_h))).astype(np.int32), first),
        }

    return map_texts(docs, run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, seq binary, far_h array<long>, far_n array<int>", more=("held_out",))


# --- the model ---------------------------------------------------------------------------------


def _pieces(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences cut into pieces of SPAN, the longest first: classes (SPAN x pieces), lengths, first of a document, document, order in it."""
    sizes = np.array([len(s) for s in seqs])
    per = -(-sizes // SPAN)
    doc = np.repeat(np.arange(len(seqs)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(SPAN, sizes[doc] - nth * SPAN)
    padded = np.zeros((len(doc), SPAN), np.int32)
    flat = np.concatenate(seqs).astype(np.int32)
    padded[np.arange(SPAN)[None, :] < length[:, None]] = flat
    order = np.argsort(-length, kind="stable")
    return np.ascontiguousarray(padded[order].T), length[order], nth[order] == 0, doc[order], nth[order]


def start_model(seed: int = 5, classes: int = WORDS + BUCKETS + 1) -> dict:
    rng = np.random.default_rng(seed)
    a = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
    return {"pi": np.full(STATES, 1 / STATES), "a": a, "b": rng.dirichlet(np.ones(STATES) * 5, classes).T / classes}


def _matrices(model: dict, x: np.ndarray, alive: np.ndarray, head: np.ndarray, bt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each piece does to the states before it, scaled, and the logarithm (base 10) of the scale. A head has no step into it."""
    k, n = STATES, x.shape[1]
    a = model["a"].astype(bt.dtype)
    p = np.where(head[:, None, None], np.eye(k, dtype=bt.dtype), a) * bt[x[0]][:, None, :]
    log = np.zeros(n)
    for t in range(1, SPAN):
        m = alive[t]
        if not m:
            break
        p[:m] = (p[:m].reshape(m * k, k) @ a).reshape(m, k, k) * bt[x[t, :m]][:, None, :]
        if t % 8 == 0:
            s = p[:m].max((1, 2))
            p[:m] /= s[:, None, None]
            log[:m] += np.log10(s)
    return p, log


def _unit(v: np.ndarray) -> np.ndarray:
    return v / v.sum(1, keepdims=True)


def expected(model: dict, seqs: list[np.ndarray]) -> np.ndarray:
    """Expected starts, transitions and emissions of whole sequences, and their log-likelihood. Flat."""
    classes = model["b"].shape[1]
    x, length, head, doc, nth = _pieces(seqs)
    k, n = STATES, x.shape[1]
    pi, a, bt = model["pi"].astype(np.float32), model["a"].astype(np.float32), np.ascontiguousarray((model["b"].T * classes).astype(np.float32))
    alive = (length[None, :] > np.arange(SPAN)[:, None]).sum(1)
    steps = int((alive > 0).sum())
    before, after = np.tile(pi, (n, 1)), np.ones((n, k), np.float32)
    if not head.all():
        per = np.bincount(doc)
        long = np.flatnonzero(per[doc] > 1)  # pieces of sequences with several
        some = (length[long][None, :] > np.arange(SPAN)[:, None]).sum(1)
        p, _ = _matrices(model, x[:, long], some, head[long], bt)
        order = np.lexsort((nth[long], doc[long]))
        at, p = long[order], p[order]
        begin = np.flatnonzero(nth[at] == 0)
        count = per[doc[at[begin]]]
        for j in range(int(count.max()) - 1):
            on = begin[count > j + 1] + j
            v = _unit(np.einsum("ni,nij->nj", before[at[on]], p[on]))
            before[at[on + 1]] = v
            back = begin[count > j + 1] + count[count > j + 1] - 1 - j
            after[at[back - 1]] = _unit(np.einsum("nij,nj->ni", p[back], after[at[back]]))
    alpha, scale = np.zeros((steps, n, k), np.float32), np.ones((steps, n), np.float32)
    now = np.where(head[:, None], pi, before @ a) * bt[x[0]]
    for t in range(steps):
        m = alive[t]
        if t:
            now = (alpha[t - 1, :m] @ a) * bt[x[t, :m]]
        s = now.sum(1)
        alpha[t, :m] = now / s[:, None]
        scale[t, :m] = s
    beta = after / (alpha[length - 1, np.arange(n)] * after).sum(1, keepdims=True)
    trans = np.zeros((k, k), np.float64)
    gamma = np.zeros((steps, n, k), np.float32)
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        if t < steps - 1 and (m2 := alive[t + 1]):
            onward = bt[x[t + 1, :m2]] * beta[:m2] / scale[t + 1, :m2, None]
            trans += alpha[t, :m2].T @ onward
            beta[:m2] = onward @ a.T
        gamma[t, :m] = alpha[t, :m] * beta[:m]
    inner = ~head  # steps from one piece into the next
    trans += before[inner].T @ (bt[x[0, inner]] * beta[inner] / scale[0, inner, None])
    emit = np.empty((k, classes))
    used = x[:steps].ravel()
    for j in range(k):
        emit[j] = np.bincount(used, gamma[:, :, j].ravel(), classes)
    live = np.arange(n)[None, :] < alive[:steps, None]
    return np.concatenate([gamma[0][head].sum(0), (trans * model["a"]).ravel(), emit.ravel(), [np.log10(scale[live]).sum() - live.sum() * np.log10(classes)]])


def updated(sums: np.ndarray) -> dict:
    k = STATES
    pi, a, b = sums[:k] + 0.1, sums[k : k + k * k].reshape(k, k) + 0.1, sums[k + k * k : -1].reshape(k, -1)
    # A thousandth of the mass follows the overall frequency of classes, and each class keeps a little.
    overall = b.sum(0) + 0.5
    b = b + 0.01 + (0.001 * b.sum(1, keepdims=True) + 1) * overall / overall.sum()
    return {"pi": pi / pi.sum(), "a": a / a.sum(1, keepdims=True), "b": b / b.sum(1, keepdims=True)}


def likelihood(model: dict, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 P of each whole sequence: pieces as scaled matrices, multiplied in order."""
    classes = model["b"].shape[1]
    x, length, head, doc, nth = _pieces(seqs)
    n = x.shape[1]
    alive = (length[None, :] > np.arange(SPAN)[:, None]).sum(1)
    p, log = _matrices(model, x, alive, head, np.ascontiguousarray(model["b"].T * classes))
    v, out = np.tile(model["pi"], (len(seqs), 1)), np.zeros(len(seqs))
    for j in range(int(nth.max()) + 1 if n else 0):
        at = np.flatnonzero(nth == j)
        d = doc[at]
        v[d] = np.einsum("ni,nij->nj", v[d], p[at])
        s = v[d].sum(1)
        v[d] /= s[:, None]
        out[d] += np.log10(s) + log[at]
    return out - np.array([len(s) for s in seqs]) * np.log10(classes)


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x), "<u2") for x in batch.column("seq").to_pylist()]


def start_pieces(encoded: DataFrame, step: int) -> list[np.ndarray]:
    """One in step of all pieces of SPAN tokens, by a hash of the document's id, the piece's number and its tokens; equal ones count once."""

    def run(batches):
        for batch in batches:
            out = []
            for i, seq in zip(batch.column("doc_id").to_pylist(), _unpacked(batch), strict=True):
                for k in range(0, len(seq), SPAN):
                    piece = seq[k : k + SPAN].tobytes()
                    if zlib.crc32(piece, zlib.crc32(f"{i}:{k}".encode())) % step == 0:
                        out.append((i, k, piece))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "nth", "piece"])

    found = encoded.select("doc_id", "seq").mapInArrow(run, "doc_id long, nth long, piece binary").distinct().collect()
    return [np.frombuffer(bytes(r["piece"]), "<u2") for r in sorted(found)]


def train(encoded: DataFrame, *, passes: int = PASSES, parts: int = 8, seed: int = 5, classes: int = WORDS + BUCKETS + 1) -> dict:
    """Baum-Welch over all encoded rows that aren't held out. The model's key seen lists log10 likelihoods before each pass over all."""
    small_batches(encoded.sparkSession)
    rows = encoded.where("not held_out").select("seq")
    total = encoded.where("not held_out").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    some = start_pieces(encoded.where("not held_out"), max(1, total // START_TOKENS))
    model = start_model(seed, classes)
    if not some:
        return model
    for _ in range(START_PASSES):
        model = updated(expected(model, some))

    seen = []
    for _ in range(passes):

        def local(batches, model=model):
            total = None
            for batch in batches:
                if batch.num_rows:
                    got = expected(model, _unpacked(batch))
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % parts]), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

        def added(batches):
            total = None
            for batch in batches:
                for raw in batch.column("sums").to_pylist():
                    total = np.frombuffer(raw) if total is None else total + np.frombuffer(raw)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        got = rows.mapInArrow(local, "part long, sums binary").repartition(parts, "part").mapInArrow(added, "sums binary").collect()
        sums = sum(np.frombuffer(r["sums"]) for r in got)
        seen.append(float(sums[-1]))
        model = updated(sums)
        if len(seen) > 1 and seen[-1] - seen[-2] < ENOUGH * abs(seen[-1]):
            break
    return model | {"seen": seen}


def score(docs: DataFrame, held_out, *, passes: int = PASSES, words: int = WORDS) -> DataFrame:
    """Per document of (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    held_out is a condition on docs; those rows teach nothing. words have a class of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")).where("doc_id is not null")
    table = stored(counts(docs.where("not held_out")), "hmm-counts")
    lex = Lexicon(table, words)
    # A row's number is written with it, so it names the row from here on.
    encoded = stored(encode(docs, lex).withColumn("row", F.monotonically_increasing_id()), "hmm-encoded")
    model = train(encoded, passes=passes, classes=lex.classes)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = likelihood(model, _unpacked(batch)) + batch.column("inner").to_numpy()
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base")), pa.array(got)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    near = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "seq").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    if not lex.whole:
        far = encoded.select("row", F.explode(F.arrays_zip("far_h", "far_n")).alias("x")).select("row", F.col("x.far_h").alias("h"), F.col("x.far_n").alias("n"))
        far = far.join(table.select("h", "c"), "h").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("also"))
        near = near.join(far, "row", "left")
    else:
        near = near.withColumn("more", F.lit(0.0)).withColumn("also", F.lit(0))
    more = F.coalesce("more", F.lit(0.0))
    return near.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
