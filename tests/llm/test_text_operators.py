"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticklake.llm import classifier, decontam, hmm, minhash, mixing, pii, quality_rules, queries, secret_scan, token_files, warc
from ticklake.llm.common import as_texts, chunks, dealt_join, span_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def frame(spark, texts, schema="doc_id long, text string, source string, kept boolean, score double, id long, h long"):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, True, 0.5, 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


ODD = [None, "", "   \n\t ", "one", "Two words", "ça va bien élan «test»", "x " * 30_000, "same text here now again", "same text here now again", "\n\n\na\n\nb", "a" * 50_000, "\x00\x1f weird 　 space", "🙂 🙂 🙂 🙂 🙂"]


def lorem(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(50)) for _ in range(n))


def texts_of(rows):
    return list(chunks(iter([pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string())], names=["doc_id", "text"])])))


# --- hashes of spans -----------------------------------------------------------------------------------


def thue_morse(n, letters="ab"):
    """Two strings of n letters that sums over powers modulo 2^64 can't tell apart from 1,024 on."""
    s = "".join(letters[bin(i).count("1") % 2] for i in range(n))
    return s, s.translate(str.maketrans(letters, letters[::-1]))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 16384])
def test_pieces_of_two_letters_are_told_apart(n, library):
    a, b = thue_morse(n)
    t = texts_of([f"x {a} y", f"x {b} y"])[0]
    h = span_hashes(t.data, np.array([2, 2 + t.offsets[1]]), np.array([2 + n, 2 + n + t.offsets[1]]))
    assert h[0] != h[1]
    enc = token_files.Encoder(token_files.tokenizer_path())
    ids, per = enc.encode(t.data, t.offsets)
    for text, got in zip((f"x {a} y", f"x {b} y"), np.split(ids, [per[0]]), strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    flat, off = minhash.shingle_sets(t.data, t.offsets, 3)
    assert flat[off[0] : off[1]].tolist() != flat[off[1] :].tolist()
    lines = texts_of([f"{a}\n{b}\n{a}"])[0]
    assert quality_rules.judge(lines)["n_dup_lines"].tolist() == [1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=8), st.integers(0, 9))
def test_hashes_depend_on_bytes_alone(spans, shift):
    data = np.frombuffer(b"z" * shift + b"".join(spans), np.uint8)
    ends = shift + np.cumsum([len(x) for x in spans])
    h, again = span_hashes(data, ends - [len(x) for x in spans], ends, (0, 1))
    one = [int(span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in spans]
    assert h.tolist() == one and (h != again).all() and len(set(one)) == len(set(spans))


def test_a_piece_whose_hash_is_taken_is_encoded_by_itself(library, monkeypatch):
    real = token_files.span_hashes
    monkeypatch.setattr(token_files, "span_hashes", lambda d, a, b, salts: (np.full(len(a), 5, np.uint64), real(d, a, b, (1,))))
    enc = token_files.Encoder(token_files.tokenizer_path())
    text = "one two three one four"
    for t in (texts_of([text])[0], texts_of(["other words", text])[0]):
        ids, per = enc.encode(t.data, t.offsets)
        assert ids[len(ids) - per[-1] :].tolist() == library.encode(text, add_special_tokens=False).ids


# --- near-duplicates ---------------------------------------------------------------------------------


def sets_by_hand(texts, width):
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def groups_by_hand(texts, width, percent):
    s = sets_by_hand(texts, width)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(s))], [len(x) for x in s]


def copies(rng, n, base_words, edits):
    base = lorem(rng, base_words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    texts = list(ODD)
    for _ in range(12):
        texts += copies(rng, 4, rng.choice([6, 20, 60, 200]), rng.choice([0, 1, 2, 3]))
    texts += copies(rng, 40, 120, 3)  # a chain of near copies about the threshold
    texts += [lorem(rng, rng.randrange(1, 80)) for _ in range(30)]
    for width in (4, 5):
        want, sizes = groups_by_hand(texts, width, 80)
        got = {r["doc_id"]: r for r in minhash.groups(frame(spark, texts), width=width).collect()}
        assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
        assert [got[i]["component_id"] for i in range(len(texts))] == want
        assert all(got[i]["kept"] == (want[i] == i) for i in got)


def test_signatures_do_not_depend_on_order_and_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    x, y = np.sort(a[:2000]), np.sort(a[500:2500])
    flat, off = np.concatenate([x, y, x[::-1]]), np.array([0, 2000, 4000, 6000])
    sig = minhash.super_minhash(flat, off)
    assert (sig[0] == sig[2]).all()
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.2
    small = minhash.super_minhash(a[:3], np.array([0, 3]))
    assert (small >> np.uint64(48) < minhash.SLOTS).all()  # even three elements fill all slots


def test_one_element_follows_its_permutation():
    sig = minhash.super_minhash(np.array([12345], np.uint64), np.array([0, 1]))
    assert sorted((sig[0] >> np.uint64(48)).tolist()) == list(range(minhash.SLOTS))


def test_components_of_chains_hubs_and_trees(spark, monkeypatch):
    written = []
    real = minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda df, name: written.append(name) or real(df, name))
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(1000)]
    up_and_down = [(2000 + (i if i % 2 else 900 - i), 2000 + (i + 1 if (i + 1) % 2 else 900 - i - 1)) for i in range(200)]
    hub = [(9000, k) for k in range(5000, 5400)] + [(4999, k) for k in range(6000, 6400)]
    tree = [(7000 + i, 7000 + rng.randrange(i)) for i in range(1, 300)]
    monkeypatch.setattr("ticklake.llm.common.PLENTY", 50)
    edges = chain + up_and_down + hub + tree + [(7, 7)]
    got = {r["id"]: r["comp"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    sets = collections.defaultdict(set)
    for i, c in got.items():
        sets[c].add(i)
    want = collections.defaultdict(set)
    for x in list(parent):
        want[find(x)].add(x)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, (v for v in want.values() if len(v) > 1)))
    assert sum(n.endswith("-near") for n in written) + sum(n.endswith("-go") for n in written) <= 24
    written.clear()
    assert len({r["comp"] for r in minhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}) == 1
    assert sum(n.endswith("-near") for n in written) + sum(n.endswith("-go") for n in written) <= 15


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "y2"), (2, b, "z"), (3, a, "w"), (0, b + " more", "v"), (5, None, "n"), (5, None, "n2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").selectExpr("*", "1 AS hash", "2 AS id", "3 AS n", "4 AS __piece")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.groups(docs, width=4).collect())
    assert got == sorted([(1, 5, 1, True), (1, 5, 0, False), (1, 5, 0, False), (2, 5, 0, False), (3, 5, 1, False), (0, 6, 0, True), (5, 0, 5, True), (5, 0, 5, True)])
    out = minhash.deduplicate(docs, width=4)
    assert out.columns == docs.columns
    assert sorted(r["row"] for r in out.collect()) == ["n", "n2", "v", "x"]
    again = minhash.deduplicate(spark.createDataFrame([(1, a), (1, a), (4, a)], "doc_id long, text string"), width=4)
    assert [tuple(r) for r in again.collect()] == [(1, a)]


def test_deduplicate_keeps_one_and_all_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (None, "a b c d e f g", "z"), (3, None, "w"), (4, "", "v")], "doc_id long, text string, kept string")
    out = minhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in out.collect()) == [(-1, "z"), (1, "x"), (3, "w"), (4, "v")]


# --- personal data -------------------------------------------------------------------------------------


def base_pii(t):
    out = []
    for k, p in enumerate((pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)):
        for m in p.finditer(t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0) or (k == 3 and 9 <= len(digits) <= 15)
            if ok:
                out.append((k, m.start(), m.end()))
    return out


PIECES = ["a@b.co", "x.y+z@h-1.org", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "é", " ", "\n", "12", ".", "-", "+", "(", "word", "0"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12), min_size=1, max_size=4))
def test_patterns_in_runs_equal_patterns_in_texts(parts):
    texts = ["".join(p) for p in parts]
    t = texts_of(texts)[0]
    lead = (t.data & 0xC0) != 0x80
    got = pii.pattern_spans(t.data[lead], np.concatenate([[0], np.cumsum(lead)])[t.offsets])
    assert got == [base_pii(x) for x in texts]


def test_pii_report(spark):
    texts = ["é mail me@x.org or 10.0.0.1", "call (212) 555-0188 now", "card 4111111111111111.", "number 4111111111111112", *ODD]
    rows = {r["doc_id"]: r for r in pii.report(frame(spark, texts)).collect()}
    assert (rows[0]["n_email"], rows[0]["n_ip"], rows[2]["n_card"], rows[3]["n_card"]) == (1, 1, 1, 0)
    assert rows[0]["spans"] == "email:7:15,ip:19:27"
    for i, t in enumerate(texts):
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base_pii(t or ""))
        assert rows[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(rows[i]["spans"].split(","))
    assert rows[3]["spans"] == ""


def test_network_finds_spans_it_has_not_seen():
    model = pii.train()
    texts, spans = pii.labelled(300, 77)
    got = pii.decoded(model, pii.windows_of(texts))
    hit = sum(len({x[:3] for x in g} & set(s)) for g, s in zip(got, spans, strict=True))
    assert hit / sum(map(len, spans)) > 0.85 and hit / max(1, sum(map(len, got))) > 0.85


def test_addresses_without_digits_and_at_signs_are_found(spark):
    forms = ["maria.lopez [at] riverbank [dot] org", "ann_lee(at)post[dot]de", "ines.costa [at] riverbank.com", "john.weber (at) riverbank.net"]
    texts = [f"please write to {x} or call, " + "we will come back to the matter as soon as we can " * 3 for x in forms] + ["we met (at) noon and sat [dot] there", "no such thing here"]
    rows = {r["doc_id"]: r["spans"] for r in pii.report(frame(spark, texts)).collect()}
    want = {i: f"email:16:{16 + len(x)}" for i, x in enumerate(forms)}
    assert {i: s for i, s in rows.items() if s} == want
    assert {r["doc_id"] for r in pii.masked(frame(spark, texts)).collect() if r["text"].startswith("please write to [EMAIL] or")} == set(want)


def test_windows_that_are_not_run_hold_no_spans(spark, monkeypatch):
    """The network over all windows of whole texts finds what it finds near the places that a span can be at."""
    model = pii.trained(spark)
    docs = ["mail me: jan [at] firm [dot] com or +44 20 7946 0958", "no data at all, just words and words", "card 4111 1111 1111 1111 and 10.0.0.1"]
    t = texts_of(docs)[0]
    some = [pii.find(t, model)]
    monkeypatch.setattr(pii, "anchors", lambda chars: np.arange(len(chars)))
    assert some == [pii.find(t, model)] and any(spans for _, spans in some[0])


def test_long_runs_of_characters(spark):
    texts = ["1.2.3." + "5" * 5000, "0" * 50 + "1.2.3.004", "a" * 300_000 + "@", "x@" + "b" * 300_000, "7" * 300_000 + ".2.3", "1.2.3.4." * 20_000, "+1" + "(" * 300_000, "@" * 100_000, "4 " * 100_000]
    rows = {r["doc_id"]: r for r in pii.report(frame(spark, texts)).collect()}
    assert [rows[i]["n_ip"] for i in range(len(texts))] == [0, 1, 0, 0, 0, 20_000, 0, 0, 0]
    assert sum(rows[i]["n_email"] + rows[i]["n_phone"] for i in rows) == 0
    assert rows[1]["spans"].startswith("ip:0:59")


def test_pieces_of_a_span_longer_than_the_overlap_are_put_together():
    pieces = [(0, 10, 96, 0.9, False, True), (0, 48, 144, 0.8, True, True), (0, 96, 170, 0.9, True, False), (1, 60, 96, 0.9, False, True)]
    assert [(k, a, b) for k, a, b, *_ in pii._whole(pieces)] == [(0, 10, 170)]
    assert pii._whole(pieces[1:3]) == [] and pii._whole([]) == []
    model = pii.train()
    name = ".".join("abcdefg" for _ in range(14))
    text = f"write to {name} [at] riverbank [dot] org today"
    raw = np.frombuffer(text.encode(), np.uint8)
    got = pii.model_spans(model, raw, np.array([0, len(raw)]))
    assert got == {0: [(0, 9, len(text) - 6)]}


def test_weights_are_read_from_the_shared_folder(spark):
    first = pii.trained(spark, 200, 1)
    again = pii.trained(spark, 200, 1)
    assert all((first[k] == again[k]).all() for k in first) and set(first) == set(pii.train(200, 1))


def test_reconciled_takes_the_best_set_without_overlap():
    spans = [(0, 0, 10, 0.6), (1, 8, 20, 0.9), (2, 18, 25, 0.6), (0, 0, 10, 0.5)]
    assert reconciled_kinds(spans) == [0, 2]
    assert pii.reconciled([]) == []


def reconciled_kinds(spans):
    return [k for k, *_ in pii.reconciled(spans)]


def test_masked_text(spark):
    got = pii.masked(frame(spark, ["mail a@b.co now", None])).collect()
    assert [r["text"] for r in sorted(got)] == ["mail [EMAIL] now", ""]


# --- token files ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\x1c", "\xa0", " ", "　", "a", "Zé", "中", "12", "!", "..", "'s", "<|endoftext|>", "|>", "\r\n", "\x85", "🙂", "_"]), max_size=25))
def test_encoder_equals_the_library(library, parts):
    text = "".join(parts)
    raw = text.encode()
    ids, per = token_files.encoder(token_files.tokenizer_path()).encode(np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8), np.array([0, len(raw)]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and per.sum() == len(ids)


def test_small_table_starts_anew(library):
    enc = token_files.Encoder(token_files.tokenizer_path(), table=16)
    for t in texts_of([lorem(random.Random(1), 40), "", "tail"]):
        ids, per = enc.encode(t.data, t.offsets)
        assert ids.tolist() == [i for k in range(len(t)) for i in library.encode(t.text(k), add_special_tokens=False).ids]


def test_round_trip_in_shards(spark, library):
    texts = [*ODD, *[lorem(random.Random(i), i) for i in range(60)]]
    from ticklake.llm.common import work_dir

    m = token_files.write(frame(spark, texts).repartition(5), work_dir(spark, "t"), shard_rows=16)
    assert m.count() > 2
    rows = sorted(token_files.read(m).collect())
    at = 0
    for r, t in zip(rows, texts, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    first = token_files.Shard(m.orderBy("shard").first()["file"])
    assert first[0].tolist() == [2] and first.keys[0] == 0


# --- mixing --------------------------------------------------------------------------------------------


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, lorem(rng, rng.randrange(0, 60)) if i % 11 else None, ["b", "a", None, "c"][min(3, int(rng.random() ** 2 * 4))]) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted(got) == sorted(mixing.mix(docs.repartition(7)).collect())  # reruns agree
    by = collections.defaultdict(list)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["size"] == len(WORD.findall(rows[r["doc_id"]][1] or ""))
        by[rows[r["doc_id"]][2]].append(r)
    order = sorted(k for k in by if k) + [None]
    weights = dict(zip(order, (3, 1, 2, 3), strict=True))
    size = {k: sum(r["size"] for r in v) for k, v in by.items()}
    left, open_, want = 1.5 * sum(size.values()), set(order), {}
    while True:
        share = {k: left * weights[k] / sum(weights[x] for x in open_) for k in open_}
        over = [k for k in open_ if share[k] > 2 * size[k]]
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 2.0 * size[k]
            left -= want[k]
            open_.discard(k)
    for k, v in by.items():
        assert all(abs(r["target"] - want[k]) < 1e-6 and r["source_size"] == size[k] for r in v)
        assert abs(sum(r["taken"] for r in v) - want[k]) <= max(r["size"] for r in v)


def test_mix_with_few_weights_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    rng = random.Random(5)
    rows = [(i % 150, " ".join(["# w"] * rng.randrange(1, 9)) if i % 2 else lorem(rng, 5), "a") for i in range(600)] + [(7, "x y", "a")] * 300 + [(None, "x y z", "a")] * 50 + [(None, f"n {i}", "b") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect())) and len(got) == len(rows)
    taken = collections.Counter((r["doc_id"], r["size"], r["taken"] // max(1, r["size"])) for r in got)
    times = {(d, z): t for d, z, t in taken}
    out = collections.Counter((r["doc_id"], len(r["text"].split())) for r in mixing.mixed(docs).collect())
    want = collections.Counter()
    for (d, z, t), n in taken.items():
        want[d, z] += t * n
    assert out == +want and times[7, 2] in (0, 1, 2)
    for source in ("a", "b"):
        mine = [r for r in got if r["source_size"] == sum(len(x[1].split()) for x in rows if x[2] == source)]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 600  # half of the largest tie


def test_ranges_are_even_for_small_weights(spark):
    docs = spark.range(0, 40_000).selectExpr("id AS doc_id", "if(id % 4 = 0, 'a b c', '# # # #') AS text", "'s' AS source")
    steps = [(1.0, 10_000), (0.25, 30_000)]
    w = F.when(F.col("doc_id") % 4 == 0, 1.0).otherwise(0.25)
    below = sum(n * (1 - F.exp(-x * (-F.log(mixing.uniform(F.col("doc_id"), 11)) / w))) for x, n in steps) / 40_000
    sizes = [r["count"] for r in docs.groupBy(F.floor(below * 10)).count().collect()]
    assert max(sizes) < 2 * min(sizes) and len(sizes) == 10


def test_mixed_repeats_rows_and_keeps_columns(spark):
    docs = frame(spark, [lorem(random.Random(i), 20) for i in range(60)]).selectExpr("*", "1 AS row", "2 AS sid", "3 AS rank", "4 AS times", "5 AS size")
    out = mixing.mixed(docs)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect()}
    assert out.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in out.collect()) == {k: v for k, v in taken.items() if v}


# --- decontamination -----------------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", min_size=1, max_size=12), st.text("abc ", max_size=20))
def test_distance_equals_brute_force(p, t):
    best = min(edit_distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
    score, end = decontam.distance(p.encode(), t.encode())
    assert score == best and (score == len(p) or any(edit_distance(p, t[i:end]) == best for i in range(end + 1)))


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(8)
    items = [lorem(rng, n) for n in (12, 25, 40, 60, 3, 1)]
    texts, want = list(ODD), set()
    for i, item in enumerate(items[:4]):
        edited = item.split()
        edited[2] = "zz"
        for form in (item, item.upper().replace(" ", "\n  "), " ".join(edited)):
            want.add((len(texts), i))
            texts.append(f"{lorem(rng, 50)} é {form} {lorem(rng, 50)}")
        texts.append(" ".join(item.split()[: len(item.split()) // 2]) + " " + lorem(rng, 80))  # half an item is none
    texts += [lorem(rng, 200) for _ in range(20)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, " \n")], "item_id long, text string")
    docs = frame(spark, texts)
    got = decontam.leaks(docs, bench.where("item_id < 4 OR item_id >= 90")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    for r in got:
        hit = " ".join(lower(texts[r["doc_id"]])[r["start"] : r["end"]].split())
        assert edit_distance(hit, items[r["item_id"]]) == r["distance"]
    kept = decontam.clean(docs, bench.where("item_id < 4"))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontam.clean(docs, bench.limit(0)).count() == len(texts)


def test_items_without_an_id_and_with_repeated_ones(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"see {item} here"), (1, "eleven twelve thirteen fourteen fifteen"), (2, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, "eleven twelve thirteen fourteen fifteen"), (4, item), (4, "eleven twelve thirteen fourteen fifteen"), (None, None)], "item_id long, text string")
    got = decontam.leaks(docs, bench)
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in got.collect()) == [(1, 0), (1, 0), (1, 4), (1, 4)]
    assert [r["doc_id"] for r in decontam.clean(docs, bench).collect()] == [2]
    assert decontam.leaks(docs, bench.limit(0)).count() == 0


def test_recall_near_the_threshold():
    rng = random.Random(2)
    items = decontam.Items(list(range(60)), [lorem(rng, 35) for _ in range(60)])
    found = total = 0
    for i, b in enumerate(items.bytes):
        w = b.decode().split()
        for j in rng.sample(range(len(w)), 4):
            w[j] = "qqqq"
        text = f"{lorem(rng, 20)} {' '.join(w)} {lorem(rng, 20)}"
        if decontam.distance(b, text.encode())[0] <= items.most[i]:
            total += 1
            found += any(x[1] == i for t in texts_of([text]) for x in decontam.leaks_in(t, items))
    assert total > 20 and found >= 0.95 * total


def leaks_of(texts, items):
    return {(d, i) for t in texts_of(texts) for d, i, *_ in decontam.leaks_in(t, items)}


def test_leaks_equal_brute_force():
    rng = random.Random(31)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n)).strip() or "a"
    for letters in ("abc ", "abcdefghijklmnop é"):
        items = decontam.Items(list(range(40)), [text(rng.choice([1, 3, 6, 7, 13, 14, 30, 62, 63, 90, 150]), letters) for _ in range(40)])
        texts = []
        for i, b in enumerate(items.bytes):
            s = list(b.decode())
            for _ in range(rng.randrange(int(items.most[i]) + 3)):
                k = rng.randrange(len(s))
                s[k : k + rng.choice([1, 1, 0])] = rng.choice(["", "x", "b", " "])
                s = s or ["a"]
            texts.append(text(rng.randrange(150), letters) + "".join(s) + text(rng.randrange(150), letters))
        want = set()
        for d, t in enumerate(texts):
            body = " ".join(lower(t).split()).encode()
            want |= {(d, i) for i, b in enumerate(items.bytes) if decontam.distance(b, body)[0] <= items.most[i]}
        assert len(want) > 20 and leaks_of(texts, items) == want


def test_items_with_every_second_word_edited_are_found():
    rng = random.Random(12)
    items = decontam.Items(list(range(30)), [lorem(rng, n) for n in (15, 25, 55) for _ in range(10)])
    texts = []
    for b in items.bytes:
        w = b.decode().split()
        w[1::2] = [x + "," for x in w[1::2]]
        texts.append(f"{lorem(rng, 60)} {' '.join(w)} {lorem(rng, 60)}")
    assert leaks_of(texts, items) == {(i, i) for i in range(30)}


def test_items_of_one_to_three_words_are_found_in_long_documents(spark):
    rng = random.Random(17)
    items = ["https://example.org/tasks/8f3a91c27be04d55", "什么是机器学习中的过拟合现象以及如何避免它", "internationalisation photosynthesis", "seventeen purple elephants", "ab", "q9"]
    forms = [
        (items[0], "see(https://example.org/tasks/8f3a91c27be04d55).", "https://examp1e.org/tasks/8f3a91c27be0-4d55"), (items[1], "请问什么是机器学习中的过拟合现象以及如何避免它呢", "什么是机器学习里的过拟合现象以及如何避免它"),
        (items[2], "Internationalisation\n photosynthesis", "internationalization photosynthesys"), (items[3], "SEVENTEEN purple  elephants", "sevent3en purpl elephants,"), (items[4],), (items[5],),
    ]
    texts, want = [], set()
    filler = lambda: " ".join(rng.choice(["umu", "voxe", "zizi", "welk"]) for _ in range(400))
    for i, edited in enumerate(forms):
        for form in edited:
            want.add((len(texts), i))
            texts.append(f"{filler()} {form} {filler()}")
    clean = len(texts)
    texts += [filler() + f" {x} " + filler() for x in ("a b", "9q", "seventy people elect", "机器学习")]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()} == want
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench).collect()) == list(range(clean, len(texts)))


# --- secrets -------------------------------------------------------------------------------------------

ASSIGN = re.compile(secret_scan.ASSIGN.replace("(?i:", "(?:"), re.I | re.A)


def base_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def test_secrets_equal_brute_force(spark):
    rng = random.Random(4)
    parts = ["password", "Token", "api_key", "APIKEY", "=", " : ", '"', "'", "abcdefghijkl", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "short", " ", "\n", "é", "deadbeef", "kPx9Lq2Zr8Vt4Wn6Yb3C", "550e8400-e29b-41d4-a716-446655440000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)] + ODD
    rows = {r["doc_id"]: r for r in secret_scan.report(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base_secrets(t or ""))
        assert rows[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert set(filter(None, base.split(","))) <= set(rows[i]["spans"].split(","))


def secrets_by_hand(t):
    """Pattern spans, and the candidates that overlap none, are on no allow-list and reach their class's threshold."""
    base = base_secrets(t)
    part = "(?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,4})"
    allowed = (secret_scan.ALLOWED[0], secret_scan.ALLOWED[1], f"^{part}(?:[-_/+=]+{part})+$", *secret_scan.ALLOWED[3:])
    out = list(base)
    for m in re.finditer(secret_scan.CANDIDATE, t):
        s = m[0]
        if any(a < m.end() and m.start() < z for a, _, z in base) or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or any(re.search(p, s) for p in allowed):
            continue
        kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "mixed" if re.search("[a-z]", s) and re.search("[A-Z]", s) else "single"
        top = max(-sum(c / 20 * math.log2(c / 20) for c in collections.Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))
        assert abs(top - secret_scan.THRESHOLDS[kind]) > 1e-9 or top >= secret_scan.THRESHOLDS[kind] - 1e-12
        if top >= secret_scan.THRESHOLDS[kind] - 1e-12:
            out.append((m.start(), 3, m.end()))
    return base, sorted(out)


def test_all_secret_spans_equal_brute_force(spark):
    rng = random.Random(41)
    letters = ["abcdef0123456789", "ABCDEF0123456789", "aB1-_/+=xYz9", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    run = lambda: "".join(rng.choice(x) for x in [rng.choice(letters)] for _ in range(rng.randrange(10, 90)))
    glue = [" ", "\n", "é", ".", " password=", "token: '", "-", "_", "AKIA", "example", "=", " abc-def-12 "]
    texts = ["".join(run() + rng.choice(glue) for _ in range(rng.randrange(1, 300 if i % 20 == 0 else 8))) for i in range(160)] + ["0123" * 5, None]
    rows = {r["doc_id"]: r for r in secret_scan.report(frame(spark, texts)).collect()}
    hidden = {r["doc_id"]: r["text"] for r in secret_scan.masked(frame(spark, texts), mask="#").collect()}
    found = 0
    for i, t in enumerate(texts):
        t = t or ""
        base, want = secrets_by_hand(t)
        assert rows[i]["spans"] == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want), t
        assert [rows[i][f"n_{k}"] for k in secret_scan.KINDS[:3]] == [sum(x[1] == k for x in base) for k in range(3)]
        found += len(want) - len(base)
        at, out = 0, ""
        for a, _, b in want:
            out += t[at:a] + "#" if a >= at else ""
            at = max(at, b)
        assert hidden[i] == out + t[at:]
    assert found > 100


def test_secrets_in_candidates_and_lists_of_a_million_characters(spark):
    rng = random.Random(3)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    run = "".join(rng.choices(chars, k=1_000_000))
    slug = "-".join("".join(rng.choices("abcdefgh", k=2)) for _ in range(340_000))
    many = " ".join(f"{rng.getrandbits(64):016x}" for _ in range(50_000))
    rows = {r["doc_id"]: r for r in secret_scan.report(frame(spark, [run, slug, many, "token=abcdefabcdef1 " * 40_000, "a1" * 500_000])).collect()}
    assert [rows[k]["spans"] for k in (0, 1, 4)] == ["entropy:0:1000000", "", "hex:0:1000000"]
    assert rows[2]["n_hex"] == 50_000 and rows[3]["n_assign"] == 40_000
    assert rows[2]["spans"].split(",")[-1] == f"hex:{17 * 49_999}:{17 * 50_000 - 1}"


def test_entropy_by_steps_equals_entropy_of_windows(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aAbB01xyz") for _ in range(rng.randrange(20, 60))) for _ in range(40)]

    def entropy(s):
        return max(-sum(c / 20 * math.log2(c / 20) for c in collections.Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", secret_scan.top_entropy(F.col("w")).alias("e")).collect()
    assert all(abs(r["e"] - entropy(r["w"])) < 1e-9 for r in got)


def test_entropy_spans_and_allow_list(spark):
    texts = ["key kPx9Lq2Zr8Vt4Wn6Yb3CfD end", "id 550e8400-e29b-41d4-a716-446655440000", "some-long-hyphenated-name-2024-version-two", "00000000000000000000000000"]
    spans = [r["spans"] for r in sorted(secret_scan.report(frame(spark, texts)).collect())]
    assert spans[0] == "entropy:4:26" and spans[1] == spans[2] == ""
    out = secret_scan.masked(frame(spark, [texts[0], "token = abcdefabcdef1234 é", None]))
    assert [r["text"] for r in sorted(out.collect())] == ["key [SECRET] end", "[SECRET] é", ""]


# --- quality rules -------------------------------------------------------------------------------------


def rules_by_hand(t):
    w = WORD.findall(t or "")
    c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), again, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bé", " ", "\n", "|", "#x", "END.", "\t", "the cat sat"]), max_size=30), min_size=1, max_size=4))
def test_measures_equal_brute_force(parts):
    texts = ["".join(p) for p in parts]
    for t in texts_of(texts):
        got = quality_rules.judge(t)
        for k in range(len(t)):
            assert tuple(got[c][k] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == rules_by_hand(texts[int(t.ids[k])])


def kept_by_hand(t):
    """Words in lines that fail a rule, and whether the document stays."""
    seen, lost = set(), 0
    for line in (t or "").split("\n"):
        w = WORD.findall(line)
        if not w:
            continue
        lone = [x in ("|", "»", "›", "·", ">") for x in w]
        letters, capitals = len(re.findall("[A-Za-z]", line)), len(re.findall("[A-Z]", line))
        failed = (
            line in seen or (w[-1][-1] not in quality_rules.CLOSING and max(len(w), sum(ord(c) >= 0x800 and not 0x2000 <= ord(c) < 0x3000 for c in line) // 2) < 5) or (sum(lone) >= 4 and 10 * sum(lone) >= len(w))
            or 3 * sum(bool(re.search(r"[#*$%&|<>]", x)) and not y for x, y in zip(w, lone, strict=True)) >= len(w) or (len(w) >= 4 and letters >= 12 and 10 * capitals >= 6 * letters)
            or any(p in lower(line) for p in quality_rules.BOILERPLATE)
        )
        seen.add(line)
        lost += len(w) * failed
    n = rules_by_hand(t)
    return lost, not n[5] and lost <= 0.5 * n[0]


def test_verdicts_equal_brute_force():
    rng = random.Random(19)
    lines = ["home | news | shop | help | more", "ALL CAPITALS ARE SHOUTING HERE", "Read our privacy policy now.", "Alle Rechte vorbehalten, 2024.", "menu", "a #b $c %d e", "short one.", "one » two » three » four » five words go", "", "  ", "«quoted» text…"]
    texts = ["\n".join(rng.choice(lines) if rng.random() < share else lorem(rng, rng.randrange(3, 16)) + rng.choice([".", "", "!"]) for _ in range(rng.randrange(0, 25))) for share in (0.1, 0.4, 0.7) for _ in range(60)]
    some = set()
    for t in texts_of(texts):
        got = quality_rules.judge(t)
        for k in range(len(t)):
            want = kept_by_hand(texts[int(t.ids[k])])
            assert (got["n_lost_words"][k], got["kept"][k]) == want
            some.add(want[1])
    assert some == {True, False}


def test_lines_close_by_code_points_in_any_script():
    lines = ["Ende mit æ", "fin en û", "これは文です。", "これは長い文で終わりの印がない", "是的", "вот так", "вот так!", "क्या है।", "a 🙂", "x”"]
    got = quality_rules.judge(texts_of(["\n".join(lines)])[0])["lines"][3].tolist()
    assert got == [True, True, False, False, True, True, False, False, True, False]
    points = quality_rules.last_points(np.frombuffer("aé。🙂".encode(), np.uint8), np.array([1, 3, 6, 10]))
    assert points.tolist() == [ord(c) for c in "aé。🙂"]


def test_rules_drop_bad_lines_and_bad_documents(spark):
    rng = random.Random(9)
    good = "\n".join(lorem(rng, 12) + "." for _ in range(8))
    menu = " | ".join(["home", "news", "about", "shop", "help", "login", "cart", "more"])
    bad = "\n".join(menu + f" | x{i}" for i in range(10))
    texts = [good, f"{menu}\n{good}\nAll rights reserved by us.", bad, good.upper(), *ODD]
    rows = {r["doc_id"]: r for r in quality_rules.clean(frame(spark, texts)).collect()}
    assert [rows[i]["kept"] for i in range(4)] == [True, True, False, False]
    assert rows[1]["cleaned"] == good and not any(rows[i]["kept"] for i in range(4, 4 + len(ODD)))


# --- language model ------------------------------------------------------------------------------------


def test_language_model_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [*ODD, *[lorem(rng, rng.randrange(1, 60)) for _ in range(80)]]
    got = {r["doc_id"]: r for r in hmm.score(frame(spark, texts), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, passes=1).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    toks = [[*WORD.findall(lower(t)), None] for t in texts]
    c = collections.Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_a_start_is_bounded_whatever_the_ids(spark, monkeypatch):
    """All rows with one id, one of them most of all tokens: what reaches the driver stays about START_TOKENS."""
    monkeypatch.setattr(hmm, "START_TOKENS", 4096)
    rng = random.Random(4)
    rows = [(7, lorem(rng, 300)) for _ in range(150)] + [(7, lorem(rng, 60_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    encoded = hmm.encode(docs, hmm.Lexicon(hmm.counts(docs), 100))
    total = encoded.agg(F.sum("n_tokens")).first()[0]
    some = hmm.start_pieces(encoded, total // 4096)
    assert 1024 < sum(map(len, some)) < 3 * 4096
    whole = hmm.start_pieces(encoded, 1)
    assert sum(map(len, whole)) == total


def test_rare_tokens_by_join_score_like_broadcast_ones(spark, monkeypatch):
    rng = random.Random(1)
    docs = frame(spark, [lorem(rng, 30) + f" only{i % 9}" for i in range(40)])
    held = F.col("doc_id") % 5 == 0
    whole = sorted(hmm.score(docs, held, passes=1).collect())
    monkeypatch.setattr(hmm, "KNOWN", 64)
    split = sorted(hmm.score(docs, held, passes=1).collect())
    for a, b in zip(whole, split, strict=True):
        assert a[:5] == b[:5] and math.isclose(a["base_score"], b["base_score"], rel_tol=1e-9)


def test_rows_that_repeat_an_id_score_each_by_itself(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i % 7, lorem(rng, 20) + f" only{i}") for i in range(30)] + [(3, "same text twice over")] * 2 + [(3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(hmm.score(docs, F.lit(False), passes=1, words=8).collect())
    monkeypatch.setattr(hmm, "KNOWN", 512)
    split = sorted(hmm.score(docs, F.lit(False), passes=1, words=8).collect())
    assert all(a[:5] == b[:5] and math.isclose(a["base_score"], b["base_score"], rel_tol=1e-9) and math.isclose(a["score"], b["score"], rel_tol=1e-6) for a, b in zip(whole, split, strict=True))
    assert all(r["n_known"] == r["n_tokens"] for r in whole) and len(whole) == len(rows)


CLASSES = hmm.WORDS + hmm.BUCKETS + 1


def counts_by_hand(model, seq):
    """Expected starts, transitions and emissions of one whole sequence."""
    a, b, pi = model["a"], model["b"], model["pi"]
    n, k = len(seq), hmm.STATES
    al, be = np.zeros((n, k)), np.ones((n, k))
    al[0] = pi * b[:, seq[0]]
    al[0] /= al[0].sum()
    for t in range(1, n):
        al[t] = (al[t - 1] @ a) * b[:, seq[t]]
        al[t] /= al[t].sum()
    for t in range(n - 2, -1, -1):
        be[t] = a @ (b[:, seq[t + 1]] * be[t + 1])
        be[t] /= be[t].sum()
    g = al * be
    g /= g.sum(1, keepdims=True)
    trans = np.zeros((k, k))
    for t in range(1, n):
        pair = al[t - 1][:, None] * a * (b[:, seq[t]] * be[t])[None, :]
        trans += pair / pair.sum()
    emit = np.zeros_like(b)
    np.add.at(emit.T, seq.astype(int), g)
    return np.concatenate([g[0], trans.ravel(), emit.ravel()])


def test_expected_counts_are_those_of_whole_texts():
    rng = np.random.default_rng(4)
    model = hmm.start_model(classes=60)
    seqs = [rng.integers(0, 60, n).astype("<u2") for n in (1, 5, 127, 128, 129, 256, 257, 700)]
    for _ in range(2):
        got = hmm.expected(model, seqs)
        want = sum(counts_by_hand(model, s) for s in seqs)
        assert np.allclose(got[:-1], want, rtol=2e-3, atol=2e-3)
        assert math.isclose(got[-1], hmm.likelihood(model, seqs).sum(), rel_tol=1e-4)
        model = hmm.updated(got)


def test_words_with_classes_are_a_parameter(spark):
    rng = random.Random(1)
    docs = frame(spark, [lorem(rng, 30) for _ in range(40)])
    few, many = (sorted(hmm.score(docs, F.col("doc_id") % 5 == 0, passes=1, words=n).collect()) for n in (10, 20_000))
    assert all(a[:6] == b[:6] and math.isfinite(a["score"] + b["score"]) for a, b in zip(few, many, strict=True))
    with pytest.raises(ValueError):
        hmm.score(docs, F.lit(False), words=70_000)


def forward_by_hand(model, seq):
    a, log = model["pi"] * model["b"][:, seq[0]], 0.0
    for x in seq[1:]:
        s = a.sum()
        a, log = (a / s @ model["a"]) * model["b"][:, x], log + math.log10(s)
    return math.log10(a.sum()) + log


def test_likelihood_is_the_exact_forward_recursion():
    rng = np.random.default_rng(0)
    model = hmm.start_model()
    seqs = [rng.integers(0, CLASSES, n).astype("<u2") for n in (1, 2, 50, 128, 129, 70, 256)]
    short = [s[:60] for s in seqs]
    assert np.allclose(hmm.likelihood(model, short), [forward_by_hand(model, s) for s in short], rtol=1e-9)
    assert np.allclose(hmm.likelihood(model, seqs), [forward_by_hand(model, s) for s in seqs], rtol=1e-9)


def test_baum_welch_never_loses_likelihood_and_sums_to_one():
    rng = np.random.default_rng(0)
    seqs = [np.concatenate([rng.integers(0, 20, 60) + 40 * (k % 2), [CLASSES - 1]]).astype("<u2") for k in range(40)]
    model, seen = hmm.start_model(), []
    for _ in range(8):
        sums = hmm.expected(model, seqs)
        seen.append(sums[-1])
        model = hmm.updated(sums)
        assert np.allclose([model["pi"].sum(), *model["a"].sum(1), *model["b"].sum(1)], 1)
    assert all(b > a - 1e-3 * abs(a) for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0] + 50


def test_the_model_beats_the_base_on_texts_held_out(spark, data):
    rows = queries.op8_hmm(spark, data.replace("0.001", "0.01")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


# --- classifier ----------------------------------------------------------------------------------------


def test_classifier_on_labels_held_out(spark, data):
    d = data.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    got = queries.op9_quality_classifier(spark, d).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_summed_equations_equal_a_plain_solve_over_all_rows(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = classifier.fit(classifier.measured(docs.repartition(7)), labels)
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    rows = [r for r in docs.collect() if r["doc_id"] in y]
    x = np.concatenate([classifier.statistics(t) for t in texts_of([r["text"] for r in rows])])
    target = np.array([y[r["doc_id"]] for r in rows], float)
    assert np.allclose(model["mean"], x.mean(0)) and np.allclose(model["scale"], np.sqrt(np.maximum(x.var(0), 1e-8)))
    w = np.where(target > 0.5, len(target) / (2 * target.sum()), len(target) / (2 * (1 - target).sum()))
    z = classifier._mapped(x, model)
    beta = np.linalg.solve((z * w[:, None]).T @ z + classifier.RIDGE * np.eye(z.shape[1]), (z * w[:, None]).T @ (2 * target - 1))
    assert np.allclose(model["beta"], beta, atol=1e-6)


def test_classifier_without_labels_and_on_odd_texts(spark):
    docs = frame(spark, ODD)
    stats = classifier.measured(docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classifier.score(stats, classifier.fit(stats, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "doc_id long, quality int")
    assert {r["score"] for r in classifier.score(stats, classifier.fit(stats, one)).collect()} == {1.0}
    both = spark.createDataFrame([(k, k % 2) for k in range(len(ODD))], "doc_id long, quality int")
    model = classifier.fit(stats, both)
    assert all(0 <= r["score"] <= 1 for r in classifier.score(stats, model).collect())
    assert classifier.keep(docs, model).columns == docs.columns


def test_isotonic_blocks():
    assert np.allclose(classifier._monotone(np.array([1.0, 0, 1, 0, 1]), np.ones(5)), [1 / 2, 1 / 2, 1 / 2, 1 / 2, 1])


# --- archives ------------------------------------------------------------------------------------------


def records(n, compress):
    body = [f"<html>{i}</html>".encode() * 20 for i in range(n)]
    return [warc.page_record(i, f"http://x/{i}", b, hashlib.sha256(b).hexdigest(), None, "2024-01-01T00:00:00Z", compress) for i, b in enumerate(body)], body


class Bytes:
    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def read(self, n):
        n = min(n, 700)
        out = self.raw[self.at : self.at + n]
        self.at += n
        return out


def test_folded_fields_and_messages_without_a_blank_line():
    block = b"<html>" + b"x" * 200
    folded = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://a.example/\r\n long/path\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\n" + b"y" * (3 << 20)
    http = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    reader = warc.Salvage(io.BytesIO(folded + http + folded))
    found = list(reader)
    assert [f.size for f in found] == [len(block), len(body), len(block)] and not reader.gaps
    assert found[0].fields["warc-target-uri"] == "http://a.example/ long/path"
    assert found[1].digest == hashlib.sha256(body).hexdigest()


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_goes_on_after_damage(compress):
    recs, body = records(6, compress)
    whole = warc.Salvage(Bytes(b"".join(recs)))
    assert [r.block for r in whole] == body and whole.gaps == []
    bad = bytearray(recs[2])
    bad[len(bad) // 2] ^= 0xFF
    raw = recs[0] + recs[1] + bytes(bad) + b"junk between" + recs[3] + recs[4] + recs[5][:-9]
    start = len(recs[0]) + len(recs[1])
    for again in (None, lambda at: Bytes(raw[at:])):
        found = warc.Salvage(Bytes(raw), again=again)
        assert [r.fields["warc-record-id"] for r in found] == [f"<urn:page:{k}>" for k in (0, 1, 3, 4)]
        assert [(a, b) for a, b, _ in found.gaps] == [(start, start + len(bad) + 12), (len(raw) - len(recs[5]) + 9, len(raw))]


def test_records_of_other_writers():
    body = b"<p>hello</p>" * 30
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    kinds = [
        ([("WARC-Payload-Digest", sha1(body)), ("WARC-Block-Digest", sha1(http))], True), ([("WARC-Payload-Digest", "sha256:" + hashlib.sha256(body).hexdigest())], True), ([], True),
        ([("WARC-Payload-Digest", "sha256:" + hashlib.sha256(http).hexdigest())], False), ([("WARC-Block-Digest", sha1(body))], False), ([("WARC-Payload-Digest", "blake3:00")], True),
    ]
    raw = b"".join(warc.encode([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{k}>"), ("Content-Type", "application/http; msgtype=response"), *f], http) for k, (f, _) in enumerate(kinds))
    found = warc.Salvage(Bytes(raw))
    got = list(found)
    assert [r.fields["warc-record-id"] for r in got] == [f"<urn:{k}>" for k, (_, ok) in enumerate(kinds) if ok] and len(found.gaps) == 1  # two bad records side by side
    assert {(r.size, r.digest) for r in got} == {(len(body), hashlib.sha256(body).hexdigest())} and got[0].block == http
    chunked = http.replace(b"Content-Type", b"Transfer-Encoding: chunked\r\nContent-Type")
    assert len(list(warc.Salvage(Bytes(warc.encode([("WARC-Type", "response"), ("Content-Type", "application/http"), ("WARC-Payload-Digest", sha1(b"else"))], chunked))))) == 1


@pytest.mark.parametrize("compress", [True, False])
def test_long_records_are_read_without_being_held(compress):
    body = [b"x" * 3_000_000, b"short", bytes(range(256)) * 20_000]
    recs = [warc.page_record(i, "u", b, hashlib.sha256(b).hexdigest(), None, "t", compress) for i, b in enumerate(body)]
    raw = b"".join(recs)
    found = warc.Salvage(Bytes(raw), 1000, lambda at: Bytes(raw[at:]))
    most = 0
    for k, r in enumerate(found):
        assert (r.size, r.digest, r.block) == (len(body[k]), hashlib.sha256(body[k]).hexdigest(), body[k] if k == 1 else None)
        assert (r.start, r.end) == (sum(map(len, recs[:k])), sum(map(len, recs[: k + 1])))
        most = max(most, len(found.buf))
    assert k == 2 and most < 2000


def test_one_payload_on_most_pages(spark):
    page = "<html>error</html>" * 20
    rows = [(i, "u", page if i % 10 else f"{page}{i}") for i in range(3000, 0, -1)] + [(7, "again", page)]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 3001
    for r in got:
        copy = r["page_id"] % 10 != 0 and r["page_id"] > 1
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if copy else ("response", None))


@pytest.mark.parametrize("plenty", [10, 10_000])
def test_dealt_join(spark, monkeypatch, plenty):
    monkeypatch.setattr("ticklake.llm.common.PLENTY", plenty)
    left = spark.range(0, 5000).selectExpr("if(id < 4000, 1, id) AS k", "id AS v")
    right = spark.range(0, 4800).selectExpr("id AS k", "id * 2 AS w")
    got = dealt_join(left, right, "k", "left").collect()
    assert sorted((r["k"], r["v"], r["w"]) for r in got) == sorted((1 if v < 4000 else v, v, 2 if v < 4000 else 2 * v if v < 4800 else None) for v in range(5000))


def test_archives_round_trip(spark):
    long = "<p>" + "é" * 40_000
    pages = spark.createDataFrame([(5, "u", long), (3, None, long), (9, "u\r\nInjected: x", long), (1, "a", "short"), (2, "b", "short"), (4, "c", None), (6, "d", "")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in warc.round_trip(spark, pages).collect()}
    assert len(rows) == 7 and rows[3]["record_type"] == "response" and rows[5]["refers_to"] == rows[9]["refers_to"] == 3
    assert {rows[k]["record_type"] for k in (1, 2, 4, 6)} == {"response"} and rows[5]["payload_bytes"] == len(long.encode())
    assert rows[4]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


# --- all of them ---------------------------------------------------------------------------------------


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert minhash.groups(docs).count() == minhash.deduplicate(docs).count() == 0
    assert pii.report(docs).count() == secret_scan.report(docs).count() == quality_rules.clean(docs).count() == 0
    assert token_files.digest(spark, docs).count() == mixing.mix(docs).count() == mixing.mixed(docs).count() == 0
    assert decontam.leaks(docs, bench).count() == decontam.clean(docs, bench).count() == 0
    assert hmm.score(docs, F.lit(False), passes=1).count() == 0
    stats = classifier.measured(docs)
    assert classifier.score(stats, classifier.fit(stats, none)).count() == 0


def test_rows_without_an_id(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(None, item, None), (0, "other text altogether here", "a"), (None, None, "a")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    for whole in (pii.report(docs), secret_scan.report(docs), quality_rules.clean(docs), mixing.mix(docs), decontam.clean(docs.drop("source"), bench.limit(0)), classifier.score(classifier.measured(docs), {"const": 0.5})):
        assert ids(whole) == [0, None, None]
    for named in (minhash.groups(docs), token_files.digest(spark, docs), hmm.score(docs, F.lit(False), passes=1)):
        assert ids(named) == [0]
    assert decontam.leaks(docs, bench).count() == 0 and decontam.clean(docs, bench).count() == 2
    pages = spark.createDataFrame([(None, "u", "x"), (1, None, None)], "page_id long, url string, html string")
    assert [r["page_id"] for r in warc.round_trip(spark, pages).collect()] == [1]


def test_repeated_and_null_ids_and_clashing_columns_in_all_operators(spark):
    """Every row is reported by its own text; operators that must name a row leave out those without an id; no helper column clashes."""
    rng = random.Random(13)
    item = "one two three four five six seven eight nine ten eleven twelve"
    long = "x" * 50_000 + " " + lorem(rng, 3_000)
    texts = [f"mail a@b.co {lorem(rng, 60)}", f"token=abcdefabcdef1 {lorem(rng, 60)}", f"see {item} here", None, "", long, lorem(rng, 60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[1]), (0, texts[0]), (0, texts[0]), (None, texts[0]), (None, None), (5, item)]
    clash = ["id", "hash", "row", "n", "sid", "rank", "times", "time", "size", "key", "kept", "score", "fold", "h", "bands", "rep", "said", "held", "digest", "first", "__piece", "__n", "__key", "x", "y"]
    docs = spark.createDataFrame([(i, t, "s", *range(len(clash))) for i, t in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in clash))
    named = [r for r in rows if r[0] is not None]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    ids = lambda df: collections.Counter(r["doc_id"] for r in df.collect())
    everyone, with_id = collections.Counter(i for i, _ in rows), collections.Counter(i for i, _ in named)
    for all_ in (pii.report(docs), pii.masked(docs), secret_scan.report(docs), secret_scan.masked(docs), quality_rules.clean(docs), mixing.mix(docs), classifier.score(classifier.measured(docs), {"const": 0.5})):
        assert ids(all_) == everyone
    for some in (minhash.groups(docs), token_files.digest(spark, docs), hmm.score(docs, F.lit(None).cast("boolean"), passes=1)):
        assert ids(some) == with_id
    assert ids(decontam.leaks(docs, bench)) == {2: 1, 5: 1}
    by = lambda df, *c: collections.Counter((r["doc_id"], *(r[x] for x in c)) for r in df.collect())
    found = by(pii.report(docs), "n_email")
    assert found[0, 1] == 3 and found[0, 0] == 1 and found[None, 1] == 1
    assert by(secret_scan.report(docs), "n_assign")[0, 1] == 1
    assert by(token_files.digest(spark, docs), "n_tokens")[5, len(token_files.encoder(token_files.tokenizer_path()).library.encode(item, add_special_tokens=False).ids) + 1] == 1
    stats = classifier.measured(docs)
    model = classifier.fit(stats, spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int"))
    for whole in (minhash.deduplicate(docs), decontam.clean(docs, bench), mixing.mixed(docs), classifier.keep(docs, model), secret_scan.masked(docs)):
        assert whole.columns == docs.columns and whole.count() >= 0
    # Two of the six texts are alike enough; then those without words and without an id.
    assert minhash.deduplicate(docs).count() == 5 + 2 + 2
    pages = spark.createDataFrame([(i, "u", t, *range(len(clash))) for i, t in rows], "page_id long, url string, html string, " + ", ".join(f"`{c}` int" for c in clash))
    assert collections.Counter(r["page_id"] for r in warc.round_trip(spark, pages).collect()) == with_id


def test_queries_have_their_contracts_columns(spark, data):
    want = {
        "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_minhash": "doc_id n_shingles component_id kept", "op3_token_files": "doc_id start n_tokens ids_crc32",
        "op4_mixing": "doc_id size source_size target taken", "op6_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans", "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op8_hmm": "doc_id held_out n_tokens n_known train_tokens base_score score", "op9_quality_classifier": "doc_id held_out score predicted", "op10_warc": "page_id payload_bytes payload_digest record_type refers_to",
    }
    for name, columns in want.items():
        df = queries.queries()[name](spark, data)
        assert set(columns.split()) <= set(df.columns), name
        table = "pages" if name == "op10_warc" else "documents"
        assert df.count() == spark.read.parquet(f"{data}/{table}.parquet").count(), name


def test_texts_of_slices():
    b = pa.RecordBatch.from_arrays([pa.array([7, 8, None], pa.int64()), pa.array([None, "é x", "y"])], names=["doc_id", "text"])
    t = as_texts(b.slice(1))
    assert (t.text(0), t.text(1), t.ids.tolist()) == ("é x", "y", [8, 0])
