"""Clustering, main text and conversation tries against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticklake.llm import clustering, conversations, html_text, queries

# --- clustering --------------------------------------------------------------------------------------


def clusters_by_hand(rows, dims, k, rounds):
    kept = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()), r[1]))
    centroids = [v for _, v in seeds[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, v in kept:
            of[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(of[j]) for x in zip(*of[j], strict=True)] if of[j] else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = collections.Counter()
    for _, d, j in found:
        sums[j] += d
    cut = lambda n: min(n, 2**63 - 1)
    return sorted(((i, j, cut(d), cut(sums[j]), cut(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def clusters(spark, rows, kind="double", **options):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, id int, x int").repartition(3)
    return sorted((tuple(r) for r in clustering.cluster(df, **options).collect()), key=str)


@pytest.mark.parametrize("big", [0.0, 30_000.0, 1e12, 1e30, 1e306])
def test_clusters_equal_brute_force_at_any_magnitude(spark, big):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    if big:
        rows += [(100 + i, [rng.choice([-1, 1]) * big, 1.5, rng.uniform(-big, big), -0.3]) for i in range(6)]
    assert clusters(spark, rows, dims=4, k=5, rounds=3) == clusters_by_hand(rows, 4, 5, 3)


def test_clusters_of_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [5.0, 1.0]), (None, [2.0, 2.0]), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 0.0]), (5, [1.0]), (6, None), (7, []), (8, [1.0, 2.0, 3.0]), (9, [-0.001, 4.0])]
    got = clusters(spark, rows, dims=2, k=40, rounds=5)
    assert got == clusters_by_hand(rows, 2, 40, 5) and len(got) == 5
    assert clusters(spark, rows[4:9], dims=2) == []
    assert clusters(spark, [], dims=2) == []
    same = [(i, [1.0, 1.0]) for i in range(30)]  # ties go to the smaller cluster, the others stay empty
    assert {r[1:3] for r in clusters(spark, same, dims=2, k=4, rounds=2)} == {(0, 0)}
    assert clusters(spark, rows[:4], kind="float", dims=2, k=2, rounds=1) == clusters_by_hand(rows[:4], 2, 2, 1)


def test_products_are_exact_up_to_the_bound():
    rng = np.random.default_rng(5)
    limit = clustering.Centroids([[0] * 64], 256).limit
    assert 64 * (2 * limit) ** 2 < 2**53
    c = clustering.Centroids([[limit, -limit] * 32, [-limit] * 64, [limit - 1] * 64], 256)
    x = rng.integers(-limit, limit + 1, (50, 64))
    x[0], x[1] = limit, -limit
    best, distance, _ = c.nearest(x / 256)
    want = [min((sum((int(a) - b) ** 2 for a, b in zip(v, r, strict=True)), k) for k, r in enumerate(c.rows)) for v in x]
    assert [(int(d), int(b)) for d, b in zip(distance, best, strict=True)] == want


# --- main text ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field(spark):
    return html_text.Field.load(html_text.trained(spark))


def likely(field, scores, steps, labels):
    total, before = field.moves[3][0][labels[0]], 0
    for i, y in enumerate(labels):
        if i:
            total += field.moves[steps[i]][before][y]
        total, before = total + scores[i] * y, y
    return total


def test_likelihood_gradient_and_viterbi_equal_enumeration():
    rng = np.random.default_rng(1)
    field = html_text.Field(np.zeros(4), rng.normal(size=(4, 2, 2)))
    lengths, longest = np.array([1, 3, 6, 7]), 7
    scores, labels = rng.normal(size=(longest, 4)), rng.integers(0, 2, (longest, 4))
    steps = rng.integers(0, 3, (longest, 4))
    steps[0] = 3
    got, by_score, by_move = html_text.likelihood(field, scores, steps, labels, lengths)
    want, want_score = 0.0, np.zeros((longest, 4))
    for p, n in enumerate(lengths):
        every = list(itertools.product((0, 1), repeat=int(n)))
        value = np.array([likely(field, scores[:n, p], steps[:n, p], y) for y in every])
        chance = np.exp(value - np.logaddexp.reduce(value))
        want += likely(field, scores[:n, p], steps[:n, p], labels[:n, p]) - np.logaddexp.reduce(value)
        want_score[:n, p] = labels[:n, p] - (np.array(every) * chance[:, None]).sum(axis=0)
        assert tuple(field.viterbi(scores[:n, p].tolist(), steps[:n, p].tolist())) == every[int(value.argmax())]
    assert got == pytest.approx(want) and np.allclose(by_score, want_score)
    k, a, b = 1, 0, 1  # a move's gradient by a small difference
    field.moves[k, a, b] += 1e-6
    assert (html_text.likelihood(field, scores, steps, labels, lengths)[0] - got) / 1e-6 == pytest.approx(by_move[k, a, b], abs=1e-4)


def texts(page):
    return [b.text for b in html_text.blocks(page)]


def test_blocks_of_wrong_markup():
    assert texts("<") == ["<"] and texts("") == texts("<p></p>") == texts("<script>x</script>") == texts("<!-- x") == texts("<p title='x") == []
    assert texts("a<br>b  c\n\td<p>e<b>f</p>g") == ["a b c d", "ef", "g"]
    assert texts("<p>one<p>two<div>three<p>four</div>five") == ["one", "two", "three", "four", "five"]
    assert texts('<script>var t="</p>";</script><style>p{}</style><p>x</p><script>y') == ["x"]
    assert texts('<p title="a>b" class=c>x</p><p data-x=\'"\'>y</p>') == ["x", "y"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("&lt;b&gt; &amp;amp; &copy &#233;&#xe9; &#99999999999; &unknown; 1 < 2 </ x>y") == ["<b> &amp; © éé � &unknown; 1 < 2 y"]
    assert texts("&#" + "9" * 6000 + ";x") == ["�x"]
    assert texts("<title>no</title><head><title>no</title></head><body>yes<template><p>no</p></template>") == ["yes"]
    assert texts("<div></p></span></div><h1>a<h2>b</h2>c") == ["a", "b", "c"]
    assert texts("a<!-->b<!--->c<!-- > -->d<!x>e<?y>f") == ["abcdef"]
    linked = html_text.blocks("<li><a href=x>ab</a> cd</li><li>ef</li>")
    assert [(b.text, b.linked) for b in linked] == [("ab cd", 2), ("ef", 0)]


def test_pages_are_read_in_linear_time():
    for unit in ("<div>", "<p>a", "<a href='", "</b><p>", "<li>x", "<!--", '<p title="', "<td>", "&#", "<b", "<ul><li>", "<script>", "<div class=c></span>"):
        took = []
        for n in (20_000, 80_000):
            start = time.perf_counter()
            html_text.blocks(unit * n)
            took.append(time.perf_counter() - start)
        assert took[1] < 12 * took[0] + 0.3, unit


PAGE = (
    "<!DOCTYPE html><html><head><title>{0}</title><style>p{{}}</style></head><body><header><a href=/>Site</a><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav></header>"
    '<div class="cookie-notice"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><div class="ad">Buy now, it was never cheaper than today.</div>'
    '<div class="wrap"><article><h1>{0}</h1><p>{1}</p><div class="ad">Only today, two for the price of one.</div><p>{2}<p>{3}</article>'
    "<aside><h3>Related</h3><ul><li><a href=/x>Another story that you may like</a></li></ul><p>Some words on the writer of this page.</p></aside></div>"
    '<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this one, it was good to read.</p></div><form><label>Your name</label><textarea>say something</textarea></form></section>'
    "<footer>&copy; 2020 Site &middot; All the words that stand here belong to someone.</footer></body></html>"
)


def test_main_text_of_a_page_with_everything(field):
    parts = ["A title of words", "The first part has some words, and ends with a stop.", "The second part &amp; what it says. It goes on for a while, as parts do.", "The last part is here."]
    got = html_text.main_text(PAGE.format(*parts), field)
    assert got == "\n".join(p.replace("&amp;", "&") for p in parts)


def test_labels_of_pages_held_out(field):
    right = blocks = 0
    for page in html_text.labelled(150, seed=77):
        found = html_text.blocks(page)
        groups, steps = html_text.encode(found)
        right += sum(b.label == y for b, y in zip(found, field.viterbi(field.scores(groups), steps), strict=True))
        blocks += len(found)
    assert right > 0.98 * blocks


def test_texts_of_the_tables_pages(spark, data):
    """All blocks in the article of every page, and none other."""
    rows = queries.op12_html_text(spark, data).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert len(rows) == len(pages) and rows[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    for r in rows:
        body = re.search("(?s)<article>(.*)</article>", pages[r["page_id"]]["html"])[1]
        assert r["text"] == "\n".join(texts(body)) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_odd_pages(spark, field):
    long = "<article>" + "<p>Some words that are a sentence, and more.</p>" * 20_000 + "</article>"
    pages = [(1, "u", None), (1, None, ""), (None, "u", "   "), (2, "u", "<html>"), (3, "u", long), (3, "u", "\x00<p>\x00"), (4, "u", "plain")]
    df = spark.createDataFrame([(*p, "c", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    rows = html_text.extract(df, field=field).collect()
    assert collections.Counter((r["page_id"], r["url"]) for r in rows) == collections.Counter(p[:2] for p in pages)
    assert {r["n_chars"] for r in rows if r["page_id"] in (1, None, 2)} == {0} and all(r["text"] == "" for r in rows if not r["n_chars"])
    assert max(r["n_chars"] for r in rows) == 20_000 * len("Some words that are a sentence, and more.") + 19_999
    assert html_text.extract(df.limit(0), field=field).count() == 0


# --- conversations ------------------------------------------------------------------------------------


def trie_by_hand(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [v[-1] for v in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]
    members = collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(m[:-1] == n for m in members if m)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(1 for m in members if m and m[:-1] == node), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def tries(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, b"x") for r in rows], "conv_id long, turn long, role string, text string, base int, c int, node binary").repartition(3)
    return sorted((tuple(r) for r in conversations.trie(df).collect()), key=str)


def test_tries_equal_brute_force(spark):
    rng = random.Random(9)
    said = ["hi", "é 🙂", "", None, "yes", "no"]
    for ids in (list(range(0, 12)) + list(range(205, 260)), list(range(-130, 20)), [300 + i for i in range(0, 100, 7)] + [5, 7, 100]):
        rows = []
        for c in ids:
            rows += [(c, t, rng.choice(["user", "bot", None]) if t > 1 else "user", rng.choice(said)) for t in range(rng.choice([1, 2, 3, 5, 8]))]
        rng.shuffle(rows)
        assert tries(spark, rows) == trie_by_hand(rows)


def test_tries_of_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, None, None, None), (1, 2, "a", "x"), (1, 2, "a", "x"), (1, 2, "a", "y"), (2, 5, "a", "x" * 100_000), (101, 0, "u", "only"), (102, 0, "u", "only")]
    assert tries(spark, rows) == trie_by_hand(rows)
    assert tries(spark, []) == tries(spark, rows[:1]) == []
    alike = [(c, t, "u", f"turn {t}") for c in range(0, 900, 3) for t in range(7)]  # one conversation, many times
    assert tries(spark, alike) == trie_by_hand(alike)


def test_a_long_conversation_goes_on_in_parts(monkeypatch):
    monkeypatch.setattr(conversations, "NODES", 10)
    rows = [(0, c, hashlib.sha256(f"{t % 7}".encode()).digest(), 3) for c in (0, 1, 2) for t in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["base", "c", "said", "chars"])
    parts = [r for b in conversations._tries(iter([batch.slice(0, 55), batch.slice(55)])) for r in b.to_pylist()]
    nodes = collections.defaultdict(lambda: [0, 99])
    for r in parts:
        if r["kind"] == conversations.NODE:
            nodes[r["node"]] = [nodes[r["node"]][0] + r["n"], min(nodes[r["node"]][1], r["c"])]
    steps = collections.defaultdict(list)
    for r in parts:
        if r["kind"] == conversations.STEP:
            steps[r["node"]].append(r["c"])
    assert {n: [len(c), min(c)] for n, c in steps.items()} == dict(nodes)
    assert sum(r["kind"] == conversations.NODE for r in parts) > len(nodes)  # some in two parts


def test_joined_ids_are_hashed_as_one_string(monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 20)
    rows = [(b"a", 100 * i, ",".join(str(100 * i + j) for j in range(3))) for i in range(9)] + [(b"b", 0, "7")]
    batch = conversations._pieces(rows)
    long = list(conversations._longer(iter([batch.slice(0, 4), batch.slice(4)])))
    assert sum(b.num_rows for b in long) < len(rows)
    got = {r["node"]: r["ends_sha256"] for b in conversations._digests(iter(long)) for r in b.to_pylist()}
    assert got == {b"a": hashlib.sha256(",".join(r[2] for r in rows[:9]).encode()).hexdigest(), b"b": hashlib.sha256(b"7").hexdigest()}


def test_queries_have_their_contracts_columns(spark, data):
    want = {
        "op11_clustering": ("embeddings", "vec_id cluster distance cluster_inertia inertia centroid_sha256"), "op12_html_text": ("pages", "page_id url text n_chars"),
        "op13_conversation_trie": (None, "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"),
    }
    for name, (table, columns) in want.items():
        df = queries.queries()[name](spark, data)
        assert df.columns == columns.split()
        assert df.count() == spark.read.parquet(f"{data}/{table}.parquet").count() if table else df.where(F.col("depth") == 0).count() == 1
