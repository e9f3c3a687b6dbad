"""Personal data by patterns and by a character-level bidirectional LSTM with CRF transitions.

Pattern matches are found in the runs of characters that can hold them (a match never leaves its
run, so looking at runs alone finds exactly what looking at whole texts does), each in time linear in
its run: an address is looked for from its at sign backwards, numbers with dots by whole parts.

The network is trained here, in numpy, from labelled spans: windows of made-up text with e-mail
addresses, addresses of hosts, card and phone numbers in many shapes, and look-alikes without a label.
Weights are kept in the shared folder by what they follow from, so one process trains for all.
Texts are cut into overlapping windows. A window without a digit, an at sign and an "at" or "dot" in
brackets can't hold a span that plausible() lets through and isn't run, unless a span is cut by its
edge. Each window is decoded by Viterbi into spans with a confidence; pieces of a span that windows'
edges cut are put together where they overlap, however long the span is, and per document the spans of
all windows are reconciled: of those that overlap, the set with the highest total confidence stays
(weighted interval scheduling; of equal sets that with the earlier end). A span on a piece of an
address with "at" in brackets is widened to all of it. Model spans are added where no pattern's span
is and where the span's own text is in order (Luhn for cards, digits and separators for phones).

Null and empty texts have no spans; very long texts are read whole. Offsets count code points; ends
are exclusive. Every row is reported by itself: rows without an id or with one that repeats stay, in
their order; repeated texts get equal results. Only the id and the text are read, whatever other
columns are called. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import inspect
import io
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from .common import Texts, map_texts, shared_file

KINDS = ("email", "ip", "card", "phone")
# Fixed values of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The same matches, without trying again what can't succeed.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
BRACKETED = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+((\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)+")

WINDOW, STRIDE, HIDDEN = 96, 48, 16
CONFIDENT = 0.85
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
#: Classes of characters: padding, other, digit, outside ASCII, white space, 26 letters, and these.
MARKS = "@.-_+()[]:/%,#*'\"="


def _classes() -> np.ndarray:
    c = np.ones(256, np.int64)
    c[48:58], c[128:], c[[9, 10, 11, 12, 13, 32]] = 2, 3, 4
    for i in range(26):
        c[97 + i] = c[65 + i] = 5 + i
    for i, m in enumerate(MARKS):
        c[ord(m)] = 31 + i
    return c


CLASS = _classes()
N_CLASS = 31 + len(MARKS)


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


# --- patterns --------------------------------------------------------------------------------


def _set(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_DIGITS = "0123456789"
_WORD = "".join(map(chr, [*range(65, 91), *range(97, 123)])) + _DIGITS
_RUNS = (_set(_WORD + "._%+-@"), _set(_DIGITS + "."), _set(_DIGITS + " -"), _set(_DIGITS + "+ ().-"))
_IS_DIGIT = _set(_DIGITS)


def _good(kind: int, text: str) -> bool:
    digits = "".join(c for c in text if c.isdigit())
    if kind == 1:
        return all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in text.split(".")))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 9 <= len(digits) <= 15


def _matches(kind: int, run: str) -> Iterator[tuple[int, int]]:
    """What the kind's pattern matches in a run, leftmost and without overlap."""
    if kind == 0:
        last, start = 0, 0  # the match before, and the name before this sign
        for at in (i for i, c in enumerate(run) if c == "@"):
            m = DOMAIN.match(run, at) if at > max(start, last) else None
            if m:
                yield max(start, last), m.end()
                last = m.end()
            start = at + 1
    elif kind == 1:
        for m in DOTTED.finditer(run):
            ends = [m.start() - 1, *(m.start() + i for i, c in enumerate(m[0]) if c == "."), m.end()]
            for k in range(0, len(ends) - 4, 4):
                yield ends[k] + 1, ends[k + 4]
    else:
        for m in (DIGITS if kind == 2 else PHONE).finditer(run):
            yield m.span()


def pattern_spans(chars: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of each document's matches, by kind, then start. chars: lead bytes of code points."""
    n = len(offsets) - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    digit = _IS_DIGIT[chars]
    after = np.zeros(len(chars), bool)
    after[:-1] = digit[1:]
    before = np.zeros(len(chars), bool)
    before[1:] = digit[:-1]
    anchors = (chars == 64, (chars == 46) & after & before, digit, (chars == 43) & after)
    for kind, (run, anchor) in enumerate(zip(_RUNS, anchors, strict=True)):
        at = np.flatnonzero(anchor)
        if not len(at):
            continue
        breaks = np.flatnonzero(~run[chars])
        doc = np.searchsorted(offsets, at, "right") - 1
        k = np.searchsorted(breaks, at)
        lo = np.where(k > 0, breaks[np.maximum(k - 1, 0)] + 1 if len(breaks) else 0, 0)
        hi = np.where(k < len(breaks), breaks[np.minimum(k, max(len(breaks) - 1, 0))] if len(breaks) else len(chars), len(chars))
        lo, hi = np.maximum(lo, offsets[doc]), np.minimum(hi, offsets[doc + 1])
        lo, first = np.unique(lo, return_index=True)
        hi, doc = hi[first], doc[first]
        if kind == 2:
            sums = np.concatenate([[0], np.cumsum(digit)])
            keep = sums[hi] - sums[lo] >= 13
            lo, hi, doc = lo[keep], hi[keep], doc[keep]
        for a, b, d in zip(lo, hi, doc, strict=True):
            text, first = chars[a:b].tobytes().decode("latin-1"), int(a - offsets[d])
            out[d] += [(kind, first + x, first + y) for x, y in _matches(kind, text) if _good(kind, text[x:y])]
    return out


# --- the network -----------------------------------------------------------------------------


def _states(model: dict, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of both directions over classes x (steps, batch), as (2, steps, batch, HIDDEN) in each one's order, and what the gradient needs."""
    steps, batch = x.shape
    into = np.stack([(model[f"w{d}"] + model[f"b{d}"]).astype(np.float32)[x[::step]] for d, step in ((0, 1), (1, -1))])
    u = np.stack([model["u0"], model["u1"]]).astype(np.float32)
    h = c = np.zeros((2, batch, HIDDEN), np.float32)
    hs, cs, gates, tcs = (np.empty((2, steps, batch, n), np.float32) for n in (HIDDEN, HIDDEN, 4 * HIDDEN, HIDDEN))
    for t in range(steps):
        z = into[:, t] + h @ u
        z[..., : 3 * HIDDEN] *= 0.5
        np.tanh(z, out=z)
        z[..., : 3 * HIDDEN] = 0.5 * z[..., : 3 * HIDDEN] + 0.5
        i, f, o, g = (z[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[:, t], cs[:, t], gates[:, t], tcs[:, t] = h, c, z, tc
    return hs, [cs, gates, tcs, u]


def _gradients(x: np.ndarray, hs: np.ndarray, kept: list, dhs: np.ndarray) -> dict:
    """Of weights, from those of the hidden states."""
    cs, gates, tcs, u = kept
    _, steps, batch, _ = hs.shape
    dz = np.empty_like(gates)
    dh = dc = np.zeros((2, batch, HIDDEN), np.float32)
    back = np.ascontiguousarray(u.transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (gates[:, t, :, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        tc = tcs[:, t]
        dh = dh + dhs[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        z = dz[:, t]
        z[..., :HIDDEN] = dc * g * i * (1 - i)
        z[..., HIDDEN : 2 * HIDDEN] = dc * cs[:, t - 1] * f * (1 - f) if t else 0
        z[..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
        z[..., 3 * HIDDEN :] = dc * i * (1 - g * g)
        dh, dc = z @ back, dc * f
    out = {}
    for d, step in ((0, 1), (1, -1)):
        flat = dz[d].reshape(-1, 4 * HIDDEN)
        seen = np.zeros((steps * batch, N_CLASS), np.float32)
        seen[np.arange(steps * batch), x[::step].ravel()] = 1
        out[f"w{d}"], out[f"b{d}"] = seen.T @ flat, flat.sum(0)
        out[f"u{d}"] = hs[d, :-1].reshape(-1, HIDDEN).T @ dz[d, 1:].reshape(-1, 4 * HIDDEN)
    return out


def _joint(hs: np.ndarray) -> np.ndarray:
    return np.concatenate([hs[0], hs[1, ::-1]], 2)


def emissions(model: dict, x: np.ndarray) -> np.ndarray:
    """Label scores (steps, batch, LABELS) of windows x (steps, batch)."""
    return _joint(_states(model, x)[0]) @ model["v"].astype(np.float32) + model["c"].astype(np.float32)


def _crf_gradient(e: np.ndarray, trans: np.ndarray, y: np.ndarray):
    """Gradients of the mean negative log-likelihood of labels y (steps, batch) for emissions and transitions."""
    steps, batch, _ = e.shape
    w, m = np.exp(e - e.max(2, keepdims=True)), np.exp(trans).astype(e.dtype)
    a, b, c = np.empty_like(w), np.ones_like(w), np.empty((steps, batch, 1), e.dtype)
    for t in range(steps):
        now = (a[t - 1] @ m) * w[t] if t else w[0]
        c[t] = now.sum(1, keepdims=True)
        a[t] = now / c[t]
    onward = np.empty_like(w)
    for t in range(steps - 1, 0, -1):
        onward[t] = w[t] * b[t] / c[t]
        b[t - 1] = onward[t] @ m.T
    de = a * b
    np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
    dt = (a[:-1].reshape(-1, LABELS).T @ onward[1:].reshape(-1, LABELS)) * m
    return de / batch, (dt - np.bincount((y[:-1] * LABELS + y[1:]).ravel(), minlength=LABELS * LABELS).reshape(LABELS, LABELS)) / batch


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    steps, batch, _ = e.shape
    best, back = e[0], np.empty((steps, batch, LABELS), np.int8)
    for t in range(1, steps):
        all_ = best[:, :, None] + trans
        back[t] = all_.argmax(1)
        best = all_.max(1) + e[t]
    path = np.empty((steps, batch), np.int64)
    path[-1] = best.argmax(1)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[t, rows, path[t]]
    return path


def marginals(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Each label's probability at each place, under the CRF."""
    steps = len(e)
    m = np.exp(trans)
    a, b = np.empty_like(e), np.ones_like(e)
    w = np.exp(e - e.max(2, keepdims=True))
    for t in range(steps):
        a[t] = w[t] * (a[t - 1] @ m if t else 1)
        a[t] /= a[t].sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        b[t] = (w[t + 1] * b[t + 1]) @ m.T
        b[t] /= b[t].sum(1, keepdims=True)
    p = a * b
    return p / p.sum(2, keepdims=True)


def labelled(n: int, seed: int) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Made-up windows with spans (kind, start, end): the labelled rows that the network learns from."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = ["an", "re", "ti", "on", "the", "es", "ou", "la", "der", "ción", "é", "ing", "st", "ba", "ko", "mi", "ver", "ß"]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))

    def card(valid: bool = True) -> str:
        body = str(rng.integers(1, 10)) + num(int(rng.integers(12, 17)))
        return next(body + d for d in _DIGITS if luhn(body + d) == valid)

    def email() -> str:
        name, host, end = word() + pick(["", ".", "_", "-", "+"]) + pick([word(), num(2)]), word() + pick(["", num(1)]), pick(["com", "org", "net", "example.com", "co.uk", "de"])
        name, host = (re.sub("[^a-z0-9._+-]", "x", s) for s in (name, host))
        return name + pick(["@", "@", "@", " [at] ", " (at) ", " @ "]) + host + pick([".", ".", " [dot] "]) + end

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)}-{a}-{b}{c}", f"00{num(2)} {a} {b} {c}"])

    def other() -> str:
        return pick([
            f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{num(2)}:{num(2)}:{num(2)}", f"v{num(1)}.{num(1)}.{num(1)}", f"version {num(1)}.{num(1)}", num(int(rng.integers(1, 9))), f"{num(3)},{num(3)}.{num(2)}",
            f"@{word()}", f"#{num(4)}", f"ISBN 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(4)}/{num(2)}", "".join(pick("0123456789abcdef") for _ in range(32)), f"{num(2)}%", f"CC BY {num(1)}.0", card(False),
        ])

    makers = (email, lambda: pick([".", ".", ".", "[.]", " . "]).join(str(x) for x in rng.integers(0, 256, 4)), lambda: (lambda s: s if rng.random() < 0.5 else pick("- .").join(s[i : i + 4] for i in range(0, len(s), 4)))(card()), phone)
    texts, spans = [], []
    for _ in range(n):
        text, found = " ".join(word() for _ in range(rng.integers(0, 9))), []
        for _ in range(rng.integers(1, 3)):
            text += pick([" ", " ", " ", "\n", ": ", " (", '"', ""]) if text else ""
            if rng.random() < 0.65:
                kind = int(rng.integers(4))
                body = makers[kind]()
                if len(text) + len(body) <= WINDOW:
                    found.append((kind, len(text), len(text) + len(body)))
                text += body
            else:
                text += other()
            text += pick([" ", ", ", ". ", "### ", "!! ", "\n", ""]) + " ".join(word() for _ in range(rng.integers(1, 6)))
        cut = int(rng.integers(0, 12)) if found and found[0][1] > 12 else 0
        texts.append(text[cut : cut + WINDOW])
        spans.append([(k, a - cut, b - cut) for k, a, b in found if b - cut <= WINDOW])
    return texts, spans


def windows_of(texts: list[str]) -> np.ndarray:
    x = np.zeros((WINDOW, len(texts)), np.int64)
    for j, t in enumerate(texts):
        codes = np.array([min(ord(c), 255) for c in t[:WINDOW]], np.int64)
        x[: len(codes), j] = CLASS[codes]
    return x


@lru_cache(2)
def train(rows: int = 5000, epochs: int = 9, seed: int = 3) -> dict:
    """The network, from labelled windows, by Adam on the CRF's likelihood; the same weights every time."""
    texts, spans = labelled(rows, seed)
    x, y = windows_of(texts), np.zeros((WINDOW, rows), np.int64)
    for j, found in enumerate(spans):
        for k, a, b in found:
            y[a:b, j] = 2 + 2 * k
            y[a, j] = 1 + 2 * k
    rng = np.random.default_rng(seed)
    shapes = {f"{n}{d}": s for d in (0, 1) for n, s in (("w", (N_CLASS, 4 * HIDDEN)), ("u", (HIDDEN, 4 * HIDDEN)), ("b", (4 * HIDDEN,)))} | {"v": (2 * HIDDEN, LABELS), "c": (LABELS,), "trans": (LABELS, LABELS)}
    model = {k: rng.normal(0, 0.0 if len(s) == 1 or k == "trans" else 0.25, s) for k, s in shapes.items()}
    for d in "01":
        model[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1.0
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step, size = 0, 100
    total = epochs * (rows // size)
    for _ in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, rows - size + 1, size):
            xb, yb = x[:, order[at : at + size]], y[:, order[at : at + size]]
            hs, kept = _states(model, xb)
            h = _joint(hs)
            de, dt = _crf_gradient((h @ model["v"] + model["c"]).astype(np.float32), model["trans"], yb)
            dh = de @ model["v"].T.astype(np.float32)
            grads = {"v": h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, LABELS), "c": de.sum((0, 1)), "trans": dt}
            grads |= _gradients(xb, hs, kept, np.stack([dh[:, :, :HIDDEN], dh[::-1, :, HIDDEN:]]))
            step += 1
            rate = 0.03 * (1 - 0.95 * step / total)
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    # A span goes on only within its kind.
    for a in range(LABELS):
        for k in range(len(KINDS)):
            if a not in (1 + 2 * k, 2 + 2 * k):
                model["trans"][a, 2 + 2 * k] = -1e3
    return model


def trained(spark: SparkSession, rows: int = 5000, epochs: int = 9, seed: int = 3) -> dict:
    """train()'s weights, from the shared folder if some process has put them there."""
    source = "".join(inspect.getsource(f) for f in (labelled, train, _states, _gradients, _crf_gradient, _classes)) + MARKS
    name = f"pii-{rows}-{epochs}-{seed}-{hashlib.sha256(source.encode()).hexdigest()[:16]}.npz"

    def made() -> bytes:
        out = io.BytesIO()
        np.savez(out, **train(rows, epochs, seed))
        return out.getvalue()

    with np.load(io.BytesIO(shared_file(spark, name, made))) as kept:
        return {k: kept[k] for k in kept.files}


def decoded(model: dict, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """Spans (kind, start, end, confidence) of each window."""
    e = emissions(model, x)
    path = viterbi(e, model["trans"].astype(np.float32))
    some = np.flatnonzero((path > 0).any(0))
    sure = np.zeros(path.shape)
    if len(some):
        sure[:, some] = np.take_along_axis(marginals(e[:, some], model["trans"].astype(np.float32)), path[:, some, None], 2)[:, :, 0]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(x.shape[1])]
    for t, j in zip(*np.nonzero((path % 2 == 1) & (x > 0)), strict=True):
        k, end = (path[t, j] - 1) // 2, t + 1
        while end < len(x) and path[end, j] == 2 + 2 * k and x[end, j]:
            end += 1
        out[j].append((int(k), int(t), int(end), float(sure[t:end, j].mean())))
    return out


def reconciled(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of all windows' spans of a document, those without overlap that have the highest total confidence."""
    best: dict[tuple[int, int, int], float] = {}
    for k, a, b, s in spans:
        best[k, a, b] = max(s, best.get((k, a, b), 0.0))
    items = sorted(((k, a, b, s) for (k, a, b), s in best.items()), key=lambda x: (x[2], x[1], x[0]))
    ends = [x[2] for x in items]
    value, take = [0.0], []
    for i, (_, a, _, s) in enumerate(items):
        j = bisect_right(ends, a, 0, i)
        take.append((value[j] + s > value[i] + 1e-12, j))
        value.append(max(value[i], value[j] + s))
    out, i = [], len(items)
    while i:
        yes, j = take[i - 1]
        if yes:
            out.append(items[i - 1])
        i = j if yes else i - 1
    return out[::-1]


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in " \t\n\r,;:'\"#*!":
        a += 1
    while a < b and text[b - 1] in " \t\n\r,;:.'\"#*!-(":
        b -= 1
    return a, b


def _widened(text: str, a: int, b: int) -> tuple[int, int]:
    """The whole address with a bracketed "at" that a span holds a piece of, or the span."""
    lo = max(0, a - WINDOW)
    for m in BRACKETED.finditer(text[lo : b + WINDOW]):
        if lo + m.start() < b and a < lo + m.end():
            return lo + m.start(), lo + m.end()
    return a, b


def plausible(kind: int, text: str) -> bool:
    """Whether a model span's own text is in order for its kind."""
    digits = sum(c in _DIGITS for c in text)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(@|[\[(]at[\])]) ?[A-Za-z0-9-]+( ?(\.|[\[(]dot[\])]) ?[A-Za-z0-9-]+)+", text))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}( ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}", text)) and _good(1, re.sub("[^0-9.]", "", text))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9]([ .-]?[0-9]){12,18}", text)) and _good(2, text)
    return 9 <= digits <= 15 and bool(re.fullmatch(r"(00|\+)?[0-9]*[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{2,5}", text))


def anchors(chars: np.ndarray) -> np.ndarray:
    """Places of digits, at signs, and of "at" and "dot" in brackets: every span that plausible() lets through holds one."""
    open_, close = (chars == 91) | (chars == 40), (chars == 93) | (chars == 41)
    found = _IS_DIGIT[chars] | (chars == 64)
    for word in (b"at", b"dot"):
        n = len(word) + 1
        if len(chars) > n:
            here = open_[:-n] & close[n:]
            for k, c in enumerate(word):
                here &= chars[k + 1 : len(chars) - n + k + 1] == c
            found[:-n] |= here
    return np.flatnonzero(found)


def _whole(pieces: list[tuple]) -> list[tuple]:
    """Pieces (kind, start, end, confidence, cut on the left, on the right) that overlap put together, by kind; those with both ends."""
    out = []
    for kind in range(len(KINDS)):
        group: list[tuple] = []
        b = 0
        for piece in [*sorted(p for p in pieces if p[0] == kind), None]:
            if group and (piece is None or piece[1] >= b):
                a = group[0][1]
                if any(p[1] == a and not p[4] for p in group) and any(p[2] == b and not p[5] for p in group):
                    long = sum(p[2] - p[1] for p in group)
                    out.append((kind, a, b, sum(p[3] * (p[2] - p[1]) for p in group) / long, False, False))
                group, b = [], 0
            if piece is not None:
                group.append(piece)
                b = max(b, piece[2])
    return out


def model_spans(model: dict, chars: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """(kind, start, end) that the network finds, by document (those with any)."""
    at = anchors(chars)
    if not len(at):
        return {}
    doc = np.searchsorted(offsets, at, "right") - 1
    size = np.diff(offsets)
    last = np.maximum(-(-(size - WINDOW) // STRIDE), 0)  # the last window of each document
    k = (at - offsets[doc]) // STRIDE
    # Windows k and k - 1 hold the place.
    near = np.concatenate([np.stack([doc, np.minimum(k, last[doc])], 1), np.stack([doc, np.clip(k - 1, 0, last[doc])], 1)])
    todo, done = {(int(d), int(j)) for d, j in np.unique(near, axis=0)}, set()
    found: dict[int, list] = {}
    cut: dict[int, list] = {}
    ahead = 1
    while todo:  # where an edge cuts a span, the windows beside are run too, twice as many each time
        pairs = np.array(sorted(todo))
        done |= todo
        todo = set()
        for part in range(0, len(pairs), 512):
            d, k = pairs[part : part + 512].T
            start = offsets[d] + k * STRIDE
            where = start[None, :] + np.arange(WINDOW)[:, None]
            x = np.where(where < offsets[d + 1][None, :], CLASS[chars[np.minimum(where, len(chars) - 1)]], 0)
            for j, spans in enumerate(decoded(model, x)):
                i, first = int(d[j]), int(k[j]) * STRIDE
                for kind, a, b, s in spans:
                    left, right = a == 0 and k[j] > 0, b == WINDOW and k[j] < last[i]
                    (cut if left or right else found).setdefault(i, []).append((kind, first + a, first + b, s, left, right))
                    beside = [*(range(max(0, int(k[j]) - ahead), int(k[j])) if left else ()), *(range(int(k[j]) + 1, min(int(last[i]), int(k[j]) + ahead) + 1) if right else ())]
                    todo |= {(i, w) for w in beside} - done
        ahead *= 2
    for i, pieces in cut.items():
        found.setdefault(i, []).extend(_whole(pieces))
    out: dict[int, dict[tuple[int, int, int], None]] = {}
    for i, spans in found.items():
        text = chars[offsets[i] : offsets[i + 1]].tobytes().decode("latin-1")
        for kind, a, b, s in reconciled([x[:4] for x in spans]):
            a, b = _widened(text, *_trimmed(text, a, b)) if kind == 0 else _trimmed(text, a, b)
            if s >= CONFIDENT and plausible(kind, text[a:b]):
                out.setdefault(i, {})[kind, a, b] = None
    return {i: list(spans) for i, spans in out.items()}


def _clear(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap none of base."""
    order = sorted((p, q) for _, p, q in base)
    starts, reach = [p for p, _ in order], [0, *accumulate((q for _, q in order), max)]
    return [x for x in spans if reach[bisect_left(starts, x[2])] <= x[1]]


def find(t: Texts, model: dict) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each document, pattern spans and all spans, by kind, then start."""
    lead = (t.data & 0xC0) != 0x80
    chars = t.data[lead]
    offsets = np.concatenate([[0], np.cumsum(lead)])[t.offsets]
    base = pattern_spans(chars, offsets)
    extra = model_spans(model, chars, offsets)
    return [(b, sorted(b + _clear(extra[i], b)) if i in extra else b) for i, b in enumerate(base)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: counts of pattern spans by kind, their digest, and all spans as text."""
    model = trained(docs.sparkSession)

    def run(t: Texts) -> dict:
        found = find(t, model)
        counts = {f"n_{name}": [sum(s[0] == k for s in b) for b, _ in found] for k, name in enumerate(KINDS)}
        return {key: t.batch.column(key), **counts, "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(a) for _, a in found]}

    return map_texts(docs, run, f"{key} long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string", text=text, key=key)


def masked(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text) with every span replaced by its kind in brackets; overlapping spans are replaced as one, by the first's kind."""
    model = trained(docs.sparkSession)

    def run(t: Texts) -> dict:
        out = []
        for i, (_, spans) in enumerate(find(t, model)):
            s, at, parts = t.text(i), 0, []
            for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
                if a >= at:
                    parts += [s[at:a], f"[{KINDS[k].upper()}]"]
                at = max(at, b)
            out.append("".join([*parts, s[at:]]))
        return {key: t.batch.column(key), text: out}

    return map_texts(docs, run, f"{key} long, {text} string", text=text, key=key)
