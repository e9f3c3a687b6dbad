"""Secrets by patterns and by sliding-window entropy, in DataFrame functions alone.

Pattern kinds are found first. Then candidate strings (long runs of key characters with digits and
letters) are cut into windows of WINDOW characters; each window's Shannon entropy follows from the
one before: with S = sum of c * log2(c) over character counts c, entropy = log2(WINDOW) - S / WINDOW.
The counts are carried from window to window, a byte a character: a step lowers the count of the
character that leaves, raises that of the one that enters, and changes S by what these two counts
say. S is summed in whole numbers (2^-40 bits), so it doesn't drift however long a candidate is. A
candidate is a secret if its highest window reaches the threshold of its character class, it is on no
allow-list, and it overlaps no pattern's span.

Time is linear in the length of texts, of candidates, and in the number of matches: lists grow by
blocks, spans meet candidates in one ordered walk, and patterns repeat no group that can be left again
(Java's matcher recurses there).

Null and empty texts have no spans; very long texts are read whole. Offsets count code points; ends
are exclusive. Every row is reported by itself, so rows that repeat an id or have none, and repeated
texts, need no care; other columns are kept (masked) or ignored (report), whatever their names. Ties
can't be: spans of a kind never overlap, and kinds have an order. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: kinds in order, with pattern and what a match must have.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a whole run; shorter ones would be dropped
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits a character over a window, by class: all hexadecimal, or letters of both cases with digits, or one case with digits.
THRESHOLDS = {"hex": 3.0, "mixed": 3.7, "single": 3.5}
#: What looks random and isn't secret: UUIDs, digits with separators, words joined by separators, runs of the alphabet, placeholders.
_PART = r"(?:[A-Za-z]{2,}+[0-9]{0,4}+|[0-9]{1,4}+)"
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_/+=-]+$",
    rf"^{_PART}(?:[-_/+=]++{_PART})++$",
    r"(?i)abcdefgh|01234567|12345678|xxxxx|example|placeholder|change_?me|your_",
    r"(?i)^sha(1|256|512)-",
)
#: Bytes of a block of a growing list, and of a number in it.
BLOCK, DIGITS = 4096, 10
#: S counts 2^-40 bits.
UNIT = 1 << 40
_SPAN = "struct<start:int,kind:int,end:int,body:string>"
#: Stands for a candidate among the kinds, after all of them.
_CANDIDATE = 9


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often and in whatever loops fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _nothing() -> list[Column]:
    """A growing list of fixed-width records, as bytes: Spark copies arrays and strings at every step of a fold, but no bytes."""
    return [F.lit(b"").alias("done"), F.lit(b"").alias("last")]


def _pushed(acc: Column, record: Column, when: Column | None = None) -> list[Column]:
    """The list with one more record (a string); full blocks are moved to the bulk together."""
    record, full = record.cast("binary"), F.octet_length(acc["last"]) >= BLOCK
    done, last = F.when(full, F.concat(acc["done"], acc["last"])).otherwise(acc["done"]), F.when(full, record).otherwise(F.concat(acc["last"], record))
    if when is not None:
        done, last = F.when(when, done).otherwise(acc["done"]), F.when(when, last).otherwise(acc["last"])
    return [done.alias("done"), last.alias("last")]


def _listed(acc: Column) -> Column:
    return F.concat(acc["done"], acc["last"])


def _number(x: Column) -> Column:
    return F.lpad(x.cast("string"), DIGITS, "0")


def _at(records: Column, i: Column) -> Column:
    """The i-th number of a list of numbers, from 0."""
    return F.substring(records, i * DIGITS + 1, F.lit(DIGITS)).cast("string").cast("int")


def pattern_spans(text: Column, pattern: str, group: int = 0, kind: int = _CANDIDATE, measure: Callable[[Column], Column] = F.char_length) -> Column:
    """array of all matches (start, kind, end, body), in order: places as measure counts, body is the group's text."""

    def built(whole: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), measure)
        parts = F.arrays_zip(gaps.alias("g"), F.transform(whole, measure).alias("m"))

        def step(acc, x):
            return F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), *_pushed(acc, _number(acc["at"] + x["g"])))

        starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), *_nothing()), step, _listed)
        bodies = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

        def spans(at: Column, body: Column) -> Column:
            return F.transform(whole, lambda m, i: F.struct(_at(at, i).alias("start"), F.lit(kind).alias("kind"), (_at(at, i) + measure(m)).alias("end"), F.get(body, i).alias("body")))

        return let(starts, lambda at: let(bodies, lambda body: spans(at, body)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda whole: F.when(F.size(whole) > 0, built(whole)).otherwise(F.array().cast(f"array<{_SPAN}>")))


def _code(raw: Column, at: Column) -> Column:
    """The byte at a place (from 1) of a binary value."""
    return F.ascii(F.substring(raw, at, F.lit(1)).cast("string"))


def top_entropy(s: Column, window: int = WINDOW) -> Column:
    """The highest entropy (bits a character) of s's windows; s is ASCII and at least a window long."""
    clog = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 1)]
    more = F.array(*[F.lit(b - a) for a, b in zip(clog[:-1], clog[1:], strict=True)])  # what one more of a character adds
    none = F.lit(bytes([1]) * 128)  # each byte is a character's count and one

    def entered(acc: Column, code: Column) -> Column:
        return let(code, lambda ch: let(_code(acc["counts"], ch + 1) - 1, lambda c: F.struct(
            F.overlay(acc["counts"], F.char(c + 2).cast("binary"), ch + 1, F.lit(1)).alias("counts"), (acc["sum"] + F.get(more, c)).alias("sum"))))

    def left(acc: Column, code: Column) -> Column:
        return let(code, lambda ch: let(_code(acc["counts"], ch + 1) - 1, lambda c: F.struct(
            F.overlay(acc["counts"], F.char(c).cast("binary"), ch + 1, F.lit(1)).alias("counts"), (acc["sum"] - F.get(more, c - 1)).alias("sum"))))

    def walked(raw: Column) -> Column:
        def step(acc, i):
            # To the window at i (from 1): the character before it leaves, its last one enters.
            out = left(acc, _code(raw, i - 1))
            now = let(out, lambda o: entered(o, _code(raw, i + window - 1)))
            return let(now, lambda n: F.struct(n["counts"].alias("counts"), n["sum"].alias("sum"), F.least(acc["least"], n["sum"]).alias("least")))

        begin = F.aggregate(F.sequence(F.lit(1), F.lit(window)), F.struct(none.alias("counts"), F.lit(0).cast("long").alias("sum")), lambda acc, i: entered(acc, _code(raw, i)))
        start = let(begin, lambda b: F.struct(b["counts"].alias("counts"), b["sum"].alias("sum"), b["sum"].alias("least")))
        steps = F.when(F.octet_length(raw) > window, F.sequence(F.lit(2), F.octet_length(raw) - window + 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda acc: acc["least"])

    return F.lit(math.log2(window)) - let(s.cast("binary"), walked) / (window * UNIT)


def suspicious(s: Column) -> Column:
    """Whether a candidate string has letters and digits, is on no allow-list and has a window above its class's threshold."""
    lower, upper = s.rlike("[a-z]"), s.rlike("[A-Z]")
    least = F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), THRESHOLDS["hex"]).when(lower & upper, THRESHOLDS["mixed"]).otherwise(THRESHOLDS["single"])
    safe = F.lit(False)
    for pattern in ALLOWED:
        safe = safe | s.rlike(pattern)
    return F.when(s.rlike("[0-9]") & (lower | upper) & ~safe, top_entropy(s) >= least).otherwise(False)


def free(base: Column, candidates: Column) -> Column:
    """The candidates that overlap no base span, by one walk over both in order of their starts."""

    def step(acc, x):
        mine = x["kind"] == _CANDIDATE
        ok = F.when(mine, x["start"] >= acc["reach"]).otherwise(acc["ok"] & (x["start"] >= acc["end"]))
        return F.struct(
            F.when(mine, acc["reach"]).otherwise(F.greatest(acc["reach"], x["end"])).alias("reach"), F.when(mine, x["end"]).otherwise(acc["end"]).alias("end"),
            ok.alias("ok"), *_pushed(acc, acc["ok"].cast("int").cast("string"), mine),
        )

    # The first record is of what stands before the first candidate.
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("end"), F.lit(True).alias("ok"), *_nothing())
    end = lambda acc: F.concat(_listed(acc), acc["ok"].cast("int").cast("string").cast("binary"))
    places = F.transform(F.concat(base, candidates), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    flags = F.aggregate(F.sort_array(places), start, step, end)
    kept = let(flags, lambda f: F.filter(candidates, lambda c, i: F.substring(f, i + 2, F.lit(1)) == F.lit(b"1")))
    return F.when(F.size(candidates) > 0, kept).otherwise(candidates)


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def found(text: Column, measure: Callable[[Column], Column] = F.char_length) -> Column:
    """struct of base and spans: arrays of (start, kind, end, body), by start and kind."""
    kinds = (
        F.filter(pattern_spans(text, ASSIGN, 2, 0, measure), lambda x: F.char_length(x["body"]) >= 12),
        F.filter(pattern_spans(text, ACCESS, 0, 1, measure), lambda x: F.char_length(x["body"]) >= 18),
        pattern_spans(text, HEX, 0, 2, measure),
    )

    def with_candidates(base: Column) -> Column:
        new = F.transform(F.filter(let(pattern_spans(text, CANDIDATE, 0, _CANDIDATE, measure), lambda c: free(base, c)), lambda c: suspicious(c["body"])), lambda c: c.withField("kind", F.lit(3)))
        return F.struct(base.alias("base"), F.sort_array(F.concat(base, new)).alias("spans"))

    return let(F.sort_array(F.concat(*kinds)), with_candidates)


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def report(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: counts by pattern kind, the digest of its pattern spans, and all spans as text."""

    def said(f: Column) -> Column:
        count = lambda k: F.size(F.filter(f["base"], lambda x: x["kind"] == k)).cast("long")
        counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
        return F.struct(*counts, F.sha2(_joined(f["base"]), 256).alias("base_sha256"), _joined(f["spans"]).alias("spans"))

    return docs.select(F.col(key).alias("key"), let(found(_text(text)), said).alias("said")).select(F.col("key").alias(key), "said.*")


def masked(docs: DataFrame, *, mask: str = "[SECRET]", text: str = "text") -> DataFrame:
    """The documents with every found span replaced by mask; overlapping spans are replaced as one. A null text becomes empty."""

    def cut(raw: Column, spans: Column) -> Column:
        def step(acc, x):
            new = x["start"] >= acc["at"]
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), *_pushed(acc, F.concat(_number(acc["at"]), _number(x["start"])), new))

        # The gaps before masked stretches, from and to, and at last where the rest begins.
        gaps = F.aggregate(spans, F.struct(F.lit(0).alias("at"), *_nothing()), step, lambda acc: F.concat(_listed(acc), _number(acc["at"]).cast("binary")))

        def joined(g: Column) -> Column:
            n = F.octet_length(g).cast("int")
            each = F.when(n > 2 * DIGITS, F.sequence(F.lit(0), (n / (2 * DIGITS)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
            parts = F.transform(each, lambda i: F.concat(F.substring(raw, _at(g, 2 * i) + 1, _at(g, 2 * i + 1) - _at(g, 2 * i)).cast("string"), F.lit(mask)))
            return F.concat(F.array_join(parts, ""), F.substring(raw, _at(g, (n / DIGITS).cast("int") - 1) + 1, F.octet_length(raw)).cast("string"))

        return let(gaps, joined)

    t = _text(text)
    spans = found(t, F.octet_length)["spans"]
    return docs.withColumn(text, let(t.cast("binary"), lambda raw: let(spans, lambda s: cut(raw, s))))
