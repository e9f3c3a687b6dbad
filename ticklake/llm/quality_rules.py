"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much goes too.

A line is what newlines separate; only lines with a word are judged. A line fails if
- it is short and ends without closing punctuation of any script (headings, buttons, menus),
- it is navigation: many of its words are separators, or too many of its words carry symbols,
- it shouts: most of its ASCII letters are capitals and there are several words,
- it holds a boilerplate phrase,
- it equals an earlier line of the document.
The document is kept if what failed holds at most max_loss of its words, and unless base rules
(too few words, or too many words in repeated 3-word windows) reject it.
Nulls and empty texts have no words: all counts are 0 and they are not kept; very long texts are judged
whole. Every row is judged by itself, by its text alone: rows without an id or with one that repeats
stay, in their order, equal texts get equal results, and other columns may have any names. Of equal
lines the first stays. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, Texts, map_texts, mix, roll, span_hashes, word_spans

SYMBOLS = b"#*$%&|<>"
SEPARATORS = (b"|", b"\xc2\xbb", b"\xe2\x80\xba", b"\xc2\xb7", b">")
#: What may close a sentence, in any script; a closing quote or bracket counts.
CLOSING = ".!?\"')]:;»”’›…。！？」』】〉》）：；؟۔؛।॥።፧។៕။༎།።՞։"
#: Phrases of lines that belong to a page and not to its text, by language; lower-case, as A-Z are lowered before they are looked for.
PHRASES = {
    "en": (
        "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
        "lorem ipsum", "javascript", "sign in to", "log in to", "subscribe to", "click here", "share on", "powered by",
    ),
    "de": ("alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "hier klicken"),
    "es": ("todos los derechos reservados", "términos de uso", "política de privacidad", "haga clic aquí"),
    "fr": ("tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "cliquez ici"),
}
BOILERPLATE = tuple(p for phrases in PHRASES.values() for p in phrases)


def _counts(flags: np.ndarray, edges_from: np.ndarray, edges_to: np.ndarray) -> np.ndarray:
    """How many flags are set in each [from, to)."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[edges_to] - sums[edges_from]


def _lut(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _CLOSING = _lut(SYMBOLS), np.array(sorted(set(map(ord, CLOSING))))
_UPPER, _ALPHA = _lut(bytes(range(65, 91))), _lut(bytes([*range(65, 91), *range(97, 123)]))
_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True


# Lead bytes of scripts that are written without spaces or in long words (from U+0800 on, but for general punctuation).
_WIDE = np.zeros(256, bool)
_WIDE[0xE0:0xF5] = True
_WIDE[0xE2] = False


def last_points(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The code point that ends just before each end (0 where there is none)."""
    at = ends - 1
    point = np.where(at >= 0, data[np.maximum(at, 0)], 0).astype(np.int64)
    open_ = (point >= 0x80) & (point < 0xC0)
    point = np.where(open_, point & 0x3F, point)
    for shift in (6, 12, 18):
        at = at - 1
        byte = data[np.maximum(at, 0)].astype(np.int64)
        more = (byte >= 0x80) & (byte < 0xC0)
        bits = np.where(more, byte & 0x3F, byte & (0x7F >> (1 + shift // 6)))
        point = np.where(open_, point | bits << shift, point)
        open_ = open_ & more
    return point


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 3) -> np.ndarray:
    """Per document, the words in width-word windows that occur twice or more in it."""
    if len(words) < width:
        return np.zeros(n_docs, np.int64)
    inside = doc[: len(words) - width + 1] == doc[width - 1 :]
    h = mix(roll(words, width) ^ mix(doc[: len(words) - width + 1].astype(np.uint64)))
    values = np.sort(h[inside])
    twice = np.unique(values[1:][values[1:] == values[:-1]])
    if not len(twice):
        return np.zeros(n_docs, np.int64)
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    again = (twice[at] == h) & inside
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : len(words) - width + 1 + k] |= again
    return np.bincount(doc[covered], minlength=n_docs)


def judge(t: Texts, *, max_loss: float = 0.5, min_words: int = 50, max_repeat: int = 50, short: int = 5, phrases: tuple[str, ...] = BOILERPLATE) -> dict:
    """Measures of a chunk's documents, and its lines (start, end, document, failed)."""
    data, off, n = t.data, t.offsets, len(t)
    starts, ends, doc = word_spans(data, off)
    word = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n_words = np.bincount(doc, minlength=n)
    lead = ~_CONT[data]
    chars = _counts(lead, starts, ends)

    # Lines: from after a newline (or a document's start) to the next newline (or its end).
    breaks = np.flatnonzero(data == 10)
    from_ = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]))
    from_ = from_[from_ < len(data)]
    owner = np.searchsorted(off, from_, "right") - 1
    nxt = np.searchsorted(breaks, from_)
    to = np.where(nxt < len(breaks), breaks[np.minimum(nxt, max(len(breaks) - 1, 0))] if len(breaks) else 0, len(data))
    to = np.minimum(to, off[owner + 1])
    a, b = np.searchsorted(starts, from_), np.searchsorted(starts, to)
    some = b > a
    from_, to, owner, a, b = from_[some], to[some], owner[some], a[some], b[some]
    in_line = b - a

    if len(from_):
        line = mix(span_hashes(data, from_, to) ^ mix(owner.astype(np.uint64)))
        _, first = np.unique(line, return_index=True)
        again = np.ones(len(line), bool)
        again[first] = False
        # Two characters of a script without spaces count as a word here.
        closed = np.isin(last_points(data, ends[b - 1]), _CLOSING)
        abrupt = ~closed & (np.maximum(in_line, _counts(_WIDE[data], from_, to) // 2) < short)
        flagged = _counts(_SYMBOL[data], starts, ends) > 0
        lone = np.zeros(len(starts), bool)
        for s in SEPARATORS:
            fit = (ends - starts) == len(s)
            for i, x in enumerate(s):
                fit &= data[np.minimum(starts + i, len(data) - 1)] == x
            lone |= fit
        # Four separators, of which each tenth word is one; or a third of the words with symbols.
        n_lone = _counts(lone, a, b)
        navigation = (n_lone >= 4) & (10 * n_lone >= in_line)
        symbols = 3 * (_counts(flagged & ~lone, a, b)) >= in_line
        letters, capitals = _counts(_ALPHA[data], from_, to), _counts(_UPPER[data], from_, to)
        shouting = (in_line >= 4) & (letters >= 12) & (10 * capitals >= 6 * letters)
        boiler = np.zeros(len(from_), bool)
        low = LOWER[data].tobytes()
        for phrase in (p.encode() for p in phrases):
            at = low.find(phrase)
            while at >= 0:
                k = np.searchsorted(from_, at, "right") - 1
                if k >= 0 and at + len(phrase) <= to[k]:
                    boiler[k] = True
                at = low.find(phrase, at + 1)
        failed = again | abrupt | navigation | symbols | shouting | boiler
    else:
        again = failed = np.zeros(0, bool)
    repeat = repeated_words(word, doc, n)
    lost = np.bincount(owner[failed], weights=in_line[failed], minlength=n).astype(np.int64)
    base_failed = (n_words < min_words) | (100 * repeat > max_repeat * n_words)
    return {
        "n_words": n_words,
        "word_chars": np.bincount(doc, weights=chars, minlength=n).astype(np.int64),
        "n_symbols": _counts(_SYMBOL[data], off[:-1], off[1:]),
        "n_dup_lines": np.bincount(owner[again], minlength=n),
        "n_repeat_words": repeat,
        "n_lost_words": lost,
        "base_failed": base_failed,
        "kept": ~base_failed & (lost <= max_loss * n_words),
        "lines": (from_, to, owner, failed),
    }


def _cleaned(t: Texts, lines: tuple) -> list[str]:
    from_, to, owner, failed = lines
    out: list[list[bytes]] = [[] for _ in range(len(t))]
    for k in np.flatnonzero(~failed):
        out[owner[k]].append(t.data[from_[k] : to[k]].tobytes())
    return [b"\n".join(x).decode("utf-8", "replace") for x in out]


def clean(docs: DataFrame, *, max_loss: float = 0.5, phrases: tuple[str, ...] = BOILERPLATE, text: str = "text", key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """Per document: its key, the measures, kept, and (with_text) the lines that passed as cleaned."""

    def run(t: Texts) -> dict:
        found = judge(t, max_loss=max_loss, phrases=phrases)
        lines = found.pop("lines")
        return {key: t.batch.column(key), **found} | ({"cleaned": pa.array(_cleaned(t, lines), pa.string())} if with_text else {})

    return map_texts(docs, run, f"{key} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_words long, base_failed boolean, kept boolean{', cleaned string' if with_text else ''}", text=text, key=key)
