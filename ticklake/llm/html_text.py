"""The main text of web pages: a linear-chain conditional random field over their leaf blocks.

A leaf block is a run of text between two tags that break lines (paragraphs, items, cells, headings).
Its features are the tags, roles and words of class and id around it, and measures of its text
(length, share of links, closing marks, digits, words that menus and notices use); its neighbours'
measures count too. The field has two labels, text and boilerplate. How likely a label follows
another depends on whether the two blocks have the same parent, sibling parents, or neither. Weights
are trained in numpy, by exact gradients over PAGES made-up labelled pages of many layouts, once per
shared folder; pages are labelled by Viterbi, each over all its blocks.

Pages are read as browsers read them, in linear time: unclosed and wrongly nested tags, comments, raw
text in scripts and styles, attributes without quotes; what is unclosed at the end goes to the end.
Character references are decoded. White space in a block becomes one space, a line break (br) too.

A null page is empty; a page without blocks, or without any labelled text, has an empty text. Very long
pages are read whole, by one task each. Pages are judged one by one, so ties, repeated ids and missing
ids change nothing: every row is returned. Other columns may have any names, and an empty table
gives an empty one.
"""

from __future__ import annotations

import html as _html
import io
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, shared_file, small_batches

#: Labelled pages that the field learns from, hashed features, and steps of training.
PAGES, DIMS, STEPS = 1500, 1 << 14, 200
#: Ancestors whose class, id and role count as features; landmark tags count at any distance.
NEAR = 12

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " audio video canvas embed object param source track map area input svg path g link meta base".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag; of these only a text area can hold words to show.
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main"
    " menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul textarea".split()
)
#: A start tag of the first closes an open element of the second, unless one of the third is between them.
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {
    "li": (frozenset(("li",)), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "tbody": (frozenset("tbody thead tfoot tr caption".split()), frozenset(("table",))),
    "tfoot": (frozenset("tbody thead tfoot tr caption".split()), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset()),
}
LANDMARKS = "article main nav aside header footer form section table figure blockquote noscript select button ul ol dl pre fieldset dialog textarea head".split()
_LANDMARK = {t: 1 << i for i, t in enumerate(LANDMARKS)}
_ARTICLE, _HEAD, _DROP = _LANDMARK["article"] | _LANDMARK["main"], _LANDMARK["head"], 1 << 40

_TAG = re.compile(r"<(?:(!--)|([!?]|/(?![a-zA-Z]))|(/?)([a-zA-Z][^\s/>]*))")
_END_COMMENT = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s=>/]?[^\s=>/]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LONG_NUMBER = re.compile(r"&#0*[1-9][0-9]{8,};?")

#: Words of notices, menus and forms; a block that has one has a feature by its name.
LEXICON = frozenset(
    "cookie cookies discussion recommended popular latest tags privacy terms copyright reserved rights subscribe newsletter share comment comments reply replies login sign register account menu search home contact about sponsored advertisement"
    " advert related more read next previous posted archive follow password email submit cart accept policy click cookies-richtlinie datenschutz impressum kommentare kommentar antworten anmelden"
    " suche teilen anzeige werbung kontakt startseite rechte vorbehalten commentaires répondre partager publicité rechercher accueil confidentialité droits réservés inscrivez comentarios responder"
    " compartir publicidad buscar inicio privacidad derechos reservados suscríbase".split()
)
_COMMENTS = frozenset("comment comments reply replies kommentare kommentar commentaires comentarios discussion".split())
_RELATED = frozenset("related more read next recommended popular latest tags archive follow subscribe newsletter share".split())


@lru_cache(1 << 16)
def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMS


def unescape(text: str) -> str:
    if "&" not in text:
        return text
    return _html.unescape(_LONG_NUMBER.sub("�", text) if "&#" in text else text)


class Block:
    """A leaf block: its text, how much of it is linked, the element it stands in and that one's parent."""

    __slots__ = ("text", "linked", "tag", "near", "marks", "parent", "above", "label")

    def __init__(self, text, linked, tag, near, marks, parent, above, label):
        self.text, self.linked, self.tag, self.near, self.marks, self.parent, self.above, self.label = text, linked, tag, near, marks, parent, above, label


class _Open:
    """An open element: tag, number, names of its class, id and role, landmarks around, label (in training), near: names around, once asked for."""

    __slots__ = ("tag", "number", "names", "marks", "label", "near")

    def __init__(self, tag, number, names, marks, label):
        self.tag, self.number, self.names, self.marks, self.label, self.near = tag, number, names, marks, label, None


@lru_cache(1 << 14)
def _names(kind: str, value: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(f"{kind}:{w}" for w in _WORDS.findall(_CAMEL.sub(" ", value[:400]).lower())))


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """Attributes from at on, and the place after the tag's end; -1 if the page ends before."""
    found: dict[str, str] = {}
    n = len(page)
    while True:
        m = _ATTRIBUTE.match(page, at)
        name, at = m[1], m.end()
        if at >= n:
            return found, -1
        value = ""
        if m[2] is not None:
            quote = page[at]
            if quote in "\"'" and at < last.setdefault(quote, page.rfind(quote)):
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                v = _UNQUOTED.match(page, at)
                value, at = v[0], v.end()
        if name:
            found.setdefault(name.lower(), value)
        if at >= n:
            return found, -1
        if page[at] == ">":
            return found, at + 1
        if not name and m[2] is None and m.end() == m.start():
            at += 1


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order. An attribute data-label, used in training, names the label of what it holds."""
    out: list[Block] = []
    stack = [_Open("", 0, (), 0, 0)]
    opened: dict[str, int] = {}
    pieces: list[str] = []
    linked, link_at, number, at, n = 0, 0, 0, 0, len(page)
    last_quote: dict[str, int] = {}
    raw_end: dict[str, re.Pattern] = {}

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1].marks & (_HEAD | _DROP):
            piece = unescape(piece)
            pieces.append(piece)
            if link_at:
                linked += len(piece)

    def flush() -> None:
        nonlocal linked
        if pieces:
            whole = " ".join("".join(pieces).split())
            if whole:
                top = stack[-1]
                if top.near is None:
                    top.near = tuple(dict.fromkeys(name for e in stack[: -NEAR - 1 : -1] for name in e.names))
                out.append(Block(whole, linked, top.tag, top.near, top.marks, top.number, stack[-2].number if len(stack) > 1 else 0, top.label))
            pieces.clear()
        linked = 0

    def close_to(size: int) -> None:
        nonlocal link_at
        while len(stack) > size:
            opened[stack.pop().tag] -= 1
        if link_at > len(stack):
            link_at = 0

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            if page.startswith((">", "->"), at):
                at = page.index(">", at) + 1
                continue
            e = _END_COMMENT.search(page, at)
            at = e.end() if e else n
            continue
        if m[2]:
            e = page.find(">", at)
            at = e + 1 if e >= 0 else n
            continue
        tag = m[4].lower()
        e = page.find(">", at)
        if e < 0:
            break
        if e == at:
            attributes, at = {}, e + 1
        else:
            attributes, at = _attributes(page, at, last_quote)
            if at < 0:
                break
        if m[3]:  # an end tag
            if tag == "a":
                link_at = 0
            elif tag == "br":
                pieces.append(" ")
            elif tag in BLOCKS:
                flush()
                if opened.get(tag):
                    k = len(stack) - 1
                    while stack[k].tag != tag:
                        k -= 1
                    close_to(k)
            continue
        if tag in INLINE or tag not in BLOCKS:
            if tag == "a":
                link_at = len(stack)
            elif tag == "br":
                pieces.append(" ")
            if tag in RAW:
                at = _past(page, at, tag, raw_end)
            continue
        flush()
        if tag in _P_ENDS and opened.get("p"):
            k = len(stack) - 1
            while stack[k].tag not in ("p", "td", "th", "button", "caption"):
                k -= 1
            if stack[k].tag == "p":
                close_to(k)
        if tag in _HEADINGS and stack[-1].tag in _HEADINGS:
            close_to(len(stack) - 1)
        elif tag in _CLOSES:
            ends, stops = _CLOSES[tag]
            if any(opened.get(x) for x in ends):
                k, found = len(stack) - 1, 0
                while k > 0 and stack[k].tag not in stops:
                    if stack[k].tag in ends:
                        found = k
                    k -= 1
                if found:
                    close_to(found)
        if tag in VOID:
            continue
        number += 1
        names: tuple[str, ...] = ()
        top = stack[-1]
        marks, label = top.marks | _LANDMARK.get(tag, 0), top.label
        if tag == "body":
            marks &= ~_HEAD
        if attributes:
            for kind in ("class", "id", "role", "itemprop"):
                if attributes.get(kind):
                    names += _names("c" if kind in ("class", "id") else kind[0], attributes[kind])
            if "hidden" in attributes or "none" in attributes.get("style", "") or attributes.get("aria-hidden") == "true":
                names += ("hidden",)
            if "data-label" in attributes:
                label = int(attributes["data-label"] == "1")
        if tag == "template":
            marks |= _DROP
        stack.append(_Open(tag, number, names, marks, label))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in RAW:
            to = _past(page, at, tag, raw_end)
            text(page[at:to].rpartition("</")[0])
            at = to
            flush()
            close_to(len(stack) - 1)
    flush()
    return out


def _past(page: str, at: int, tag: str, ends: dict[str, re.Pattern]) -> int:
    """The place after the end tag of a raw element that starts at at, or the page's end."""
    if tag not in ends:
        ends[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)
    m = ends[tag].search(page, at)
    return m.end() if m else len(page)


#: Bounds of bins: characters, and parts in ten.
_SIZES = [3, 8, 16, 30, 50, 80, 130, 220, 400, 900]
#: Characters of a block whose words are looked up in the lexicon.
SHORT = 160
_CLOSING = frozenset(".!?…。！？؟।:;\"'”’»)")


@lru_cache(1 << 14)
def _around(tag: str, near: tuple[str, ...], marks: int, has_article: bool) -> tuple[int, ...]:
    """Features of where a block stands."""
    names = [f"tag:{tag}", *near]
    names += [f"in:{t}" for t, bit in _LANDMARK.items() if marks & bit]
    where = "none" if not has_article else "inside" if marks & _ARTICLE else "outside"
    names += [f"article:{where}", f"article:{where}:{tag}"]
    return tuple(feature(x) for x in names)


@lru_cache(1 << 16)
def _measured(size: int, links: int, closed: bool, stops: int, digits: bool, marks: str) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
    """Features of a block's measures, for itself, for the block after it and for the block before it."""
    own = [f"links:{links}", f"size:{size}", f"size:{size}:{links}", f"closed:{closed}:{min(size, 6)}", f"stops:{stops}", *(f"has:{c}" for c in marks)]
    if digits:
        own.append("digits")
    return tuple(feature(x) for x in own), tuple(feature(f"before:{x}") for x in own[:2]), tuple(feature(f"after:{x}") for x in own[:2])


@lru_cache(1 << 12)
def _said(words: frozenset[str]) -> tuple[int, ...]:
    return tuple(feature(f"w:{w}") for w in sorted(words))


@lru_cache(64)
def _under(under: str, tag: str, headed: bool) -> tuple[int, ...]:
    return feature(f"under:{under}"), feature(f"under:{under}:{tag}"), feature(f"headed:{headed}")


_FIRST, _LAST = (feature("first"),), (feature("last"),)
_DIGITS, _MARKS, _STOPS, _LETTERS = re.compile("[0-9]"), re.compile("[©|»›•·@]"), re.compile("[.!?,] "), re.compile(r"[^\W\d_]+")


def _measures(b: Block) -> tuple:
    """What a block's own text says of it."""
    t = b.text
    n = len(t)
    links = 0 if not b.linked else 1 if 3 * b.linked < n else 2 if 10 * b.linked < 8 * n else 3
    marks = "".join(sorted(set(_MARKS.findall(t))))
    return _measured(bisect_right(_SIZES, n), links, t[-1] in _CLOSING, min(len(_STOPS.findall(t)), 4), 5 * len(_DIGITS.findall(t)) > n, marks)


def encode(found: list[Block]) -> tuple[list[list[tuple[int, ...]]], list[int]]:
    """Features of a page's blocks, in groups, and the kind of step from the block before each."""
    has_article = any(b.marks & _ARTICLE for b in found)
    own = [_measures(b) for b in found]
    groups: list[list[tuple[int, ...]]] = []
    steps: list[int] = []
    under, headed = "none", False
    for i, b in enumerate(found):
        words = LEXICON.intersection(_LETTERS.findall(b.text.lower())) if len(b.text) <= SHORT else ()
        if b.tag in _HEADINGS:
            under = "comments" if _COMMENTS.intersection(words) else "related" if _RELATED.intersection(words) and len(b.text) < 40 else "text"
            headed = headed or b.tag == "h1"
        groups.append([
            _around(b.tag, b.near, b.marks, has_article), own[i][0], own[i - 1][1] if i else _FIRST, own[i + 1][2] if i + 1 < len(found) else _LAST,
            _under(under, b.tag, headed), _said(frozenset(words)) if words else (),
        ])
        p = found[i - 1] if i else None
        steps.append(3 if p is None else 0 if p.parent == b.parent else 1 if p.above == b.above else 2)
    return groups, steps


class Field:
    """weights: of the label text by feature; moves: step kind x label before x label (kind 3, the first block, uses its first row)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self._sums: dict[tuple[int, ...], float] = {}

    def _sum(self, group: tuple[int, ...]) -> float:
        found = self._sums.get(group)
        if found is None:
            if len(self._sums) > 1 << 16:
                self._sums.clear()
            found = self._sums[group] = float(sum(self.weights[list(group)].tolist()))
        return found

    def scores(self, groups: list[list[tuple[int, ...]]]) -> list[float]:
        """The weight of the label text over boilerplate, of each block by itself."""
        return [sum(map(self._sum, g)) for g in groups]

    def viterbi(self, scores: list[float], steps: list[int]) -> list[int]:
        """The likeliest labels; boilerplate on ties."""
        if not scores:
            return []
        moves = self.moves.tolist()
        a, b = moves[3][0][0], moves[3][0][1] + scores[0]
        back: list[tuple[int, int]] = []
        for s, k in zip(scores[1:], steps[1:], strict=True):
            (p, q), (r, t) = moves[k]
            back.append((int(b + r > a + p), int(b + t > a + q)))
            a, b = max(a + p, b + r), max(a + q, b + t) + s
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez_compressed(f, weights=self.weights, moves=self.moves)
        return f.getvalue()

    @staticmethod
    def load(data: bytes) -> Field:
        with np.load(io.BytesIO(data)) as f:
            return Field(f["weights"], f["moves"])


def likelihood(field: Field, scores: np.ndarray, steps: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of pages (padded columns: places x pages), and its gradients by each block's score and by the moves."""
    longest, pages = scores.shape
    there = np.arange(longest)[:, None] < lengths
    emit = np.stack([np.zeros_like(scores), scores], axis=2)
    move = field.moves[steps]
    move[0, :, 1, :] = -1e30  # the first block comes from one state
    ahead, behind = np.zeros((longest, pages, 2)), np.zeros((longest, pages, 2))
    ahead[0] = move[0, :, 0] + emit[0]
    for k in range(1, longest):
        step = np.logaddexp(ahead[k - 1, :, :1] + move[k, :, 0], ahead[k - 1, :, 1:] + move[k, :, 1]) + emit[k]
        ahead[k] = np.where(there[k, :, None], step, ahead[k - 1])
    for k in range(longest - 2, -1, -1):
        on = emit[k + 1] + behind[k + 1]
        step = np.logaddexp(move[k + 1, :, :, 0] + on[:, :1], move[k + 1, :, :, 1] + on[:, 1:])
        behind[k] = np.where(there[k + 1, :, None], step, 0.0)
    total = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
    chance = np.exp(ahead + behind - total[:, None])
    by_score = (labels - chance[:, :, 1]) * there
    pair = np.zeros((longest, pages, 2, 2))
    pair[0, :, 0] = chance[0]
    pair[1:] = np.exp(ahead[:-1, :, :, None] + move[1:] + (emit + behind)[1:, :, None, :] - total[:, None, None])
    place, page = np.indices((longest, pages))
    before = np.concatenate([np.zeros((1, pages), np.int64), labels[:-1]])
    pair[place, page, before, labels] -= 1
    pair *= there[:, :, None, None]
    by_move = np.stack([-pair[steps == k].sum(axis=0) for k in range(4)])
    path = np.where(there, np.take_along_axis(emit, labels[:, :, None], 2)[:, :, 0] + move[place, page, before, labels], 0.0).sum()
    return float(path - total.sum()), by_score, by_move


def train(pages: list[str], steps: int = STEPS, decay: float = 0.03) -> Field:
    """Weights that maximise the likelihood of the pages' labels less decay / 2 times the weights' squares, by adaptive gradient steps."""
    coded = sorted(((*encode(b), [x.label for x in b]) for b in map(blocks, pages) if b), key=lambda x: len(x[1]))
    parts = []  # pages of similar lengths, padded to the longest of them
    for some in np.array_split(np.arange(len(coded)), 6):
        mine = [coded[i] for i in some]
        if not mine:
            continue
        lengths = np.array([len(x[1]) for x in mine])
        kinds, labels = np.zeros((lengths.max(), len(mine)), np.int64), np.zeros((lengths.max(), len(mine)), np.int64)
        for i, (_, s, y) in enumerate(mine):
            kinds[: len(y), i], labels[: len(y), i] = s, y
        each = [[f for group in block for f in group] for groups, _, _ in mine for block in groups]
        flat, sizes = np.array([f for ids in each for f in ids]), np.array([len(ids) for ids in each])
        # Blocks come page by page, the padded arrays place by place.
        parts.append((flat, sizes, np.cumsum(sizes) - sizes, kinds, labels, lengths, np.arange(lengths.max()) < lengths[:, None]))
    field = Field(np.zeros(DIMS), np.zeros((4, 2, 2)))
    state = [(np.zeros(DIMS), np.zeros(DIMS)), (np.zeros((4, 2, 2)), np.zeros((4, 2, 2)))]
    for t in range(1, steps + 1):
        by_weight, by_moves = -decay * field.weights, -decay * field.moves
        for flat, sizes, starts, kinds, labels, lengths, there in parts:
            scores = np.zeros(there.shape)
            scores[there] = np.add.reduceat(field.weights[flat], starts)
            _, by_score, by_move = likelihood(field, scores.T, kinds, labels, lengths)
            by_weight += np.bincount(flat, weights=np.repeat(by_score.T[there], sizes), minlength=DIMS)
            by_moves += by_move
        for values, gradient, (m, v) in ((field.weights, by_weight, state[0]), (field.moves, by_moves, state[1])):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            values += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return field


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    groups, steps = encode(found)
    return "\n".join(b.text for b, y in zip(found, field.viterbi(field.scores(groups), steps), strict=True) if y)


def trained(spark: SparkSession) -> bytes:
    """The field of the made-up pages, trained where the shared folder hasn't it yet (about 20 s)."""
    return shared_file(spark, "html-field-1.npz", lambda: train(labelled(PAGES)).dump())


def extract(pages: DataFrame, *, page: str = "html", key: str = "page_id", url: str = "url", field: Field | None = None) -> DataFrame:
    """Per page: key, url, text and n_chars (its code points). Without a field, that of the made-up pages."""
    spark = pages.sparkSession
    small_batches(spark)
    weights = field.dump() if field is not None else trained(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Field.load(weights)
        for batch in batches:
            texts = [main_text(h.as_py(), known) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])
        release()

    return pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(page).cast("string")).mapInArrow(run, f"`{key}` long, `{url}` string, text string, n_chars long")


# --- labelled pages -----------------------------------------------------------------------------------

_SYLLABLES = (
    "the of and ing er on re en at ti es or ed ha he st nt th ly wh", "der die und en er ich sch ein ung ver be ge zu ü ä ß", "le la de et que ou on é è ç ai eau oi tion ment", "el los de que y ó ción ar as os ñ al",
    "на по не то ка ра ли ов ение ст", "το και να της ος ια ων", "の に は を た が で て と し", "的 一 是 了 我 不 人 在 他 有",
)
_CONTENT = "content post entry article story text body main page news blog single detail prose copy".split()
_SIDE = "sidebar side widget related promo rail secondary aside recommended popular trending links".split()
_ADS = "ad ads advert advertisement banner sponsor sponsored promo dfp".split()
_NAV = "nav menu navigation navbar topbar breadcrumb breadcrumbs tabs pagination pager toc".split()
_NOTICE = "cookie consent notice alert gdpr popup modal overlay warning message".split()
_COMMENT = "comments comment commentlist discussion replies reply respond disqus thread feedback".split()
_HEADER = "header masthead top site branding logo brand".split()
_FOOTER = "footer bottom copyright legal colophon foot".split()
_SOCIAL = "share social sharing follow buttons tools meta byline tags".split()
_FORM = "newsletter subscribe signup search form login contact".split()


class _Maker:
    """Made-up pages: layouts put together at random, blocks marked with the label that they have."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def one(self, *options):
        return self.r.choice(options)

    def upto(self, low: int, high: int) -> int:
        """Of low to high - 1."""
        return self.r.randrange(low, high)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.upto(1, 5)))

    def words(self, low: int, high: int) -> list[str]:
        return [self.word() for _ in range(self.upto(low, high + 1))]

    def phrase(self, low: int = 1, high: int = 4) -> str:
        return " ".join(self.words(low, high)).capitalize()

    def sentence(self) -> str:
        w = self.words(1, 18) if not self.junk else [x + self.one("%%%", "***", "###", "$$$", "&amp;&amp;&amp;", "|", "") for x in self.words(1, 18)]
        for i in range(len(w) - 1):
            if self.chance(0.08):
                w[i] += ","
        if self.chance(0.2):
            k = self.upto(0, len(w))
            w[k] = self.one("<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>", "<span class=x>{}</span>", "<code>{}</code>", "{}&nbsp;").format(w[k])
        return " ".join(w).capitalize() + self.one(".", ".", ".", ".", "!", "?", "…", "")

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.upto(low, high + 1)))

    def named(self, tag: str, names: list[str], inside: str, label: int | None = None, plain: float = 0.15) -> str:
        """inside in tag, with one or two of the names as class or id; sometimes with names that say nothing."""
        some = [self.one(*names) for _ in range(1 + self.chance(0.3))]
        if self.chance(plain):
            some = [self.one("box", "row", "col", "wrap", "inner", "c1", "x9z", "container", "block", "section", "group")]
        value = self.one("-", "_", " ").join(some)
        mark = "" if label is None else f' data-label="{label}"'
        return f'<{tag} {self.one("class", "class", "class", "id")}="{value}"{mark}>{inside}</{tag}>'

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.phrase()}</a>' for _ in range(self.upto(2, 9))]
        how = self.one("ul", "ul", "div", "p", "ol", "bare")
        if how in ("ul", "ol"):
            return f"<{how}>" + "".join(f"<li>{x}</li>" if self.chance(0.9) else f"<li>{x}" for x in items) + f"</{how}>"
        return (f"<{how}>" if how != "bare" else "") + self.one(" | ", " ", " · ", " » ").join(items) + (f"</{how}>" if how != "bare" else "")

    def nav(self) -> str:
        return f"<nav data-label=0>{self.links()}</nav>" if self.chance(0.6) else self.named(self.one("div", "ul", "nav", "div"), _NAV, self.links(), 0, plain=0.1)

    def ad(self) -> str:
        return self.named(self.one("div", "div", "aside", "section", "p"), _ADS, self.one(self.prose(1, 2), self.prose(1, 2), f"<a href=/buy>{self.phrase(2, 6)}</a>", f"<p>{self.prose(1, 2)}</p>", f"<h3>{self.phrase()}</h3><p>{self.prose(1, 2)}</p>"), 0, plain=0.05)

    def notice(self) -> str:
        say = self.one("We use cookies. " + self.prose(1, 2), self.prose(1, 3), "This site uses cookies, see our privacy policy.", "Diese Seite verwendet Cookies. " + self.sentence())
        return self.named(self.one("div", "div", "section", "dialog", "aside"), _NOTICE, self.one(f"<p>{say}</p>", say) + self.one("", "<button>Accept</button>", "<button>OK</button>", "<a href='/privacy'>Privacy</a>"), 0, plain=0.05)

    def form(self) -> str:
        fields = self.one(f"<label>{self.phrase()}</label><input name=q><button>{self.one('Search', 'Submit', 'Send', self.phrase(1, 2))}</button>", f"<p>{self.prose(1, 2)}</p><input type=email><button>Subscribe</button>", f"<select><option>{self.phrase()}<option>{self.phrase()}</select><textarea>{self.phrase(2, 8)}</textarea>")
        inside = f"<form>{fields}</form>" if self.chance(0.8) else fields
        return inside.replace("<form", "<form data-label=0", 1) if self.chance(0.3) and inside.startswith("<form") else self.named("div", _FORM, inside, 0)

    def side(self) -> str:
        parts = []
        for _ in range(self.upto(1, 4)):
            parts.append(f"<h{self.one(2, 3, 4)}>{self.one('Related', 'Popular', 'Read more', self.phrase(), 'Archive', 'Tags')}</h3>" if self.chance(0.7) else "")
            parts.append(self.one(self.links(), f"<p>{self.prose(1, 2)}</p>", f"<p>{self.prose(1, 3)}</p><p>{self.prose(1, 2)}</p>", f"<ul><li>{self.sentence()}</li><li>{self.sentence()}</li></ul>", self.form(), self.ad()))
        inside = "".join(parts)
        return f"<aside data-label=0>{inside}</aside>" if self.chance(0.45) else self.named(self.one("div", "aside", "section", "td"), _SIDE, inside, 0, plain=0.05)

    def comments(self) -> str:
        each = []
        for _ in range(self.upto(1, 7)):
            who = self.one(f"<span class=author>{self.phrase(1, 2)}</span>", f"<cite>{self.phrase(1, 2)}</cite> says:", f"<h4>{self.phrase(1, 2)}</h4>", "")
            said = self.one(f"<p>{self.prose(1, 4)}</p>", self.prose(1, 3), f"<p>{self.prose(1, 2)}</p><p>{self.prose(1, 3)}</p>") + self.one("", "<a href='#r'>Reply</a>", f"<time>{self.upto(1, 28)} May 2019</time>")
            each.append(self.named(self.one("li", "div", "article", "section"), ["comment", "reply", "post", "depth", "message"], who + said, plain=0.1))
        head = self.one("<h2>Comments</h2>", f"<h3>{self.upto(2, 99)} comments</h3>", "<h3>Kommentare</h3>", "<h2>Commentaires</h2>", "<h2>Comentarios</h2>", "")
        return self.named(self.one("div", "section", "ol", "div"), _COMMENT, head + "".join(each) + (self.form() if self.chance(0.4) else ""), 0, plain=0.0 if not head else 0.1)

    def header(self) -> str:
        inside = self.one(f"<h1>{self.phrase()}</h1>" if self.chance(0.2) else f"<a href=/>{self.phrase()}</a>", f"<p>{self.phrase(2, 7)}</p>", f"<div class=logo>{self.phrase()}</div><p>{self.sentence()}</p>") + (self.nav() if self.chance(0.6) else "")
        return f"<header data-label=0>{inside}</header>" if self.chance(0.6) else self.named("div", _HEADER, inside, 0, plain=0.05)

    def footer(self) -> str:
        parts = [self.one(f"&copy; {self.word()}.example.com &middot; {self.prose(1, 2)}", f"Copyright {self.upto(1995, 2026)} {self.phrase()}. All rights reserved.", f"<p>{self.prose(1, 3)}</p>", self.links(), f"<p>&copy; {self.phrase()}</p>{self.links()}") for _ in range(self.upto(1, 4))]
        inside = "".join(parts)
        return f"<footer data-label=0>{inside}</footer>" if self.chance(0.65) else self.named("div", _FOOTER, inside, 0, plain=0.05)

    def social(self) -> str:
        return self.named(self.one("div", "p", "ul", "span"), _SOCIAL, self.one("Share on <a href=x>X</a> <a href=y>Y</a>", f"By {self.phrase(1, 2)}, {self.upto(1, 28)} May 2021", f"Posted in <a href=/c>{self.phrase()}</a>", f"Tags: <a href=/t>{self.word()}</a>, <a href=/t>{self.word()}</a>"), 0)

    def content(self) -> str:
        """The article's own blocks, all labelled by the container, with some that aren't of it between them."""
        parts = []
        if self.chance(0.9):
            h = self.one(1, 1, 1, 1, 2)
            title = f"<h{h}>{self.phrase(1, 10)}{self.one('', '', '.', '?', self.one('%%%', '&amp;', '***') if self.junk else '')}</h{h}>"
            parts.append(f"<header>{title}{self.social() if self.chance(0.6) else ''}</header>" if self.chance(0.15) else title + (self.social() if self.chance(0.25) else ""))
        bare = self.chance(0.1)
        for _ in range(self.one(0, 1, 2, 3, 4, 6, 9, 14) if parts else self.upto(2, 12)):
            kind = self.r.random()
            if bare and kind < 0.64:
                parts.append(f"{self.prose()}<br><br>" if self.chance(0.5) else f"<div>{self.prose()}</div>")
            elif kind < 0.64:
                p = self.prose(1, self.one(1, 2, 4, 8, 20))
                parts.append(self.one(f"<p>{p}</p>", f"<p>{p}</p>", f"<p>{p}", f"<p class={self.word()[:1] or 'x'}1>{p}</p>", f"<p><b>{p}<br>"))
            elif kind < 0.71:
                parts.append(f"<h{(k := self.one(2, 3, 4))}>{self.phrase(1, 7)}</h{k}>")
            elif kind < 0.77:
                parts.append("<ul>" + "".join(f"<li>{self.one(self.sentence(), self.phrase(1, 5))}</li>" for _ in range(self.upto(1, 6))) + "</ul>")
            elif kind < 0.80:
                parts.append(f"<blockquote>{self.one('<p>{}</p>', '{}').format(self.prose(1, 3))}</blockquote>")
            elif kind < 0.82:
                parts.append(f"<figure><img src=x><figcaption>{self.one(self.sentence(), self.phrase(2, 8))}</figcaption></figure>")
            elif kind < 0.84:
                parts.append("<table>" + "".join(f"<tr><td>{self.phrase()}</td><td>{self.upto(1, 999)}</td></tr>" for _ in range(self.upto(1, 5))) + "</table>")
            elif kind < 0.85:
                parts.append(f"<pre>{self.phrase(2, 9)}\n  {self.phrase(2, 9)}</pre>")
            else:
                parts.append(self.one(self.ad, self.ad, self.ad, self.social, self.form, self.side, self.notice, self.nav)())
        if self.chance(0.12):
            parts.append(self.one(self.social, self.side, self.comments, self.form)())
        return "".join(parts)

    def page(self) -> str:
        self.syllables = self.one(*_SYLLABLES).split()
        self.junk = self.chance(0.15)
        body = self.content()
        how = self.r.random()
        if how < 0.45:
            main = f"<article data-label=1>{body}</article>" if self.chance(0.6) else self.named("article", _CONTENT, body, 1)
        elif how < 0.6:
            main = f"<main data-label=1>{body}</main>"
        elif how < 0.9:
            main = self.named(self.one("div", "div", "section", "main", "td"), _CONTENT, body, 1, plain=0.1)
        else:
            main = self.one('<div role="main" data-label=1>{}</div>', '<div itemprop="articleBody" data-label=1>{}</div>', "<div data-label=1>{}</div>").format(body)
        if self.chance(0.25):
            main = self.named(self.one("div", "main", "section"), ["wrap", "container", "page", "main", "layout", *_CONTENT], main, plain=0.5)
        before = [f() for f, p in ((self.header, 0.5), (self.nav, 0.7), (self.notice, 0.25), (self.ad, 0.4), (self.form, 0.15), (self.side, 0.12), (self.social, 0.1)) if self.chance(p)]
        after = [f() for f, p in ((self.social, 0.15), (self.ad, 0.15), (self.comments, 0.35), (self.side, 0.35), (self.nav, 0.1), (self.form, 0.12), (self.notice, 0.1)) if self.chance(p)]
        self.r.shuffle(before)
        end = self.footer() if self.chance(0.8) else ""
        script = self.one("", '<script>var t="</p>";track(1);</script>', "<style>p{margin:0}</style>")
        top = f"<!DOCTYPE html><html><head><title>{self.phrase()}</title>{script}</head><body>" if self.chance(0.9) else ""
        return top + "<!-- x -->".join(before) + main + "".join(after) + end + ("</body></html>" if self.chance(0.8) else "")


def labelled(n: int, seed: int = 12) -> list[str]:
    """n made-up pages, whose data-label attributes say which blocks are the text."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
