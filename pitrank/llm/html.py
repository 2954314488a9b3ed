"""Main text of web pages by a recurrent block labeller.

A page is split into leaf blocks: runs of text between block-level tags, with the open tags above them.  Every
block becomes a vector of hashed tag-path names (tags, classes, ids), all its hashed words, those of its two ends and
a few ratios; a bidirectional LSTM in numpy reads the blocks of the whole page in order and classifies each with the context
of the document on both sides.

No page carries labels, so the labeller learns from two bounded sources: pages written by a small generator
that knows which of its blocks are article text, and a hash sample of the table whose blocks are labelled by
the elements that name their role (article or main against nav, footer, aside, form and the like).  In both,
names are blanked at random, so that context has to carry the decision as well.

Scripts, styles, comments and markup are dropped by the parser.  Edge cases: null and empty html give the
empty text; broken or unclosed markup is read as far as it goes; repeated rows and extra columns pass
through; pages are read whole, very long ones in chunks
that carry the state; an empty table gives no row.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import append_map, bounded_sample

PATH_BUCKETS, WORD_BUCKETS, ALL_BUCKETS, HIDDEN = 192, 16, 32, 20
FIT_PAGES, FIT_HTML_CHARS, MADE_PAGES = 200, 4_000_000, 600

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg textarea select object".split())
#: Without an end tag these run to the end of the page; of the others only the tag is skipped.
TO_END = frozenset("script style textarea iframe".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Names of a path from which on it no longer takes names that its vector shows already.
LONG_PATH = 64
#: Elements that name the role of what they hold.
MAIN, SIDE = frozenset(("article", "main")), frozenset("nav footer aside form header head menu button dialog".split())
ROLES = MAIN | SIDE | {".ad"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?/a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.S)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def _longer(path: tuple[str, ...], names: tuple[str, ...]) -> tuple[str, ...]:
    """``path`` with the names it lacks; a very long one takes only names that its vector does not show yet."""
    for n in names:
        if n not in path and (len(path) < LONG_PATH or n in ROLES or _bucket(n, PATH_BUCKETS) not in {_bucket(m, PATH_BUCKETS) for m in path}):
            path += (n,)
    return path


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in order, without empty ones."""
    out: list[Block] = []
    # Open elements: tag and the names on the path to it, shared with the element around it where it adds none.
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0
    unended: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else (), linked))
            parts.clear()
        linked = 0

    def close(tag: str) -> None:
        while open_tags[tag]:
            top = stack.pop()[0]
            open_tags[top] -= 1
            if top == tag:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                piece = entities.unescape(piece)
                parts.append(piece)
                if open_tags["a"]:
                    linked += len(piece)
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            close(tag)
        elif tag in RAW:
            parts.append(" ")
            if tag == "svg" and m[3].endswith("/"):
                continue
            end = None if tag in unended else re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in TO_END:
                at = size
            else:
                unended.add(tag)
        elif tag in VOID:
            parts.append(" ")
        else:
            if tag not in INLINE:
                flush()
                if tag in CLOSES_P:
                    close("p")
                elif tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                    close(tag)
            names: tuple[str, ...] = (tag,)
            if m[3]:
                for values in _NAMED.findall(m[3]):
                    names += tuple("." + w for w in _NAME.findall("".join(values).lower()))
            if tag not in ("html", "body"):
                stack.append((tag, _longer(stack[-1][1] if stack else (), names)))
                open_tags[tag] += 1
    flush()
    return out


def _bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % n


#: Blocks of a page that are read at once.
CHUNK = 4096
_PATHS: dict[tuple, np.ndarray] = {}
WIDTH = PATH_BUCKETS + WORD_BUCKETS + ALL_BUCKETS + 7


def _hashed_words(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signed sums by bucket of the words at the two ends and of all words of every block, and the numbers of words."""
    texts = [b.text.encode("utf-8", "surrogatepass") for b in blocks]
    n = np.array([t.count(b" ") + 1 for t in texts])
    h = np.fromiter(map(zlib.crc32, b" ".join(texts).split(b" ")), np.int64, n.sum())
    row, sign = np.repeat(np.arange(len(n)), n), 2.0 * (h & 1) - 1
    at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    end = (at < 3) * 1.0 + (at >= n[row] - 3)  # a short block's words count twice

    def sums(weights: np.ndarray, k: int) -> np.ndarray:
        return np.bincount(row * k + (h >> 1) % k, weights, len(n) * k).reshape(len(n), k)
    return sums(sign * end, WORD_BUCKETS), sums(sign, ALL_BUCKETS), n


def vectors_of(whole: list[Block], first: int = 0, end: int | None = None) -> np.ndarray:
    """Vectors of the blocks of a page from ``first`` up to ``end``."""
    blocks = whole[first:end]
    out = np.zeros((len(blocks), WIDTH), np.float32)
    if not blocks:
        return out
    ends, every, counts = _hashed_words(blocks)
    out[:, PATH_BUCKETS:PATH_BUCKETS + WORD_BUCKETS] = ends / 3  # the ends of a block tell its kind
    out[:, PATH_BUCKETS + WORD_BUCKETS:-7] = every / np.sqrt(counts)[:, None]
    for i, b in enumerate(blocks):
        path = _PATHS.get(b.path)
        if path is None:
            path = np.zeros(PATH_BUCKETS, np.float32)
            path[[_bucket(n, PATH_BUCKETS) for n in b.path]] = 1
            if len(_PATHS) < 50_000:
                _PATHS[b.path] = path
        out[i, :PATH_BUCKETS] = path
        n = len(b.text)
        out[i, -7:] = (math.log1p(counts[i]) / 3, min(b.linked / n, 1), b.text[-1] in ".!?\"'", b.text[0].isupper(),
                       "©" in b.text, (first + i) / len(whole), 1 / (1 + len(whole) - first - i))
    return out


@dataclass
class Labeller:
    """Weights of the two directions (input, recurrent, bias) and of the output layer."""
    ways: list[list[np.ndarray]]
    out: np.ndarray
    bias: float


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _read(x: np.ndarray, mask: np.ndarray, way: list[np.ndarray], keep: bool, state: list[np.ndarray] | None = None):
    """States by step of one direction; ``x`` is page, step, feature, and ``mask`` 0 behind a page's end.

    ``state`` (hidden and cell) is where the reading goes on from; it is replaced by where it ends.
    """
    w, u, b = way
    n, steps, _ = x.shape
    h, c = state or [np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)]
    fed = x @ w + b
    states, tape = np.zeros((n, steps, HIDDEN), np.float32), []
    for t in range(steps):
        z = fed[:, t] + h @ u
        gates = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        live = mask[:, t:t + 1]
        new_c = (f * c + i * g) * live
        tc = np.tanh(new_c)
        new_h = o * tc * live
        if keep:
            tape.append((h, c, i, f, o, g, tc, live))
        h, c = new_h, new_c
        states[:, t] = h
    if state:
        state[:] = h, c
    return states, tape


def _unread(x, way, tape, into):
    """Gradients of one direction's weights from the gradients of its states."""
    w, u, _ = way
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32)
    dh_next, dc_next = 0.0, 0.0
    for t in range(len(tape) - 1, -1, -1):
        h, c, i, f, o, g, tc, live = tape[t]
        dh = (into[:, t] + dh_next) * live
        dc = (dh * o * (1 - tc * tc) + dc_next) * live
        dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
        dw += x[:, t].T @ dz
        du += h.T @ dz
        db += dz.sum(0)
        dh_next, dc_next = dz @ u.T, dc * f
    return [dw, du, db]


def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse; what lies behind its end stays there."""
    steps = x.shape[1]
    at = np.arange(steps)[None, :]
    index = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, index[..., None], axis=1)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), lengths.max(), WIDTH), np.float32)
    for k, p in enumerate(pages):
        x[k, :len(p)] = p
    return x, lengths, (np.arange(lengths.max())[None, :] < lengths[:, None]).astype(np.float32)


def label_pages(pages: list[np.ndarray], model: Labeller, cells: int = 40_000) -> list[np.ndarray]:
    """Probability of article text of every block; pages of similar length are read together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        longest, take = len(pages[order[-1]]), 1
        take = max(1, min(len(order), cells // longest))
        group, order = order[-take:], order[:-take]
        x, lengths, mask = _padded([pages[k] for k in group])
        ahead, _ = _read(x, mask, model.ways[0], False)
        back = _flip(_read(_flip(x, lengths), mask, model.ways[1], False)[0], lengths)
        p = _sigmoid(np.concatenate((ahead, back), axis=2) @ model.out + model.bias)
        for row, k in enumerate(group):
            out[k] = p[row, :lengths[row]]
    return out


def label_long_page(blocks: list[Block], model: Labeller, chunk: int = CHUNK) -> np.ndarray:
    """As ``label_pages`` for one page of any length: both directions read it in chunks and carry their state."""
    total = np.full(len(blocks), model.bias, np.float32)
    for way, weights, ahead in ((model.ways[0], model.out[:HIDDEN], True), (model.ways[1], model.out[HIDDEN:], False)):
        state = [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
        starts = range(0, len(blocks), chunk)
        for a in starts if ahead else reversed(starts):
            x = vectors_of(blocks, a, a + chunk)[None]
            x = x if ahead else x[:, ::-1]
            h = _read(x, np.ones(x.shape[:2], np.float32), way, False, state)[0][0]
            total[a:a + chunk] += (h if ahead else h[::-1]) @ weights
    return _sigmoid(total)


def train_labeller(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, rate: float = 0.01, seed: int = 5) -> Labeller:
    rng = np.random.default_rng(seed)

    def way():
        b = np.zeros(4 * HIDDEN, np.float32)
        b[HIDDEN:2 * HIDDEN] = 1
        return [rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32), rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32), b]
    params = [*way(), *way(), rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    pages = [p for p in pages if len(p[0])]
    t = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(pages)), key=lambda k: len(pages[k][0]) // 8)
        batches = [order[a:a + 24] for a in range(0, len(order), 24)]
        for b in rng.permutation(len(batches)):
            group = batches[b]
            x, lengths, mask = _padded([pages[k][0] for k in group])
            y = np.zeros(mask.shape, np.float32)
            for r, k in enumerate(group):
                y[r, :lengths[r]] = pages[k][1]
            flipped = _flip(x, lengths)
            ahead, tape_a = _read(x, mask, params[:3], True)
            back_raw, tape_b = _read(flipped, mask, params[3:6], True)
            both = np.concatenate((ahead, _flip(back_raw, lengths)), axis=2)
            d = (_sigmoid(both @ params[6] + params[7]) - y) * mask / mask.sum()
            into = d[..., None] * params[6]
            grads = [*_unread(x, params[:3], tape_a, into[..., :HIDDEN]),
                     *_unread(flipped, params[3:6], tape_b, _flip(into[..., HIDDEN:], lengths)),
                     np.einsum("nt,nth->h", d, both), np.array([d.sum()], np.float32)]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            t += 1
            for k, g in enumerate(grads):
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = (params[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return Labeller([params[:3], params[3:6]], params[6], float(params[7][0]))


def made_page(rng: random.Random) -> tuple[list[Block], list[int]]:
    """Blocks of one invented page and whether each is article text."""
    letters = "etaoinshrdlucmfwypvbgk"

    def word():
        return "".join(rng.choices(letters, k=rng.randrange(2, 10)))

    def words(low, high, stop=""):
        text = " ".join(word() for _ in range(rng.randrange(low, high)))
        return text[:1].upper() + text[1:] + stop
    out: list[tuple[Block, int]] = []

    def add(path, text, linked=0.0, main=0):
        out.append((Block(text, tuple(path.split()), int(linked * len(text))), main))

    def menu(path):
        for _ in range(rng.randrange(3, 9)):
            add(path + rng.choice([" ul li a", " li a", " a"]), words(1, 3), 1.0)

    def sentence():
        return words(2, 60, rng.choice([".", ".", ".", "!", "?", ""]))
    add("head title", words(2, 10))
    if rng.random() < 0.5:
        add(rng.choice(["header .site .header", "div .header .masthead", "header", "div .top .bar"]), words(1, 6))
    if rng.random() < 0.9:
        menu(rng.choice(["nav", "nav .main .nav", "div .menu", "div .navbar .nav", "header nav", "nav .breadcrumb"]))
    if rng.random() < 0.4:
        add(rng.choice(["div .cookie .notice p", "div .notice", "div .cookie .banner", "div .alert p", "div .consent", "aside .notice p"]), sentence())
    def advert(path=""):
        add(path + rng.choice(["div .ad", "div .ads", "div .advert", "div .ad .banner", "aside .promo", "div .sponsored p", "div .advertisement"]), sentence(), rng.choice([0.0, 0.0, 1.0]))
    if rng.random() < 0.6:
        advert()
    if rng.random() < 0.3:
        add("form " + rng.choice(["p", "fieldset", "div", "button"]), words(1, 6))
    body = rng.choice(["article", "article", "main article", "main", "div .content", "div .post .body", "section .article", "div .entry .content", "main div .text", "div"])
    if rng.random() < 0.8:
        add(body + " h1", words(2, 12), main=1)
    for _ in range(rng.randrange(1, 25)):
        kind = rng.random()
        if kind < 0.70:
            add(body + rng.choice([" p", " p", " p", " p b", " div p"]), sentence(), rng.choice([0.0, 0.0, 0.1, 0.3]), 1)
        elif kind < 0.75:
            add(body + rng.choice([" h2", " h3", " h4"]), words(1, 8), main=1)
        elif kind < 0.80:
            for _ in range(rng.randrange(2, 6)):
                add(body + rng.choice([" ul li", " ol li"]), words(2, 20), rng.choice([0.0, 0.2]), 1)
        elif kind < 0.83:
            add(body + rng.choice([" blockquote", " blockquote p", " pre", " table tr td", " figure figcaption", " pre code"]), sentence(), main=1)
        elif kind < 0.91:
            advert(body + " ")
        elif kind < 0.96:
            add(body + rng.choice([" aside p", " aside .related a", " form p", " nav a", " div .share a", " div .newsletter p", " footer p", " header p"]), words(1, 15), rng.choice([0.0, 1.0]))
        else:
            add(body, sentence(), main=1)
    if rng.random() < 0.5:
        where = rng.choice(["aside", "div .sidebar", "aside .sidebar", "div .related", "section .related", "div .widget"])
        for _ in range(rng.randrange(1, 7)):
            add(where + rng.choice([" ul li a", " p", " h3", " a", " div"]), words(1, 14), rng.choice([0.0, 1.0]))
    if rng.random() < 0.5:
        where = rng.choice(["div .comments", "section .comments", "div .comment .list", "section .comments article .comment", "div .comments .area ol li", "div .replies", "div .responses"])
        if rng.random() < 0.5:
            add(where + rng.choice([" h2", " h3"]), words(1, 3))
        for _ in range(rng.randrange(1, 8)):
            add(where + rng.choice([" p", " div .comment p", " li", " div .comment", " article .comment p"]), sentence())
    if rng.random() < 0.3:
        for _ in range(rng.randrange(1, 4)):
            add("form " + rng.choice([".search", ".newsletter p", ".comment .form label", "p", "button"]), words(1, 5))
    if rng.random() < 0.9:
        where = rng.choice(["footer", "footer", "div .footer", "footer .site .footer"])
        for _ in range(rng.randrange(1, 5)):
            add(where + rng.choice(["", " p", " a", " ul li a"]), rng.choice(["© ", "", ""]) + sentence(), rng.choice([0.0, 1.0]))
    return [b for b, _ in out], [y for _, y in out]


def role_of(path: tuple[str, ...]) -> int | None:
    """1 inside an article, 0 inside a side element, None where no element names the role."""
    if any(n in SIDE for n in path) or ".ad" in path:
        return 0
    return 1 if any(n in MAIN for n in path) else None


def _blanked(blocks: list[Block], rng: np.random.Generator) -> list[Block]:
    """The same blocks; at random, some names of the page are replaced by ``div``."""
    names = {n for b in blocks for n in b.path}
    gone = {n for n in sorted(names) if rng.random() < 0.12}
    return [Block(b.text, tuple("div" if n in gone else n for n in b.path), b.linked) for b in blocks]


def fit_labeller(pages: DataFrame, html: str = "html", key: str = "page_id", *, rows: int = FIT_PAGES, chars: int = FIT_HTML_CHARS,
                 made: int = MADE_PAGES, seed: int = 5) -> Labeller:
    """Fit on ``made`` generated pages and a hash sample of ``rows`` pages and ``chars`` characters at most."""
    rng, names = np.random.default_rng(seed), random.Random(seed)
    known: list[tuple[list[Block], list[int]]] = [made_page(names) for _ in range(made)]
    taken = bounded_sample(pages.where(F.col(html).isNotNull()), html, key, rows, chars).select(html, F.xxhash64(key, html).alias("k")).collect()
    for r in sorted(taken, key=lambda r: (r.k, r[0])):
        blocks = blocks_of(r[0])
        roles = [role_of(b.path) for b in blocks]
        if 1 in roles and None not in roles:
            known.append((blocks, roles))
    examples = [(vectors_of(_blanked(b, rng) if k % 3 == 0 else b), np.array(y, np.float32)) for k, (b, y) in enumerate(known)]
    return train_labeller(examples, seed=seed)


def main_text(pages: list[str], model: Labeller, threshold: float = 0.5) -> list[tuple[str, int, int]]:
    """Text, number of blocks and number of blocks kept of every page."""
    split = [blocks_of(p) for p in pages]
    labels = label_pages([vectors_of(b) if len(b) <= CHUNK else np.zeros((0, WIDTH), np.float32) for b in split], model)
    labels = [label_long_page(b, model) if len(b) > CHUNK else p for b, p in zip(split, labels, strict=True)]
    out = []
    for blocks, p in zip(split, labels, strict=True):
        kept = [b.text for b, q in zip(blocks, p, strict=True) if q >= threshold]
        out.append(("\n".join(kept), len(blocks), len(kept)))
    return out


def extract_main(pages: DataFrame, model: Labeller, html: str = "html", group: int = 256) -> DataFrame:
    """Add ``text``, ``n_blocks`` and ``n_kept`` to every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # 100 kB

    def run(column: pa.Array) -> list[pa.Array]:
        texts = [x or "" for x in column.to_pylist()]
        found = [r for a in range(0, len(texts), group) for r in main_text(texts[a:a + group], shared.value)]
        text, n, m = zip(*found, strict=True)
        return [pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(m, pa.int32())]

    return append_map(pages, [F.col(html).cast("string")], {"text": "string", "n_blocks": "integer", "n_kept": "integer"}, run)
