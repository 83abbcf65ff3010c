"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of blocks, the texts between block-level tags. Each block has vectors of its tag path (tag
names and the words of class, id and role, hashed) and of its words (hashed), over all names and all words, and a few
numbers (length, share of link text, place). Open elements form a tree, so a path's sum is its parent's and its own names'. A bidirectional LSTM reads the sequence both ways, so every block is labelled with the whole page as
context. The blocks labelled as content are joined.

The LSTM is trained in numpy, in one task, on `LAYOUTS` pages that are put together from layouts (`_layout`: the usual
containers of articles and of everything around them, with and without telling names, and containers that no name
gives away) and from the words of at most `SAMPLE_PAGES` pages of the table, the ones of smallest hash. Only its
weights (`WEIGHT_BYTES`, whatever the corpus) go to the tasks. Pages are read whole; the labeller runs over the pages
of an Arrow batch at a time, grouped by their number of blocks.

A null or empty html has no blocks and gives an empty text. Broken markup is read as browsers do: what is left open is
closed, a tag whose quote never closes ends at its next >, a tag that never ends is dropped with what follows. What
stands between <svg>, <object>, <canvas> or <select> and its own end tag is not content; where that tag is missing, what
follows is labelled like any other block. Repeated rows are labelled each; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.stages import written

SAMPLE_PAGES = 200
LAYOUTS = 500
EPOCHS = 6
HIDDEN, VECTOR, PATHS, WORDS = 24, 16, 2048, 1024
NUMBERS = 6

# Elements of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title head".split())
EMBEDDED = frozenset("select svg object canvas".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_OPEN_QUOTE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")  # a quote that never closes: the tag ends where it seems to
_MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_VALUE_WITH_SLASH = re.compile(r"=\s*[^\s\"'=]+/$")  # the / belongs to an unquoted value and closes nothing
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Za-z]+")
_PARAGRAPH_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def _bucket(name: str, size: int) -> int:
    return zlib.crc32(name.encode()) % size


class Element:
    __slots__ = ("tag", "names", "parent")

    def __init__(self, tag: str, names: list[str], parent: Element | None):
        self.tag, self.names, self.parent = tag, names, parent


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element | None, linked: int):
        self.text, self.element, self.linked = text, element, linked

    @property
    def path(self) -> tuple[str, ...]:
        """The names of all open elements, outermost first."""
        levels, element = [], self.element
        while element:
            levels.append(element.names)
            element = element.parent
        return tuple(n for names in reversed(levels) for n in names)


def parse(page: str | None) -> list[Block]:
    """The blocks of a page in order, without raw elements; time is linear in the page."""
    page = page or ""
    blocks: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    links = linked = svgs = 0
    opened: list[tuple[int, int]] = []  # of open embedded elements: place on the stack, blocks before them
    hidden: list[tuple[int, int]] = []  # ranges of blocks within closed embedded elements
    places: dict[str, list[int]] = {}  # where on the stack the elements of each tag are

    def innermost(*tags: str) -> int:
        return max(places[t][-1] if places.get(t) else -1 for t in tags)

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            blocks.append(Block(text, stack[-1] if stack else None, linked))
        parts.clear()
        linked = 0

    def close(upto: int, ended: bool = False) -> None:
        nonlocal links, svgs
        if any(e.tag not in INLINE for e in stack[upto:]):
            flush()
        links -= sum(e.tag == "a" for e in stack[upto:])
        svgs -= sum(e.tag == "svg" for e in stack[upto:])
        for e in stack[upto:]:
            places[e.tag].pop()
        del stack[upto:]
        while opened and opened[-1][0] > upto:
            opened.pop()
        if opened and opened[-1][0] == upto:
            _, first = opened.pop()
            if ended:
                while hidden and hidden[-1][0] >= first:
                    hidden.pop()
                hidden.append((first, len(blocks)))

    at, last_end = 0, page.rfind(">")
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            lt = len(page)
        if lt > at:
            text = entities.unescape(page[at:lt])
            parts.append(text)
            linked += len(text) if links else 0
        if lt >= len(page):
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        kind = page[lt + 1 : lt + 2]
        if kind in ("!", "?") or page[lt + 1 : lt + 3] == "/":
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        if not (kind.isascii() and kind.isalpha()) and not (kind == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha()):
            if lt + 1 >= len(page) or (kind == "/" and lt + 2 >= len(page)):
                break
            parts.append("<")
            at = lt + 1
            continue
        found = (_TAG.match(page, lt) or _OPEN_QUOTE_TAG.match(page, lt)) if last_end > lt else None
        if not found:
            break
        closing, tag, marks = found.group(1), found.group(2).lower(), found.group(3)
        at = found.end()
        if closing:
            if places.get(tag):
                close(places[tag][-1], ended=True)
            continue
        if (svgs or tag == "svg") and marks.endswith("/") and not _VALUE_WITH_SLASH.search(marks):
            if tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            if tag not in ("title", "head"):
                flush()
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at) if tag != "head" else None
            if tag != "head":
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE and tag != "img" and tag != "input":
                flush()
            continue
        if tag not in INLINE:
            flush()
            if tag in _PARAGRAPH_ENDS:
                spot = innermost("p", "div", "article", "section", "td", "body", "li")
                if spot >= 0 and stack[spot].tag == "p":
                    close(spot)
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                spot = innermost(tag, "ul", "ol", "dl", "table")
                if spot >= 0 and stack[spot].tag == tag:
                    close(spot)
        names = [tag]
        if "=" in marks:
            for key, *values in _MARK.findall(marks):
                names += [f"{tag if key.lower() == 'role' else ''}.{w.lower()}" for v in values for w in _NAME.findall(v)]
        places.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, names, stack[-1] if stack else None))
        links += tag == "a"
        svgs += tag == "svg"
        if tag in EMBEDDED:
            opened.append((len(stack) - 1, len(blocks)))
    flush()
    kept, at = [], 0
    for low, high in hidden:
        kept += blocks[at:low]
        at = high
    return kept + blocks[at:] if hidden else blocks


class Paths:
    """The elements above a page's blocks, parents first: buckets of their names, and the element of each block.

    Sums over n names are divided by sqrt(n), so that one telling name is still heard among many that only arrange.
    """

    def __init__(self, blocks: list[Block]):
        place: dict[Element | None, int] = {}
        names, self.parents, known, at = [], [], [], []
        for block in blocks:
            new, element = [], block.element
            while element and element not in place:
                new.append(element)
                element = element.parent
            for element in reversed(new):
                place[element] = len(names)
                up = place[element.parent] if element.parent else -1
                names.append(element.names)
                self.parents.append(up)
                known.append(len(element.names) + (known[up] if up >= 0 else 0))
            if not block.element and None not in place:
                place[None] = len(names)  # under no element: bucket 0
                names.append([])
                self.parents.append(-1)
                known.append(1)
            at.append(place[block.element])
        self.at, self.scale = np.array(at, np.int64), np.sqrt(np.array(known, np.float32))
        self.sizes = np.array([max(1, len(n)) for n in names])
        self.buckets = np.array([x for n in names for x in ([_bucket(w, PATHS) for w in n] or [0])])
        self.inner = [(i, up) for i, up in enumerate(self.parents) if up >= 0]

    def vectors(self, table: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(table[self.buckets], np.cumsum(self.sizes) - self.sizes, axis=0)
        for i, up in self.inner:
            sums[i] += sums[up]
        return sums[self.at] / self.scale[self.at][:, None]

    def add_gradient(self, out: np.ndarray, part: np.ndarray) -> None:
        sums = np.zeros((len(self.sizes), part.shape[1]), part.dtype)
        np.add.at(sums, self.at, part / self.scale[self.at][:, None])
        for i, up in reversed(self.inner):
            sums[up] += sums[i]
        np.add.at(out, self.buckets, np.repeat(sums, self.sizes, axis=0))


class Words:
    """Buckets of all words of a page's blocks with their weights, which add up to one in each block."""

    def __init__(self, texts: list[list[str]]):
        buckets, weights = [], []
        for found in texts:
            part = np.array([_bucket(w, WORDS) for w in found])
            counts = np.ones(len(part))
            if len(part) > WORDS:
                part, counts = np.unique(part, return_counts=True)
            buckets.append(part)
            weights.append(counts / len(found))
        self.sizes = np.array([len(b) for b in buckets])
        self.buckets, self.weights = np.concatenate(buckets), np.concatenate(weights)[:, None].astype(np.float32)

    def vectors(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.buckets] * self.weights, np.cumsum(self.sizes) - self.sizes, axis=0)

    def add_gradient(self, out: np.ndarray, part: np.ndarray) -> None:
        np.add.at(out, self.buckets, np.repeat(part, self.sizes, axis=0) * self.weights)


def describe(blocks: list[Block]) -> tuple[Paths, Words, np.ndarray]:
    """Path buckets, word buckets and numbers of every block."""
    texts, numbers = [], np.zeros((len(blocks), NUMBERS), np.float32)
    for i, block in enumerate(blocks):
        found = block.text.lower().split()
        texts.append(found)
        numbers[i] = (np.log1p(len(found)) / 5, min(1.0, block.linked / max(1, len(block.text))), i / len(blocks), block.text[-1] in ".!?\"”", np.log1p(len(blocks)) / 5, block.text[0].isupper())
    return Paths(blocks), Words(texts), numbers


class Labeller:
    """Embeddings, two LSTMs, and a logistic output; weights are one flat array."""

    def __init__(self, weights: np.ndarray | None = None):
        width = 2 * VECTOR + NUMBERS
        shapes = {"path": (PATHS, VECTOR), "word": (WORDS, VECTOR), "out": (2 * HIDDEN,), "bias": (1,)}
        for side in ("left", "right"):
            shapes |= {f"{side}_w": (width + HIDDEN, 4 * HIDDEN), f"{side}_b": (4 * HIDDEN,)}
        self.size = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.zeros(self.size, np.float32) if weights is None else weights
        self.p, at = {}, 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            self.p[name] = self.flat[at : at + n].reshape(shape)
            at += n
        if weights is None:
            rng = np.random.default_rng(0)
            for name in ("path", "word", "out", "left_w", "right_w"):
                self.p[name][:] = rng.normal(0, 0.3 if name in ("path", "word") else 0.2, self.p[name].shape)
            for side in ("left", "right"):
                self.p[f"{side}_b"][HIDDEN : 2 * HIDDEN] = 1

    def inputs(self, paths: Paths, words: Words, numbers: np.ndarray) -> np.ndarray:
        return np.hstack([paths.vectors(self.p["path"]), words.vectors(self.p["word"]), numbers]).astype(np.float32)

    def _run(self, side: str, x: np.ndarray, keep: bool):
        """Hidden states of (steps, pages, width) inputs; what the way back needs, if asked for."""
        w, b = self.p[f"{side}_w"], self.p[f"{side}_b"]
        steps, pages, width = x.shape
        ahead = x.reshape(-1, width) @ w[:width] + b
        ahead = ahead.reshape(steps, pages, -1)
        h = c = np.zeros((pages, HIDDEN), np.float32)
        states, saved = np.empty((steps, pages, HIDDEN), np.float32), []
        for t in range(steps):
            z = ahead[t] + h @ w[width:]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            previous, c = c, f * c + i * g
            if keep:
                saved.append((h, previous, i, f, o, g, np.tanh(c)))
            h = o * np.tanh(c)
            states[t] = h
        return states, saved

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Logits of (steps, pages, width) inputs."""
        left, _ = self._run("left", x, False)
        right, _ = self._run("right", x[::-1], False)
        return np.concatenate([left, right[::-1]], axis=2) @ self.p["out"] + self.p["bias"]

    def gradients(self, paths, words, numbers, truth: np.ndarray) -> np.ndarray:
        """Gradient of the mean logistic loss of one page."""
        grad = Labeller(np.zeros(self.size, np.float32))
        x = self.inputs(paths, words, numbers)[:, None, :]
        steps, _, width = x.shape
        runs_ = {"left": self._run("left", x, True), "right": self._run("right", x[::-1], True)}
        states = np.concatenate([runs_["left"][0], runs_["right"][0][::-1]], axis=2)[:, 0]
        logit = states @ self.p["out"] + self.p["bias"]
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - truth) / steps).astype(np.float32)
        grad.p["out"][:] = states.T @ error
        grad.p["bias"][:] = error.sum()
        pulled = error[:, None] * self.p["out"]
        dx = np.zeros((steps, width), np.float32)
        for side, part in (("left", pulled[:, :HIDDEN]), ("right", pulled[::-1, HIDDEN:])):
            w, saved = self.p[f"{side}_w"], runs_[side][1]
            inputs = x[:, 0] if side == "left" else x[::-1, 0]
            dh = dc = np.zeros(HIDDEN, np.float32)
            dz = np.empty((steps, 4 * HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1):
                _, previous, i, f, o, g, tc = (s[0] for s in saved[t])
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz[t] = np.concatenate([dc * g * i * (1 - i), dc * previous * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
                dh, dc = w[width:] @ dz[t], dc * f
            before = np.array([s[0][0] for s in saved])
            grad.p[f"{side}_w"][:] = np.vstack([inputs.T @ dz, before.T @ dz])
            grad.p[f"{side}_b"][:] = dz.sum(axis=0)
            back = dz @ w[:width].T
            dx += back if side == "left" else back[::-1]
        paths.add_gradient(grad.p["path"], dx[:, :VECTOR])
        words.add_gradient(grad.p["word"], dx[:, VECTOR : 2 * VECTOR])
        return grad.flat


WEIGHT_BYTES = 4 * Labeller().size

# Usual names of containers.
_CONTENT_BOXES = ("article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "div.story", "section.post-body", "div.main", "div.text", "div.page-content", "section")
_MENUS = ("nav", "div.menu", "ul.nav", "div.navbar", "div.breadcrumbs", "div.topbar", "nav.pagination", "div.tags", "div.share", "div.social", "ul.menu")
_SIDES = ("aside", "div.sidebar", "div.widget", "div.related", "div.recommended", "section.popular", "div.more-stories")
_NOTICES = ("div.ad", "div.ads", "div.banner", "div.advert", "div.sponsored", "div.promo", "aside.ad", "div.cookie-notice", "div.consent", "div.notice", "div.alert", "div.popup", "div.paywall", "div.disclaimer", "div.newsletter")
_COMMENTS = ("div.comments", "section.comments", "ol.comment-list", "div.comment", "div.replies", "div.disqus-thread", "div.user-comments", "section.discussion")
_FORMS = ("form", "form.search", "div.login", "form.subscribe", "fieldset")
# Names of containers that only arrange others.
_GRID = "container container-fluid row col-xs-12 col-sm-6 col-md-4 col-lg-3 wrapper wrap inner outer page site layout grid flex d-flex justify-center mx-auto px-4 clearfix block region panel body root app is-wide has-gutter".split()
_HEADERS, _FOOTERS = ("header", "div.header", "div.masthead", "div.site-header"), ("footer", "div.footer", "div.site-footer", "div.copyright", "div.legal")


# Private characters that carry a label through the parser.
_SIGNS = (chr(0xE000), chr(0xE001))


def _layout(rng: random.Random, vocabulary: list[str]) -> list[tuple[Block, int]]:
    """Blocks of one made-up page with their labels."""
    phrase = lambda low, high: " ".join(rng.choices(vocabulary, k=rng.randint(low, high)))
    plain = rng.random() < 0.15  # no name tells anything
    depth = rng.randint(1, 12) if rng.random() < 0.5 else 0  # containers that only arrange others, above and below the telling ones
    page: list[tuple[str, int]] = []

    def grid() -> tuple[str, str]:
        levels = rng.randint(0, depth)
        return "".join(f"""<div class="{' '.join(rng.choices(_GRID, k=rng.randint(1, 6)))}">""" for _ in range(levels)), "</div>" * levels

    def box(name: str, inner: str) -> str:
        above, below = grid(), grid()
        tag, _, mark = name.partition(".")
        if plain:
            tag, mark = "div", f"{rng.choice('xyzqw')}{rng.randint(0, 99)}"
        return f'{above[0]}<{tag}{f""" class="{mark}" """ if mark else ""}>{below[0]}{inner}{below[1]}</{tag}>{above[1]}'

    def sentence() -> str:
        return phrase(1, 25).capitalize() + rng.choice([".", ".", ".", "!", ""])

    def paragraphs() -> str:
        out = []
        for _ in range(rng.randint(1, 12)):
            text = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 8])))
            out.append(rng.choice([f"<p>{text}</p>"] * 8 + [f"<p><b>{text}<br>", f"<blockquote>{text}</blockquote>", f"<h2>{phrase(1, 6)}</h2><p>{text}</p>", f"<ul><li>{text}</li><li>{sentence()}</li></ul>", f"<pre>{text}</pre>"]))
        return "".join(out)

    def linked(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{phrase(1, 4)}</a></li>' for _ in range(rng.randint(low, high))) + "</ul>"

    def comments() -> str:
        return "".join(rng.choice([f'<div class="comment"><span>{phrase(1, 2)}</span><p>{sentence()}</p></div>', f"<li><p>{sentence()} {sentence()}</p></li>", f"<p>{sentence()}</p>"]) for _ in range(rng.randint(1, 6)))

    def around() -> str:
        kind = rng.randrange(5)
        if kind == 0:
            return box(rng.choice(_MENUS), linked(2, 8))
        if kind == 1:
            return box(rng.choice(_SIDES), f"<h3>{phrase(1, 3)}</h3>" + rng.choice([linked(1, 6), f"<p>{sentence()}</p>"]))
        if kind == 2:
            return box(rng.choice(_NOTICES), rng.choice([sentence(), f"<p>{sentence()} {sentence()}</p>", f'<a href="/x">{phrase(2, 8)}</a>']))
        if kind == 3:
            return box(rng.choice(_FORMS), f"<label>{phrase(1, 3)}</label><button>{phrase(1, 2)}</button>")
        return box(rng.choice(_NOTICES), f"<p>{sentence()}</p>")

    if rng.random() < 0.6:
        page.append((box(rng.choice(_HEADERS), rng.choice([f"<h1>{phrase(1, 3)}</h1>", linked(2, 5), f'<a href="/">{phrase(1, 3)}</a>'])), 0))
    if rng.random() < 0.8:
        page.append((box(rng.choice(_MENUS), linked(2, 9)), 0))
    page += [(around(), 0) for _ in range(rng.randint(0, 3))]
    inside = [(f"<h1>{phrase(1, 10)}</h1>" if rng.random() < 0.8 else "", 1), (paragraphs(), 1)]
    if rng.random() < 0.3:
        inside += [(around(), 0), (paragraphs(), 1)]
    if rng.random() < 0.2:
        inside.append((box(rng.choice(_COMMENTS), comments()), 0))
    name = rng.choice(_CONTENT_BOXES)
    tag, _, mark = name.partition(".")
    opened = f'<{"div" if plain else tag} class="{mark}">' if mark and not plain else f"<{'div' if plain else tag}>"
    above, below = grid(), grid()
    page.append((above[0] + opened + below[0], 0))
    page += inside
    page.append((f"{below[1]}</{'div' if plain else tag}>{above[1]}", 0))
    if rng.random() < 0.4:
        page.append((box(rng.choice(_COMMENTS), comments()), 0))
    page += [(around(), 0) for _ in range(rng.randint(0, 3))]
    if rng.random() < 0.85:
        page.append((box(rng.choice(_FOOTERS), rng.choice([f"&copy; {phrase(1, 3)}", f"<p>&copy; {phrase(1, 3)} &middot; {sentence()}</p>", linked(2, 6)])), 0))
    # A label is carried through the parser by a sign before each text.
    marked = "".join(re.sub(r">([^<]+)", lambda m, y=y: f">{_SIGNS[y]}{m.group(1)}", f">{part}")[1:] for part, y in page)
    out = []
    for block in parse(f"<!DOCTYPE html><html><body>{marked}</body></html>"):
        label = int(_SIGNS[1] in block.text)
        block.text = _SPACE.sub(" ", block.text.replace(_SIGNS[0], "").replace(_SIGNS[1], "")).strip()
        if block.text:
            out.append((block, label))
    return out


def train(words: list[str], layouts: int = LAYOUTS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights fitted by Adam, one page a step."""
    rng = random.Random(0)
    words = words or ["word"]
    pages = [p for p in (_layout(rng, words) for _ in range(layouts)) if p]
    described = [(*describe([b for b, _ in page]), np.array([y for _, y in page], np.float32)) for page in pages]
    model = Labeller()
    m, v, step = np.zeros_like(model.flat), np.zeros_like(model.flat), 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        rng.shuffle(described)
        for page in described:
            step += 1
            gradient = np.clip(model.gradients(*page), -1, 1)
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient * gradient - v)
            model.flat -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model.flat


def _extractor(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(weights.copy())
        for batch in batches:
            texts = [""] * len(batch)
            column = batch.column("html")
            for low in range(0, len(batch), 256):
                pages = [(low + i, blocks) for i, p in enumerate(column.slice(low, 256).to_pylist()) if (blocks := parse(p))]
                pages.sort(key=lambda x: len(x[1]))
                at = 0
                while at < len(pages):
                    # Pages of the same number of blocks run side by side.
                    end = at
                    while end < len(pages) and len(pages[end][1]) == len(pages[at][1]):
                        end += 1
                    x = np.stack([model.inputs(*describe(blocks)) for _, blocks in pages[at:end]], axis=1)
                    content = model.scores(x) > 0
                    for j, (i, blocks) in enumerate(pages[at:end]):
                        texts[i] = " ".join(b.text for b, keep in zip(blocks, content[:, j].tolist()) if keep)
                    at = end
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url")), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of `pages` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rank = F.xxhash64("page_id")
    sample = rows.where("html IS NOT NULL").select("html", rank.alias("rank"), F.xxhash64("html").alias("tie")).orderBy("rank", "tie").limit(SAMPLE_PAGES)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        found = sorted({w for page in group["html"] for b in parse(page) for w in b.text.split()})
        return pd.DataFrame({"weights": [train(found).tobytes()]})

    model = written(sample.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "weights binary"), "labeller").first()
    weights = np.frombuffer(model["weights"], np.float32) if model else Labeller().flat
    return rows.mapInArrow(_extractor(weights), "page_id bigint, url string, text string")
