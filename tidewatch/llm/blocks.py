"""Main text of web pages: a recurrent network labels every block, seeing the whole page.

The parser cuts a page into leaf blocks: runs of text between block-level tags or line breaks, each with
the path of open elements (names, and the words of their class, id and role). Scripts, styles, drawings, frames,
templates, comments and markup never become text; formulas and fallback texts (object, noscript) do. A block's input are hashed counts of its path, of its
words, and a few measures (length, share of link text, place in the page). A bidirectional LSTM in numpy reads the
sequence, so each label depends on all blocks of the page.

It is fitted on ``TRAIN_PAGES`` pages (those with the least hash of url and html, whatever the table's size), labelled by
their own markup: what lies in an article or main element and in no element that is named for menus, notices and
the like is main text. As markup differs between sites, every training page is also shown with
other container names, and with added blocks in containers that the page does not have. All other steps
are one narrow pass over all pages; pages are padded to the longest of a small group of similar length.

Pages are read in time that grows with their length alone, also broken ones and very deep ones: text that only looks like
tags stays text.

Null or empty html has no blocks and an empty text, as has a page without any main block. Null urls stay
null, repeated rows are repeated, other columns are not read. Without any labelled page the
markup rule itself decides.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

TRAIN_PAGES = 400
VARIANTS = 3
EPOCHS = 6
PATH_SIZE, WORD_SIZE, MEASURES = 96, 32, 6
HIDDEN = 24
GROUP, STEPS = 64, 20_000
SEED = 7

# Elements of HTML that hold no content, and those that start a line of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol "
    "optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
# Dropped up to their end tag: the first also up to the page's end without one, the others only where they have one.
RAW = ("script", "style")
CLOSED = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("svg", "iframe", "template")}
# Elements that "/>" closes.
FOREIGN = ("svg", "math")
RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}
NAME_END, SPECIAL = re.compile(r"[\s/>]"), re.compile("[\"'>]")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PART = re.compile(r"[a-z]+")
WORD = re.compile(r"\w+")

MAIN = ("article", "main")
# Words in names of elements that hold no main text.
OTHER = frozenset(
    "nav menu header footer aside sidebar ad ads advert advertisement banner sponsor promo notice cookie consent "
    "alert popup form search login signup subscribe newsletter comment comments reply respond discussion share social "
    "related recommended breadcrumb breadcrumbs pagination pager widget navigation complementary contentinfo".split()
)


@lru_cache(maxsize=10_000)
def marks_of(words: tuple[str, ...]) -> tuple[int, bool, bool]:
    """Slots of the words in the network's input, and whether they name main text or other parts."""
    slots = 0
    for w in words:
        slots |= 1 << zlib.crc32(w.encode()) % PATH_SIZE
    return slots, any(w in MAIN for w in words), any(w.lstrip(".") in OTHER for w in words)


class Path:
    """Open block elements with the words of their names: a step at a time, so that deep pages stay linear."""

    __slots__ = ("above", "words", "size", "slots", "main", "other")

    def __init__(self, above: Path | None, words: tuple[str, ...]):
        self.above, self.words = above, words
        slots, main, other = marks_of(words)
        self.size = len(words) + (above.size if above else 0)
        self.slots = slots | (above.slots if above else 0)
        self.main = main or above is not None and above.main
        self.other = other or above is not None and above.other


class Block:
    __slots__ = ("steps", "text", "link")

    def __init__(self, path: Path | tuple[str, ...], text: str, link: float):
        self.steps = path if isinstance(path, Path) else Path(None, path)
        self.text, self.link = text, link

    @property
    def path(self) -> tuple[str, ...]:
        words, step = [], self.steps
        while step is not None:
            words.append(step.words)
            step = step.above
        return tuple(w for part in words[::-1] for w in part)


class Scanner:
    """Tags of a page from left to right, in time that grows with the page alone.

    What a tag's end depends on is remembered: where the next quote, ``>`` or end of a name is, and whether quotes that open at a
    place lead to a ``>`` at all. So text that looks like a thousand unfinished tags is read once, not once for each.
    """

    def __init__(self, page: str):
        self.page = page
        #: Where the search for the next tag goes on; may be moved forward.
        self.at = 0
        self.next: dict[re.Pattern, tuple[int, int]] = {}
        self.ends: dict[int, int] = {}

    def find(self, what: re.Pattern, at: int) -> int:
        """The first place of a character from ``at`` on, -1 if none; ``at`` mostly rises."""
        asked, found = self.next.get(what, (1, 0))
        if not asked <= at or 0 <= found < at:
            m = what.search(self.page, at)
            asked, found = at, m.start() if m else -1
            self.next[what] = asked, found
        return found

    def tag_end(self, at: int) -> int:
        """Where the ``>`` stands that ends a tag, in no quotes; -1 if there is none."""
        place, seen = self.find(SPECIAL, at), []
        while True:
            if place < 0 or self.page[place] == ">":
                end = place
                break
            if place in self.ends:
                end = self.ends[place]
                break
            seen.append(place)
            closed = self.page.find(self.page[place], place + 1)
            m = SPECIAL.search(self.page, closed + 1) if closed >= 0 else None
            place = m.start() if m else -1
        for quote in seen:
            self.ends[quote] = end
        return end

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether an end tag, the rest of the tag); the name is empty for what is no element."""
        page = self.page
        gone = False  # no ">" is left
        while (start := page.find("<", self.at)) >= 0:
            at = self.at = start + 1
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                self.at = len(page) if end < 0 else end + 3
                yield start, self.at, "", False, ""
                continue
            closing = page.startswith("/", at)
            first = at + closing
            if first < len(page) and page[first].isascii() and page[first].isalpha() and not gone:
                stop = self.find(NAME_END, first)
                if stop < 0:
                    # Neither white space nor ">" follows any more.
                    gone = True
                    continue
                end = self.tag_end(stop)
                if end < 0 and 0 <= (quote := self.find(SPECIAL, first)) < stop:
                    # Quotes inside a name belong to it, unless that leaves the tag without an end.
                    end, stop = self.tag_end(quote), quote
                if end >= 0:
                    name = page[first:stop].lower()
                    self.at = end + 1
                    if name in RAW and not closing:
                        m = RAW_END[name].search(page, self.at)
                        self.at = m.end() if m else len(page)
                    yield start, self.at, name, closing, page[stop:end]
                    continue
            if page[at : at + 1] in ("!", "?", "/") and not gone:
                end = page.find(">", at + 1)
                if end < 0:
                    gone = True
                    continue
                self.at = end + 1
                yield start, self.at, "", False, ""


def parse(page: str) -> list[Block]:
    """The leaf blocks of a page in order, in time that grows with the page alone."""
    out: list[Block] = []
    # Open elements, each with the path that it leads to, and how many of a name are open: block elements in the
    # whole page, others since the last block element.
    stack: list[tuple[str, Path | None]] = []
    blocks: Counter = Counter()
    inner: list[Counter] = [Counter()]
    parts: list[str] = []
    linked = [0, 0]
    anchors = 0

    def add(text: str) -> None:
        if text:
            parts.append(text)
            linked[anchors > 0] += len(text)

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            here = stack[-1][1] if stack else None
            out.append(Block(here or Path(None, ()), text, linked[1] / max(1, sum(linked))))
        parts.clear()
        linked[:] = [0, 0]

    def pop() -> str:
        nonlocal anchors
        name = stack.pop()[0]
        anchors -= name == "a"
        if name in BLOCK:
            blocks[name] -= 1
            inner.pop()
        else:
            inner[-1][name] -= 1
        return name

    def close(name: str) -> None:
        # An end tag does not reach out of the block that holds it.
        if (blocks if name in BLOCK else inner[-1])[name] > 0:
            while pop() != name:
                pass

    at, open_ended, scanner = 0, set(), Scanner(page)
    for start, end, name, closing, rest in scanner.tags():
        add(page[at:start])
        at = end
        if not name:
            continue
        if name in BLOCK or name == "br":
            flush()
        if name in RAW and not closing or name in FOREIGN and not closing and rest.endswith("/"):
            continue
        if name in CLOSED and not closing and name not in open_ended:
            found = CLOSED[name].search(page, at)
            if found is not None:
                at = scanner.at = found.end()
                continue
            # Nor has any later one an end.
            open_ended.add(name)
        if closing:
            close(name)
        elif name not in VOID:
            words = ()
            if name in BLOCK:
                while stack and stack[-1][0] not in BLOCK:
                    pop()
                if stack and (
                    stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")
                ):
                    pop()
                names = NAMES.findall(rest)
                words = tuple(f".{w}" for n in names for w in PART.findall(n.lower()))
            here = stack[-1][1] if stack else None
            if name in BLOCK:
                here = Path(here, (name, *words))
                blocks[name] += 1
                inner.append(Counter())
            else:
                inner[-1][name] += 1
            anchors += name == "a"
            stack.append((name, here))
    add(page[at:])
    flush()
    return out


def by_markup(path: Path) -> bool:
    return path.main and not path.other


class Features:
    """Rows of the network's input."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def slot(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > 200_000:
                self.words.clear()
            got = self.words[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_SIZE
        return got

    def of(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + MEASURES), np.float32)
        for i, b in enumerate(blocks):
            slots = np.frombuffer(b.steps.slots.to_bytes(PATH_SIZE // 8, "little"), np.uint8)
            out[i, :PATH_SIZE] = np.unpackbits(slots, bitorder="little")
            words = WORD.findall(b.text.lower())
            counts = np.bincount([self.slot(w) for w in words], minlength=WORD_SIZE) if words else np.zeros(WORD_SIZE)
            out[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = counts / max(1, len(words))
            size = len(b.text)
            out[i, -MEASURES:] = (
                np.log1p(size) / 8, b.link, i / len(blocks), len(words) / (size + 1), b.steps.size / 8,
                sum(b.text.count(c) for c in ".,;:!?") / (len(words) + 1),
            )
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """Two LSTMs, one per direction, and a logistic output; all arrays are float32."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, size**-0.5, (size, 4 * hidden))
            self.p[f"h{d}"] = r.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            self.p[f"b{d}"] = np.repeat([1.0, 0.0, 0.0, 0.0], hidden)  # gates: forget, input, output, new
        self.p["o"] = r.normal(0, hidden**-0.5, 2 * hidden)
        self.p["c"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _forward(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h = c = np.zeros((n, self.h), np.float32)
        out, tape = np.zeros((n, steps, self.h), np.float32), []
        inputs = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[:, t] + h @ self.p[f"h{d}"]
            gates = sigmoid(z[:, : 3 * self.h])
            f, i, o = (gates[:, k * self.h : (k + 1) * self.h] for k in range(3))
            g = np.tanh(z[:, 3 * self.h :])
            m = mask[:, t, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                tape.append((t, h, c, f, i, o, g, tc, m))
            # Padding keeps the state, so that the backward pass starts at the last block.
            c, h = np.where(m, new, c), np.where(m, o * tc, h)
            out[:, t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        a, tape_a = self._forward(x, mask, "f", keep)
        b, tape_b = self._forward(x, mask, "b", keep)
        both = np.concatenate([a, b], axis=2)
        return sigmoid(both @ self.p["o"] + self.p["c"]), both, tape_a, tape_b

    def _backward(self, x: np.ndarray, up: np.ndarray, tape: list, d: str, grads: dict) -> None:
        dh = dc = np.zeros((len(x), self.h), np.float32)
        dz_all = np.zeros((*x.shape[:2], 4 * self.h), np.float32)
        for t, h, c, f, i, o, g, tc, m in reversed(tape):
            dh = dh + up[:, t]
            through_h, through_c = np.where(m, 0, dh), np.where(m, 0, dc)
            dh, dc = np.where(m, dh, 0), np.where(m, dc, 0)
            dn = dc + dh * o * (1 - tc**2)
            dz = np.concatenate([dn * c * f * (1 - f), dn * g * i * (1 - i), dh * tc * o * (1 - o), dn * i * (1 - g**2)], axis=1)
            dz_all[:, t] = dz
            grads[f"h{d}"] += h.T @ dz
            dh, dc = dz @ self.p[f"h{d}"].T + through_h, dn * f + through_c
        grads[f"x{d}"] += np.einsum("nti,ntj->ij", x, dz_all, optimize=True)
        grads[f"b{d}"] += dz_all.sum(axis=(0, 1))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all blocks, and its gradients."""
        p, both, tape_a, tape_b = self.forward(x, mask, True)
        total = mask.sum()
        loss = -(np.where(y, np.log(p + 1e-7), np.log(1 - p + 1e-7)) * mask).sum() / total
        dp = ((p - y) * mask / total).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["o"] = np.einsum("nt,ntk->k", dp, both)
        grads["c"] = np.array([dp.sum()], np.float32)
        up = dp[:, :, None] * self.p["o"]
        self._backward(x, up[:, :, : self.h], tape_a, "f", grads)
        self._backward(x, up[:, :, self.h :], tape_b, "b", grads)
        return float(loss), grads

    def train(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float = 0.01, seed: int = SEED) -> None:
        """Adam over groups of sequences of similar length."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][0]))
        groups = [order[i : i + 32] for i in range(0, len(order), 32)]
        step = 0
        for _ in range(epochs):
            for g in r.permutation(len(groups)):
                x, mask, y = padded([sequences[i] for i in groups[g]])
                step += 1
                _, grads = self.gradients(x, mask, y)
                for k, v in grads.items():
                    v = np.clip(v, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    a, b = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                    self.p[k] = (self.p[k] - rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)


def padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x, _ in sequences)
    x = np.zeros((len(sequences), steps, sequences[0][0].shape[1]), np.float32)
    mask, y = np.zeros(x.shape[:2], bool), np.zeros(x.shape[:2], bool)
    for i, (a, b) in enumerate(sequences):
        x[i, : len(a)], mask[i, : len(a)], y[i, : len(a)] = a, True, b
    return x, mask, y


# Containers that training pages are shown with instead of their own: for main text and for all else.
MAIN_PATHS = [
    ("article",), ("main",), ("div", ".content"), ("section", ".post"), ("div", ".entry", ".content"), ("main", "article"),
    ("div", ".article", ".body"), ("section",), ("div", ".story"), ("article", "section"), ("div", ".main"), ("article", "div"),
]
OTHER_PATHS = [
    ("nav",), ("div", ".menu"), ("header",), ("header", "nav", "ul"), ("footer",), ("div", ".footer"), ("aside",),
    ("div", ".sidebar"), ("div", ".ad"), ("div", ".advert"), ("div", ".banner"), ("div", ".notice"), ("div", ".cookie"),
    ("div", ".cookie", ".notice"), ("form",), ("form", "fieldset"), ("div", ".search"), ("section", ".comments"),
    ("div", ".comments"), ("div", ".comment"), ("ol", ".comment", ".list", "li"), ("div", ".related"), ("div", ".share"),
    ("ul", ".breadcrumb"), ("div", ".newsletter"), ("section", ".related"), ("div", ".promo"), ("article", ".comment"),
    ("form", "label"), ("form", "select", "option"), ("form", "textarea"), ("div", ".alert"), ("div", ".popup"),
    ("div", ".reader", ".comments"), ("details", ".notice"), ("div", ".social"), ("div", ".subscribe"), ("dialog",),
]


def shown_otherwise(blocks: list[Block], labels: list[bool], r: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A page with other containers, and with blocks of other kinds put in between."""
    main = MAIN_PATHS[r.integers(len(MAIN_PATHS))]
    out, marks = [], []
    texts = [b.text for b in blocks]

    def extra(inside: bool) -> None:
        path = OTHER_PATHS[r.integers(len(OTHER_PATHS))]
        tail = [("p",), (), ("div",), ("ul", "li")][r.integers(4)]
        front = ("html", "body", *main) if inside else ("html", "body")
        link = float(r.random() < 0.4)
        for _ in range(r.integers(1, 5)):
            out.append(Block((*front, *path, *tail), texts[r.integers(len(texts))], link))
            marks.append(False)

    for i, (b, mark) in enumerate(zip(blocks, labels, strict=True)):
        if r.random() < 0.12:
            extra(inside=mark and i > 0 and labels[i - 1])
        if mark:
            tail = tuple(p for p in b.path if p not in ("html", "body", *MAIN))
            out.append(Block(("html", "body", *main, *tail), b.text, b.link))
        elif b.path[-1:] == ("title",) or r.random() < 0.3:
            out.append(b)
        else:
            out.append(Block(("html", "body", *OTHER_PATHS[r.integers(len(OTHER_PATHS))], *b.path[-1:]), b.text, b.link))
        marks.append(mark)
    if r.random() < 0.5:
        extra(inside=r.random() < 0.4)
    return out, marks


def fit(pages: DataFrame, url: str = "url", page: str = "html", most: int = TRAIN_PAGES) -> Lstm | None:
    """The network, fitted on ``most`` pages."""
    asked = pages.where(F.col(page).isNotNull()).select(F.col(page).alias("p"), F.xxhash64(url, page).alias("k"))
    with common.tidy(pages.sparkSession):
        # The cut among the hashes first, so that no more pages than asked for travel; equal pages count once.
        last = asked.select("k").distinct().orderBy("k").limit(most).agg(F.max("k")).first()[0]
        chosen = asked.where(F.col("k") <= F.lit(last)).groupBy("k").agg(F.first("p").alias("p"))
        rows = [r.p for r in chosen.collect()] if last is not None else []
        rows.sort()
    features, r, sequences = Features(), np.random.default_rng(SEED), []
    for row in dict.fromkeys(rows):
        blocks = parse(row)
        labels = [by_markup(b.steps) for b in blocks]
        if any(labels) and not all(labels):
            shown = [(blocks, labels), *(shown_otherwise(blocks, labels, r) for _ in range(VARIANTS))]
            sequences += [(features.of(b), np.array(m)) for b, m in shown]
    if not sequences:
        return None
    network = Lstm(PATH_SIZE + WORD_SIZE + MEASURES)
    network.train(sequences, EPOCHS)
    return network


class Extractor:
    def __init__(self, network: Lstm | None):
        self.network, self.features = network, Features()

    def texts(self, pages: list[str | None]) -> list[str]:
        blocks = [parse(p) if p else [] for p in pages]
        out = [""] * len(pages)
        order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
        at = 0
        while at < len(order):
            # Pages in rising length: as many as GROUP, and no more steps than GROUP pages of usual length.
            upto = at + 1
            while upto < min(at + GROUP, len(order)) and (upto + 1 - at) * len(blocks[order[upto]]) <= STEPS:
                upto += 1
            group, at = order[at:upto], upto
            if self.network is None:
                marks = [[by_markup(b.steps) for b in blocks[i]] for i in group]
            else:
                inputs = [self.features.of(blocks[i]) for i in group]
                x, mask, _ = padded([(a, np.zeros(len(a), bool)) for a in inputs])
                marks = (self.network.forward(x, mask)[0] > 0.5).tolist()
            for i, mark in zip(group, marks, strict=True):
                out[i] = " ".join(b.text for b, m in zip(blocks[i], mark, strict=False) if m)
        return out


def main_text(
    pages: DataFrame, network: Lstm | None, page_id: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """Per page: its id, url, main text and the text's length."""
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(network)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = extractor.texts(part.column(2).to_pylist())
                arrays = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "url", "text", "n_chars"])

    asked = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("p"))
    out = asked.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.toDF(page_id, url, "text", "n_chars")


def op7_blocks(spark: SparkSession, folder: str) -> DataFrame:
    pages = common.table(spark, folder, "pages")
    return main_text(pages, fit(pages))
