"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags, with character references decoded and white space as
single blanks.  Each block has a vector of its tag path (hashed tags, classes and ids), hashed words and shape.  A
bidirectional LSTM in numpy reads the page's whole sequence and labels each block as main text or not, so a block is
judged by all that stands before and behind it.  The main blocks joined by line ends are the text.

The labeller learns from at most ``TRAIN_PAGES`` pages, those with the smallest hash of page_id.  Their labels come
from the names of tags, classes and ids around a block; every page is also seen with notices, menus, sidebars, forms,
adverts and reader comments put in under other names and places, and with its article under other names.

A null or empty html, and one without main text, gives an empty text; a page cut off inside a tag, a reference or a
script is read as far as it goes; only script, style, textarea and title run to the end of the page without their end
tag, of other skipped elements the tag alone goes then; formulas are text; repeated rows come out each; a null page_id stays null; extra columns, whatever their names, are ignored; a block for which
both labels are equally likely is no main text; pages of one hash are learned from in the order of their html; an
empty table gives no rows.  The whole html is read, blocks are neither dropped nor cut for length.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages the labeller learns from, hidden units of one direction, hash buckets of paths and words, rounds of training.
TRAIN_PAGES, HIDDEN, PATH_BUCKETS, WORD_BUCKETS, ROUNDS = 160, 20, 96, 24, 8
SHAPE = 8
WIDTH = PATH_BUCKETS + WORD_BUCKETS + SHAPE
#: Blocks of one training or labelling batch, padding included.
BATCH_CELLS = 60_000

#: Tags that stay inside a block, tags without content, tags whose content is no text.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE |= set("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mpadded mphantom menclose merror mmultiscripts semantics".split())
RAW, SKIPPED = "script style textarea title", "noscript template svg iframe object select annotation-xml annotation"
#: Names of tags, and parts of classes and ids, that hold no main text, and those that do.
BOILER_TAGS = set("nav header footer aside form button menu dialog".split())
BOILER_NAMES = set(
    "ad ads advert advertisement sponsor promo banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget related share social "
    "cookie consent notice alert popup modal newsletter subscribe signup login form search comment comments reply discussion footer header masthead "
    "topbar bottom copyright legal pager pagination tags toolbar".split()
)
MAIN_TAGS = {"article", "main"}
MAIN_NAMES = set("article content post entry story main body-text article-body post-content entry-content".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW.replace(' ', '|')})(?=[\s/>]|\Z)[^>]*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    rf"|<(?P<skipped>{SKIPPED.replace(' ', '|')})(?=[\s/>]|\Z)[^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in SKIPPED.split()}
_CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Leaf:
    """A block: its open tags with their names from outside in, its text, and the part of it inside links."""

    path: tuple
    text: str
    linked: int


def leaves(page: str) -> list[Leaf]:
    """Blocks of a page in order."""
    out, path, parts, linked = [], [], [], 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            out.append(Leaf(tuple(path), text, linked))
        parts, linked = [], 0

    at, endless = 0, set()
    while found := _TOKEN.match(page, at):
        at = found.end()
        text, tag = found["text"], found["tag"]
        if text is not None:
            parts.append(text)
            linked += len(text) if any(t == "a" for t, _ in path) else 0
            continue
        if tag is None:
            if found["raw"]:
                flush()
            elif found["skipped"]:
                name = found["skipped"].lower()
                if not name.startswith("annotation"):
                    flush()
                if page[at - 2 : at] != "/>" and name not in endless:
                    end = _ENDS[name].search(page, at)
                    at = end.end() if end else at
                    endless |= set() if end else {name}
            continue
        tag = tag.lower()
        if tag == "head":  # its raw elements go by themselves; its end tag may be left out
            flush()
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if found["close"]:
            for i in range(len(path) - 1, -1, -1):
                if path[i][0] == tag:
                    del path[i:]
                    break
        elif tag not in VOID and not found["attrs"].endswith("/"):
            closes = _CLOSED_BY.get(tag, ())
            if path and path[-1][0] in closes:
                path.pop()
            names = tuple(n for m in _NAMES.findall(found["attrs"]) for n in re.split(r"[\s_]+", "".join(m).lower()) if n)
            path.append((tag, names))
    flush()
    return out


def _kinds(names: tuple) -> set:
    return set(names) | {x for n in names for x in n.split("-")}


def rule(leaf: Leaf) -> bool:
    """Label by the names around a block, to learn from: inside an article, and nearer to it than to anything else."""
    main = False
    for tag, names in leaf.path:
        kinds = _kinds(names)
        if tag in BOILER_TAGS or kinds & BOILER_NAMES:
            if not (main and tag == "header"):
                return False
        main = main or tag in MAIN_TAGS or bool(kinds & MAIN_NAMES)
    return main


def _bucket(text: str, n: int) -> int:
    return zlib.crc32(text.encode()) % n


def vectors(found: list[Leaf]) -> np.ndarray:
    """One row for each block."""
    out, paths, words = np.zeros((len(found), WIDTH), "f4"), {}, {}
    for i, leaf in enumerate(found):
        row = paths.get(leaf.path)
        if row is None:
            row = np.zeros(PATH_BUCKETS, "f4")
            for depth, (tag, names) in enumerate(leaf.path):
                if tag not in ("html", "body", "a", "b", "i", "em", "strong", "span"):
                    row[_bucket(tag, PATH_BUCKETS)] = 1
                for name in _kinds(names):
                    row[_bucket(f"name {name}", PATH_BUCKETS)] = 1
                if depth == len(leaf.path) - 1:
                    row[_bucket(f"last {tag}", PATH_BUCKETS)] = 1
            paths[leaf.path] = row
        out[i, :PATH_BUCKETS] = row
        listed = leaf.text.split()
        for word in listed:
            at = words.get(word)
            if at is None:
                at = words[word] = PATH_BUCKETS + _bucket(word.lower(), WORD_BUCKETS)
            out[i, at] += 1
        out[i, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] /= 2 * np.sqrt(len(listed))
        n = len(leaf.text)
        out[i, -SHAPE:] = (
            np.log1p(len(listed)) / 5, min(1.0, leaf.linked / n), sum(leaf.text.count(c) for c in ".,;:!?") / len(listed), len(leaf.path) / 10,
            i / len(found), 1.0 if i == 0 else 0.0, 1.0 if i == len(found) - 1 else 0.0, 1.0 if leaf.text.startswith(("©", "(c)")) else 0.0,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one for each direction, and a logistic output over both."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = draw.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype("f4")
            self.w[f"h{d}"] = draw.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)).astype("f4")
            self.w[f"b{d}"] = np.zeros(4 * HIDDEN, "f4")
            self.w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.w["o"] = draw.normal(0, 0.1, 2 * HIDDEN).astype("f4")
        self.w["ob"] = np.zeros(1, "f4")

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states (time x pages x units) of one direction; pages are padded behind their end."""
        steps, n, _ = x.shape
        inputs = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        h, c, out, kept = np.zeros((n, HIDDEN), "f4"), np.zeros((n, HIDDEN), "f4"), np.empty((steps, n, HIDDEN), "f4"), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = inputs[t] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            new = f * c + i * g
            bent = np.tanh(new)
            m = mask[t][:, None]
            kept.append((t, h, c, i, f, o, g, bent, m))
            h, c = m * (o * bent) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d)[0] for d in "fb"], 2)
        return both @ self.w["o"] + self.w["ob"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 2)
        error = (_sigmoid(both @ self.w["o"] + self.w["ob"]) - y) * mask / max(1.0, mask.sum())
        g = {"o": np.einsum("tn,tnh->h", error, both), "ob": np.array([error.sum()])}
        back = error[:, :, None] * self.w["o"]
        for k, d in enumerate("fb"):
            into = back[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            gates, gh = np.zeros((*x.shape[:2], 4 * HIDDEN), "f4"), np.zeros_like(self.w[f"h{d}"])
            dh, dc = np.zeros(into.shape[1:], "f4"), np.zeros(into.shape[1:], "f4")
            for t, h, c, i, f, o, u, bent, m in reversed(runs[d][1]):
                dh = dh + into[t]
                dnew = m * (dc + dh * o * (1 - bent**2))
                parts = (dnew * u * i * (1 - i), dnew * c * f * (1 - f), m * dh * bent * o * (1 - o), dnew * i * (1 - u**2))
                gates[t] = np.concatenate(parts, 1)
                gh += h.T @ gates[t]
                dh = gates[t] @ self.w[f"h{d}"].T + (1 - m) * dh
                dc = dnew * f + (1 - m) * dc
            g[f"x{d}"] = np.einsum("tnw,tng->wg", x, gates, optimize=True)
            g[f"h{d}"], g[f"b{d}"] = gh, gates.sum((0, 1))
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, rate: float = 0.01) -> Labeller:
        """Adam over batches of pages of like length, in an order drawn with a fixed seed."""
        draw, mean, square, n = np.random.default_rng(11), {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for _ in range(rounds):
            batches = list(_batches([len(x) for x, _ in pages], 16))
            for b in draw.permutation(len(batches)):
                x, mask = _padded([pages[i][0] for i in batches[b]])
                y = np.zeros(mask.shape, "f4")
                for j, i in enumerate(batches[b]):
                    y[: len(pages[i][1]), j] = pages[i][1]
                n += 1
                for k, g in self.gradients(x, mask, y).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g**2
                    step = mean[k] / (1 - 0.9**n) / (np.sqrt(square[k] / (1 - 0.99**n)) + 1e-8)
                    self.w[k] = (self.w[k] - rate * step).astype("f4")
        return self

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        out: list = [np.zeros(0, bool)] * len(pages)
        for chosen in _batches([len(x) for x in pages]):
            x, mask = _padded([pages[i] for i in chosen])
            found = self.logits(x, mask) > 0
            for j, i in enumerate(chosen):
                out[i] = found[: len(pages[i]), j]
        return out


def _batches(sizes: list[int], most: int = 512) -> Iterator[list[int]]:
    """Pages of like length together, so many that the padded batch stays small; a longer page is a batch of its own."""
    batch: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        if not sizes[i]:
            continue
        if batch and (len(batch) >= most or sizes[i] * (len(batch) + 1) > BATCH_CELLS):
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), "f4"), np.zeros((steps, len(pages)), "f4")
    for j, page in enumerate(pages):
        x[: len(page), j], mask[: len(page), j] = page, 1
    return x, mask


# --- Training pages ---------------------------------------------------------

_BOILER_SHAPES = [
    (("aside", ("sidebar",)), "p"), (("div", ("sidebar",)), "p"), (("div", ("cookie-notice",)), "p"), (("div", ("notice",)), "p"), (("div", ("alert",)), None),
    (("form", ()), "label"), (("form", ("newsletter",)), "p"), (("div", ("subscribe",)), "p"), (("header", ()), "p"), (("header", ("masthead",)), "h1"),
    (("div", ("menu",)), "li"), (("ul", ("menu",)), "li"), (("nav", ()), "a"), (("div", ("breadcrumbs",)), "a"), (("div", ("ad",)), None), (("div", ("advert",)), "p"),
    (("div", ("ads",)), "p"), (("aside", ()), "p"), (("section", ("related",)), "li"), (("div", ("social",)), "a"), (("div", ("share",)), "a"), (("footer", ()), "p"),
    (("div", ("footer",)), "p"), (("div", ("popup",)), "p"), (("div", ("banner",)), "p"),
]
_COMMENT_SHAPES = [
    (("section", ("comments",)), ("div", ("comment",))), (("div", ("comments",)), ("p", ())), (("div", ("discussion",)), ("div", ("reply",))),
    (("ol", ("comment-list",)), ("li", ("comment",))), (("section", ()), ("article", ("comment",))),
]
_MAIN_SHAPES = [("article", ()), ("main", ()), ("div", ("content",)), ("div", ("post",)), ("div", ("entry-content",)), ("div", ("article-body",)), ("article", ("post",))]


def _varied(found: list[Leaf], labels: np.ndarray, others: list[Leaf], draw: np.random.Generator) -> tuple[list[Leaf], np.ndarray]:
    """The page under other names, with other parts put in."""
    body = (("html", ()), ("body", ()))
    main = _MAIN_SHAPES[draw.integers(len(_MAIN_SHAPES))]
    out: list[tuple[Leaf, bool]] = []
    text = lambda: others[draw.integers(len(others))].text
    pick = lambda shapes: shapes[draw.integers(len(shapes))]

    def part(inside: tuple = ()) -> None:
        shape, child = pick(_BOILER_SHAPES)
        path = body + inside + (shape,) + (((child, ()),) if child else ())
        for _ in range(draw.integers(1, 5)):
            words = text().split()
            short = " ".join(words[: draw.integers(1, 12)]) if draw.random() < 0.7 else " ".join(words)
            out.append((Leaf(path, short, len(short) if child in ("a", "li") else 0), False))

    for i, (leaf, label) in enumerate(zip(found, labels, strict=True)):
        if draw.random() < (0.5 if i in (0, len(found) - 1) else 0.06):
            part((main,) if label and draw.random() < 0.5 else ())
        if label:
            path = tuple(main if t in MAIN_TAGS else (t, n) for t, n in leaf.path)
            leaf = Leaf(path, leaf.text, leaf.linked)
        out.append((leaf, bool(label)))
    if draw.random() < 0.5:
        shape, child = pick(_COMMENT_SHAPES)
        inside = (main,) if draw.random() < 0.3 else ()
        end = max((i for i, (_, label) in enumerate(out) if label), default=len(out) - 1) + 1
        made = [(Leaf(body + inside + (shape, child), text(), 0), False) for _ in range(draw.integers(1, 8))]
        out[end:end] = made
    if draw.random() < 0.5:
        part()
    return [x for x, _ in out], np.array([y for _, y in out], "f4")


def trained(pages: DataFrame, key: str = "page_id", html: str = "html") -> Labeller | None:
    """The labeller, learned from a bounded number of pages; None if there are no pages with blocks."""
    rows = pages.where(F.col(html).isNotNull()).select(F.xxhash64(key, html).alias("h"), F.col(html).alias("html"))
    n = max(1, rows.count())
    # a share by hash, about twice as large as needed, then the smallest hashes
    bound = min(1.0, 2 * TRAIN_PAGES / n + 20 / n) * 2.0**64 - 2.0**63
    sample = rows.where(F.col("h").cast("double") <= bound).collect()
    found = [leaves(r.html) for r in sorted(sample, key=lambda r: (r.h, r.html))[:TRAIN_PAGES]]
    found = [f for f in found if f]
    others = [x for f in found for x in f]
    if not others:
        return None
    draw, examples = np.random.default_rng(5), []
    for f in found:
        labels = np.array([rule(x) for x in f], "f4")
        examples.append((vectors(f), labels))
        for _ in range(3):
            g, y = _varied(f, labels, others, draw)
            examples.append((vectors(g), y))
    return Labeller().fit(examples)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    labeller = trained(pages, key, html)

    def extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 500):
                part = frame.iloc[a : a + 500]
                found = [leaves(h or "") for h in part.html]
                labels = labeller.labels([vectors(f) for f in found]) if labeller else [[] for _ in found]
                texts = ["\n".join(x.text for x, main in zip(f, y, strict=False) if main) for f, y in zip(found, labels, strict=True)]
                yield pd.DataFrame({"page_id": part.page_id, "url": part.url, "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(key).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    out = rows.mapInPandas(extracted, "page_id string, url string, text string, n_chars bigint")
    return out.withColumn("page_id", F.col("page_id").cast("bigint"))
