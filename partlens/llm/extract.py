"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks of text, each with the path of tags that holds it.  A
bidirectional LSTM (numpy) reads the sequence of blocks, each as a hashed vector of
its path, a hashed vector of its words and a few measures, and labels every block
as article or not, so a block is judged in the context of the whole page.

There are no labelled pages, so the labeller learns from two bounded sources: pages
of the table whose own markup names its parts (``article``, ``nav``, ...), and layouts
put together here from common names of page parts, filled with words of those pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.llm.token_counts import Remembered, _bounded

# Elements by their place in the text, and common names of page parts.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is raw up to the end tag, and others that show no text of their own.
RAW = "script|style|title"
SILENT = set("template svg math iframe object noscript noframes canvas audio video".split())
CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
ARTICLE_PARTS = ["article", "main", "article.post", "div.content", "div.article-body", "div#main", "div.entry-content", "section.story", "div.post", "div.main-content", "main.page"]
OTHER_PARTS = [
    "nav", "header", "footer", "aside", "form", "div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.sidebar", "div.side", "div.widget", "div.menu", "ul.menu",
    "div.navbar", "div.navigation", "div.breadcrumbs", "div.header", "div#header", "div.top-bar", "div.footer", "div#footer", "div.legal", "div.copyright", "div.cookie", "div.cookie-notice",
    "div.consent", "div.notice", "div.banner", "div.popup", "div.modal", "div.newsletter", "div.subscribe", "form.search", "form.login", "div.share", "div.social", "div.related", "div.promo",
    "section.comments", "div.comments", "div#comments", "div.comment", "ol.comment-list", "div.comment-body", "section.reviews", "div.login", "div.pagination", "div.tags", "section.related",
]
#: Parts that stand inside an article and yet are not its text.
INSERTED = ["aside", "div.ad", "div.related", "div.share", "form", "section.comments", "div.comments", "div.newsletter", "nav", "div.advert", "div.social", "footer"]

PATH_SIZE, WORD_SIZE, EXTRA, HIDDEN = 96, 32, 5, 24
#: Pages that may be learned from (none longer than LEARNED_CHARS), layouts put together, passes over them.
LEARNED_PAGES, LEARNED_CHARS, LAYOUTS, PASSES, PAGES_AT_ONCE = 300, 60_000, 900, 14, 32

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?:/?[a-zA-Z]|[!?])[^>]*(?:>|\Z)", re.S | re.I
)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


def _closed(tokens: list[re.Match]) -> dict[int, int]:
    """The place of the end tag of each silent element that has one; an element ends at the nearest end tag of its name not taken by one inside it."""
    opened: dict[str, list[int]] = {}
    ends = {}
    for i, token in enumerate(tokens):
        tag = (token[3] or "").lower()
        if tag not in SILENT:
            continue
        if not token[2]:
            if tag not in ("svg", "math") or not (token[4] or "").endswith("/"):
                opened.setdefault(tag, []).append(i)
        elif opened.get(tag):
            ends[opened[tag].pop()] = i
    return ends


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters in links) of each block of a page, in order; the path holds tags and the words of their names."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    page = page or ""

    def say(text: str) -> None:
        nonlocal linked
        if text:
            plain = entities.unescape(text) if "&" in text else text
            parts.append(plain)
            if any(tag == "a" for tag, _ in stack):
                linked += len(plain.strip())

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((tuple(w for tag, names in stack if tag not in INLINE for w in (tag, *names)), text, linked))
            parts.clear()
        linked = 0

    at, until = 0, -1
    tokens = list(_TOKEN.finditer(page))
    ends = _closed(tokens)
    for place, token in enumerate(tokens):
        if place > until:
            say(page[at : token.start()])
        at = token.end()
        tag = (token[3] or "").lower()
        if not tag or place <= until:
            continue
        if tag in SILENT:
            # One that is self-closed, or has no end tag, hides nothing.
            until = ends.get(place, until)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            end()
        if token[2]:
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if where is not None:
                if any(t not in INLINE for t, _ in stack[where:]):
                    end()
                del stack[where:]
            continue
        if tag in VOID or (token[4] or "").endswith("/"):
            continue
        if tag not in INLINE:
            # A paragraph ends where a block begins, as do a list entry or a cell where the next one does.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in (tag, CLOSES.get(tag)) and tag in CLOSES:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        names = tuple(w for m in _NAMES.finditer(token[4] or "") for w in _WORDS.findall(m[1].lower()))
        stack.append((tag, names))
    say(page[at:])
    end()
    return out


def _bucket(word: str) -> int:
    return crc32(word.encode())


_path_of = Remembered(lambda w: (_bucket("p:" + w) % PATH_SIZE, 1 if _bucket("s:" + w) & 1 else -1), 20_000)
_word_of = Remembered(lambda w: _bucket(w) % (2 * WORD_SIZE), 100_000)


def vectors(found: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    """The blocks of a page as rows: path, words, measures."""
    x = np.zeros((len(found), PATH_SIZE + WORD_SIZE + EXTRA), np.float32)
    for i, (path, text, linked) in enumerate(found):
        for word in path:
            k, sign = _path_of[word]
            x[i, k] += sign
        words = text.split()
        hashed = np.bincount(list(map(_word_of.__getitem__, words)), minlength=2 * WORD_SIZE)
        x[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = (hashed[:WORD_SIZE] - hashed[WORD_SIZE:]) / len(words)
        x[i, -EXTRA:] = (np.log1p(len(words)) / 5, linked / len(text), text[-1] in ".!?", i / len(found), (len(found) - i) / len(found))
    return x


class Labeller:
    """A bidirectional LSTM with one output for each block."""

    def __init__(self, size: int = PATH_SIZE + WORD_SIZE + EXTRA, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w: dict[str, np.ndarray] = {}
        for way in ("f", "b"):
            self.w[f"x{way}"] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * hidden))
            self.w[f"h{way}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1
            self.w[f"c{way}"] = bias
        self.w["out"], self.w["off"] = rng.normal(0, 0.3, (2 * hidden, 1)), np.zeros(1)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, there: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Hidden states over padded sequences (pages, steps, size); places that are not there hand the state on."""
        n, steps, _ = x.shape
        k = self.hidden
        pre = x @ self.w[f"x{way}"] + self.w[f"c{way}"]
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        states, kept = np.zeros((n, steps, k), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.w[f"h{way}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * k]))
            i, f, o, g = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(z[:, 3 * k :])
            new = f * c + i * g
            squashed = np.tanh(new)
            on = there[:, t, None]
            kept.append((t, h, c, i, f, o, g, squashed, on))
            h, c = np.where(on, o * squashed, h), np.where(on, new, c)
            states[:, t] = h
        return states, kept

    def scores(self, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, there, way)[0] for way in ("f", "b")], axis=2)
        return (both @ self.w["out"])[..., 0] + self.w["off"]

    def _back(self, x: np.ndarray, kept: list, grown: np.ndarray, way: str, into: dict[str, np.ndarray]) -> None:
        k = self.hidden
        dh, dc = np.zeros_like(kept[0][1]), np.zeros_like(kept[0][1])
        dz_all = np.zeros((*x.shape[:2], 4 * k), np.float32)
        for t, h, c, i, f, o, g, squashed, on in reversed(kept):
            dh = dh + grown[:, t]
            own = np.where(on, dh, 0)
            dnew = np.where(on, dc, 0) + own * o * (1 - squashed**2)
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), own * squashed * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
            dz_all[:, t] = dz
            into[f"h{way}"] += h.T @ dz
            dh = np.where(on, 0, dh) + dz @ self.w[f"h{way}"].T
            dc = np.where(on, dnew * f, dc)
        into[f"x{way}"] += np.tensordot(x, dz_all, ((0, 1), (0, 1)))
        into[f"c{way}"] += dz_all.sum((0, 1))

    def learn(self, pages: list[tuple[np.ndarray, np.ndarray]], passes: int = PASSES, rate: float = 0.01, seed: int = 5) -> Labeller:
        """Cross-entropy over all blocks, by Adam over batches of pages of like length."""
        rng = np.random.default_rng(seed)
        pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
        groups = [pages[i : i + PAGES_AT_ONCE] for i in range(0, len(pages), PAGES_AT_ONCE)]
        mean, var, step = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(3))
        step = 0
        for _ in range(passes):
            for at in rng.permutation(len(groups)):
                x, there, y = padded(groups[at])
                grad = {k: np.zeros_like(v) for k, v in self.w.items()}
                runs = {way: self._run(x, there, way) for way in ("f", "b")}
                both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
                score = (both @ self.w["out"])[..., 0] + self.w["off"]
                error = np.where(there, 1 / (1 + np.exp(-score)) - y, 0).astype(np.float32) / there.sum()
                grad["out"] += np.tensordot(both, error, ((0, 1), (0, 1)))[:, None]
                grad["off"] += error.sum()
                grown = error[..., None] * self.w["out"][:, 0]
                for way, part in (("f", grown[..., : self.hidden]), ("b", grown[..., self.hidden :])):
                    self._back(x, runs[way][1], part, way, grad)
                step += 1
                for k, g in grad.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    var[k] = 0.999 * var[k] + 0.001 * g * g
                    self.w[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, whether each block is article text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        for at in range(0, len(order), PAGES_AT_ONCE):
            part = order[at : at + PAGES_AT_ONCE]
            x, there, _ = padded([(pages[i], np.zeros(len(pages[i]))) for i in part])
            score = self.scores(x, there)
            for row, i in enumerate(part):
                out[i] = score[row, : len(pages[i])] > 0
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(y) for _, y in pages)
    x = np.zeros((len(pages), steps, pages[0][0].shape[1]), np.float32)
    there, wanted = np.zeros((len(pages), steps), bool), np.zeros((len(pages), steps), np.float32)
    for row, (v, y) in enumerate(pages):
        x[row, : len(y)], there[row, : len(y)], wanted[row, : len(y)] = v, True, y
    return x, there, wanted


_OTHER_WORDS = {w for p in OTHER_PARTS for w in re.split(r"[.#-]", p)} - {"div", "section", "ul", "ol", "body", "list", "top", "bar", "side"}


def named_by_markup(found: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray | None:
    """Labels of a page whose markup has an ``article`` or ``main``: what is inside and in no part of another kind; else None."""
    inside = np.array([("article" in path or "main" in path) and not _OTHER_WORDS.intersection(path) for path, _, _ in found], bool)
    return inside if inside.any() else None


def layout(rng: np.random.Generator, words: list[str]) -> tuple[str, list[bool]]:
    """A page put together from common parts, and for each of its blocks whether it is article text."""
    labels: list[bool] = []

    def text(least: int, most: int) -> str:
        said = " ".join(words[int(i)] for i in rng.integers(0, len(words), int(rng.integers(least, most))))
        return said.capitalize() + "." * int(rng.random() < 0.8)

    def opened(part: str, inner: str) -> str:
        tag, kind, name = re.match(r"(\w+)([.#]?)(.*)", part).groups()
        mark = f' {"id" if kind == "#" else "class"}="{name}"' if kind else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    def paragraph(main: bool, most: int) -> str:
        tag = str(rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote", "div"])) if main else str(rng.choice(["p", "div", "li", "span", "h3"]))
        if tag == "span":
            tag = "div"
        labels.append(main)
        return f"<{tag}>{text(1, most)}</{tag}>"

    def other(part: str) -> str:
        kind = rng.random()
        if kind < 0.4:
            n = int(rng.integers(2, 8))
            labels.extend([False] * n)
            return opened(part, "<ul>" + "".join(f'<li><a href="/">{text(1, 3)}</a></li>' for _ in range(n)) + "</ul>")
        if kind < 0.6:
            labels.append(False)
            return opened(part, text(2, 30))
        return opened(part, "".join(paragraph(False, 60) for _ in range(int(rng.integers(1, 5)))))

    pick = lambda parts: parts[int(rng.integers(len(parts)))]
    page = "".join(other(pick(OTHER_PARTS)) for _ in range(int(rng.integers(0, 4))))
    body = ""
    if rng.random() < 0.8:
        labels.append(True)
        body += f"<h1>{text(3, 12)}</h1>"
    for _ in range(int(rng.integers(1, 14))):
        body += other(pick(INSERTED)) if rng.random() < 0.1 else paragraph(True, 90)
    if rng.random() < 0.2:
        body += other(pick(INSERTED))
    page += opened(pick(ARTICLE_PARTS), body)
    page += "".join(other(pick(OTHER_PARTS)) for _ in range(int(rng.integers(0, 4))))
    return f"<html><body>{page}</body></html>", labels


def train(pages: list[str], layouts: int = LAYOUTS, seed: int = 3) -> Labeller:
    """A labeller learned from the given pages (those that name their parts) and from layouts filled with their words."""
    rng = np.random.default_rng(seed)
    cut = [blocks(p) for p in pages]
    words = sorted({w for found in cut for _, text, _ in found for w in text.split()})[:5000] or ["word"]
    known = []
    for found in cut:
        named = named_by_markup(found)
        if named is not None:
            known.append((vectors(found), named))
    for _ in range(layouts):
        made, labels = layout(rng, words)
        found = blocks(made)
        if len(found) == len(labels):
            known.append((vectors(found), np.array(labels)))
    return Labeller().learn(known)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """``id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``.

    Without a ``model`` one is trained on at most LEARNED_PAGES pages, those first
    in the order of a hash of the row, none longer than LEARNED_CHARS.  A null or empty
    page, and one without article text, has an empty text; repeated rows are each
    read; an empty table gives an empty result; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"), F.col(url_col).cast("string").alias("url"))
    if model is None:
        key = F.xxhash64("id", "url", "html")
        few = rows.where(F.length("html") <= LEARNED_CHARS).select(key.alias("k")).distinct().orderBy("k").limit(LEARNED_PAGES)
        some = rows.withColumn("k", key).join(F.broadcast(few), "k", "left_semi").dropDuplicates(["k"]).orderBy("k")
        model = train([r.html for r in some.select("html").collect()])
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _bounded(batch):
                cut = [blocks(p) for p in part.column(1).to_pylist()]
                told = shared.value.label([vectors(found) for found in cut])
                texts = [" ".join(text for (_, text, _), main in zip(found, labels, strict=True) if main) for found, labels in zip(cut, told, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"]
                )

    return rows.mapInArrow(run, "id long, url string, text string, n_chars long")
