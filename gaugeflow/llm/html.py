"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each has a vector of its tag path (tags, class and id words of
all ancestors, hashed), one of its hashed words, and a few measures. A bidirectional LSTM in numpy
reads the whole sequence and labels every block. It is trained on a bounded sample of pages, whose
semantic tags give the labels, and on rearrangements of their blocks in other page frames.

Defined results: a NULL, empty or block-free page gives an empty text; white space inside a block becomes
one space; blocks are joined by one line end in page order; nothing else is dropped or cut.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import only

#: Pages that the labeller is trained on at most, the least by hash among those up to so many characters.
SAMPLE_PAGES, SAMPLE_CHARS = 80, 20_000
PATH, WORDS, MEASURES, HIDDEN = 64, 16, 4, 16
INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em font i img ins del kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg math iframe object select textarea button".split())
#: What the weak labels take for a frame around the main text.
FRAME_TAGS = frozenset("title nav header footer aside form menu dialog".split())
FRAME_NAMES = ("ad ads advert advertisement banner sponsor sponsored promo cookie consent notice popup modal newsletter subscribe sidebar "
               "menu nav navbar breadcrumb breadcrumbs footer header comment comments reply replies share social related form login").split()
MAIN_TAGS = ("article", "main", "div.content", "div.post", "div.entry-content", "section.story", "div#article", "div.article-body", "div")


class _Blocks(HTMLParser):
    """Collects (path words, text, share of the text inside links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.out: list[tuple[tuple[str, ...], str, float]] = []
        self.text: list[str] = []
        self.linked = self.links = self.silent = 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            path = tuple(w for _, words in self.stack for w in words)
            self.out.append((path, text, min(1.0, self.linked / len(text))))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        if tag in SILENT:
            self.silent += 1
        if tag in INLINE:
            return
        self.flush()
        closes = {"p": ("p",), "li": ("li",), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
                  "body": ("head", "title")}.get(tag, ("p",))
        while self.stack and self.stack[-1][0] in closes:
            self.stack.pop()
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        self.stack.append((tag, (f"<{tag}", *re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names).lower()))))

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in INLINE or tag in VOID:
            return
        self.flush()
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                del self.stack[at:]
                break

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks(html: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.out


_tokens: dict[str, np.ndarray] = {}
_word_table = np.random.default_rng(1).standard_normal((256, WORDS))


def _token(word: str) -> np.ndarray:
    if word not in _tokens:
        if len(_tokens) > 1 << 16:
            _tokens.clear()
        _tokens[word] = np.random.default_rng(zlib.crc32(word.encode())).standard_normal(PATH) / 4
    return _tokens[word]


def vectors(page, drop: float = 0.0, rng=None) -> np.ndarray:
    """One row per block of a page."""
    out = np.zeros((len(page), PATH + WORDS + MEASURES))
    for row, (path, text, linked) in zip(out, page):
        for w in dict.fromkeys(path):
            if not drop or rng.random() >= drop:
                row[:PATH] += _token(w)
        words = text.split()
        cells = np.bincount([zlib.crc32(w.lower().encode()) & 255 for w in words], minlength=256)
        row[PATH:PATH + WORDS] = cells @ _word_table / max(1, len(words))
        row[PATH + WORDS:] = np.log1p(len(text)) / 5, np.log1p(len(words)) / 3, linked, text[-1:] in ".!?"
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x, w, u, b):
    """Hidden states of a batch (rows, steps, width), and what the way back needs."""
    n, steps, _ = x.shape
    h, c, trace = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), []
    for t in range(steps):
        z = x[:, t] @ w + h @ u + b
        i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        old_h, old_c = h, c
        c = f * c + i * g
        h = o * np.tanh(c)
        trace.append((i, f, o, g, old_h, old_c, c, h))
    return np.stack([s[-1] for s in trace], 1), trace


def _backward(x, u, trace, dh_out):
    dw, du, db = np.zeros((x.shape[2], 4 * HIDDEN)), np.zeros_like(u), np.zeros(4 * HIDDEN)
    dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, o, g, old_h, old_c, c, _ = trace[t]
        dh = dh + dh_out[:, t]
        th = np.tanh(c)
        dc = dc + dh * o * (1 - th * th)
        dz = np.concatenate([dc * g * i * (1 - i), dc * old_c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
        dw += x[:, t].T @ dz
        du += old_h.T @ dz
        db += dz.sum(0)
        dh, dc = dz @ u.T, dc * f
    return dw, du, db


def _padded(pages: list[np.ndarray]):
    """(batch, mirrored batch, lengths, mask, mirror index)."""
    n = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), n.max(), pages[0].shape[1]))
    for row, p in zip(x, pages):
        row[:len(p)] = p
    at = np.arange(n.max())
    mirror = np.where(at < n[:, None], n[:, None] - 1 - at, at)
    return x, np.take_along_axis(x, mirror[:, :, None], 1), at < n[:, None], mirror[:, :, None]


def logits(params: dict, pages: list[np.ndarray], trace: bool = False):
    x, back, mask, mirror = _padded(pages)
    hf, tf = _forward(x, params["wf"], params["uf"], params["bf"])
    hb, tb = _forward(back, params["wb"], params["ub"], params["bb"])
    hb = np.take_along_axis(hb, mirror, 1)
    both = np.concatenate([hf, hb, x], 2)
    out = both @ params["v"] + params["c"]
    return (out, mask, (x, back, mirror, tf, tb, both)) if trace else (out, mask)


def train(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 12, rate: float = 0.01, seed: int = 1) -> dict:
    """Adam on the cross-entropy of every block."""
    rng = np.random.default_rng(seed)
    width = PATH + WORDS + MEASURES
    params = {"v": np.zeros(2 * HIDDEN + width), "c": np.zeros(())}
    for d in "fb":
        params |= {f"w{d}": rng.standard_normal((width, 4 * HIDDEN)) / np.sqrt(width), f"u{d}": rng.standard_normal((HIDDEN, 4 * HIDDEN)) / 4,
                   f"b{d}": np.zeros(4 * HIDDEN)}
    m, s, step = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros_like(p) for k, p in params.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        for at in range(0, len(order), 16):
            some = order[at:at + 16]
            out, mask, (x, back, mirror, tf, tb, both) = logits(params, [pages[i] for i in some], True)
            y = np.zeros(mask.shape)
            for row, i in zip(y, some):
                row[:len(labels[i])] = labels[i]
            d = np.where(mask, _sigmoid(out) - y, 0) / mask.sum()
            dboth = d[:, :, None] * params["v"]
            grads = {"v": np.einsum("nt,ntk->k", d, both), "c": d.sum()}
            for way, seq, tr, dh in (("f", x, tf, dboth[:, :, :HIDDEN]), ("b", back, tb, np.take_along_axis(dboth[:, :, HIDDEN:2 * HIDDEN], mirror, 1))):
                grads[f"w{way}"], grads[f"u{way}"], grads[f"b{way}"] = _backward(seq, params[f"u{way}"], tr, dh)
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                params[k] = params[k] - rate * m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return params


def weak_labels(page) -> np.ndarray:
    """1 where semantic tags and names put the block into the main text."""
    names = set(FRAME_NAMES) | {f"<{t}" for t in FRAME_TAGS}
    return np.array([not names & set(path) for path, _, _ in page], float)


def rearranged(page, rng) -> list:
    """A page's blocks in another frame: other tags around the main text, other kinds of boxes about and inside it."""
    label = weak_labels(page)
    main, rest = [b for b, y in zip(page, label) if y], [b for b, y in zip(page, label) if not y]
    if not main or not rest:
        return page
    tag, *names = re.split(r"[.#-]", MAIN_TAGS[rng.integers(len(MAIN_TAGS))])
    root = ("<html", "<body", *(("<div", "page") if rng.random() < 0.3 else ()), f"<{tag}", *names)
    inner = [((*root, "<" + ("h1" if i == 0 else "h2" if rng.random() < 0.1 else "li" if rng.random() < 0.1 else "p")), text, linked)
             for i, (_, text, linked) in enumerate(main)]

    def box(inside):
        texts = rest if rng.random() < 0.6 else main
        if rng.random() < 0.4:
            path = ("<" + sorted(FRAME_TAGS - {"title"})[rng.integers(len(FRAME_TAGS) - 1)],)
        else:
            path = ("<" + ("div", "section", "ul", "p")[rng.integers(4)], FRAME_NAMES[rng.integers(len(FRAME_NAMES))])
        leaf = ("<" + ("p", "li", "div")[rng.integers(3)],) if rng.random() < 0.7 else ()
        base = root if inside else root[:2]
        return [((*base, *path, *leaf), *texts[rng.integers(len(texts))][1:]) for _ in range(rng.integers(1, 4))]

    at = int(rng.integers(1, len(inner) + 1))
    middle = inner[:at] + (box(True) if rng.random() < 0.5 else []) + inner[at:]
    before = [b for _ in range(rng.integers(0, 3)) for b in box(False)]
    after = [b for _ in range(rng.integers(0, 3)) for b in box(rng.random() < 0.3)]
    return before + middle + after


def fit(pages: DataFrame, html: str = "html", seed: int = 5) -> dict:
    """The labeller, trained on a bounded sample (SAMPLE_PAGES pages of at most SAMPLE_CHARS characters)."""
    rows = only(pages, html).toDF("html").filter(F.length("html").between(1, SAMPLE_CHARS)).orderBy(F.xxhash64("html")).limit(SAMPLE_PAGES).collect()
    rng = np.random.default_rng(seed)
    real = [p for p in (blocks(r[0]) for r in rows) if p]
    if not real:
        return train([vectors([(("<p",), "x", 0.0)])], [np.ones(1)], epochs=1)
    shown = real + [rearranged(p, rng) for p in real for _ in range(4)]
    return train([vectors(p, 0.05, rng) for p in shown], [weak_labels(p) for p in shown])


def main_text(params: dict, pages: list[str | None], group: int = 32) -> list[str]:
    """The main text of each page; pages of like length are read together."""
    parsed = [blocks(h) for h in pages]
    out = [""] * len(pages)
    order = sorted((i for i, p in enumerate(parsed) if p), key=lambda i: len(parsed[i]))
    for at in range(0, len(order), group):
        some = order[at:at + group]
        if len(parsed[some[-1]]) > 2000:  # very long pages are read one by one
            batches = [[i] for i in some]
        else:
            batches = [some]
        for batch in batches:
            score, _ = logits(params, [vectors(parsed[i]) for i in batch])
            for i, s in zip(batch, score):
                out[i] = "\n".join(b[1] for b, x in zip(parsed[i], s) if x > 0)
    return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", params: dict | None = None) -> DataFrame:
    """(key, url, text, n_chars): one row per page."""
    params = params or fit(pages, html)
    rows = only(pages, key, url, html).toDF("key", "url", "html")
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[:2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                texts = main_text(params, b.column(2).to_pylist())
                yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                      names=["key", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"key {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"key": key, "url": url})
