"""HTML extraction by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is a vector: hashed vectors of the tags,
classes, ids and roles above it, hashed vectors of its words, its length, link share,
closing mark and place. A bidirectional LSTM in numpy reads the whole sequence, so
a block is judged by everything before and after it, and labels it main text or not.

There are no labelled pages, so the labels come from page structure: on a bounded sample
(``SAMPLE`` pages, the first by a hash of page_id) a block below an article is main text,
one below a menu, footer, advert and the like is not, and other blocks teach nothing.
Every sampled page is also learned from in disguises: containers under other names
and classes, and notices, sidebars, forms and comments added from its own words, so that
the labeller does not hang on one layout. In part of the disguises the containers lose their
names: they become tables, bare or randomly named ones, and what blocks look like, their
places and neighbours must decide. The model is trained on the driver in a
fixed number of small steps; extraction is one pass without a shuffle.

Defined cases: a null, empty or blank page has an empty text; so has a page without
main blocks; pages without an id are sampled, by a hash of the page, only where no page has
one; where no sampled page has a known container, long unlinked blocks that end a sentence
teach main text and linked ones the rest; tables without pages train nothing and
give an empty result; repeated rows are extracted each; pages of any length are read whole
(the sample takes those of at most ``LONGEST`` characters, so what the driver holds is bounded);
other columns may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import quoted
from tapewright.llm.html_blocks import Block, blocks

SAMPLE = 240
LONGEST = 200_000  # characters of a page that may be sampled
STEPS = 2000
BATCH_PAGES = 24
CROP = 40          # blocks of a page that a training step sees
HIDDEN = 24
PATH_DIM, WORD_DIM, WORD_ROWS = 48, 12, 2048
RATE = 0.01
READ = 128         # pages labelled together

# What the structure of a page says about a block.
MAIN = {"article", "main", ".article", ".post", ".content", ".entry", ".story"}
OTHER = set((
    "nav header footer aside form dialog menu button fieldset .nav .navbar .navigation .menu .header .masthead .footer "
    ".sidebar .aside .ad .ads .advert .advertisement .banner .promo .sponsored .sponsor .cookie .cookies .consent .notice "
    ".popup .modal .overlay .newsletter .subscribe .signup .login .search .share .social .related .recommended "
    ".breadcrumb .breadcrumbs .pagination .comment .comments .respond .disqus .copyright .widget .toolbar").split())
# Disguises of a container.
AS_MAIN = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post"), ("div", ".article", ".body"),
           ("section", ".story"), ("div", ".entry", ".content"), ("div", ".main"), ("div", ".article")]
AS_MENU = [("nav",), ("header", "nav"), ("div", ".menu"), ("div", ".nav"), ("ul", ".navbar"), ("div", ".navigation"),
           ("div", ".breadcrumb"), ("header", "div", ".menu")]
AS_FOOT = [("footer",), ("div", ".footer"), ("footer", "div", ".copyright"), ("div", ".footer", ".links")]
AS_AD = [("div", ".ad"), ("div", ".ads"), ("div", ".advert"), ("aside", ".promo"), ("div", ".sponsored"), ("div", ".banner"),
         ("div", ".advertisement"), ("section", ".sponsor")]
ADDED = [("header",), ("div", ".header"), ("aside",), ("aside", ".sidebar"), ("div", ".sidebar"), ("div", ".widget"),
         ("div", ".cookie", ".notice"), ("div", ".consent"), ("div", ".cookie"), ("div", ".notice"), ("div", ".popup"),
         ("form",), ("form", ".newsletter"), ("div", ".subscribe"), ("div", ".login"), ("div", ".search", "form"),
         ("div", ".share"), ("div", ".social"), ("div", ".related"), ("section", ".comments"), ("div", ".comments"),
         ("ol", ".comments", "li", ".comment"), ("div", ".comment"), ("section", ".comments", "article")]
NAMED = ADDED + AS_AD + AS_FOOT + AS_MENU
NAMELESS = 0.45    # share of disguises whose containers lose their names
WRAPS = [(), (), ("div", ".wrapper"), ("div", ".container"), ("div", ".page"), ("div",), ("div", ".site", "div", ".row")]


def structure_label(path: tuple[str, ...]) -> int:
    """1 main, 0 other, -1 unknown: the innermost telling piece decides, an outer OTHER wins over it."""
    if any(p in OTHER for p in path):
        return 0
    return 1 if any(p in MAIN for p in path) else -1


def shape_label(b: Block) -> int:
    """The same by the look of a block alone: 1 for prose, 0 for links, -1 unknown."""
    if 2 * b.linked > len(b.text):
        return 0
    return 1 if len(b.text.split()) >= 12 and b.text[-1] in ".!?" else -1


def _vector(word: str, size: int) -> np.ndarray:
    return np.random.default_rng(zlib.crc32(word.encode("utf-8", "replace"))).standard_normal(size) / np.sqrt(size)


_pieces: dict[str, np.ndarray] = {}
_WORDS = np.random.default_rng(7).standard_normal((WORD_ROWS, WORD_DIM)) / np.sqrt(WORD_DIM)
WIDTH = PATH_DIM + WORD_DIM + 5


def _piece(piece: str) -> np.ndarray:
    if piece not in _pieces:
        if len(_pieces) > 20_000:
            _pieces.clear()
        _pieces[piece] = _vector(piece, PATH_DIM)
    return _pieces[piece]


def _word_mean(words: list[str]) -> np.ndarray:
    rows = [zlib.crc32(w.encode("utf-8", "replace")) % WORD_ROWS for w in words]
    return _WORDS[rows].mean(axis=0)


def features(page: list[Block], memo: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """(blocks, WIDTH) matrix of a page. Training passes a memo of word vectors by text."""
    out = np.zeros((len(page), WIDTH))
    for i, b in enumerate(page):
        for piece in set(b.path) - {"html", "body"}:
            out[i, :PATH_DIM] += _piece(piece)
        words = b.text.split()
        mean = None if memo is None else memo.get(b.text)
        if mean is None:
            mean = _word_mean(words)
        out[i, PATH_DIM:PATH_DIM + WORD_DIM] = mean
        out[i, -5:] = (np.log1p(len(b.text)) / 6, b.linked / len(b.text), np.log1p(len(words)) / 4,
                       b.text[-1] in ".!?:;\"'", i / len(page))
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Two LSTMs over padded sequences (time, batch, width) and a logistic output."""

    def __init__(self, width: int, hidden: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.standard_normal((width, 4 * hidden)) / np.sqrt(width)
            self.p["h" + d] = rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)
            bias = np.zeros(4 * hidden)
            bias[hidden:2 * hidden] = 1.0      # remember by default
            self.p["c" + d] = bias
        self.p["o"] = rng.standard_normal(2 * hidden) / np.sqrt(2 * hidden)
        self.p["ob"] = np.zeros(1)

    def _run(self, x, mask, d, keep):
        steps, batch, _ = x.shape
        n = self.hidden
        pre = x @ self.p["x" + d] + self.p["c" + d]
        h, c = np.zeros((batch, n)), np.zeros((batch, n))
        hs, saved = np.zeros((steps, batch, n)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p["h" + d]
            gates = _sigmoid(z[:, :3 * n])
            i, f, o, g = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:], np.tanh(z[:, 3 * n:])
            m = mask[t][:, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(new_c)
            new_h = m * (o * tc) + (1 - m) * h
            if keep:
                saved.append((t, h, c, i, f, o, g, tc, m))
            h, c = new_h, new_c
            hs[t] = h
        return hs, saved

    def forward(self, x, mask, keep=False):
        ahead, kept_f = self._run(x, mask, "f", keep)
        back, kept_b = self._run(x, mask, "b", keep)
        both = np.concatenate([ahead, back], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["ob"]), (both, kept_f, kept_b)

    def gradients(self, x, mask, y, known):
        """Mean cross-entropy over known blocks, and its gradients."""
        p, (both, kept_f, kept_b) = self.forward(x, mask, keep=True)
        n_known = max(known.sum(), 1)
        loss = -(known * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / n_known
        dz = known * (p - y) / n_known
        grads = {"o": np.einsum("tb,tbk->k", dz, both), "ob": np.array([dz.sum()])}
        dboth = dz[:, :, None] * self.p["o"]
        n = self.hidden
        for d, kept, dhs in (("f", kept_f, dboth[:, :, :n]), ("b", kept_b, dboth[:, :, n:])):
            dpre = np.zeros((*x.shape[:2], 4 * n))
            gh = np.zeros_like(self.p["h" + d])
            dh, dc = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n))
            for t, h, c, i, f, o, g, tc, m in reversed(kept):
                dh = dh + dhs[t]
                live = m * dh
                dcn = dc + live * o * (1 - tc * tc)
                inner = m * dcn
                dz4 = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), live * tc * o * (1 - o),
                                      inner * i * (1 - g * g)], axis=1)
                dpre[t] = dz4
                gh += h.T @ dz4
                dh = (1 - m) * dh + dz4 @ self.p["h" + d].T
                dc = (1 - m) * dcn + inner * f
            grads["h" + d] = gh
            grads["x" + d] = np.einsum("tbw,tbk->wk", x, dpre, optimize=True)
            grads["c" + d] = dpre.sum(axis=(0, 1))
        return loss, grads


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, seqs))
    x = np.zeros((steps, len(seqs), seqs[0].shape[1]))
    mask = np.zeros((steps, len(seqs)))
    for k, s in enumerate(seqs):
        x[:len(s), k], mask[:len(s), k] = s, 1
    return x, mask


def _nameless(rng) -> tuple[str, ...]:
    """A container that tells nothing: bare, or under a name that is drawn anew each time."""
    names = [f".{rng.integers(1 << 40):x}" for _ in range(2)]
    options = [(), ("div",), ("div", names[0]), ("section", names[0]), ("div", names[0], names[1]),
               ("div", names[0], "div", names[1]), ("div", "div"), ("center",), ("span", names[0])]
    return options[rng.integers(len(options))]


def strip_names(page: list[Block], known: list[int], rng) -> tuple[list[Block], list[int]]:
    """A page whose containers have lost their names, and its labels.

    Main text keeps its look. Around it stand link bars, notices and short lines made of the page's
    own words; what cannot be told from prose without a name (adverts, comments) keeps one."""
    words = " ".join(b.text for b in page).split()
    table = rng.random() < 0.3
    cell = ("table", "tr", "td") if table and rng.random() < 0.7 else ("table", "tbody", "tr", "td") if table else ()
    wrap = () if rng.random() < 0.5 else _nameless(rng)
    main = wrap + (cell or _nameless(rng))
    bare = rng.random() < (0.7 if table else 0.3)     # blocks without a tag of their own
    plain = [(), ("div",), ("p",), ("td",), ("font",), ("div", "div")][rng.integers(6)]
    out, labels = [], []

    def say(path, n, linked, end=""):
        at = int(rng.integers(max(1, len(words) - n)))
        text = " ".join(words[at:at + n]).rstrip(".,;:!?") + end
        if text:
            out.append(Block(path, text, len(text) if linked else 0))
            labels.append(0)

    def bar():
        path = wrap + (cell or _nameless(rng)) + [(), ("p",), ("li",), ("ul", "li"), ("div",), ("td",)][rng.integers(6)]
        for _ in range(rng.integers(1, 9)):
            say(path, int(rng.integers(1, 6)), True)

    def named():
        path = wrap + NAMED[rng.integers(len(NAMED))] + [(), ("p",), ("li",), ("div",)][rng.integers(4)]
        for _ in range(rng.integers(1, 4)):
            say(path, int(rng.integers(2, 30)), rng.random() < 0.2, "." if rng.random() < 0.8 else "")

    def small():
        path = wrap + (cell or _nameless(rng)) + [(), ("p",), ("div",)][rng.integers(3)]
        for _ in range(rng.integers(1, 3)):
            say(path, int(rng.integers(1, 6)), rng.random() < 0.3)

    for part, chance in ((small, 0.2), (bar, 0.7), (named, 0.6)):
        if rng.random() < chance:
            part()
    kept = [b for b, label in zip(page, known) if label == 1]
    if rng.random() < 0.5:             # a short article, or one without its heading
        first = int(rng.integers(len(kept)))
        kept = kept[first:first + int(rng.integers(2, 6))]
    for b in kept:
        if rng.random() < 0.08:
            named()
        rest = tuple(x for x in b.path if x not in ("html", "body"))
        at = max((i for i, x in enumerate(rest) if x in MAIN), default=-1)
        inner = rest[at + 1:]
        heading = (f"h{rng.integers(1, 5)}",) if inner[-1:] == ("h1",) else ()
        text, n = b.text, len(b.text.split())
        if rng.random() < 0.2 and n > 14:
            short = int(rng.integers(8, n))
            text = " ".join(text.split()[:short]).rstrip(",;:") + "."
        out.append(Block(main + (() if bare else heading or plain or inner), text, min(b.linked, len(text))))
        labels.append(1)
    for part, chance in ((bar, 0.5), (named, 0.7), (small, 0.3), (named, 0.4), (bar, 0.2)):
        if rng.random() < chance:
            part()
    return out, labels


def disguise(page: list[Block], known: list[int], rng) -> tuple[list[Block], list[int]]:
    """A page under other container names with added blocks, and its labels."""
    pick = lambda options: options[rng.integers(len(options))]
    wrap = pick(WRAPS)
    as_main, as_menu, as_foot, as_ad = pick(AS_MAIN), pick(AS_MENU), pick(AS_FOOT), pick(AS_AD)
    out, labels = [], []

    def add():
        for _ in range(rng.integers(1, 4)):
            source = page[rng.integers(len(page))]
            words = source.text.split()
            n = int(rng.integers(1, 30))
            path = wrap * int(rng.integers(2)) + pick(ADDED) + pick([(), ("p",), ("li",), ("div",), ("h3",)])
            text = " ".join(words[:n])
            out.append(Block(path, text, len(text) * int(rng.random() < 0.3)))
            labels.append(0)

    for b, label in zip(page, known):
        rest = tuple(x for x in b.path if x not in ("html", "body"))
        if label == 1:
            at = max((i for i, x in enumerate(rest) if x in MAIN), default=-1)
            rest = as_main + rest[at + 1:]
        elif label == 0:
            at = min((i for i, x in enumerate(rest) if x in OTHER), default=-1)
            name = rest[at] if at >= 0 else "nav"
            kind = as_menu if name in ("nav", ".nav", ".menu") else as_foot if "foot" in name else as_ad
            rest = kind + rest[at + 1:]
        if rng.random() < 0.06:
            add()
        text = b.text
        if rng.random() < 0.25:            # length alone tells nothing
            text = " ".join(text.split()[:int(rng.integers(1, 5))])
        out.append(Block(wrap + rest, text, min(b.linked, len(text))))
        labels.append(label)
    if rng.random() < 0.8:
        add()
    return out, labels


def train(pages: list[str | None], steps: int = STEPS, seed: int = 1) -> BiLstm:
    """Fit to sampled pages and their disguises. Deterministic; Adam."""
    model = BiLstm(WIDTH, HIDDEN, seed)
    parsed = [p for p in map(blocks, pages) if p]
    if not parsed:
        return model
    labelled = [[structure_label(b.path) for b in page] for page in parsed]
    if not any(1 in known for known in labelled):
        labelled = [[shape_label(b) for b in page] for page in parsed]
    rng = np.random.default_rng(seed)
    memo = {b.text: _word_mean(b.text.split()) for page in parsed for b in page}
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        seqs, ys = [], []
        for k in rng.integers(len(parsed), size=BATCH_PAGES):
            page, labels = parsed[k], labelled[k]
            as_it_is = rng.random()
            if as_it_is < NAMELESS and 1 in labels:
                page, labels = strip_names(page, labels, rng)
            elif as_it_is < 0.8:
                page, labels = disguise(page, labels, rng)
            at = int(rng.integers(max(1, len(page) - CROP + 1)))
            seqs.append(features(page, memo)[at:at + CROP])
            ys.append(np.array(labels[at:at + CROP], float)[:, None])
        x, mask = _padded(seqs)
        y = _padded(ys)[0][:, :, 0]
        _, grads = model.gradients(x, mask, np.maximum(y, 0), mask * (y >= 0))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            model.p[k] -= rate * m1[k] / (1 - 0.9 ** step) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def label(pages: list[list[Block]], model: BiLstm) -> list[np.ndarray]:
    """Probability of main text for every block; pages of like length share a pass."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        # Long pages go in smaller groups, so a pass holds a bounded number of blocks.
        size = max(1, min(READ, 40_000 // len(pages[order[min(at + READ, len(order)) - 1]])))
        part = order[at:at + size]
        x, mask = _padded([features(pages[k]) for k in part])
        p, _ = model.forward(x, mask)
        for j, k in enumerate(part):
            out[k] = p[:len(pages[k]), j]
        at += size
    return out


def fit(pages: DataFrame, page_id: str = "page_id", page: str = "html", sample: int = SAMPLE) -> BiLstm:
    """Train on the first sample pages by a hash of their id (of the page itself, where none has an id)."""
    rows = pages.select(quoted(page_id).alias("k"), quoted(page).alias("h")).where(
        (F.length("h") > 0) & (F.length("h") <= LONGEST))
    # Ids first: a top-k over whole pages would send sample pages from every task.
    chosen = [r.k for r in rows.select("k").orderBy(F.xxhash64("k"), "k").limit(sample).collect()]
    named = [k for k in chosen if k is not None]
    if chosen and not named:
        marks = [r.k for r in rows.select(F.xxhash64("h").alias("k")).orderBy("k").limit(sample).collect()]
        found = rows.where(F.xxhash64("h").isin(marks)).limit(2 * sample).collect()
        return train(sorted(r.h for r in found)[:sample])
    found = rows.where(F.col("k").isin(named)).limit(2 * sample).collect()
    return train([r.h for r in sorted(found, key=lambda r: (r.k, r.h))][:sample])


def extract(pages: DataFrame, model: BiLstm, page_id: str = "page_id", url: str = "url", page: str = "html",
            least: float = 0.5) -> DataFrame:
    """page_id, url, text, n_blocks, n_main of every page."""
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512]
                parsed = [blocks(h) for h in part.iloc[:, 2]]
                texts, n_main = [], []
                for found, p in zip(parsed, label(parsed, model)):
                    kept = [b.text for b, q in zip(found, p) if q >= least]
                    texts.append("\n".join(kept))
                    n_main.append(len(kept))
                yield pd.DataFrame({"page_id": part.iloc[:, 0], "url": part.iloc[:, 1], "text": texts,
                                    "n_blocks": [len(f) for f in parsed], "n_main": n_main})

    # Ids travel as text: pandas would turn whole numbers beside a null into doubles.
    found = pages.select(quoted(page_id).cast("string"), quoted(url), quoted(page)).mapInPandas(
        run, "page_id string, url string, text string, n_blocks long, n_main long")
    return found.withColumn("page_id", F.col("page_id").cast(pages.schema[page_id].dataType))
