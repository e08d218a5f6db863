"""Main text of web pages: a bidirectional LSTM labels every block in the context of its page."""

from __future__ import annotations

import random
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import map_rows, sample_rows
from cuewright.llm.html_blocks import Block, blocks_of

#: Hashed path and word dimensions, hidden units of each direction, pages in training.
PATH_DIMS, WORD_DIMS, NUMBERS, HIDDEN = 96, 32, 8, 24
MADE_PAGES, SAMPLE_PAGES, SAMPLE_CHARS, EPOCHS = 900, 200, 50_000, 12
DIMS = PATH_DIMS * 2 + WORD_DIMS + NUMBERS
_PADDED = 1 << 15

_words: dict[str, int] = {}
_paths: dict[tuple, np.ndarray] = {}


def _slot(name: str, dims: int) -> tuple[int, float]:
    h = xxhash.xxh64_intdigest(f"{dims}{name}".encode("utf-8", "replace"))
    return h % dims, 1.0 if h >> 40 & 1 else -1.0


def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Hashed names on a path: all of it, and its innermost three elements by themselves."""
    row = _paths.get(path)
    if row is None:
        row = np.zeros(2 * PATH_DIMS, np.float32)
        for base, part in ((0, path), (PATH_DIMS, path[-3:])):
            for element in part:
                for name in sorted({"<" + element[0], *element[1:], *(n[:4] + "*" for n in element[1:] if len(n) > 4)}):
                    k, sign = _slot(name, PATH_DIMS)
                    row[base + k] += sign
        if len(_paths) > 20_000:
            _paths.clear()
        _paths[path] = row
    return row


def _word_slot(word: str) -> int:
    """Slot of a word, twice that and one more for a negative sign."""
    s = _words.get(word)
    if s is None:
        k, sign = _slot(word.lower(), WORD_DIMS)
        s = 2 * k + (sign < 0)
        if len(_words) > 200_000:
            _words.clear()
        _words[word] = s
    return s


def block_vectors(blocks: list[Block]) -> np.ndarray:
    """Hashed names of the path, hashed words of the whole text, and lengths, link share, marks and
    place in the page."""
    out = np.zeros((len(blocks), DIMS), np.float32)
    for i, b in enumerate(blocks):
        row = out[i]
        row[: 2 * PATH_DIMS] = _path_vector(tuple(b.path))
        words = b.text.split(" ")
        counts = np.bincount(np.fromiter(map(_word_slot, words), np.int64, len(words)), minlength=2 * WORD_DIMS)
        row[2 * PATH_DIMS : 2 * PATH_DIMS + WORD_DIMS] = (counts[::2] - counts[1::2]) / len(words)
        n = len(b.text)
        row[-NUMBERS:] = (
            np.log1p(n) / 6, len(words) / (n + 1) * 4, b.links, b.text[-1] in ".!?", b.text.count(",") / (n + 1) * 20,
            i / len(blocks), 1 - i / len(blocks), "&" in b.text or "©" in b.text,
        )
    return np.clip(out, -3, 3)


# --- the network -----------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over block vectors with a logistic output for each block.

    ``p`` holds for either direction the input, recurrent and bias weights of the gates (input,
    forget, output, cell), then the output weights and bias. Padding sits behind the sequences and is
    masked, so it changes nothing in either direction.
    """

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p: list[np.ndarray] = []
        for _ in range(2):
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p += [draw(DIMS, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), bias]
        self.p += [draw(2 * HIDDEN, 1), np.zeros(1, np.float32)]

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: int, keep: list | None) -> np.ndarray:
        wx, wh, b = self.p[3 * d : 3 * d + 3]
        n, steps = x.shape[:2]
        z_all = x.reshape(n * steps, -1) @ wx
        z_all = z_all.reshape(n, steps, -1) + b
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            m = mask[:, t, None]
            z = z_all[:, t] + h @ wh
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, th))
            c = np.where(m, new, c)
            h = np.where(m, o * th, h)
            out[:, t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list[list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.concatenate([self._direction(x, mask, d, keep[d] if keep else None) for d in range(2)], axis=2)
        return _sigmoid(hidden @ self.p[6] + self.p[7])[:, :, 0], hidden

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        keep: list[list] = [[], []]
        p, hidden = self.forward(x, mask, keep)
        total = max(1.0, float(weight.sum()))
        loss = float(-(weight * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        miss = ((p - y) * weight / total)[:, :, None].astype(np.float32)
        grads = [np.zeros_like(w) for w in self.p]
        grads[6] += hidden.reshape(-1, 2 * HIDDEN).T @ miss.reshape(-1, 1)
        grads[7] += miss.sum()
        back = miss @ self.p[6].T
        for d in range(2):
            wh = self.p[3 * d + 1]
            dh = np.zeros((len(x), HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, h, c, i, f, o, g, th in reversed(keep[d]):
                m = mask[:, t, None]
                dh = dh + back[:, t, d * HIDDEN : (d + 1) * HIDDEN]
                live = dh * m
                do = live * th * o * (1 - o)
                dnew = live * o * (1 - th * th) + dc * m
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do, dnew * i * (1 - g * g)], axis=1)
                grads[3 * d] += x[:, t].T @ dz
                grads[3 * d + 1] += h.T @ dz
                grads[3 * d + 2] += dz.sum(0)
                dh = dh * (1 - m) + dz @ wh.T
                dc = dc * (1 - m) + dnew * f
        return loss, grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 5) -> Labeller:
        """Adam over batches of pages (vectors, labels, weights) of like length."""
        rng = random.Random(seed)
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        batches = [pages[i : i + 32] for i in range(0, len(pages), 32)]
        first, second = [np.zeros_like(w) for w in self.p], [np.zeros_like(w) for w in self.p]
        step = 0
        for epoch in range(epochs):
            rng.shuffle(batches)
            for batch in batches:
                x, mask = padded([v for v, _, _ in batch])
                y, w = (np.zeros(mask.shape, np.float32) for _ in range(2))
                for r, (_, label, weight) in enumerate(batch):
                    y[r, : len(label)], w[r, : len(label)] = label, weight
                _, grads = self.gradients(x, mask, y, w)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                step += 1
                slow = rate * (0.3 if epoch > 0.7 * epochs else 1)
                for p, g, a, b in zip(self.p, grads, first, second):
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (slow * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block; pages of like length share a padded batch."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            n = max(1, min(len(order), _PADDED // len(pages[order[-1]])))
            part, order = order[-n:], order[:-n]
            x, mask = padded([pages[i] for i in part])
            p, _ = self.forward(x, mask)
            for r, i in enumerate(part):
                out[i] = p[r, : len(pages[i])]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, DIMS), np.float32), np.zeros((len(pages), steps), bool)
    for r, v in enumerate(pages):
        x[r, : len(v)], mask[r, : len(v)] = v, True
    return x, mask


# --- training pages ------------------------------------------------------------------------------

#: Names that pages give to their parts; training pages are put together from them.
MAIN = ("<article>", "<main>", '<div class="content">', '<div id="main-content">', '<div class="post-body">', '<div class="entry-content">', '<section class="story">', '<div class="article-body">', '<div role="main">', '<article class="post">', '<section class="article-text">')
OTHER = {
    "menu": ("<nav>", '<ul class="menu">', '<div class="navbar">', '<div id="navigation">', '<div class="breadcrumbs">', '<nav class="main-nav">', '<div class="topmenu">', '<ul id="tabs">'),
    "header": ("<header>", '<div class="header">', '<div id="masthead">', '<div class="site-header">', '<div class="topbar">', '<header class="page-header">'),
    "footer": ("<footer>", '<div class="footer">', '<div id="colophon">', '<div class="site-footer">', '<div class="copyright">', '<footer class="bottom">'),
    "side": ("<aside>", '<div class="sidebar">', '<div class="widget">', '<div class="related-posts">', '<div id="right-column">', '<aside class="side">', '<div class="recommended">', '<div class="share social">', '<div class="popular tags">'),
    "notice": ('<div class="cookie-banner">', '<div class="notice">', '<div id="consent">', '<div class="alert">', '<div class="newsletter">', '<div class="popup modal">', '<div class="subscribe">', '<div class="gdpr privacy">', '<div class="paywall warning">', '<p class="disclaimer">'),
    "advert": ('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div class="promo">', '<div id="banner-ad">', '<section class="sponsor">', '<div class="adsbox">', '<p class="ad">'),
    "form": ("<form>", '<form class="search">', '<form id="login">', '<div class="search-form">', '<fieldset>', '<div class="contact-form">'),
    "comment": ('<div class="comments">', '<section id="comments">', '<ol class="comment-list">', '<div class="comment">', '<div class="discussion">', '<div class="replies">', '<section class="user-comments">', '<div id="disqus_thread">', '<div class="responses">', '<div class="reader-comments">'),
}


def made_page(rng: random.Random, words: list[str]) -> tuple[str, list[int]]:
    """A random page and the label of each of its blocks (1: main text)."""
    labels: list[int] = []

    def say(n: int, stop: str = "") -> str:
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + stop

    def close(opening: str) -> str:
        return f"</{opening[1:].split()[0].rstrip('>')}>"

    def other(kind: str) -> str:
        opening = rng.choice(OTHER[kind])
        long = rng.random() < 0.35
        if opening.startswith("<p") or (kind not in ("menu", "form") and rng.random() < 0.4 and not opening.startswith(("<ul", "<ol"))):
            labels.append(0)
            return opening + say(rng.randint(1, 30), rng.choice(("", "."))) + close(opening)
        inner = []
        for _ in range(rng.randint(1, 6)):
            if kind == "menu" or rng.random() < 0.3:
                labels.append(0)
                inner.append(f'<li><a href="/{rng.choice(words)}">{say(rng.randint(1, 4))}</a></li>')
            elif kind == "form":
                labels.append(0)
                inner.append(rng.choice(("<div><label>{}</label><input></div>", "<button>{}</button>", "<p>{}</p><textarea></textarea>")).format(say(rng.randint(1, 6))))
            else:
                labels.append(0)
                tag = rng.choice(("p", "p", "div", "h3", "li"))
                inner.append(f"<{tag}>{say(rng.randint(1, 60 if long or kind == 'comment' else 14), rng.choice(('', '.')))}</{tag}>")
        body = "".join(inner)
        return opening + (f"<ul>{body}</ul>" if kind == "menu" and not opening.startswith("<ul") else body) + close(opening)

    def some(kinds: tuple[str, ...], chance: float) -> str:
        return "".join(other(k) for k in kinds if rng.random() < chance)

    def main() -> str:
        opening = rng.choice(MAIN)
        out = [opening]
        inside = rng.random() < 0.3
        if rng.random() < 0.8:
            labels.append(1)
            out.append(rng.choice(("<h1>{}</h1>", "<h1>{}</h1>", "<h1 class=\"title\">{}</h1>", "<h2>{}</h2>")).format(say(rng.randint(2, 12))))
        for _ in range(rng.choice((1, 2, 3, 5, 8, 12))):
            labels.append(1)
            n = rng.choice((1, 2, 6, 12, 25, 50, 90))
            form = rng.choice(("<p>{}</p>",) * 8 + ("<p><b>{}<br>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", '<p class="lead">{}</p>'))
            out.append(form.format(say(n, rng.choice((".", ".", "", "!")))))
            if inside and rng.random() < 0.3:
                out.append(other(rng.choice(("advert", "side", "notice", "form", "menu"))))
        if rng.random() < 0.2:
            out.append(other("comment"))
        return "".join(out) + close(opening)

    page = "<html><head><title>x</title></head><body>"
    page += some(("notice", "header", "menu", "advert", "menu"), 0.45)
    wrap = rng.random() < 0.4
    page += rng.choice(('<div class="container">', '<div id="wrapper">', "<div>", '<div class="page row">')) if wrap else ""
    page += some(("side", "advert", "form"), 0.25)
    page += main()
    page += some(("comment", "side", "advert", "form", "notice"), 0.4)
    page += "</div>" if wrap else ""
    return page + some(("footer", "notice", "menu"), 0.5) + "</body></html>", labels


_IN, _OUT = {"article", "main"}, {"nav", "header", "footer", "aside", "form", "button", "select", "textarea"}


def structural_labels(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Labels and weights of a real page's blocks where its tags leave no doubt: inside an article
    without classes on the way, or inside a navigation, header, footer, aside or form outside it."""
    label, weight = np.zeros(len(blocks), np.float32), np.zeros(len(blocks), np.float32)
    for i, b in enumerate(blocks):
        tags = set(b.tags)
        plain = not any(len(e) > 1 for e in b.path)
        if tags & _IN and not tags & _OUT and plain:
            label[i], weight[i] = 1, 1
        elif tags & _OUT and not tags & _IN:
            weight[i] = 1
    return label, weight


def train(sample: list[str]) -> Labeller:
    """Fits the network to made pages (words taken from the sample) and the sample's own pages."""
    rng = random.Random(11)
    real = [blocks_of(p) for p in sample]
    words = sorted({w for bs in real for b in bs for w in b.text.split()[:200]})[:20000] or ["word", "text", "page", "more"]
    pages = []
    for _ in range(MADE_PAGES):
        page, labels = made_page(rng, words)
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            pages.append((block_vectors(blocks), np.array(labels, np.float32), np.ones(len(labels), np.float32)))
    pages += [(block_vectors(bs), *structural_labels(bs)) for bs in real]
    return Labeller().fit(pages)


def _extract(columns: list[list], model: Labeller) -> list[list]:
    pages = [blocks_of(p) for p in columns[0]]
    chosen = model.label([block_vectors(bs) for bs in pages])
    texts = ["\n".join(b.text for b, p in zip(bs, ps) if p >= 0.5) for bs, ps in zip(pages, chosen)]
    return [texts, [len(t) for t in texts], [len(bs) for bs in pages]]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, ``url``, ``text`` (main blocks in page order, one per line), ``n_chars``, ``n_blocks``.

    The network is trained on the driver on made pages and about ``SAMPLE_PAGES`` pages of up to
    ``SAMPLE_CHARS`` characters, chosen by hash, then labels every block of every page. Null and empty pages, and pages without text, have an empty text; broken markup is read
    as far as it goes; repeated rows are treated alike; an empty table gives no rows.
    """
    page = F.col(html_col)
    fit = pages.filter((F.length(page) > 0) & (F.length(page) <= SAMPLE_CHARS)).select(page.alias("_p"), F.col(id_col).alias("_id"))
    model = train(sorted(r[0] for r in sample_rows(fit, ["_id", "_p"], SAMPLE_PAGES).select("_p").toLocalIterator()))
    lean = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_u"), page.alias("_p"))
    out = map_rows(lean, ["_p"], ["_id", "_u"], "text string, n_chars bigint, n_blocks bigint", partial(_extract, model=model))
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_u", "url")
