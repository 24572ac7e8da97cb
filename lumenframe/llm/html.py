"""Main text of web pages by a recurrent block labeller.

A page is parsed into its leaf blocks in page order: runs of text that no block element interrupts. Each block is a vector of its hashed tag
path, its hashed words and a few shares and lengths. A bidirectional LSTM in numpy reads the whole sequence, so a block is judged by what stands
before and after it, and gives each block the probability that it belongs to the article. The network is trained here, on pages made by a
generator of common layouts (news, blogs, wikis, manuals, shops, forums, table layouts, bare pages) whose blocks are known.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import escape, unescape
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that end a run of text, elements whose content is no text, and elements without content.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea iframe noframes noembed xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same row closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{b: {"p"} for b in BLOCKS - {"li", "dt", "dd", "tr", "td", "th", "option", "html", "body", "head", "title", "button"}},
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?|[^<]++|<", re.S)
HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")

# Elements whose presence in the path is a value of its own, not hashed.
PARTS = "article main nav aside footer header form figure table ul ol li blockquote pre section h1 h2 h3 p".split()
PATH_DIM, WORD_DIM, MORE = 192, 48, 10 + len(PARTS)
HIDDEN = 24
#: Innermost tags and names of a block's path that are kept, and elements that a closing tag looks through; the work for a tag doesn't grow with its depth.
PATH, REACH = 40, 512
#: Blocks of a page that are turned into vectors at once; a longer page is read in such pieces, its states carried from one to the next.
PIECE = 8192


def blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, tag path, characters inside links) of each leaf block that has text; white space is one space, ends are trimmed.

    Comments, scripts, styles and other content that is no text are left out; a tag that the page's end cuts off is markup, not text.
    """
    out: list[tuple[str, tuple[str, ...], int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # tags with the path down to them
    opened: Counter[str] = Counter()
    run: list[str] = []
    linked, pos, end = 0, 0, len(page)

    def flush():
        nonlocal linked
        if run:
            if text := " ".join(unescape("".join(run)).split()):
                out.append((text, stack[-1][1] if stack else (), linked))
            run.clear()
        linked = 0

    def cut(k: int) -> None:
        for tag, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    def pop(names) -> None:
        """Closes the nearest open element of these names, unless a container that isn't one of them stands between."""
        if any(opened[n] for n in names):
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - REACH), -1):
                if stack[k][0] in names:
                    cut(k)
                    return
                if stack[k][0] in BLOCKS and stack[k][0] not in ("p", "li", "dt", "dd"):
                    return

    while pos < end:
        m = TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if page[m.start()] != "<" or pos == m.start() + 1:
                run.append(m[0])
                linked += len(m[0].strip()) if opened["a"] > 0 else 0
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, pos)
                pos = stop.end() if stop else end
            run.append(" ")
        elif tag in VOID:
            if tag in BLOCKS:
                flush()
            run.append(" ")
        elif closing:
            if tag in BLOCKS:
                flush()
                if opened[tag] > 0:
                    while stack:
                        last = stack[-1][0]
                        cut(len(stack) - 1)
                        if last == tag:
                            break
            else:
                pop({tag})
        else:
            path = stack[-1][1] if stack else ()
            if tag in BLOCKS:
                flush()
                if tag in CLOSES:
                    pop(CLOSES[tag])
                hints = dict.fromkeys("." + x for h in HINT.findall(attributes) for x in PART.findall("".join(h).lower())) if attributes else ()
                path = ((stack[-1][1] if stack else ()) + (tag, *hints))[-PATH:]
            # In drawings and formulas a slash closes an element.
            if tag in BLOCKS or not attributes.endswith("/") or not (tag in ("svg", "math") or opened["svg"] > 0 or opened["math"] > 0):
                stack.append((tag, path))
                opened[tag] += 1
    flush()
    return out


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


@functools.lru_cache(maxsize=1 << 16)
def _word_slot(word: str) -> int:
    return _slot(word.strip(".,;:!?()|"), WORD_DIM)


@functools.lru_cache(maxsize=1 << 14)
def _path_slots(path: tuple[str, ...]) -> list[int]:
    tags = [p for p in path if p[0] != "."]
    return [_slot(p, PATH_DIM) for p in path] + [_slot("last " + t, PATH_DIM) for t in tags[-1:]]


def features(found: list[tuple[str, tuple[str, ...], int]], first: int = 0, total: int | None = None) -> np.ndarray:
    """One row a block: hashed tag path (the innermost element twice), hashed words, shares and lengths, place in the page. Blocks may be part of a page of `total`, from `first` on."""
    n = len(found)
    total = n if total is None else total
    x = np.zeros((n, PATH_DIM + WORD_DIM + MORE), np.float32)
    slots, counts = [], np.zeros(n)
    for i, (text, path, linked) in enumerate(found):
        x[i, _path_slots(path)] = 1.0
        words = text.lower().split()
        base = i * WORD_DIM
        slots += [base + _word_slot(w) for w in words]
        counts[i] = len(words)
        size = len(text)
        x[i, PATH_DIM + WORD_DIM :] = (
            min(size, 2000) / 2000, np.log1p(size) / 8, min(1.0, linked / size), sum(map(text.count, ".!?")) / len(words), text.count(",") / len(words), "©" in text or "copyright" in words,
            text.count("|") / len(words), size < 40, (first + i) / total, 1.0, *(part in path for part in PARTS),
        )
    held = np.bincount(np.array(slots, np.int64), minlength=n * WORD_DIM).reshape(n, WORD_DIM)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = held / np.maximum(1.0, np.sqrt(counts) * 4)[:, None]
    return x


class Labeller:
    """Two LSTMs, one from each end, and a logistic unit over both states and the block itself."""

    def __init__(self, size: int = PATH_DIM + WORD_DIM + MORE, hidden: int = HIDDEN, seed: int = 1):
        random = np.random.default_rng(seed)
        self.hidden = hidden
        shape = lambda *s: random.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.params = {f"{k}{d}": shape(*s) for d in "fb" for k, s in (("w", (size, 4 * hidden)), ("u", (hidden, 4 * hidden)))}
        self.params |= {f"b{d}": np.zeros(4 * hidden, np.float32) for d in "fb"} | {"o": shape(2 * hidden + size, 1) * 0.3, "ob": np.zeros(1, np.float32)}

    def direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = True, begin: tuple[np.ndarray, np.ndarray] | None = None):
        """(states, what gradients need of each step, last state and cell) of one direction; x is blocks x pages x size, a masked step leaves the state as it is."""
        p, h = self.params, self.hidden
        steps, pages = x.shape[:2]
        into = x @ p["w" + d] + p["b" + d]
        state, cell = begin or (np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32))
        out, kept = np.zeros((steps, pages, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = into[t] + state @ p["u" + d]
            gates = 1 / (1 + np.exp(-z[:, : 3 * h]))
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            squash = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                kept.append((t, state, cell, i, f, o, g, squash, m))
            cell, state = np.where(m, new, cell), np.where(m, o * squash, state)
            out[t] = state
        return out, kept, (state, cell)

    def joined(self, f: np.ndarray, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joint = np.concatenate([f, b, x], axis=2)
        return 1 / (1 + np.exp(-np.clip((joint @ self.params["o"])[:, :, 0] + self.params["ob"], -30, 30))), joint

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = True):
        (f, fk, _), (b, bk, _) = self.direction(x, mask, "f", keep), self.direction(x, mask, "b", keep)
        return *self.joined(f, b, x), fk, bk

    def long(self, found: list[tuple[str, tuple[str, ...], int]], piece: int = PIECE) -> np.ndarray:
        """Probabilities of one page's blocks, whatever their number: vectors are made for a piece at a time, once for each direction."""
        n, h = len(found), self.hidden
        cuts = [(a, min(n, a + piece)) for a in range(0, n, piece)]
        vectors = lambda a, z: features(found[a:z], a, n)[:, None, :]
        forth, carry = np.zeros((n, 1, h), np.float32), None
        for a, z in cuts:
            forth[a:z], _, carry = self.direction(vectors(a, z), np.ones((z - a, 1), bool), "f", False, carry)
        out, carry = np.zeros(n, np.float32), None
        for a, z in reversed(cuts):
            x = vectors(a, z)
            back, _, carry = self.direction(x, np.ones((z - a, 1), bool), "b", False, carry)
            out[a:z] = self.joined(forth[a:z], back, x)[0][:, 0]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.params, self.hidden
        prob, joint, fk, bk = self.forward(x, mask)
        d = np.where(mask, prob - y, 0.0).astype(np.float32)[:, :, None] / max(1, mask.sum())
        grads = {"o": np.tensordot(joint, d, ((0, 1), (0, 1))), "ob": d.sum((0, 1))}
        dj = d @ p["o"].T
        for name, kept, ds in (("f", fk, dj[:, :, :h]), ("b", bk, dj[:, :, h : 2 * h])):
            dz_all = np.zeros((*x.shape[:2], 4 * h), np.float32)
            gu = np.zeros_like(p["u" + name])
            dstate, dcell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for t, state, cell, i, f, o, g, squash, m in reversed(kept):
                dstate = dstate + ds[t]
                dh = np.where(m, dstate, 0.0)
                dc = np.where(m, dcell, 0.0) + dh * o * (1 - squash**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * squash * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                gu += state.T @ dz
                dstate = dz @ p["u" + name].T + np.where(m, 0.0, dstate)
                dcell = dc * f + np.where(m, 0.0, dcell)
            grads["w" + name] = np.tensordot(x, dz_all, ((0, 1), (0, 1)))
            grads["u" + name], grads["b" + name] = gu, dz_all.sum((0, 1))
        return grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 24, seed: int = 2) -> "Labeller":
        random, t = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.params.items()} for _ in range(2))
        for epoch in range(epochs):
            # Pages of like length go together, so that few steps of a batch are masked.
            order = np.argsort([len(x) * random.uniform(0.8, 1.25) for x, _ in pages], kind="stable")
            for a in random.permutation(np.arange(0, len(pages), batch)):
                own = [pages[i] for i in order[a : a + batch]]
                x, mask = stacked([p[0] for p in own])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, label) in enumerate(own):
                    y[: len(label), k] = label
                t += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.params[k] -= 0.01 * (1 - 0.9 * epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def label(self, pages: list[list[tuple[str, tuple[str, ...], int]]], cells: int = 16384) -> list[np.ndarray]:
        """Probabilities of each page's blocks; pages of like length go together, some thousand blocks at a time, and long ones alone."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order and len(pages[order[-1]]) > PIECE:
            i = order.pop()
            out[i] = self.long(pages[i])
        while order:
            take = max(1, min(len(order), cells // len(pages[order[min(len(order), 256) - 1]])))
            own, order = order[:take], order[take:]
            x, mask = stacked([features(pages[i]) for i in own])
            prob = self.forward(x, mask, False)[0]
            for k, i in enumerate(own):
                out[i] = prob[: len(pages[i]), k]
        return out


def stacked(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


# Words that page furniture uses and articles seldom do, and names that pages give to their parts.
FURNITURE = {
    "nav": "home about contact menu news sports login register sign in search archive products services blog help next previous page top back".split(),
    "footer": "© copyright all rights reserved privacy policy terms of use imprint contact 2021 2024 sitemap powered by".split(),
    "ad": "advertisement sponsored offer buy now sale deal free shipping click here".split(),
    "notice": "we use cookies to improve your experience accept all reject settings consent subscribe to our newsletter".split(),
    "form": "name email password send submit your message search subscribe required".split(),
    "comment": "says reply posted by ago comment thanks great post i agree guest".split(),
}
NAMES = {
    "main": "content main main-content maincontent post entry article article-body article-content story story-body text post-body post-content entry-content body-content content-body page-content parser-output markdown-body prose description product-description detail documentation docs chapter topic question".split(),
    "outer": "wrapper container row col page site inner layout grid wrap outer box body main content column center global app root".split(),
    "nav": "nav menu navbar navigation top topbar header-menu breadcrumb breadcrumbs links toc tabs mainmenu footer-menu pagination pager".split(),
    "header": "header masthead top banner site-header branding logo head".split(),
    "ad": "ad ads advert advertisement banner sponsor sponsored promo promotion".split(),
    "notice": "notice cookie cookies cookie-notice consent alert banner gdpr message".split(),
    "side": "sidebar widget aside side related rail secondary infobox recent tags share social see-also recommended teaser".split(),
    "comment": "comments comment-list discussion responses replies reviews feedback comment reply".split(),
    "form": "form search login newsletter subscribe signup".split(),
    "footer": "footer bottom copyright site-footer colophon legal foot".split(),
}


def made_page(random: np.random.Generator) -> tuple[str, set[str]]:
    """A page of a common layout, with the texts of its article's blocks."""
    pick = lambda *x: x[int(random.integers(len(x)))]
    chance = lambda p: random.random() < p
    letters = ["".join(pick(*"bcdfghklmnprstvwz") + pick(*"aeiouéöñ") + pick("", *"nrst") for _ in range(random.integers(1, 5))) for _ in range(60)]
    symbols = [escape(pick(*punctuation) * int(random.integers(1, 4))) for _ in range(4)]

    def prose(least: int, most: int) -> str:
        style = random.random()
        words = [pick(*letters) for _ in range(random.integers(least, most + 1))]
        if style < 0.05:
            return " | ".join(words)
        if style < 0.1:
            return " ".join(w.upper() + "!" * int(random.integers(0, 4)) for w in words)
        if style < 0.2:  # text full of signs
            return " ".join(w + (pick(*symbols) if chance(0.8) else "") for w in words)
        if style < 0.24:
            return " ".join([words[0].title()] * len(words))
        return " ".join(w.title() if k % 9 == 0 else w + ("." if k % 9 == 8 else "," if chance(0.06) else "") for k, w in enumerate(words)) + pick(".", ".", "", "?")

    def furniture(kind: str, least: int = 1, most: int = 8) -> str:
        mix = random.random()
        return " ".join(pick(*FURNITURE[kind]) if random.random() < mix else pick(*letters) for _ in range(random.integers(least, most + 1)))

    def named(tag: str, kind: str, inner: str) -> str:
        names = " ".join(pick(*NAMES[kind]) + ("-" + pick(*letters) if chance(0.1) else "") for _ in range(pick(1, 1, 2)))
        return f'<{tag} {pick("class", "class", "id")}="{names}">{inner}</{tag}>'

    def wrapped(inner: str, least: int = 0, most: int = 3) -> str:
        for _ in range(random.integers(least, most + 1)):
            inner = pick(named("div", "outer", inner), named("div", "outer", inner), f"<div>{inner}</div>", f"<section>{inner}</section>")
        return inner

    def listing(kind: str) -> str:
        links = [f'<a href="/{pick(*letters)}">{furniture(kind, 1, pick(3, 3, 9))}</a>' for _ in range(random.integers(2, 9))]
        return pick("<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", " ".join(links), " &gt; ".join(links), "<ol>" + "".join(f"<li>{x}" for x in links) + "</ol>", "".join(f"<p>{x}</p>" for x in links), "".join(f"<div>{x}</div>" for x in links))

    body = lambda kind, least=3, most=30: pick(furniture(kind, least, most), prose(least, most))
    main: list[str] = []

    def marked(text: str) -> str:
        """The text with some words inside inline elements, some of them never closed."""
        words = text.split(" ")
        for _ in range(random.integers(0, 4)):
            at = int(random.integers(len(words)))
            if "<" not in words[at]:
                words[at] = pick(f"<b>{words[at]}</b>", f"<i>{words[at]}</i>", f'<a href="/x">{words[at]}</a>', f"<em>{words[at]}</em>", f"<code>{words[at]}</code>", f"<span class='{pick(*letters)}'>{words[at]}</span>", f"<b>{words[at]}", f"<i>{words[at]}")
        return " ".join(words)

    def text(least=1, most=60) -> str:
        main.append(own := prose(least, most))
        return marked(own) if chance(0.3) else own

    def lines() -> str:
        """Paragraphs that only line breaks part."""
        parts = [prose(8, 50) for _ in range(random.integers(2, 6))]
        main.append(" ".join(parts))
        return pick("<br>", "<br/>", "<br><br>", "<br /><br />").join(parts)

    heading = lambda: "<h{0}>{1}</h{0}>".format(pick(2, 2, 3, 4), text(1, 8))
    paragraph = lambda: pick("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p class='x'>{}</p>").format(text(3, 70))
    items = lambda: "".join(pick("<li>{}</li>", "<li>{}").format(text(2, 20)) for _ in range(random.integers(1, 6)))
    rows = lambda: "".join(f"<tr>{pick('<td>{}</td><td>{}</td>', '<th>{}</th><td>{}</td>').format(text(1, 4), text(1, 6))}</tr>" for _ in range(random.integers(1, 5)))
    quoted = lambda: pick("<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<pre><code>{}</code></pre>", "<figure><img src='x'><figcaption>{}</figcaption></figure>").format(text(2, 25))
    defined = lambda: "<dl>" + "".join(f"<dt>{text(1, 3)}</dt><dd>{text(3, 20)}</dd>" for _ in range(random.integers(1, 4))) + "</dl>"

    # What stands around and between articles.
    nav = lambda: pick(f"<nav>{listing('nav')}</nav>", named("div", "nav", listing("nav")), named("ul", "nav", "".join(f"<li><a href='/'>{furniture('nav', 1, 2)}</a></li>" for _ in range(random.integers(2, 8)))))
    header = lambda: pick("<header>{}</header>", named("div", "header", "{}")).format(pick(f"<h1>{furniture('nav', 1, 4)}</h1>", f"<a href='/'>{furniture('nav', 1, 3)}</a>", f"<div>{furniture('nav', 1, 3)}</div>", f"<p>{furniture('nav', 1, 3)}</p>") + pick("", f"<p>{furniture('nav', 2, 8)}</p>", f"<p>{prose(2, 9)}</p>") + pick("", nav(), nav()))
    ad = lambda: pick(named("div", "ad", body("ad")), f"<aside>{body('ad')}</aside>", named("p", "ad", body("ad", 2, 12)))
    notice = lambda: named(pick("div", "div", "section"), "notice", pick("{}", "<p>{}</p>", "<p>{}</p><button>ok</button>").format(body("notice", 4, 40)))
    side = lambda: pick(f"<aside>{{}}</aside>", named("div", "side", "{}"), named("section", "side", "{}")).format(pick(listing("nav"), f"<h3>{furniture('nav', 1, 3)}</h3>" + pick(listing("nav"), f"<p>{prose(3, 30)}</p>"), f"<p>{body('ad')}</p>", f"<h2>{furniture('nav', 1, 3)}</h2><ul>" + "".join(f"<li><a href='/'>{prose(2, 9)}</a></li>" for _ in range(random.integers(2, 6))) + "</ul>"))
    form = lambda: pick("<form>{}</form>", named("div", "form", "<form>{}</form>")).format(f"<label>{furniture('form', 1, 3)}</label><input><p>{body('form', 2, 12)}</p><button>{furniture('form', 1, 2)}</button>")
    said = lambda: pick("<p>{}</p>", "{}", f"<span>{furniture('comment', 1, 4)}</span><p>{{}}</p>", f"<b>{furniture('comment', 1, 3)}</b>: {{}}").format(body("comment", 2, 50))
    comments = lambda: named(pick("div", "div", "section", "ol"), "comment", pick("", f"<h3>{furniture('comment', 1, 3)}</h3>") + "".join(pick(named("div", "comment", said()), named("li", "comment", said()), f"<li>{said()}</li>", f"<article class='comment'>{said()}</article>") for _ in range(random.integers(1, 7))))
    footer = lambda: pick("<footer>{}</footer>", "<footer>{}</footer>", named("div", "footer", "{}")).format(pick(f"&copy; {furniture('footer', 1, 8)}", f"<p>{body('footer')}</p>", listing("nav"), f"&copy; {pick(*letters)} {prose(2, 20)}", f"{pick(*letters)}.{pick('com', 'org', 'net')} {pick('|', '&middot;', '-', '')} {prose(2, 20)}", body("footer")))

    def written(kinds: list, least: int, most: int, between: float = 0.06) -> str:
        parts = []
        for _ in range(random.integers(least, most + 1)):
            parts.append(pick(*kinds)())
            if chance(between):
                parts.append(pick(ad, side)())
        return "".join(parts)

    def titled(inner: str) -> str:
        return pick(f"<h1>{text(2, 12)}</h1>", f"<header><h1>{text(2, 12)}</h1></header>", f"<h2>{text(2, 12)}</h2>", f"<div class='title'>{text(2, 12)}</div>", "") + inner

    def framed(inner: str) -> str:
        return pick(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", named("div", "main", inner), named("div", "main", inner), named("section", "main", inner), named("article", "main", inner))

    layout = pick("news", "news", "news", "news", "news", "blog", "wiki", "manual", "shop", "forum", "table", "bare")
    if layout == "news":
        middle = framed(titled(written([paragraph] * 8 + [heading, quoted, lambda: f"<ul>{items()}</ul>", lambda: f"<table>{rows()}</table>", lambda: f"<p>{text(1, 8)}</p>"], 1, 24)))
    elif layout == "blog":
        middle = framed(titled(pick(f"<div class='{pick('post-body', 'entry', 'post')}'>{lines()}</div>", lines(), written([paragraph, paragraph, lambda: f"<div>{lines()}</div>", quoted], 1, 8))))
    elif layout == "wiki":
        inside = written([paragraph] * 5 + [heading, heading, lambda: f"<ul>{items()}</ul>", lambda: f"<table class='{pick('wikitable', 'data', 'infobox')}'>{rows()}</table>", defined], 3, 16, 0.02)
        middle = f'<div id="{pick("content", "main", "mw-content", "wiki")}"><h1 id="{pick("firstHeading", "title")}">{text(1, 6)}</h1>{wrapped(inside, 1, 3)}</div>'
    elif layout == "manual":
        middle = framed(titled(written([paragraph] * 4 + [heading, quoted, quoted, lambda: f"<ol>{items()}</ol>", defined], 2, 14, 0.02)))
    elif layout == "shop":
        middle = framed(f"<h1>{text(2, 8)}</h1>" + form() * chance(0.5) + written([paragraph, paragraph, lambda: f"<ul>{items()}</ul>", lambda: f"<table>{rows()}</table>", defined], 1, 5))
    elif layout == "forum":
        middle = named("div", "main", f"<h1>{text(2, 12)}</h1>" * chance(0.8) + written([paragraph, paragraph, quoted, lambda: f"<div>{lines()}</div>"], 1, 5, 0.0)) + comments()
    elif layout == "table":
        middle = titled(pick(lines(), written([paragraph] * 3 + [heading], 1, 7, 0.02)))
    else:
        middle = titled(written([paragraph] * 5 + [heading, quoted, lambda: f"<ul>{items()}</ul>"], 1, 10, 0.0))
    if layout == "table":
        menu, more, last = pick(listing("nav"), nav()), pick("", f"<td>{side()}</td>"), body("footer")
        page = f"<table{pick('', ' width=100%')}><tr><td colspan=2>{pick(header(), nav(), furniture('nav', 1, 4))}</td></tr><tr><td{pick('', ' class=menu')}>{menu}</td><td>{middle}</td>{more}</tr>{pick('', f'<tr><td>{last}</td></tr>')}</table>"
        page += pick("", footer())
    else:
        above = "".join(pick(nav, nav, header, header, ad, notice, side, form)() for _ in range(random.integers(0, 4)))
        below = "".join(pick(side, side, comments, comments, ad, notice, form, nav)() for _ in range(random.integers(0, 4))) + pick("", footer(), footer(), footer())
        page = pick(above + wrapped(middle) + below, wrapped(above + middle + below, 0, 2), above + wrapped(middle + pick("", side(), comments()), 1, 3) + below)
    title = pick(main[0], furniture("nav", 1, 5)) if main else ""
    page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style></head><body>{page}</body></html>"
    if chance(0.1):  # a page that was cut off
        page = page[: int(len(page) * random.uniform(0.5, 1.0))]
    return page, {" ".join(unescape(x).split()) for x in main}


def examples(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, str]]:
    random, out = np.random.default_rng(seed), []
    while len(out) < n:
        page, main = made_page(random)
        found = blocks(page)
        if found:
            # A cut page may cut a text: what lies inside one of them, beyond a few letters, is article too.
            label = [float("title" not in path and "head" not in path and (text in main or k == len(found) - 1 and len(text) > 12 and any(x.startswith(text) for x in main))) for k, (text, path, _) in enumerate(found)]
            out.append((features(found), np.array(label, np.float32), page))
    return out


@functools.lru_cache(maxsize=2)
def trained(pages: int = 1500, seed: int = 8) -> Labeller:
    """The labeller, trained on `pages` made pages; the same on every machine but for rounding."""
    return Labeller().train([(x, y) for x, y, _ in examples(pages, seed)])


def main_texts(pages: list[str], labeller: Labeller, least: float = 0.5) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n\n".join(text for (text, _, _), p in zip(f, prob, strict=True) if p >= least) for f, prob in zip(found, labeller.label(found), strict=True)]


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), labeller: Labeller | None = None, at_once: int = 1 << 20) -> DataFrame:
    """The columns `keep` with text and n_chars for every row of pages, from the whole html.

    A null or empty page, and one without article blocks, has an empty text. Blocks are joined in page order by two line ends; nothing is cut.
    Equal pages get equal texts. Null keys and repeated rows are rows like others; an empty table gives an empty result.
    """
    sent = pages.sparkSession.sparkContext.broadcast(labeller or trained())  # a fixed number of weights
    schema = T.StructType([*(T.StructField(c, pages.schema[c].dataType) for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            waiting, size = [], 0
            for x in batch.column(len(keep)):  # some pages at a time, so features of long pages don't pile up
                waiting.append(x.as_py() or "")
                size += len(waiting[-1])
                if size >= at_once:
                    texts += main_texts(waiting, sent.value)
                    waiting, size = [], 0
            texts += main_texts(waiting, sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*keep, F.col(html_col)).mapInArrow(run, schema)
