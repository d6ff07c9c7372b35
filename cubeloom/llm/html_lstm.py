"""Main text of web pages by a bidirectional LSTM over a page's leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags). Each block becomes a vector of its tag
path with classes, hashed; of its words, hashed; and of a few shape figures. A bidirectional LSTM in numpy reads the
whole sequence of a page's blocks, so every block is judged with the context of all others, and labels it as article
or not. The network is trained here, on the driver, on ``TRAIN_PAGES`` generated pages whose blocks have known labels
(fixed seed); training sees none of the pages it is applied to. Its weights are a few thousand numbers.

Defined cases: null or empty html gives empty text; pages without tags are one block, which is article; scripts,
styles and comments are never blocks; a null page_id or url is kept; text of formulas and objects is text; unclosed and stray tags are repaired as browsers do; long pages are read whole;
repeated rows get equal results; no rows give no rows; only three columns are read.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thrifty

TRAIN_PAGES = 2000
HIDDEN = 16
PATH_DIMS = 256
WORD_DIMS = 32
FIGURES = 8
DIMS = PATH_DIMS + WORD_DIMS + FIGURES

# Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math menclose mfrac mi mn mo mover mpadded mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover object q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title head".split())
SWALLOWS = frozenset("script style textarea title".split())  # without an end they go on to the end of the page
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

TAG = re.compile(r"""<!--.*?(?:-->|$)|<([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?][^>]*+>|<([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)  # nothing is read twice from one place
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters in links) of each leaf block; the path has tags, and tokens of class, id and role as .token."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked = at = 0

    def text(piece: str) -> None:
        nonlocal path, linked
        if piece:
            if not parts and not piece.isspace():
                path = tuple(x for tag, names in stack for x in (tag, *names))
            if parts or not piece.isspace():
                parts.append(piece)
                if any(tag == "a" for tag, _ in stack):
                    linked += len(piece)

    def flush() -> None:
        nonlocal linked
        if parts:
            if joined := " ".join(html.unescape("".join(parts)).split()):
                out.append((path, joined, min(linked, len(joined))))
            parts.clear()
        linked = 0

    def close(tag: str) -> None:
        for k in reversed(range(len(stack))):
            if stack[k][0] == tag:
                del stack[k:]
                return

    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[1] or m[4] or "").lower()
        if tag:
            if tag not in INLINE:
                flush()
            if tag in RAW:
                empty = tag == "svg" and (m[2] or m[5] or "").endswith("/")
                if tag != "head" and not empty:
                    end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
                    at = end.end() if end else len(page) if tag in SWALLOWS else at
                continue
            if tag in CLOSES_P and any(t == "p" for t, _ in stack):
                close("p")
            if tag in SIBLINGS:
                for k in reversed(range(len(stack))):
                    if stack[k][0] in SCOPES[tag]:
                        break
                    if stack[k][0] in SIBLINGS[tag]:
                        del stack[k:]
                        break
            attributes = m[2] or m[5] or ""
            if tag not in VOID and not (attributes.endswith("/") and tag not in INLINE and tag not in CLOSES_P):
                names = [p.lower() for g in NAMES.findall(attributes) for p in PARTS.findall(g[0] or g[1] or g[2])] if "=" in attributes else []
                stack.append((tag, tuple("." + p for p in names)))
        elif m[3]:
            tag = m[3].lower()
            if tag not in INLINE:
                flush()
            close(tag)
    text(page[at:])
    flush()
    return out


@lru_cache(maxsize=20_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_DIMS, np.float32)
    for depth, x in enumerate(path):
        out[zlib.crc32(x.encode()) % PATH_DIMS] += 1.0
    last = next((x for x in reversed(path) if x[0] != "."), "")
    out[zlib.crc32(b"last " + last.encode()) % PATH_DIMS] += 1.0
    return np.minimum(out, 2.0)


def features(page_blocks: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    x = np.zeros((len(page_blocks), DIMS), np.float32)
    for i, (path, text, linked) in enumerate(page_blocks):
        x[i, :PATH_DIMS] = path_vector(path)
        words = text.split()
        hashed = np.bincount(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.int64, len(words)) % WORD_DIMS, minlength=WORD_DIMS)
        x[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = hashed / (len(words) + 16)
        n = len(text)
        ends = text[-1] in ".!?:;"
        x[i, PATH_DIMS + WORD_DIMS :] = (np.log1p(n) / 6, np.log1p(len(words)) / 5, linked / n, min(1.0, text.count(". ") / 5), ends, sum(c in "|·©»&" for c in text) / n * 5, i / len(page_blocks), 1.0)
    return x


class Network:
    """One LSTM each way and a logistic output. Gates stand in the order input, forget, output, candidate."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = {}
        for way in "fb":
            self.w[f"x{way}"] = (rng.standard_normal((DIMS, 4 * hidden)) * 0.1).astype(np.float32)
            self.w[f"h{way}"] = (rng.standard_normal((hidden, 4 * hidden)) * 0.2).astype(np.float32)
            self.w[f"c{way}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)
        self.w["o"] = (rng.standard_normal(2 * hidden) * 0.2).astype(np.float32)
        self.w["d"] = (rng.standard_normal(DIMS) * 0.01).astype(np.float32)
        self.w["z"] = np.zeros(1, np.float32)

    def way(self, x: np.ndarray, live: np.ndarray, way: str) -> dict:
        """States over (time, page, ...); pages are padded at the end, ``live`` is 1 where there is a block. Where there is
        none the state stays zero, so the backward way begins at each page's own last block."""
        time, pages = live.shape
        proj = x @ self.w[f"x{way}"] + self.w[f"c{way}"]
        h, c = np.zeros((pages, self.h), np.float32), np.zeros((pages, self.h), np.float32)
        gates = np.zeros((time, pages, 4 * self.h), np.float32)
        hs, cs = np.zeros((time, pages, self.h), np.float32), np.zeros((time, pages, self.h), np.float32)
        n = 3 * self.h
        for t in range(time) if way == "f" else reversed(range(time)):
            g = proj[t] + h @ self.w[f"h{way}"]
            g[:, :n] = 1 / (1 + np.exp(-np.clip(g[:, :n], -30, 30)))
            g[:, n:] = np.tanh(g[:, n:])
            i, f, o, z = np.split(g, 4, axis=1)
            c = (f * c + i * z) * live[t, :, None]
            h = o * np.tanh(c)
            gates[t], hs[t], cs[t] = g, h, c
        return {"g": gates, "h": hs, "c": cs}

    def forward(self, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, dict]:
        states = {way: self.way(x, live, way) for way in "fb"}
        both = np.concatenate([states["f"]["h"], states["b"]["h"]], axis=2)
        logit = both @ self.w["o"] + x @ self.w["d"] + self.w["z"]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), states | {"both": both}

    def gradients(self, x, live, y) -> dict[str, np.ndarray]:
        p, s = self.forward(x, live)
        d = ((p - y) * live / live.sum()).astype(np.float32)
        out = {"o": np.einsum("tp,tph->h", d, s["both"]), "d": np.einsum("tp,tpd->d", d, x), "z": np.array([d.sum()], np.float32)}
        for k, way in enumerate("fb"):
            up = d[:, :, None] * self.w["o"][k * self.h : (k + 1) * self.h]
            g, hs, cs = s[way]["g"], s[way]["h"], s[way]["c"]
            order = list(range(len(x))) if way == "f" else list(reversed(range(len(x))))
            dg = np.zeros_like(g)
            dh, dc = np.zeros_like(hs[0]), np.zeros_like(hs[0])
            for k2 in reversed(range(len(order))):
                t = order[k2]
                i, f, o, z = np.split(g[t], 4, axis=1)
                c0 = cs[order[k2 - 1]] if k2 else np.zeros_like(dc)
                dh_t = up[t] + dh
                tc = np.tanh(cs[t])
                dc_t = (dc + dh_t * o * (1 - tc * tc)) * live[t, :, None]
                dg[t] = np.concatenate([dc_t * z * i * (1 - i), dc_t * c0 * f * (1 - f), dh_t * tc * o * (1 - o), dc_t * i * (1 - z * z)], axis=1)
                dc = dc_t * f
                dh = dg[t] @ self.w[f"h{way}"].T
            before = np.zeros_like(hs)
            before[order[1:]] = hs[order[:-1]]
            out[f"x{way}"] = x.reshape(-1, DIMS).T @ dg.reshape(-1, 4 * self.h)
            out[f"h{way}"] = before.reshape(-1, self.h).T @ dg.reshape(-1, 4 * self.h)
            out[f"c{way}"] = dg.sum((0, 1))
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 25, rate: float = 0.01) -> Network:
        """Adam over batches of pages of like length."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        batches = [padded([pages[i] for i in order[k : k + batch]]) for k in range(0, len(order), batch)]
        rng, step = np.random.default_rng(11), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                step += 1
                for k, g in self.gradients(*batches[b]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray], cells: int = 40_000) -> list[np.ndarray]:
        """Whether each block of each page is article. Pages of like length are read together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: -len(pages[i]))
        while order:
            take = max(1, min(len(order), cells // len(pages[order[0]])))
            some, order = order[:take], order[take:]
            x, live, _ = padded([(pages[i], np.zeros(len(pages[i]))) for i in some])
            p = self.forward(x, live)[0]
            for k, i in enumerate(some):
                out[i] = p[: len(pages[i]), k] > 0.5
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    time = max(len(x) for x, _ in pages)
    x, live, y = np.zeros((time, len(pages), DIMS), np.float32), np.zeros((time, len(pages)), np.float32), np.zeros((time, len(pages)), np.float32)
    for k, (a, b) in enumerate(pages):
        x[: len(a), k], live[: len(a), k], y[: len(a), k] = a, 1, b
    return x, live, y


class Pages:
    """Generated pages with known labels: article parts stand between marks that are cut out again."""

    NAMES = {
        "menu": ["nav", "menu", "navbar", "breadcrumb", "topnav", "main-menu"], "header": ["header", "masthead", "banner", "site-header", "top"],
        "footer": ["footer", "site-footer", "copyright", "bottom", "colophon"], "sidebar": ["sidebar", "related", "widget", "aside", "recommended", "popular", "trending"],
        "notice": ["cookie", "notice", "consent", "gdpr", "alert", "popup", "banner-notice", "newsletter"], "advert": ["ad", "ads", "advert", "sponsored", "promo", "adsense", "banner-ad"],
        "form": ["search", "subscribe", "login", "signup", "contact-form"], "comments": ["comments", "comment", "replies", "discussion", "comment-list", "respond"],
        "share": ["share", "social", "sharing", "tags", "meta-links"],
        "article": ["article", "content", "post", "entry", "story", "main", "body", "text", "post-content", "entry-content"],
    }
    TAGS = {"menu": ["nav", "div", "ul", "nav"], "header": ["header", "div"], "footer": ["footer", "div", "footer"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "p"], "advert": ["div", "aside", "section", "p"], "form": ["form"], "comments": ["section", "div", "ul", "ol"], "share": ["div", "ul"], "article": ["article", "main", "div", "section", "article"]}

    def __init__(self, seed: int = 5):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(["th", "er", "on", "an", "re", "ing", "le", "que", "ion", "sch", "ei", "os", "ar", "é", "ü", "ta", "mi", "lo", "12", "ne", "st"]) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        out = " ".join(self.word() for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.15:
            out = re.sub(" ", lambda _: self.r.choice(["### ", "&amp;&amp; ", "*** ", " | ", ", "]), out)
        return out.capitalize() if self.r.random() < 0.8 else out

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 18) + self.r.choice([".", ".", ".", "!", "?", ""]) for _ in range(self.r.randint(low, high)))

    def attribute(self, kind: str) -> str:
        roll = self.r.random()
        if roll < 0.2 and kind != "article":
            return ""
        if roll < 0.4:
            return ""
        name = self.r.choice(self.NAMES[kind])
        return f' {self.r.choice(["class", "class", "id"])}="{name}{self.r.choice(["", "", " wide", "-1", " block"])}"'

    def links(self, low: int, high: int) -> str:
        item = self.r.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> ", "<li>{}</li>", "<div><a href='/y'>{}</a></div>"])
        inner = "".join(item.format(self.words(1, 3)) for _ in range(self.r.randint(low, high)))
        return f"<ul>{inner}</ul>" if item.startswith("<li") else inner

    def chrome(self, kind: str) -> str:
        tag = self.r.choice(self.TAGS[kind])
        attr = self.attribute(kind)
        if tag in ("div", "section", "p", "ul", "ol") and not attr:
            attr = f' class="{self.r.choice(self.NAMES[kind])}"'
        text = lambda: self.r.choice(["", "<p>", "<b>", "<span>"]) + self.sentences(1, 3)
        body = {
            "menu": lambda: self.links(2, 9), "header": lambda: self.r.choice(["<h1>{}</h1>", "<p>{}</p>", "{}"]).format(self.words(1, 5)) + self.r.choice(["", self.links(2, 5)]),
            "footer": lambda: self.r.choice(["&copy; ", "", "Copyright "]) + self.words(1, 3) + self.r.choice([" &middot; ", " | ", "<br>"]) + self.sentences(1, 2) + self.r.choice(["", self.links(2, 5)]),
            "sidebar": lambda: self.r.choice(["", f"<h3>{self.words(1, 4)}</h3>"]) + self.r.choice([self.links(2, 6), f"<p>{self.sentences(1, 4)}</p>"]), "notice": text, "advert": text,
            "form": lambda: f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>" + self.r.choice(["", f"<p>{self.sentences(1, 2)}</p>"]),
            "comments": lambda: f"<h3>{self.words(1, 3)}</h3>" + "".join(self.r.choice(["<div class='comment'><b>{0}</b><p>{1}</p></div>", "<li><p>{1}</p></li>", "<p>{1}</p>"]).format(self.word(), self.sentences(1, 6)) for _ in range(self.r.randint(1, 6))),
            "share": lambda: self.links(2, 5),
        }[kind]()
        return f"<{tag}{attr}>{body}</{tag}>"

    def article(self) -> str:
        r = self.r
        tag = r.choice(self.TAGS["article"])
        attr = self.attribute("article")
        if tag in ("div", "section") and not attr:
            attr = f' class="{r.choice(self.NAMES["article"])}"'
        parts = [r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>", ""]).format(self.words(1, 12))]
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            text = self.sentences(1, r.choice([1, 1, 3, 8]))
            if kind < 0.72:
                parts.append(f"<p>{text}</p>" if r.random() < 0.85 else f"<p><b>{text}<br>")
            elif kind < 0.78:
                parts.append(f"<h2>{self.words(1, 6)}</h2>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.95:
                parts.append(f"<p>{self.words(2, 6)} <a href='/z'>{self.words(1, 3)}</a> {text}</p>")
            else:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            if r.random() < 0.15:
                parts.append("\x02" + self.chrome(r.choice(["advert", "share", "sidebar", "form", "notice"])) + "\x01")
        body = "".join(parts)
        return f"<{tag}{attr}>\x01{body}\x02</{tag}>"

    def page(self) -> str:
        r = self.r
        if r.random() < 0.06:  # an article and nothing else
            return "\x01" + r.choice(["", "<p>", "<h1>Title</h1><p>"]) + "<p>".join(self.sentences(1, 4) for _ in range(r.randint(1, 3))) + "\x02"
        pick = lambda kinds, p: "".join(self.chrome(k) for k in kinds if r.random() < p)
        before = pick(["notice", "header", "menu", "menu", "form", "advert", "sidebar"], 0.4)
        after = pick(["share", "comments", "sidebar", "advert", "form", "footer", "footer", "notice"], 0.4)
        wrap = r.choice(["{}", "{}", "<div>{}</div>", "<div id='page'>{}</div>", "<div class='container'><div class='row'>{}</div></div>"])
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><script>var a='</p>';</script></head><body>" + wrap.format(before + self.article() + after) + r.choice(["</body></html>", ""])

    def labelled(self) -> tuple[list, np.ndarray]:
        """Blocks of a page, and 1 for those between \\x01 and \\x02."""
        page, inside, marked = self.page(), False, []
        for piece in re.split("([\x01\x02])", page):
            if piece == "\x01":
                inside = True
            elif piece == "\x02":
                inside = False
            else:
                marked.append(re.sub(r"(^|>)([^<>]*[^<>\s][^<>]*)", r"\1" + "\x03\\2", piece) if inside else piece)
        got = blocks("".join(marked))
        return [(path, text.replace("\x03", ""), n) for path, text, n in got], np.array(["\x03" in text for _, text, _ in got], np.float32)


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES) -> Network:
    made = Pages()
    return Network().fit([(features(b), y) for b, y in (made.labelled() for _ in range(pages)) if b])


def extract(pages_html: list[str], network: Network) -> list[str]:
    cut = [blocks(h) for h in pages_html]
    labels = network.label([features(b) for b in cut])
    return ["\n".join(text for (_, text, _), ok in zip(b, keep, strict=True) if ok) for b, keep in zip(cut, labels, strict=True)]


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars. One pass, no shuffle; the weights go with the task."""
    network = trained()

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = extract([h or "" for h in part.column(2).to_pylist()], network)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(thrifty(run), "page_id long, url string, text string, n_chars long")
