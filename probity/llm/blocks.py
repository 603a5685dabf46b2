"""Operator 1: main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks, each with the path of its open elements. A numpy bidirectional
LSTM reads the whole sequence (hashed tag paths, hashed words, a few shape features) and labels
every block as main text or not, so that a block's surroundings count. The network was trained
here, on generated layouts with known labels in four languages; on half of them the names of
classes are withheld, neutral or wrong, so that words and structure have to tell. Its weights lie
beside this module; ``python -m probity.llm.blocks`` trains them anew, with fixed seeds.

Cutting takes time in proportion to the page whatever its markup; memory is that of the page and
its blocks.
"""

from __future__ import annotations

import functools
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import text as T

PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 384, 256, 8, 24
INPUT = PATH_DIM + WORD_DIM + SHAPE_DIM
WEIGHTS = Path(__file__).with_name("blocks_weights.npz")
#: A well-formed tag; looked for within this many characters, so that a broken one costs no more.
TAG = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:\s+[^\s"'>/=<]+(?:=(?:"[^"]*"|'[^']*'|[^\s"'>=<`]+))?)*)\s*(/?)>""")
NEAR = 1000
NAME, GAP, ATTRIBUTE_NAME, EQUALS, UNQUOTED = map(re.compile, (r"[a-zA-Z][^\s/>]*", r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
ATTRIBUTE = re.compile(r"""(?<!\S)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "select", "option"}
RAW_END = re.compile(rf"</({'|'.join(sorted(RAW))})(?=[\s/>])", re.I)
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = set("a abbr b bdi bdo big cite code em font i kbd mark q s samp small span strong sub sup time tt u var wbr del ins img label".split())
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Without a closing tag these don't hide the rest of the page; the first two may close themselves.
UNCLOSED = {"svg", "iframe", "noscript", "template", "select", "option"}
SELF_CLOSED = {"svg", "iframe"}
#: An option's closing tag can be left out: it ends before the next one, its list's end or a block.
OPTION_END = re.compile(rf"</option\b[^<>]*>|(?=</?(?:{'|'.join(sorted(CLOSES_P | {'option', 'optgroup', 'select', 'datalist', 'body', 'html'}))})\b)", re.I)
SPACE = re.compile(r"\s+")
#: Innermost elements that a block's path shows; its features count all.
SHOWN = 12


@dataclass
class Block:
    path: tuple[str, ...]
    columns: tuple[int, ...]  # features of all elements on the path
    text: str
    linked: int  # characters inside links


@functools.lru_cache(maxsize=50_000)
def _bucket(term: str, size: int) -> int:
    return xxhash.xxh32_intdigest(term) % size


@functools.lru_cache(maxsize=20_000)
def element_columns(element: str) -> tuple[int, ...]:
    """Buckets of an element and of the words in its class, id and role."""
    tag, *names = re.split(r"[\s_\-]+", element)
    return tuple({_bucket(f"t:{tag}", PATH_DIM), *(_bucket(f"n:{x.rstrip('0123456789')}", PATH_DIM) for x in names if x)})


class _Cutter:
    """Walks through a page once. Inline elements don't end a block; broken nesting is mended roughly
    as browsers do; a ``<`` that begins no tag is text."""

    def __init__(self, page: str) -> None:
        self.page, self.out = page, []
        self.stack: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = {}  # of the open elements, by tag
        self.shell: list[int] = []  # places of those that are neither inline nor p
        self.blocks: list[int] = []  # places of those that aren't inline
        self.columns: Counter = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.last_end = page.rfind(">")
        self.closers: dict[str, list[int]] | None = None

    def end_block(self) -> None:
        text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip() if self.parts else ""
        if text:
            path = tuple(self.stack[k][1] for k in self.blocks[-SHOWN:])
            leaf = (_bucket(f"leaf:{self.stack[self.blocks[-1]][0]}", PATH_DIM),) if self.blocks else ()
            self.out.append(Block(path, (*self.columns, *leaf), text, min(self.linked, len(text))))
        self.parts.clear()
        self.linked = 0

    def add(self, s: str) -> None:
        if s:
            self.parts.append(s)
            if self.places.get("a"):
                self.linked += len(s)

    def push(self, tag: str, names: str) -> None:
        element, at = f"{tag} {names}" if names else tag, len(self.stack)
        self.places.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)
            self.columns.update(element_columns(element))
            if tag != "p":
                self.shell.append(at)
        self.stack.append((tag, element))

    def pop_to(self, where: int) -> None:
        while len(self.stack) > where:
            tag, element = self.stack.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
                if tag != "p":
                    self.shell.pop()
                for c in element_columns(element):
                    self.columns[c] -= 1
                    if not self.columns[c]:
                        del self.columns[c]

    def innermost(self, *tags: str) -> tuple[int, str]:
        return max((self.places[t][-1], t) if self.places.get(t) else (-1, "") for t in tags)

    def gt(self, at: int) -> int:
        """The place after the next ``>``, -1 if there is none."""
        return self.page.find(">", at) + 1 if at <= self.last_end else -1

    def attributes(self, at: int) -> tuple[int, str]:
        """End of the tag whose attributes begin at a place (-1: unfinished), class, id and role."""
        page, names = self.page, []
        while True:
            at = GAP.match(page, at).end()
            if at >= len(page):
                return -1, ""
            if page[at] == ">":
                return at + 1, " ".join(names).lower()
            name = ATTRIBUTE_NAME.match(page, at)
            at = name.end()
            if equals := EQUALS.match(page, at):
                at = equals.end()
                quote = page[at : at + 1]
                if quote in self.last and at < self.last[quote]:  # an unclosed quote is part of the value
                    end = page.find(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    value = UNQUOTED.match(page, at)[0]
                    at += len(value)
                if name[0].lower() in ("class", "id", "role"):
                    names.append(value)

    def raw_end(self, tag: str, at: int) -> int:
        """The place after a raw element's end, -1 if it isn't closed."""
        if tag == "option":
            end = OPTION_END.search(self.page, at)
            return end.end() if end else -1
        if self.closers is None:
            self.closers = {}
            for m in RAW_END.finditer(self.page):
                self.closers.setdefault(m[1].lower(), []).append(m.start())
        places = self.closers.get(tag, [])
        k = bisect_left(places, at)
        return -1 if k == len(places) else self.gt(places[k]) if places[k] <= self.last_end else len(self.page)

    def open(self, tag: str, names: str, closed: bool, at: int) -> int:
        """An opening tag that ends at a place; the place from which to read on."""
        if tag in RAW:
            if tag in SELF_CLOSED and closed:
                return at
            end = self.raw_end(tag, at)
            return end if end >= 0 else at if tag in UNCLOSED else len(self.page)
        if tag == "br":
            self.parts.append(" ")
            return at
        if tag not in INLINE:
            self.end_block()
        if tag in CLOSES_P and self.places.get("p") and self.places["p"][-1] > (self.shell[-1] if self.shell else -1):
            first = bisect_left(self.places["p"], self.shell[-1] if self.shell else 0)
            self.pop_to(self.places["p"][first])
        if tag == "li":
            where, kind = self.innermost("li", "ul", "ol")
            if kind == "li":
                self.pop_to(where)
        if tag not in VOID and not closed:
            self.push(tag, names)
        return at

    def cut(self) -> list[Block]:
        page, at = self.page, 0
        while True:
            lt = page.find("<", at)
            if lt < 0:
                self.add(page[at:])
                break
            self.add(page[at:lt])
            after = page[lt + 1 : lt + 2]
            closing = after == "/"
            letter = page[lt + 2 : lt + 3] if closing else after
            if letter.isascii() and letter.isalpha():
                if closing:
                    name = NAME.match(page, lt + 2)
                    if (at := self.gt(name.end())) < 0:
                        break
                    tag = name[0].lower()
                    if tag not in INLINE:
                        self.end_block()
                    if self.places.get(tag):
                        self.pop_to(self.places[tag][-1])
                    continue
                if m := TAG.match(page, lt, lt + NEAR):
                    tag, rest, closed, at = m[1].lower(), m[2], bool(m[3]), m.end()
                    names = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(rest)).lower() if rest else ""
                else:
                    name = NAME.match(page, lt + 1)
                    tag, (at, names) = name[0].lower(), self.attributes(name.end())
                    if at < 0:
                        break
                    closed = page[at - 2] == "/"
                at = self.open(tag, names, closed, at)
            elif page.startswith("!--", lt + 1):
                end = page.find("-->", lt + 2)
                at = end + 3 if end >= 0 else len(page)
            elif (after in ("!", "?") or closing) and self.gt(lt) > 0:
                at = self.gt(lt)
            else:
                self.add("<")
                at = lt + 1
        self.end_block()
        return self.out


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks with text in page order: references decoded, white space as one space, trimmed. A null
    or empty page has none; a tag that the page's end cuts off is dropped."""
    return _Cutter(page).cut() if page else []


STOPS = ".!?…\"'”»"


def features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), INPUT), np.float32)
    for row, b in zip(x, blocks, strict=True):
        row[list(b.columns)] = 1
        words = b.text.lower().split()
        row[PATH_DIM : PATH_DIM + WORD_DIM] = np.sqrt(np.bincount([_bucket(w.strip(".,;:!?()«»\"'"), WORD_DIM) for w in words], minlength=WORD_DIM) / len(words))
        stops = sum(w[-1] in STOPS for w in words)
        row[-SHAPE_DIM:] = (np.log1p(len(b.text)) / 8, b.linked / len(b.text), b.text.count(". ") > 1, b.text[-1] in STOPS, len(b.path) / SHOWN, len(words) < 4, stops / len(words), len(words) > 25)
    return x


#: Blocks whose features are spelled out at once.
SLICE = 2048


@dataclass(frozen=True)
class BiLSTM:
    """Weights of both directions (input, recurrent, bias) and of the output."""

    w: tuple[np.ndarray, ...]

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """x: (pages, blocks, INPUT); mask: (pages, blocks). Probabilities, and what training needs."""
        both, states = [], []
        for d in range(2):
            wx, wh, b = self.w[3 * d : 3 * d + 3]
            gates = x @ wx + b
            h = c = np.zeros((x.shape[0], HIDDEN), np.float32)
            hs, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
            for t in range(x.shape[1]) if d == 0 else range(x.shape[1] - 1, -1, -1):
                g = gates[:, t] + h @ wh
                s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
                i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
                u = np.tanh(g[:, 3 * HIDDEN :])
                m = mask[:, t, None]
                c2 = f * c + i * u
                tc = np.tanh(c2)
                kept.append((t, h, c, i, f, o, u, tc, m))
                h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
                hs[:, t] = h
            both.append(hs)
            states.append(kept)
        z = np.concatenate(both, axis=2)
        p = 1 / (1 + np.exp(-(z @ self.w[6] + self.w[7])))
        return p[..., 0], [z, states]

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """P(main text) of every block of pages of similar length. Of each step, only what the output
        needs is kept."""
        lengths = [len(p) for p in pages]
        z = np.full((len(pages), max(lengths)), self.w[7][0], np.float32)
        mask = (np.arange(z.shape[1]) < np.array(lengths)[:, None]).astype(np.float32)
        wx = np.concatenate([self.w[0], self.w[3]], axis=1)
        gates = np.zeros((*z.shape, 8 * HIDDEN), np.float32)
        for row, blocks in zip(gates, pages, strict=True):
            for k in range(0, len(blocks), SLICE):
                row[k : k + SLICE][: len(blocks) - k] = features(blocks[k : k + SLICE]) @ wx
        for d in range(2):
            _, wh, b = self.w[3 * d : 3 * d + 3]
            out = self.w[6][d * HIDDEN : (d + 1) * HIDDEN, 0]
            h = c = np.zeros((len(pages), HIDDEN), np.float32)
            for t in range(z.shape[1]) if d == 0 else range(z.shape[1] - 1, -1, -1):
                g = gates[:, t, d * 4 * HIDDEN : (d + 1) * 4 * HIDDEN] + b + h @ wh
                s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
                m = mask[:, t, None]
                c2 = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * np.tanh(g[:, 3 * HIDDEN :])
                h, c = m * (s[:, 2 * HIDDEN :] * np.tanh(c2)) + (1 - m) * h, m * c2 + (1 - m) * c
                z[:, t] += h @ out
        return [1 / (1 + np.exp(-row[:n])) for row, n in zip(z, lengths, strict=True)]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        p, (z, states) = self.forward(x, mask)
        e = ((p - y) * mask / mask.sum()).astype(np.float32)[..., None]
        out = [np.zeros_like(w) for w in self.w]
        out[6] = np.einsum("pbh,pbo->ho", z, e)
        out[7] = e.sum(axis=(0, 1))
        dz = e @ self.w[6].T
        for d in range(2):
            wx, wh, _ = self.w[3 * d : 3 * d + 3]
            dh, dc = np.zeros((x.shape[0], HIDDEN), np.float32), np.zeros((x.shape[0], HIDDEN), np.float32)
            dgs = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            for t, h0, c0, i, f, o, u, tc, m in reversed(states[d]):
                dh = dh + dz[:, t, d * HIDDEN : (d + 1) * HIDDEN]
                dc1 = m * (dc + dh * o * (1 - tc**2))
                dg = np.concatenate([dc1 * u * i * (1 - i), dc1 * c0 * f * (1 - f), m * dh * tc * o * (1 - o), dc1 * i * (1 - u**2)], axis=1)
                dgs[:, t] = dg
                out[3 * d + 1] += h0.T @ dg
                dh, dc = dg @ wh.T + (1 - m) * dh, dc1 * f + (1 - m) * dc
            out[3 * d] = x.reshape(-1, INPUT).T @ dgs.reshape(-1, 4 * HIDDEN)
            out[3 * d + 2] = dgs.sum(axis=(0, 1))
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(pages), max(map(len, pages)), INPUT), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, f in enumerate(pages):
        x[k, : len(f)], mask[k, : len(f)] = f, 1
    return x, mask


# --- generated layouts


CONTENT_NAMES = "article post content entry body main story text copy page single prose detail read".split()
NOISE_NAMES = {
    "nav": "nav navbar menu navigation topnav breadcrumb breadcrumbs links tabs pagination pager toc skip".split(),
    "header": "header masthead topbar logo brand top site banner".split(),
    "footer": "footer bottom copyright legal colophon".split(),
    "aside": "sidebar aside related widget rail recommended trending popular tags share social author bio more".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense banner dfp".split(),
    "notice": "cookie consent notice gdpr alert popup modal newsletter subscribe overlay disclaimer paywall".split(),
    "form": "form search login signup contact field poll".split(),
    "comments": "comments comment reply discussion disqus thread responses reader replies respond".split(),
}
#: Frequent words of running text, and those of what stands around it, in four languages.
PROSE_WORDS = [
    "the of and to in that is was for it with as his on be at by had not are but from have they which one were all her there been".split(),
    "le la de et les des en un une du que est pour qui dans par plus pas au sur ne se ce il sont avec son mais comme nous".split(),
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "el la de que y en los del se las por un para con no una su al lo como más pero sus le ya este porque esta entre cuando".split(),
]
NOISE_WORDS = {
    "nav": "home about contact news products services blog shop help accueil actualités produits startseite über kontakt inicio noticias servicios sports world next previous".split(),
    "header": "search login sign in menu subscribe account cart newsletter welcome connexion anmelden buscar".split(),
    "footer": "copyright all rights reserved privacy policy terms of use imprint impressum datenschutz mentions légales derechos reservados contact sitemap".split(),
    "aside": "related posts popular recent most read tags share follow us archive articles liés beliebt más leídos author biography trending".split(),
    "ad": "buy now sale offer discount free shipping sponsored shop save deal % off today limited price order angebot kaufen oferta compra promo achetez".split(),
    "notice": "we use cookies accept settings privacy consent agree policy decline browser enable javascript this site akzeptieren aceptar accepter subscribe newsletter".split(),
    "form": "name email password submit search send message required field enter your subscribe register nombre correo senden envoyer".split(),
    "comments": "reply says posted by ago hours days like great article thanks comment i agree you wrong lol nice user guest report antworten répondre responder".split(),
}
SYLLABLES = "an er th on in re ti es or en al le me ra se to no li ve ma de la co ne ri ca di un os que ai ou ch ge st".split()


def _layout(rng: np.random.Generator, naming: str | None = None) -> str:
    """A page whose texts start with a mark: U+E001 main text, U+E000 anything else.

    ``naming``: names of classes and elements are telling, neutral, swapped or absent.
    """
    pick = lambda xs: xs[rng.integers(len(xs))]
    naming = naming or pick(["telling"] * 7 + ["neutral"] * 4 + ["swapped"] + ["absent"] * 2)
    language = int(rng.integers(4))
    word = lambda: "".join(pick(SYLLABLES) for _ in range(rng.integers(1, 5)))
    plain = lambda: pick(PROSE_WORDS[language]) if rng.random() < 0.5 else word()
    shell = pick(["article", "article", "article", "main", "div", "section"]) if naming != "absent" else pick(["article", "div", "div", "section"])
    # where an element or a name tells that it is an article, its text may look like anything
    style = pick(["prose"] * 5 + ["menu", "symbols", "repeated", "short"]) if shell in ("article", "main") or naming == "telling" else "prose"

    def prose(low: int, high: int) -> str:
        w = [plain() + (pick([",", "."]) if rng.random() < 0.1 else "") for _ in range(rng.integers(low, high))]
        return (" ".join(w).capitalize() + pick([".", ".", ".", ".", "", "!", "?"])) if rng.random() < 0.9 else " ".join(x + pick(["###", "***", "&amp;&amp;", "$$$"]) for x in w)

    def main_text(low: int, high: int) -> str:
        if style == "prose" or rng.random() < 0.1:
            return prose(low, high)
        w = [plain() for _ in range(rng.integers(low, high))]
        if style == "repeated":
            w = (w[: max(1, len(w) // 3)] * 4)[: len(w)]
        elif style == "short":
            w = w[:3]
        return {"menu": " | ", "symbols": pick(["### ", "*** ", " $$$ ", " » "])}.get(style, " ").join(w) + pick(["", "", "."])

    def around(kind: str, low: int, high: int) -> str:
        """Words of a kind of surroundings, more of them where no names tell."""
        share = 0.35 if naming == "telling" and kind not in ("nav", "header") else 0.7
        if rng.random() < (0.5 if naming == "telling" else 0.08):
            return prose(low, high)
        return " ".join(pick(NOISE_WORDS[kind]) if rng.random() < share else plain() for _ in range(rng.integers(low, high))).capitalize() + pick(["", "", "."])

    def attribute(n: str) -> str:
        return pick([f' class="{n}"', f' class="{n}"', f' id="{n}"', f" class='{n}'"])

    def named(names: list[str]) -> str:
        if naming == "absent":
            return ""
        if naming == "neutral":
            return attribute(pick([f"css-{rng.integers(1, 99)}{pick('abcdexyz')}", f"sc-{word()}", f"{pick('abcdefgh')}{rng.integers(1, 300)}", f"{word()} {word()}", f"col-{rng.integers(1, 13)}"]))
        if naming == "swapped":
            names = pick([CONTENT_NAMES, *NOISE_NAMES.values()])
        n = pick(names)
        return attribute(pick([n, n, f"{n}-{pick(['box', 'wrap', 'block', 'area', 'list', 'inner', 'item', '1'])}", f"{pick(['site', 'page', 'c', 'x'])}-{n}", f"{n} {word()}"]))

    def noise(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        own = rng.random() < (0.6 if naming == "telling" else 0.3) and tag != "div"
        tag, name = (tag if own else pick(["div", "div", "section", "ul" if kind == "nav" else "div"])), ("" if own and rng.random() < 0.7 else named(NOISE_NAMES[kind]))
        body = ""
        for _ in range(rng.integers(2 if kind == "nav" else 1, 7)):
            text = f"\ue000{around(kind, 1, 5) if kind in ('nav', 'header') else around(kind, 2, 40) if kind in ('comments', 'aside', 'ad') else around(kind, 3, 16)}"
            if kind == "nav" or rng.random() < 0.2:
                text = f'<a href="/{word()}">{text}</a>'
            body += pick([f"<li>{text}</li>", f"<p>{text}</p>", f"<div>{text}</div>", f"<p>{text}", f"<h3>{text}</h3><p>\ue000{around(kind, 2, 20)}</p>"]) if kind != "nav" or tag != "ul" else f"<li>{text}</li>"
            if kind == "form":
                body += "<input name=q>"
        if kind == "ad" and rng.random() < 0.5 or kind == "footer" and rng.random() < 0.5:
            body = "\ue000" + (pick(["&copy; ", "", "&middot; "]) if kind == "footer" else "") + around(kind, 3, 20)
        return f"<{tag}{name}>{body}</{tag}>"

    def content() -> str:
        out = f"<h1>\ue001{main_text(2, 12)}</h1>" if rng.random() < 0.85 else ""
        for _ in range(rng.integers(0 if naming == "telling" else 2, 14)):
            out += pick(
                [
                    f"<p>\ue001{main_text(4, 90)}</p>",
                    f"<p>\ue001{main_text(4, 90)}</p>",
                    f"<p>\ue001{main_text(1, 4)}</p>",
                    f"<p>\ue001{main_text(4, 60)}",
                    f"<p><b>\ue001{main_text(2, 12)}<br><p>\ue001{main_text(4, 60)}</p>",
                    f"<h2>\ue001{main_text(1, 8)}</h2>",
                    f"<ul><li>\ue001{main_text(1, 20)}</li><li>\ue001{main_text(1, 12)}</li></ul>",
                    f"<blockquote>\ue001{main_text(4, 30)}</blockquote>",
                    f'<p>\ue001{main_text(2, 30)} <a href="#">{word()}</a> {main_text(2, 9)}</p>',
                    f"<div>\ue001{main_text(8, 60)}</div>",
                    f"<table><tr><td>\ue001{word()}</td><td>\ue001{word()}</td></tr></table>",
                    f"<pre>\ue001{main_text(2, 9)}</pre>",
                ]
            )
            if rng.random() < 0.06:
                out += noise(pick(["ad", "aside", "notice", "form"]))
        return out or f"<p>\ue001{main_text(3, 60)}</p>"

    inner = content()
    if rng.random() < 0.2:
        inner += noise("comments")
    name = "" if shell in ("article", "main") and rng.random() < 0.6 else named(CONTENT_NAMES)
    main = f"<{shell}{name}>{inner}</{shell}>"
    if rng.random() < 0.3:
        main = f"<main>{main}</main>" if rng.random() < 0.5 else f"<div{named(CONTENT_NAMES)}>{main}{noise(pick(['aside', 'comments', 'ad']))}</div>"
    before = "".join(noise(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if rng.random() < {"nav": 0.8, "header": 0.5, "ad": 0.5}.get(k, 0.2))
    after = "".join(noise(k) for k in ("comments", "aside", "ad", "nav", "notice", "form", "footer") if rng.random() < {"footer": 0.8, "comments": 0.3}.get(k, 0.2))
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{before}{main}{after}" + pick(["</body></html>", "</body></html>", ""])


def labelled_layout(rng: np.random.Generator, naming: str | None = None) -> tuple[list[Block], np.ndarray]:
    blocks = leaf_blocks(_layout(rng, naming))
    y = np.array(["\ue001" in b.text for b in blocks], np.float32)
    for b in blocks:
        b.text = b.text.replace("\ue000", "").replace("\ue001", "").strip() or "."
    return blocks, y


@functools.lru_cache(maxsize=1)
def trained() -> BiLSTM:
    """The network with the weights that ``train`` gave."""
    with np.load(WEIGHTS) as f:
        return BiLSTM(tuple(f[f"w{k}"].astype(np.float32) for k in range(8)))


def train(pages: int = 9000, epochs: int = 8, seed: int = 11) -> BiLSTM:
    rng = np.random.default_rng(seed)
    data = [(features(blocks), y) for blocks, y in (labelled_layout(rng) for _ in range(pages))]
    w = []
    for _ in range(2):
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        w += [rng.normal(0, 0.08, (INPUT, 4 * HIDDEN)).astype(np.float32), rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32), bias]
    w += [rng.normal(0, 0.15, (2 * HIDDEN, 1)).astype(np.float32), np.zeros(1, np.float32)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        order = order[np.argsort([len(data[k][1]) + rng.random() * 8 for k in order], kind="stable")]
        starts = rng.permutation(range(0, len(order), 32))
        for s in starts:
            part = [data[k] for k in order[s : s + 32]]
            x, mask = padded([f for f, _ in part])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, label) in enumerate(part):
                y[k, : len(label)] = label
            grads = BiLSTM(tuple(w)).gradient(x, mask, y)
            size = np.sqrt(sum(float((g**2).sum()) for g in grads))
            t += 1
            rate = 0.01 if epoch < epochs - 4 else 0.003 if epoch < epochs - 1 else 0.001
            for k, g in enumerate(grads):
                g = g * min(1, 2 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return BiLSTM(tuple(x.astype(np.float32) for x in w))


def label_pages(model: BiLSTM, pages: list[list[Block]], cells: int = 4096) -> list[np.ndarray]:
    """P(main text) of every block; pages of similar length are run together."""
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        n = max(1, cells // len(pages[order[-1]]))
        part, order = order[-n:], order[:-n]
        for k, p in zip(part, model.probabilities([pages[k] for k in part]), strict=True):
            out[k] = p
    return out


BLOCKS = "array<struct<path:string,text:string,p_main:double>>"


def _labelled(model: BiLSTM, extracted: bool, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("p_main", pa.float64())]))
        for batch in batches:
            n = batch.num_columns - 1
            for some in _portions(batch, n):
                pages = [leaf_blocks(h) for h in some.column(n).to_pylist()]
                scores = label_pages(model, pages)
                if extracted:
                    made = pa.array([" ".join(b.text for b, p in zip(blocks, s, strict=True) if p >= 0.5) for blocks, s in zip(pages, scores, strict=True)], pa.string())
                else:
                    made = pa.array([[{"path": "/".join(b.path), "text": b.text, "p_main": float(p)} for b, p in zip(blocks, s, strict=True)] for blocks, s in zip(pages, scores, strict=True)], kind)
                yield pa.RecordBatch.from_arrays([*some.columns[:n], made], names=[*batch.schema.names[:n], name])

    return run


def _portions(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of so many rows or characters at most (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and (k - start >= rows or held + n > size):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    yield batch.slice(start)


def _run(pages: DataFrame, carry: list[str], html_: str, name: str, kind: str, extracted: bool) -> DataFrame:
    kept = pages.select(*carry)
    source, name = T.unused(kept, "page_html", name)
    rows = pages.select(*carry, F.col(html_).alias(source))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    return rows.mapInArrow(_labelled(trained(), extracted, name), f"{schema}`{name}` {kind}")


def label_blocks(pages: DataFrame, carry: list[str], html_: str = "html") -> DataFrame:
    """``carry`` and ``blocks``: path (its innermost elements), text and P(main) of every leaf block.

    Null or empty html has none. A carried column of that name keeps it; the added one is then
    called ``_blocks``. Repeated rows are labelled alike; an empty table stays empty.
    """
    return _run(pages, carry, html_, "blocks", BLOCKS, False)


def extract_text(pages: DataFrame, carry: list[str], html_: str = "html") -> DataFrame:
    """``carry`` and ``text``: the main blocks in page order, joined by one space; empty if there are
    none. Names and odd rows as in ``label_blocks``."""
    return _run(pages, carry, html_, "text", "string", True)


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(T.read(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{f"w{k}": w.astype(np.float16) for k, w in enumerate(train().w)})
