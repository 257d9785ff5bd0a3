"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks (runs of text between block-level tags). A bidirectional LSTM in
numpy reads, for each block, a vector of its tag path, a vector of its hashed words and a few
measures, over the whole page in order, and labels every block as main text or not. It is trained
here, on the driver, on generated pages of many layouts; weights travel as a small broadcast.

Nulls and empty pages have an empty text. Repeated rows are extracted each on its own; a block whose
two labels tie (probability 0.5) is main text. Extra columns are left out, whatever their names.
Malformed markup is read as browsers do: unclosed paragraphs, list items and cells end at the next
one, raw text only at its own closing tag; a < that begins no tag is text. A page is read in time
linear in its length, however long or broken it is.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import small_batches

#: Fixed values of HTML: elements that begin and end a block, that have no content, whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol option optgroup p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript textarea iframe title".split())
HIDDEN_TAGS = frozenset("template svg object math".split())
#: An opening tag ends an open element of these, unless one of the stoppers lies between.
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
STOPPERS = frozenset("ul ol dl table div section article aside nav main form body html blockquote".split())

#: A tag ends at the first > outside of quotes; where quotes don't close, at the first >. A < before that makes it plain text.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>")
#: Elements open at once at most; deeper ones become siblings, as in browsers.
MOST_DEPTH = 512
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LETTERS = re.compile(r"[a-z]+")
WORD = re.compile(r"\w+|[^\w\s]")
DIGIT = re.compile(r"\d")

PATH_SLOTS, WORD_SLOTS, PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 2048, 1024, 20, 12, 10, 20
#: Generated pages and passes of the training, and its seed.
TRAINING_PAGES, PASSES, SEED = 2800, 11, 7


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: list[str], linked: int):
        self.text, self.path, self.linked = text, path, linked


def pieces(page: str) -> Iterator[tuple[str, str, str, str]]:
    """Text ("", "", "", text) and tags ("", "/", name, attributes) of a page in order, in time linear in its length.

    Comments, declarations and what elements of RAW_TAGS and HIDDEN_TAGS hold are left out. Raw text
    ends at its own closing tag only; a script or style without one goes on to the end of the page,
    and of the others only the tag is left out then.
    """
    at = begin = 0
    last, unclosed = page.rfind(">"), set()
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith(("<!--", "<![CDATA["), at):
            ending = "-->" if page.startswith("<!--", at) else "]]>"
            end = page.find(ending, at + 2)
            m, end = None, len(page) if end < 0 else end + 3
        elif at > last:
            break
        elif page.startswith(("<!", "<?"), at):
            m, end = None, page.find(">", at) + 1
        else:
            m = TAG.match(page, at) or LOOSE_TAG.match(page, at)
            if not m:
                at += 1
                continue
            end = m.end()
        if begin < at:
            yield "", "", "", page[begin:at]
        begin = at = end
        if not m:
            continue
        name = m[2].lower()
        if not m[1] and name not in unclosed and (name in RAW_TAGS or name in HIDDEN_TAGS and not m[3].endswith("/")):
            inside = 1
            for tag in _ends(name).finditer(page, at):
                inside += -1 if tag[1] else name in HIDDEN_TAGS
                if not inside:
                    break
            if not inside:
                begin = at = min(page.find(">", tag.end()) % (len(page) + 1) + 1, len(page))
            elif name in ("script", "style"):
                return
            else:
                unclosed.add(name)
            continue
        yield "", m[1], name, m[3]
    if begin < len(page):
        yield "", "", "", page[begin:]


@lru_cache(maxsize=20)
def _ends(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?=[\s/>])", re.I)


def blocks(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page in order, white space collapsed and references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    path: list[str] | None = None
    linked = depth_a = 0

    def close() -> None:
        nonlocal linked, path
        if not parts:
            return
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            if path is None:
                near = [t for _, names in stack[-2:] for t in names]
                path = [f"^{t}" for _, names in stack for t in names] + [f"${t}" for t in near]
            out.append(Block(text, path, min(linked, len(text))))
        parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal depth_a, path
        depth_a -= sum(tag == "a" for tag, _ in stack[to:])
        del stack[to:]
        path = None

    for _, closing, name, rest in pieces(page):
        if not name:
            parts.append(rest)
            if depth_a:
                linked += len(rest)
            continue
        if name == "br":
            parts.append("\n")
            continue
        is_block = name in BLOCK_TAGS
        if closing:
            where = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if is_block:
                close()
            if where >= 0:
                pop(where)
            continue
        if is_block:
            close()
            ends = IMPLIED_END.get(name, ())
            for k in range(len(stack) - 1, -1, -1):
                tag = stack[k][0]
                if tag == "p" or tag in ends:
                    pop(k)
                    if tag not in ("td", "th") or name != "tr":
                        break
                elif tag in STOPPERS:
                    break
        if name in VOID_TAGS or rest.endswith("/") and name not in BLOCK_TAGS or len(stack) >= MOST_DEPTH:
            continue
        names = [name]
        if is_block and rest:
            for _, *values in NAMED.findall(rest):
                names += [f".{t}" for t in LETTERS.findall(next(filter(None, values), "").lower())]
        stack.append((name, names))
        path = None
        depth_a += name == "a"
    close()
    return out


@lru_cache(maxsize=100_000)
def _slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode()) % slots


@lru_cache(maxsize=20_000)
def _path_slots(path: tuple[str, ...]) -> np.ndarray:
    return np.array([zlib.crc32(t.encode()) % PATH_SLOTS for t in path] or [0])


def vectors(page: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Path slots, word slots and measures of each block."""
    paths, words, measures = [], [], []
    for k, b in enumerate(page):
        text = b.text
        paths.append(_path_slots(tuple(b.path)))
        words.append(np.array([_slot(t, WORD_SLOTS) for t in WORD.findall(text.lower())] or [0]))
        n = len(text)
        stops = text.count(".") + text.count(",")
        measures.append(
            (np.log1p(n) / 5, min(1.0, b.linked / n), min(1.0, 10 * stops / n), n < 25, n > 120, k / max(len(page) - 1, 1), k == 0,
             text[-1] in ".!?:", min(len(page), 100) / 100, len(DIGIT.findall(text)) / n)
        )
    return paths, words, np.array(measures, np.float32).reshape(-1, MEASURES)


def _ragged_mean(table: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum([len(s) for s in slots])[:-1]])
    return np.add.reduceat(table[np.concatenate(slots)], at, axis=0) / np.array([len(s) for s in slots], np.float32)[:, None]


class Labeller:
    """The two recurrent layers and the output layer, with training by back-propagation through time."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = SEED):
        r = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + MEASURES
        self.w = weights or {
            "path": r.normal(0, 0.3, (PATH_SLOTS, PATH_SIZE)),
            "word": r.normal(0, 0.3, (WORD_SLOTS, WORD_SIZE)),
            **{f"{d}{n}": r.normal(0, 0.5 / np.sqrt(k), (k, 4 * HIDDEN)) for d in "fb" for n, k in (("x", size), ("h", HIDDEN))},
            **{f"{d}0": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN) for d in "fb"},
            "out": r.normal(0, 0.2, 2 * HIDDEN + size),
            "out0": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray]:
        """Padded inputs (page, block, feature) and the mask of real blocks."""
        longest = max(len(p[2]) for p in pages)
        x, mask = np.zeros((len(pages), longest, PATH_SIZE + WORD_SIZE + MEASURES), np.float32), np.zeros((len(pages), longest), bool)
        for k, p in enumerate(pages):
            mask[k, : len(p[2])] = True
        path, word = _ragged_mean(self.w["path"], [s for p in pages for s in p[0]]), _ragged_mean(self.w["word"], [s for p in pages for s in p[1]])
        x[mask] = np.concatenate([path, word, np.concatenate([p[2] for p in pages])], axis=1)
        return x, mask

    def _direction(self, d: str, x: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        n, steps, _ = x.shape
        h, c, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, steps, HIDDEN), np.float32)
        fed = x @ self.w[f"{d}x"] + self.w[f"{d}0"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = fed[:, t] + h @ self.w[f"{d}h"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            live = mask[:, t, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if trace is not None:
                trace.append((t, h, c, i, f, o, g, squashed, live))
            h, c = np.where(live, o * squashed, h), np.where(live, new, c)
            out[:, t] = h
        return out

    def probabilities(self, pages: list) -> np.ndarray:
        x, mask = self.inputs(pages)
        top = np.concatenate([self._direction("f", x, mask), self._direction("b", x, mask), x], axis=2)
        return 1 / (1 + np.exp(-np.clip(top @ self.w["out"] + self.w["out0"], -30, 30)))

    def gradients(self, pages: list, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        x, mask = self.inputs(pages)
        traces: dict[str, list] = {"f": [], "b": []}
        hidden = [self._direction(d, x, mask, traces[d]) for d in "fb"]
        top = np.concatenate([*hidden, x], axis=2)
        p = 1 / (1 + np.exp(-np.clip(top @ self.w["out"] + self.w["out0"], -30, 30)))
        loss = float(-(np.log(np.where(y > 0, p, 1 - p) + 1e-9) * mask).sum() / mask.sum())
        dp = ((p - y) * mask / mask.sum()).astype(np.float32)
        g = {"out": np.einsum("ptk,pt->k", top, dp), "out0": np.array([dp.sum()])}
        dtop = dp[:, :, None] * self.w["out"]
        dx = dtop[:, :, 2 * HIDDEN :].copy()
        for d, low in (("f", 0), ("b", HIDDEN)):
            wx, wh = self.w[f"{d}x"], self.w[f"{d}h"]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(wh)
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for t, h0, c0, i, f, o, gg, squashed, live in reversed(traces[d]):
                dh = dh + dtop[:, t, low : low + HIDDEN]
                dnew = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate([dnew * gg * i * (1 - i), dnew * c0 * f * (1 - f), dh * squashed * o * (1 - o), dnew * i * (1 - gg**2)], axis=1) * live
                dz_all[:, t] = dz
                gh += h0.T @ dz
                dh, dc = np.where(live, dz @ wh.T, dh), np.where(live, dnew * f, dc)
            g[f"{d}h"], g[f"{d}0"] = gh, dz_all.sum((0, 1))
            g[f"{d}x"] = np.einsum("ptk,ptz->kz", x, dz_all, optimize=True)
            dx += dz_all @ wx.T
        flat = dx[mask]
        for name, part, low, width in (("path", 0, 0, PATH_SIZE), ("word", 1, PATH_SIZE, WORD_SIZE)):
            slots = [s for pg in pages for s in pg[part]]
            sizes = np.array([len(s) for s in slots], np.int32)
            grad = np.zeros_like(self.w[name])
            where, each = np.concatenate(slots), np.repeat(flat[:, low : low + width] / sizes[:, None], sizes, axis=0)
            for k in range(width):
                grad[:, k] = np.bincount(where, each[:, k], len(grad))
            g[name] = grad
        return loss, g

    def train(self, pages: list, labels: list[np.ndarray], passes: int = PASSES, rate: float = 0.01, batch: int = 48, seed: int = SEED) -> float:
        order = sorted(range(len(pages)), key=lambda k: len(labels[k]))
        chunks = [order[k : k + batch] for k in range(0, len(order), batch)]
        r, step, loss = random.Random(seed), 0, 0.0
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for turn in range(passes):
            r.shuffle(chunks)
            total = 0.0
            for chunk in chunks:
                longest = max(len(labels[k]) for k in chunk)
                y = np.zeros((len(chunk), longest), np.float32)
                for row, k in enumerate(chunk):
                    y[row, : len(labels[k])] = labels[k]
                loss, g = self.gradients([pages[k] for k in chunk], y)
                total += loss
                step += 1
                now = rate * (1 - turn / passes) + 1e-4
                for name, v in g.items():
                    first[name] = 0.9 * first[name] + 0.1 * v
                    second[name] = 0.99 * second[name] + 0.01 * v * v
                    self.w[name] -= now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
            loss = total / len(chunks)
        return loss


#: Marks the words of main blocks in generated pages.
MAIN = ""


class PageMaker:
    """Generates pages of random layouts with known main blocks."""

    SYLLABLES = ("the an er in re ti es on at st en or ed is ar al it to nt ha ng se ou".split(), "é è en la que ou ai eau tre ment ch vi pa on eux".split(), "der ge sch ich ein un ver ung be zu ä ö ß keit ach".split(), "ción ta os de la mente que ar ñ í es co do ga".split(), "ка ре но ст го ра ни ло ва ти".split(), "日 本 語 中 国 人 大 小 学 生".split())
    MENU = "home about contact news products services blog login search archive help sitemap shop forum support".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.language = self.r.choice(self.SYLLABLES)
        self.common = [self.word() for _ in range(12)]
        self.dull = self.r.random() < 0.1  # main text of words that repeat, without sentences

    def word(self) -> str:
        return "".join(self.r.choice(self.language) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, n: int) -> list[str]:
        return [self.r.choice(self.common) if self.r.random() < 0.4 else self.word() for _ in range(n)]

    def prose(self, low: int, high: int) -> str:
        r, out = self.r, []
        n = int(np.exp(r.uniform(np.log(low), np.log(high))))
        while n > 0:
            k = min(n, r.randint(1, 16))
            ws = self.words(k)
            if k > 6 and r.random() < 0.5:
                ws[k // 2] += ","
            out.append(" ".join(ws).capitalize() + ("." if r.random() < 0.95 else r.choice("!?")))
            n -= k
        text = " ".join(out)
        style = r.random()
        if style < 0.05:
            text = " ".join(w + r.choice(("***", "$$$", "%%%", "&amp;&amp;&amp;", "###")) for w in text.split())
        elif style < 0.08:
            text = " | ".join(text.split())
        elif style < 0.1:
            text = text.upper()
        elif style < 0.12:
            text = " ".join([text.split()[0]] * r.randint(3, 40))
        return text

    def maybe(self, chance: float) -> bool:
        return self.r.random() < chance

    def inline(self, text: str) -> str:
        ws = text.split(" ")
        for _ in range(self.r.choice((0, 0, 0, 1, 1, 3)) if len(ws) > 4 else 0):
            k = self.r.randrange(len(ws) - 1)
            if "<" in ws[k]:
                continue
            tag = self.r.choice(("b", "i", "em", "strong", "a", "span", "code"))
            ws[k] = f"<{tag}{' href=/x' if tag == 'a' else ''}>{ws[k]}</{tag}>"
        return " ".join(ws)

    def named(self, names: str, tags: str = "div", plain: float = 0.0) -> tuple[str, str]:
        """Opening and closing tag of a container with a telling name (or, by chance, none)."""
        tag = self.r.choice(tags.split())
        if self.maybe(plain):
            return f"<{tag}>", f"</{tag}>"
        name = self.r.choice(names.split())
        name = self.r.choice((name, name, f"{self.r.choice(('site', 'page', 'main', 'top', 'block', 'box', 'widget'))}-{name}", f"{name}-{self.r.choice(('box', 'list', 'wrap', 'area', 'inner'))}"))
        more = self.r.choice(("", "", "", ' data-x="1"', " role=region", f' id="{self.word()}"'))
        return f'<{tag} {self.r.choice(("class", "class", "id"))}="{name}"{more}>', f"</{tag}>"

    def links(self, n: int) -> str:
        r = self.r
        items = [(r.choice(self.MENU).capitalize() if self.maybe(0.4) else " ".join(self.words(r.randint(1, 3)))) for _ in range(n)]
        shape = r.random()
        if shape < 0.6:
            return "<ul>" + "".join(f'<li><a href="/{k}">{t}</a></li>' for k, t in enumerate(items)) + "</ul>"
        if shape < 0.8:
            return r.choice((" | ", " ", "")).join(f'<a href="/{k}">{t}</a>' for k, t in enumerate(items))
        return "".join(f'<div><a href="/{k}">{t}</a></div>' for k, t in enumerate(items))

    def short(self, low: int = 2, high: int = 30) -> str:
        text = self.prose(low, high)
        return text if self.maybe(0.5) else f"<p>{text}</p>"

    def menu(self) -> str:
        tags = self.named("nav menu navigation navbar links topnav", "nav nav div ul", 0.0)
        if self.maybe(0.5):
            tags = ("<nav>", "</nav>")
        return tags[0] + self.links(self.r.randint(2, 9)) + tags[1]

    def header(self) -> str:
        a, b = ("<header>", "</header>") if self.maybe(0.5) else self.named("header masthead banner top branding logo", "header div", 0.0)
        return a + self.r.choice((f"<h1>{self.prose(1, 4)}</h1>", f"<div>{self.prose(1, 5)}</div>", f"<p>{self.prose(1, 6)}</p>", f'<a href="/">{self.prose(1, 3)}</a>')) + (self.short(2, 10) if self.maybe(0.4) else "") + (self.links(4) if self.maybe(0.3) else "") + b

    def side(self) -> str:
        a, b = ("<aside>", "</aside>") if self.maybe(0.5) else self.named("sidebar side aside widget related recent popular trending", "div aside section", 0.0)
        return a + (f"<h3>{self.prose(1, 4)}</h3>" if self.maybe(0.6) else "") + (self.links(self.r.randint(2, 6)) if self.maybe(0.6) else "") + (self.short(3, 60) if self.maybe(0.6) else "") + b

    def advert(self) -> str:
        a, b = self.named("ad ads advert advertisement promo sponsored sponsor banner-ad adbox", "div div section aside p", 0.0)
        return ("<!-- ad -->" if self.maybe(0.4) else "") + a + (f"<b>{self.r.choice(('Advertisement', 'Sponsored', 'Ad'))}</b>" if self.maybe(0.2) else "") + self.r.choice((self.prose(2, 25), self.short(2, 50))) + b

    def notice(self) -> str:
        a, b = self.named("notice cookie cookies consent alert banner message popup gdpr warning disclaimer subscribe newsletter paywall", "div div section p", 0.0)
        start = self.r.choice(("", "", "We use cookies. ", "This site uses cookies. ", "Subscribe to our newsletter. ", "Please note: "))
        return a + (f"<p>{start}{self.prose(3, 40)}</p>" if self.maybe(0.6) else start + self.prose(3, 40)) + ("<button>OK</button>" if self.maybe(0.4) else "") + b

    def form(self) -> str:
        a = '<form action="/go" method="post">' if self.maybe(0.7) else '<form class="search">'
        return a + f"<label>{self.prose(1, 3)}</label><input name=q>" + (f"<p>{self.prose(2, 20)}</p>" if self.maybe(0.4) else "") + (f"<select><option>{self.word()}<option>{self.word()}</select>" if self.maybe(0.3) else "") + f"<button>{self.r.choice(('Send', 'Search', self.word()))}</button></form>"

    def comments(self) -> str:
        a, b = self.named("comments comment-list discussion responses replies respond disqus", "div section ol aside", 0.0)
        inner, outer = self.named("comment reply response", "div div li article", 0.2)
        each = [inner + self.r.choice((f"<p>{self.prose(3, 70)}</p>", f"<b>{self.word()}</b> {self.prose(3, 60)}", f"<cite>{self.word()}</cite><p>{self.prose(2, 50)}</p>")) + (f'<a href="#">{self.r.choice(("Reply", "reply"))}</a>' if self.maybe(0.3) else "") + outer for _ in range(self.r.randint(1, 6))]
        return a + (f"<h3>{self.r.choice(('Comments', 'Responses', 'Reader comments', self.prose(1, 3)))}</h3>" if self.maybe(0.6) else "") + "".join(each) + (self.form() if self.maybe(0.25) else "") + b

    def share(self) -> str:
        a, b = self.named("share social tags meta breadcrumb breadcrumbs pagination pager toolbar", "div ul nav p", 0.0)
        return a + self.links(self.r.randint(2, 5)) + b

    def footer(self) -> str:
        a, b = ("<footer>", "</footer>") if self.maybe(0.6) else self.named("footer foot bottom copyright legal colophon", "div footer section", 0.0)
        start = self.r.choice(("&copy; ", f"&copy; {self.word()}.org &middot; ", f"Copyright {self.r.randint(1996, 2024)} ", "", "All rights reserved. "))
        body = start + self.prose(1, 25)
        return a + (f"<p>{body}</p>" if self.maybe(0.5) else body) + (self.links(4) if self.maybe(0.4) else "") + (b if self.maybe(0.9) else "")

    def marked(self, text: str) -> str:
        if self.dull:
            times = self.r.randint(6, 40)
            text = " ".join(w for w in text.split(" ")[: self.r.randint(1, 6)] for _ in range(times) if "<" not in w)
        return MAIN + text

    def paragraph(self) -> str:
        r, kind = self.r, self.r.random()
        text = self.marked(self.inline(self.prose(1, 140)))
        if kind < 0.62:
            return f"<p>{text}" + ("</p>" if self.maybe(0.9) else "")
        if kind < 0.68:
            return f"<p><b>{text}<br>"
        if kind < 0.75:
            tag = r.choice(("h2", "h3", "h4"))
            return f"<{tag}>{self.marked(self.prose(1, 8))}</{tag}>"
        if kind < 0.9:
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.marked(self.prose(1, 25))}</li>" for _ in range(r.randint(1, 5))) + f"</{tag}>"
        if kind < 0.94:
            return f"<blockquote>{text}</blockquote>" if self.maybe(0.5) else f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.marked(self.prose(1, 4))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>"
        return f"<div>{text}</div>"

    def article(self, bare: bool = False) -> str:
        r, shape = self.r, self.r.random()
        if bare:
            a, b = "", ""
        elif shape < 0.45:
            a, b = "<article>", "</article>"
        elif shape < 0.6:
            a, b = "<main>", "</main>"
        elif shape < 0.65:
            a, b = "<main><article>", "</article></main>"
        elif shape < 0.7:
            a, b = '<div role="main">', "</div>"
        else:
            a, b = self.named("content article post entry story body text main article-body post-content entry-content page-content", "div div section article main", 0.1)
        n = int(np.exp(r.uniform(0, np.log(22))))
        title = r.choice(("h1", "h1", "h1", 'h1 class="title"', 'h2 class="entry-title"', "h2"))
        parts = [f"<{title}>{self.marked(self.prose(1, 14))}</{title[:2]}>"] if self.maybe(0.85) else []
        parts += [self.paragraph() for _ in range(n)]
        if self.maybe(0.15):
            parts.insert(r.randrange(len(parts)) + 1, r.choice((self.advert, self.share, self.side, self.notice))())
        if self.maybe(0.1):
            parts.append(self.comments())
        return a + "".join(parts) + b

    def nested(self, section: str) -> str:
        """By chance, a section whose content lies some elements deeper."""
        m = re.match(r"(?:<!-- ad -->)?<[^>]+>", section)
        end = section.rfind("</")
        if not m or end < m.end() or m[0].startswith(("<p", "<ul", "<ol")) or not self.maybe(0.25):
            return section
        tags = [("<div>", "</div>") if self.maybe(0.6) else self.named("inner wrap row col grid box layer outer cell", "div div section") for _ in range(self.r.randint(1, 10))]
        return section[: m.end()] + "".join(a for a, _ in tags) + section[m.end() : end] + "".join(b for _, b in reversed(tags)) + section[end:]

    def table(self) -> str:
        """A page laid out by the cells of a table."""
        r = self.r
        cell = lambda text, names="": f"<td{' width=' + str(r.randint(90, 700)) if self.maybe(0.3) else ''}{f' class={r.choice(names.split())}' if names and self.maybe(0.6) else ''}{' colspan=2' if self.maybe(0.2) else ''}>{text}" + ("</td>" if self.maybe(0.8) else "")
        menu = "<br>".join(f'<a href="{k}.htm">{t}</a>' for k, t in enumerate(self.words(r.randint(2, 8)))) if self.maybe(0.6) else self.links(r.randint(2, 8))
        main = "".join([f"<h1>{self.marked(self.prose(1, 10))}</h1>"] * self.maybe(0.8) + [self.paragraph() for _ in range(r.randint(1, 10))])
        title = self.prose(1, 6)
        rows = [cell(r.choice((f"<font size=5>{title}</font>", f"<b>{title}</b>", f"<h2>{title}</h2>", title)), "top header title banner")] if self.maybe(0.8) else []
        sides = [cell(menu, "menu left nav links"), cell(main, "content main text body")]
        rows.append("".join(sides if self.maybe(0.7) else sides[::-1]))
        rows += [cell(r.choice(("Copyright ", "&copy; ", "")) + f"{r.randint(1996, 2024)} {self.prose(1, 8)}", "footer bottom copyright")] if self.maybe(0.8) else []
        return f"<table{r.choice(('', ' width=100%', ' border=0', ' class=layout'))}>" + "".join(f"<tr>{x}" + ("</tr>" if self.maybe(0.8) else "") for x in rows) + "</table>"

    def page(self) -> str:
        r = self.r
        if self.maybe(0.06):
            return f"<html><head><title>{self.prose(1, 6)}</title></head><body>{self.table()}</body></html>"
        if self.maybe(0.04):
            return f"<html><body>{self.article(bare=True)}</body></html>"
        before = [f for f, p in ((self.notice, 0.25), (self.header, 0.45), (self.menu, 0.75), (self.share, 0.15), (self.advert, 0.45), (self.form, 0.15), (self.side, 0.15)) if self.maybe(p)]
        if self.maybe(0.3):
            r.shuffle(before)
        after = [f for f, p in ((self.share, 0.15), (self.advert, 0.25), (self.comments, 0.4), (self.side, 0.35), (self.form, 0.15), (self.notice, 0.2), (self.menu, 0.1)) if self.maybe(p)]
        r.shuffle(after)
        after += [self.footer] if self.maybe(0.85) else []
        body = "".join(self.nested(f()) for f in (*before, self.article, *after))
        if self.maybe(0.15):
            for _ in range(r.choice((1, 1, 1, 2, 4, 8))):
                body = f'<div class="{r.choice(("wrapper", "container", "page", "site"))}">{body}</div>'
        head = f"<head><title>{self.prose(1, 10)}</title>" + r.choice(("", "<style>p > b {}</style>", "<script>if (a<b) c('<p>x</p>')</script>")) + "</head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + ("</body></html>" if self.maybe(0.85) else "")


def readable(page: str | None) -> list[Block]:
    """The blocks of a page's body; those of its head are never main text."""
    return [b for b in blocks(page or "") if "^head" not in b.path and "^title" not in b.path]


def training_set(n: int = TRAINING_PAGES, seed: int = SEED) -> tuple[list, list[np.ndarray]]:
    pages, labels = [], []
    for k in range(n):
        found = readable(PageMaker(seed * 1_000_003 + k).page())
        y = np.array([float(MAIN in b.text) for b in found])
        for b in found:
            b.text = b.text.replace(MAIN, "").strip() or "-"
        if found:
            pages.append(vectors(found))
            labels.append(y)
    return pages, labels


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    """Weights of the labeller, trained once in a process; the same in every run."""
    model = Labeller()
    model.train(*training_set())
    return {k: v.astype(np.float32) for k, v in model.w.items()}


def main_texts(model: Labeller, pages: list[str | None], padded: int = 40_000) -> list[str]:
    """The main text of each page: its labelled blocks in order, joined by empty lines."""
    found = [readable(p) for p in pages]
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    out = [""] * len(pages)
    while order:
        chunk = [order.pop()]
        longest = len(found[chunk[0]])
        while order and (len(chunk) + 1) * longest <= padded and len(found[order[-1]]) > longest // 2:
            chunk.append(order.pop())
        p = model.probabilities([vectors(found[k]) for k in chunk])
        for row, k in enumerate(chunk):
            out[k] = "\n\n".join(b.text for b, x in zip(found[k], p[row]) if x >= 0.5)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text and its number of code points."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        model = Labeller(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                texts = main_texts(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(body_col).cast("string").alias("html"))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
