"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags). Features of a block are the tags, classes, ids and
roles of its ancestors, each name with how much of the page's plain text its element holds and whether it holds the title;
its own text (length, share of link text, punctuation); its container (share of the page's text, blocks that read like
running text, links, whether no other has more of them); its neighbours, and its place before, amid or after such blocks and
the title. So an article stands out where no name tells of it, and where a name denies it. A two-label chain (article or
not) is trained by maximum likelihood on labelled pages and decoded by Viterbi. As the pages come without labels, training
pages are written by ``labelled_pages``: layouts whose article is known because they are built around it, in an element
that names it, misleads or says nothing, or in none; a share ``BARE`` of them has no classes, ids and roles at all. They are
a fixed number (``TRAIN_PAGES``), so training is bounded; it runs once on the driver, and tasks get the weights. Text of
math, object, canvas, svg and noscript elements is text like any other.

Defined cases: null or empty html gives '' and 0; markup may be broken: an unclosed tag ends with its parent, an unclosed
script, style or comment hides the rest; a null id or url is kept; character references are decoded once; rows that repeat are extracted each; an
empty table gives no rows; pages of any length are read whole."""

from __future__ import annotations

import functools
import html as _html
import random
import re
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from capturelake.llm.common import arrow_rows, release, table, text_chunks

TRAIN_PAGES, BARE = 900, 0.5  # training pages, and the share of them without any class, id or role
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead tr ul video audio".split()
)
RAW_TAGS = frozenset("script style template textarea title iframe".split())
#: Tags by which a page names its article; blocks of such a page outside of them are marked as standing beside it.
NAMED = frozenset(["article", "main"])
NAMED_TOKENS = frozenset(f"{a}<{t}>" for t in NAMED for a in ("", "around "))
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"(?:\s|^)(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
TOKEN = re.compile(r"[a-z]+")
SHUT = re.compile(r"(?:^|[\s\"'])/$")  # a slash at the end of an unquoted value belongs to it


#: Tags that hold a part of what their container says, and are no containers themselves.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th hr".split())
#: Containers that are no small boxes.
WHOLE = frozenset(["", "html", "body", "article", "main"])


class Block:
    """Text of a leaf, how much of it is in links, and the element that it stands in."""

    __slots__ = ("text", "element", "linked", "tokens", "more")

    def __init__(self, text: str, element: int, linked: int):
        self.text, self.element, self.linked = text, element, linked
        self.tokens: frozenset[str] = frozenset()
        self.more: list[str] = []


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks in page order, white space already single. With known, names that are not in it are left out."""
    out: list[Block] = []
    tags, parents, names = [""], [-1], [()]  # of every element, in page order
    stack = [0]
    opened: Counter[str] = Counter()  # tags on the stack, so that a closing tag without one costs nothing
    run: list[str] = []
    linked, in_link = 0, False
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(Block(text, stack[-1], min(linked, len(text))))
            run, linked = [], 0

    while at < end:
        lt = page.find("<", at)
        piece = page[at : lt if lt >= 0 else end]
        if piece:
            piece = _html.unescape(piece) if "&" in piece else piece
            run.append(piece)
            linked += len(piece) * in_link
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        mark = page[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            stop = page.find(">", lt)
            at = stop + 1 if stop >= 0 else end
            continue
        m = TAG.match(page, lt)
        if not m:
            following = page[lt + 2 : lt + 3] if mark == "/" else mark
            if following.isascii() and following.isalpha():  # a tag that never closes its quotes or itself
                stop = page.find(">", lt)
                at = stop + 1 if stop >= 0 else end
            else:
                run.append("<")
                at = lt + 1
            continue
        at, tag = m.end(), m[1].lower()
        if mark == "/":
            if tag == "a":
                in_link = False
            elif tag in BLOCK_TAGS:
                flush()
                in_link = False
                while opened[tag]:
                    gone = tags[stack.pop()]
                    opened[gone] -= 1
                    if gone == tag:
                        break
            continue
        if tag in RAW_TAGS:
            if not SHUT.search(m[2]):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*+>?", re.I).search(page, at)
                at = close.end() if close else end
            if tag in ("title",):
                flush()
            continue
        if tag == "a":
            in_link = True
        elif tag == "br":
            run.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            in_link = False
            shut = CLOSES.get(tag, {"p"} if tag not in ("button", "label", "option") else set())
            while len(stack) > 1 and tags[stack[-1]] in shut:
                opened[tags[stack.pop()]] -= 1
            if tag in VOID_TAGS:
                continue
            tags.append(tag)
            parents.append(stack[-1])
            names.append(tuple(f"{'role' if name.lower() == 'role' else 'c'}:{t}" for name, a, b, c in ATTRIBUTE.findall(m[2]) for t in TOKEN.findall((a or b or c).lower())))
            stack.append(len(tags) - 1)
            opened[tag] += 1
    flush()
    _describe(out, tags, parents, names, known)
    return out


def _prose(b: Block) -> bool:
    """Whether a block reads like running text."""
    return len(b.text) >= 40 and b.linked * 3 < len(b.text) and any(c in b.text for c in ".,;:!?")


def _level(share: float) -> int:
    return 0 if share < 0.05 else 1 if share < 0.2 else 2 if share < 0.5 else 3


def _describe(page: list[Block], tags: list[str], parents: list[int], names: list[tuple[str, ...]], known: Container[str] | None) -> None:
    """Tokens of the elements a block stands in, and what its text, its neighbours and its container are like.

    A name says something else in an element that holds most of the page's plain text, or its first h1, than in a small one,
    so how large the element is belongs to the token. Everything here is linear in blocks and elements."""
    n = len(tags)
    plain, first_h1 = [0] * n, -1
    h1_at = next((i for i, b in enumerate(page) if tags[b.element] == "h1"), -1)
    first_h1 = h1_element = page[h1_at].element if h1_at >= 0 else -1
    for b in page:
        plain[b.element] += len(b.text) - b.linked
    for e in range(n - 1, 0, -1):  # children come after their parents
        plain[parents[e]] += plain[e]
    whole = max(plain[0], 1)
    titled = set()
    while first_h1 >= 0:
        titled.add(first_h1)
        first_h1 = parents[first_h1]
    tokens: list[frozenset[str]] = [frozenset()] * n
    container = [0] * n
    for e in range(1, n):
        tag, up = tags[e], parents[e]
        container[e] = container[up] if tag in PARTS else e
        state = ("+" if 2 * plain[e] >= whole else "") + ("h" if e in titled else "")
        own = {f"<{tag}>", *(f"{t}{state}" for t in names[e])}
        around = tokens[up]
        if tag in NAMED:  # names of an article itself and of what it stands in say something else than names in it
            own = {f"<{tag}>", *(f"own {t}" for t in own)}
            around = frozenset(t if t.startswith("around ") else f"around {t}" for t in around)
            around = around if known is None else frozenset(t for t in around if t in known)
        if known is not None:
            own = {t for t in own if t in known or t in NAMED_TOKENS}
        tokens[e] = around if own <= around else around | own
    named = any(not NAMED_TOKENS.isdisjoint(tokens[b.element]) for b in page)

    text, linked, prose = Counter(), Counter(), Counter()
    for b in page:
        c = container[b.element]
        text[c] += len(b.text)
        linked[c] += b.linked
        prose[c] += _prose(b)
    reads = [_prose(b) for b in page]
    says = Counter()
    for b, r in zip(page, reads):
        says[container[b.element]] += (len(b.text) - b.linked) * r
    most = max(says.values(), default=0)
    first = next((i for i, r in enumerate(reads) if r), len(page))
    last = next((i for i in range(len(page) - 1, -1, -1) if reads[i]), -1)
    for i, b in enumerate(page):
        c = container[b.element]
        b.tokens = tokens[b.element]
        here, short = reads[i], "s" if len(b.text) < 40 else "l"
        b.more = [
            f"share:{_level((text[c] - linked[c]) / whole)}", f"prose:{min(prose[c], 4)}", f"links:{_level(linked[c] / max(text[c], 1))}", f"share:{_level((text[c] - linked[c]) / whole)} prose:{min(prose[c], 3)} {short}",
            f"next:{int(i + 1 < len(page) and reads[i + 1])} {short}", f"before:{int(i > 0 and reads[i - 1])} {short}", f"in:{tags[b.element]} {short}", "early" if i < first else "late" if i > last else f"amid:{int(here)}",
            f"top:{int(0 < most == says[c])} {short}", f"near top:{_level(says[c] / most) if most else 9} {int(here)}",
            f"box:{int(tags[c] in WHOLE)} {min(prose[c], 1)} {short}{int(i > last)}{int(i < first)}", f"same:{int(i > 0 and container[page[i - 1].element] == c)}{int(i + 1 < len(page) and container[page[i + 1].element] == c)}",
        ]
        if h1_at >= 0:
            b.more.append(f"h1:{int(i < h1_at)}{int(container[h1_element] == c)}")
        if named and NAMED_TOKENS.isdisjoint(b.tokens):
            b.more.append("beside" if h1_at < 0 or NAMED_TOKENS.isdisjoint(tokens[h1_element]) else "beside h1")
        if named:
            b.more.append(f"named {tags[c] in NAMED}")


def features(block: Block) -> list[str]:
    n = len(block.text)
    share = block.linked / n
    last = block.text[-1]
    stops = sum(map(block.text.count, ".,;:!?"))
    out = [*block.tokens, *block.more, "bias", f"len:{min(n.bit_length(), 10)}", f"link:{0 if not share else 1 if share < 0.5 else 2}", f"stop:{min(stops, 5)}", "end" if last in ".!?\"'" else "open"]
    if "©" in block.text or "copyright" in block.text.lower():
        out.append("copyright")
    return out


class Chain:
    """Weights of a two-label chain: features times labels, transitions, and labels at the start."""

    def __init__(self, index: dict[str, int], w: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.index, self.w, self.move, self.start = index, w, move, start

    def emissions(self, page: list[Block]) -> np.ndarray:
        get = self.index.get
        return np.array([self.w[[i for f in features(b) if (i := get(f)) is not None]].sum(0) for b in page])

    def decode(self, page: list[Block]) -> list[int]:
        """Most likely labels; 1 is article."""
        if not page:
            return []
        e = self.emissions(page).tolist()
        (aa, ab), (ba, bb) = self.move.tolist()
        s0, s1 = (self.start + e[0]).tolist()
        back = []
        for x0, x1 in e[1:]:
            f0, f1 = s1 + ba > s0 + aa, s1 + bb > s0 + ab
            back.append((f0, f1))
            s0, s1 = (s1 + ba if f0 else s0 + aa) + x0, (s1 + bb if f1 else s0 + ab) + x1
        label = int(s1 > s0)
        out = [label]
        for f in reversed(back):
            label = int(f[label])
            out.append(label)
        return out[::-1]

    @staticmethod
    def fit(pages: list[list[Block]], labels: list[list[int]], rounds: int = 100, rate: float = 0.15, decay: float = 2e-3) -> Chain:
        """Maximum likelihood with a Gaussian prior, by full-batch Adam; forward-backward runs over all pages at once."""
        index: dict[str, int] = {}
        found = [[[index.setdefault(f, len(index)) for f in features(b)] for b in p] for p in pages]
        steps = max(map(len, pages))
        sizes = np.array([len(fs) for p in found for fs in p])
        rf = np.array([f for p in found for fs in p for f in fs])
        starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        bn = np.array([n for n, p in enumerate(found) for _ in p])
        bt = np.array([t for p in found for t in range(len(p))])
        size = np.array([len(p) for p in pages])
        live = np.arange(steps) < size[:, None]
        gold = np.zeros((len(pages), steps), int)
        for n, y in enumerate(labels):
            gold[n, : len(y)] = y
        theta = np.zeros(len(index) * 2 + 6)
        m = v = np.zeros_like(theta)
        hot = np.eye(2)[gold] * live[:, :, None]
        pair = hot[:, :-1, :, None] * hot[:, 1:, None, :]
        for step in range(1, rounds + 1):
            w, move, start = theta[:-6].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
            e = np.zeros((len(pages), steps, 2))
            e[bn, bt] = np.add.reduceat(w[rf], starts)
            f = np.zeros_like(e)
            f[:, 0] = start + e[:, 0]
            for t in range(1, steps):
                f[:, t] = np.logaddexp(f[:, t - 1, :1] + move[0], f[:, t - 1, 1:] + move[1]) + e[:, t]
            b = np.zeros_like(e)
            for t in range(steps - 2, -1, -1):
                nxt = b[:, t + 1] + e[:, t + 1]
                b[:, t] = np.where(live[:, t + 1, None], np.logaddexp(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:]), 0)
            z = np.logaddexp(*np.moveaxis((f + b)[:, 0], 1, 0))
            p = np.exp(f + b - z[:, None, None]) * live[:, :, None]
            pp = np.exp(f[:, :-1, :, None] + move + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
            g = np.zeros_like(theta)
            off = (hot - p)[bn, bt][owner]
            g[:-6] = np.stack([np.bincount(rf, off[:, k], len(index)) for k in (0, 1)], 1).reshape(-1)
            g[-6:-2] = (pair - pp).sum((0, 1)).reshape(-1)
            g[-2:] = (hot - p)[:, 0].sum(0)
            g = g / len(pages) - decay * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return Chain(index, theta[:-6].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:])


#: Names that sites give to the parts of a page. Those of NOISE hold no article, but an article's own name, and that of what
#: it stands in, may have such a word in it; cards of other stories stand in parts of the names of CARDS.
NOISE: dict[str, list[str]] = {
    "nav": ["nav", "navbar", "menu", "breadcrumb", "breadcrumbs", "navigation", "toc", "pagination"],
    "header": ["header", "masthead", "topbar", "branding", "logo"],
    "footer": ["footer", "colophon", "copyright", "legal", "bottom"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "trending", "rail"],
    "div": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "consent", "notice", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "share", "social", "login", "search", "alert", "paywall", "comments", "comment", "disqus", "replies", "reply", "respond", "discussion"],
    "form": ["form", "search", "contact", "newsletter", "comment"],
    "section": ["comments", "related", "newsletter", "cookie", "promo", "responses"],
    "ul": ["menu", "nav", "links", "tags", "share"],
    "dialog": ["cookie", "modal"],
}
CARDS = ["related", "recommended", "trending", "sidebar", "rail", "widget", "promo"]
MAIN: list[tuple[str, list[str]]] = [("article", ["", "post", "article", "entry"]), ("main", ["", "content", "main"]), ("div", ["content", "article", "post", "entry", "body", "story", "main", "text"]), ("section", ["content", "article", "body", "story"])]


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 11) -> tuple[list[list[Block]], list[list[int]]]:
    """Pages of invented words with known articles: words of the article are marked by a leading 'm' and checked per block."""
    rng = random.Random(seed)
    bare = False  # nothing but text tells what the boxes of such a page are, so they say little

    def word(main: bool) -> str:
        return ("m" if main else "x") + "".join(rng.choice(["ta", "re", "on", "st", "li", "ve"]) for _ in range(rng.randint(1, 4)))

    def text(main: bool, lo: int, hi: int) -> str:
        plain = rng.random() < 0.25  # no punctuation
        out = " ".join(word(main) + ("" if plain else rng.choice(["", "", "", "", ","])) for _ in range(rng.randint(lo, hi)))
        return out if plain else out + rng.choice([".", ".", ".", "", "!", "?"])

    def title() -> str:
        return "-".join([word(False), rng.choice(NOISE[rng.choice(list(NOISE))]), *(word(False) for _ in range(rng.randint(0, 2)))])

    def cards() -> str:
        inner = "".join(f"<article{rng.choice(['', ' class=card', ' class=teaser'])}><h3>{text(False, 2, 8)}</h3><p>{text(False, 3, 30)}</p></article>" for _ in range(rng.randint(1, 4)))
        return rng.choice([f"<aside>{inner}</aside>", f'<div class="{rng.choice(CARDS)}">{inner}</div>', f'<aside class="{rng.choice(CARDS)}">{inner}</aside>'])

    def noise(deep: bool = False) -> str:
        kind = rng.random()
        if kind < 0.08:
            return cards()
        if kind < (0.4 if deep else 0.2):
            return strip(deep)
        tag = rng.choice(list(NOISE))
        if deep and tag in ("header", "form"):
            tag = "div"
        names = NOISE[tag]
        mark = rng.choice(["class", "class", "id", "role"]) if rng.random() < (1.0 if tag in ("div", "section", "ul") else 0.5) else ""
        attr = f' {mark}="{rng.choice(["", "", "site-", "main-", "page-"])}{rng.choice(names)}{rng.choice(["", "", "-box", "-wrap", "-list"])}"' if mark else ""
        kind = rng.random()
        if tag == "ul" or kind < 0.3:
            inner = "".join(f'<li><a href="/">{text(False, 1, 3).rstrip(".!?")}</a></li>' for _ in range(rng.randint(2, 7)))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        elif kind < 0.6 or bare:
            inner = text(False, 2, 12 if bare else 30)
        else:
            inner = "".join(f"<p>{text(False, 2, 40)}</p>" for _ in range(rng.randint(1, 4)))
        if tag in ("form", "div", "dialog") and rng.random() < 0.3:
            inner += f"<button>{text(False, 1, 3).rstrip('.!?')}</button>"
        if tag == "header" and not deep and rng.random() < 0.3:
            inner = f"<h1>{text(False, 1, 3).rstrip('.!?')}</h1>" + inner
        if tag == "footer" and rng.random() < 0.6:
            inner += "&copy; " + text(False, 1, 6)
        return f"<{tag}{attr}>{inner}</{tag}>"

    def strip(deep: bool = False) -> str:
        """A small box of a name that says nothing: a call to do something, a line of links."""
        ask = text(False, 2, 9).rstrip(".!?")
        inner = rng.choice([f"<p>{ask}</p>", ask, f'<a href="/">{ask}</a>', f"<p>{ask}</p><button>{word(False)}</button>", f'{ask} <a href="/">{word(False)}</a>'])
        if deep and rng.random() < 0.4:
            return f"<button>{text(False, 1, 4).rstrip('.!?')}</button>"
        return f"<div class='{word(False)}-{word(False)}'>{inner}</div>"

    def body() -> str:
        """What an article says."""
        out = [f"<h1>{text(True, 1, 10)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            said = text(True, 1, 6) if kind < 0.2 else text(True, 6, 90)
            tag = rng.choices(["p", "h2", "h3", "blockquote", "li", "div", "pre", "figcaption", "td", "nest"], [60, 6, 4, 4, 6, 4, 2, 2, 2, 3])[0]
            said = text(True, 12, 60) if tag in ("div", "nest") else said
            if rng.random() < 0.2:
                said += f' <a href="/">{text(True, 1, 3)}</a>'
            one = f"<{tag}>{'<b>' if rng.random() < 0.1 else ''}{said}</{tag}>"
            nest = f"<div class='{word(False)}'>" + "".join(f"<p>{text(True, 8, 60)}</p>" for _ in range(rng.randint(1, 4))) + "</div>"
            out.append({"li": f"<ul>{one}</ul>", "td": f"<table><tr>{one}</tr></table>", "figcaption": f"<figure>{one}</figure>", "nest": nest}.get(tag, one))
            if rng.random() < 0.1:
                out.append(noise(True))
        if rng.random() < 0.25 and not bare:
            out.append(f'<{rng.choice(["div", "section"])} class="{rng.choice(["comments", "comment-list", "share", "related", "reader-comments"])}">' + "".join(f"<p>{text(False, 3, 40)}</p>" for _ in range(rng.randint(1, 12))) + "</div>")
        return "".join(out)

    def article() -> str:
        """An article in an element that names it, in one that misleads or says nothing, or in none."""
        kind, said = rng.random(), body()
        if kind < 0.12:
            return said
        tag, names = rng.choice(MAIN)
        name = rng.choice(names)
        if tag in NAMED:
            name = f"{name} {title()}".strip() if rng.random() < 0.2 else name
        elif kind < 0.6:
            name = rng.choice(["", title(), title(), word(False)])
        head = ""
        if said.startswith("<h1>") and rng.random() < 0.15:  # the title may stand before what holds the rest
            head, said = said.split("</h1>", 1)
            head += "</h1>"
        return f"{head}<{tag}{f' class={name!r}' if name else ''}>{said}</{tag}>"

    pages, labels = [], []
    for _ in range(n):
        bare = rng.random() < BARE
        said = article()
        if rng.random() < 0.3:
            said = f'<{rng.choice(["div", "main", "section"])} {rng.choice(["class", "id"])}="{title() if rng.random() < 0.5 else rng.choice(["wrap", "container", "page", "layout", "content"])}">' + "".join(noise() for _ in range(rng.randint(0, 2))) + said + "".join(noise() for _ in range(rng.randint(0, 2))) + "</div>"
        if said.startswith(("<article", "<main")) and rng.random() < 0.3:
            said = strip() + said if rng.random() < 0.5 else said + strip()
        whole = "<html><body>" + "".join(noise() for _ in range(rng.randint(0, 4))) + said + "".join(noise() for _ in range(rng.randint(0, 4))) + "</body></html>"
        if bare:
            whole = re.sub(r" (?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^ >]*)", "", whole)
            whole = whole if rng.random() < 0.7 else re.sub(r"(</?)(?:nav|header|footer|aside|section|dialog|form)>", r"\1div>", whole)
        page = blocks(whole)
        pages.append(page)
        labels.append([int(b.text[0] == "m") for b in page])
    return pages, labels


@functools.cache
def default_model() -> Chain:
    return Chain.fit(*labelled_pages())


def main_text(page: str | None, model: Chain) -> str:
    found = blocks(page or "", model.index)
    return "\n".join(b.text for b, y in zip(found, model.decode(found), strict=True) if y)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; one pass, no shuffle."""
    arrow_rows(pages.sparkSession)
    model = model or default_model()
    shared = pages.sparkSession.sparkContext.broadcast((model.index, model.w, model.move, model.start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(*shared.value)
        for batch in batches:
            at = 0
            for _, own in text_chunks(list(range(len(batch))), batch.column(2).to_pylist(), 1 << 23):
                text = [main_text(p, chain) for p in own]
                part = batch.slice(at, len(own))
                at += len(own)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])
        release()

    cols = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
