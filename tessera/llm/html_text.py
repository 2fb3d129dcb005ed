"""Main-text extraction with a tree-structured graphical model over the DOM.

Every block element and every run of text is a binary node, content or not. Unary potentials come from its tag, class and
text; parent-child potentials from how often a child agrees with its parent. Sum-product messages pass up to the root and
down again, which gives exact marginals on the tree; runs over one half are the text. All potentials are trained from
labelled pages, which `labelled_pages` composes from page templates.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

COMMENT_END, SPECIAL, NAME = re.compile(r"--!?>"), re.compile(r"[>\"']"), re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose text is never shown, or is not prose.
SKIP = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "textarea", "button", "title", "head"}
RAW = {"script", "style", "iframe", "textarea", "title", "noscript", "template"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "col", "source", "area", "base", "embed", "param", "track"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "center", "nobr", "img", "wbr", "picture", "input"}
HEADS, LISTS = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}
TAGS = ["root", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "ol", "table", "td", "blockquote", "pre", "figure", "figcaption", "dl", "dd", "nav", "header", "footer", "aside", "form", "address", "dialog", "menu", "other"]
#: Elements that say something of all that is inside of them.
AROUND = ["nav", "header", "footer", "aside", "form", "dialog", "menu", "article", "main"]
#: What class and id names and roles say, in the languages of the tables, by their word parts; a word may say several things.
HINTS = [
    ("menu", "nav navbar navigation menu menus breadcrumb breadcrumbs toc pagination pager skip tabs navi"),
    ("header", "header masthead topbar banner logo branding hero site kopfzeile cabecera"),
    ("footer", "footer copyright legal imprint colophon bottom contentinfo fusszeile impressum pied pie"),
    ("side", "sidebar side aside widget widgets related recommended recommendations popular trending rail more complementary seitenleiste lateral similaires"),
    ("advert", "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adbox adslot dfp outbrain taboola werbung anzeige pub publicite publicidad anuncio reklame"),
    ("notice", "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall toast message warning disclaimer hinweis aviso avis"),
    ("comment", "comment comments commentlist reply replies respond disqus discussion responses feedback review reviews kommentar kommentare commentaire commentaires comentario comentarios"),
    ("form", "form search login signin register contact input formular formulaire formulario"),
    ("share", "share sharing social follow like tools meta tags tag byline author date teilen partager compartir"),
    ("content", "article content post entry main story body text page prose markdown document artikel inhalt contenu contenido"),
    ("hidden", ""),
]
_HINT: dict[str, tuple[int, ...]] = {}
for _i, (_, _words) in enumerate(HINTS):
    for _w in _words.split():
        _HINT[_w] = (*_HINT.get(_w, ()), _i)
#: Words of so many letters are known as parts of joined names, such as "commentlistitem".
LONG, HIDDEN = 6, len(HINTS) - 1
_LONG = sorted((w for w in _HINT if len(w) >= LONG), key=len, reverse=True)
NOT_SHOWN = re.compile(r"(?:^|[\s\"'])hidden(?=[\s=/]|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
N_AROUND = len(HINTS) + len(AROUND)
N_ELEMENT = len(TAGS) + len(HINTS) + N_AROUND + 8
N_RUN = len(TAGS) + N_AROUND + 17


class Node:
    __slots__ = ("tag", "hints", "up", "text", "linked")

    def __init__(self, tag: str, hints: frozenset, up: int, text: str | None = None, linked: float = 0.0):
        self.tag, self.hints, self.up, self.text, self.linked = tag, hints, up, text, linked


@lru_cache(1 << 16)
def hints_of(word: str) -> tuple[int, ...]:
    return _HINT.get(word) or next((_HINT[w] for w in _LONG if word.startswith(w) or word.endswith(w)), ())


@lru_cache(1 << 12)
def hints(attrs: str) -> frozenset:
    out = {HIDDEN} if NOT_SHOWN.search(attrs) else set()
    for m in ATTR.finditer(attrs):
        for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()):
            out.update(hints_of(w))
    return frozenset(out)


class Markup:
    """Finds comments, declarations and tags, each place in time that doesn't grow with the rest of the page.

    What was looked for in vain behind one place is not looked for again behind later ones.
    """

    def __init__(self, html: str):
        self.html, self.ends, self.gone = html, {}, set()
        self.last, self.last_data = html.rfind(">"), html.rfind("]]>")

    def tag_end(self, at: int) -> int:
        """Place of the first > outside quotes, or of the first > at all where a quote never ends."""
        path, i = [], at
        while True:
            m = SPECIAL.search(self.html, i)
            j = m.start() if m else -1
            if j < 0 or j in self.ends:
                end = self.ends.get(j, -1)
                break
            path.append(j)
            i = self.html.find(m[0], j + 1) + 1
            if m[0] == ">" or not i:
                end = j if m[0] == ">" else -1
                break
        self.ends.update(dict.fromkeys(path, end))
        return end if end >= 0 else self.html.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, tag or "", whether it closes, attributes) of the next markup from `at` on."""
        html = self.html
        while 0 <= (lt := html.find("<", at)) < self.last or lt >= 0 and html.startswith("<!--", lt):
            if html.startswith("<!--", lt):
                m = COMMENT_END.search(html, lt + 2)
                return lt, m.end() if m else len(html), "", False, ""
            if html.startswith("<![CDATA[", lt) and lt < self.last_data:
                return lt, html.find("]]>", lt) + 3, "", False, ""
            if html[lt + 1 : lt + 2] in ("!", "?"):
                return lt, html.find(">", lt) + 1, "", False, ""
            if m := NAME.match(html, lt + 1):
                end = self.tag_end(m.end())
                return lt, end + 1, m[2].lower(), m[1] == "/", html[m.end() : end]
            at = lt + 1
        return None

    def close_of(self, tag: str, at: int) -> int:
        """Where the next end tag of that name ends, or -1."""
        if tag in self.gone:
            return -1
        m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.html, at)
        if not m:
            self.gone.add(tag)
        return m.end() if m else -1


class Stack:
    """The open elements; where a name was last opened is known without a search."""

    def __init__(self):
        self.nodes, self.names, self.at = [0], ["root"], {}

    def push(self, node: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.names.append(tag)

    def last(self, tag: str) -> int:
        found = self.at.get(tag)
        return found[-1] if found else -1

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            self.nodes.pop()
            self.at[self.names.pop()].pop()


def parse(html: str) -> list[Node]:
    """Nodes in page order, parents first; node 0 is the root. A run's text has its references decoded and white space joined.

    Elements may lie as deep as they like; time grows with the length of the page.
    """
    nodes = [Node("root", frozenset(), -1)]
    markup, stack, parts, linked, links, at, size = Markup(html), Stack(), [], [0], 0, 0, len(html)

    def flush() -> None:
        t = " ".join(unescape("".join(parts)).split())
        if t:
            nodes.append(Node("#", frozenset(), stack.nodes[-1], t, min(1.0, linked[0] / len(t))))
        parts.clear()
        linked[0] = 0

    def text(s: str) -> None:
        if s:
            parts.append(s)
            if links:
                linked[0] += len(s)

    def close(tag: str, fence: set[str]) -> None:
        i = stack.last(tag)
        if i > 0 and all(stack.last(t) <= i for t in fence):
            flush()
            stack.cut(i)

    while at < size:
        m = markup.next(at)
        if not m:
            text(html[at:])
            break
        start, stop, tag, end, attrs = m
        text(html[at:start])
        at = stop
        if not tag:
            continue
        if tag in SKIP and tag != "head":
            if not end and not attrs.rstrip().endswith("/"):
                stop = markup.close_of(tag, at)
                at = stop if stop >= 0 else (size if tag in RAW else at)
            continue
        if tag == "br":
            text(" ")
        elif tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if end else 1
        elif tag in VOID or tag in ("html", "head"):
            flush()
        elif end:
            close(tag, {"table"} if tag not in ("table", "body") else set())
        else:
            flush()
            if tag in ("li", "p", "dd", "dt", "tr", "td", "th", "option"):
                close(tag, {"ul", "ol", "table", "dl", "menu", "div", "article", "section", "blockquote"} - {tag})
            else:
                close("p", {"div", "article", "section", "td", "li", "blockquote", "table", "body"})
            links = 0
            nodes.append(Node(tag, hints(attrs), stack.nodes[-1]))
            stack.push(len(nodes) - 1, tag)
    flush()
    return nodes


_TAG, _AROUND = {t: i for i, t in enumerate(TAGS)}, {t: len(HINTS) + i for i, t in enumerate(AROUND)}


def features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which nodes are runs, and the feature rows of the elements and of the runs.

    Of an element: tag, hints, what is around it (hints and elements further up; the body's own are left out), and of its text the
    share of links, length, length of a run, runs that end like sentences, share of the page, and whether the page has an article or
    main part elsewhere. Of a run: the tag of its block, what
    is around it, its links, length and end, and the same of the block that holds its block.
    """
    n, k = len(nodes), len(TAGS)
    is_run = np.array([x.text is not None for x in nodes])
    up = np.array([x.up for x in nodes])
    size, links, runs, ends, held = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    around = np.zeros((n, N_AROUND), bool)
    own = np.zeros((n, len(HINTS)), bool)
    tag = np.zeros(n, np.int64)
    for i, x in enumerate(nodes):
        if x.text is not None:
            size[i], links[i], runs[i], ends[i] = len(x.text), len(x.text) * x.linked, 1, x.text[-1] in ".!?:;\"')”。！？"
            tag[i] = tag[x.up]
        else:
            tag[i] = _TAG.get(x.tag, k - 1)
            own[i, list(x.hints)] = True
            held[i] = x.tag in ("article", "main")
        if i and nodes[x.up].tag not in ("root", "body"):
            p = nodes[x.up]
            around[i] = around[x.up]
            around[i, list(p.hints)] = True
            if p.tag in _AROUND:
                around[i, _AROUND[p.tag]] = True
    for i in range(n - 1, 0, -1):
        for c in (size, links, runs, ends, held):
            c[up[i]] += c[i]
    outside = (held == 0) & (held[0] > 0) & ~around[:, _AROUND["article"]] & ~around[:, _AROUND["main"]]
    many, page = np.maximum(runs, 1), max(size[0], 1.0)
    share, length, mean, closed = links / np.maximum(size, 1), np.log1p(size) / 8, np.log1p(size / many) / 6, ends / many
    e, els = np.zeros((n, N_ELEMENT)), np.nonzero(~is_run)[0]
    e[els, tag[els]] = 1
    e[:, k : k + len(HINTS)] = own
    at = k + len(HINTS)
    e[:, at : at + N_AROUND] = around
    e[:, at + N_AROUND :] = np.stack([own.any(1), outside, share, share > 0.5, length, mean, closed, size / page], 1)
    r, at = np.zeros((n, N_RUN)), k + N_AROUND
    rows = np.nonzero(is_run)[0]
    block = up[rows]
    holder = np.maximum(up[block], 0)
    r[rows, tag[rows]] = 1
    r[rows, k:at] = around[rows]
    tags = [nodes[i].tag for i in block]
    texts = [nodes[i].text for i in rows]
    r[rows, at:] = np.stack([outside[rows], share[rows], share[rows] > 0.5, np.log1p(size[rows]) / 6, size[rows] < 25, size[rows] > 80, ends[rows], ["©" in t for t in texts], [t in HEADS for t in tags],
                             share[holder], share[holder] > 0.5, length[holder], mean[holder], closed[holder], size[holder] / page, [nodes[i].tag in LISTS for i in holder], share[rows] * (share[holder] < 0.4)], 1) if len(rows) else np.zeros((0, 17))
    return is_run, e[els], r[rows]


class Model:
    def __init__(self, we: np.ndarray, wr: np.ndarray, pair: np.ndarray):
        self.we, self.wr, self.pair = we, wr, pair  # pair: (element child, run child) x parent state x child state

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """P(content) of each node, by one pass of messages up and one down."""
        n = len(nodes)
        is_run, e, r = features(nodes)
        u = np.empty(n)
        u[~is_run], u[is_run] = e @ self.we, r @ self.wr
        own = np.exp(np.stack([-u / 2, u / 2], 1) - np.abs(u / 2)[:, None]).tolist()
        kind, up, pair = [int(x.text is not None) for x in nodes], [x.up for x in nodes], self.pair.tolist()
        below, sent = [list(x) for x in own], [None] * n
        for i in range(n - 1, 0, -1):  # upward: children come after their parents
            p, (b0, b1) = pair[kind[i]], below[i]
            m0, m1 = p[0][0] * b0 + p[0][1] * b1, p[1][0] * b0 + p[1][1] * b1
            z = m0 + m1
            sent[i] = m0 / z, m1 / z
            q = below[up[i]]
            q[0], q[1] = q[0] * m0 / z, q[1] * m1 / z
            z = q[0] + q[1]
            q[0], q[1] = max(q[0] / z, 1e-290), max(q[1] / z, 1e-290)
        full, out = [None] * n, np.empty(n)
        for i in range(n):  # downward: the parent's belief without this child's message
            b0, b1 = below[i]
            if i:
                f, (m0, m1), p = full[up[i]], sent[i], pair[kind[i]]
                c0, c1 = f[0] / max(m0, 1e-290), f[1] / max(m1, 1e-290)
                b0, b1 = b0 * (c0 * p[0][0] + c1 * p[1][0]), b1 * (c0 * p[0][1] + c1 * p[1][1])
            z = b0 + b1
            full[i] = b0 / z, b1 / z
            out[i] = full[i][1]
        return out

    def extract(self, html: str | None) -> list[str]:
        nodes = parse(html or "")
        p = self.marginals(nodes)
        return [n.text for n, q in zip(nodes, p) if n.text is not None and q > 0.5]


def _prose(r: random.Random, lo: int, hi: int) -> str:
    w = lambda: "".join(r.choice(["ba", "to", "ri", "ne", "shu", "ka", "mel", "dor", "in", "es"]) for _ in range(r.randint(1, 4)))
    out = []
    for _ in range(r.randint(lo, hi)):
        s = " ".join(w() for _ in range(r.randint(1, 22)))
        out.append(s.capitalize() + r.choice(["."] * 8 + ["?", "!"]))
    return " ".join(out)


def labelled_pages(n: int = 800, seed: int = 11) -> list[tuple[str, set[str]]]:
    """(html, texts of its content runs), composed from templates of many layouts; marks of content carry a unique word."""
    r, pages = random.Random(seed), []
    for _ in range(n):
        good: set[str] = set()

        def say(lo: int = 1, hi: int = 4, keep: bool = False) -> str:
            t = _prose(r, lo, hi) if r.random() < 0.85 else " ".join(_prose(r, 1, 1).rstrip(".?!").split()[: r.randint(1, 6)])
            t += f" z{len(good)}q{r.randrange(10**6)}." if r.random() < 0.7 else f" z{len(good)}q{r.randrange(10**6)}"
            if keep:
                good.add(t)
            return t

        short = lambda: " ".join(_prose(r, 1, 1).split()[: r.randint(1, 4)]).rstrip(".?!")

        def tiny() -> str:
            good.add(t := f"{short().split()[0]}{len(good)}x{r.randrange(10**6)}")
            return t

        menu = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(r.randint(2, 9))) + "</ul>"
        lines = lambda: r.choice(["<br>", " | ", " "]).join(f'<a href="/{i}">{short()}</a>' for i in range(r.randint(2, 9)))
        word = lambda i: r.choice(HINTS[i][1].split())

        def cls(i: int) -> str:
            if i == HIDDEN:
                return r.choice(["hidden", 'style="display:none"', 'aria-hidden="true"', 'class="x" style="color:red; display: none"'])
            name = r.choice([lambda: word(i), lambda: word(i), lambda: f"{r.choice(['site', 'page', 'block', 'c', 'js', 'x'])}-{word(i)}", lambda: f"{word(i)}-{word(i)}", lambda: f"{word(i)}{r.choice(['-box', '_1', '-wrap', ' inner', 'Area'])}"])()
            return f'{r.choice(["class", "class", "class", "id", "role"])}="{name}"'

        box = lambda i, inner: f"<{(t := r.choice(['div', 'div', 'section']))} {cls(i)}>{inner}</{t}>"
        para = lambda keep=False: f"<p>{say(1, 5, keep)}</p>"
        plain = lambda: r.choice(["", "", 'class="x1"', 'class="row"', f'class="{word(9)}"', f'class="inner {word(9)}"'])

        def junk() -> str:
            return r.choice([
                lambda: f"<nav>{menu()}</nav>", lambda: box(0, menu()), lambda: f"<aside>{para()}{menu()}</aside>", lambda: box(3, f"<h3>{short()}</h3>" + menu() + para()),
                lambda: box(4, r.choice([say(), para(), f'<a href="/x">{say(1, 2)}</a>'])), lambda: box(5, para() + f"<button>{short()}</button>"), lambda: box(5, say(1, 2)),
                lambda: f"<form {cls(7)}><label>{short()}</label><input><p>{say(1, 2)}</p><button>{short()}</button></form>", lambda: box(8, menu()), lambda: f"<dialog {cls(5)}>{para()}</dialog>",
                lambda: box(4, f"<p {plain()}>{say(1, 3)}</p>"), lambda: box(5, f"<div {plain()}>{say(1, 3)}</div>"), lambda: box(HIDDEN, r.choice([para(), say(1, 3), menu()])), lambda: box(6, f"<div {plain()}>{para()}</div>"),
                lambda: f"<form><p>{say(1, 3)}</p><input><button>{short()}</button></form>", lambda: f"<form><div {plain()}><h3>{short()}</h3>{para()}</div><input></form>", lambda: f"<aside {plain()}>{r.choice([para(), say(1, 3)])}</aside>",
                lambda: f"<div>{r.choice([menu, lines])()}</div>", lambda: f"<p {cls(HIDDEN)}>{say(1, 3)}</p>", lambda: box(2, para()), lambda: box(3, f"<div {plain()}>{para()}</div>"), lambda: f"<div><p><a href='/a'>{short()}</a> | <a href='/b'>{short()}</a> | <a href='/c'>{short()}</a></p></div>",
            ])()

        def comments() -> str:
            one = lambda: r.choice([f"<div {cls(6)}>{para()}</div>", f"<div {plain()}><b>{short()}</b><p {plain()}>{say()}</p></div>", f"<div {plain()}><div {plain()}>{para()}{para()}</div></div>", f"<article {plain()}>{para()}</article>", f"<li>{say()}</li>", f"<li {cls(6)}><b>{short()}</b><p>{say()}</p></li>", f"<article {cls(6)}>{para()}</article>"])
            return f'<{(t := r.choice(["section", "div", "ol"]))} {cls(6)}><h3>{short()}</h3>' + "".join(one() for _ in range(r.randint(1, 5))) + f"</{t}>"

        body = []
        for _ in range(r.randint(1, 12)):
            k = r.random()
            if k < 0.58:
                body.append(para(True))
            elif k < 0.66:
                body.append(f"<h{(h := r.randint(2, 4))}>{say(1, 1, True)}</h{h}>")
            elif k < 0.71:
                body.append("<ul>" + "".join(f"<li>{say(1, 1, True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.74:
                body.append(f"<blockquote>{r.choice([para(True), say(1, 3, True)])}</blockquote>")
            elif k < 0.8:
                body.append("<ul>" + "".join(f"<li>{tiny()}</li>" for _ in range(r.randint(2, 7))) + "</ul>")
            elif k < 0.84:
                body.append(f'<p><a href="/x">{say(1, 2, True)}</a></p>')
            elif k < 0.87:
                body.append("<table><tr>" + "".join(f"<td>{say(1, 1, True)}</td>" for _ in range(3)) + "</tr></table>")
            elif k < 0.97:
                body.append(junk())
            else:
                body.append(f"<div>{say(1, 4, True)}</div>")
        title = f"<h1>{say(1, 1, True)}</h1>"
        if r.random() < 0.2:
            title = f"<header>{title}</header>"
        inner = title + "".join(body)
        wrap = r.choice([
            lambda: f"<article>{inner}{comments() if r.random() < 0.15 else ''}</article>", lambda: f"<main><article {cls(9)}>{inner}</article></main>", lambda: f'<div id="{r.choice(["content", "main"])}">{inner}</div>', lambda: f"<div {cls(9)}>{inner}</div>",
            lambda: f"<main>{inner}</main>", lambda: f"<div><div {cls(9)}>{inner}</div></div>", lambda: f"<section {cls(9)}>{inner}</section>", lambda: inner,
        ])()
        head = r.choice([lambda: f"<header><a href='/'>{short()}</a><nav>{menu()}</nav></header>", lambda: f"<header>{say(1, 2)}</header>", lambda: box(1, f"<a href='/'>{short()}</a>" + menu()), lambda: f"<nav>{menu()}</nav>", lambda: ""])()
        foot = r.choice([lambda: f"<footer>&copy; {say(1, 2)}</footer>", lambda: f"<footer><p>{say(1, 2)}</p>{menu()}</footer>", lambda: box(2, say(1, 2)), lambda: f"<footer>{say(1, 3)}</footer>"])()
        tail = comments() if r.random() < 0.35 else ""
        sides = [junk() for _ in range(r.randint(0, 3))]
        k = r.random()
        if k < 0.14:  # columns of a table
            cells = [f"<td>{r.choice([menu, lines])()}</td>", f"<td {plain()}>{wrap}</td>", f"<td>{r.choice([menu(), lines(), menu() + say(1, 1), junk(), f'<b>{short()}</b><br>{short()}', f'<h3>{short()}</h3>{short()}<br>{short()}', say(1, 1)])}</td>"]
            wrap = f"<table><tr>{''.join(cells[r.randint(0, 1):])}</tr></table>"
        elif k < 0.24:  # names that speak of parts of the page, around all of it
            wrap = f'<div class="{r.choice(["has", "with", "no"])}-{r.choice([word(0), word(3), word(5), word(6), word(2)])} {r.choice(["", "page", "layout"])}">{"".join(sides)}{wrap}</div>'
            sides = []
        elif k < 0.3:  # no article at all
            wrap, good = r.choice([lambda: comments(), lambda: "", lambda: f"<h2>{short()}</h2>" + menu()])(), set()
        cut_ = r.randint(0, len(sides))
        pages.append((f"<html><head><title>{short()}</title></head><body>{head}{''.join(sides[:cut_])}{wrap}{tail}{''.join(sides[cut_:])}{foot}</body></html>", good))
    return pages


def train(pages: list[tuple[str, set[str]]], rounds: int = 12, ridge: float = 1e-5) -> Model:
    """Unary weights by logistic regression (Newton steps); parent-child potentials by the agreement that is more than chance."""
    es, rs, ye, yr, count = [], [], [], [], np.ones((2, 2, 2))
    for html, good in pages:
        nodes = parse(html)
        inside, total = np.zeros(len(nodes)), np.zeros(len(nodes))
        for i in range(len(nodes) - 1, -1, -1):
            n = nodes[i]
            if n.text is not None:
                inside[i], total[i] = len(n.text) * (n.text in good), len(n.text)
            if i:
                inside[n.up] += inside[i]
                total[n.up] += total[i]
        y = inside * 2 > total
        is_run, e, r = features(nodes)
        es.append(e), ye.append(y[~is_run]), rs.append(r), yr.append(y[is_run])
        for i, n in enumerate(nodes[1:], 1):
            count[int(n.text is not None), int(y[n.up]), int(y[i])] += 1

    def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        w, own = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + own, x.T @ (p - y) / len(x) + ridge * w)
            w -= step
        return w

    pair = count / count.sum((1, 2), keepdims=True)
    pair = pair / (pair.sum(2, keepdims=True) * pair.sum(1, keepdims=True))
    return Model(logistic(np.concatenate(es), np.concatenate(ye).astype(float)), logistic(np.concatenate(rs), np.concatenate(yr).astype(float)), pair)


def extract_pages(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars added (columns of these names are replaced).

    Null, empty and textless pages give an empty text. Rows are independent; nothing is gathered.
    """
    model = model or train(labelled_pages())
    out_cols = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = pages.select(*out_cols).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n".join(model.extract(h.as_py())) for h in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*out_cols, F.col(html_col).cast("string").alias(html_col)).mapInArrow(run, schema)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
