"""Main text of web pages by a tree-structured graphical model.

Every element that isn't mere formatting is a node with a label, content or not. Its own features favour one, and each child
leans to its parent's. Messages pass from the leaves to the root and back, which gives exact marginals on a tree; text is
kept where content is likelier. The weights are fitted to labelled pages (`labelled_pages`): the gradient of the likelihood
of their labels takes the same marginals.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.llm.common import id_field, small_batches

#: Elements that stand inside a line of text: their text belongs to the block around them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Start tags that end an open paragraph, and elements that end an open one of their own kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Quotes count in a tag only after an equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)", re.DOTALL)
#: What a head may hold; anything else ends one that is open.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
#: Attributes that may give an inline element marks of its own.
TELLING = re.compile(r"class|\bid\b|role|hidden|style|itemprop", re.IGNORECASE)
NAME = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE | re.DOTALL)

#: Words in class, id and role, by what they mark.
MARKS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs".split(),
    "head": "header masthead banner topbar logo site-header".split(),
    "foot": "footer copyright bottom colophon site-footer contentinfo".split(),
    "side": "sidebar aside widget related recommended trending popular complementary more-stories".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner-ad".split(),
    "notice": "cookie cookies consent gdpr notice modal popup overlay alert newsletter subscribe signup paywall toast".split(),
    "comment": "comment comments reply replies disqus discussion respond reader-comments".split(),
    "social": "share sharing social follow tags".split(),
    "content": "article content post entry story main body text articlebody post-content entry-content article-body".split(),
}
MARK_OF = {w: kind for kind, words in MARKS.items() for w in words}
TAGS = {"article": "article", "main": "main", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "button", "dialog": "aside", "p": "p", "pre": "p", "blockquote": "p", "li": "li", "ul": "ul", "ol": "ul", "td": "cell", "th": "cell", "div": "div", "section": "div", "h1": "h1", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "table": "table", "tbody": "table", "tr": "table", "fieldset": "form", **dict.fromkeys(INLINE, "inline"), "html": "root", "body": "root", "": "root"}
FEATURES = ("bias", *sorted({f"tag_{t}" for t in TAGS.values()}), "tag_other", *(f"mark_{m}" for m in MARKS), "hidden", "no_text", "short", "middle", "long", "ends_sentence", "linked", "half_linked", "under_article", "sentences")
PLACE = {f: i for i, f in enumerate(FEATURES)}
N = len(FEATURES)
#: Parent and child: (neither, content below none, none below content, both).
PAIRS = 4


class Node:
    __slots__ = ("tag", "parent", "marks", "hidden", "text", "links", "gold", "feats")

    def __init__(self, tag: str, parent: int, marks: frozenset[str], hidden: bool, gold: int | None = None):
        self.tag, self.parent, self.marks, self.hidden, self.gold = tag, parent, marks, hidden, gold
        self.text, self.links, self.feats = 0, 0, ()


def attributes(raw: str) -> tuple[frozenset[str], bool]:
    marks, hidden = set(), False
    for name, value in NAME.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name in ("class", "id", "role", "itemprop"):
            for word in value.split():
                for part in (word, *re.split(r"[-_]+", word)):
                    if part in MARK_OF:
                        marks.add(MARK_OF[part])
    return frozenset(marks), hidden


def gold_of(raw: str) -> int | None:
    """The label that an element of a labelled page bears."""
    return int(re.search(r'data-gold="(\d)"', raw)[1]) if "data-gold" in raw else None


#: The parts of a block: node and text.
Block = list[tuple[int, str]]


def joined(parts: Block) -> str:
    """The text of a block's parts, its white space collapsed."""
    return " ".join("".join(t for _, t in parts).split())


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """The nodes, parents first, and the blocks in page order. Inline elements with marks are nodes inside a block."""
    nodes = [Node("", -1, frozenset(), False)]
    stack: list[tuple[str, int]] = [("", 0)]  # open elements, inline ones too, with the node that takes their text
    blocks: list[Block] = []
    run: Block = []
    links = 0  # open links
    opened: dict[str, int] = {}  # how many of each stand open
    at, n = 0, len(page)
    lower: str | None = None

    def flush() -> None:
        nonlocal run
        if run:
            if any(t and not t.isspace() for _, t in run):
                blocks.append(run)
            run = []

    def take(s: str) -> None:
        if not s:
            return
        s = html.unescape(s) if "&" in s else s
        node = stack[-1][1]
        run.append((node, s))
        size = len(s) - s.count(" ") if len(s) < 40 else len(s)
        nodes[node].text += size if not s.isspace() else 0
        if links and not s.isspace():
            nodes[node].links += size

    def close(tag: str, scope: tuple[str, ...] = ()) -> None:
        nonlocal links
        if not opened.get(tag):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                if any(t not in INLINE for t, _ in stack[k:]):
                    flush()
                for t, _ in stack[k:]:
                    links -= t == "a"
                    opened[t] -= 1
                del stack[k:]
                return
            if stack[k][0] in scope or tag in INLINE and stack[k][0] not in INLINE:
                return

    for m in iter(lambda: TOKEN.search(page, at), None):
        take(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                run.append((stack[-1][1], "\n"))
            elif tag == "p" and not opened.get("p"):
                flush()
            else:
                close(tag, ("table",) if tag not in ("table", "body", "html") and tag not in INLINE else ())
            continue
        if tag == "br":
            take("\n")
            continue
        if tag == "a" and links:
            close("a")
        if tag not in IN_HEAD and opened.get("head"):
            close("head")
        if tag in ENDS_P:
            close("p", ("table", "td", "th", "button", "object"))
        if tag in SIBLING:
            for t in SIBLING[tag]:
                close(t, SCOPE[tag])
        if tag in INLINE:
            if tag not in VOID:
                node = stack[-1][1]
                if m[3] and TELLING.search(m[3]):
                    marks, hidden = attributes(m[3])
                    if marks or hidden:
                        nodes.append(Node(tag, node, marks, hidden, gold_of(m[3])))
                        node = len(nodes) - 1
                stack.append((tag, node))
                opened[tag] = opened.get(tag, 0) + 1
                links += tag == "a"
        elif tag not in VOID:
            flush()
            marks, hidden = attributes(m[3]) if m[3] else (frozenset(), False)
            nodes.append(Node(tag, stack[-1][1], marks, hidden, gold_of(m[3])))
            if tag not in RAW:
                stack.append((tag, len(nodes) - 1))
                opened[tag] = opened.get(tag, 0) + 1
        elif tag == "hr":
            flush()
        if tag in RAW:
            if lower is None:
                lower = page.lower()
            # lower() may change lengths of odd letters; then search without it
            k = lower.find("</" + tag, at) if len(lower) == n else (x.start() if (x := re.compile("</" + tag, re.IGNORECASE).search(page, at)) else -1)
            stop = page.find(">", k) if k >= 0 else -1
            at = stop + 1 if stop >= 0 else n
    take(page[at:])
    flush()
    return nodes, blocks


def describe(nodes: list[Node], blocks: list[Block]) -> None:
    """Sets each node's features. Text of a node without its own is that of its blocks below."""
    ends = [False] * len(nodes)
    total = [x.text for x in nodes]
    linked = [x.links for x in nodes]
    sentences = [0] * len(nodes)
    for parts in blocks:
        text = joined(parts)
        if text and text[-1] in ".!?\"”»:" and len(text) > 12:
            for k in {k for k, t in parts if not t.isspace()}:
                ends[k] = True
                sentences[k] += 1
    for k in range(len(nodes) - 1, 0, -1):
        sentences[nodes[k].parent] += sentences[k]
        total[nodes[k].parent] += total[k]
        linked[nodes[k].parent] += linked[k]
    below = [False] * len(nodes)
    for k, x in enumerate(nodes):
        tag = TAGS.get(x.tag, "other")
        below[k] = x.parent >= 0 and (below[x.parent] or nodes[x.parent].tag in ("article", "main") or "content" in nodes[x.parent].marks)
        t = total[k]
        f = ["bias", f"tag_{tag}", *(f"mark_{m}" for m in x.marks)]
        if x.hidden:
            f.append("hidden")
        f.append("no_text" if t == 0 else "short" if t < 25 else "middle" if t < 100 else "long")
        if ends[k]:
            f.append("ends_sentence")
        if t and linked[k] > 0.7 * t:
            f.append("linked")
        elif t and linked[k] > 0.3 * t:
            f.append("half_linked")
        if below[k]:
            f.append("under_article")
        if sentences[k] > 2:
            f.append("sentences")
        x.feats = tuple(PLACE[i] for i in f)


def marginals(nodes: list[Node], w: list[float], pair: list[float]) -> tuple[list[float], list[float]]:
    """Each node's chance to be content, and the expected counts of the kinds of pairs: sum-product up, then down."""
    n = len(nodes)
    own = [sum(w[f] for f in x.feats) for x in nodes]
    e = [math.exp(p) for p in pair]
    up0, up1 = [1.0] * n, [math.exp(max(-60.0, min(60.0, s))) for s in own]
    m0, m1 = [1.0] * n, [1.0] * n  # a node's message to its parent
    for k in range(n - 1, 0, -1):
        a, b = up0[k], up1[k]
        to0, to1 = a * e[0] + b * e[1], a * e[2] + b * e[3]
        z = to0 + to1
        m0[k], m1[k] = to0 / z, to1 / z
        p = nodes[k].parent
        up0[p] *= m0[k]
        up1[p] *= m1[k]
        z = up0[p] + up1[p]
        up0[p], up1[p] = up0[p] / z, up1[p] / z
    at0, at1 = up0[:], up1[:]
    z = at0[0] + at1[0]
    at0[0], at1[0] = at0[0] / z, at1[0] / z
    counts = [0.0] * PAIRS
    for k in range(1, n):
        p = nodes[k].parent
        out0, out1 = at0[p] / max(m0[k], 1e-300), at1[p] / max(m1[k], 1e-300)  # the parent without this child
        j00, j01, j10, j11 = out0 * e[0] * up0[k], out0 * e[1] * up1[k], out1 * e[2] * up0[k], out1 * e[3] * up1[k]
        z = j00 + j01 + j10 + j11
        counts[0] += j00 / z
        counts[1] += j01 / z
        counts[2] += j10 / z
        counts[3] += j11 / z
        at1[k] = (j01 + j11) / z
        at0[k] = 1 - at1[k]
    return at1, counts


def labelled_pages(n: int = 72) -> list[str]:
    """Pages of several layouts whose elements bear their labels (data-gold), written by a fixed seed: with and without telling
    elements and names, inside one form, laid out by tables, with unclosed elements, articles among the clutter, and inline
    clutter."""
    r = random.Random(7)
    word = lambda: "".join(r.choice(("ba", "ne", "ti", "lo", "ru", "sa", "me", "ko")) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + "."
    el = lambda tag, y, inner, attr="": f'<{tag} {attr} data-gold="{y}">{inner}</{tag}>'
    menu = lambda k: el("ul", 0, "".join(el("li", 0, f'<a href="/{word()}">{words(1, 3)}</a>') for _ in range(k)))

    def para() -> str:
        text = " ".join(sentence() for _ in range(r.choice((1, 1, 2, 4, 6))))
        if r.random() < 0.1:
            text += el("span", 0, words(1, 3), r.choice(('class="ad"', 'class="share"', 'class="comment-count"')))
        elif r.random() < 0.1:
            text = el("span", 1, words(2, 6), r.choice(('class="text"', 'class="story-lead"'))) + " " + text
        return el("p", 1, text)

    names = {  # element and attribute, by kind
        "nav": ("nav div ul", 'class="menu"|id="navigation"|class="navbar top"'), "header": ("header div", 'class="header masthead"|class="site-header"'), "footer": ("footer div", 'class="footer"|id="site-footer"'),
        "aside": ("aside div", 'class="sidebar"|class="related"|id="widget"'), "ad": ("div", 'class="ad"|class="advert"|id="sponsored"|class="promo"'), "notice": ("div section", 'class="cookie-notice"|id="consent"|class="newsletter modal"'),
        "comment": ("section div", 'class="comments"|id="comments"|class="comment-list"'), "social": ("div", 'class="share"|class="social-links"'), "form": ("form", 'action="/go"'),
    }

    def clutter(kind: str, plain: bool) -> str:
        tags, attrs = names[kind]
        tag, attr = r.choice(tags.split()), r.choice(attrs.split("|"))
        if plain:
            tag, attr = "div" if kind != "form" else "form", r.choice(("", f'class="{word()}"'))
        elif tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5:
            attr = ""
        if kind in ("nav", "social") or plain and kind in ("comment", "notice", "ad", "aside"):
            inner = menu(r.randint(2, 7))
        elif kind == "comment":
            inner = "".join(el(r.choice(("div", "div", "article")), 0, el("p", 0, " ".join(sentence() for _ in range(r.randint(1, 4)))), 'class="comment"') for _ in range(r.randint(1, 4)))
        elif kind == "form":
            inner = f'<label>{words(1, 3)}</label><input name="q">' + el("button", 0, word())
        elif kind == "aside" and r.random() < 0.4:
            inner = el("h3", 0, words(1, 3)) + "".join(el("article", 0, el("h4", 0, f'<a href="#">{words(3, 8)}</a>') + el("p", 0, f'<a href="#">{sentence()}</a>')) for _ in range(r.randint(1, 3)))
        else:
            body = sentence() if r.random() < 0.7 and not plain else words(2, 5)
            inner = r.choice((body, el("p", 0, body), el("h3", 0, words(1, 3)) + el("p", 0, f'{body} <a href="#">{word()}</a>'), el("div", 0, f"{body} {sentence()}" if not plain else body)))
        return el(tag, 0, inner, attr)

    out = []
    for i in range(n):
        layout = ("usual", "usual", "form", "tables", "plain", "usual")[i % 6]
        plain = layout == "plain"
        blocks = [el("h1", 1, words(3, 9))] + [para() for _ in range(r.randint(2, 8))]
        if r.random() < 0.5:
            blocks.insert(r.randint(2, len(blocks)), el("h2", 1, words(2, 6)))
        if r.random() < 0.4:
            blocks.insert(r.randint(1, len(blocks)), el("ul", 1, "".join(el("li", 1, r.choice((words(2, 5), sentence()))) for _ in range(r.randint(2, 5)))))
        if r.random() < 0.3:
            blocks.insert(r.randint(1, len(blocks)), el("blockquote", 1, el("p", 1, sentence())))
        if r.random() < 0.3:
            blocks.insert(r.randint(1, len(blocks)), el("table", 1, el("tr", 1, el("td", 1, words(1, 3)) + el("td", 1, sentence()))))
        if r.random() < 0.3:
            blocks.insert(r.randint(1, len(blocks)), el("p", 1, words(1, 4)))
        for kind in r.sample(("ad", "aside", "social", "comment", "form", "notice"), r.randint(0, 3)) if not plain else ():
            blocks.insert(r.randint(1, len(blocks)), clutter(kind, plain))
        body = "".join(blocks)
        wrap = r.choice(("article", "article", "article", "main", "div content", "div post", "div", "main article")) if not plain else r.choice(("div", "section", "div div"))
        for part in reversed(wrap.split()):
            body = el(part, 1, body) if part in ("article", "main", "div", "section") else body
        if "content" in wrap or "post" in wrap:
            body = body.replace("<div", f'<div class="{wrap.split()[1]}"', 1)
        before = "".join(clutter(k, plain) for k in r.sample(("nav", "header", "ad", "notice", "form"), r.randint(1, 4)))
        after = "".join(clutter(k, plain) for k in r.sample(("footer", "comment", "aside", "ad", "nav", "notice", "social"), r.randint(1, 4)))
        if layout == "tables":
            cells = el("td", 0, menu(r.randint(3, 8))) + el("td", 1, body) + (el("td", 0, el("p", 0, words(1, 6))) if r.random() < 0.5 else "")
            page = el("table", 1, el("tr", 0, el("td", 0, before, 'colspan="3"')) + el("tr", 1, cells) + el("tr", 0, el("td", 0, after, 'colspan="3"')))
        else:
            page = f"{before}{body}{after}"
        if layout == "form":
            page = el("form", 1, page, 'method="post" action="/page"')
        if r.random() < 0.25:
            page = page.replace("</p>", "").replace("</li>", "").replace("</td>", "").replace("</tr>", "")
        out.append(f'<!DOCTYPE html><html data-gold="1"><head data-gold="0"><title>{words(2, 6)}</title></head><body data-gold="1">{page}</body></html>')
    return out


@lru_cache(maxsize=1)
def weights(rounds: int = 80, rate: float = 0.5, ridge: float = 0.02) -> tuple[list[float], list[float]]:
    pages = []
    for page in labelled_pages():
        nodes, blocks = parse(page)
        for x in nodes:
            x.gold = (nodes[x.parent].gold if x.parent >= 0 else 1) if x.gold is None else x.gold
        describe(nodes, blocks)
        pages.append(nodes)
    w, pair = [0.0] * N, [0.0] * PAIRS
    w2, p2 = [1e-6] * N, [1e-6] * PAIRS
    for _ in range(rounds):
        gw, gp = [-ridge * x for x in w], [-ridge * x for x in pair]
        for nodes in pages:
            at, counts = marginals(nodes, w, pair)
            for k, x in enumerate(nodes):
                d = (x.gold - at[k]) / len(nodes)
                for f in x.feats:
                    gw[f] += d
                if k:
                    gp[2 * nodes[x.parent].gold + x.gold] += 1 / len(nodes)
            for k in range(PAIRS):
                gp[k] -= counts[k] / len(nodes)
        for v, g, s in ((w, gw, w2), (pair, gp, p2)):
            for k, x in enumerate(g):
                s[k] += x * x
                v[k] += rate * x / math.sqrt(s[k])
    return w, pair


#: Elements whose content isn't shown as text. All others are judged by their marginals.
NEVER = frozenset("script style title noscript template svg head textarea select option iframe xmp noembed noframes".split())


def main_text(page: str, model: tuple[list[float], list[float]]) -> str:
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    describe(nodes, blocks)
    at, _ = marginals(nodes, *model)
    kept = [True] * len(nodes)
    for k, x in enumerate(nodes):
        kept[k] = not (x.tag in NEVER or x.hidden) and (x.parent < 0 or kept[x.parent])
    texts = (joined([(k, t) for k, t in parts if kept[k] and at[k] > 0.5]) for parts in blocks)
    return " ".join(t for t in texts if t)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per page: identifier, url, text and n_chars (code points).

    A null or empty page has an empty text, as has one without likely content. Broken markup is read as far as it goes: open
    elements end with the page. Repeated rows each get a row; extra columns are ignored.
    """
    spark = df.sparkSession
    small_batches(spark)
    model = weights()
    schema = T.StructType([id_field(df, id_col), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(p or "", model) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    return df.select(F.col(id_col), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, schema)
