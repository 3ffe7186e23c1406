"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page.

A page becomes the sequence of its blocks: runs of text that no block-level tag divides, each with the
tags, classes and ids of its ancestors. Features of a block are its ancestors' tags and the kinds of
names in their classes and ids, and its text's length, share of link text and punctuation. The field
has the labels main and other, a weight for each feature, and weights for neighbouring labels; it is
trained by gradient ascent on the likelihood of labelled pages (``labelled_pages`` makes them: several
layouts of sites, with each block's label known) and decoded by Viterbi. The text is the blocks
labelled main, character references decoded, white space within a block made one space, trimmed, and
joined by one space.

Every page is handled in place from its whole html; nothing is shuffled, and the model is a few
hundred numbers.

Defined cases: null and empty html give the empty text; unclosed and misnested tags close with their
parents; a tag cut off by the page's end, and an unclosed script, style, textarea or title, reach to the end;
what browsers don't show of iframe, noembed, noframes and template is left out where they are closed;
one of these that ends with '/>' has no content; repeated rows are rows; an empty table gives no rows; other columns are carried along, except that columns
named like the outputs are replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import map_slices, read

_ATTRS = r"""(?:[^>"'/]++|/(?!>)|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea)(?=[\s/>]){_ATTRS}(?:/>|>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z))"""
    # not shown, but only left out up to an end of its own: nothing is lost after an unclosed one
    rf"""|<(?P<unseen>iframe|noembed|noframes|template)(?=[\s/>]){_ATTRS}(?:/>|>(?:[^<]++|<(?!/?(?P=unseen)[\s/>]))*+</(?P=unseen)[^>]*+>)"""
    r"""|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)""",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img object".split())
#: Drawings and formulas stand in a line; the text elements of drawings are blocks.
_INLINE |= frozenset("svg g path circle ellipse line rect polygon polyline defs use symbol marker mask pattern image filter stop clippath lineargradient radialgradient tspan textpath".split())
_INLINE |= frozenset("math semantics annotation mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose merror mmultiscripts mprescripts".split())
#: What an opening tag closes, and the tags beyond which it doesn't look.
_CLOSES = {t: (frozenset({"p"}), frozenset("td th li div section article body button".split())) for t in "p div ul ol dl h1 h2 h3 h4 h5 h6 section article aside nav header footer form table blockquote pre main figure hr address fieldset".split()}
_CLOSES |= {"li": (frozenset({"li"}), frozenset({"ul", "ol"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "tr": (frozenset({"tr"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "option": (frozenset({"option"}), frozenset({"select"})), "body": (frozenset({"head"}), frozenset())}
_ATTR = re.compile(r"""(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Kinds of names, looked for among the words of classes and ids.
_KINDS = [
    ("ad", r"ads?|adverts?|advertisement|adbox|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|dfp|teaser"),
    ("menu", r"nav(?:igation|bar)?|menu|breadcrumbs?|pagination|pager|toc|tabs?|toolbar|skip"),
    ("side", r"side(?:bar)?|widget|aside|rail|related|recommend(?:ed|ations)?|popular|trending|more|links|tags?"),
    ("notice", r"cookies?|consent|gdpr|notice|alert|popup|modal|overlay|disclaimer|paywall|privacy"),
    ("talk", r"comments?|respond|repl(?:y|ies)|discussion|disqus|thread|feedback|reviews?"),
    ("share", r"share|sharing|social|follow|buttons?"),
    ("foot", r"foot(?:er)?|copyright|legal|colophon|bottom"),
    ("head", r"head(?:er)?|masthead|top(?:bar)?|logo|brand|hero"),
    ("form", r"form|subscribe|newsletter|signup|login|search|register"),
    ("body", r"article|post|entry|story|content|text|body|main|prose|copy|read"),
]
_KIND = {}


def _kinds(names: str) -> set[str]:
    out = set()
    for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()):
        if word not in _KIND:
            if len(_KIND) > 100_000:
                _KIND.clear()
            _KIND[word] = [k for k, pattern in _KINDS if re.fullmatch(pattern, word)]
        out.update(_KIND[word])
    return out


#: Other names, of which a page may have any number, give one common feature: so paths stay small at any depth.
_TAGS = _INLINE | _VOID | frozenset("html head body title article aside section nav main header footer h1 h2 h3 h4 h5 h6 hgroup search address p pre blockquote ul ol li dl dt dd div figure figcaption table caption colgroup thead tbody tfoot tr td th form fieldset legend button select option optgroup textarea output progress meter datalist details summary dialog menu noscript center dir frameset iframe noembed noframes template xmp audio video picture canvas map text desc foreignobject slot strike".split())
_ROLES = frozenset("alert alertdialog application article banner button complementary contentinfo definition dialog document feed figure form group heading img link list listbox listitem log main marquee math menu menubar menuitem navigation none note option presentation region row rowgroup search searchbox separator status switch tab table tablist tabpanel term textbox timer toolbar tooltip tree".split())


@lru_cache(1 << 14)
def _own(tag: str, attrs: str) -> tuple[frozenset[str], str | None]:
    """Features that an element gives to the blocks in it; its ``data-main``."""
    out, label = {f"in:{tag if tag in _TAGS else '*'}"}, None
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "data-main":
                label = value
            else:
                kinds = _kinds(value)
                out |= {f"kind:{k}" for k in kinds}
                if name == "role":
                    out.add(f"role:{role if (role := value.lower()) in _ROLES else '*'}")
    return frozenset(out), label


@dataclass
class Block:
    text: str
    path: frozenset[str]
    tag: str
    linked: int = 0
    label: str | None = None


@dataclass(slots=True)
class _Frame:
    tag: str
    path: frozenset[str]
    label: str | None
    block: str = ""


def blocks_of(html: str) -> list[Block]:
    """The page's blocks that have text, in order."""
    out: list[Block] = []
    stack = [_Frame("", frozenset(), None, "")]
    places: dict[str, list[int]] = {}  # of the open elements of a tag in the stack, so that no search walks it
    blocks: list[int] = []  # places of those that are not inline
    held: list[str] = []
    where = stack[0]
    linked = depth = 0  # characters of link text in the block; open links

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(Block(text, where.path, where.block, linked, where.label))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal where, linked
        if not text:
            return
        if not held:
            where = stack[-1]
        held.append(text)
        if depth:
            linked += len(text)

    def pop_to(n: int) -> None:
        nonlocal depth
        while len(stack) > n:
            tag = stack.pop().tag
            places[tag].pop()
            if tag not in _INLINE:
                blocks.pop()
            depth -= tag == "a"

    def last(tags: Iterable[str]) -> int:
        return max([places[t][-1] for t in tags if places.get(t)], default=0)

    at = 0
    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        if (tag := m["tag"]) is None:
            continue
        tag = tag.lower()
        inline = tag in _INLINE
        if tag == "br":
            add(" ")
            continue
        if not inline:
            flush()
        if m["close"]:
            if (i := last((tag,))) and not (inline and blocks and blocks[-1] > i):
                pop_to(i)
        elif tag not in _VOID:
            if tag in _CLOSES:
                closed, beyond = _CLOSES[tag]
                if (i := last(closed)) > last(beyond):
                    pop_to(i)
            if m["attrs"].endswith("/") and inline:
                continue
            own, label = _own(tag, m["attrs"])
            top = stack[-1]
            places.setdefault(tag, []).append(len(stack))
            if not inline:
                blocks.append(len(stack))
            stack.append(_Frame(tag, top.path if own <= top.path else top.path | own, top.label if label is None else label, top.block if inline else tag))
            depth += tag == "a"
    add(html[at:])
    flush()
    return out


def features_of(block: Block, n: int, size: int) -> list[str]:
    """Names of the block's features; it is the n-th of ``size``."""
    text = block.text
    words = text.count(" ") + 1
    ends = text[-1] in ".!?…\"”»:;"
    out = ["bias", f"tag:{block.tag}", f"words:{min(words.bit_length(), 8)}", f"ends:{ends}", f"ends:{ends}:{words >= 8}", f"linked:{min(4, 5 * block.linked // max(1, len(text)))}", f"commas:{min(3, text.count(','))}"]
    if "©" in text or "copyright" in text.lower() or "all rights" in text.lower():
        out.append("rights")
    if "|" in text or "»" in text or "›" in text:
        out.append("bars")
    if n == 0:
        out.append("first")
    if n == size - 1:
        out.append("last")
    inside = "in:article" in block.path or "in:main" in block.path or "kind:body" in block.path
    out.append(f"inside:{inside}:{words >= 8}")
    return out + sorted(block.path)


@dataclass
class Field:
    """Weights for the label main against other; ``between[a, b]`` for label a before label b."""

    weights: dict[str, float] = field(default_factory=dict)
    between: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi's most likely labels; equal scores go to other."""
        if not blocks:
            return []
        get, size = self.weights.get, len(blocks)
        (oo, om), (mo, mm) = self.between.tolist()
        back = []
        other, main = self.start.tolist()
        for n, block in enumerate(blocks):
            gain = sum(get(f, 0.0) for f in features_of(block, n, size))
            if n:
                a, b, c, d = other + oo, main + mo, other + om, main + mm
                back.append((b > a, d > c))
                other, main = max(a, b), max(c, d)
            main += gain
        labels = [main > other]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def extract(self, html: str | None) -> str:
        blocks = blocks_of(html or "")
        return " ".join(b.text for b, main in zip(blocks, self.decode(blocks), strict=True) if main)


def fit(pages: list[list[Block]], *, steps: int = 250, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood with L2 decay, by Adam; all pages take a step of the chain together."""
    pages = [p for p in pages if p]
    size = max(map(len, pages))
    names: dict[str, int] = {}
    rows, cols = [], []
    y, real = np.zeros((len(pages), size), int), np.zeros((len(pages), size), bool)
    for i, page in enumerate(pages):
        for n, b in enumerate(page):
            real[i, n], y[i, n] = True, b.label == "1"
            for f in features_of(b, n, len(page)):
                rows.append(i * size + n)
                cols.append(names.setdefault(f, len(names)))
    rows, cols, k = np.array(rows), np.array(cols), len(names)
    x = np.zeros(k + 6)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        gain = np.bincount(rows, weights=x[:k][cols], minlength=y.size).reshape(y.shape)
        between, start = x[k : k + 4].reshape(2, 2), x[k + 4 :]
        marg, pair = _marginals(gain, between, start, real)
        g = np.zeros_like(x)
        g[:k] = np.bincount(cols, weights=((y == 1) * real - marg[:, :, 1]).reshape(-1)[rows], minlength=k)
        both = real[:, 1:]
        for a in (0, 1):
            g[k + 4 + a] = ((y[:, 0] == a) - marg[:, 0, a]).sum()
            for b in (0, 1):
                g[k + 2 * a + b] = (((y[:, :-1] == a) & (y[:, 1:] == b)) * both - pair[:, :, a, b] * both).sum()
        g = g / len(pages) - decay * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field({f: float(x[i]) for f, i in names.items()}, x[k : k + 4].reshape(2, 2), x[k + 4 :])


def _marginals(gain: np.ndarray, between: np.ndarray, start: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and pair marginals by forward-backward in logarithms; past a page's end the chain stands still."""
    n, size = gain.shape
    emit = np.stack([np.zeros_like(gain), gain], axis=2)
    ahead, behind = np.zeros((n, size, 2)), np.zeros((n, size, 2))
    ahead[:, 0] = start + emit[:, 0]
    for t in range(1, size):
        new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + between, axis=1) + emit[:, t]
        ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
    for t in range(size - 2, -1, -1):
        new = np.logaddexp.reduce(between[None] + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        behind[:, t] = np.where(real[:, t + 1, None], new, 0)
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    marg = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
    pair = np.exp(ahead[:, :-1, :, None] + between + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
    return marg, pair


def labelled_pages(n: int = 400, seed: int = 7) -> list[str]:
    """Training pages. Elements with ``data-main`` 1 hold the main text, unless one within has 0."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("a e i o u an er in on th st re sch ion ment la el que".split()) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def sentence(a: int = 4, b: int = 18) -> str:
        s = words(a, b).capitalize()
        return s.replace(" ", ", ", r.randint(0, 2)) + r.choice(["."] * 6 + ["!", "?"])

    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(r.randint(a, b)))
    links = lambda a, b, tag="li": "".join(f'<{tag}><a href="/{word()}">{words(1, 4)}</a></{tag}>' for _ in range(r.randint(a, b)))
    pick = lambda *x: r.choice(x)

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.12:
            return f"<p>{pick(word().capitalize() + '.', words(1, 3).capitalize() + '.', sentence(1, 3))}</p>"
        if kind < 0.2:
            return f"<h{(k := r.randint(2, 4))}>{words(1, 7).capitalize()}</h{k}>"
        if kind < 0.28:
            return "<ul>" + "".join(f"<li>{pick(words(1, 6), sentence(), prose(1, 2))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.33:
            return f"<blockquote><p>{prose(1, 2)}</p></blockquote>"
        if kind < 0.37:
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"
        if kind < 0.4:
            return f"<pre>{words(3, 12)}</pre>"
        if kind < 0.43:
            return f"<p>{' | '.join(words(1, 2) for _ in range(r.randint(3, 9)))}</p>"
        if kind < 0.55:
            return f'<p><b>{prose(1, 3)}<br><p>{prose(1, 3)} <a href="/x">{words(1, 5)}</a> {prose(1, 2)}</p>'
        return f"<p>{prose()}{pick('', '</p>')}"

    def article() -> str:
        return f"<h1>{words(2, 14).capitalize()}</h1>" * (r.random() < 0.8) + "".join(paragraph() for _ in range(r.randint(1, 9)))

    def talk() -> str:
        each = "".join(f'<{(t := pick("div", "li", "article"))} class="{pick("comment", "reply", "comment-body", "review")}"><{(a := pick("p", "span", "div"))}>{words(1, 2)}</{a}><p>{prose(1, 3)}</p></{t}>' for _ in range(r.randint(1, 4)))
        return f'<{(s := pick("section", "div", "ol", "aside"))} {pick("id", "class")}="{pick("comments", "reader-comments", "comment-list", "discussion", "disqus_thread", "responses reviews")}" data-main="0">{pick("<h3>Comments</h3>", "<h2>" + words(1, 3) + "</h2>", "")}{each}</{s}>'

    def other(kind: str) -> str:
        if kind == "menu":
            t = pick("nav", "nav", "div", "ul")
            return f'<{t} class="{pick("menu", "nav", "main-nav", "navbar", "breadcrumbs")}"><ul>{links(2, 8)}</ul></{t}>' if t != "nav" or r.random() < 0.4 else f"<nav>{pick('<ul>' + links(2, 8) + '</ul>', links(3, 6, 'span'))}</nav>"
        if kind == "head":
            return pick(f"<header><h1>{words(1, 4)}</h1><p>{pick(words(2, 7), sentence())}</p></header>", f'<div class="{pick("header", "masthead", "topbar", "site-header")}"><a href="/">{words(1, 3)}</a><p>{words(1, 6)}</p></div>', f"<header><nav><ul>{links(2, 6)}</ul></nav></header>")
        if kind == "foot":
            body = pick(f"&copy; {words(1, 3)} &middot; {prose(1, 3)}", f"<p>Copyright {word()}. All rights reserved.</p><ul>{links(2, 5)}</ul>", f"<p>{prose(1, 3)}</p>")
            return pick(f"<footer>{body}</footer>", f"<footer>{body}</footer>", f'<div {pick("id", "class")}="{pick("footer", "site-footer", "colophon")}">{body}</div>')
        if kind == "ad":
            return f'<{(t := pick("div", "div", "aside", "section", "p"))} {pick("class", "id")}="{pick("ad", "ads", "advert", "ad-box", "sponsored", "promo", "banner")}">{pick(prose(1, 3), words(2, 12), f"<p>{prose(1, 2)}</p>")}</{t}>'
        if kind == "side":
            body = pick(f"<h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul>", f"<p>{prose(1, 2)}</p>", f"<h4>{words(1, 3)}</h4><p>{prose(1, 3)}</p>")
            return pick(f"<aside>{body}</aside>", f'<div class="{pick("sidebar", "widget", "related-posts", "side", "recommended")}">{body}</div>')
        if kind == "notice":
            return f'<div {pick("class", "id")}="{pick("cookie-notice", "cookies", "consent-banner", "gdpr", "notice", "alert", "popup")}"><p>{prose(1, 3)}</p>{pick("", "<button>" + words(1, 2) + "</button>")}</div>'
        if kind == "form":
            return f'<form class="{pick("", "search", "newsletter", "subscribe")}"><label>{words(1, 4)}</label><input type="text"><p>{pick(sentence(), words(2, 6))}</p><select><option>{word()}<option>{word()}</select><button>{word()}</button></form>'
        return f'<div class="{pick("share", "social-links", "share-buttons")}">{links(2, 5, "span")}</div>'

    def page() -> str:
        body = article()
        if r.random() < 0.35:
            cut = other(pick("ad", "side", "share", "form", "notice"))
            body = body.replace("</p>", "</p>" + cut.replace(" ", ' data-main="0" ', 1) if " " in cut.split(">")[0] else "</p>" + cut.replace(">", ' data-main="0">', 1), 1)
        if r.random() < 0.35:
            body += talk()
        layout = r.random()
        if layout < 0.5:
            main = f'<article data-main="1">{body}</article>'
        elif layout < 0.6:
            main = f'<main data-main="1">{body}</main>'
        elif layout < 0.9:
            main = f'<div {pick("class", "id")}="{pick("content", "post", "entry-content", "article-body", "story", "main", "post-text")}" data-main="1">{body}</div>'
        else:
            main = f'<div data-main="1">{body}</div>'
        if r.random() < 0.3:
            main = f"<{(t := pick('main', 'div', 'section'))}>{main}</{t}>"
        if r.random() < 0.3:
            main += talk()
        before = [other(k) for k in ("notice", "head", "menu", "ad", "form", "share", "side") if r.random() < {"menu": 0.8, "head": 0.45, "ad": 0.5}.get(k, 0.2)]
        r.shuffle(before)
        after = [other(k) for k in ("side", "ad", "share", "form", "menu") if r.random() < 0.3] + [other("foot")] * (r.random() < 0.9)
        return f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"

    bare = lambda: f'<body data-main="1">{pick(prose(1, 5), "".join(paragraph() for _ in range(r.randint(1, 5))))}</body>'
    return [bare() if r.random() < 0.06 else page() for _ in range(n)]


@lru_cache(1)
def default_field() -> Field:
    return fit([blocks_of(p) for p in labelled_pages()])


def extract(pages: DataFrame, *, html: str = "html", model: Field | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points)."""
    pages = pages.select([c for c in pages.columns if c not in ("text", "n_chars")])
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    shared, carried = pages.sparkSession.sparkContext.broadcast(model or default_field()), list(pages.columns)

    def each(batch: pa.RecordBatch) -> dict:
        texts = [shared.value.extract(x) for x in batch.column(html).to_pylist()]
        return {c: batch.column(c) for c in carried} | {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_slices(pages, html, schema, each)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html"))).select("page_id", "url", "text", "n_chars")
