"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element and each run of text is a node with a hidden label: content or not. Potentials connect
parent and child, and each node has evidence of its own (its tag, words of its class and id, length
and share of links). Sum-product messages upward and downward give every node's marginal. Potentials
are counts over labelled pages; ``labelled_pages`` builds the default ones.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import text_or_empty

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page: scripts, styles and templates, fields of forms, the page's title, graphics, what
#: stands in for media that a browser can't play, and the annotations of formulas. Content of noscript and math is text like any other.
RAW = frozenset("script style textarea title iframe template svg select object canvas audio video annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small "
                   "span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder "
                   "mover munderover mtable mtr mtd mstyle mspace mpadded merror semantics".split())
#: An opening tag of the first ends an open element of the second kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tr"}, "tfoot": {"tbody", "tr", "td", "th"}}
_BLOCKS_END_P = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 "
                          "h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold running text; the label passes on to their children otherwise than in containers.
TEXTUAL = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd figcaption blockquote pre".split())
_WALLS = frozenset("html body table td th article section div main aside nav header footer ul ol dl form blockquote figure".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_STOP = re.compile("[<>\"']")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]*)[^;!]*(!\s*important)?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str  # "#text" for a run of text
    parent: int
    marks: str = ""
    text: str = ""
    children: list[int] = field(default_factory=list)
    hidden: bool = False


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values of an opening tag's attributes; the first of a name counts, as in browsers."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape("".join(values)))
    return out


def is_hidden(raw: str) -> bool:
    """Whether an element with these attributes is not shown: hidden, aria-hidden with value true, or display none in its style."""
    low = raw.lower()
    if "hidden" not in low and "style" not in low:
        return False
    own = attributes(raw)
    if "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true":
        return True
    said = _DISPLAY.findall(_COMMENT.sub("", own.get("style", "").lower()))
    # the last declaration counts, those marked important before others
    return bool(said) and ([x for x in said if x[1]] or said)[-1][0] == "none"


class _Tags:
    """The tags of a page in turn. Each character is looked at a few times at most, however broken the page is.

    A tag goes from ``<`` and a letter to the next ``>`` outside of quotes. If another ``<`` or the end comes first, the
    ``<`` is text. A quote that nothing closes is a character like others.
    """

    def __init__(self, page: str) -> None:
        self._page = page
        self._last = {c: page.rfind(c) for c in "\"'>"}

    def _end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, -1 if there is none."""
        if self._last[">"] < at:
            return -1
        while m := _STOP.search(self._page, at):
            if m[0] == ">":
                return m.start()
            if m[0] == "<":
                return -1
            at = self._page.find(m[0], m.end()) + 1 if self._last[m[0]] >= m.end() else m.end()
        return -1

    def after(self, at: int) -> tuple[int, int, str, str, str]:
        """(begin, end, slash, name in lower case, attributes) of the next tag from ``at`` on; comments and declarations have no name."""
        page, size = self._page, len(self._page)
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, (size if end < 0 else end + 3), "", "", ""
            if page.startswith(("<!", "<?"), at):
                if self._last[">"] > at:
                    return at, page.find(">", at) + 1, "", "", ""
            elif m := _TAG.match(page, at):
                end = self._end(m.end())
                if end >= 0:
                    return at, end + 1, m[1], m[2].lower(), page[m.end():end]
            at += 1
        return size, size, "", "", ""


def parse(page: str) -> list[Node]:
    """Nodes in page order; a parent comes before its children. Broken markup closes as browsers close it."""
    nodes = [Node("#root", -1)]
    open_ = [0]
    opened: Counter[str] = Counter()  # how many elements of a tag are open
    unended: set[str] = set()  # tags that have no end any more

    def say(text: str) -> None:
        if text:
            nodes.append(Node("#text", open_[-1], text=entities.unescape(text)))
            nodes[open_[-1]].children.append(len(nodes) - 1)

    def close(k: int) -> None:
        opened.subtract(nodes[i].tag for i in open_[k:])
        del open_[k:]

    tags = _Tags(page)
    at, size = 0, len(page)
    while at < size:
        begin, end, slash, tag, raw = tags.after(at)
        say(page[at:begin])
        at = end
        if not tag:
            continue
        if slash:
            for k in range(len(open_) - 1, 0, -1) if opened[tag] else ():
                if nodes[open_[k]].tag == tag:
                    close(k)
                    break
                if nodes[open_[k]].tag in _WALLS and tag in INLINE | {"p"}:
                    break
            continue
        if tag in _BLOCKS_END_P and opened["p"]:
            for k in range(len(open_) - 1, 0, -1):
                if nodes[open_[k]].tag == "p":
                    close(k)
                    break
                if nodes[open_[k]].tag in _WALLS:
                    break
        ended = _CLOSES.get(tag, ())
        while ended and nodes[open_[-1]].tag in ended:
            close(len(open_) - 1)
        marks = " ".join(a or b or c for a, b, c in _MARKS.findall(raw)).lower()
        nodes.append(Node(tag, open_[-1], marks=marks, hidden=tag in RAW or is_hidden(raw)))
        nodes[open_[-1]].children.append(len(nodes) - 1)
        if tag in RAW and not raw.endswith("/"):
            found = None if tag in unended else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if found is None:
                unended.add(tag)
            at = found.end() if found else (size if tag in ("script", "style") else at)
        elif tag not in VOID and not raw.endswith("/"):
            open_.append(len(nodes) - 1)
            opened[tag] += 1
    return nodes


def evidence(nodes: list[Node]) -> list[list[str]]:
    """Features of every node. A formula and its signs have none: they go with the text around them."""
    size, linked = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        if n.tag == "#text":
            size[i] = len(n.text.strip())
        if n.tag == "a":
            linked[i] = size[i]
        if not n.hidden:
            size[n.parent] += size[i]
            linked[n.parent] += linked[i]
    out: list[list[str]] = []
    formula = [False] * len(nodes)
    for i, n in enumerate(nodes):
        formula[i] = n.tag == "math" or (i > 0 and formula[n.parent])
        if formula[i]:
            out.append([])
            continue
        share = linked[i] / size[i] if size[i] else 0.0
        level = min(7, int(math.log2(size[i] + 1) // 1.5))
        own = [f"t:{n.tag}", f"l:{level}", f"k:{int(share * 3.99)}"]
        if n.marks:
            own += [f"m:{w}" for w in set(_WORD.findall(n.marks))]
        if n.tag in ("div", "section"):
            own.append("plain" if not n.marks else "named")
        out.append(own)
    return out


@dataclass
class TreeModel:
    """Logarithms: of the root's labels, of a child's label given its parent's (for containers and for textual parents), of features given the label."""

    root: tuple[float, float]
    steps: tuple[tuple[tuple[float, float], tuple[float, float]], tuple[tuple[float, float], tuple[float, float]]]
    features: dict[str, tuple[float, float]]

    def step(self, parent: Node) -> tuple[tuple[float, float], tuple[float, float]]:
        return self.steps[parent.tag in TEXTUAL]

    def local(self, own: list[str]) -> tuple[float, float]:
        a = b = 0.0
        for f in own:
            x = self.features.get(f)
            if x:
                a += x[0]
                b += x[1]
        return a, b


def _plus(a: float, b: float) -> float:
    return (a + math.log1p(math.exp(b - a))) if a > b else (b + math.log1p(math.exp(a - b)))


def marginals(nodes: list[Node], own: list[list[str]], model: TreeModel) -> list[float]:
    """P(content) of every node: messages from the leaves to the root and back."""
    n = len(nodes)
    up = [model.local(x) for x in own]
    message: list[tuple[float, float]] = [(0.0, 0.0)] * n
    belief0, belief1 = [x[0] for x in up], [x[1] for x in up]
    for i in range(n - 1, 0, -1):
        b0, b1 = belief0[i], belief1[i]
        (s00, s01), (s10, s11) = model.step(nodes[nodes[i].parent])
        m0, m1 = _plus(s00 + b0, s01 + b1), _plus(s10 + b0, s11 + b1)
        message[i] = (m0, m1)
        p = nodes[i].parent
        belief0[p] += m0
        belief1[p] += m1
    belief0[0] += model.root[0]
    belief1[0] += model.root[1]
    out = [0.0] * n
    out[0] = 1 / (1 + math.exp(min(700.0, max(-700.0, belief0[0] - belief1[0]))))
    for i in range(1, n):
        p = nodes[i].parent
        (s00, s01), (s10, s11) = model.step(nodes[p])
        c0, c1 = belief0[p] - message[i][0], belief1[p] - message[i][1]
        belief0[i] += _plus(s00 + c0, s10 + c1)
        belief1[i] += _plus(s01 + c0, s11 + c1)
        top = max(belief0[i], belief1[i])
        belief0[i] -= top
        belief1[i] -= top
        out[i] = 1 / (1 + math.exp(min(700.0, max(-700.0, belief0[i] - belief1[i]))))
    return out


def train(pages: Iterable[tuple[str, str]]) -> TreeModel:
    """Smoothed counts over labelled pages: (html, name of the attribute that marks the content element).

    The marked element, its ancestors up to the root and all below it are content, apart from
    elements marked with the attribute's value "no".
    """
    root, step, seen = Counter(), Counter(), (Counter(), Counter())
    for page, attribute in pages:
        yes, no = re.compile(rf'\b{attribute}="yes"'), re.compile(rf'\b{attribute}="no"')
        nodes = parse(yes.sub('class="zzyes"', no.sub('class="zzno"', page)))
        label, inside = [0] * len(nodes), [False] * len(nodes)
        for i, n in enumerate(nodes):
            inside[i] = "zzyes" in n.marks or i > 0 and inside[n.parent] and "zzno" not in n.marks and not n.hidden
            label[i] = int(inside[i])
            p = n.parent
            while inside[i] and p >= 0 and not label[p]:
                label[p] = 1
                p = nodes[p].parent
            n.marks = n.marks.replace("zzyes", "").replace("zzno", "").strip()
        root[label[0]] += 1
        for i, own in enumerate(evidence(nodes)):
            if i:
                step[nodes[nodes[i].parent].tag in TEXTUAL, label[nodes[i].parent], label[i]] += 1
            seen[label[i]].update(own)
            seen[label[i]]["#"] += 1

    def log_step(textual: bool, p: int) -> tuple[float, float]:
        total = step[textual, p, 0] + step[textual, p, 1] + 2
        return math.log((step[textual, p, 0] + 1) / total), math.log((step[textual, p, 1] + 1) / total)

    features = {f: tuple(math.log((seen[y][f] + 0.3) / (seen[y]["#"] + 1)) for y in (0, 1)) for f in set(seen[0]) | set(seen[1]) if f != "#"}
    return TreeModel((math.log((root[0] + 1) / (sum(root.values()) + 2)), math.log((root[1] + 1) / (sum(root.values()) + 2))),
                     tuple((log_step(k, 0), log_step(k, 1)) for k in (False, True)), features)


#: Names that page authors give to parts around the text, for labelled pages.
_AROUND = ["nav", "menu", "navbar", "breadcrumb", "sidebar", "widget", "related", "recommended", "promo", "banner", "ad", "ads", "advert", "advertisement",
           "sponsored", "cookie", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "search", "share", "social",
           "footer", "copyright", "header", "masthead", "topbar", "comments", "comment", "replies", "reader", "pagination", "pager", "tags", "toolbar", "skip", "legal"]
_TEXT = ["content", "article", "post", "entry", "body", "story", "main", "text", "page"]


def labelled_pages(count: int = 400, seed: int = 5) -> list[tuple[str, str]]:
    """Pages with their content marked (data-main), in many layouts: with and without semantic tags, tables of links, comments."""
    rng = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(lo, hi)))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(n))

    def around(inside_article: bool = False) -> str:
        name = rng.choice(_AROUND)
        tag = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside"}.get(name, rng.choice(["div", "div", "section", "aside"]))
        if rng.random() < 0.25 and not inside_article:
            tag, name = rng.choice([("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", "")])
        if tag == "form":
            inner = f'<label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button>'
        elif name.startswith(("comment", "repl", "reader")):
            inner = "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{words(3, 60)}</p></div>' for _ in range(rng.randint(1, 5)))
        else:
            inner = rng.choice([f"<ul>{links(rng.randint(2, 9))}</ul>", words(2, 25), f"<p>{words(3, 30)}</p>", f'<a href="#">{words(1, 4)}</a>',
                                f"<h3>{words(1, 4)}</h3><p>{words(4, 25)}</p>", f"&copy; {words(1, 12)}"])
        mark = f' {rng.choice(["class", "id"])}="{name}"' if name else ""
        return f'<{tag}{mark} data-main="no">{inner}</{tag}>'

    def block() -> str:
        r = rng.random()
        if r < 0.62:
            inner = words(1, 90)
            if rng.random() < 0.3:
                inner = f"<b>{inner}</b> {words(1, 30)}"
            if rng.random() < 0.2:
                inner += f' <a href="/x">{words(1, 3)}</a> <em>{words(1, 6)}</em><br>{words(1, 20)}'
            return f"<p>{inner}" + ("</p>" if rng.random() < 0.8 else "")
        if r < 0.72:
            return f"<h2>{words(1, 8)}</h2>"
        if r < 0.8:
            return f"<ul>{''.join(f'<li>{words(2, 20)}</li>' for _ in range(rng.randint(2, 6)))}</ul>"
        if r < 0.85:
            return f"<blockquote><p>{words(5, 40)}</p></blockquote>"
        if r < 0.9:
            return f"<pre><code>{words(3, 30)}</code></pre>"
        if r < 0.95:
            return f"<table><tr><td>{words(1, 6)}</td><td>{words(1, 6)}</td></tr></table>"
        return f"<figure><img src='x.png'><figcaption>{words(2, 12)}</figcaption></figure>"

    pages = []
    for _ in range(count):
        body = (f"<h1>{words(1, 12)}</h1>" if rng.random() < 0.85 else "") + "".join(block() for _ in range(rng.randint(1, 14)))
        if rng.random() < 0.25:
            body += around(True)
        name = rng.choice(_TEXT)
        main = rng.choice([f'<article data-main="yes">{body}</article>', f'<main data-main="yes">{body}</main>',
                           f'<div class="{name}" data-main="yes">{body}</div>', f'<div id="{name}" data-main="yes">{body}</div>',
                           f'<article data-main="yes"><section>{body}</section></article>'])
        before, after = ("".join(around() for _ in range(rng.randint(0, 4))) for _ in range(2))
        head = f'<head><meta charset="utf-8"><title>{words(2, 8)}</title><style>p{{}}</style><script>var a="<p>";</script></head>'
        pages.append((f"<!DOCTYPE html><html>{head}<body>{before}{main}{after}<script>x()</script></body></html>", "data-main"))
    return pages


def main_text(page: str, model: TreeModel) -> str:
    """Blocks of text whose nodes are rather content than not, joined by two line breaks; empty if there are none."""
    nodes = parse(page)
    content = marginals(nodes, evidence(nodes), model)
    hidden = [False] * len(nodes)
    block = [0] * len(nodes)
    pieces: dict[int, list[str]] = defaultdict(list)
    order: list[int] = []
    part = 0
    latest = [-1] * len(nodes)  # the child of a node that was met last
    for i, n in enumerate(nodes):
        if i:
            hidden[i] = n.hidden or hidden[n.parent]
            inline = n.tag in INLINE or n.tag in ("#text", "br")
            if not inline:
                part += 1
                block[i] = part
            elif latest[n.parent] >= 0 and nodes[latest[n.parent]].tag not in INLINE and nodes[latest[n.parent]].tag not in ("#text", "br"):
                part += 1  # text after a block is a block of its own
                block[i] = block[n.parent] = part
            else:
                block[i] = block[n.parent]
            latest[n.parent] = i
        if n.tag == "#text" and not hidden[i] and content[i] >= 0.5:
            if not pieces[block[i]]:
                order.append(block[i])
            pieces[block[i]].append(n.text)
        elif n.tag == "br" and pieces.get(block[i]):
            pieces[block[i]].append(" ")
    texts = (_SPACE.sub(" ", "".join(pieces[b])).strip() for b in order)
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page. A null or empty page has an empty text; repeated rows stay."""
    fitted = train(labelled_pages()) if model is None else model
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x, fitted) for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                      names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", text_or_empty("html").alias("html")).mapInArrow(run, f"{kinds}, text string, n_chars long")
