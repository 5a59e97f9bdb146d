"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element is a binary variable (main text or not).  Its features (class and id
words, length and link share of its text) are emitted given its label, and a child's
label depends on its parent's label and its own tag.  Both tables are counted from
labelled pages.
Sum-product message passing, up from the leaves and down from the root, gives exact
marginals; the text of elements whose marginal is at least a half is the result.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("head title script style noscript template iframe svg select button textarea option input canvas audio video".split())
RAW = frozenset("script style textarea title iframe noscript template xmp noembed noframes".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html article section div nav aside footer header main form td th".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
LABEL = "data-main"  #: attribute that marks main elements of labelled pages


@dataclass(slots=True)
class Node:
    tag: str
    attrs: str
    parent: int
    own: int = 0  #: letters of text directly or through inline children
    linked: int = 0  #: those of them in links
    parts: list[tuple[int, str]] = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in document order (parents first), and the text runs with the element of each.

    A run of element -1 is a block boundary.  End tags without a start are ignored and
    open elements end with the page, as browsers do it.
    """
    nodes, runs, stack = [Node("#root", "", -1)], [], [0]
    open_at: dict[str, list[int]] = {}  # places on the stack of the open elements of each name
    blocks = [0]  # places of those that are not inline
    at = 0
    skip = 0
    size = len(page)

    def text(upto: int) -> None:
        if upto > at and not skip:
            runs.append((stack[-1], page[at:upto]))

    def close(upto: int) -> None:
        nonlocal skip
        while len(stack) > upto:
            tag = nodes[stack.pop()].tag
            open_at[tag].pop()
            if tag in NO_TEXT:
                skip -= 1
            if tag not in INLINE:
                blocks.pop()
                runs.append((-1, ""))

    def innermost(tags: Iterable[str]) -> int:
        return max((places[-1] for t in tags if (places := open_at.get(t))), default=0)

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text(size)
            break
        text(m.start())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if tag == "br":
                runs.append((-1, ""))
            if open_at.get(tag):
                close(open_at[tag][-1])
            continue
        if tag in ENDS_P and nodes[stack[blocks[-1]]].tag == "p":
            close(blocks[-1])
        if ends := ENDS_SAME.get(tag):
            scope = innermost(SCOPES.difference(ends))
            while (last := innermost(ends)) > scope:
                close(last)
        if tag not in INLINE:
            runs.append((-1, ""))
        if tag in VOID:
            continue
        nodes.append(Node(tag, m[3], stack[-1]))
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        open_at.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append(len(nodes) - 1)
        skip += tag in NO_TEXT
    return nodes, runs


def measure(nodes: list[Node], runs: list[tuple[int, str]]) -> None:
    """Text and link lengths of each element: its own runs and those of inline elements in it, in one pass up."""
    for at, text in runs:
        if at >= 0:
            nodes[at].own += len(text) - text.count(" ")
    for node in reversed(nodes):
        if node.tag == "a":
            node.linked = node.own
        if node.tag in INLINE and node.parent >= 0:
            parent = nodes[node.parent]
            parent.own += node.own
            parent.linked += node.linked


def features(node: Node) -> list[str]:
    words: list[str] = []
    if node.attrs:
        for m in ATTRIBUTE.finditer(node.attrs):
            words += {"name " + w for w in WORDS.findall((m[2] or m[3] or m[4] or "").lower())}
    if node.own:
        words.append(f"long {min(6, node.own.bit_length() // 2)}")
        words.append(f"links {4 * node.linked // node.own}")
    return words


@dataclass(frozen=True)
class Model:
    """Log-odds of features for main text, and P(child main | parent label) for each tag of the child."""

    weights: dict[str, float]
    child_main: dict[str, tuple[float, float]]

    def given_parent(self, tag: str) -> tuple[float, float]:
        return self.child_main.get(tag) or self.child_main[""]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Log-odds of main text of each element, by one pass up and one down."""
        get = self.weights.get
        given = [self.given_parent(node.tag) for node in nodes]
        n = len(nodes)
        belief = [0.0] * n
        for i in range(n):
            belief[i] = sum(get(w, 0.0) for w in features(nodes[i]))
        belief[0] = -30.0
        up = [0.0] * n
        exp, log = math.exp, math.log
        for i in range(n - 1, 0, -1):
            q0, q1 = given[i]
            e = exp(max(-30.0, min(30.0, belief[i])))
            up[i] = log((q1 * e + 1 - q1) / (q0 * e + 1 - q0))
            belief[nodes[i].parent] += up[i]
        for i in range(1, n):
            q0, q1 = given[i]
            e = exp(max(-30.0, min(30.0, belief[nodes[i].parent] - up[i])))
            belief[i] += log((q1 * e + q0) / ((1 - q1) * e + 1 - q0))
        return belief

    def extract(self, page: str) -> str:
        nodes, runs = parse(page)
        measure(nodes, runs)
        belief = self.marginals(nodes)
        # references are decoded within their run: none spans a tag
        kept = "".join(" " if at < 0 else html.unescape(text) if "&" in text else text for at, text in runs if at < 0 or belief[at] >= 0)
        return " ".join(kept.split())


def train(pages: Iterable[str]) -> Model:
    """Count features by label and labels by parent label over pages whose main elements carry ``data-main``.

    The mark on an element holds for all in it up to an element with ``data-main="0"``.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    total, pairs = [0, 0], Counter()
    for page in pages:
        nodes, runs = parse(page)
        measure(nodes, runs)
        labels = [0] * len(nodes)
        for i, node in enumerate(nodes):
            m = re.search(rf'{LABEL}="([01])"', node.attrs)
            labels[i] = int(m[1]) if m else labels[node.parent] if i else 0
            total[labels[i]] += 1
            seen[labels[i]].update(set(features(node)))
            if i:
                for tag in (node.tag, ""):
                    pairs[tag, labels[node.parent], labels[i]] += 1
    weights = {w: max(-6.0, min(6.0, math.log((seen[1][w] + 0.5) / (total[1] + 1)) - math.log((seen[0][w] + 0.5) / (total[0] + 1)))) for w in {*seen[0], *seen[1]}}

    def share(tag: str, parent: int, prior: float, strength: float) -> float:
        no, yes = pairs[tag, parent, 0], pairs[tag, parent, 1]
        return (yes + strength * prior) / (no + yes + strength)

    whole = (share("", 0, 0.5, 1), share("", 1, 0.5, 1))
    tags = {tag for tag, _, _ in pairs}
    return Model(weights, {tag: (share(tag, 0, whole[0], 0.2), share(tag, 1, whole[1], 0.2)) for tag in tags} | {"": whole})


# Names that pages give to their parts, for the labelled pages below.
PARTS = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs toc sitemap topbar".split(),
    "header": "header masthead banner logo branding top site".split(),
    "footer": "footer copyright colophon legal bottom imprint".split(),
    "aside": "sidebar aside widget related recommended trending popular more rail".split(),
    "ad": "ad ads advert advertisement adsense sponsored sponsor promo promotion commercial".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay paywall message".split(),
    "form": "form search login signup subscribe newsletter contact register".split(),
    "comments": "comments comment reply replies discussion responses respond thread disqus".split(),
    "share": "share social sharing follow tags pagination pager meta byline".split(),
}
BARE = 0.15  #: share of labelled pages whose text stands in the body itself
MAIN_NAMES = "article content post entry story main text body page".split()


def labelled_pages(n: int = 600, seed: int = 3) -> list[str]:
    """The training set: ``n`` pages put together from common page parts, main elements marked."""
    rng = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))

    def sentence() -> str:
        return words(4, 18).capitalize() + rng.choice(".....!?")

    def prose(a: int = 1, b: int = 6) -> str:
        parts = [sentence() for _ in range(rng.randint(a, b))]
        if rng.random() < 0.3:
            i = rng.randrange(len(parts))
            tag = rng.choice(["b", "i", "em", "strong", "a href='/x'", "code", "span"])
            parts[i] = f"<{tag}>{parts[i]}</{tag.split()[0]}>"
        return rng.choice(["", "", "<br>"]).join(x + " " for x in parts)

    def links(a: int, b: int) -> str:
        item = rng.choice(["li", "li", "span", ""])
        made = [f"<a href='/{i}'>{words(1, 3)}</a>" for i in range(rng.randint(a, b))]
        made = [f"<{item}>{x}</{item}>" for x in made] if item else made
        return f"<ul>{''.join(made)}</ul>" if item == "li" else " ".join(made)

    def named(kind: str, tags: list[str]) -> tuple[str, str]:
        tag = rng.choice(tags)
        plain = tag not in ("div", "section", "p", "ul", "span")
        name = " ".join(rng.sample(PARTS[kind], rng.randint(1, 2)))
        how = "" if plain and rng.random() < 0.6 else f' {rng.choice(["class", "class", "id"])}="{rng.choice([name, name.replace(" ", "-")])}"'
        return f'<{tag}{how} {LABEL}="0">', f"</{tag}>"

    def other(kind: str) -> str:
        tags = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section"], "form": ["form", "form", "div"]}.get(kind, ["div", "div", "section", "p"] if kind != "comments" else ["div", "section"])
        a, b = named(kind, tags)
        if kind == "nav":
            inside = links(3, 9)
        elif kind == "header":
            inside = rng.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", words(1, 5)]) + rng.choice(["", links(2, 6)])
        elif kind == "footer":
            inside = rng.choice(["&copy; ", "", "<p>"]) + words(2, 20) + rng.choice(["", links(2, 5)])
        elif kind == "aside":
            inside = f"<h{(h := rng.choice('2344'))}>{words(1, 4)}</h{h}>" + rng.choice([links(3, 7), f"<p>{prose(1, 3)}</p>", f"<div><p>{prose(1, 2)}</p>{links(1, 3)}</div>"])
        elif kind == "ad":
            inside = rng.choice([words(2, 12), f"<p>{prose(1, 2)}</p>", f"<a href='/buy'>{words(2, 6)}</a>", f"<b>{words(1, 3)}</b> {sentence()}"])
        elif kind == "notice":
            inside = rng.choice([sentence(), f"<p>{prose(1, 3)}</p>"]) + rng.choice(["", "<button>ok</button>", f"<a href='/p'>{words(1, 2)}</a>"])
        elif kind == "form":
            inside = f"<label>{words(1, 3)}</label><input name='q'><p>{words(2, 9)}</p>" + rng.choice(["", "<button>go</button>"])
        elif kind == "comments":
            ca, cb = named("comments", ["div"] * 6 + ["li"] * 6 + ["section"] * 3 + ["article"])
            inside = f"<h{(h := rng.choice('2334'))}>{words(1, 3)}</h{h}>" + "".join(f"{ca}<b>{words(1, 2)}</b><p>{prose(1, 5)}</p>{cb}" for _ in range(rng.randint(1, 4)))
        else:
            inside = rng.choice([links(2, 5), words(2, 8), f"<span>{words(1, 4)}</span>"])
        return a + inside + b

    def main(tag: str = "") -> str:
        tag = tag or rng.choice(["article"] * 5 + ["main", "main", "div", "section"])
        how = "" if tag == "body" or tag in ("article", "main") and rng.random() < 0.6 else f' class="{rng.choice(MAIN_NAMES)}"'
        blocks = [f"<h1>{words(1, 10)}</h1>"] if rng.random() < 0.8 else []
        short = rng.random() < 0.35
        for _ in range(rng.choice([1, 2, 2, 12, 40]) if short else rng.randint(1, 9)):
            r = rng.random() * (0.7 if short else 1)
            if short and r < 0.5:
                blocks.append(rng.choice([f"<p>{words(1, 8)}.</p>", f"<p><b>{sentence()}</b></p>", f"<p>{sentence()}", f"<p><b>{words(1, 3)}.<br>", f"<div>{words(1, 9)}</div>"]))
            elif r < 0.62:
                blocks.append(f"<p>{prose()}" + rng.choice(["</p>", "</p>", ""]))
            elif r < 0.7:
                blocks.append(f"<p>{words(1, 4)}.</p>")
            elif r < 0.78:
                blocks.append(f"<h{(h := rng.choice('23'))}>{words(1, 6)}</h{h}>")
            elif r < 0.84:
                blocks.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.88:
                blocks.append(f"<blockquote><p>{prose(1, 3)}</p></blockquote>")
            elif r < 0.91:
                blocks.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 2)}</td></tr>" for _ in range(3)) + "</table>")
            elif r < 0.94:
                blocks.append(f"<pre>{words(3, 20)}</pre>")
            elif r < 0.97:
                blocks.append(f"<div><p>{prose()}</p></div>")
            else:
                blocks.append(f"<figure><figcaption>{words(2, 9)}</figcaption></figure>")
            if rng.random() < 0.08:
                blocks.append(other(rng.choice(["ad", "share", "aside", "form", "notice"])))
        if rng.random() < 0.15:
            blocks.append(other("comments"))
        if tag == "body":
            return "".join(blocks)
        return f'<{tag}{how} {LABEL}="1">{"".join(blocks)}</{tag}>'

    pages = []
    for _ in range(n):
        before = [other(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.45]
        after = [other(k) for k in ("share", "aside", "ad", "comments", "notice", "footer") if rng.random() < 0.45]
        if rng.random() < BARE:
            pages.append(f'<html><head><title>t</title></head><body {LABEL}="1">' + "".join(before) + main("body") + "".join(after) + "</body></html>")
            continue
        middle = main()
        if rng.random() < 0.3:
            middle = f'<div class="{rng.choice(["wrapper", "container", "row", "page", "main"])}">{rng.choice(["", other("aside")])}{middle}</div>'
        pages.append("<html><head><title>t</title></head><body>" + "".join(before) + middle + "".join(after) + "</body></html>")
    return pages


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Cases: null and empty html, and pages without main text, give an empty text; very
    long and very deep pages take time in proportion to their length; repeated rows are extracted each; an empty table gives no rows; further columns
    are ignored.  The default model is trained on ``labelled_pages()``.
    """
    model = model or train(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
