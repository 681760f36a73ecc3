"""Main text of HTML pages by tree scoring.

A page becomes a light tree of its block elements. Paragraphs give points for their length and
commas to their parent and, halved, to their grandparent; an element's points are discounted by the
share of its text that stands in links. The best container is kept with those siblings that score
well enough or read like text. Navigation, footers, scripts and controls never enter the tree's text.
Forms, asides, headers and elements whose class, id or role names boilerplate are doubted: they go,
unless the page has hardly any text outside them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element names of HTML by what they mean here.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe object embed svg math canvas select option button input textarea dialog menu head title".split())
DOUBTED = frozenset("form aside header dialog".split())
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body main article section div p pre blockquote ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption "
    "h1 h2 h3 h4 h5 h6 hr address center details summary fieldset".split()
) | (DROPPED - frozenset("script style button input select option textarea svg math canvas object embed".split()))
PARAGRAPHS = frozenset("p pre blockquote td th li dd dt h1 h2 h3 h4 h5 h6 figcaption caption address summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends an open element of these kinds that isn't outside the named boundary.
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
#: Words in a class or id that name boilerplate. Those of SURE leave no doubt.
SURE = frozenset(
    "ad ads adbox advert advertisement advertising adsense sponsor sponsored sponsors cookie cookies consent nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "footer copyright newsletter subscribe subscription comment comments commentlist disqus respond replies hidden".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies hidden".split())
LIKELY = frozenset(
    "promo promotion banner popup modal overlay notice notices alert sidebar header masthead share sharing social related recommended recommendations "
    "widget widgets login signup search form skip".split()
)
#: Words that stand beside those without changing what is named, or turn it round.
BESIDE = frozenset(
    "list box bar wrap wrapper container section area block inner outer content body item items link links button buttons icon icons text unit slot left right top bottom main primary "
    "secondary group panel row col form title message site page global thread author reply site".split()
)
TURNED = frozenset("has no not with without is post entry article story headline".split())
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(eq=False)
class Node:
    name: str
    parent: Node | None
    dropped: bool = False
    doubt: int = 0  # 1: rather not of the article; 2: surely not; 3: whatever else the page has
    parts: list = field(default_factory=list)  # texts, and child nodes in page order
    own: list[str] = field(default_factory=list)
    score: float = 0.0
    size: int = 0
    linked: int = 0


def _doubt_of_name(value: str) -> int:
    """How surely a class or id names boilerplate: a bad word by itself, or one with words beside it
    that don't matter. ``has-sidebar``, ``post-header`` and ``share-price`` name something else."""
    worst = 0
    for token in value.lower().split():
        words = [w for w in re.split(r"[-_]+", re.sub(r"\d+", "", token)) if w]
        bad = [w for w in words if w in SURE or w in LIKELY]
        if not bad or words[0] in TURNED or any(w not in SURE and w not in LIKELY and w not in BESIDE for w in words):
            if not (bad and words and words[-1] in bad and words[0] not in TURNED):
                continue
        worst = max(worst, 3 if any(w in COMMENTS for w in bad) else 2 if any(w in SURE for w in bad) else 1)
    return worst


def _doubt(attributes: str) -> int:
    worst = 0
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            worst = max(worst, _doubt_of_name(value))
        elif key == "role" and value.lower() in BAD_ROLE:
            worst = max(worst, 1)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN_STYLE.search(value):
            worst = 3
    return worst


def parse(html: str) -> Node:
    """The tree of block elements; inline markup leaves only its text, in links counted apart."""
    root = node = Node("html", None)
    links, at, skip = 0, 0, None

    def text(raw: str) -> None:
        nonlocal node
        if node.name == "head" and raw.strip():  # </head> may be left out
            node = node.parent
        if raw and not node.dropped:
            node.parts.append((unescape(raw), links > 0))

    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        text(html[at : m.start()])
        at = m.end()
        name = (m[1] or "").lower()
        if not name:
            continue
        opening = html[m.start() + 1] != "/"
        if name in RAW:
            if opening:
                # Everything up to the end tag is raw, of whatever kind it looks.
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name == "a":
            links = 1 if opening else 0
        elif name == "br":
            text("\n")
        elif name in BLOCKS or name in DROPPED:
            if opening:
                if node.name == "head" and name not in VOID - {"hr"}:  # what may stand in a head is raw or void
                    node = node.parent
                if name in BLOCKS and node.name == "p":
                    node = node.parent
                if name in IMPLIED_END:
                    kinds, stop = IMPLIED_END[name]
                    up = node
                    while up is not None and up.name not in stop:
                        if up.name in kinds:
                            node = up.parent
                            break
                        up = up.parent
                if name in VOID:
                    continue
                links = 0 if name != "li" else links
                in_article = name == "header" and _within(node, ("article", "main"))
                doubt = 0 if name in ("html", "body", "article", "main") else max(_doubt(m[2] or ""), int(name in DOUBTED and not in_article))
                child = Node(name, node, node.dropped or name in DROPPED - DOUBTED, doubt)
                node.parts.append(child)
                if not (m[2] or "").rstrip().endswith("/") or name in BLOCKS:
                    node = child
            else:
                up = node
                while up is not None and up.name != name:
                    up = up.parent
                if up is not None and up.parent is not None:
                    node = up.parent
                    links = 0
    text(html[at:])
    return root


def settle(root: Node) -> None:
    """Drops doubted elements, unless the rest of the page has hardly any text: less than a quarter of an
    element that is rather boilerplate, or a few words beside one that is named as such."""

    def outside() -> int:
        """Characters of text, links aside, outside of all dropped and doubted elements."""
        total, stack = 0, [root]
        while stack:
            for part in stack.pop().parts:
                if not isinstance(part, Node):
                    total += 0 if part[1] else len(part[0].strip())
                elif not part.dropped and not part.doubt:
                    stack.append(part)
        return total

    def inside(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            for part in stack.pop().parts:
                if not isinstance(part, Node):
                    total += 0 if part[1] else len(part[0].strip())
                elif not part.dropped and part.doubt < 2:
                    stack.append(part)
        return total

    stack, rest = [root], None
    while stack:
        for part in stack.pop().parts:
            if not isinstance(part, Node) or part.dropped:
                continue
            if part.doubt:
                rest = outside() if rest is None else rest
                if part.doubt == 1 and rest * 4 < inside(part) or part.doubt == 2 and rest < 25 <= inside(part) and part.name not in ("nav", "footer"):
                    part.doubt, rest = 0, None
                    stack.append(part)
                else:
                    part.dropped = True
            else:
                stack.append(part)


def _within(node: Node | None, names: tuple[str, ...]) -> bool:
    while node is not None:
        if node.name in names:
            return True
        node = node.parent
    return False


def blocks(node: Node) -> list[str]:
    """The texts of an element in page order: a run of inline text between block edges is a block."""
    out: list[str] = []
    run: list[str] = []
    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        here, i = stack.pop()
        for i in range(i, len(here.parts)):
            part = here.parts[i]
            if isinstance(part, Node):
                if part.dropped and part.name not in BLOCKS:
                    continue
                out.append("".join(run))
                run = []
                if not part.dropped:
                    stack += [(here, i + 1), (part, 0)]
                    break
            else:
                run.append(part[0])
        else:
            out.append("".join(run))
            run = []
    return [t for t in (" ".join(x.split()) for x in out) if t]


def _measure(root: Node) -> list[Node]:
    """Sizes and link sizes of all elements, and points passed on by paragraphs; children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            order.append(node)
            stack += [x for x in node.parts if isinstance(x, Node)]
    order.reverse()
    for node in order:
        own = commas = 0
        for part in node.parts:
            if not isinstance(part, Node):
                size = len(" ".join(part[0].split()))
                own += size
                node.linked += size if part[1] else 0
                commas += sum(part[0].count(c) for c in ",،、，")
        node.size += own
        if node.name in PARAGRAPHS or own:
            points = min(own / 100, 3) + commas + (1 if own >= 25 else 0)
            points *= 1 - min(1.0, node.linked / own) if own else 0
            if node.name in HEADINGS:
                points = 0
            target = node if node.name not in PARAGRAPHS else node.parent
            if target is not None:
                target.score += points
                if target.parent is not None:
                    target.parent.score += points / 2
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
    return order


def _final(node: Node) -> float:
    density = node.linked / node.size if node.size else 0.0
    bonus = {"article": 25.0, "main": 20.0, "section": 1.0}.get(node.name, 0.0)
    return (node.score + (bonus if node.size else 0)) * (1 - density)


def main_text(html: str | None) -> str:
    """The article's blocks joined by line breaks; empty if the page has none."""
    if not html:
        return ""
    root = parse(html)
    settle(root)
    order = _measure(root)
    held = [n for n in order if n.size and n.name not in PARAGRAPHS - {"td", "blockquote"}]
    if not held:
        return "\n".join(blocks(root))
    best = max(reversed(held), key=_final)
    if best.parent is None:
        return "\n".join(blocks(best))
    if best.name in ("article", "main") and not any(isinstance(x, Node) and x is not best and x.name == best.name and x.size for x in best.parent.parts):
        return "\n".join(blocks(best))
    floor = max(10.0, _final(best) * 0.2)
    out: list[str] = []
    for part in best.parent.parts:
        if not isinstance(part, Node) or part.dropped:
            continue
        density = part.linked / part.size if part.size else 1.0
        reads = part.name in PARAGRAPHS and (density == 0 or part.size >= 80 and density < 0.25)
        if part is best or _final(part) >= floor or reads:
            out += blocks(part)
    return "\n".join(out)


def extract(html: Column) -> Column:
    """Main text of each page. Null and empty pages, and pages without text, give an empty string;
    broken and cut-off markup is read as far as it goes; pages of any length are read whole. A page's
    text depends on its html alone, so repeated rows get equal texts and an empty table an empty result."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p if isinstance(p, str) else None) for p in pages], dtype=object)

    return run(html)
