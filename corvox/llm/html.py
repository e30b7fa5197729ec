"""Main text of web pages by tree scoring.

A page is read into a light tree in which only block elements, their text and their links
count. Paragraphs pass points for their length and commas to their ancestors, less with each
level; a container's points are discounted by its link density. The best container, or the
article or main that it stands in, is kept whole, with all blocks around it that score well or
have few links. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments are left out by their element, role, class or id wherever they stand, but not by a class
or id alone where the page's article would go with them.

Cases: null or empty html, or no text outside what is left out, gives an empty text. Unclosed
and misnested elements are closed as the next block element demands. Repeated pages get a row
each; of containers with equal points the outer, earlier one is taken. Pages of any length are
read whole. An empty table gives an empty result; extra columns, whatever their names, are not
read.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

SCHEMA = "page_id long, url string, text string, n_chars long"
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold main text.
OUT = RAW | set("head nav footer aside form noscript template svg canvas object button select option datalist dialog menu audio video map fieldset label input".split())
BLOCK = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption header address hr details summary center nav footer aside form fieldset".split())
#: Words of a class or id that tell what is left out.
UNLIKELY = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidenav comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices banner popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar related recommended share sharing social subscribe newsletter signup login search widget pagination pager tags byline print hidden".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of UNLIKELY that inside an article can name a part of its text as well: there they leave out only what has many links or speaks of the site.
DOUBTFUL = set("notice notices tags banner byline print hidden related menu navigation share".split())
#: What notices of a site speak of; one such word in SITE_DENSITY characters or less makes a notice.
SITE, SITE_DENSITY = re.compile(r"\b(?:cookies?|consent|gdpr|privacy policy|terms of (?:use|service)|subscribe|newsletter|sign ?up|log ?in|javascript|ad ?block(?:er)?|advert(?:s|isements?)?|notifications?)\b", re.IGNORECASE), 80
#: Elements whose text reads on around what is left out inside them, and what is left out there without a break. Labels and formulas are text there.
RUNNING = set("p li dt dd td th caption figcaption blockquote summary h1 h2 h3 h4 h5 h6 address pre".split())
INLINE = set("svg canvas button object select datalist input audio video map noscript template annotation annotation-xml".split())
#: Words that go with those of UNLIKELY in one class or id: parts of a page, not what a page has or lacks.
PARTS = set("site page main primary secondary global mobile desktop article articles post posts entry blog story content body text header head title area box wrap wrapper container inner outer block list item items link links bar section slot unit left right top bottom module panel button buttons group row col column form count is".split())
LIKELY = set("article content main body text entry post story hentry blog".split())
CLOSES_P = BLOCK - {"html", "body"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "table", "dl", "select", "tbody", "thead", "tfoot"}
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "parent", "out", "soft", "children", "bonus", "points", "size", "linked")

    def __init__(self, tag: str, parent: Node | None, out: bool, bonus: float = 0.0, soft: bool = False):
        self.tag, self.parent, self.out, self.bonus, self.soft = tag, parent, out, bonus, soft
        self.children: list = []  # nodes, and block texts as (text, characters in links)
        self.points = 0.0
        self.size = self.linked = 0


def unlikely(name: str) -> bool:
    """Whether one class or id tells what is left out: all its words are of UNLIKELY or PARTS. has-sidebar, no-nav and hidden-print do not."""
    parts = [w.lower() for w in NAME.findall(name)]
    return any(w in UNLIKELY for w in parts) and all(w in UNLIKELY or w in PARTS for w in parts) and (len(parts) == 1 or "print" not in parts)


def left_out(tag: str, attributes: str, inside: bool) -> tuple[bool, float, bool | None]:
    """Whether an element is left out with all it holds, its bonus as a container, and whether its class or id would leave it out (None: where it has many links or speaks of the site). inside: it stands in an article."""
    if tag in OUT or tag == "header" and not inside:
        return True, 0.0, False
    bonus = 25.0 if tag in ("article", "main") else 5.0 if tag in ("section", "div") else 0.0
    if not attributes.strip():
        return False, bonus, False
    own = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower() or own.get("role", "").lower() in ROLES:
        return tag not in ("html", "body"), bonus, False
    whole = (own.get("class", "") + " " + own.get("id", "")).split()
    names = {w.lower() for x in whole for w in NAME.findall(x)}
    bad = [x for x in whole if unlikely(x)] if names & UNLIKELY else []
    if inside and all({w.lower() for w in NAME.findall(x)} & UNLIKELY <= DOUBTFUL for x in bad):
        return False, bonus, None if bad else False
    if bad and tag not in ("html", "body", "main") and not any((w := {y.lower() for y in NAME.findall(x)}) and w <= LIKELY for x in whole):
        if tag != "article" or {w.lower() for x in bad for w in NAME.findall(x)} & {"comment", "comments", "reply", "ad", "ads", "advert", "promo", "related"}:
            return False, 0.0, True
    if names & LIKELY or own.get("role", "").lower() in ("main", "article") or own.get("itemprop", "").lower() == "articlebody":
        bonus += 15.0
    return False, bonus, False


def after(page: str, tag: str, at: int) -> int:
    """Where the element that was opened before `at` ends; `at` if it is not closed."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?:\s[^>]*)?>", re.IGNORECASE).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def tree(page: str, classes: bool = True) -> Node:
    """The page's tree. classes: soft marks what classes and ids would leave out; inline elements of that kind are not in the tree."""
    root = Node("#", None, False)
    at, open_, text, links, link = root, 0, [], 0, None  # link: the node in which an open <a> began

    def flush() -> None:
        nonlocal text, links
        if text:
            if not at.out:
                line = " ".join("".join(text).split())
                if line:
                    at.children.append((line, min(links, len(line))))
            text, links = [], 0

    def close(node: Node) -> None:
        nonlocal at, link
        flush()
        up = link
        while up is not None and up is not node:
            up = up.parent
        at, link = node.parent, None if up is node else link

    end = len(page)
    while open_ < end:
        m = TAG.search(page, open_)
        piece = page[open_ : m.start() if m else end]
        if piece and not at.out:
            piece = entities.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if link:
                links += len(piece.strip())
        if not m:
            break
        open_ = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            link = None if closing else at
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif closing:
            if tag in BLOCK or tag in OUT:
                node = at
                while node.parent is not None and node.tag != tag:
                    if node.tag in ("article", "body", "table") and tag in ("p", "li", "span"):
                        break
                    node = node.parent
                if node.parent is not None and node.tag == tag:
                    close(node)
        elif at.tag in RUNNING and tag in INLINE or tag.startswith("annotation"):
            open_ = after(page, tag, open_)
        elif at.tag in RUNNING and tag == "label":
            pass
        elif tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, open_)
            open_ = stop.end() if stop else end if tag != "title" else open_
        elif tag in BLOCK or tag in OUT:
            if at.tag == "p" and tag in CLOSES_P:
                close(at)
            if tag in SAME:
                node = at
                while node.parent is not None and node.tag not in SCOPE and node.tag not in SAME[tag]:
                    node = node.parent
                if node.tag in SAME[tag]:
                    while at is not node:
                        close(at)
                    close(node)
            flush()
            inside, node = False, at
            while node is not None and not inside:
                inside, node = node.tag == "article" or tag == "header" and node.tag == "main", node.parent
            out, bonus, soft = left_out(tag, attributes, inside)
            child = Node(tag, at, at.out or out, bonus, soft if classes else False)
            if not child.out:
                at.children.append(child)
            at = child
        elif not at.out and ((got := left_out(tag, attributes, True))[0] or got[2] and classes):
            open_ = after(page, tag, open_)  # an inline advert or the like
    while at is not None and at.parent is not None:
        close(at)
    flush()
    return root


def texts(node: Node):
    """Block texts below a node in page order, without recursion."""
    stack = [iter(node.children)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, tuple):
                yield x[0]
            else:
                stack.append(iter(x.children))
                break
        else:
            stack.pop()


#: Elements that can be the container of an article; rows, items and paragraphs count for the one around them.
HOLDS = set("# html body main article section div center".split())


def holder(node: Node | None) -> Node | None:
    """The nearest container at or above a node: HOLDS, or a table cell with blocks of its own."""
    while node is not None and node.tag not in HOLDS and not (node.tag == "td" and any(isinstance(x, Node) for x in node.children)):
        node = node.parent
    return node


def score(root: Node) -> list[Node]:
    """Containers with their points, and sizes of all nodes."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.children if isinstance(x, Node)]
    for node in order:
        for x in node.children:
            if isinstance(x, tuple):
                line, linked = x
                gain = (1 + line.count(",") + min(len(line) / 100, 30)) * (1 - linked / len(line))
                up, level = holder(node), 0
                while up is not None and level < 5:
                    up.points += gain / (1, 2, 6, 9, 12)[level]
                    up, level = holder(up.parent), level + 1
    for node in reversed(order):
        node.size = sum(len(x[0]) if isinstance(x, tuple) else x.size for x in node.children)
        node.linked = sum(x[1] if isinstance(x, tuple) else x.linked for x in node.children)
    for node in order:
        node.points = (node.points + (node.bonus if node.points > 0 else 0)) * (1 - node.linked / node.size) if node.size else 0.0
    return order


def below(root: Node, soft: bool) -> list[Node]:
    """The nodes at and below root, parents first; soft: those below soft ones too."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        if soft or not node.soft:
            stack += [x for x in node.children if isinstance(x, Node)]
    return order


def pruned(root: Node) -> None:
    """Takes soft nodes out of the tree, but not one that holds the page's article: its only article or main, else its only h1, else most of its text where nothing else reads as the article."""

    def seen(nodes: list[Node]) -> tuple[bool, bool, bool, int]:
        full = [x for x in nodes if x.tag in ("article", "main", "h1") and not x.soft and any(True for _ in texts(x))]
        size = sum(len(y[0]) for x in nodes for y in x.children if isinstance(y, tuple))
        return any(x.tag != "h1" for x in full), any(x.tag == "h1" for x in full), any(x.bonus >= 15 for x in nodes), size

    for x in reversed(below(root, True)):
        x.size = sum(len(y[0]) if isinstance(y, tuple) else y.size for y in x.children)
        x.linked = sum(y[1] if isinstance(y, tuple) else y.linked for y in x.children)
        if x.soft is None:
            x.soft = 4 * x.linked >= x.size > 0 or SITE_DENSITY * len(SITE.findall(" ".join(texts(x)))) >= x.size > 0
    while True:
        top = below(root, False)
        soft = [x for x in top if x.soft]
        if not soft:
            return
        article, h1, likely, size = seen([x for x in top if not x.soft])
        inner = [seen(below(x, True)) for x in soft]
        total = size + sum(x[3] for x in inner)
        held = [x for x, (a, h, _, n) in zip(soft, inner, strict=True) if not article and (a or h and not h1 or not h1 and not likely and 2 * n > total)]
        if not held:
            for up in {id(x.parent): x.parent for x in soft}.values():
                up.children = [x for x in up.children if isinstance(x, tuple) or not x.soft]
            return
        for x in held:
            x.soft = False


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return chosen(tree(page)) or chosen(tree(page, False))


def chosen(root: Node) -> str:
    """Main text of a tree."""
    pruned(root)
    best = max(score(root), key=lambda x: x.points)
    if not best.size:
        return ""
    least = max(10.0, 0.2 * best.points)
    line = [best]
    while line[-1].parent is not None:
        line.append(line[-1].parent)
    article = max((i for i, x in enumerate(line) if x.tag == "article"), default=None)
    main = max((i for i, x in enumerate(line) if x.tag == "main"), default=None)
    # what is kept whole, and the ancestor below which its surroundings are looked at
    if article is not None:
        at, end = article, main if main is not None and main > article else article + 1
    elif main is not None:
        at, end = main, main
    else:
        at, end = 0, len(line) - 1
    keep = list(texts(line[at]))
    for inner, outer in zip(line[at:end], line[at + 1 : end + 1], strict=True):
        before, after = [], []
        side = before
        for x in outer.children:
            if x is inner:
                side = after
            elif isinstance(x, tuple):
                side += [x[0]] if 4 * x[1] < len(x[0]) else []
            elif x.size and (4 * x.linked < x.size or x.points >= least and x.tag not in ("ul", "ol", "table")):
                side += texts(x)
        keep = before + keep + after
    return "\n".join(keep)


def extracted(pages: DataFrame) -> DataFrame:
    """One row of SCHEMA per page."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out = [main_text(x) for x in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": out, "n_chars": [len(x) for x in out]}

        return run

    return map_slices(rows, make, SCHEMA, text="html")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
