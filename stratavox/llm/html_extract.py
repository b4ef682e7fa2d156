"""HTML main-text extraction by tree scoring.

Every block of text passes points for its length and commas to its ancestors, halved per level and discounted by the
container's link density. The best container, lifted to an enclosing article or main element, and its well-scored
siblings are kept. Menus, headers, footers, asides and raw elements are pruned first. Blocks that only their class or id words, their
being hidden or their being a form speak against (suspects) are pruned unless they wrap the page: such words often stand on wrappers
("has-sidebar", "modal-open"). A wrapper scores half, and is kept only around the best container.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.llm.common import map_batches

#: Elements whose content is text up to their own end tag, whatever stands in it.
RAW = frozenset("script style textarea title iframe noframes xmp".split())
#: Elements that are pruned inside a line of text, without ending its block.
INSIDE = frozenset("noscript template svg math object select button canvas audio video".split())
PRUNED = RAW | INSIDE | frozenset("nav header footer aside head menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote section article main figure figcaption address center details summary fieldset hgroup search form".split()
) | (PRUNED - RAW - INSIDE)
ENDS_P = (BLOCK - {"html", "body", "head"}) | {"hr"}
#: An open element on the left is closed by a start tag on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base link meta title style script noscript template head".split())
#: Elements that often lack an end tag. They end with their parent.
UNENDED = frozenset(CLOSES) | {"p", "tfoot", "head", "html", "body"}
#: An end tag closes nothing beyond these, unless it is of a table's own parts; those stop at the table.
LIMITS = frozenset("td th caption table".split())
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
STRONG = frozenset("ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr comment comments commentlist replies respond disqus newsletter subscribe signup popup modal pager pagination toolbar skiplink".split())
WEAK = frozenset("header sidebar side rail notice notices banner alert message search share sharing social related recommended widget widgets form login outbrain taboola".split())
KEEPS = frozenset("content article main post entry story body text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

#: Words that also tell what the page around holds; a suspect by these alone is a wrapper if most of the page's text is in it.
LAYOUT = frozenset("nav navbar navigation sidebar side rail header footer masthead modal popup search menu message widget widgets toolbar form".split())
#: What a wrapper holds: the article is in it. Not counted where it is a suspect itself.
HEADS = frozenset("article main h1".split())

_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_SPLIT = re.compile(r"[^a-z0-9]+")


#: Verdicts on an element by its start tag. LAYOUT_SUSPECT may be rescued by its share of the text, SUSPECT only by what it holds.
WANTED, LAYOUT_SUSPECT, SUSPECT, UNWANTED = range(4)


def _verdict(tag: str, attrs: str) -> int:
    if tag in PRUNED:
        return UNWANTED
    if not attrs or tag in ("html", "body"):
        return LAYOUT_SUSPECT if tag == "form" else WANTED
    found: set[str] = {"form"} if tag == "form" else set()
    kept = own = False
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            found.add("hidden")
        elif name == "role" and value.strip() in ROLES:
            return UNWANTED
        elif name in ("class", "id", "role"):
            for token in value.split():
                words = set(_SPLIT.split(token))
                found |= words & (STRONG | WEAK)
                kept |= bool(words & KEEPS)
                own |= bool(words & KEEPS) and not words & STRONG
    if tag in ("article", "main") and own:  # "post comments-open"
        found &= {"hidden"}
    if not found or kept and found <= WEAK:
        return WANTED
    return LAYOUT_SUSPECT if found <= LAYOUT else SUSPECT


class _Node:
    __slots__ = ("parent", "tag", "depth", "size", "link", "points", "blocks", "pruned", "gone", "verdict", "whole", "holds")

    def __init__(self, parent, tag, pruned=False, verdict=WANTED):
        self.parent, self.tag, self.depth = parent, tag, parent.depth + 1 if parent else 0
        self.size = self.link = 0
        self.points = 0.0
        self.blocks: list[tuple[int, str]] = []
        self.pruned, self.gone = pruned, False
        self.verdict = verdict
        self.whole, self.holds = 0, False  # of suspects and what is in them: text outside of links, and whether HEADS are among it


class _Tree:
    """Elements that matter for the text: blocks, and pruned elements of any kind. Open ones form a stack, which implied end tags
    shorten alike inside and outside of pruned elements. Text directly in a pruned element is dropped; its descendants go
    once it is known to have ended before the page did, as an element that is never closed would swallow the rest. Of a pruned
    element inside a line that its parent's end closes, blocks stay too."""

    def __init__(self):
        root = _Node(None, "#")
        self.stack, self.nodes = [root], [root]
        self.at: dict[str, list[int]] = {}  # places in the stack by tag
        self.limits: list[int] = []  # places of LIMITS
        self.blocks = [0]  # places of block elements
        self.parts: list[str] = []
        self.links = self.n_blocks = self.in_link = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                node = self.stack[self.blocks[-1]]
                node.blocks.append((self.n_blocks, text))
                self.n_blocks += 1
                node.size += len(text)
                node.link += min(self.links, len(text))
        self.links = 0

    def text(self, s: str) -> None:
        if not s:
            return
        if self.stack[-1].tag == "head" and s.strip():
            self.pop(len(self.stack) - 1)
        if self.stack[-1].pruned:
            return
        s = unescape(s) if "&" in s else s
        self.parts.append(s)
        if self.in_link:
            self.links += len(s.strip())

    def push(self, tag: str, pruned: bool, block: bool, verdict: int = WANTED) -> None:
        if block:
            self.flush()
            self.blocks.append(len(self.stack))
        if tag in LIMITS:
            self.limits.append(len(self.stack))
        self.at.setdefault(tag, []).append(len(self.stack))
        # plain elements inside a pruned one of the same line are dropped with it
        node = _Node(self.stack[-1], tag, pruned or not block and self.stack[-1].pruned, verdict)
        self.stack.append(node)
        self.nodes.append(node)

    def pop(self, to: int, by: str = "") -> None:
        """Closes all elements from place `to` on; `by` is the end tag that closes the first of them."""
        if self.blocks[-1] >= to:
            self.flush()
            self.in_link = 0
        for k in range(len(self.stack) - 1, to - 1, -1):
            node = self.stack.pop()
            self.at[node.tag].pop()
            if self.blocks[-1] == k:
                self.blocks.pop()
            if self.limits and self.limits[-1] == k:
                self.limits.pop()
            if (node.pruned or node.verdict) and (node.tag in UNENDED or k == to and by or node.tag in BLOCK and by not in ("", "body", "html")):
                node.gone = True

    def start(self, tag: str, attrs: str) -> None:
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.pop(len(self.stack) - 1)
        if tag in ENDS_P and self.stack[self.blocks[-1]].tag == "p":
            self.pop(self.blocks[-1])
        while tag in CLOSES.get(self.stack[self.blocks[-1]].tag, ()):
            self.pop(self.blocks[-1])
        verdict = _verdict(tag, attrs)
        if verdict == UNWANTED or verdict and tag not in BLOCK:
            if tag in BLOCK or not attrs.endswith("/"):
                self.push(tag, True, tag in BLOCK)
        elif tag == "a":
            self.in_link += 1
            if self.at.get("a"):
                self.push(tag, False, False)
        elif tag in BLOCK:
            self.push(tag, False, True, verdict)
        elif self.at.get(tag):  # inside a pruned element of this tag
            self.push(tag, False, False)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        places = self.at.get(tag)
        if not places:
            return
        if tag not in BLOCK:
            limit = self.blocks[-1]
        elif tag in TABLE:
            limit = self.at["table"][-1] - 1 if self.at.get("table") else 0
        else:
            limit = self.limits[-1] if self.limits else 0
        if places[-1] > limit:
            self.pop(places[-1], tag)

    def finish(self) -> list[_Node]:
        self.pop(1)
        self.flush()
        return self.nodes


def main_text(page: str | None) -> str:
    """The main text of one page: blocks in page order joined by newlines; empty for null, empty or text-free pages."""
    if not page:
        return ""
    tree = _Tree()
    pos, end = 0, len(page)
    while pos < end:
        lt = page.find("<", pos)
        if lt < 0:
            tree.text(page[pos:])
            break
        if lt > pos:
            tree.text(page[pos:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            pos = end if stop < 0 else stop + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            if page.startswith("<![CDATA[", lt) and (stop := page.find("]]>", lt)) > 0:
                tree.text(page[lt + 9 : stop].replace("&", "&amp;"))
                pos = stop + 3
                continue
            stop = page.find(">", lt)
            pos = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            if nxt == "/" or nxt.isalpha():  # a tag that never ends: the rest is markup
                stop = page.find(">", lt)
                pos = end if stop < 0 else stop + 1
            else:
                tree.text("<")
                pos = lt + 1
            continue
        pos = m.end()
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            tree.end(tag)
        elif tag in RAW:
            stop = _RAW_END[tag].search(page, pos)
            pos = stop.end() if stop else end
        elif tag == "br":
            if not tree.stack[-1].pruned:
                tree.parts.append(" ")
        elif tag not in VOID:
            tree.start(tag, attrs)
        elif tag == "hr":
            if tree.stack[tree.blocks[-1]].tag == "p":
                tree.pop(tree.blocks[-1])
            tree.flush()
    return _best(tree.finish())


_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
INLINE_PARENTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption pre figcaption summary".split())
#: Levels that points climb; they halve at each, so what is left beyond counts for nothing.
LEVELS = 50


def _judge(nodes: list[_Node]) -> list[_Node]:
    """What is left without pruned elements and suspects that are no wrappers; wrappers keep their verdict. Parents stand first."""
    left = []
    for n in nodes:
        n.gone = n.gone and (n.pruned or n.verdict)
        if n.parent is not None and n.parent.pruned and n.parent.gone:
            n.pruned = n.gone = True
        if not (n.pruned and n.gone):
            n.verdict = n.verdict if n.gone else WANTED  # one that the page never closes holds the rest of the page
            n.gone = False
            left.append(n)
    for n in reversed(left):
        n.whole += sum(len(t) for _, t in n.blocks) - n.link
        n.holds = n.holds or n.tag in HEADS and not n.verdict
        if n.parent is not None:
            n.parent.whole += n.whole
            n.parent.holds = n.parent.holds or n.holds
    total = left[0].whole if left else 0
    out = []
    for n in left:
        wrapper = n.holds or n.verdict == LAYOUT_SUSPECT and 2 * n.whole > total
        n.gone = n.verdict and not wrapper or n.parent is not None and n.parent.gone
        if not n.gone:
            out.append(n)
    return out


def _best(nodes: list[_Node]) -> str:
    nodes = _judge(nodes)
    if not any(n.blocks for n in nodes):
        return ""
    kids: dict[int, list[_Node]] = {}
    for n in nodes:
        for _, text in n.blocks:
            share = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - n.link / max(n.size, 1))
            at = n.parent if n.tag in INLINE_PARENTS and n.parent else n
            for _ in range(LEVELS):
                at.points += share
                share /= 2
                at = at.parent
                if at is None:
                    break
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.size += n.size
            n.parent.link += n.link
            kids.setdefault(id(n.parent), []).append(n)
    score = lambda n: n.points * (1 - n.link / max(n.size, 1)) * (1.5 if n.tag in ("article", "main") else 1.0) * (0.5 if n.verdict else 1.0)
    best = max((n for n in nodes if n.tag not in INLINE_PARENTS), key=lambda n: (score(n), n.depth), default=nodes[0])
    around, at = set(), best
    while at is not None:
        around.add(id(at))
        at = at.parent
    lift = best
    while lift is not None and lift.tag not in ("article", "main"):
        lift = lift.parent
    best = lift or best
    keep = [best]
    least = max(score(best) * 0.2, 1e-9)
    for n in kids.get(id(best.parent), []) if best.parent is not None else []:
        if n is not best and not n.verdict:
            dense = n.link / max(n.size, 1)
            if score(n) >= least or n.tag in INLINE_PARENTS and n.size > 80 and dense < 0.25:
                keep.append(n)
    blocks: list[tuple[int, str]] = []
    while keep:
        n = keep.pop()
        blocks += n.blocks
        keep += [c for c in kids.get(id(n), []) if not c.verdict or id(c) in around]
    return "\n".join(t for _, t in sorted(blocks))


def extract_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: its id, the kept columns and text. Null or empty html gives an empty text; ids may repeat or be null.

    Columns of other names, `text` among them, are left out unless kept; a kept column `text` would clash and is refused.
    """
    if "text" in (id_col, *keep):
        raise ValueError("a kept column is named text")
    out = pages.select(F.col(id_col), *[F.col(c) for c in keep], F.col(html_col).alias("html_in"))
    fields = out.schema.fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string"

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([main_text(h) for h in b.column(len(fields)).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(fields))], texts], names=[*[f.name for f in fields], "text"])

    return map_batches(out, schema, run)
