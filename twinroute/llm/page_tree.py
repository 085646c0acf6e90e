"""Web pages as trees of nodes with text runs, from tolerant HTML parsing.

A node is a block element, or an inline element that carries a class, id or role; other inline
elements only format the text of the node around them.  Left-out end tags are implied for paragraphs,
list items, cells and the like; an end tag without a start is ignored; what is open at the end
closes.  Contents that are no text of the page (scripts, styles, templates, form fields, embedded
media, comments, hidden elements) are left out while parsing.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements whose text is never shown as text of the page.
SILENT = frozenset("head title script style template noscript textarea select datalist button iframe object canvas audio video svg noframes noembed".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
#: A start tag closes an open element of its group, unless a bound lies between.
_GROUPS = (
    ({"li"}, {"ul", "ol", "menu", "dir"}),
    ({"dt", "dd"}, {"dl"}),
    ({"td", "th"}, {"tr", "table"}),
    ({"tr"}, {"table"}),
    ({"thead", "tbody", "tfoot"}, {"table"}),
)
_CLOSES = {tag: (group | ({"td", "th"} if "tr" in group else {"tr", "td", "th"} if "tbody" in group else set()), bound) for group, bound in _GROUPS for tag in group}

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Tree:
    """Nodes in page order (a parent before its children) and runs of text: (node, block, in a link, text)."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    mark: list[str | None] = field(default_factory=list)
    runs: list[tuple[int, int, bool, str]] = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(text)))}


def parse(page: str) -> Tree:
    tree, block = Tree(), 0
    # open elements: (tag, node, silent, in a link)
    stack: list[tuple[str, int, bool, bool]] = []

    def node(tag: str, parent: int, names: str, mark: str | None) -> int:
        tree.parent.append(parent)
        tree.depth.append(tree.depth[parent] + 1 if parent >= 0 else 0)
        tree.tag.append(tag)
        tree.names.append(names)
        tree.mark.append(mark)
        return len(tree.tag) - 1

    root = node("body", -1, "", None)
    top = ("", root, False, False)

    def close(at: int) -> None:
        nonlocal block
        if any(t in BLOCK for t, *_ in stack[at:]):
            block += 1
        del stack[at:]

    def text(raw: str) -> None:
        _, own, silent, link = stack[-1] if stack else top
        if raw and not silent:
            tree.runs.append((own, block, link, html.unescape(raw)))

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            # an end tag closes the nearest open element of its name; a cell or list holds inner end tags back
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK and stack[k][0] != "p":
                    break
            else:
                if tag == "p":
                    block += 1
            continue
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                block += 1
            continue
        if tag in BLOCK:
            # a block start ends an open paragraph around it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK or stack[k][0] == "button":
                    break
            if tag[0] == "h" and stack and tag[1:].isdigit() and re.fullmatch("h[1-6]", stack[-1][0]):
                close(len(stack) - 1)
            if tag in _CLOSES:
                group, bound = _CLOSES[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in bound:
                        break
                    if stack[k][0] in group:
                        close(k)
                        if stack and stack[-1][0] in group:
                            continue
                        break
            block += 1
            if tag in ("body", "article", "main", "div", "header", "nav"):
                # a head whose end tag is left out ends at the first block
                for k in range(len(stack)):
                    if stack[k][0] == "head":
                        close(k)
                        break
        above, own, silent, link = stack[-1] if stack else top
        known = attributes(found[3]) if found[3].strip(" /\n\t") else {}
        names = " ".join(x for x in (known.get("id"), known.get("class"), known.get("role"), known.get("itemprop")) if x)
        quiet = silent or tag in SILENT or "hidden" in known or known.get("aria-hidden") == "true" or bool(_HIDDEN.search(known.get("style", "").lower()))
        if tag in ("html", "body"):
            if names:
                tree.names[root] += " " + names
            tree.mark[root] = known.get("data-main", tree.mark[root])
            if any(t == tag for t, *_ in stack):
                continue
            stack.append((tag, root, quiet and tag != "html", link))
            continue
        if not quiet and (tag in BLOCK or names or "data-main" in known):
            own = node(tag, own, names, known.get("data-main"))
        if found[3].endswith("/") and tag not in BLOCK and tag not in RAW and tag != "a":
            continue
        stack.append((tag, own, quiet, link or tag == "a"))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else size
            text(page[at:stop])
            at = stop
    return tree


def block_texts(tree: Tree, keep) -> list[str]:
    """Texts of blocks from the runs of nodes that ``keep`` names: white space is one space, empty blocks vanish."""
    parts: dict[int, list[str]] = {}
    for own, block, _, text in tree.runs:
        if keep[own]:
            parts.setdefault(block, []).append(text)
    return [t for t in (" ".join("".join(p).split()) for p in parts.values()) if t]
