"""A small tree of a page's tags: enough of HTML's rules to read pages that leave tags open."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.DOTALL
)
ATTRIBUTE = re.compile(r"""(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: A start tag closes an open element of these, looked for up to the nearest of the second set.
CLOSES = {
    **dict.fromkeys(BLOCK - {"button", "option", "legend", "caption", "body", "html", "head", "title"}, (frozenset({"p"}), frozenset("table td th caption button".split()))),
    "li": (frozenset({"li", "p"}), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd p".split()), frozenset({"dl"})),
    "dd": (frozenset("dt dd p".split()), frozenset({"dl"})),
    "tr": (frozenset("tr td th p".split()), frozenset({"table"})),
    "td": (frozenset("td th p".split()), frozenset("tr table".split())),
    "th": (frozenset("td th p".split()), frozenset("tr table".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th".split()), frozenset({"table"})),
    "tfoot": (frozenset("tbody thead tfoot tr td th".split()), frozenset({"table"})),
    "thead": (frozenset("tbody thead tfoot tr td th".split()), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Elements that an end tag of another one doesn't reach beyond.
SCOPE = frozenset("table td th button".split())


class Node:
    """An element; children are nodes and texts in their order."""

    __slots__ = ("tag", "marks", "children", "number")

    def __init__(self, tag: str, marks: str = "") -> None:
        self.tag, self.marks, self.children, self.number = tag, marks, [], -1


def parse(page: str) -> Node:
    """The tree of a page. Comments, scripts and styles are left out; references are decoded."""
    root = Node("#root")
    stack = [root]
    at, size = 0, len(page)
    match = TOKEN.match
    while at < size:
        found = match(page, at)
        at = found.end()
        tag = found[2]
        if tag is None:
            text = found[0]
            if text[0] != "<" or len(text) == 1:
                stack[-1].children.append(html.unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if found[1]:
            _close(stack, tag)
            continue
        rule = CLOSES.get(tag)
        if rule is not None:
            _close_implied(stack, *rule)
        attributes = found[3]
        node = Node(tag, _marks(attributes) if attributes else "")
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
            stop = end.start() if end else size
            if tag in ("title", "textarea"):
                node.children.append(html.unescape(page[at:stop]))
            at = stop
            stack.append(node)
        elif tag not in VOID:
            stack.append(node)
    return root


def _marks(attributes: str) -> str:
    """Class, id, role and hidden as words."""
    words = []
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            words.append("hidden")
        elif name != "aria-hidden":
            words += re.findall(r"[a-z0-9]+", value)
    return " ".join(words)


def _close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in SCOPE and tag not in BLOCK:
            return


def _close_implied(stack: list[Node], closed: frozenset[str], until: frozenset[str]) -> None:
    lowest = 0
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in until:
            break
        if stack[i].tag in closed:
            lowest = i
    if lowest:
        del stack[lowest:]
