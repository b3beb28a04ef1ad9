"""A page's block elements as a tree, with the text runs that belong to them."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Element names of the markup language.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = frozenset("script style title textarea iframe".split())
#: Formulas flow with the text around them; each part stands apart.
FORMULA = frozenset(
    "math mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover "
    "munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split()
)
#: Elements that may stand within a paragraph and do not end it.
WITHIN = frozenset("svg object template noscript".split())
CONTROLS = frozenset("input button select textarea".split())
#: A start tag ends an open element of its group, up to the enclosing container.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>?|!--.*?(?:-->|\Z)|[!?/][^>]*+>?)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_SPACE = re.compile(r"\s+")
_XMP_END = re.compile(r"</xmp[^>]*>?", re.I)
_NAMED = frozenset(("class", "id", "role", "itemprop", "aria-label"))
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Tree:
    """Elements in page order; ``runs`` are (element, text, characters inside links)."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    marks: list[str | None] = field(default_factory=list)
    runs: list[tuple[int, str, int]] = field(default_factory=list)


def _attributes(source: str, mark: str | None) -> tuple[tuple[str, ...], str | None]:
    if "=" not in source:
        return (), None
    found, marked = [], None
    for name, *values in _ATTRIBUTE.findall(source):
        name = name.lower()
        if name in _NAMED:
            found += [w.lower() for w in _WORDS.findall("".join(values))]
        elif name == mark:
            marked = "".join(values)
    return tuple(dict.fromkeys(found)), marked


def parse(source: str, mark: str | None = None) -> Tree:
    """The tree of a whole page, however broken; ``mark`` names an attribute that labels elements."""
    tree = Tree()
    stack: list[int] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    state = {"links": 0, "linked": 0}

    def push(tag: str, attributes: str) -> None:
        words, marked = _attributes(attributes, mark)
        tree.tags.append(tag)
        tree.parents.append(stack[-1] if stack else -1)
        tree.words.append(words)
        tree.controls.append(0)
        tree.marks.append(marked)
        stack.append(len(tree.tags) - 1)
        opened[tag] += 1

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            tree.runs.append((stack[-1], text, state["linked"]))
        parts.clear()
        state["linked"] = 0

    def pop_to(depth: int) -> None:
        flush()
        while len(stack) > depth:
            opened[tree.tags[stack.pop()]] -= 1

    def add(text: str) -> None:
        if text:
            text = html.unescape(text)
            parts.append(text)
            if state["links"]:
                state["linked"] += len(text)

    push("html", "")
    at = begin = 0
    while True:
        at = source.find("<", at)
        if at < 0:
            add(source[begin:])
            break
        tag = _TAG.match(source, at)
        if not tag:
            at += 1
            continue
        add(source[begin:at])
        at = begin = tag.end()
        closing, name, attributes = tag.groups()
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not closing:
            tree.controls[stack[-1]] += name in CONTROLS
            if opened["svg"] and attributes.endswith("/"):
                continue
            end = re.compile(f"</{name}[^>]*>?{'|(?=</svg)' if opened['svg'] else ''}", re.I).search(source, at)
            at = begin = end.end() if end else len(source)
        elif name == "br" or name in FORMULA:
            parts.append(" ")
        elif name in INLINE:
            if name == "a":
                state["links"] = 0 if closing else 1
        elif name in VOID:
            tree.controls[stack[-1]] += name in CONTROLS
            if name == "hr":
                flush()
        elif closing:
            if opened[name] and name not in ("html", "body"):
                depth = len(stack) - 1
                while tree.tags[stack[depth]] != name:
                    depth -= 1
                pop_to(depth)
        elif name == "html" or (name == "body" and opened["body"]):
            continue
        elif (name == "svg" or opened["svg"]) and attributes.endswith("/"):
            continue
        else:
            flush()
            if tree.tags[stack[-1]] == "p" and name not in WITHIN:
                pop_to(len(stack) - 1)
            group, container = SIBLINGS.get(name, ((), ()))
            depth = len(stack) - 1
            while group and depth > 0 and tree.tags[stack[depth]] not in container:
                if tree.tags[stack[depth]] in group:
                    pop_to(depth)
                    if name not in ("tr",) or tree.tags[stack[-1]] not in group:
                        break
                depth -= 1
            push(name, attributes)
            if name in CONTROLS:
                tree.controls[stack[-1]] += 1
            if name == "xmp":  # all up to its end is text as it stands
                end = _XMP_END.search(source, at)
                parts.append(source[at : end.start() if end else len(source)])
                state["linked"] += len(parts[-1]) if state["links"] else 0
                at = begin = end.start() if end else len(source)
    flush()
    return tree
