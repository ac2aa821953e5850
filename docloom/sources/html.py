"""HTML to blocks, on a small tree that the standard library's tokenizer feeds.

The tree is lenient, not a browser's: an end tag closes up to its nearest open
match, a stray one is ignored, and nothing closes by itself, so an unclosed <p>
holds what follows it.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from typing import Any

from docloom.functions import constants as K
from docloom.functions.python_text import normalize_whitespace

HEADINGS = {f"h{n}": n for n in range(1, 7)}
CONTAINERS = frozenset(("div", "section", "article", "main", "header", "footer", "aside"))


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        """All elements below, in document order, without recursion: trees of unclosed tags are deep."""
        todo = list(reversed(self.elements()))
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.elements()))

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def text(self) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                todo.extend(reversed(c.children))
        return "".join(out)


class _Builder(HTMLParser):
    """`mark` stands for an ampersand that is to stay one."""

    def __init__(self, mark: str = ""):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.mark = mark

    def written(self, x: str) -> str:
        return x.replace(self.mark, "&") if self.mark else x

    def handle_starttag(self, tag: str, attrs):
        tag, seen = self.written(tag), {}
        for k, v in attrs:
            seen[self.written(k)] = self.written(v or "")
        node = Node(tag, seen)
        self.open[-1].children.append(node)
        if tag not in K.HTML_VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in K.HTML_VOID:
            self.open.pop()

    def handle_endtag(self, tag: str):
        tag = self.written(tag)
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str):
        self.open[-1].children.append(self.written(data))

    def unknown_decl(self, data: str):
        if data.startswith("CDATA["):
            self.open[-1].children.append(self.written(data[6:]))


_TITLE_END = re.compile(r"</\s*[tT][iI][tT][lL][eE]\s*>")
_TITLE_MARKUP = re.compile(rf"<[tT][iI][tT][lL][eE][^<]*(?!{_TITLE_END.pattern})<")


class _TitleBuilder(_Builder):
    """As HTML has it, a title holds text and references up to its end tag, but no markup; one without an end tag holds what follows it."""

    title_ends = True

    def parse_starttag(self, i: int) -> int:
        at = super().parse_starttag(i)
        if self.lasttag == "title" and at > 0 and self.open[-1].tag == "title" and self.title_ends:
            self.title_ends = _TITLE_END.search(self.rawdata, at) is not None
            if self.title_ends:
                self.set_cdata_mode("title")
        return at

    def handle_data(self, data: str):
        super().handle_data(unescape(data) if self.cdata_elem == "title" else data)


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))?")


def tree(html: str, closed_references: bool = False) -> Node:
    """`closed_references` leaves a reference without its semicolon as it is written; HTML resolves some of them, such as &amp."""
    mark = ""
    if closed_references and "&" in html:
        mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in html)
        html = _REFERENCE.sub(lambda m: m[0] if m[2] in html5 or (m[1] and not m[2]) else mark + m[0][1:], html)
    b = (_TitleBuilder if _TITLE_MARKUP.search(html) else _Builder)(mark)
    b.feed(html)
    b.close()
    return b.root


def prune(root: Node, noise=K.HTML_NOISE) -> None:
    todo = [root]
    while todo:
        n = todo.pop()
        n.children = [c for c in n.children if isinstance(c, str) or c.tag not in noise]
        todo.extend(n.elements())


_WRAP = {"strong": ("**", "**"), "em": ("*", "*"), "mark": ("==", "=="), "s": ("~~", "~~"), "del": ("~~", "~~"), "strike": ("~~", "~~")}
_FORM = frozenset(("input", "button", "select", "textarea"))


def rich_text(node: Node) -> str:
    """The text with inline marks for emphasis, code, links, abbreviations and images."""
    done: list[list[str]] = [[]]
    todo: list[tuple[Any, bool]] = [(c, False) for c in reversed(node.children)]
    while todo:
        c, closing = todo.pop()
        if isinstance(c, str):
            done[-1].append(c)
        elif closing:
            inner = "".join(done.pop())
            done[-1].append(_marked(c, inner))
        elif c.tag == "br":
            done[-1].append("\n")
        elif c.tag == "img":
            done[-1].append(f"[Image: {c.attrs['alt']}]" if c.attrs.get("alt") else "")
        elif c.tag not in _FORM:
            done.append([])
            todo.append((c, True))
            todo.extend((x, False) for x in reversed(c.children))
    return "".join(done[0])


def _marked(node: Node, inner: str) -> str:
    if node.tag == "a":
        href = node.attrs.get("href", "")
        return f"{inner} [{href}]" if href and not href.startswith("#") else inner
    if node.tag == "code":
        return inner if "\n" in inner else f"`{inner}`"
    if node.tag == "abbr":
        title = node.attrs.get("title", "")
        return f"{inner} ({title})" if title else inner
    before, after = _WRAP.get(node.tag, ("", ""))
    return before + inner + after


def _clean(node: Node) -> str:
    return normalize_whitespace(rich_text(node))


def _list(node: Node) -> dict:
    items = []
    for li in (n for n in node.elements() if n.tag == "li"):
        nested = [n for n in li.elements() if n.tag in ("ul", "ol")]
        text = _clean(li)
        for n in nested:
            inner = _clean(n)
            if inner in text:
                text = text.replace(inner, "").strip()
        item: dict[str, Any] = {"text": text}
        if nested:
            item["nested"] = [_list(n) for n in nested]
        items.append(item)
    return {"type": "list", "ordered": node.tag == "ol", "items": items}


def _code(node: Node) -> dict:
    inner = node.find("code") if node.tag == "pre" else None
    language = None
    for c in (inner or node).attrs.get("class", "").split():
        if c.startswith(("language-", "lang-")):
            language = c.split("-", 1)[1]
            break
        if c in K.CODE_CLASSES:
            language = c
    return {"type": "code_block", "language": language, "text": node.text()}


def _definitions(node: Node) -> dict:
    items, term = [], None
    for n in node.elements():
        if n.tag == "dt":
            term = _clean(n)
        elif n.tag == "dd" and term:
            items.append({"term": term, "definition": _clean(n)})
    return {"type": "definition_list", "items": items}


def blocks_of(node: Node, bare_text: bool = False) -> list[dict]:
    """Blocks that an element gives: containers give those of their elements, unknown ones none."""
    t = node.tag
    if t in HEADINGS:
        return [{"type": "heading", "level": HEADINGS[t], "text": _clean(node)}]
    if t == "p":
        return [{"type": "paragraph", "text": _clean(node)}]
    if t in ("ul", "ol"):
        return [_list(node)]
    if t == "table":
        rows = [[_clean(c) for c in r.walk() if c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
        return [{"type": "table", "rows": [r for r in rows if r]}]
    if t in ("pre", "code"):
        return [_code(node)]
    if t == "blockquote":
        return [{"type": "quote", "text": _clean(node)}]
    if t == "img":
        return [{"type": "image_placeholder", "src": node.attrs.get("src", ""), "alt": node.attrs.get("alt", "")}]
    if t == "hr":
        return [{"type": "divider"}]
    if t == "dl":
        return [_definitions(node)]
    if t == "figure":
        img, caption = node.find("img"), node.find("figcaption")
        if img and caption:
            return [{"type": "figure", "src": img.attrs.get("src", ""), "alt": img.attrs.get("alt", ""), "caption": _clean(caption)}]
    if t in CONTAINERS or t == "figure":
        return children_of(node, bare_text)
    return []


def children_of(node: Node, bare_text: bool = False) -> list[dict]:
    out = []
    for c in node.children:
        if isinstance(c, Node):
            out += blocks_of(c, bare_text)
        elif bare_text and c.strip():
            out.append({"type": "paragraph", "text": normalize_whitespace(c).strip()})
    return out


_CONTENT_CLASS = re.compile(r"content|main|article", re.IGNORECASE)


_EAST_ASIAN = re.compile(r"[぀-ゟ゠-ヿ一-鿿]")


def _pruned(html: str, closed_references: bool) -> Node:
    root = tree(html, closed_references)
    prune(root)
    return root


def _metadata(root: Node) -> dict[str, Any]:
    meta: dict[str, Any] = {}
    title = root.find("title")
    if title:
        meta["title"] = "".join(x.strip() for x in title.children if isinstance(x, str))
    for m in (n for n in root.walk() if n.tag == "meta"):
        content = m.attrs.get("content")
        for key, known in (("property", K.META_PROPERTIES), ("name", K.META_NAMES)):
            name = m.attrs.get(key, "").lower()
            if content and name in known:
                meta[name.replace(":", "_")] = content
    return meta


def _blocks(root: Node, bare_text: bool, content_class: bool) -> list[dict]:
    tops = [root.find("main"), root.find("article")]
    if content_class:
        tops.append(next((n for n in root.walk() if n.tag == "div" and _CONTENT_CLASS.search(n.attrs.get("class", ""))), None))
    top = next((n for n in (*tops, root.find("body")) if n), root)
    return children_of(top, bare_text)


def _languages(blocks: list[dict]) -> dict[str, Any]:
    found = _EAST_ASIAN.search(" ".join(b.get("text", "") for b in blocks))
    return {"languages": ["en", "ja"], "multilingual": True} if found else {}


def parse_html(html: str, bare_text: bool = False, content_class: bool = False, closed_references: bool = False) -> tuple[list[dict], dict]:
    """(blocks, metadata). `bare_text` keeps text outside elements, `content_class` also roots at a div of such a class; `tree` has the last."""
    root = _pruned(html, closed_references)
    blocks = _blocks(root, bare_text, content_class)
    return blocks, _metadata(root) | _languages(blocks)


def parse_metadata(html: str, closed_references: bool = False) -> dict:
    """The metadata of `parse_html`; blocks are made only where the page can hold the characters that tell its languages."""
    root = _pruned(html, closed_references)
    east_asian = "&#" in html or _EAST_ASIAN.search(html)
    return _metadata(root) | (_languages(_blocks(root, False, False)) if east_asian else {})
