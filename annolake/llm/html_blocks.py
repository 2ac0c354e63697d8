"""From HTML source to leaf blocks: text runs between block-level boundaries, each with its ancestors.

The reader is tolerant: it takes unclosed and stray tags, unquoted attributes, a source that breaks off
inside a tag, and raw-text elements that never end.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: Kept as text of their own kind and never read as markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start or end of any of these ends a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button label".split()
)
#: A start tag closes an open element of these names, up to the nearest of the fences.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_ENDS_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button", "label", "option"}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[tuple[str, str], ...]  # (tag, attribute words joined by a space), root first
    linked: int  # characters inside <a>


def _attribute_words(attrs: str) -> str:
    words = []
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "style":
            words += ["hiddenstyle"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else []
        elif name in ("hidden", "aria-hidden"):
            words += ["hiddenstyle"] if value.lower() in ("", "true", "hidden") else []
        else:
            words += [w.lower() for w in _WORDS.findall(html.unescape(value))]
    return " ".join(words)


def blocks(source: str) -> list[Block]:
    """The leaf blocks in page order; text outside the body's raw-text elements only. A block's text has its
    character references decoded, white space made one space, and is never empty."""
    stack: list[tuple[str, str]] = []
    out: list[Block] = []
    parts: list[str] = []
    path: tuple = ()
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, path, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal path, linked
        if "&" in text:
            text = html.unescape(text)
        if not any(parts):
            if not text.strip():
                return
            path = tuple(stack)
        parts.append(text)
        if anchors:
            linked += len(text.strip())

    def pop_to(at: int) -> None:
        nonlocal anchors
        for name, _ in stack[at:]:
            anchors -= name == "a"
        del stack[at:]

    at, end = 0, len(source)
    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        closing = m["close"] or m["close2"]
        if name in BLOCK:
            flush()
        elif name == "br":
            parts and parts.append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
                if stack[i][0] in ("td", "th", "table") and name in ("p", "li", "span", "b", "i", "a"):
                    break
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            if not attrs.endswith("/") or name in ("script", "style", "title", "textarea"):
                gone = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                at = gone.end() if gone else end
            continue
        if name in VOID:
            continue
        if name in _ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if name in _CLOSES:
            closed, fences = _CLOSES[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closed:
                    pop_to(i)
                    break
                if stack[i][0] in fences:
                    break
        if name == "body" and any(t == "head" for t, _ in stack):
            pop_to(next(i for i, (t, _) in enumerate(stack) if t == "head"))
        stack.append((name, _attribute_words(attrs) if attrs and not attrs.isspace() else ""))
        anchors += name == "a"
        if len(stack) > 512:  # a broken page that nests without end
            pop_to(256)
    flush()
    return [b for b in out if not any(t == "head" for t, _ in b.path)]
