"""A forgiving HTML reader: element trees and blocks of text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*+(?:>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
#: Those that hold the rest of the page where their end is missing.
_TO_THE_END = frozenset("script style textarea title".split())
#: Elements whose start and end part blocks of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Elements inside which a region of content may be looked for.
CONTAINER = frozenset("html body div section article main table tbody tr td center".split())
NOT_TEXT = frozenset("head nav footer aside form select button label dialog menu search object canvas audio video".split()) | RAW
_HIDING_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of a class or id that tell what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adslot adbox sponsor sponsored sponsors promo promos promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar comment comments commentlist disqus replies respond discussion share sharing social related recommended newsletter "
    "subscribe subscription signup login widget widgets toolbar pagination pager copyright".split()
)
#: Those of them that tell it inside the article as well; the others are ordinary words.
NEVER_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertisements adslot adbox sponsored sidebar nav navbar breadcrumb breadcrumbs "
    "comments commentlist disqus newsletter pagination pager gdpr".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element's start ends, up to the nearest of the elements that hold it.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Labels of a path; what lies deeper has the path of that depth.
MAX_PATH = 60
_WHOLE = frozenset("html body main article".split())


@dataclass
class Node:
    tag: str
    label: str
    skipped: bool
    children: list = field(default_factory=list)  # of Node and str
    #: Not the article by a word that tells it only outside of the article.
    doubtful: bool = False


def _words(value: str) -> set[str]:
    return set(_NAME.findall(_CAMEL.sub(" ", value).lower()))


def _element(tag: str, attrs: str) -> Node:
    if not attrs.strip(" /\n\t\r"):
        return Node(tag, tag, tag in NOT_TEXT)
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    words = _words(got.get("class", ""))
    label = ".".join([tag, *sorted(words)])
    skipped = tag in NOT_TEXT
    doubtful = False
    if tag not in _WHOLE:
        # the id of a heading or section names its subject
        ids = set() if tag in _HEADINGS else _words(got.get("id", ""))
        skipped |= bool((words if tag == "section" else words | ids) & NEVER_ARTICLE)
        doubtful = bool((words | ids) & NOT_ARTICLE)
        skipped |= got.get("role", "").lower() in _HIDING_ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true"
        skipped |= "display:none" in got.get("style", "").replace(" ", "").lower()
    return Node(tag, label, skipped, doubtful=doubtful and not skipped)


def parse(text: str) -> Node:
    """The element tree; unclosed and misnested elements are closed as browsers do, roughly."""
    root = Node("#root", "#root", False)
    stack = [root]
    paragraphs: list[int] = []  # where p elements stand in the stack
    at, size = 0, len(text)
    unclosed: set[str] = set()

    def close_to(k: int) -> None:
        del stack[k:]
        while paragraphs and paragraphs[-1] >= k:
            paragraphs.pop()

    while at < size:
        m = _TOKEN.search(text, at)
        if m is None:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if m["close"]:
            tag = m["close"].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_to(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:  # an inline end does not close a block
                    break
            continue
        if not m["open"]:
            continue
        tag = m["open"].lower()
        if tag in BLOCK:
            # a block ends the paragraph before it, and what was left open in that
            if paragraphs and not any(n.tag in BLOCK for n in stack[paragraphs[-1] + 1 :]):
                close_to(paragraphs[-1])
        if tag in _ENDS:
            ended, held = _ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in held:
                    break
                if stack[k].tag in ended:
                    close_to(k)
                    break
        node = _element(tag, m["attrs"] or "")
        stack[-1].children.append(node)
        if tag in VOID or text[m.end() - 2 : m.end()] == "/>" and tag in RAW:
            continue
        if tag in RAW:
            end = None if tag in unclosed else _RAW_END[tag].search(text, at)
            if end is None:
                if tag in _TO_THE_END:
                    break
                unclosed.add(tag)
                continue
            at = end.end()
            close = text.find(">", at)
            at = size if close < 0 else close + 1
            continue
        if tag == "p":
            paragraphs.append(len(stack))
        stack.append(node)
    return root


def squeeze(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def blocks(root: Node, region: tuple[str, ...] | None = None) -> list[tuple[tuple[str, ...], str]]:
    """(path of labels, text) of every block with text, in page order, without skipped elements.

    Doubtful elements are left out too, but for those within an article or main element
    or within the ``region``; the empty region is the whole page.
    """
    out: list[tuple[tuple[str, ...], str]] = []
    held: list[str] = []
    begun: tuple[str, ...] = ()

    def flush() -> None:
        if held:
            text = squeeze(held)
            if text:
                out.append((begun, text))
            held.clear()

    def content(path: tuple[str, ...]) -> bool:
        return region is not None and path[: len(region)] == region or any(x.split(".")[0] in ("article", "main") for x in path)

    # iterative, as trees may be deep
    todo: list = [(root, (), 0)]
    while todo:
        node, path, k = todo.pop()
        if k == 0 and node.tag in BLOCK:
            flush()
        while k < len(node.children):
            c = node.children[k]
            k += 1
            if isinstance(c, str):
                if not held:
                    begun = path
                held.append(c)
            elif c.skipped or c.doubtful and not content(path):
                if c.tag in BLOCK:
                    flush()
            else:
                if c.tag in ("br", "td", "th", "img"):
                    held.append(" ")
                todo.append((node, path, k))
                deeper = (c.tag in BLOCK or c.tag in ("td", "th")) and len(path) < MAX_PATH
                todo.append((c, path + (c.label,) if deeper else path, 0))
                break
        else:
            if node.tag in BLOCK:
                flush()
    flush()
    return out
