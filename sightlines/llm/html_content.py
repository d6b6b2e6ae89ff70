"""Main text of HTML pages by a minimum cut.

A page is a row of text blocks. A classifier gives each block a cost for either label, from the elements around it and
its own text; the costs are the capacities to the two terminals. Blocks that follow one another, and blocks with one
parent, are linked by edges that cost more the closer they lie in the document tree. The minimum cut, found by maximum
flow, is the labelling with the least total cost.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import appended

#: Elements by their role.
BREAKING = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p "
    "pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLUTTER = frozenset("nav footer aside form button select menu dialog fieldset label legend option head title dir".split())
MAIN = frozenset(("article", "main"))
UNREAD = frozenset(
    "script style template textarea svg math iframe noscript object canvas audio video noembed noframes xmp".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of the same group within their parent.
GROUPS = {"li": "li", "dt": "d", "dd": "d", "tr": "tr", "td": "t", "th": "t", "option": "o", "optgroup": "og", "p": "p"}

_CLUTTER_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|banners?|breadcrumbs?|bylines?|captcha|comments?|commentlist|consent|contact|"
    r"cookies?|copyright|credits|disclaimer|discussion|disqus|flyout|foot|footer|gdpr|header|login|masthead|menus?|"
    r"meta|modal|nav|navbar|navigation|newsletter|notices?|notifications?|overlay|pager|pagination|paywall|popup|privacy|"
    r"promos?|promoted|ratings?|recommend\w*|related|repl(?:y|ies)|respond|responses?|search|share|sharing|sidebars?|"
    r"signup|skip|social|sponsor\w*|subscri\w*|tags|teasers?|toc|toolbar|topbar|tracking|widgets?)(?=$|[\s_-])",
    re.I,
)
_MAIN_WORDS = re.compile(
    r"(?:^|[\s_-])(?:article|articlebody|body|content|entry|main|post|story|text)(?=$|[\s_-])", re.I
)
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without)[_-][\w-]+", re.I)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RIGHTS = re.compile(r"^\W*(?:©|\(c\)\s|copyright\b)|all rights reserved", re.I)
_SENTENCE = re.compile(r"[.!?…:;。！？][\"'»”)\]*#$%&]*$")

#: Weights of the classifier: log-odds for content.
BIAS, IN_CLUTTER, CLUTTER_NAME, IN_MAIN, MAIN_NAME, LINKED, PER_WORD, SENTENCE, HEADING, SHORT, RIGHTS = (
    0.3, -7.0, -6.0, 3.5, 1.5, -4.0, 0.04, 0.9, 0.6, -0.6, -4.0,
)
#: Cost of parting two neighbouring blocks of one parent, and its share left per step in the tree between them.
SMOOTHNESS, PER_STEP = 0.8, 0.6


@dataclass
class Block:
    """A text block: its pieces, how many characters are linked, its own element and the elements around it."""

    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    tag: str = ""
    path: tuple[int, ...] = ()
    clutter: float = 0.0
    main: float = 0.0
    text: str = ""


@dataclass
class _Open:
    tag: str
    number: int
    clutter: float
    main: float


def _marks(tag: str, attributes: str, above: _Open) -> tuple[float, float]:
    """Evidence for clutter and for the main text that an element adds for all it holds."""
    clutter, main = above.clutter, above.main
    if tag in CLUTTER or (tag == "header" and not main):
        clutter = min(clutter, IN_CLUTTER)
    elif tag in MAIN:
        main = max(main, IN_MAIN)
    if attributes and not attributes.isspace() and tag not in ("html", "body"):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        names = _LAYOUT.sub(" ", " ".join(found.get(n, "") for n in ("class", "id", "itemprop")))
        role = found.get("role", "").lower()
        hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        if hidden or role in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog"):
            clutter = min(clutter, IN_CLUTTER)
        if names.strip() and _CLUTTER_WORDS.search(names):
            clutter = min(clutter, CLUTTER_NAME)
        elif role in ("main", "article") or (names.strip() and _MAIN_WORDS.search(names)):
            main = max(main, MAIN_NAME)
    return clutter, main


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, unlabelled; text is decoded and its white space made single spaces."""
    out: list[Block] = []
    stack = [_Open("", 0, 0.0, 0.0)]
    number, at, links = 0, 0, 0
    now = Block()

    def ended(tag: str) -> Block:
        text = " ".join(html.unescape("".join(now.pieces)).split())
        if text:
            now.text = text
            out.append(now)
        top = stack[-1]
        return Block(tag=tag, path=tuple(o.number for o in stack), clutter=top.clutter, main=top.main)

    def took(text: str) -> None:
        now.pieces.append(text)
        if links:
            now.linked += len(text.strip())

    while found := _TAG.search(page, at):
        if found.start() > at:
            took(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                took(found[0][9:].removesuffix("]]>"))
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if tag in UNREAD and not closing:
            if not attributes.endswith("/") or tag in ("script", "style"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                close = page.find(">", end.end() - 1) if end else -1
                at = close + 1 if close >= 0 else len(page)
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            took(" ")
        elif tag in BREAKING:
            group = GROUPS.get(tag)
            if closing or group:
                for depth in range(len(stack) - 1, 0, -1):
                    opened = stack[depth].tag
                    if opened == tag or (not closing and GROUPS.get(opened) == group):
                        del stack[depth:]
                        break
                    if not closing and opened not in GROUPS:
                        break
            if not closing and tag != "p" and stack[-1].tag == "p":
                stack.pop()
            if not closing and tag not in VOID:
                number += 1
                stack.append(_Open(tag, number, *_marks(tag, attributes, stack[-1])))
            now = ended("" if closing else tag)
            links = links if tag in ("div", "p", "section", "h1", "h2", "h3", "h4", "h5", "h6") and not closing else 0
    if at < len(page):
        took(page[at:])
    ended("")
    return out


def log_odds(block: Block) -> float:
    """The classifier: positive for content."""
    words = block.text.split(" ")
    share = min(1.0, block.linked / max(1, len(block.text)))
    value = BIAS + block.clutter + block.main + LINKED * share + PER_WORD * min(len(words), 40)
    sentence = bool(_SENTENCE.search(block.text))
    if sentence:
        value += SENTENCE
    if block.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        value += HEADING
    elif len(words) < 4 and not sentence:
        value += SHORT
    if _RIGHTS.search(block.text):
        value += RIGHTS
    return value


def _edges(row: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in the page, and neighbours among the blocks of one parent."""
    out, last = [], {}
    for i, block in enumerate(row):
        parent = block.path[:-1]
        if i:
            a, b = row[i - 1].path, block.path
            shared = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            out.append((i - 1, i, SMOOTHNESS * PER_STEP ** max(0, len(a) + len(b) - 2 * shared - 2)))
        before = last.get(parent)
        if before is not None and before < i - 1:
            out.append((before, i, SMOOTHNESS * PER_STEP))
        last[parent] = i
    return out


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: content) that loses least: ``-gain`` of each block labelled against its sign, and the
    capacity of each edge between differently labelled blocks.

    Blocks whose gain outweighs all their edges are labelled at once and their edges added to their neighbours' gains;
    the maximum flow is found over the others.
    """
    n = len(gains)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, capacity in edges:
        near[a][b] = near[a].get(b, 0.0) + capacity
        near[b][a] = near[b].get(a, 0.0) + capacity
    gains = list(gains)
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if label[i] is None and abs(gains[i]) >= sum(near[i].values()):
            label[i] = gains[i] > 0
            for j, capacity in near[i].items():
                gains[j] += capacity if label[i] else -capacity
                del near[j][i]
                waiting.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = n, n + 1
        flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
        flow[source] = {i: gains[i] for i in rest if gains[i] > 0}
        flow[sink] = {i: 0.0 for i in rest}
        for i in rest:
            flow[i][source] = 0.0
            flow[i][sink] = max(0.0, -gains[i])
        reached = _pushed(flow, source, sink)
        for i in rest:
            label[i] = i in reached
    return [bool(x) for x in label]


def _pushed(flow: dict[int, dict[int, float]], source: int, sink: int) -> set[int]:
    """Pushes flow along shortest paths until the sink is out of reach; the nodes still in reach."""
    while True:
        before = {source: source}
        queue = deque([source])
        while queue and sink not in before:
            i = queue.popleft()
            for j, left in flow[i].items():
                if left > 1e-9 and j not in before:
                    before[j] = i
                    queue.append(j)
        if sink not in before:
            return set(before)
        path, j = [], sink
        while j != source:
            path.append((before[j], j))
            j = before[j]
        most = min(flow[i][j] for i, j in path)
        for i, j in path:
            flow[i][j] -= most
            flow[j][i] = flow[j].get(i, 0.0) + most


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by line breaks; empty for null."""
    row = blocks(page or "")
    if not row:
        return ""
    keep = minimum_cut([log_odds(b) for b in row], _edges(row))
    return "\n".join(b.text for b, kept in zip(row, keep) if kept)


def extracted(pages: DataFrame) -> DataFrame:
    """The pages with text (the main text) and n_chars (its code points) in place of old columns of these names.

    Null and empty pages, and pages without main text, have an empty text. Every row gives one row.
    """

    def rows(columns: dict) -> dict:
        texts = [main_text(page) for page in columns["html"]]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return appended(pages, ["html"], rows, "text string, n_chars long")
