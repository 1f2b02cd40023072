"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks. A logistic classifier over each block's place, text and links gives
it a cost for either label: these are the capacities of its terminal edges. Blocks that are neighbours
in page order or share ancestors in the element tree are joined by smoothness edges. The minimum cut
between the terminals is the cheapest labelling; what stays with the source is content.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from html import unescape
from math import exp, log, log1p

from pyspark.sql import DataFrame, types as T

from strandwise.llm.columns import with_struct

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg math iframe object canvas head title select textarea button datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img nobr".split()
)
#: What an open element of this name is closed by, besides its own end tag.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
#: Elements that an implied end tag does not reach past.
SCOPE = frozenset("article aside body div footer header main nav section table ul ol dl html blockquote form figure details".split())
LEAN = {  # log-odds of content that an enclosing element adds
    "article": 3.0, "main": 2.5, "p": 0.8, "h1": 0.8, "h2": 0.6, "h3": 0.6, "h4": 0.4, "blockquote": 0.8, "pre": 0.8, "figcaption": 0.3, "section": 0.2,
    "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0, "header": -5.0, "fieldset": -9.0,
}
ROLES = {"navigation": -9.0, "banner": -5.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "alert": -9.0, "dialog": -9.0, "alertdialog": -9.0, "form": -9.0, "main": 2.5, "article": 3.0, "menu": -9.0, "toolbar": -9.0}
_POOR = re.compile(
    r"(?:^|[^a-z])(?:ads?|adv|advert\w*|banner|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w*|"
    r"signup|login|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|aside|rail|widget\w*|footer|foot|bottom|header|masthead|topbar|toolbar|"
    r"comment\w*|respond|replies|reply|disqus|discussion|reviews?|share\w*|sharing|social|follow|related|recommend\w*|recirc\w*|trending|popular|"
    r"more|pagination|pager|paging|tags?|copyright|legal|disclaimer|skip|search\w*|form|hidden|outbrain|taboola)(?![a-z])"
)
_RICH = re.compile(r"(?:^|[^a-z])(?:article\w*|content\w*|main|post|story|entry|body|text|prose)(?![a-z])")
#: Names that only say what a wrapper has, or in which state something else is.
_STATE = re.compile(r"(?:^|-)(?:has|no|non|with|without|show|hide)-|-(?:open|opened|closed|enabled|disabled|on|off|active|visible)$")
_WHITE = re.compile(r"\s+")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I) for name in ("script", "style", "noscript", "iframe", "textarea", "title", "template", "svg", "math")}

MOST = 3.0  # log-odds that enclosing elements can add for content
SMOOTH = 1.0  # capacity between neighbours that share all ancestors
PROSE = 80  # characters of a block without many links that count as running text
WHOLE = 500  # characters of running text, and the share of the page's, that outweigh a wrapper's name
SHARE = 0.8
REACH = 3  # blocks in page order that are joined
UNIT = 1000  # capacities are whole numbers of 1 / UNIT

FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("blocks", T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()), T.StructField("odds", T.DoubleType()), T.StructField("content", T.BooleanType()),
])))])


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # numbers of the open elements, outermost first
    lean: float  # what these elements say
    linked: int  # characters inside links
    name: str = ""  # of the innermost element


def blocks_of(html: str) -> list[Block]:
    """Text between block-level tags, with references decoded and white space made single spaces."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, int, float, bool]] = [("", 0, 0.0, False)]  # name, number, lean, dropped
    number, at, links = 0, 0, 0
    owns: list[tuple[float, float | None]] = [(0.0, None)]  # of each element: its lean, and that without a poor name
    cores: set[int] = set()  # article and main elements without a poor name

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _WHITE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, tuple(n for _, n, _, _ in stack), stack[-1][2], linked, stack[-1][0]))
            parts.clear()
        linked = 0

    def close(down_to: int) -> None:
        nonlocal links
        links -= sum(name == "a" for name, *_ in stack[down_to:])
        del stack[down_to:]

    def write(text: str) -> None:
        nonlocal linked
        if text and not stack[-1][3]:
            parts.append(text)
            if links:
                linked += len(text.strip())

    while match := _TAG.search(html, at):
        write(html[at : match.start()])
        at = match.end()
        if not match[2]:
            continue
        name = match[2].lower()
        block = name not in INLINE
        if block:
            flush()
        if match[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth and (block or not any(s[0] not in INLINE for s in stack[depth + 1 :])):
                close(depth)
            continue
        for i in range(len(stack) - 1, 0, -1):
            open_name = stack[i][0]
            if name in CLOSED_BY.get(open_name, ()):
                close(i)
                break
            if open_name in SCOPE:
                break
        if name in VOID or match[3].endswith("/") and name in DROPPED:
            continue
        if name in _RAW:
            at = _RAW[name].search(html, at).end()
            continue
        number += 1
        _, _, lean, dropped = stack[-1]
        own, unnamed, hidden = _lean(name, match[3])
        owns.append((own, unnamed))
        if unnamed is None and name in ("article", "main"):
            cores.add(number)
        stack.append((name, number, _added(lean, own), dropped or hidden or name in DROPPED))
        links += name == "a"
    write(html[at:])
    flush()
    freed = _misnamed(out, {n for n, (_, unnamed) in enumerate(owns) if unnamed is not None}, cores)
    for block in out if freed else ():
        if not freed.isdisjoint(block.path):
            block.lean = 0.0
            for n in block.path[1:]:
                own, unnamed = owns[n]
                block.lean = _added(block.lean, unnamed if n in freed else own)
    return out


def _added(lean: float, own: float) -> float:
    """What an element makes of the log-odds of the elements around it."""
    return min(lean + own, MOST) if own > 0 else min(lean, MOST) + own


def _misnamed(blocks: list[Block], poor: set[int], cores: set[int]) -> set[int]:
    """Elements of a poor name that hold the page's article or main element, or nearly all of its running text.

    No article or main element with text may stand outside, so that comments never pass for the article.
    """
    inside: dict[int, set[int]] = {}  # the article and main elements that share a block with an element of a poor name
    holds: set[int] = set()  # elements of a poor name around an article or main element
    prose: dict[int, int] = {}
    used: set[int] = set()
    total = 0
    for b in blocks:
        named = [k for k, n in enumerate(b.path) if n in poor]
        core = [(k, n) for k, n in enumerate(b.path) if n in cores]
        used.update(n for _, n in core)
        n = len(b.text)
        long = n if n >= PROSE and b.linked < 0.2 * n else 0
        total += long
        for k in named:
            e = b.path[k]
            prose[e] = prose.get(e, 0) + long
            inside.setdefault(e, set()).update(n for _, n in core)
            if any(at > k for at, _ in core):
                holds.add(e)
    return {e for e, text in prose.items() if used <= inside[e] and (e in holds or text >= max(WHOLE, SHARE * total))}


def _lean(name: str, attributes: str) -> tuple[float, float | None, bool]:
    """Log-odds that an element adds for what it holds, the same without its poor name if it has one, and whether it is hidden."""
    lean = LEAN.get(name, 0.0)
    unnamed = None
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return lean, None, False
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attributes)}
    role = values.get("role", "").lower()
    lean += ROLES.get(role, 0.0)
    named = f"{values.get('class', '')} {values.get('id', '')}".lower()
    if len(named) > 1 and name not in ("html", "body"):
        # any word of a name counts, but not in names of a state
        names = [n for n in named.replace("_", "-").split() if not _STATE.search(n)]
        better = lean + 1.5 * any(map(_RICH.search, names))
        if any(map(_POOR.search, names)):
            lean, unnamed = lean - 7.0, better
        else:
            lean = better
    style = values.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in values or "display:none" in style or "visibility:hidden" in style or values.get("aria-hidden", "").lower() == "true"
    return lean, unnamed, hidden


def odds_of(block: Block) -> float:
    """Log-odds of content: where the block stands, how long it is, how much of it is links."""
    n = len(block.text)
    odds = -0.2 + block.lean + 0.45 * log1p(n / 20) - 4.0 * min(1.0, block.linked / n)
    return max(-12.0, min(12.0, odds + 0.5 * (block.text[-1] in ".!?:;\"'…")))


def _cost(odds: float) -> float:
    """-log of the probability with these log-odds."""
    return log(1 + exp(-odds)) if odds > -30 else -odds


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, weaker the farther apart in the page and in the tree, and
    for each open element the block of the same kind before in it, weaker the less they share."""
    edges = []
    direct: dict[tuple[int, str], int] = {}  # the last block of an element's own children of a name
    below: dict[tuple[int, str], int] = {}  # the last one anywhere in the element

    for j, block in enumerate(blocks):
        for i in range(max(0, j - REACH), j):
            edges.append((i, j, SMOOTH * _near(blocks[i], block) / (j - i)))
        parents = block.path[:-1]
        before = {below.get((n, block.name), j) for n in parents} | {direct.get((n, block.name), j) for n in parents[-1:]}
        edges += [(i, j, SMOOTH * _near(blocks[i], block)) for i in sorted(before) if i < j - REACH]
        below.update(((n, block.name), j) for n in parents)
        direct.update(((n, block.name), j) for n in parents[-1:])
    return edges


def _near(a: Block, b: Block) -> float:
    """How many of the open elements two blocks share."""
    shared = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        shared += 1
    return (shared / max(len(a.path), len(b.path))) ** 2


def minimum_cut(content: list[float], other: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source. Labelling a node content costs ``content``, otherwise ``other``.

    Max-flow by shortest augmenting paths over levels, in whole numbers; ties go to the sink.
    """
    n = len(content)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(round(forth * UNIT))
        graph[b].append(len(to))
        to.append(a)
        room.append(round(back * UNIT))

    for i in range(n):
        # the smaller of both costs is paid in any case
        paid = min(content[i], other[i])
        join(source, i, other[i] - paid, 0)
        join(i, sink, content[i] - paid, 0)
    for i, j, w in edges:
        join(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        while _augment(graph, to, room, level, tried, source, sink):
            pass


def _augment(graph, to, room, level, tried, source: int, sink: int) -> bool:
    """Send what one path of rising levels can carry."""
    path: list[int] = []
    a = source
    while a != sink:
        while tried[a] < len(graph[a]):
            e = graph[a][tried[a]]
            if room[e] > 0 and level[to[e]] == level[a] + 1:
                path.append(e)
                a = to[e]
                break
            tried[a] += 1
        else:
            if a == source:
                return False
            a = to[path.pop() ^ 1]
            tried[a] += 1
    carried = min(room[e] for e in path)
    for e in path:
        room[e] -= carried
        room[e ^ 1] += carried
    return True


def label_blocks(blocks: list[Block]) -> tuple[list[float], list[bool]]:
    odds = [odds_of(b) for b in blocks]
    return odds, minimum_cut([_cost(o) for o in odds], [_cost(-o) for o in odds], edges_of(blocks))


def extract(pages: DataFrame, html: str = "html", out: str = "main", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with the struct ``out``: ``text`` of the content blocks joined by one space, and all ``blocks``.

    Null and empty pages, and pages without text, have empty text and no blocks. Repeated rows give the
    same text. A column already called ``out`` is replaced; other columns stay.
    """

    def make():
        def one(page: bytes | None) -> dict:
            blocks = blocks_of(page.decode("utf-8", "replace")) if page else []
            odds, content = label_blocks(blocks)
            return {
                "text": " ".join(b.text for b, c in zip(blocks, content) if c),
                "blocks": [{"text": b.text, "odds": o, "content": c} for b, o, c in zip(blocks, odds, content)],
            }

        return lambda texts: [one(t) for t in texts]

    return with_struct(pages, html, out, FIELDS, make, keep)
