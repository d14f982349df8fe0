"""Main text of web pages by tag-path ratios (operator 3).

A page is cut into text nodes, each with its path of open tags from root to leaf (tag names
with the roles that ``class``, ``id`` and ``role`` attributes name). Per path the text
length, punctuation and number of nodes are summed; the two ratios - text per node and
punctuation per node - are smoothed along the page, fused by their product, and the paths
whose fused ratio reaches a threshold that follows from the page's own spread are content
paths, unless they hold link texts only; so are paths nearly as dense, whatever their share. Blocks with nodes on content paths
are selected wherever they stand. Others are added if they stand in the same element as selected
text (lists, quotes and cells count as standing in theirs) or wholly between two such blocks, if
they are headings of them, or short and next to them in the innermost element that holds all
selected text: a ratio cannot tell a short last paragraph from a
caption. Paths through menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comment sections take no part. Comments, footers, menus and adverts never do, however
much they hold; where only a looser role (a sidebar, a header, a form) says so, an element stays in
that holds the bulk of the text, and all stay in if nothing else is left; layout modifiers
(``with-sidebar``, ``comments-open``) and the ids of sections and headings are no roles.

Blocks are joined in page order. Pages are handled row by row in Arrow batches, so nothing
is moved. Defined results: a null or empty page has an empty text; a page without any
content path gives all its block text outside the excluded paths; text outside any tag
counts as a block; a line break is white space. Unclosed and wrongly nested tags close with their ancestors. A page
of any length and depth takes time and memory in proportion to its length: paths are numbers in a tree of
paths, not lists of tags. Repeated
rows each get their own row; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math select option xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
                  "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul video audio canvas object".split())
PLAIN = frozenset("aside footer form nav button dialog head menu label object audio video canvas fieldset".split()) | RAW
CLOSES_P = BLOCK - {"html", "body"}
SAME = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}

# Roles in class, id and role attributes that are never main text: as the first part of a name, as its last, and what an id may hold after the first.
_FIRST = (r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer\w*|foot|header|masthead|"
          r"cookies?|consent|gdpr|notices?|alert\w*|popup\w*|modal\w*|newsletter\w*|subscri\w*|comments?|commentlist|respond|replies|reply|discussion|disqus\w*|"
          r"share\w*|social\w*|related\w*|recommend\w*|widget\w*|toolbar\w*|pagination|pager|login|signup|search\w*|copyright|legal|skip\w*|hidden|"
          r"navigation|complementary|contentinfo|dialog|form)")
_LAST = (r"(?:ads?|adverts?|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|footer|header|masthead|cookies?|consent|popup|modal|newsletter|"
         r"comments?|replies|share|social|related|widgets?|toolbar|pagination|pager|login|signup|copyright)")
_PLACE = r"(?:area|list|section|wrap\w*|container|box|bar|left|right|inner|outer|top|bottom|links?|form|content|primary|secondary|panel|block|region|holder|posts?|buttons?|widgets?|[0-9]+)"
EXCLUDED = re.compile(rf"{_FIRST}(?:$|[_-])|(?:.*[_-])?{_LAST}(?:$|[_-])", re.I)
EXCLUDED_ID = re.compile(rf"(?!discussion$){_FIRST}(?:[_-]+{_PLACE})*$|(?:.*[_-])?(?:{_LAST}$|(?:comments|footer|sidebar|navbar|navigation|breadcrumbs)(?:$|[_-]))", re.I)
# Roles that keep text out however much of it there is.
FIRM = re.compile(r"(?:.*[_-])?(?:comments?|commentlist|respond|repl(?:y|ies)|disqus\w*|foot|footer\w*|contentinfo|copyright|nav\w*|menu\w*|breadcrumbs?|pagination|pager|"
                  r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter\w*|subscri\w*|shar(?:e|ing)|related\w*|recommend\w*)(?:$|[_-])", re.I)
# What a name says about the layout of an element or its state, not about its role.
MODIFIER = re.compile(r"(?:^|[_-])(?:no|has|with|without)[_-].*", re.I)
STATE = re.compile(r"[_-](?:open|closed|enabled|disabled|on|off|fixed|sticky)$", re.I)
# Elements that structure the text of the element they stand in.
TEXT = frozenset("p li ul ol dir dl dt dd blockquote pre h1 h2 h3 h4 h5 h6 hr center address".split())
CELL = frozenset("td th".split())
TABLE = CELL | frozenset("tr table tbody thead tfoot".split())
SHORT = 80        # characters of a block that a ratio says nothing about
DENSE = 0.25      # of the usual ratio of content, without shares
BULK = 0.5        # share of the text that an element of such a role does not hold
LONGER = 10       # times the text of articles outside it, for comments can be longer than what they comment on
# The head of an article is part of it, and an article element is reader comment or teaser only by its first role.
ARTICLE_HEAD = re.compile(r"(?:entry|post|article|content|story|page)[_-]?(?:header|title|heading|head)\b", re.I)
NOT_ARTICLE = re.compile(r"(?:comment|reply|related|promo|teaser|ad)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ROLE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
WHITE = re.compile(r"[\s\xa0]+")
HEADING = re.compile(r"h[1-6]\Z")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def barring(tag: str, roles: list[tuple[str, str]]) -> int:
    """Whether an element of these (attribute, value) roles looks like no part of the main text: 0 no, 1 unless it holds the bulk, 2 in any case."""
    if tag == "article":
        return int(bool(NOT_ARTICLE.match(" ".join(value for _, value in roles))))
    if tag in ("main", "body", "html"):
        return 0
    # Ids of sections and headings name their subject.
    subject = tag == "section" or bool(HEADING.match(tag)) or any(kind == "class" and "section" in value.lower().split() for kind, value in roles)
    bad = 0
    for kind, value in roles:
        if kind == "id" and subject:
            continue
        excluded = EXCLUDED_ID if kind == "id" else EXCLUDED
        for name in ARTICLE_HEAD.sub("", value).split():
            name = MODIFIER.sub("", CAMEL.sub("-", name))
            if excluded.match(name):
                bad = max(bad, 2 if FIRM.match(name) and not STATE.search(name) else 1)
    return bad


class Paths:
    """The tree of a page's paths: a path is its parent's number and a label, and has a number of its own."""

    def __init__(self):
        self.parent, self.tag, self.depth = [-1], [""], [0]
        self.link, self.heading, self.holder, self.textual, self.untabled = [False], [False], [0], [False], [0]
        self.numbers: dict[tuple[int, str], int] = {}

    def under(self, parent: int, label: str) -> int:
        found = self.numbers.get((parent, label))
        if found is not None:
            return found
        n = self.numbers[parent, label] = len(self.parent)
        tag = label.partition(".")[0]
        self.parent.append(parent)
        self.tag.append(tag)
        self.depth.append(self.depth[parent] + 1)
        self.link.append(self.link[parent] or tag == "a")
        self.heading.append(self.heading[parent] or bool(HEADING.match(tag)))
        # The innermost element that is no inline element, paragraph, list, quote or cell of one; whether text elements lie between.
        own = tag in BLOCK and tag not in TEXT
        self.holder.append(n if own else self.holder[parent])
        self.textual.append(not own and (tag in TEXT or self.textual[parent]))
        self.untabled.append(self.untabled[parent] if tag in TABLE else n)
        return n

    def container(self, path: int) -> int:
        """The element that a block of text stands in: without inline elements, paragraphs, lists, quotes and cells at its end."""
        held = self.holder[path]
        return self.untabled[held] if self.tag[held] in CELL and not self.textual[path] else held

    def spans(self) -> tuple[list[int], list[int]]:
        """When a walk over the tree enters and has left each path: a path lies below another if its span lies in the other's."""
        n = len(self.parent)
        below = [1] * n
        for i in range(n - 1, 0, -1):  # children have larger numbers
            below[self.parent[i]] += below[i]
        start, free = [0] * n, [1] * n
        for i in range(1, n):
            p = self.parent[i]
            start[i] = start[p] + free[p]
            free[p] += below[i]
        return start, [a + b for a, b in zip(start, below)]


def nodes(page: str) -> tuple[Paths, list[tuple[int, int, str, bool]]]:
    """The paths of a page, and its text nodes in page order: path, number of the block, raw text, whether it may be content."""
    paths, out = Paths(), []
    block = at = text_from = 0
    # Open elements from the root on: tag, path, bar, whether in or below an article or main.
    tags, at_path, at_bar, in_article = [""], [0], [0], [False]
    where: dict[str, list[int]] = {}  # positions of each open tag
    blocks: list[int] = []            # positions of open block elements
    # Bars: 0 is none; others have the bar around them and how firm they are: 1 by role, 2 for good.
    around, firm = [0], [0]

    def put(text: str) -> None:
        if text:
            out.append((at_path[-1], block, text, at_bar[-1], in_article[-1]))

    def close(position: int) -> None:
        while len(tags) > position:
            tag = tags.pop()
            where[tag].pop()
            if tag in BLOCK:
                blocks.pop()
            at_path.pop(), at_bar.pop(), in_article.pop()

    def last(*names: str) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        put(page[text_from:m.start()])
        text_from = at = m.end()
        if m[0].startswith("<![CDATA["):
            put(m[0][9:].removesuffix("]]>"))
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            block += 1
        elif tag == "br":
            put(" ")
        if m[1]:
            if where.get(tag):
                close(where[tag][-1])
            continue
        if tag in CLOSES_P and blocks and tags[blocks[-1]] == "p":
            close(blocks[-1])
        if tag in SAME:
            alike = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
            if (same := last(*alike)) > last(*SAME[tag]):
                close(same)
        if tag in VOID or m[3].endswith("/") and tag not in RAW and tag not in BLOCK:
            continue
        if tag in RAW:
            # Up to the end tag nothing is markup.
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if end is None:
                text_from = len(page)
                break
            stop = page.find(">", end.end())
            text_from = at = len(page) if stop < 0 else stop + 1
            continue
        named = [(kind.lower(), a or b or c) for kind, a, b, c in ROLE.findall(m[3])] if m[3] else []
        words = " ".join(value for _, value in named).split()
        bad = 0
        if tag in PLAIN and tag != "form" or tag == "header" and not in_article[-1] or m[3] and HIDDEN.search(m[3]):
            bad = 2
        elif tag == "form" or named:
            bad = max(int(tag == "form"), barring(tag, named) if named else 0)
        if bad:
            around.append(at_bar[-1])
            firm.append(bad)
        where.setdefault(tag, []).append(len(tags))
        if tag in BLOCK:
            blocks.append(len(tags))
        at_path.append(paths.under(at_path[-1], f"{tag}.{words[0].lower()}" if words else tag))
        at_bar.append(len(around) - 1 if bad else at_bar[-1])
        in_article.append(in_article[-1] or tag in ("article", "main"))
        tags.append(tag)
    put(page[text_from:])
    return paths, lifted(out, around, firm)


def lifted(found: list[tuple[int, int, str, int, bool]], around: list[int], firm: list[int]) -> list[tuple[int, int, str, bool]]:
    """Nodes with their bars resolved: a loose role (or form) does not bar the bulk of the text, nor all of it.

    An element does not hold the bulk if article or main elements have text of some length beside it.
    """
    # Out for good: firm bars and what they hold. An outer bar has a smaller number.
    out = [False] * len(around)
    for b in range(1, len(around)):
        out[b] = firm[b] == 2 or out[around[b]]
    size = [0] * len(around)
    total = named = 0
    for _, _, text, bar, article in found:
        n = len(text.strip())
        if out[bar]:
            continue
        total += n
        named += n if article and not bar else 0
        size[bar] += n
    for b in range(len(around) - 1, 0, -1):
        size[around[b]] += size[b]
    open_ = [True] * len(around)
    for b in range(1, len(around)):
        open_[b] = open_[around[b]] and not out[b] and size[b] > BULK * total and size[b] > LONGER * named
    if not any(open_[bar] and text.strip() for _, _, text, bar, _ in found):
        open_ = [not x for x in out]
    return [(path, block, text, open_[bar]) for path, block, text, bar, _ in found]


def sums(found: list[tuple[int, int, str, bool]]) -> dict[int, list[int]]:
    """Characters, punctuation and number of the content nodes of each path, in the order of the page."""
    out: dict[int, list[int]] = {}
    for path, _, text, may in found:
        size = len(text.strip())
        if may and size:
            x = out.setdefault(path, [0, 0, 0])
            x[0] += size
            x[1] += len(PUNCTUATION.findall(text))
            x[2] += 1
    return out


def ratios(of: dict[int, list[int]]) -> tuple[dict[int, float], float]:
    """Fused ratio of each path and the threshold."""
    if not of:
        return {}, 0.0
    s = np.array(list(of.values()), float)
    text, punctuation = s[:, 0] / s[:, 2], s[:, 1] / s[:, 2]
    kernel = np.array([0.25, 0.5, 0.25])
    if len(s) >= 3:
        text, punctuation = (np.convolve(np.pad(x, 1, mode="edge"), kernel, mode="valid") for x in (text, punctuation))
    # Weighted by their share of the text, so that one long path outweighs many short ones.
    fused = np.sqrt(text * (1 + punctuation)) * (s[:, 0] / s[:, 0].sum())
    return dict(zip(of, fused.tolist())), float(min(fused.std(), fused.max()) * 0.5)


def content_paths(paths: Paths, found: list[tuple[int, int, str, bool]]) -> set[int]:
    """Paths whose fused ratio reaches the threshold, and those of prose nearly as dense, for a share says nothing about one of many sections.

    Paths of link texts need that density.
    """
    of = sums(found)
    fused, least = ratios(of)
    reached = {p for p, x in fused.items() if x >= least}
    # Many links reach it by their share alone.
    content = {p for p in reached if not paths.link[p]} or reached
    dense = {p: (size / n * (1 + marks / n)) ** 0.5 for p, (size, marks, n) in of.items()}
    whole = sum(of[p][0] for p in content)
    usual = sum(dense[p] * of[p][0] for p in content) / whole if whole else 0.0
    return content | {p for p, x in dense.items() if x >= DENSE * usual}


def main_text(page: str | None) -> str:
    if not page:
        return ""
    paths, found = nodes(page)
    content = content_paths(paths, found)
    # Blocks in page order: text, path, whether a heading, whether it holds a content node.
    chosen: dict[int, list] = {}
    for path, block, text, may in found:
        if may:
            x = chosen.setdefault(block, [[], path, False, False])
            x[0].append(text)
            x[2] = x[2] or paths.heading[path]
            x[3] = x[3] or path in content and bool(text.strip())
    blocks = [(t, paths.container(path), heading, selected) for _, (texts, path, heading, selected) in sorted(chosen.items())
              if (t := WHITE.sub(" ", html.unescape("".join(texts))).strip())]
    taken = _taken(blocks, paths)
    return "\n".join(t for (t, *_), take in zip(blocks, taken) if take)


def _taken(blocks: list[tuple[str, int, bool, bool]], paths: Paths) -> list[bool]:
    """Which blocks belong to the main text: selected ones, and by them headings, short ones and what stands inside their text."""
    inside = {place for _, place, _, selected in blocks if selected}
    if not inside:
        return [True] * len(blocks)
    start, end_of = paths.spans()
    below = lambda place, top: start[top] <= start[place] < end_of[top]
    # The innermost element that holds all of them: the first and the last that a walk meets decide.
    root, other = min(inside, key=start.__getitem__), max(inside, key=start.__getitem__)
    while not below(other, root):
        root = paths.parent[root]
    taken = [selected or place in inside for _, place, _, selected in blocks]
    out = list(taken)
    # Runs of other blocks: between two taken blocks of one container and below it they are part of its text.
    at = 0
    while at < len(blocks):
        end = at
        while end < len(blocks) and not taken[end]:
            end += 1
        if 0 < at < end < len(blocks):
            place = blocks[at - 1][1]
            if place == blocks[end][1] and place and all(below(blocks[i][1], place) for i in range(at, end)):
                out[at:end] = [True] * (end - at)
        # Short blocks next to a taken one, in the element that holds all content.
        for i, near in ((at, at > 0), (end - 1, end < len(blocks))):
            if at < end and near and len(blocks[i][0]) <= SHORT and below(blocks[i][1], root):
                out[i] = True
        at = end + 1
    # A heading belongs to the taken block that follows it, short lines between them aside.
    before = False
    for i in range(len(blocks) - 1, -1, -1):
        text, _, heading, _ = blocks[i]
        if heading and before:
            out[i] = True
        before = out[i] or before and not heading and len(text) <= SHORT
    return out


@F.pandas_udf(StringType())
def _extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    x = pages.select("page_id", "url", _extract(F.col("html").cast("string")).alias("text"))
    return x.withColumn("n_chars", F.length("text").cast("bigint"))
