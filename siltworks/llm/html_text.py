"""Main text of web pages by tree scoring.

A page is cut into tags and texts and built into a tree, with the end tags that pages leave out. Elements that hold no article
(menus, forms, scripts, hidden ones, those whose class or id says so) are left out with all inside. Each paragraph, a block
with text of its own, passes points for its length and its commas to the blocks above it: whole to the nearest, half to the next,
and less further up. A block's points count for the share of its text that is not in links. The best block is the container;
where it lies in an `article`, or else in a `main`, that element is. Its siblings are kept where they have a fifth of its
points, or are headings or paragraphs with few links. The text of what is kept is read in page order.

Every loop over a page is linear in its length; pages are read whole, each in one task, one at a time.

Defined cases: a null or empty page, or one without text, gives an empty text; text without any tag is the text; white space is
what Unicode calls so, no-break spaces included; `<br>` is white space; a tag, comment or script that never ends goes on to the
end of the page, but a "<" without ">" behind is text; a tag with more than 65536 characters ends at its first ">". An `li`, `td` or the like ends one before it that is at most 64 elements up. Of blocks
with the same points the first is best. Rows that repeat are pages of their own; other columns are kept, with free names for
the new ones; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_batches, free_names

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'){0,65536}+)>", re.S)
_SHORT_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![^\s"'/>=])""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
LEFT_OUT = RAW | frozenset("head template object svg canvas video audio map math form input select option button datalist fieldset label nav aside footer menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends, and the elements that it does not look beyond.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
SCOPES = frozenset("td th caption table button object html".split())

#: Words in a class, id or role that name what is no article. Elements of KEEP_ALWAYS are not judged by their names.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond "
    "reply replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar "
    "pagination pager contentinfo complementary search dialog alert skip".split()
)
KEEP_ALWAYS = frozenset("html body article main".split())
ARTICLE = frozenset("article body content entry main post story text blog page".split())
#: Points that a block starts with.
START = {"article": 25.0, "main": 25.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0}
NAMED = 25.0
#: Blocks above a paragraph that it passes points to.
LEVELS = 6
#: A sibling stays with this share of the container's points.
SIBLING = 0.2
#: A heading or paragraph stays, and a list stays in the container, with at most this share of its text in links.
LINKS = 0.5
MENU_LINKS = 0.8


class _Page:
    """The tree of one page, in lists by the number of an element. Element 0 is the page."""

    def __init__(self) -> None:
        self.tag, self.parent, self.bonus = ["html"], [-1], [0.0]
        self.texts: list[tuple[int, str]] = []

    def add(self, tag: str, parent: int, bonus: float) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.bonus.append(bonus)
        return len(self.tag) - 1


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes), ("close", tag, ""). Comments and declarations are passed over."""
    at, n, start, bound = 0, len(page), 0, -1
    while (at := page.find("<", at)) >= 0:
        if bound < at and (bound := page.find(">", at)) < 0:
            # no tag ends any more; only a comment may begin
            bound, at = n, page.find("<!--", at)
            if at < 0:
                break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1 or n
        else:
            m = _TAG.match(page, at) or _SHORT_TAG.match(page, at)
            if m is None:
                at += 1
                continue
            end = m.end()
        if at > start:
            yield "text", page[start:at], ""
        if not page.startswith(("<!", "<?"), at):
            tag = m[2].lower()
            yield "close" if m[1] else "open", tag, m[3]
            if not m[1] and tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, end)
                end = close.start() if close else n
        start = at = end
    if start < n:
        yield "text", page[start:], ""


def _judge(tag: str, attributes: str) -> tuple[bool, float]:
    """Whether an element is left out, and the points that it starts with."""
    bonus = START.get(tag, 0.0)
    if tag in LEFT_OUT:
        return True, bonus
    if not attributes.strip("/ "):
        return False, bonus
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _INVISIBLE.search(value):
            return True, bonus
        if name in ("class", "id", "role", "itemprop"):
            words = {w.lower() for w in _NAME_PARTS.findall(value)}
            if tag not in KEEP_ALWAYS and not words.isdisjoint(NOT_ARTICLE):
                return True, bonus
            if not words.isdisjoint(ARTICLE):
                bonus += NAMED
    return False, bonus


def _tree(page: str) -> _Page:
    tree = _Page()
    stack = [(0, "html")]
    opened = Counter(["html"])
    #: Paragraphs open in each scope; the number of elements on the stack that are left out.
    in_scope = [0]
    out = 0
    skipped: list[bool] = [False]

    def pop() -> str:
        nonlocal out
        _, tag = stack.pop()
        opened[tag] -= 1
        out -= skipped.pop()
        if tag in SCOPES and len(in_scope) > 1:
            in_scope.pop()
        elif tag == "p":
            in_scope[-1] -= 1
        return tag

    for kind, what, attributes in _tokens(page):
        if kind == "text":
            if not out:
                tree.texts.append((stack[-1][0], what))
        elif kind == "close":
            if what == "br":
                kind = "open"
            elif what in ("html", "body"):
                continue
            elif opened[what]:
                while pop() != what:
                    pass
                continue
            else:
                continue
        if kind != "open":
            continue
        tag = what
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS:
            while in_scope[-1]:
                pop()
        if tag in ENDS and any(opened[t] for t in ENDS[tag]):
            # the nearest of those that the tag ends, unless one that it stays within is nearer
            for depth in range(len(stack) - 1, max(0, len(stack) - 64) - 1, -1):
                name = stack[depth][1]
                if name in WITHIN[tag]:
                    break
                if name in ENDS[tag] and (tag != "tr" or name == "tr" or not opened["tr"]):
                    while len(stack) > depth:
                        pop()
                    break
        if tag == "br":
            if not out:
                tree.texts.append((stack[-1][0], " "))
            continue
        gone, bonus = _judge(tag, attributes)
        if tag == "header" and not (opened["article"] or opened["main"]):
            gone = True
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            if tag in BLOCKS and not out:
                tree.add(tag, stack[-1][0], 0.0)
            continue
        node = stack[-1][0] if out or gone else tree.add(tag, stack[-1][0], bonus)
        stack.append((node, tag))
        opened[tag] += 1
        skipped.append(gone)
        out += gone
        if tag in SCOPES:
            in_scope.append(0)
        elif tag == "p":
            in_scope[-1] += 1
    return tree


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    tree = _tree(page)
    n = len(tree.tag)
    tag, parent = tree.tag, tree.parent
    block = list(range(n))
    linked = [False] * n
    for i in range(1, n):
        if tag[i] not in BLOCKS:
            block[i] = block[parent[i]]
            linked[i] = linked[parent[i]] or tag[i] == "a"
        else:
            linked[i] = linked[parent[i]]
    chars, commas, in_links, links = [0] * n, [0] * n, [0] * n, [0] * n
    read = []
    for i, raw in tree.texts:
        text = html.unescape(raw) if "&" in raw else raw
        size = sum(map(len, text.split()))
        read.append(text)
        if size:
            b = block[i]
            chars[b] += size
            commas[b] += text.count(",") + text.count("，") + text.count("،") + text.count("、")
            in_links[b] += size if linked[i] else 0
    for i in range(1, n):
        if tag[i] == "a":
            links[block[i]] += 1
    points = list(tree.bonus)
    up = [-1] * n
    for i in range(1, n):
        up[i] = block[parent[i]]
    # paragraphs pass their points to the blocks above; a paragraph's own block counts for a page that is one block
    scored = [False] * n
    for i in range(n):
        if block[i] != i or not chars[i]:
            continue
        gain = (1 + commas[i] + min(chars[i] / 100, 3)) * (1 - in_links[i] / chars[i])
        to, level = up[i], 1
        if to < 0:
            to = i
        while to >= 0 and level <= LEVELS:
            points[to] += gain / (level if level < 3 else 3 * (level - 1))
            scored[to] = True
            to, level = up[to], level + 1
    for i in range(n - 1, 0, -1):
        if block[i] == i:
            above = up[i]
            chars[above] += chars[i]
            in_links[above] += in_links[i]
            links[above] += links[i]
    density = [in_links[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
    final = [points[i] * (1 - density[i]) for i in range(n)]
    candidates = [i for i in range(n) if scored[i]]
    if not candidates:
        return ""
    best = max(candidates, key=final.__getitem__)
    for wanted in ("article", "main"):
        at = best
        while at >= 0 and tag[at] != wanted:
            at = up[at]
        if at >= 0:
            best = at
            break
    keep = [False] * n
    keep[best] = True
    if up[best] >= 0:
        for i in range(1, n):
            if i != best and block[i] == i and up[i] == up[best] and chars[i]:
                few = density[i] <= LINKS
                keep[i] = scored[i] and final[best] > 0 and final[i] >= SIBLING * final[best] or few and (tag[i] == "p" or tag[i] in HEADINGS)
    inside = [False] * n
    for i in range(n):
        menu = i != best and tag[i] in ("ul", "ol", "dl", "table", "div", "section") and links[i] >= 3 and density[i] >= MENU_LINKS
        inside[i] = keep[i] or (i > 0 and inside[parent[i]] and not menu)
    parts, last = [], -1
    for (i, _), text in zip(tree.texts, read):
        if inside[i]:
            if block[i] != last:
                parts.append(" ")
                last = block[i]
            parts.append(text)
        elif block[i] != last:
            last = -1
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, page: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows without the column `page`, columns as they were, with the main text and its number of code points."""
    arrow_batches(pages.sparkSession)
    names = [c for c in pages.columns if c != page]
    coded = pages.select(F.coalesce(F.col(f"`{page}`").cast("string"), F.lit("")).alias("page"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py()) for value in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*batch.schema.names[1:], "text", "n_chars"])

    schema = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    return coded.mapInArrow(run, ", ".join(filter(None, [schema, "text string, n_chars long"]))).toDF(*names, *free_names(names, text, n_chars))
