"""Main-text extraction from HTML: flat text blocks classified by a small decision tree.

A page is read once into blocks, the texts between block-level tags, in time that grows with its length alone. A block is known by
its word count and link density, those of the blocks before and after it, and two marks of where it stands (inside article or main;
inside a part that is by its tag or its name navigation, header, footer, advert, comment and so on). Such names are weak or strong:
an article in a part with a weak one, or a page in one form, is still the article where the page has no other. A decision tree, grown
from the small labelled table below, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import utf8

# Names of HTML.
SKIPPED = frozenset("script style noscript template svg math title textarea select button iframe object canvas audio video map".split())
#: Their content is no markup: they end at their own end tag only.
RAW = frozenset("script style title textarea iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
#: A new one of these ends an open one of the same kind.
CLOSES_SELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A part is named so by a whole class token or the last word of one.
ASIDE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs
    sidebar side footer header masthead comment comments commentlist replies reply respond disqus discussion cookie cookies consent gdpr notice
    notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations widget tags
    pagination pager copyright legal disclaimer toolbar search""".split()
)
#: Or by the first word of one; not where an earlier word says that the part has or lacks such a thing, or is beside it.
ASIDE_FIRST = ASIDE_NAMES - frozenset("header side legal search tags alert login notice reply share overlay".split())
BESIDE = frozenset("has have with without no not non is hide above below after before".split())
#: No aside by their names.
NEVER_ASIDE = frozenset("html body main".split())
#: A part whose name says that it holds main text.
MAIN_NAMES = frozenset("main article maincontent main-content article-body articlebody article-content post-content entry-content post-body story-body".split())
#: What stands in these is never main text; of other asides an article or a whole page can be a part.
STRONG = frozenset("nav footer aside menu dialog".split())
STRONG_NAMES = frozenset(
    """comment comments commentlist replies reply respond disqus discussion related recommended recommendations nav navbar navigation menu
    sidebar footer cookie cookies consent ad ads advert adverts advertisement advertising sponsor sponsored""".split()
)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTED_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"""(?<![^\s=/>"'])([^\s=/>"']++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")


@dataclass
class Block:
    """parts: the raw pieces of the text; linked: those that stand in links. aside: 0, or 1 by a weak mark, 2 by a strong one.
    within: the same by the marks inside the outermost article or main alone; form: whether forms without an aside's name are the only mark."""

    inside: bool = False
    aside: int = 0
    within: int = 0
    form: bool = False
    link: bool = False
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def aside_name(value: str) -> int:
    """Whether a class, id, role or label names an aside: 0, 1, or 2 for a strong name."""
    best = 0
    for token in value.lower().split():
        words = re.split(r"[_-]+", token)
        if not BESIDE.intersection(words[:-1]) and (token in ASIDE_NAMES or words[-1] in ASIDE_NAMES or words[0] in ASIDE_FIRST):
            best = max(best, 2 if STRONG_NAMES.intersection((token, words[-1], words[0])) else 1)
    return best


def marks_of(tag: str, attributes: str) -> tuple[int, bool]:
    """An element's own mark (0, 1 weak, 2 strong), and whether it holds main text by its tag or name."""
    mark, main = 2 if tag in STRONG else int(tag in ASIDE), tag in MAIN
    for name, a, b, c in ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        name, value = name.lower(), html.unescape(a or b or c)
        if name in ("class", "id", "role", "aria-label"):
            if tag not in NEVER_ASIDE:
                mark = max(mark, aside_name(value), 2 * (name == "role" and value.lower() in ("complementary", "contentinfo", "dialog", "alertdialog")))
            main = main or name != "aria-label" and tag not in ("html", "body") and not MAIN_NAMES.isdisjoint(value.lower().split())
    if tag not in NEVER_ASIDE and " hidden" in attributes.lower() and re.search(r"\shidden(?:\s|$|=)", attributes.lower()):
        mark = 2
    return mark, main and not mark or tag in MAIN


def ends_of(page: str, tag: str) -> dict[int, int]:
    """For each start tag of a skipped element, by its place, where the element ends; elements of its own kind inside it are counted. Those without an end tag are left out."""
    found, open_ = {}, []
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*+(?:>|$)", re.I).finditer(page):
        if not m[1]:
            open_.append(m.start())
        elif tag in RAW:
            found.update(dict.fromkeys(open_, m.end()))
            open_ = []
        elif open_:
            found[open_.pop()] = m.end()
    return found


def tokens(page: str) -> Iterator[tuple[str | None, bool, str]]:
    """(tag in lower case, whether an end tag, attributes) or (None, False, text) in order, without comments and what is inside
    skipped elements. Each place is looked at a fixed number of times: after the first tag whose quotes leave it without an end, and
    in that tag, quotes count as any other character; a skipped element without an end tag is empty, script and style go on to the end."""
    at, quotes, cdata, ends = 0, True, True, {}
    last = page.rfind(">")
    while at < len(page):
        start = at
        if page[at] != "<":
            at = page.find("<", at)
            at = len(page) if at < 0 else at
            yield None, False, page[start:at]
            continue
        if page.startswith("<!--", at):
            at = page.find("-->", at + 4)
            if at < 0:
                return
            at += 3
            continue
        if cdata and page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            if end >= 0:
                yield None, False, html.escape(page[at + 9 : end])
                at = end + 3
                continue
            cdata = False
        m = TAG.match(page, at) if at < last else None
        if m is None:
            if at < last and page[at + 1] in "!?":
                at = page.find(">", at) + 1
            else:
                at += 1
                yield None, False, "<"
            continue
        if m.end() > last:  # a name to the end of the page
            at += 1
            yield None, False, "<"
            continue
        end = QUOTED_END.match(page, m.end()) if quotes else None
        quotes = end is not None
        at = end.end() if end else page.find(">", m.end()) + 1
        tag, attributes = m[2].lower(), page[m.end() : at - 1]
        yield tag, bool(m[1]), attributes
        if tag in SKIPPED and not m[1] and not (attributes.endswith("/") and tag in ("svg", "math", "iframe")):
            if tag not in ends:
                ends[tag] = ends_of(page, tag)
            end = ends[tag].get(start)
            if end is None:
                at = len(page) if tag in ("script", "style") else at
            else:
                at = max(at, end)


def blocks_of(page: str) -> list[Block]:
    """The text blocks in page order; those without text are left out."""
    out: list[Block] = []
    stack: list[tuple[str, Block]] = []  # tags and what they say of the text in them
    places: dict[str, list[int]] = {}  # where in the stack a tag stands
    solid = [-1]  # where in the stack block-level tags stand
    block = top = Block()

    def push(tag: str, state: Block) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            solid.append(len(stack))
        stack.append((tag, state))

    def cut(size: int) -> None:
        while len(stack) > size:
            tag, _ = stack.pop()
            places[tag].pop()
            if tag not in INLINE:
                solid.pop()

    def end() -> None:
        nonlocal block
        if any(not p.isspace() for p in block.parts):
            out.append(block)
        block = Block(top.inside, top.aside, top.within, top.form)

    for tag, closing, rest in tokens(page):
        if tag is None:
            block.parts.append(rest)
            if top.link:
                block.linked.append(rest)
            continue
        if tag in VOID or tag in SKIPPED:
            if tag in ("br", "hr"):
                block.parts.append(" ")
            continue
        at = places[tag][-1] if places.get(tag) else None
        if tag not in INLINE:
            if closing:
                if at is not None:
                    cut(at)
            else:
                while stack and (stack[-1][0] in INLINE or stack[-1][0] in CLOSES_SELF.get(tag, ())):
                    cut(len(stack) - 1)
                up = stack[-1][1] if stack else Block()
                mark, main = marks_of(tag, rest)
                within = max(up.within, mark)
                if tag in MAIN and not up.inside:
                    within = mark if mark == 2 or up.aside == 2 else 0
                    within = 2 if up.aside == 2 else within
                form = (up.form or not up.aside) and not marks_of("div", rest)[0] if tag == "form" else up.form and not mark
                push(tag, Block(up.inside or main, max(up.aside, mark), within, form, up.link))
            top = stack[-1][1] if stack else Block()
            end()
            continue
        if closing:
            if at is not None and at > solid[-1]:
                cut(at)
        else:
            mark = marks_of(tag, rest)[0] if tag == "span" and not top.aside else 0
            push(tag, Block(top.inside, max(top.aside, mark), max(top.within, mark), top.form and not mark, top.link or tag == "a"))
        top = stack[-1][1] if stack else Block()
        if top.aside != block.aside:
            end()
    end()
    return out


def settle(blocks: list[Block]) -> None:
    """Takes back marks that would lose the article: where no article or main stands outside asides, weak marks on or around the
    outermost one do not count; where a page has nothing outside asides, a form around text is the page and no aside."""
    if not any(b.inside and not b.aside for b in blocks):
        for b in blocks:
            if b.inside and not b.within:
                b.aside = 0
    if all(b.aside for b in blocks):
        for b in blocks:
            if b.form:
                b.aside = 0


#: The columns of a block's features.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "inside", "aside")
# The labelled table, FEATURES and 1 for main text.
LABELLED = (
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.0, 1, 1.0, 8, 0.0, 0, 1, 0),
    (9, 0.0, 2, 1.0, 11, 0.0, 0, 1, 0), (14, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0), (55, 0.0, 40, 0.0, 60, 0.0, 0, 1, 0),
    (80, 0.0, 90, 0.0, 6, 0.0, 1, 1, 0), (12, 0.1, 70, 0.0, 15, 0.1, 1, 1, 0), (30, 0.0, 65, 0.0, 28, 0.0, 1, 1, 0),
    (120, 0.05, 20, 0.0, 18, 0.0, 0, 1, 0), (7, 0.3, 90, 0.0, 0, 0.0, 0, 1, 0), (6, 1.0, 60, 0.0, 5, 1.0, 1, 0, 0),
    (5, 1.0, 6, 1.0, 7, 1.0, 1, 0, 0), (4, 1.0, 5, 1.0, 0, 0.0, 1, 0, 0), (8, 0.9, 30, 0.0, 7, 0.9, 1, 0, 0),
    (6, 1.0, 1, 1.0, 55, 0.0, 0, 1, 0), (60, 0.0, 4, 1.0, 80, 0.0, 0, 1, 0), (120, 0.0, 70, 0.0, 150, 0.0, 0, 1, 0),
    (9, 0.0, 12, 0.0, 200, 0.0, 0, 1, 0), (40, 0.0, 90, 0.0, 45, 0.0, 1, 1, 0), (75, 0.0, 60, 0.0, 110, 0.0, 1, 1, 0),
    (18, 0.0, 30, 0.0, 64, 0.0, 1, 1, 0), (4, 1.0, 80, 0.0, 90, 0.0, 0, 1, 0), (3, 0.0, 40, 0.0, 70, 0.0, 0, 1, 0),
    (9, 0.0, 9, 0.0, 60, 0.0, 1, 0, 1), (60, 0.0, 9, 0.0, 45, 0.0, 1, 0, 1), (1, 0.0, 80, 0.0, 50, 0.0, 1, 0, 1),
    (2, 0.0, 0, 0.0, 3, 0.0, 1, 0, 1), (3, 0.0, 2, 0.0, 0, 0.0, 1, 0, 1), (150, 0.02, 40, 0.0, 5, 0.0, 1, 0, 1),
    (25, 0.2, 70, 0.0, 90, 0.0, 1, 0, 1), (12, 0.4, 35, 0.0, 50, 0.0, 1, 0, 1), (5, 0.0, 120, 0.0, 7, 0.3, 1, 0, 1),
    (40, 0.0, 60, 0.0, 3, 0.0, 1, 0, 1), (7, 0.0, 55, 0.0, 2, 0.0, 1, 0, 1), (90, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1),
    (2, 0.0, 4, 0.0, 2, 1.0, 1, 0, 1), (1, 0.0, 35, 0.0, 3, 0.0, 1, 0, 1), (12, 0.0, 3, 0.0, 1, 0.0, 1, 0, 1),
    (3, 0.0, 3, 0.0, 3, 0.0, 1, 0, 1), (65, 0.0, 2, 1.0, 2, 0.0, 1, 0, 1), (18, 0.0, 90, 0.0, 0, 0.0, 1, 0, 1),
    (45, 0.0, 3, 1.0, 52, 0.0, 0, 0, 1), (90, 0.05, 45, 0.0, 80, 0.0, 0, 0, 1), (70, 0.1, 90, 0.0, 4, 1.0, 0, 0, 1),
    (6, 0.0, 60, 0.0, 75, 0.0, 0, 0, 1), (14, 0.0, 50, 0.0, 40, 0.0, 0, 0, 1), (7, 0.0, 2, 1.0, 66, 0.0, 0, 0, 1),
    (28, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (20, 0.0, 5, 0.0, 4, 0.0, 0, 0, 1), (2, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0),
    (3, 0.0, 2, 0.0, 1, 1.0, 0, 0, 0), (4, 0.0, 3, 0.0, 3, 0.0, 0, 0, 0), (3, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0),
    (5, 0.6, 4, 0.7, 6, 0.8, 0, 0, 0), (6, 0.2, 80, 0.0, 0, 0.0, 0, 0, 0), (9, 0.8, 60, 0.0, 12, 0.7, 0, 0, 0),
)


def grow(rows: np.ndarray, labels: np.ndarray, least: int = 1, deep: int = 8):
    """A decision tree by Gini impurity: a share of main text, or (feature, limit, tree at or under it, tree over it)."""
    share = labels.mean()
    if share in (0, 1) or len(labels) < 2 * least or deep == 0:
        return float(share)
    best = (len(labels) * share * (1 - share) - 1e-9, None)
    for k in range(rows.shape[1]):
        values = np.unique(rows[:, k])
        for limit in (values[1:] + values[:-1]) / 2:
            left = rows[:, k] <= limit
            n = left.sum()
            if least <= n <= len(labels) - least:
                p, q = labels[left].mean(), labels[~left].mean()
                impurity = n * p * (1 - p) + (len(labels) - n) * q * (1 - q)
                if impurity < best[0]:
                    best = (impurity, (k, float(limit), left))
    if best[1] is None:
        return float(share)
    k, limit, left = best[1]
    return k, limit, grow(rows[left], labels[left], least, deep - 1), grow(rows[~left], labels[~left], least, deep - 1)


def share_of(tree, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def trained(table=LABELLED):
    data = np.array(table, float)
    return grow(data[:, :-1], data[:, -1])


def main_text(page: str, tree) -> str:
    """The main blocks' texts in page order, joined by one space."""
    found = [(b, b.text()) for b in blocks_of(page)]
    found = [(b, t) for b, t in found if t]
    settle([b for b, _ in found])
    sizes = [max(1, len(t.split())) for _, t in found]
    density = [min(1.0, len(html.unescape(" ".join(b.linked)).split()) / n) for (b, _), n in zip(found, sizes)]
    out = []
    for k, (b, t) in enumerate(found):
        before = (sizes[k - 1], density[k - 1]) if k else (0, 0.0)
        after = (sizes[k + 1], density[k + 1]) if k + 1 < len(found) else (0, 0.0)
        if share_of(tree, [sizes[k], density[k], *before, *after, b.inside, b.aside > 0]) > 0.5:
            out.append(t)
    return " ".join(out)


def extract(pages: DataFrame, source: str = "html", out: str = "text", table=LABELLED) -> DataFrame:
    """pages with the main text of column `source` in `out` instead of it, and n_chars (its code points).

    A null or empty page has an empty text; nothing is dropped or cut, repeated rows stay. The tree is grown once, on the
    driver, from `table` (a small constant).
    """
    tree = trained(table)
    kept = [f for f in pages.schema.fields if f.name not in (source, out, "n_chars")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.decode(), tree) for p in utf8(b.column(source))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [f.name for f in kept] + [out, "n_chars"])

    return pages.mapInArrow(step, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{out} string, n_chars long"]))
