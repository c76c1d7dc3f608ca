"""Main text of web pages by two passes over their blocks.

The page is cut into blocks (text between block-level tags). The first pass decides each by itself, from its share
of stop words, its link density and its length; where it stands (inside an element that the page names as its main
text, or outside one) moves these limits. Menus, footers and the like are out by their tag. What is only named like an
advert, a sidebar and so on, and forms, are out unless they hold the page's main element or most of its stop words: then
the name is one more limit for their blocks, for pages have wrappers of such names. Blocks that say too little, short ones and, inside, ones of few stop words, stay open. The second pass
gives an open block the label of its nearest decided neighbours of the same surroundings: theirs if both agree,
else that of the nearer one, the one before on a tie. Where its surroundings have no decided block (inside: no
good one), it is good inside, and outside if the page names no main text.

Defined cases: a null or empty page has the empty text; repeated rows get equal results; unclosed and misnested
tags end where their surroundings do; what is not closed by the end of the page is closed there. Scripts, styles and
the like end at their first closing tag, foreign elements where they do, nested ones and self-closed ones too.
A link needs an address; it ends with its element's surroundings or at the next one. Nothing is capped, and the time is
linear in the page's length.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags and words with a known part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("head title nav footer aside script style noscript template svg math iframe object button label legend select option textarea dialog menu canvas audio video map".split())
FOREIGN = frozenset(["svg", "math"])
RAW = "script|style|noscript|iframe|textarea|title"
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|ad-?(?:box|slot|unit|space|wrap|wrapper|container|area)|adv|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|sidebar|side|aside|footer|foot|cookie|cookies|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comment|comments|disqus|reply|replies|respond|widget|toolbar|pagination|pager|search|copyright|legal|disclaimer|hidden|skip)(?:$|[\s_-])",
    re.I,
)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)  # of the page, if not inside its main text
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|main|body|text|article-body|post-body)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form note".split())
STOP_WORDS = frozenset(
    (
        "a about all also an and are as at be been but by can for from had has have he her his if in into is it its more no not of on one or out she so that the their them there they this to up was we were what when which who will with would you your "
        "à au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais me même mes ne nos nous on ou où par pas pour qu que qui sa se ses son sur ta te un une vos vous "
        "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wird zu zum zur "
        "al como con cuando de del desde donde el ella ellos en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por que se si sin sobre su sus también te un una y ya"
    ).split()
)
#: Limits of the first pass: characters of a short and of a long block, shares of stop words and of link text.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.15, 0.30, 0.5

#: Parts of a page that are never its main text, however much they say.
OTHERS = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus|reply|replies|respond|related|recommended)(?:$|[\s_-])", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_RAW_END = {raw: re.compile(rf"</{raw}\s*+>", re.I) for raw in RAW.split("|")}
_ATTR = re.compile(r"([a-zA-Z-]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_WITH = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without)-\S++", re.I)  # says what else a page has, not what this is
_LETTERS = re.compile(r"[^\W\d_]+")


class _Block:
    """A run of text: its parts, how much of it is linked, whether it is left out, the element of the main text it is in (0: none), and the suspect one."""

    __slots__ = ("linked", "parts", "region", "skipped", "stop", "suspect", "words")

    def __init__(self, place: _Place) -> None:
        self.parts: list[str] = []
        self.linked = self.stop = self.words = 0
        self.skipped, self.region, self.suspect = place.skipped, place.region, place.suspect

    def count(self, text: str) -> None:
        words = _LETTERS.findall(text.lower())
        self.words, self.stop = len(words), sum(w in STOP_WORDS for w in words)


class _Suspect:
    """An element that looks like no main text: the suspect one it is in, whether it holds the page's main element, its stop words."""

    __slots__ = ("main", "never", "out", "stop", "within")

    def __init__(self, within: _Suspect | None, never: bool) -> None:
        self.within, self.never = within, never
        self.main = self.out = False
        self.stop = 0


class _Place(NamedTuple):
    """Where an open element stands: its tag, whether it is left out, its part of the main text, suspect, link and whether it is foreign."""

    tag: str = ""
    skipped: bool = False
    region: int = 0
    suspect: _Suspect | None = None
    link: int = 0
    foreign: bool = False


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, tag, attributes, closing) of the markup in order; comments and the like have no tag, raw elements end with their closing tag.

    A tag ends at the first > outside of quotes, or at the first of all if a quote stays open. These ends are found
    once for the whole page, from behind.
    """
    marks = [m.start() for m in re.finditer("[>\"']", page)]
    ends, first = [-1] * (len(marks) + 1), [-1] * (len(marks) + 1)
    behind = {'"': len(marks), "'": len(marks)}
    for k in range(len(marks) - 1, -1, -1):
        mark = page[marks[k]]
        first[k] = first[k + 1]
        if mark == ">":
            ends[k] = first[k] = marks[k]
        else:
            ends[k] = ends[behind[mark] + 1] if behind[mark] < len(marks) else -1
            behind[mark] = k
    at = page.find("<")
    while at >= 0:
        end, tag, attrs, closing = at + 1, "", "", False
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", "", False
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", "", False
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            yield at, end, "", "", False
        else:
            closing = page.startswith("/", at + 1)
            name_at = at + 1 + closing
            if page[name_at : name_at + 1].isascii() and page[name_at : name_at + 1].isalpha():
                k = bisect.bisect_left(marks, name_at)
                if first[k] < 0:
                    return
                name = _NAME.match(page, name_at, first[k])
                tag, k = name[0].lower(), bisect.bisect_left(marks, name.end())
                close = ends[k] if ends[k] >= 0 else first[k]
                attrs, end = page[name.end() : close], close + 1
                if tag in _RAW_END and not closing:
                    found = _RAW_END[tag].search(page, end)
                    end = found.end() if found else len(page)
                yield at, end, tag, attrs, closing
        at = page.find("<", end)


def _role(tag: str, attrs: str, inside: bool) -> tuple[str, bool]:
    """What an element is: "out" with all it holds, "suspect" or "never" (by its name) or nothing, and whether the page names it as its main text."""
    if tag in SKIPPED:
        return "out", False
    if tag == "header":
        return ("" if inside else "out"), False
    form = "suspect" if tag == "form" else ""
    if not attrs:
        return form, tag in ("article", "main")
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    names = _WITH.sub(" ", f"{named.get('class', '')} {named.get('id', '')}")
    hidden = "hidden" in named or named.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", ""), re.I)
    if hidden or named.get("role", "").lower() in ROLES:
        return "out", False
    main = tag in ("article", "main") or named.get("role", "").lower() in ("main", "article")
    boilerplate = BOILERPLATE.search(names) or (not inside and HEADER.search(names))
    if boilerplate and tag not in ("html", "body") and not (main and CONTENT.search(names)):
        return ("never" if OTHERS.search(names) else "suspect"), False
    return form, main or (tag in ("div", "section") and bool(CONTENT.search(names)))


def blocks(page: str) -> tuple[list[_Block], list[_Suspect]]:
    """The page's blocks in order, with what is known of where each stands, and its suspect elements, outer ones first."""
    out: list[_Block] = []
    suspects: list[_Suspect] = []
    stack = [_Place()]
    places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
    block_places: list[int] = []  # of the open block-level ones
    links = regions = open_link = 0
    block: _Block | None = None

    def add(raw: str) -> None:
        nonlocal block
        if not raw:
            return
        if block is None:
            block = _Block(stack[-1])
            out.append(block)
        value = entities.unescape(raw)
        block.parts.append(value)
        if open_link and stack[-1].link == open_link:
            block.linked += len(value.strip())

    def cut(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCK:
                block_places.pop()

    at = 0
    for start, end, tag, attrs, closing in _tokens(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag in BLOCK or tag in FOREIGN:
            block = None
        if tag in _RAW_END:
            continue
        if closing:
            if places.get(tag):
                cut(places[tag][-1])
            continue
        if tag in BLOCK and block_places and stack[block_places[-1]].tag == "p":
            cut(block_places[-1])
        here = stack[-1]
        foreign = here.foreign or tag in FOREIGN
        if tag in VOID or (foreign and _closes_itself(attrs)):
            continue
        kind, main = _role(tag, attrs, here.region > 0)
        link, region, suspect = here.link, here.region, here.suspect
        if tag == "a":
            links += 1
            open_link = links if any(m[1].lower() == "href" for m in _ATTR.finditer(attrs)) else 0
            link = open_link
        if kind in ("suspect", "never"):
            suspect = _Suspect(suspect, kind == "never")
            suspects.append(suspect)
        if main and not (here.skipped or kind):
            if tag == "main" or "main" in attrs:
                around = suspect
                while around is not None and not around.main:
                    around.main, around = True, around.within
            if not region:
                regions += 1
                region = regions
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            block_places.append(len(stack))
        stack.append(_Place(tag, here.skipped or kind == "out", region, suspect, link, foreign))
    add(page[at:])
    return out, suspects


def _closes_itself(attrs: str) -> bool:
    """Whether a tag ends with a / of its own, not with one of a value without quotes."""
    return attrs.endswith("/") and (len(attrs) == 1 or attrs[-2] in "\"'" or attrs[-2].isspace() or "=" not in attrs)


def _judge(found: list[tuple[str, _Block]], suspects: list[_Suspect]) -> None:
    """Leaves out the blocks of suspect elements that hold neither the page's main element nor most of its stop words."""
    said = [b for t, b in found if not b.skipped and len(t) >= SHORT]  # a few words in a short block tell nothing
    total = sum(b.stop for b in said)
    for b in said:
        if b.suspect is not None:
            b.suspect.stop += b.stop
    for s in reversed(suspects):
        if s.within is not None:
            s.within.stop += s.stop
    for s in suspects:
        s.out = (s.within is not None and s.within.out) or not (s.main or (not s.never and 2 * s.stop > total))
    for _, b in found:
        b.skipped = b.skipped or (b.suspect is not None and b.suspect.out)


def _first(text: str, block: _Block, named: bool) -> bool | None:
    """Good, bad or (None) open, from the block alone. named: the page names its main text."""
    linked = block.linked / max(len(text), 1)
    if block.skipped or linked > LINKS:
        return False
    if len(text) < SHORT:
        return None
    stop = block.stop / max(block.words, 1)
    long = len(text) >= LONG
    if block.region:
        return True if stop >= STOP_HIGH or (long and stop >= STOP_LOW) else None
    if named:
        return stop >= STOP_HIGH and long and linked == 0
    if block.suspect is not None:
        return True if stop >= STOP_HIGH else None
    return True if stop >= STOP_HIGH or (long and stop >= STOP_LOW) else None if stop >= STOP_LOW else long and linked == 0


def labels(found: list[tuple[str, _Block]]) -> list[tuple[bool, bool]]:
    """For each block (its text, itself): whether it is good, and whether the first pass had left it open."""
    named = any(b.region and not b.skipped for _, b in found)
    first = [_first(t, b, named) for t, b in found]
    surroundings = [-1 if b.skipped else b.region for _, b in found]
    decided: dict[int, list[int]] = {}
    for i, label in enumerate(first):
        if label is not None and surroundings[i] >= 0:
            decided.setdefault(surroundings[i], []).append(i)
    with_good = {place for place, label in zip(surroundings, first, strict=True) if label}
    out = []
    for i, label in enumerate(first):
        if label is not None:
            out.append((label, False))
            continue
        near = decided.get(surroundings[i], [])
        if surroundings[i] > 0 and surroundings[i] not in with_good:
            near = []  # link lists alone say nothing against an article's short lines
        at = bisect.bisect(near, i)
        before, behind = (near[at - 1] if at else None), (near[at] if at < len(near) else None)
        if before is None and behind is None:
            good = surroundings[i] > 0 or not named
        elif before is None or behind is None:
            good = first[behind if before is None else before]
        else:
            good = first[before] if i - before <= behind - i else first[behind]
        out.append((bool(good), True))
    return out


def main_text(page: str) -> tuple[str, int, int]:
    """The good blocks' texts, white space run together, joined by one space; the number of blocks, and of those left open at first."""
    all_, suspects = blocks(page)
    found = [(" ".join("".join(b.parts).split()), b) for b in all_]
    found = [(t, b) for t, b in found if t]
    for t, b in found:
        b.count(t)
    _judge(found, suspects)
    told = labels(found)
    return " ".join(t for (t, _), (good, _) in zip(found, told, strict=True) if good), len(found), sum(open_ for _, open_ in told)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_blocks, n_open (blocks that the first pass left to the second)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [main_text(x.as_py() or "") for x in b.column(2)]
            numbers = [pa.array(c, pa.int64()) for c in ([len(t) for t, _, _ in found], [n for _, n, _ in found], [n for _, _, n in found])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _, _ in found], pa.string()), *numbers], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_open"])

    chosen = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(batches, f"page_id {chosen.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_blocks long, n_open long")
