"""Main text of web pages from standard-library parser events.

The parser's events become lines: the text of a block with the number of tags met in it. The ratio
of text to tags of each line is smoothed with a Gaussian kernel and split in two clusters by a
threshold. The lines above it are seeds, and they choose the region: the article and main elements that hold
seeds, nested ones as part of the outermost, if most of the seeds' text is in such elements; otherwise
the smallest element with most of it. An article without seeds beside one with them, under the same
parent, belongs to it. But for the one with most seeds, none is taken that is mostly links, as teasers are. All lines of the region are kept but
those in elements that are something else by name: menus, headers, footers, sidebars, notices,
adverts, forms, comments. Short lines inside the region stay.

Character references are decoded, white space inside a block becomes one space, blocks are joined by
a line feed in page order. Null and empty pages, and pages without text, give an empty text.
Unclosed, crossing and unknown tags are tolerated. Every page is judged alone, so repeated rows get
equal texts; pages of any length and depth are read whole, in time that grows with their length. Extra
columns are not looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import map_rows, text_of

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu "
    "nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_PARAGRAPH = BLOCKS - {"br", "button", "option"}
SILENT = frozenset("script style noscript template title head textarea svg math iframe object canvas".split())
ASIDE = frozenset("nav footer aside form menu dialog button select search".split())
REGIONS = frozenset(("article", "main"))
HOLDERS = frozenset("html body div main article section center table td".split())
# Words in class, id and role that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert advertisement advertisements advertising banner breadcrumb breadcrumbs comment "
    "comments complementary contentinfo cookie cookies consent dialog disqus disclaimer footer footnav "
    "form gdpr masthead menu modal nav navbar navigation newsletter notice notices notification paywall "
    "popup promo promoted promotion related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Words that say what an element goes with, not what it is: "has-sidebar".
ABOUT = frozenset(("has", "with", "without", "no"))
#: Lines on either side that the smoothing looks at, and the width of its bell.
REACH, SIGMA = 2, 1.0


class Line:
    """A block's text: its tags, how much of it is in links, its innermost holder and outermost region."""

    __slots__ = ("text", "tags", "linked", "holder", "region")

    def __init__(self, text: str, tags: int, linked: int, holder: int, region: int):
        self.text, self.tags, self.linked, self.holder, self.region = text, tags, linked, holder, region


class Events(HTMLParser):
    """Turns parser events into lines; ``stack`` has (name, number, is something else) of open elements.

    ``parents`` has the holder around each holder and region, by numbers; an inner one has a greater number.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []
        self.open: Counter[str] = Counter()
        self.holders, self.regions = [0], []
        self.parents: dict[int, int] = {}
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.number = self.linked = 0
        self.silent = self.other = 0

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and not self.other:
            region = self.regions[0] if self.regions else -1
            self.lines.append(Line(text, self.tags, self.linked, self.holders[-1], region))
        if text or self.parts:
            self.tags = 0
        self.linked = 0
        self.parts.clear()

    def is_other(self, name: str, attributes: list[tuple[str, str | None]]) -> bool:
        if name in ASIDE:
            return True
        if name == "header":
            return not self.regions
        if name in REGIONS or name in ("html", "body"):
            return False
        said = " ".join(value for key, value in attributes if key in ("class", "id", "role") and value)
        for token in said.split():
            words = {word.lower() for word in re.findall("[A-Z]?[a-z]+|[A-Z]+", token)}
            if words & MARKS and not words & ABOUT or "header" in words and not self.regions:
                return True
        return False

    def pop(self) -> None:
        name, number, other = self.stack.pop()
        self.open[name] -= 1
        self.other -= other
        self.silent -= name in SILENT
        if name in HOLDERS:
            self.holders.pop()
        if name in REGIONS:
            self.regions.pop()

    def close(self) -> None:
        super().close()
        self.cut()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.cut()
            if tag in CLOSES_PARAGRAPH:
                self.imply_end("p")
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                self.imply_end(tag)
        self.tags += 1
        if tag not in VOID:
            other = self.is_other(tag, attrs)
            self.number += 1
            self.stack.append((tag, self.number, other))
            self.open[tag] += 1
            self.other += other
            self.silent += tag in SILENT
            if tag in HOLDERS:
                self.parents[self.number] = self.holders[-1]
                self.holders.append(self.number)
            if tag in REGIONS:
                self.regions.append(self.number)

    def imply_end(self, tag: str) -> None:
        """Closes an open ``tag`` unless another block holds it open."""
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if name in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())


BELL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(REACH + 1)]


def smoothed(ratios: list[float]) -> list[float]:
    out = []
    for k in range(len(ratios)):
        near = range(max(0, k - REACH), min(len(ratios), k + REACH + 1))
        weights = [BELL[abs(j - k)] for j in near]
        out.append(sum(w * ratios[j] for w, j in zip(weights, near, strict=True)) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """The border between two clusters: moved to the middle of their means until it rests."""
    border = sum(values) / len(values)
    for _ in range(20):
        low = [v for v in values if v < border]
        high = [v for v in values if v >= border]
        if not low or not high:
            break
        moved = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(moved - border) < 1e-9:
            break
        border = moved
    return border


def seeds_of(lines: list[Line]) -> list[Line]:
    """The lines in the cluster of high ratios."""
    ratios = smoothed([len(line.text) / max(1, line.tags) for line in lines])
    border = threshold(ratios)
    return [line for line, ratio in zip(lines, ratios, strict=True) if ratio >= border] or lines


def chosen_regions(lines: list[Line], seeds: list[Line], parents: dict[int, int]) -> set[int]:
    """The regions that are content, none if most of the seeds' text lies elsewhere."""
    held: Counter[int] = Counter()
    for line in seeds:
        held[line.region] += len(line.text)
    if 2 * held[-1] > sum(held.values()):
        return set()
    del held[-1]
    most = max(held, key=lambda region: held[region])
    text: Counter[int] = Counter()
    linked: Counter[int] = Counter()
    for line in lines:
        text[line.region] += len(line.text)
        linked[line.region] += line.linked
    beside = {parents[region] for region in held}
    said = {r for r in text if r >= 0 and 2 * linked[r] < text[r]}
    return {most} | {r for r in said if r in held or parents[r] in beside}


def deepest_holder(seeds: list[Line], parents: dict[int, int]) -> int:
    """The smallest element with most of the seeds' text; 0, the page, has all of it."""
    weight: Counter[int] = Counter()
    for line in seeds:
        weight[line.holder] += len(line.text)
    enough = 0.8 * sum(weight.values())
    for element in sorted(parents, reverse=True):  # inner ones first
        weight[parents[element]] += weight[element]
    return max((element for element in weight if weight[element] >= enough), default=0)


def content(lines: list[Line], parents: dict[int, int]) -> list[str]:
    """The texts of the region that the lines of high ratio lie in."""
    if not lines:
        return []
    seeds = seeds_of(lines)
    regions = chosen_regions(lines, seeds, parents)
    if regions:
        return [line.text for line in lines if line.region in regions]
    holder = deepest_holder(seeds, parents)
    inside = {holder}
    for element in sorted(parents):  # outer ones first
        if parents[element] in inside:
            inside.add(element)
    return [line.text for line in lines if line.holder in inside]


def main_text(page: str) -> str:
    events = Events()
    events.feed(page)
    events.close()
    return "\n".join(content(events.lines, events.parents))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def rows(ids: list, urls: list, bodies: list[str]) -> list[list]:
        texts = [main_text(body) if body else "" for body in bodies]
        return [ids, urls, texts, [len(text) for text in texts]]

    kinds = ", ".join(f"{name} {pages.schema[name].dataType.simpleString()}" for name in ("page_id", "url"))
    columns = [F.col("page_id"), F.col("url"), text_of("html")]
    return map_rows(pages, columns, f"{kinds}, text string, n_chars long", rows)
