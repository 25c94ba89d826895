"""Main text of web pages from parser events and the text-to-tag ratio of lines.

The standard library's event parser streams over the page. Every block boundary ends a line; a line
has its text, the tags seen on it and the container that holds it. A line's ratio is its characters
outside links over its tags; the ratios are smoothed with a Gaussian and split into two clusters by a
threshold (Otsu's: the cut with the largest variance between its sides, or the mean if that is lower).
Core lines reach half the threshold, so they stand with others of the upper cluster, and the geometric
mean of all ratios by themselves.

Clusters choose, names are evidence. What a tag, role, class or id plainly names as no part of the
article (menus, footers, side bars, notices, adverts, comments: the fixed lists below) is left out;
names that may as well stand in an article (form, header, discussion, related, share), and containers
so named that hold the main heading, are left out only if their ratios stay below half the threshold.
The region is all outermost article and main elements with a core line, if they hold half of the core
text; else the innermost container of all core lines, without its first and last parts that have
neither a core line nor a heading and whose ratios stay below half the threshold, or that are mostly
links. All other lines of the region
are the text, so short paragraphs of an article stay.

Defined results: null html is empty; a page without text gives the empty text; an unclosed element
ends with its parent, and the head where the body's content begins; an unknown declaration is a
comment; repeated rows and null ids are rows like others; extra columns are ignored. Time and memory
are linear in the page, however deep it is nested.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pagelens.llm.common import id_slice, whole_id

SIGMA, FEED = 1.0, 1 << 16

#: Fixed lists of tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
LEFT_OUT = frozenset(
    "script style noscript template nav footer aside button select textarea label legend iframe object svg canvas head title menu dialog audio video map".split()
)
HEAD = frozenset("html head meta title link base script style noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements of text, never a page's content region by themselves.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot pre blockquote figure figcaption address hr".split())
LISTS = frozenset("ul ol dl table".split())
#: Fixed words of class and id that name what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promoted cookie cookies consent gdpr "
    "notice notices notification notifications popup modal overlay newsletter subscribe subscription signup sidebar sidebars rail menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer foot masthead topbar comment comments commentlist disqus respond recommended recommendations pagination pager skip".split()
)
#: Fixed words that may name a part of an article as well.
DOUBTFUL = frozenset("header head banner alert discussion reply replies related share sharing social widget toolbar login search dialog form tags tag taglist aside asides promotion".split())
#: Fixed words of a name that tells of something else than the element itself.
ABOUT = frozenset("has with no without is show hide toggle".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar".split())
SURE, MAYBE = 2, 1
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Za-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")


def _noise(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """SURE, MAYBE or 0, by attributes."""
    found = 0
    for key, value in attrs:
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and re.search(r"display\s*:\s*none", value)):
            return SURE
        if key == "role" and value and value.strip().lower() in ROLES:
            return SURE
        if tag in ("html", "body", "main") or tag in HEADINGS or not value:
            continue
        if key == "class" or (key == "id" and tag not in TEXTUAL):
            for name in value.split():
                words = {w.lower() for w in _WORD.findall(_HUMP.sub(r"\1 \2", name))}
                if not words & ABOUT:
                    found = max(found, SURE if words & NOISE else MAYBE if words & DOUBTFUL and tag != "article" else 0)
    return found


class _Lines(HTMLParser):
    """lines: text, characters outside links, tags, container, innermost named noise (or -1), whether
    it is a heading. Containers and noises are numbered, each with its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, left out, is a container, is a noise
        self.count: Counter[str] = Counter()
        self.out = self.links = self.tags = self.plain = self.heads = 0
        self.text: list[str] = []
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        self.parent, self.inside, self.named, self.listed = [-1], [0], [False], [False]  # containers; 0 is the page
        self.noises: list[list[int]] = []  # parent, grade
        self.around: list[int] = []

    def _end_line(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append((text, self.plain, self.tags, self.inside[-1], self.around[-1] if self.around else -1, self.heads > 0))
            self.text, self.plain, self.tags = [], 0, 0

    def _pop(self, at: int) -> None:
        if any(t not in INLINE for t, *_ in self.open[at:]):
            self._end_line()
        for tag, left, holds, noise in self.open[at:]:
            self.out -= left
            self.links -= tag == "a"
            self.heads -= tag in HEADINGS
            self.count[tag] -= 1
            if holds:
                self.inside.pop()
            if noise:
                self.around.pop()
        del self.open[at:]

    def _last(self, tag: str) -> int:
        return next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.count["head"] and tag not in HEAD:
            self._pop(self._last("head"))
        if tag not in INLINE:
            self._end_line()
        self.tags += 1
        if tag in VOID:
            return
        last = self.open[-1][0] if self.open else ""
        if tag in ENDS_P and any(t == "p" for t, *_ in self.open[-6:]):
            self._pop(self._last("p"))
        elif last in SELF_ENDING.get(tag, ()):
            self._pop(len(self.open) - 1)
        role = next((v.strip().lower() for k, v in attrs if k == "role" and v), "")
        main = tag == "main" or role == "main"
        within = self.count["article"] or self.count["main"]
        grade = MAYBE if tag == "form" else SURE if tag == "header" and not within else 0
        grade = 0 if main else max(grade, _noise(tag, attrs))
        left = tag in LEFT_OUT or (grade == SURE and tag in INLINE)
        noise = bool(grade) and not left and tag not in INLINE
        if main or tag == "h1":
            for i in self.around:  # what holds the main heading is no mere side piece
                self.noises[i][1] = MAYBE
        if noise:
            self.noises.append([self.around[-1] if self.around else -1, grade])
            self.around.append(len(self.noises) - 1)
        holds = tag not in INLINE and tag not in TEXTUAL
        if holds:
            self.parent.append(self.inside[-1])
            self.named.append((main or tag == "article" or role == "article") and grade != SURE)
            self.listed.append(tag in LISTS)
            self.inside.append(len(self.parent) - 1)
        self.open.append((tag, left, holds, noise))
        self.count[tag] += 1
        self.out += left
        self.links += tag == "a"
        self.heads += tag in HEADINGS

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.count[tag]:
            return
        if tag in INLINE:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    return self._pop(i)
                if self.open[i][0] not in INLINE:
                    return None
        self._pop(self._last(tag))

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.text.append(data)
            self.plain += 0 if self.links else len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """An unknown `<![...` is a comment up to the next `>`, as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else -1

    def close(self) -> None:
        super().close()
        self._end_line()


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel, "full")[reach : reach + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel, "full")[reach : reach + len(ratio)]


def threshold(values: np.ndarray) -> float:
    """The value from which the upper cluster starts."""
    v = np.sort(values)
    n = np.arange(1, len(v))
    low = np.cumsum(v)[:-1]
    between = (low / n - (v.sum() - low) / (len(v) - n)) ** 2 * n * (len(v) - n)
    return float(v[int(np.argmax(between)) + 1]) if len(v) > 1 and v[0] < v[-1] else float(v[0])


def ratios(lines: list[tuple]) -> np.ndarray:
    """Characters outside links over tags of each line."""
    return np.array([line[1] / max(1, line[2]) for line in lines])


def _clusters(lines: list[tuple], sigma: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Smoothed ratios, the threshold between their clusters, and which lines are core."""
    own = ratios(lines)
    ratio = smoothed(own, sigma)
    cut = min(threshold(ratio), float(ratio.mean()))  # of a long tail Otsu's cut alone takes too little
    clear = np.log1p(own) >= np.log1p(own).mean()  # text by itself, however long the longest line is
    core = clear & (ratio >= 0.5 * cut)
    return ratio, cut, core if core.any() else clear


def _without_noise(page: _Lines, sigma: float) -> list[tuple]:
    """The lines outside sure noise, and outside doubtful noise whose text is in the lower cluster."""
    out = np.zeros(len(page.noises) + 1, bool)  # the last stands for none
    for i, (up, grade) in enumerate(page.noises):
        out[i] = grade == SURE or out[up]
    lines = [line for line in page.lines if not out[line[4]]]
    if lines and any(line[4] >= 0 for line in lines):
        ratio, cut, _ = _clusters(lines, sigma)
        mass, size = np.zeros(len(out)), np.zeros(len(out))
        for line, r in zip(lines, ratio):
            mass[line[4]] += r * len(line[0])
            size[line[4]] += len(line[0])
        for i in range(len(page.noises) - 1, -1, -1):
            up = page.noises[i][0]
            if up >= 0:
                mass[up] += mass[i]
                size[up] += size[i]
        for i, (up, grade) in enumerate(page.noises):
            out[i] = out[up] or grade == SURE or mass[i] < 0.5 * cut * size[i]
        lines = [line for line in lines if not out[line[4]]]
    return lines


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    page = _Lines()
    for at in range(0, len(html or ""), FEED):
        page.feed(html[at : at + FEED])
    page.close()
    lines = _without_noise(page, sigma)
    if not lines:
        return ""
    ratio, cut, core = _clusters(lines, sigma)
    n = len(page.parent)
    outermost = np.zeros(n, int)  # the outermost article or main around each container, 0 if none
    for i in range(1, n):
        outermost[i] = outermost[page.parent[i]] or (i if page.named[i] else 0)
    home = np.array([line[3] for line in lines])
    size = np.array([len(line[0]) for line in lines])
    named = outermost[home]
    if 2 * size[core & (named > 0)].sum() >= size[core].sum():
        keep = np.isin(named, np.unique(named[core & (named > 0)]))
        return " ".join(line[0] for line, k in zip(lines, keep) if k)
    # lines, core lines, headings, summed ratios, characters and those outside links of each container's whole content
    held = np.stack([np.bincount(home, w, n) for w in (np.ones(len(lines)), core, [line[5] for line in lines], ratio, size, [line[1] for line in lines])], 1)
    for i in range(n - 1, 0, -1):
        held[page.parent[i]] += held[i]
    region = home[core][0]
    while held[region, 1] < core.sum() or page.listed[region]:
        region = page.parent[region]
    part = np.full(n, -1)  # the child of the region in which each container lies; the region is its own
    part[region] = region
    for i in range(region + 1, n):
        part[i] = -1 if part[page.parent[i]] < 0 else i if page.parent[i] == region else part[page.parent[i]]
    mine = part[home]
    low = (held[:, 3] < 0.5 * cut * held[:, 0]) | (held[:, 5] < 0.2 * held[:, 4])
    weak = (mine != region) & (mine >= 0) & (held[mine, 1] == 0) & (held[mine, 2] == 0) & low[mine]
    strong = np.flatnonzero((mine >= 0) & ~weak)
    keep = (mine >= 0) & (np.arange(len(lines)) >= strong[0]) & (np.arange(len(lines)) <= strong[-1])
    return " ".join(line[0] for line, k in zip(lines, keep) if k)


def extract_text(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                text = [main_text(h if isinstance(h, str) else None, sigma) for h in part["html"]]
                yield pd.DataFrame({"page_id": id_slice(pdf, "page_id", at, at + 256), "url": part["url"].to_numpy(), "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(*whole_id("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
