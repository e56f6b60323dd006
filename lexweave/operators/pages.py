"""Pages: one pass over tolerant HTML, and what the work pages of an archive say about a work."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without content, and those whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style"))
#: Class of a definition to type of its tags.
TAG_TYPES = {
    "rating": "Rating", "warning": "ArchiveWarning", "category": "Category", "fandom": "Fandom", "character": "Character",
    "relationship": "Relationship", "freeform": "Freeform"
}
NUMBERS = ("words", "comments", "kudos", "bookmarks", "hits")
#: An ampersand, and the rest of a character reference that a semicolon ends.
REFERENCE = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[0-9A-Za-z]+;)?")


class PageReader(HTMLParser):
    """Fills a page's record while elements open and close.

    An element may open a region (work metadata, its statistics, a tag list, a
    chapter, a summary, hidden text) and may start texts to listen for; both end
    when it closes.  An end tag closes the nearest open element of its name and
    all within it, a stray one nothing; what is open at the end closes there.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[Callable[[], None]]]] = []
        self.within: Counter[str] = Counter()
        self.listeners: dict[int, list[str]] = {0: []}  # 0: the whole page
        self.first: dict[str, str | None] = {}
        self.counts: Counter[str] = Counter()
        self.stats: dict[str, str] = {}
        self.tags: dict[str, list[dict[str, str | None]]] = {}
        self.lists: list[str] = []  # kinds of the tag lists that are open
        self.ids: set[int] = set()
        self.chapters: list[str] = []
        self.links: list[str] = []

    # what an element starts; each returns nothing and notes what its end does
    def _region(self, name: str, ends: list[Callable[[], None]]) -> None:
        self.within[name] += 1
        ends.append(lambda: self.within.subtract([name]))

    def _listen(self, done: Callable[[str], None], ends: list[Callable[[], None]]) -> None:
        key = max(self.listeners) + 1
        self.listeners[key] = []
        ends.append(lambda: done(folded(self.listeners.pop(key))))

    def _first(self, field: str, ends: list[Callable[[], None]]) -> None:
        if field not in self.first:
            self.first[field] = None
            self._listen(lambda text: self.first.update({field: text}), ends)

    def handle_starttag(self, tag, attrs):
        about = {k: v or "" for k, v in attrs}
        kinds = about.get("class", "").split()
        has, ends = set(kinds).issuperset, []
        if tag in HIDDEN:
            self._region("hidden", ends)
        elif tag in ("title", "h1"):
            self._first(tag, ends)
        if re.fullmatch("h[1-6]", tag):
            self.counts["headings"] += 1
        if tag == "h2" and has(("title", "heading")):
            self._first("work title", ends)
        elif tag == "div":
            if has(["chapter"]) and about.get("id", "").startswith("chapter-"):
                self.chapters.append(about["id"])
                self._region("chapter", ends)
            if has(("summary", "module")):
                self._region("summary", ends)
        elif tag == "blockquote" and self.within["summary"]:
            self._first("summary", ends)
        elif tag == "dl":
            if has(("work", "meta")) and not self.counts["meta"]:
                self.counts["meta"] = 1
                self._region("meta", ends)
            elif has(["stats"]) and self.within["meta"] and not self.counts["stats"]:
                self.counts["stats"] = 1
                self._region("stats", ends)
        elif tag == "dd" and self.within["meta"]:
            self._definition(about.get("class", ""), kinds, ends)
        elif tag == "a":
            self._anchor(about, dict(attrs).get("href"), has, ends)
        if tag in VOID:
            _run(ends)
        else:
            self.open.append((tag, ends))

    def _definition(self, name: str, kinds: list[str], ends: list[Callable[[], None]]) -> None:
        if self.within["stats"]:
            self._listen(lambda text: self.stats.update({name: text}), ends)
        if "language" in kinds:
            self._first("language", ends)
        if "tags" in kinds and (kind := TAG_TYPES.get(kinds[0])):
            self.tags[kind] = []
            self.lists.append(kind)
            ends.append(self.lists.pop)

    def _anchor(self, about: dict[str, str], href: str | None, has: Callable, ends: list[Callable[[], None]]) -> None:
        self.counts["links"] += "href" in about
        if self.within["meta"]:
            if m := re.search(r"/works/(\d+)", href or ""):
                self.ids.add(int(m[1]))
            if self.lists and has(["tag"]):
                entry: dict[str, str | None] = {"name": None, "href": href}
                for kind in self.lists:
                    self.tags[kind].append(entry)
                self._listen(lambda text: entry.update(name=text), ends)
        if self.within["chapter"] and (m := re.fullmatch(r"/works/(\d+)/chapters/\d+", href or "")):
            self.links.append(href)
            self.ids.add(int(m[1]))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            _run(self.open.pop()[1])

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        while at is not None and len(self.open) > at:
            _run(self.open.pop()[1])

    def handle_data(self, data):
        if not self.within["hidden"]:
            for parts in self.listeners.values():
                parts.append(data)

    def close(self):
        super().close()
        while self.open:
            _run(self.open.pop()[1])

    def work(self) -> dict:
        if not self.counts["meta"]:
            raise ValueError("no work metadata: a login or error page?")
        if len(self.ids) > 1:
            raise ValueError("the page is about several works")
        numbers = {k: int(self.stats[k].replace(",", "")) if k in self.stats else None for k in NUMBERS}
        return {
            "work_id": min(self.ids, default=None), "title": self.first.get("work title"), "summary": self.first.get("summary"), "language": self.first.get("language"),
            "tags": self.tags, "stats": self.stats | numbers, "saved_chapter_containers": self.chapters, "chapter_urls": self.links,
        }


def folded(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def _run(ends: list[Callable[[], None]]) -> None:
    for end in ends:
        end()


def read_page(html: str) -> PageReader:
    reader = PageReader()
    reader.feed(html)
    reader.close()
    return reader


def whole_references(html: str) -> str:
    """The page with every ampersand written out that begins no character reference that a semicolon ends."""
    return REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + (m[1] or ""), html)


def work_page(html: str) -> dict:
    """What a work's page says; pages without work metadata, or of several works, are an error."""
    return read_page(html).work()


def page_metadata(pages: DataFrame, html: str = "html", cut_references: bool = True) -> DataFrame:
    """Pages with title, first heading, visible text length, links and headings, and ``work``: a work page's data as JSON, or null.

    ``cut_references``: character references without their semicolon (``&amp`` at
    the end of a title that was cut) are read as HTML parsers do; otherwise they
    are text as they stand.
    """

    @F.pandas_udf("title string, heading string, text_chars bigint, links bigint, headings bigint, work string")
    def read(s: pd.Series) -> pd.DataFrame:
        rows = []
        for h in s:
            page = read_page((h or "") if cut_references else whole_references(h or ""))
            try:
                work = json.dumps(page.work(), ensure_ascii=False)
            except ValueError:
                work = None
            rows.append((page.first.get("title"), page.first.get("h1"), len(folded(page.listeners[0])), page.counts["links"], page.counts["headings"], work))
        return pd.DataFrame(rows, columns=["title", "heading", "text_chars", "links", "headings", "work"])

    return pages.withColumn("page", read(html)).select(*pages.columns, "page.*")


def hrefs(html: str | Column) -> Column:
    """Values of all quoted href attributes, in order."""
    return F.regexp_extract_all(html, F.lit(r"""href=["']([^"']*)["']"""), 1)


def comma_number(c: str | Column) -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit(","), F.lit("")).try_cast("bigint")
