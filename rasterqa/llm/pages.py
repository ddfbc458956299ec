"""Main text of web pages, by what a page does not share with its nearest neighbour.

Pages are ranged by host and URL path, so that neighbours in the order come from one template.
Each page is read into lines (the text of a block), the lines of a page and of its nearest
neighbour are aligned by their longest common subsequence, and shared lines go as the frame both
have: menus, notices, footers. Lines that both pages mark as article stay, as two articles may quote
the same passage. What marks itself as frame goes without a neighbour, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterqa.llm import words

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot
    thead tr ul""".split())
GAPS = frozenset("br td th wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text, wherever they stand.
FRAME = frozenset("""aside audio button canvas dialog footer form head iframe menu nav noscript object script select style svg
    template textarea title video""".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: First or last parts of class names and ids of frame elements.
NAMES = frozenset("""ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie
    cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice pagination popup promo promotion related replies
    reply share sharing sidebar signup social sponsor sponsored subscribe widget""".split())
#: These name a page's head outside of an article, and the head of the article inside.
HEADS = frozenset("header masthead".split())
WORD = re.compile(r"[a-z0-9]+")
#: Bits of a table of the longest common subsequence; longer pages are halved first.
TABLE_BITS = 1 << 28


class Reader(HTMLParser):
    """Lines of a page that name no frame, and whether each lies in a marked article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []
        self.buffer: list[str] = []
        self.lines: list[str] = []
        self.marked: list[bool] = []

    def state(self) -> tuple[bool, bool]:
        return self.open[-1][1:] if self.open else (False, False)

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            self.lines.append(text)
            self.marked.append(self.state()[1])

    def is_frame(self, tag: str, attrs: list, inside: bool) -> bool:
        if tag in FRAME or (tag in HEADS and not inside):
            return True
        if tag in ("html", "body", "main"):
            return False
        given = {k: (v or "").lower() for k, v in attrs}
        if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role") in ROLES:
            return True
        for name in f"{given.get('class', '')} {given.get('id', '')}".split():
            parts = WORD.findall(name)
            if parts and parts[0] not in ("has", "no", "with") and any(p in NAMES or (p in HEADS and not inside) for p in (parts[0], parts[-1])):
                return True
        return False

    def close(self) -> None:
        super().close()
        self.flush()

    def drop(self, tag: str, among=None) -> None:
        """Close the innermost open ``tag`` and what is open in it, not looking past ``among``."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if among is not None and self.open[i][0] in among:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
            self.drop("p", BLOCKS - {"p"})
        elif tag in GAPS:
            self.buffer.append(" ")
        if tag not in VOID:
            frame, inside = self.state()
            frame = frame or self.is_frame(tag, attrs, inside)
            if frame and not self.state()[0]:
                self.flush()
            self.open.append((tag, frame, inside or tag in ("article", "main") or ("role", "main") in attrs))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or self.state()[0]:
            self.flush()
        if tag in GAPS:
            self.buffer.append(" ")
        self.drop(tag)

    def handle_data(self, data: str) -> None:
        if not self.state()[0]:
            self.buffer.append(data)


@dataclass
class Page:
    """A row with the lines of its page."""

    page_id: int | None
    url: str | None
    host: str
    path: str
    lines: list[str]
    marked: list[bool]


def read_page(page_id, url, host: str, path: str, html: str | None) -> Page:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return Page(page_id, url, host, path, reader.lines, reader.marked)


def rows_of_table(a: list[str], b: list[str]) -> list[int]:
    """Bit j of row i is 0 where the longest common subsequence of ``a[:i]`` and ``b[:j + 1]`` is
    longer than that of ``a[:i]`` and ``b[:j]``."""
    full = (1 << len(b)) - 1
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    rows = [full]
    for x in a:
        v = rows[-1]
        u = v & where.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    return rows


def lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and each beginning of ``b``."""
    full = (1 << len(b)) - 1
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common_lines(a: list[str], b: list[str], at: int = 0, bt: int = 0) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, in order."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(at + k, bt + k) for k in range(head)]
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    if x and y:
        if len(x) * len(y) > TABLE_BITS and len(x) > 1:
            mid = len(x) // 2
            cut = int(np.argmax(lengths(x[:mid], y) + lengths(x[mid:][::-1], y[::-1])[::-1]))
            out += common_lines(x[:mid], y[:cut], at + head, bt + head) + common_lines(x[mid:], y[cut:], at + head + mid, bt + head + cut)
        else:
            rows, found = rows_of_table(x, y), []
            i, j = len(x), len(y)
            while i and j:
                if x[i - 1] == y[j - 1]:
                    i, j = i - 1, j - 1
                    found.append((at + head + i, bt + head + j))
                elif rows[i] >> (j - 1) & 1:
                    j -= 1
                else:
                    i -= 1
            out += found[::-1]
    return out + [(at + len(a) - k, bt + len(b) - k) for k in range(tail, 0, -1)]


def nearness(a: Page, b: Page | None) -> int:
    """Characters of the path that two pages of a host have in common from its start; -1: no pair."""
    if b is None or a.host != b.host or not a.host:
        return -1
    n = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        n += 1
    return n


def shared_lines(page: Page, other: Page) -> set[int]:
    """Lines that the page has in common with the other and that not both mark as article."""
    return {i for i, j in common_lines(page.lines, other.lines) if not (page.marked[i] and other.marked[j])}


def main_lines(page: Page, before: Page | None, after: Page | None) -> tuple[list[str], int]:
    """The page's own lines, and how many shared ones went.

    The neighbour with the longer common path counts, the one before at a tie. One that would leave nothing
    is a copy of the page, so the other one counts; if that is one as well, all lines stay.
    """
    near = sorted([(-nearness(page, p), k, p) for k, p in enumerate((before, after)) if nearness(page, p) >= 0], key=lambda t: t[:2])
    gone: set[int] = set()
    for _, _, other in near:
        found = shared_lines(page, other)
        if len(found) < len(page.lines):
            gone = found
            break
    only = any(m for i, m in enumerate(page.marked) if i not in gone)
    return [t for i, t in enumerate(page.lines) if i not in gone and (page.marked[i] or not only)], len(gone)


def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of host and path; three pages are held at a time."""
    names = ["page_id", "url", "text", "n_shared"]

    def out(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done)) if done else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=names)

    def row(before: Page | None, page: Page, after: Page | None) -> tuple:
        lines, gone = main_lines(page, before, after)
        return page.page_id, page.url, "\n\n".join(lines), gone

    before = page = None
    done: list[tuple] = []
    for batch in words.slices(batches, 100):
        for values in zip(*[c.to_pylist() for c in batch.columns]):
            after = read_page(*values)
            if page is not None:
                done.append(row(before, page, after))
            before, page = page, after
        yield out(done)
        done = []
    if page is not None:
        yield out([row(before, page, None)])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_shared``: the main text of each page, its blocks joined by
    an empty line, its code points, and how many lines the page shared with its neighbour.

    Each page is held against the page of its host with the nearest path; pages are ranged by
    host and path, so a large host lies over many tasks, and the first and last page of a task
    have one neighbour. Null and empty pages have an empty text; pages without a host have no
    neighbour; copies of a page keep their lines; repeated rows give a row each; an empty
    table gives no rows; other columns are ignored.
    """
    place = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)"
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), place, 1)).alias("host"),
                        F.regexp_replace(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), place, 2), r"(/|/index\.\w+|\.html?)$", "").alias("path"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    order = ["host", "path", "url", "page_id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = ranged.mapInArrow(differences, "page_id long, url string, text string, n_shared long")
    return found.select(F.col("page_id").alias(page_id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
