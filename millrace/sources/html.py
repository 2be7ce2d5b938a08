"""HTML pages to text blocks (SC6, SC7, WN12): one Arrow pass with the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is dropped, block elements, headings, and void elements.
DROPPED = frozenset(["script", "style", "nav", "header", "footer", "aside", "form", "noscript"])
BLOCKS = frozenset(["p", "li", "blockquote", "td", "th", "pre", "h1", "h2", "h3", "h4", "h5", "h6"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
ROOTS = ("main", "article", "role", "body")
SHORTEST = 20


class _Blocks(HTMLParser):
    """Blocks as (roots they are in, tag, text), in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.out: list[tuple[frozenset, str, str]] = []
        self.tag, self.parts, self.title, self.in_title = "", [], "", False

    def _roots(self) -> frozenset:
        return frozenset(r for _, r in self.open if r)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and self.tag:
            self.out.append((self._roots(), self.tag, text))
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
            self.tag = tag
        self.in_title = tag == "title"
        root = tag if tag in ("main", "article", "body") else "role" if dict(attrs).get("role") == "main" else ""
        self.open.append((tag, root))

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS:
            self._flush()
            self.tag = ""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in ("main", "article", "body"):
                    self._flush()
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif self.tag and not any(t in DROPPED for t, _ in self.open):
            self.parts.append(data)


def blocks(html: str | None) -> tuple[str, list[tuple[int, str, str]]]:
    """(title, [(paragraph, section, text)]) of the best root: main, article, role=main, body, else everything.

    section is the last heading before the block; a short line without a sentence mark counts as a heading too.
    """
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p._flush()
    root = next((r for r in ROOTS if any(r in roots for roots, _, _ in p.out)), None)
    out, section = [], ""
    for roots, tag, text in p.out:
        if root is not None and root not in roots:
            continue
        if tag in HEADINGS or (len(text) < SHORTEST and not any(m in text for m in ".!?")):
            section = text
        if len(text) >= SHORTEST:
            out.append((len(out), section, text))
    return " ".join(p.title.split()), out


SCHEMA = "page_id long, paragraph int, section string, title string, text string"


def block_table(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """SCHEMA: one row per block; pages without blocks give none (see ``audit``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, s, t, x) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t, found in [blocks(h)] for i, s, x in found]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "paragraph", "section", "title", "text"])

    return pages.selectExpr(f"cast({key} as long) as page_id", f"{html} as html").mapInArrow(run, SCHEMA)


def audit(pages: DataFrame, extracted: DataFrame, key: str = "page_id") -> DataFrame:
    """page_id, blocks, reason: pages without a block are ``empty``."""
    n = extracted.groupBy("page_id").count()
    d = pages.selectExpr(f"{key} as page_id").join(n, "page_id", "left")
    return d.selectExpr("page_id", "coalesce(count, 0) as blocks", "CASE WHEN count IS NULL THEN 'empty' END as reason")
