"""Text of HTML elements by id, read by the page's structure: a tokenizer with a stack of open elements."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
HIDDEN = frozenset(("script", "style", "template"))


class Elements(HTMLParser):
    """Spans of text pieces by element id; the first element of an id counts.

    An end tag closes the nearest open element of its name and all that were left open in it; an
    end tag without one is passed over, and what is open at the end closes there.
    """

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.open: list[tuple[str, str | None]] = []
        self.spans: dict[str, list[int]] = {}
        self.feed(page)
        self.close()
        while self.open:
            self._shut()

    def handle_starttag(self, tag, attrs):
        name = next((v for k, v in attrs if k == "id" and v), None)
        if name in self.spans:
            name = None
        if name is not None:
            self.spans[name] = [len(self.pieces), -1]
        self.open.append((tag, name))
        if tag in VOID:
            self._shut()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML knows no empty elements but the void ones

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self._shut() != tag:
                pass

    def handle_data(self, data):
        if data.strip() and not any(t in HIDDEN for t, _ in self.open):
            self.pieces.append(data.strip())

    def _shut(self) -> str:
        tag, name = self.open.pop()
        if name is not None:
            self.spans[name][1] = len(self.pieces)
        return tag

    def text(self, name: str) -> str:
        """The element's text pieces, each without white space around it, joined; '' if there is no such element."""
        return "".join(self.pieces[slice(*self.spans[name])]) if name in self.spans else ""


def element_texts(pages: DataFrame, key: str, html: str, ids: list[str], *, required: str | None = None) -> DataFrame:
    """Rows (key, texts map<string,string>) of pages; texts is null where the page is null or has no element `required`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for page in b.column(1):
                e = Elements(page.as_py()) if page.is_valid else None
                found.append(None if e is None or (required and required not in e.spans) else [(i, e.text(i)) for i in ids])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.map_(pa.string(), pa.string()))], [key, "texts"])

    rows = pages.select(key, F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, texts map<string,string>")
