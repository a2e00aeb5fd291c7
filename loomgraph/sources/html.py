"""HTML sources: a tokenizer that emits block rows, and a cleaner made of replacements."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = "id, pos int, kind string, text string, offset long, anchor string, container int, classes string"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSE_P = {"p", "div", "section", "h1", "h2", "h3", "h4", "ul", "ol", "table", "article", "nav"}


class _Blocks(HTMLParser):
    """Headings, marked divisions and paragraphs in document order, each with its character offset."""

    def __init__(self, raw: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0]
        for i, c in enumerate(raw):
            if c == "\n":
                self.lines.append(i + 1)
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.containers = 0
        self.feed(raw)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        if tag in _CLOSE_P and any(x["tag"] == "p" for x in self.open):
            self.handle_endtag("p")
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        kind = None
        if tag == "h2":
            kind = "volume" if "volume-title" in classes else "h2"
        elif tag == "h3":
            kind = "title" if "chapter-title" in classes else "h3"
        elif tag == "h1":
            kind = "h1"
        elif tag == "div" and "section-head" in classes:
            kind = "section"
        elif tag == "div" and "subsection-head" in classes:
            kind = "subsection"
        elif (tag == "div" and ("chapter" in classes or "bb-item" in classes)) or (tag == "section" and "content-block" in classes):
            kind = "item" if "bb-item" in classes else "block" if tag == "section" else "chapter"
            self.containers += 1
        elif tag == "p":
            kind = "p"
        line, col = self.getpos()
        row = None
        if kind:
            row = {"pos": len(self.rows), "kind": kind, "parts": [], "offset": self.lines[line - 1] + col, "anchor": a.get("id") or "", "container": self.containers, "classes": " ".join(classes)}
            row["classes"] += "".join(f" in:{c}" for x in self.open for c in x["classes"])
            self.rows.append(row)
        self.open.append({"tag": tag, "row": row, "classes": classes})

    def handle_endtag(self, tag: str) -> None:
        if any(x["tag"] == tag for x in self.open):
            while self.open and self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if any(x["tag"] in ("script", "style") for x in self.open):
            return
        for x in self.open:
            if x["row"] is not None and x["row"]["kind"] not in ("chapter", "item", "block"):
                x["row"]["parts"].append(data)


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, kind, text, offset, anchor, container, classes) per block; text with white space collapsed. Null pages have none."""
    kind = dict(pages.dtypes)[id_col]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in it:
            rows = [(i, r["pos"], r["kind"], " ".join(" ".join(r["parts"]).split()), r["offset"], r["anchor"], r["container"], r["classes"]) for i, raw in zip(g[id_col], g[html_col]) if raw is not None for r in _Blocks(raw).rows]
            yield pd.DataFrame(rows, columns=["id", "pos", "kind", "text", "offset", "anchor", "container", "classes"])

    return pages.select(id_col, html_col).mapInPandas(run, _BLOCK.replace("id,", f"id {kind},", 1))


#: What the cleaner removes, in this order, and what it leaves instead.
RULES = [
    ("boundaries", r"(?is)</body>\s*</html>\s*<!DOCTYPE[^>]*>\s*<html\b[^>]*>\s*<head\b[^>]*>.*?</head>\s*<body\b[^>]*>", "\n"),
    ("audio", r"(?is)<audio\b[^>]*>.*?</audio>", ""),
    ("images", r"(?i)<img\b[^>]*/?>", ""),
    ("comments", r"(?s)<!--.*?-->", ""),
    ("favicons", r'(?i)<link\b[^>]*rel="shortcut icon"[^>]*>', ""),
    ("bold", r"(?i)<b>(\s*)</p>", "</b>$1</p>"),
]


def cleaned(html: Column) -> tuple[Column, dict[str, Column]]:
    """The cleaned page and the number of replacements by rule."""
    counts = {}
    for name, pattern, by in RULES:
        counts[name] = F.regexp_count(html, F.lit(pattern))
        html = F.regexp_replace(html, pattern, by)
    return html, counts
