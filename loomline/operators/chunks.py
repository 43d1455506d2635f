"""Document chunkers: per-row functions over Arrow batches that return several chunks a document."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.work import flat_mapped


def by_characters(text: str, size: int = 1800, overlap: int = 250) -> list[str]:
    """Windows of ``size`` characters that end at a paragraph (past 55 %) or sentence (past 65 %) where they can."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            part = text[at:end]
            paragraph = part.rfind("\n\n")
            sentence = max(part.rfind(". "), part.rfind("! "), part.rfind("? "))
            if paragraph > size * 0.55:
                end = at + paragraph
            elif sentence > size * 0.65:
                end = at + sentence + 1
        if chunk := text[at:end].strip():
            out.append(chunk)
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def by_sentences(text: str, size: int = 500, overlap: int = 100) -> list[str]:
    """Whole sentences up to ``size`` characters; the next chunk begins with the last ``overlap`` characters."""
    out: list[str] = []
    held = ""
    for sentence in re.findall(r"[^.!?]+[.!?]*\s*", text):
        if held and len(held) + len(sentence) > size:
            out.append(held.strip())
            held = held[-overlap:] if overlap else ""
        held += sentence
    if held.strip():
        out.append(held.strip())
    return out


def by_words(text: str, size: int = 140, overlap: int = 30, ceiling: int = 3) -> list[str]:
    """Sentence-aware word windows; text without sentence ends is cut every ``size`` words."""
    sentences = [s.split() for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.split()]
    pieces = [s[i : i + size] for s in sentences for i in range(0, len(s), size)] if any(len(s) > ceiling * size for s in sentences) else sentences
    out: list[str] = []
    held: list[str] = []
    fresh = 0
    for piece in pieces:
        if fresh and len(held) + len(piece) > size:
            out.append(" ".join(held))
            held, fresh = held[-overlap:], 0
        held = held + piece
        fresh += len(piece)
    if fresh:
        out.append(" ".join(held))
    return out


def table_rows(text: str, least: float = 0.8) -> list[str]:
    """Rows of a delimited table inside a text as "column: value" lines; [] for prose.

    The delimiter is the comma or the tab that more rows agree on; 80 % of rows must be within one column of the
    header, and text whose fields mostly hold three words or more is prose.
    """
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 3:
        return []
    delimiter = max(",\t", key=lambda d: sum(d in x for x in lines))
    rows = [[f.strip() for f in x.split(delimiter)] for x in lines]
    columns = len(rows[0])
    if columns < 2 or sum(abs(len(r) - columns) <= 1 for r in rows) < least * len(rows):
        return []
    fields = [f for r in rows for f in r]
    if sum(len(f.split()) >= 3 for f in fields) >= 0.3 * len(fields):
        return []
    return ["; ".join(f"{h}: {v}" for h, v in zip(rows[0], r)) for r in rows[1:]]


def page_sections(text: str) -> list[str]:
    """Sections of a text with [Page N] markers and numbered headings, each led by its page and heading."""
    page, heading, held, out = 1, "", [], []

    def flush() -> None:
        if body := " ".join(held).strip():
            out.append(f"[Page {page}]" + (f" [{heading}]" if heading else "") + f" {body}")
        held.clear()

    for line in text.split("\n"):
        for part in re.split(r"(\[Page \d+\])", line):
            if m := re.fullmatch(r"\[Page (\d+)\]", part):
                flush()
                page = int(m[1])
            elif m := re.fullmatch(r"\s*(\d+(?:\.\d+)*)[.)]?\s+([A-Z][^.]{2,80})", part):
                flush()
                heading = f"Section {m[1]} {m[2].strip()}"
            elif re.search(r"\.{4,}\s*\d+\s*$", part):
                continue  # a line of a table of contents
            elif part.strip():
                held.append(part.strip())
    flush()
    return out


def chunk_documents(docs: DataFrame, cut: Callable[[str], list[str]], key: str = "doc_id") -> DataFrame:
    """(key, chunk, text, tokens): ``cut`` applied to every document's text, batch by batch."""
    chunked = lambda row: [(row[key], n, c, -(-len(c) // 4)) for n, c in enumerate(cut(row["text"] or ""))]
    return flat_mapped(docs.select(F.col(key).cast("long").alias(key), "text"), chunked, f"{key} long, chunk int, text string, tokens long")
