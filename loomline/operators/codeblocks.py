"""Code on web pages: preformatted text, code elements and the lines of code editors, with white space kept."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.work import flat_mapped

LIMIT, CUT_MARK = 8000, "\n…(code truncated)"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_LINES = {"monaco": {"view-line"}, "mirror": {"cm-line", "CodeMirror-line"}}


class _Part:
    """An element whose text is wanted: the text, and the lines inside it if it is an editor."""

    def __init__(self, kind: str) -> None:
        self.kind, self.text, self.lines = kind, [], []


class CodeReader(HTMLParser):
    """Collects the parts of a page in the order in which they open; parts inside parts are parts of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[_Part] = []
        self._open: list[tuple[str, list[_Part], list[list[str]]]] = []  # tag, parts it is, line buffers it is

    def _is(self, kind: str) -> bool:
        return any(p.kind == kind for _, parts, _ in self._open for p in parts)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            return
        names = set((dict(attrs).get("class") or "").split())
        kinds = []
        if tag == "pre":
            kinds.append("pre")
        if tag == "code" and not self._is("pre"):
            kinds.append("code")
        if "monaco-editor" in names or "view-lines" in names and self._is("monaco"):
            kinds.append("monaco")
        if names & {"cm-content", "CodeMirror-code"}:
            kinds.append("mirror")
        mine = [_Part(k) for k in kinds]
        lines: list[list[str]] = []
        for _, parts, _ in self._open:
            for p in parts:
                if names & _LINES.get(p.kind, set()):
                    lines.append([])
                    p.lines.append(lines[-1])
        self.parts += mine
        self._open.append((tag, mine, lines))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # in HTML a slash closes nothing

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                del self._open[k:]
                return

    def handle_data(self, data: str) -> None:
        for _, parts, lines in self._open:
            for p in parts:
                p.text.append(data)
            for buffer in lines:
                buffer.append(data)


def code_blocks(html: str, limit: int = LIMIT) -> str:
    """The page's code, blocks joined by an empty line: preformatted text, code outside it, then editors.

    A block counts once, and only if it is longer than 40 characters or holds a line break or a sign that code has;
    the whole is cut at ``limit``. Pages may be cut off or badly nested.
    """
    reader = CodeReader()
    reader.feed(html)
    reader.close()
    found: dict[str, None] = {}
    for kind in ("pre", "code", "monaco", "mirror"):
        for p in (p for p in reader.parts if p.kind == kind):
            if kind == "monaco" and not p.lines:
                continue
            raw = "\n".join("".join(line) for line in p.lines) if p.lines else "".join(p.text)
            block = re.sub(r"(?m)[ \t]+$", "", re.sub(r"\r\n?", "\n", raw.replace("\xa0", " "))).strip()
            if len(block) >= 2 and (len(block) > 40 or re.search(r"[\n;{}()\[\]=:]", block)):
                found.setdefault(block)
    whole = "\n\n".join(found)
    return whole[:limit] + CUT_MARK if len(whole) > limit else whole


def pages_with_code(pages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(page_id, code) of the pages that hold any; null html holds none."""
    found = lambda row: [(row["page_id"], code)] if (code := code_blocks(row["html"], limit)) else []
    return flat_mapped(pages.where("html IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string")), found, "page_id long, code string")
