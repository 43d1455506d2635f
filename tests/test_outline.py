"""The document map against a plain reading of the lines."""

from __future__ import annotations

import re

from loomline.operators import outline

TEXT = "intro\n[Page 2]\n1 First Things\nbody one\n1.1 Part A\na\tb\tc\nd | e\n[Page 3]\nmore\n1.1.1) Deep\n2. Second\nIntro ....... 4\n\n1.1 Part B\n1.1.2 Under B\nx.y no 3.1 Heading\n9.9 Orphan"


def _plain(text):
    out, page, at, section = [], 1, 0, {"num": None, "title": None, "start": 0, "pages": [], "end": 0, "rows": 0, "contents": 0, "text": 0}
    found = [section]
    for line in text.split("\n"):
        kind = "text" if line.strip() else "empty"
        if m := re.match(outline.PAGE, line):
            kind, page = "page", int(m[1])
        elif re.search(outline.CONTENTS, line):
            kind = "contents"
        elif m := re.match(outline.HEADING, line):
            kind = "heading"
            section = {"num": m[1], "title": m[2].strip(), "start": at, "pages": [], "end": 0, "rows": 0, "contents": 0, "text": 0}
            found.append(section)
        elif re.match(outline.ROW, line):
            kind = "row"
        section["end"] = at + len(line)
        section["pages"] += [page] * (kind != "page")
        for k, name in (("row", "rows"), ("contents", "contents"), ("text", "text")):
            section[name] += kind == k
        at += len(line) + 1
    for n, s in enumerate(found):
        above = s["num"].rpartition(".")[0] if s["num"] else ""
        parent = max((k for k in range(n) if above and found[k]["num"] == above), default=None)
        if n or s["pages"] or s["end"]:
            out.append((n, s["num"], s["title"], s["num"] and s["num"].count(".") + 1, parent, min(s["pages"], default=None), max(s["pages"], default=None), s["start"], s["end"], s["rows"], s["contents"], s["text"]))
    return out


def test_document_map(spark):
    texts = {1: TEXT, 2: "plain text", 3: "3 Only Heading", 4: "[Page 7]", 5: "1 Heading one\n1 Heading two\n1.1 Child of the second"}
    docs = spark.createDataFrame([*texts.items(), (6, None)], "doc_id long, text string")
    got = {}
    for r in outline.document_map(docs).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert got == {k: _plain(t) for k, t in texts.items()}
    assert [r[4] for r in got[1]] == [None, None, 1, 2, None, 1, 5, None]
