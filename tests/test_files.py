"""Documents in containers and encodings: what is read, and what is refused and why."""

from __future__ import annotations

import io
import zipfile

from loomline.sources import files


def _docx(body: str, name: str = "word/document.xml") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        box.writestr(name, body)
    return out.getvalue()


def test_documents_from_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell &amp; more</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:p><w:r><w:t>la</w:t><w:br/><w:t>st</w:t></w:r></w:p></w:body></w:document>"
    bomb = _docx(f"<w:document {w}>" + " " * (files.MOST_BYTES + 10) + "</w:document>")
    assert len(bomb) < 100_000
    made = {
        "a.DOCX": _docx(body), "long.docx": files.docx_bytes("é 漢\n<b>\r\x0bz"), "empty.docx": files.docx_bytes(""), "cut.docx": _docx(body)[:-30], "other.docx": _docx(body, "word/other.xml"), "bad.docx": _docx("<w:document"), "text.docx": b"plain text",
        "entity.docx": _docx('<!DOCTYPE x [<!ENTITY a "b">]>' + body), "bomb.docx": bomb, "le.txt": b"\xff\xfe" + "h\u00e9\U0001f642".encode("utf-16-le"), "be.md": b"\xfe\xff" + "h\u00e9".encode("utf-16-be"), "mark.txt": b"\xef\xbb\xbfx", "zero.txt": b"a\x00b", "p.pdf": b"%PDF-1.7", "none": b"text",
    }
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["refused"]) for r in files.read_documents(spark, f"file://{tmp_path}").collect()}
    assert got == {
        "a.DOCX": ("One\ttwo\ncell & more\n\nla\nst", None), "long.docx": ("é 漢\n<b>\r\ufffdz", None), "empty.docx": ("", None), "cut.docx": (None, "broken"), "other.docx": (None, "broken"), "bad.docx": (None, "broken"), "text.docx": (None, "broken"),
        "entity.docx": (None, "broken"), "bomb.docx": (None, "broken"), "le.txt": ("h\u00e9\U0001f642", None), "be.md": ("h\u00e9", None), "mark.txt": ("x", None), "zero.txt": (None, "binary"), "p.pdf": (None, "extension"), "none": (None, "extension"),
    }
