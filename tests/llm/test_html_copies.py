"""Templates where pages of a host are copies of each other."""

from __future__ import annotations

from loomline.llm import html_main


def _texts(spark, pages: list[tuple[int, str]]) -> list[tuple[int, str]]:
    rows = [(k, f"http://one.example/{k}", h) for k, h in pages]
    got = html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return sorted((r["page_id"], r["text"]) for r in got)


def test_copies_of_one_article_stay(spark):
    page = "<html><body><div>Site name</div><article><h1>Title</h1><p>The same words.</p></article></body></html>"
    assert _texts(spark, [(k, page) for k in range(8)]) == [(k, "Title\nThe same words.") for k in range(8)]


def test_doubled_rows_keep_classes_apart(spark):
    own = lambda k: f"<p>Own text {k}.</p>"
    pages = [(k, f"<html><body><div class=a></div><div class=b></div><div class=c></div>{own(k)}</body></html>") for k in range(8)]
    pages += [(k, f"<html><body>{own(k)}<p>Shared text.</p></body></html>") for k in range(8, 16)]
    assert _texts(spark, pages * 2) == sorted([(k, f"Own text {k}.") for k in range(8)] * 2 + [(k, f"Own text {k}.\nShared text.") for k in range(8, 16)] * 2)
