"""Nothing of an article is lost by its names or by pages being alike; what isn't article stays out."""

from __future__ import annotations

import pytest

from loomline.llm.html_main import Page, main_text

INSIDE = [
    ("<p class='search-term'>kept</p>", "kept"), ("<h1 class='banner'>kept</h1>", "kept"), ("<div class='discussion'>kept</div>", "kept"), ("<section id='related-work'>kept</section>", "kept"),
    ("<p id='comment-theory'>kept</p>", "kept"), ("<div class='social-contract'>kept</div>", "kept"), ("<p class='share'>kept</p>", "kept"), ("<div class='notice'>kept</div>", "kept"),
    ("<div class='ad-box'>gone</div>", ""), ("<div class='share buttons'>gone</div>", ""), ("<section id='comments'><p>gone</p></section>", ""), ("<aside>gone</aside>", ""), ("<div class='newsletter-form'>gone</div>", ""),
]


@pytest.mark.parametrize("part,text", INSIDE)
def test_inside_an_article(part, text):
    page = f"<body><nav>menu</nav><article><p>before</p>{part}<p>after</p></article><footer>foot</footer></body>"
    assert Page(page).text(set()).split("\n") == [x for x in ("before", text, "after") if x]


def test_alike_pages_keep_their_text(spark):
    alike = "<html><body><div><h2>Title</h2></div><div><p>All pages say this</p><p>and that</p></div></body></html>"
    shared = "<html><body><div class='menu'>menu</div><div role='main'><p>shared by all</p><p>{0} alone</p></div></body></html>"
    rows = [(i, "http://one/a", alike) for i in range(9)] + [(20 + i, "http://two/a", shared.format(i)) for i in range(9)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host long")
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    assert all(got[i] == "Title\nAll pages say this\nand that" for i in range(9))
    assert all(got[20 + i] == f"shared by all\n{i} alone" for i in range(9))
