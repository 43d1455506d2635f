"""Valid classes are ordered and nested, and tokens are told apart by their place in classes."""

from __future__ import annotations

from loomline.llm import html_main
from loomline.llm.html_main import Member, nesting, out_of_order


def _texts(spark, pages: list[str]) -> list[str]:
    rows = [(k, f"http://one.example/{k}", h) for k, h in enumerate(pages)]
    got = html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_texts_that_change_places_are_no_template(spark):
    two = ("<p>Alpha</p>", "<p>Beta</p>")
    page = lambda k: f"<body><h1>Site</h1><div class=a></div><div class=b></div>{two[k % 2]}{two[1 - k % 2]}<i></i><p>Own {k}</p></body>"
    want = [f"{'Alpha Beta'.split()[k % 2]}\n{'Alpha Beta'.split()[1 - k % 2]}\nOwn {k}" for k in range(10)]
    assert _texts(spark, [page(k) for k in range(10)]) == want


def test_equal_tokens_are_told_apart_by_their_place(spark):
    page = "<body><h1>Site</h1><p>More</p><div class=a></div>{0}<div class=b></div><p>More</p></body>"
    pages = [page.format("".join(f"<p>Own {k} {n}</p>" for n in range(k % 3 + 1))) for k in range(10)]
    assert _texts(spark, pages) == ["\n".join(f"Own {k} {n}" for n in range(k % 3 + 1)) for k in range(10)]


def test_a_class_in_changing_gaps_is_no_class(spark):
    part = "<ul><li class=x></li><li class=y></li><li>Note</li></ul>"
    page = lambda k: f"<body><h1>Site</h1><div class=a></div>{part if k % 3 == 1 else ''}<div class=b></div>{part if k % 3 == 2 else ''}<p>Own {k}</p></body>"
    got = _texts(spark, [page(k) for k in range(12)])  # four pages have the part in one gap, four in another
    assert got == [f"Own {k}" if k % 3 == 0 else f"Note\nOwn {k}" for k in range(12)]


def test_order_and_overlap_by_themselves():
    assert out_of_order([0, 1, 2, 3, 4, 5], 3) == set()
    assert out_of_order([3, 0, 1, 2], 4) == {3}
    assert out_of_order([1, 0, 2], 3) == {0, 1}
    member = lambda cls, at: Member(cls, at, 1, cls, (cls,))
    new = {10: member(1, 0), 11: member(1, 1), 20: member(2, 0), 21: member(2, 1)}
    inside = nesting([10, 20, 21, 11], [None] * 4, new)
    assert inside[1] == set() and inside[0][2] != inside[0][1] == {0}
    assert nesting([10, 20, 11, 21], [None] * 4, new)[1] == {1}
    assert nesting([10, 20, 11, 21], [new[10], None, new[11], None], new)[1] == {2}
    assert nesting([10, 20, 21, 20, 21, 11], [None] * 6, new)[2] == {2}
