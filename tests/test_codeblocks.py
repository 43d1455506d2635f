"""Code blocks of pages: nesting, repeats, editors, limits, broken markup."""

from __future__ import annotations

from loomline.operators.codeblocks import CUT_MARK, code_blocks, pages_with_code


def test_blocks():
    assert code_blocks("<pre>a = 1\n<pre>b = 2</pre></pre>") == "a = 1\nb = 2\n\nb = 2"
    assert code_blocks("<pre><code>x();</code></pre><code>x();</code><code>y();</code>") == "x();\n\ny();"
    assert code_blocks("<code>plain words</code><code>a</code>") == "" == code_blocks("<p>x = 1</p>") == code_blocks("")
    assert code_blocks("<code>" + "w" * 41 + "</code>") == "w" * 41
    assert code_blocks("<pre> a: \t\r\n\tb&nbsp;&lt;c \r</pre>") == "a:\n\tb <c"
    assert code_blocks("<pre>cut off; <b>here") == "cut off; here"
    assert code_blocks("<pre>a;</span></div>b</pre><code/>z=1") == "a;b\n\nz=1"
    mirror = "<div class='cm-content'><div class='cm-line'>a</div><div class='cm-line'>b<i>c</i></div></div>"
    assert code_blocks(mirror + "<div class=CodeMirror-code>x = <b>1</b></div>") == "a\nbc\n\nx = 1"
    assert code_blocks("<div class=monaco-editor>no lines; here</div><div class=view-lines><p class=view-line>q;</p></div>") == ""
    assert code_blocks("<pre>" + "x;" * 5000 + "</pre>") == "x;" * 4000 + CUT_MARK


def test_pages(spark):
    pages = spark.createDataFrame([(1, "<pre>a;</pre>", "x"), (2, None, "x"), (3, "<p>none</p>", "x"), (1, "<pre>a;</pre>", "y")], "page_id long, html string, code string")
    assert sorted(map(tuple, pages_with_code(pages).collect())) == [(1, "a;"), (1, "a;")]
