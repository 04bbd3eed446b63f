import html as entities
import re

import pytest

from keelson.llm.html import extract_html, html_text

CASES = [
    ("<p>area <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> m", "area x=2 m"),
    ("<svg><title>t</title><defs><text>no</text></defs><text>north</text><g><text>so<tspan>uth</tspan></text></g><desc>d</desc></svg>", "north\nsouth"),
    ("<div style='visibility:hidden'>a<p style='visibility: visible'>b</p>c</div>d", "b\n\nd"),
    ("<div style='visibility:hidden'>a<p>b</p></div>c", "c"), ("<div style='display:none'><p style='visibility:visible'>b</p></div>c", "c"),
    ("plain", "plain"), ("", ""), ("a  b\n c", "a b c"), ("<p>one<p>two", "one\n\ntwo"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<div>a</div><div>b</div>", "a\nb"), ("x<b>y</b> <i> z</i>", "xy z"), ("a &amp; b &lt;c&gt; &eacute;&#233;", "a & b <c> éé"),
    ("<head><title>t</title><style>s</style></head><body>b<script>var x='</p>';</script><!-- c --></body>", "b"),
    ("<title>t</title><p>x", "x"), ("<p hidden>a</p><p style='color:red; display : none'>b</p><p style='visibility:hidden'>c</p>d", "d"),
    ("<details><summary>s</summary>more</details><details open><summary>s</summary>more</details>", "s\ns\nmore"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    ("<ol><li>a<li value=5>b<li>c</ol>", "1. a\n5. b\n6. c"),
    ("<table><tr><th>k<th>value<tr><td>long key<td>1</table>", "k         value\nlong key  1"),
    ("<table><tr><td>a<br>b<td>c<tr><td colspan=2>wide wide wide<tr><td>x<td>y</table>", "a  c\nb\nwide wide wide\nx  y"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td>一二<td>x<tr><td>abcd<td>y</table>", "一二  x\nabcd  y"),
    ("<pre>\n a\n   b</pre>", " a\n   b"), ("<pre>x\n\ny</pre>", "x\n\ny"), ("a<hr>b", "a\n\nb"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"), ("<h1>h</h1>t", "h\n\nt"), ("</p>a</div></b>", "a"), ("<p>a<table><tr><td>b</table>c", "a\n\nb\n\nc"),
    ("<select><option>a<option selected>b<option>c</select>", "a\nb"), ("<img alt='pic'> t<input type=hidden value=v><input type=submit value=Go>", "pic tGo"),
    ("<a href=x>l</a><textarea>two\nlines</textarea><noscript>no</noscript>", "l\ntwo\nlines"), ("<b><p>x</b>y</p>z", "xy\n\nz"), ("<td>cell</td>", "cell"), ("<li>a<li>b", "- a\n- b"),
    ("<unknown>x</unknown>", "x"), ("a<", "a<"), ("<!DOCTYPE html><html><body>x", "x"), ("<template>t</template><dialog>d</dialog>x", "x"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_cases(page, text):
    assert html_text(page) == text


def test_deep_and_long_pages():
    assert html_text("<div>" * 50_000 + "x" + "</div>" * 10) == "x"
    assert html_text("<ul><li>" * 2000 + "x").endswith("- x")
    assert html_text("word " * 200_000) == ("word " * 200_000).strip()


def test_pages_keep_all_visible_words(spark):
    """Words of the rendered pages against a plain removal of tags and unseen elements."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.id: r.text for r in extract_html(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?is)<head>.*?</head>|<(script|style)\b.*?</\1>|<!--.*?-->", " ", r.html)
        want = entities.unescape(re.sub(r"(?s)<[^>]*>", " ", body)).split()
        have = [w for line in got[r.page_id].split("\n") for w in re.sub(r"^\s*- ", "", line).split()]
        assert "".join(have) == "".join(want), r.page_id


def test_odd_frame(spark):
    rows = [(1, None, "u", "x"), (2, "", None, "x"), (2, "", None, "x"), (None, "<p>a", "u", None), (3, "<p>" * 20_000, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    assert sorted((str(r.id), r.text) for r in extract_html(pages).collect()) == sorted([("1", ""), ("2", ""), ("2", ""), ("None", "a"), ("3", "")])
    assert extract_html(pages.limit(0)).collect() == []
