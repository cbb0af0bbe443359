import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import html_text as H


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<p>b <b>c</b>  d", "a\n\nb c d"),
        ("<div>a</div><div>b</div>c<br>d<br><br>e", "a\nb\nc\nd\ne"),
        ("<ul><li>one<ul><li>in<li>in2</ul><li>two</ul>x", "- one\n  - in\n  - in2\n- two\n\nx"),
        ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>1<tr><td>fig<td>22</table>", "Name      | Qty\napple pie | 1\nfig       | 22"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<table><tr><td>a<br>b<td>c</table>", "a | c\nb"),
        ("<table><tr><td>only<tr><td>rows</table>", "only\nrows"),
        ("<pre>\n a\n   b</pre>", " a\n   b"),
        ("a &lt; b &amp; c &nbsp;d", "a < b & c \xa0d"),
        ("<head><title>t</title></head><body>x<script>if(a<b){'</p>'}</script>y<style>p{}</style><!-- c -->z", "xyz"),
        ("<style>.x{display:none} #y , b.z {visibility:hidden}</style><i class='w x'>1</i><i id=y>2</i><b class=z>3</b><i class=z>4</i>", "4"),
        ("<p hidden>1<p style='color:red; display : none'>2<p style='display:block'>3", "3"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details><dialog>d</dialog>", "s\nt\nyes"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("a < b <c", "a < b"),
        ("<table><caption>cap</caption><tr><td>1<td>2</table>", "cap\n1 | 2"),
        ("<p>日本</p><table><tr><td>日本<td>x<tr><td>abcd<td>y</table>", "日本\n\n日本 | x\nabcd | y"),
        ("<style>@media print{.x{display:none}}</style><b class=x>1</b>", "1"),
        ("<style>@media (max-width:600px){.x{display:none}} @media screen and (min-width: 40em){.y{display:none}} .z{display:none}</style><b class=x>1</b><b class=y>2</b><b class=z>3</b>", "1"),
        ("<style media=print>p{display:none}</style><style>@import url(x); @font-face{src:none} @supports (a:b){i{display:none}}</style><p>1<i>2</i></p>", "1"),
        ("<style>.x{display:none}.x{display:block}</style><b class=x>1</b>", "1"),
        ("<style>#a{display:none} .x{display:inline} b{display:none!important}</style><i id=a class=x>1</i><b style='display:block'>2</b><u class=x>3</u>", "3"),
        ("<style>.x{display:none}</style><b class=x style='display:inline'>1</b>", "1"),
        ("<style>[hidden]{} p.v{display:block}</style><p class=v hidden>1</p><p hidden>2</p>", "1"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c<ul><li>d<li style='visibility:visible'>e</ul></div>f", "b\n\n- e\n\nf"),
        ("<table><tr style='visibility:hidden'><td>a<td style='visibility:visible'>b<tr><td>c<td>d</table>", "  | b\nc | d"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>.", "so x=2."),
        ("a<svg><title>t</title><desc>d</desc>stray<g><text>shown <tspan>too</tspan></text></g><defs><text>no</text></defs></svg>b", "a shown too b"),
        ("<input type=email value=a><input type=number value=7><input type=search value=s><input type=url value=u><input type=tel value=5><input type=password value=p><input type=checkbox value=c>", "a 7 s u 5"),
        ("<table><tr><td>a|<td>b|<tr><td>c<td> </table>", "a| | b|\nc"),
        ("<ol><li value=5>a<li>b<li value=2>c</ol><ol reversed><li>x<li>y<li>z</ol><ol reversed start=9><li>p<li>q</ol>", "5. a\n6. b\n2. c\n\n3. x\n2. y\n1. z\n\n9. p\n8. q"),
        ("<table><tr><th colspan=900>wide<tr><td>1<td>2</table>", "wide\n1    | 2"),
        ("", ""),
        ("   \n ", ""),
    ],
)
def test_rules(page, want):
    assert H.render(page) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/\"'=! -abptdlirushe&;#\n", max_size=120))
def test_never_fails(page):
    H.render(page)


def test_deep_and_long():
    for page in ("<b>" * 5000 + "x", "<ul><li>" * 3000 + "x", "<table><tr><td>" * 300 + "x", "<div " + "a='" * 20000, "<p>" + "word " * 400000):
        H.render(page)


class Walk(HTMLParser):
    """Words of a page that are visible, by the standard library's parser and a stack of hidden elements."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.words, self.stack = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "input":
            value = dict(attrs).get("value")
            if value and dict(attrs).get("type", "text") not in H.MUTE and not any(h for _, h in self.stack):
                self.words.append(value)
        if tag not in H.VOID:
            a = dict(attrs)
            gone = tag in ("head", "script", "style", "template", "noscript", "title") or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "")
            self.stack.append((tag, gone))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        if not any(h for _, h in self.stack):
            self.words.append(data)


def test_every_visible_word_is_there(spark):
    from lakeloom.llm import queries

    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        pages = {x.page_id: x.html for x in spark.read.parquet(f"{d}/pages.parquet").collect()}
        got = {x.page_id: x.text for x in queries.op4_html_text(spark, d).collect()}
        assert got.keys() == pages.keys()
        for i, page in pages.items():
            # marks and rules that the layout adds
            have = re.sub(r"(?m)^ *(?:- +|\d+\. +)+", "", got[i]).split()
            plain = lambda x: re.sub("[-|]", "", "".join(x))
            assert plain(have) == plain("".join(Walk(page).words).split()), i


def test_table_cases(spark):
    df = spark.createDataFrame([(1, None, "old", "c0"), (2, "", None, None), (3, "<p>x", "o", "t"), (3, "<p>x", "o", "t")], "page_id int, html string, text string, c0 string")
    got = sorted(map(tuple, H.extract_text(df).collect()))
    assert got == sorted([(1, "c0", None), (2, None, ""), (3, "t", "x"), (3, "t", "x")], key=lambda r: r[0])
    assert H.extract_text(df).columns == ["page_id", "c0", "text"]
    assert H.extract_text(df.limit(0)).collect() == []
