import re

import pytest

from cohortsmith.llm import html_text
from cohortsmith.llm.html_text import html_to_text

CASES = {
    "<p>a <b>b</b>  c<p>d": "a b c\n\nd",
    "<div>a<div>b</div>c</div>": "a\nb\nc",
    "x<br>y<br><br>z": "x\ny\n\nz",
    "<head><title>t</title><style>s</style></head><body>a<script>var t='</p>';</script>b":
        "ab",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": "- a\n- b\n  - c\n- d\n\ne",
    "<ol start=3><li>a<li value=7>b<li>c</ol>": "3. a\n7. b\n8. c",
    "<ol type=i reversed><li>a<li>b</ol>": "ii. a\ni. b",
    "<table><caption>T</caption><tr><th>aa<th>b<tr><td>c<td>dd</table>": "T\naa  b\nc   dd",
    "<table><tr><td colspan=2>x<td>y<tr><td>1<td>2<td>3</table>": "x     y\n1  2  3",
    "<table><tr><td rowspan=2>x<td>y<tr><td>z</table>": "x  y\n   z",
    "<pre>a\n  b</pre>": "a\n  b",
    "<p hidden>no</p><p style='display: none'>no</p><p>yes<template>no</template></p>": "yes",
    "<noscript>no</noscript>yes<input type=hidden value=no><input type=submit value=Go>":
        "yes Go",
    "<details><summary>s</summary>no</details><details open>yes</details>": "s\nyes",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n  d\nu",
    "&lt;a&gt; &amp;&eacute;&#8364; &copy": "<a> &é€ ©",
    "<!-- c -->a<!doctype x>": "a",
    "</p></div>a</b>": "a",
    "<td>a</td><td>b</td>": "a\nb",
    "<table><tr><td>日本<td>x<tr><td>abc<td>y</table>": "日本  x\nabc   y",
    "<select><option>a<option>b</select>": "a\nb",
    "": "",
    "<": "<",
    "plain  text\n only": "plain text only",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert html_to_text(html) == CASES[html]


def test_broken_nesting_keeps_all_text():
    deep = "<b><div>" * 3000 + "x" + "<i>y" * 3000
    text = html_to_text(deep)
    assert re.sub(r"\s", "", text) == "x" + "y" * 3000


def test_all_words_of_random_markup_survive():
    import random

    chance = random.Random(2)
    tags = ["p", "div", "b", "li", "ul", "td", "tr", "table", "h1", "span", "dd", "ol"]
    for _ in range(300):
        parts, words = [], []
        for i in range(30):
            parts.append(chance.choice(["<{}>", "</{}>", " w{} "]).format(
                chance.choice(tags) if chance.random() < 0.5 else i
            ))
        html = "".join(p if not p.startswith(("<1", "<2")) else p for p in parts)
        words = re.findall(r" (w\S+) ", html)
        text = html_to_text(html)
        for w in words:
            assert w in text


def test_rows(spark):
    pages = spark.createDataFrame(
        [(1, "<p>a", "x"), (1, "<p>a", "y"), (None, None, None), (2, "", ""),
         (3, "<p>" + "word " * 200_000, "z")],
        "page_id long, html string, text string",
    )
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "text"]
    by = sorted((r["page_id"] or 0, len(r["text"])) for r in got.collect())
    assert by == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 999_999)]
    assert html_text.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("html, text", [
    ("<div>" * 205 + '<div style="display:none"><b>HIDDEN</b> tail</div>after', "after"),
    ("<div>" * 205 + '<p hidden><i><b>NO</i>NO</b></p>a<p>b</p>c' + "</div>" * 205 + "d",
     "a\nb\nc\nd"),
    ("<b>" * 300 + '<i style="visibility:hidden">no<u style="visibility:visible">yes</u></i>!',
     "yes!"),
    ('<div style="visibility:hidden">no<b style="visibility:visible">yes</b>no</div>x', "yes\nx"),
    ('<ul style="visibility: collapse"><li>no<li style="visibility:visible">yes</ul>', "- yes"),
    ('<table style="visibility:hidden"><tr><td>no<td style="visibility:visible">yes</table>', "yes"),
    ('<p style="visibility:hidden">a<br>b</p>c', "c"),
    ("<table>" + "<tr><td rowspan=50 colspan=1000>x" * 3 + "</table>", "x\n   x\n      x"),
])
def test_hidden_and_deep_parts(html, text):
    assert html_to_text(html) == text


def test_large_spans_and_deep_pages_end_soon():
    import time

    start = time.process_time()
    text = html_to_text("<table>" + "<tr><td rowspan=10000 colspan=1000>x" * 10_000 + "</table>")
    assert text.split() == ["x"] * 10_000 and len(text) < 100_000
    deep = "<div>" * 50_000 + "x" + "</b>" * 50_000 + "</div>" * 50_000 + "y"
    assert html_to_text(deep) == "x\ny"
    assert time.process_time() - start < 20


def naive(html):
    """Words a reader sees in well-formed markup of spans and blocks, by a stack of styles."""
    out, stack = [], [(True, True)]
    for piece in re.findall(r"<[^>]*>|[^<]+", html):
        if piece.startswith("</"):
            stack.pop()
        elif piece.startswith("<"):
            displayed, seen = stack[-1]
            if "display:none" in piece or " hidden" in piece:
                displayed = False
            for word, value in (("visibility:hidden", False), ("visibility:visible", True)):
                seen = value if word in piece else seen
            stack.append((displayed, seen))
        elif all(stack[-1]):
            out += piece.split()
    return out


def test_words_of_random_pages_equal_a_naive_reader():
    import random

    chance = random.Random(8)
    styles = ["", "", "", ' style="display:none"', " hidden", ' style="visibility:hidden"',
              ' style="color:red; visibility:visible"']

    def page(depth):
        parts = []
        for _ in range(chance.randrange(1, 4)):
            parts.append(f" w{chance.randrange(99)} ")
            if depth:
                tag = chance.choice(["div", "b", "span", "section", "i"])
                parts.append(f"<{tag}{chance.choice(styles)}>{page(depth - 1)}</{tag}>")
        return "".join(parts)

    for wrap in (0, 150, 196, 240):
        for _ in range(60):
            html = "<div>" * wrap + page(6) + "</div>" * wrap
            assert html_to_text(html).split() == naive(html)
