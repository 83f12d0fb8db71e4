"""Operator 12: wrappers on made pages, main text against a plain reading of the given ones."""

import re
from html import unescape

import pytest

from scorecraft.llm import wrappers
from scorecraft.llm.wrappers import Region, align, infer, parse, spelled, wrapper


def plain(html):
    """The article of a given page, block by block, by splitting at its tags."""
    inside = re.search(r"<article>(.*)</article>", html, re.S)
    parts = re.split(r"</?(?:h1|p)>", inside[1]) if inside else []
    return "\n".join(t for t in (" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts) if t)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r["page_id"]: (r["url"], r["text"]) for r in wrappers.extract(pages).collect()}
    want = {r["page_id"]: (r["url"], plain(r["html"])) for r in pages.collect()}
    assert got == want and all(t for _, t in got.values())


def inferred(*pages):
    made = wrapper(parse(pages[0]))
    for p in pages[1:]:
        made = align(made, wrapper(parse(p)))
    return made


def test_mismatches_become_slots_options_and_groups():
    a = "<div><h2>News</h2><p>one</p><p>two</p><img></div>"
    b = "<div><h2>News</h2><p>three</p></div>"
    assert spelled(inferred(a, b)) == '<#page><div><h2>"News"</h2>(<p>SLOT</p>)+(<img>)?</div></#page>'
    assert spelled(inferred(b, a)) == spelled(inferred(a, b))
    c = "<dl><dt>k<dd>v<dt>k2<dd>v2</dl>"
    assert spelled(inferred(c)) == "<#page><dl>(<dt>SLOT</dt><dd>SLOT</dd>)+</dl></#page>"
    d = "<dl><dt>k<dd>v<dt>lone</dl>"
    assert spelled(inferred(c, d)) == "<#page><dl>((<dt>SLOT</dt>)?(<dd>SLOT</dd>)?)+</dl></#page>"
    assert "(<b>" in spelled(inferred("<p>x</p><p><b>y</b></p>"))


def test_merging_partial_wrappers_gives_one_that_holds_all():
    pages = [f"<body><h1>t{i}</h1>" + "<p>x</p>" * (i % 4) + ("<ul>" + "<li>i" * i + "</ul>" if i % 3 == 0 else "") + "</body>" for i in range(1, 30)]
    whole = inferred(*pages)
    parts = align(inferred(*pages[:10]), align(inferred(*pages[10:20]), inferred(*pages[20:])))
    assert spelled(whole) == spelled(parts) == '<#page><body><h1>SLOT</h1>((<p>"x"</p>)+)?(<ul>(<li>"i"</li>)+</ul>)?</body></#page>'


def text_of(*pages, of=0):
    return Region(inferred(*pages), len(set(pages)) > 1).text(parse(pages[of]))


FRAME = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav>"
         "<div class='cookie-notice'>We use cookies</div>%s<aside>More</aside><section id=comments><article>Great!</article></section><form>Mail <input></form><footer>(c)</footer></body></html>")


def test_parts_that_are_no_main_text():
    body = ("<article><header><h1>Head &amp; line</h1>by us</header><p>One\n two <b>three</b><p>Four<br>five<script>var t='</p>';</script><div class='ad-box'>Buy</div><!-- no -->"
            "<ul><li>a<li>b</ul>tail<table><tr><td>x<td>y</table></article>")
    assert text_of(FRAME % body) == "Head & line\nOne two three\nFour five\na\nb\ntail\nx\ny"
    assert text_of(FRAME % "<main><p>Only</p><p>main</p></main>") == "Only\nmain"
    assert text_of(FRAME % "<div role=main><p>Role</p></div><div>Not</div>") == "Role"


def test_host_without_article_tells_its_own_texts():
    pages = [f"<html><body><h3>All our pages say this</h3><div><p>Story {i}</p><p>Same end</p></div></body></html>" for i in range(3)]
    assert text_of(*pages) == "Story 0\nSame end"  # one of a group's repeats is no text of the host
    assert text_of(pages[0]) == "All our pages say this\nStory 0\nSame end"
    assert text_of(pages[0], pages[0]) == "All our pages say this\nStory 0\nSame end"  # nothing differs: no page's text is given up


def test_pages_with_and_without_an_article():
    one, two = "<body><article><p>A</p></article></body>", "<body><div><p>B</p></div></body>"
    assert text_of(one, two) == "A" and text_of(one, two, of=1) == "B"


def test_shared_article_stays():
    page = FRAME % "<article><p>Copied on two pages of a host.</p></article>"
    assert text_of(page, page, page) == "Copied on two pages of a host."


@pytest.mark.parametrize("html,want", [
    ("", ""), ("no tags", "no tags"), ("a < b > c", "a < b > c"), ("<p>open", "open"), ("</p></div>x", "x"), ("<p title='a>b'>q</p>", "q"), ('<p title="never closed>q</p>', "q"),
    ("<p>&lt;i&gt;&eacute;&#233;&nbsp;x</p>", "<i>éé x"), ("<script>if (a<b) x()</script>y", "y"), ("<script>never closed", ""), ("<!-- never closed <p>x", ""),
    ("<b><p>one<p>two</b>", "one\ntwo"), ("<P>UP<BR/>down</P>", "UP down"), ("<div>" * 3000 + "deep" + "</div>" * 3000 + "after", "deep\nafter"),
    ("<p>" + "word " * 200_000 + "</p>", ("word " * 200_000).strip()), ("x" + "<p>y</p>" * 20_000, "x\n" + "\n".join(["y"] * 20_000)),
])
def test_odd_pages(html, want):
    assert text_of(html) == want


def test_tables(spark, monkeypatch):
    schema = "page_id long, url string, html string, text string, host string, pages int"
    page = FRAME % "<article><p>%s</p></article>"
    rows = [(1, "http://a.example/x", page % "one", "t", "h", 1), (1, "http://a.example/x", page % "one", "t", "h", 1), (2, None, None, None, None, None), (None, "", "", None, None, None),
            (3, "no host", "<p>three", None, None, None)] + [(100 + i, "http://HOT.example/" + str(i), page % f"hot {i}", None, None, None) for i in range(300)]
    want = sorted(((i, u, "" if not t else "three" if i == 3 else re.search("<article><p>(.*)</p></article><aside", t)[1]) for i, u, t, *_ in rows), key=str)
    df = spark.createDataFrame(rows, schema).repartition(40)
    assert sorted((tuple(r) for r in wrappers.extract(df).collect()), key=str) == want
    monkeypatch.setattr(wrappers, "MERGED", 2)
    assert sorted((tuple(r) for r in wrappers.extract(df).collect()), key=str) == want
    got = {r["host"]: (r["pages"], r["differ"]) for r in infer(df.selectExpr("html", "coalesce(regexp_extract(url, '://([^/]*)', 1), '') AS host")).collect()}
    assert got == {"a.example": (2, False), "HOT.example": (300, True), "": (3, True)}
    assert wrappers.extract(df.limit(0)).count() == 0
