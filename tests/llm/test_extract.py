"""Page extraction: pages by hand, odd pages, and given pages against a plain cut and SQL."""

import time
from pathlib import Path

import duckdb
import pytest

from emberfield.llm import extract, queries

DATA = Path("/root/testdata/sf0.01")
P1 = "The ember field burned for two days before the wind turned, and nobody had seen it come so far down."
P2 = "Crews from three towns worked along the ridge; by the second evening the line held and most went home."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul>'


def body(*parts):
    return "<!DOCTYPE html><html><head><title>Site</title><style>p{}</style></head><body>" + "".join(parts) + "</body></html>"


@pytest.mark.parametrize("page", [
    body(f"<nav>{MENU}</nav>", f"<article><h1>Ember</h1><p>{P1}</p><p>{P2}</p></article>", "<footer>&copy; Site</footer>"),
    body(f"<div class='top-menu'>{MENU}</div>", f"<div id=content><h1>Ember</h1><p>{P1}</p><p>{P2}</p></div>", f"<div>{MENU}</div>"),
    body("<header><h2>The Site of all things</h2></header>", f"<main><article><header><h1>Ember</h1></header><p>{P1}<p>{P2}<aside>See also this</aside></article></main>"),
    body(f"<article><h1>Ember</h1><p>{P1}</p><p>{P2}</p></article>", f"<div id='comments'><article><p>{P1} I say.</p></article><p>{P2}{P1}</p></div>"),
    body(f"<article><h1>Ember</h1><p>{P1}</p><div class=\"ad\">Buy now, it is cheap</div><p>{P2}</p><section class='comment-list'>{P1 * 9}</section></article>"),
    body("<div class='cookie-notice'>We use cookies on this site, please agree to all of them.</div>", f"<div><h1>Ember</h1><p>{P1}</p><p>{P2}</p></div>",
         "<form><p>Subscribe to our letters and hear of every offer first, before others do.</p><input></form>"),
    body(f"<div class='layout sidebar-right'><article><h1>Ember</h1><p>{P1}</p><p>{P2}</p></article><div class=sidebar>{P1}</div></div>"),
    f"<p hidden>{P1}</p><article><h1>Ember</h1><p>{P1}<br></p><script>var t='</article>';</script><p>{P2}<!-- </article> -->",
])
def test_the_article_is_found(page):
    assert extract.main_text(page) == f"Ember {P1} {P2}"


def test_the_densest_boxes_are_found_without_marks():
    boxes = f"<div><h1>Ember</h1><p>{P1}</p><p>{P2}</p></div>"
    links = "<div>" + "".join(f"<p><a href=x{i}>Read on here {i}</a></p>" for i in range(9)) + "</div>"
    page = extract.Page(body(links, f"<div>{boxes}</div>", links))
    assert page.text() == f"Ember {P1} {P2}"
    top = -page.best[page.body][1]
    assert page.names[top] == "div" and page.sums[top] == sum(d for d, up in zip(page.density, page.parents, strict=True) if up == top)
    assert max(page.density[i] for i, n in enumerate(page.names) if n == "a") < min(page.density[i] for i, n in enumerate(page.names) if n == "h1")


def test_densities_by_hand():
    page = extract.Page("<body><div><p>aaaa</p><p><a>bb</a>cc</p></div></body>")
    page.densities()
    import math

    c, t, lc, lt, ratio = 8, 3, 2, 1, 2 / 8
    base = math.log(max(1, c / (c - lc) * lc + ratio * c) + math.e)
    assert page.names[2] == "div" and math.isclose(page.density[2], c / t * math.log(c / lc * t / lt) / math.log(base))
    assert math.isclose(page.sums[2], page.density[3] + page.density[4])


def test_white_space_and_references():
    page = "<body><p>a<b>b</b> \n c&amp;d &lt;e&gt; &eacute;&#233;&nbsp;f&copy g<br>h<wbr>i</p>j<p>k</p><td>l<script>x</script>m</body>"
    assert extract.main_text(page) == "ab c&d <e> éé f© g hi j k lm"


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), (" \n", ""), ("no tags & all", "no tags & all"), ("<p>one", "one"), ("a < b and c > d", "a < b and c > d"),
    ("<article></article>", ""), ("<nav>x</nav>", ""), ("<script>x", ""), ("<p>a</p><a href='b", "a"), ("</p></div>x</body></html>y", "x y"),
    ("<title>t</title><p>x", "x"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<ul><li>a<li>b</ul>", "a b"),
    ("<p title='>'>x</p>", "x"), ("<!-- a", ""), ("<p>x</b></i>y</p>", "xy"), ("<div><table><tr><td></div>x</table>y", "x y"),
    ("<P CLASS=AD>x</P><P>y</P>", "y"),
])
def test_odd_pages(page, text):
    assert extract.main_text(page) == text


def test_very_long_pages_end():
    began = time.perf_counter()
    many = "<article>" + f"<p><b>{P1}<br>" * 20_000 + "</article>"
    assert extract.main_text(many) == " ".join([P1] * 20_000)
    for unit in ("<div>", "<b>", "<p x='\">", "<", "<!--", "</div>", "<a \"", "&", "<li>", "<table><tr><td>", "x " * 50):
        extract.main_text(unit * 20_000)
    assert extract.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert time.perf_counter() - began < 90


SCHEMA = "page_id long, url string, html string, text string, n_chars int, label int"


def test_rows_of_pages(spark):
    page = body(f"<article>{P1}</article>")
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, None, None), (3, "v", ""), (4, "w", "x" * 3_000_000)]
    got = extract.extract(spark.createDataFrame([(*r, "t", 1, 2) for r in rows], SCHEMA)).collect()
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    want = [(i, u, extract.main_text(h)) for i, u, h in rows]
    assert sorted(map(str, got)) == sorted(str(type(got[0])(page_id=i, url=u, text=t, n_chars=len(t))) for i, u, t in want)
    assert extract.extract(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    got = queries.op13_extract(spark, str(DATA)).select("page_id", "url", "text", "n_chars").collect()
    want = con.execute(queries.oracle_sql()["op13_extract"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and all(r[2] for r in want)
