import html as entities
import random
import re
import time

import duckdb

from lumenframe.llm import pages, queries

SCHEMA = "page_id long, url string, html string, host string, keys string"
SF = "/root/testdata/sf0.01"

NOISE = {
    "nav": '<nav class="main-nav"><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav>',
    "header": '<header id="top"><h1>The Site</h1><p>A slogan of some length, for all who read it</p></header>',
    "aside": '<div class="sidebar-left"><h3>Popular</h3><p>One more story that many people have read this week</p></div>',
    "notice": '<div class="cookie-notice" role="dialog"><p>We use cookies &amp; more to make the page better.</p><button>Yes</button></div>',
    "ad": '<div class="ad">Buy now and save a lot of money on this</div>',
    "form": '<form action="/s"><label>Your mail</label><input name="q" value="x > y"><select><option>one<option>two</select></form>',
    "script": '<script>if (a < b) document.write("<p>not a text</p>")</script><style>p > b { color: red }</style><!-- <p>hidden</p> -->',
    "comments": '<section id="comments"><h2>3 comments</h2><article class="comment"><p>First! I liked the part about the sea.</p></article></section>',
    "footer": "<footer><p>&copy; 2020 The Site. All rights reserved, and more words of that kind.</p></footer>",
}
TEMPLATES = {
    "plain.example": ("<article>{}</article>", "nav ad script", "comments footer"),
    "divs.example": ('<div id="page-{id}" class="wrap no-sidebar"><div class="post-body js-{id}">{}</div></div>', "header nav notice", "aside comments footer"),
    "main.example": ('<main role="main"><section class="text">{}</section></main>', "notice nav form", "aside ad footer"),
    "inside.example": ('<div class="content"><div class="entry">{}' + NOISE["ad"] + NOISE["form"] + NOISE["comments"] + "</div></div>", "header nav", "footer script"),
    "table.example": ('<table><tr><td class="menu">{menu}<td class="body">{}</table>', "notice", "footer"),
}


def blocks(rng):
    word = lambda: rng.choice(["sea", "über", "a<b", "R&D", "it's", "“so”", "long-form", "x"])
    return [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(2, 8))]


def page(rng, host, number):
    own = blocks(rng)
    title, *rest = own
    shown = f"<h1>{entities.escape(title)}</h1>"
    for b in rest:
        words = entities.escape(b).replace(" ", rng.choice([" ", "\n  ", "<br>", "&#32;", " <i></i>"]))
        shown += rng.choice([f"<p>{words}</p>", f"<p><b>{words}</b>\n", f"<P CLASS='t'>{words}", f"<ul><li>{words}</ul>", f"<blockquote>{words}</blockquote>", f"<div>{words}</div>"])
    frame, before, after = TEMPLATES[host]
    body = frame.replace("{id}", str(number)).replace("{menu}", NOISE["nav"]).replace("{}", shown)
    made = "<!DOCTYPE html><html><head><title>T</title><body class='with-sidebar'>" + "".join(NOISE[k] for k in before.split()) + body + "".join(NOISE[k] for k in after.split())
    return made + rng.choice(["", "</body></html>"]), "\n".join(own)


def test_templates(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(200):
        host = rng.choice([*TEMPLATES, "plain.example", "plain.example"])
        made, want[i] = page(rng, host, i)
        rows.append((i, f"https://user@{host.upper()}:80/{i}?q#f", made, "h", "k"))
    frame = spark.createDataFrame(rows, SCHEMA)
    got = pages.main_text(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]), (rows[r["page_id"]][2], r["path"])
    plain = sorted(map(tuple, got))
    assert sorted(map(tuple, pages.main_text(frame, hosts=1).collect())) == plain  # hosts shuffled to their pages


def test_consensus_overrules_one_page(spark):
    """A page whose longest part isn't where its host's articles are follows the host."""
    usual = '<div class="story-{0}"><p>{1}</p></div><div class="box"><p>{2}</p></div>'
    rows = [(i, "http://h.example/", usual.format(i, f"story {i} " * 40, "x" * 20), "", "") for i in range(30)]
    rows.append((30, "http://h.example/z", usual.format(30, "short story", "a long box " * 40), "", ""))
    got = {r["page_id"]: (r["text"], r["path"]) for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[30] == ("short story", "body/div.story-#") and all(got[i][0] == " ".join([f"story {i}"] * 40) for i in range(30))
    alone = pages.read(rows[30][2])
    assert alone.path(alone.best()) == "body/div.box"


def test_winners(spark):
    votes = [("h", b"a", 90, "p"), ("h", b"b", 6, "q"), ("h", b"c", 4, "r"), ("h", None, 50, None), ("e", None, 3, None), ("t", b"z", 1, "y"), ("t", b"a", 1, "x")]
    got = {r["host"]: (r["n"], [bytes(k) for k in r["keys"]]) for r in pages.winners(spark.createDataFrame(votes, "host string, key binary, n long, path string")).collect()}
    assert got == {"h": (150, [b"a", b"b"]), "e": (3, []), "t": (2, [b"a", b"z"])}


def test_odd_markup():
    text = lambda h: (lambda p: p.text([p.best()]))(pages.read(h))
    assert text("") == "" and text("<p>") == "" and text("just text") == "just text"
    assert text("a < b &lt; c &amp;amp; &nbsp; d &#x41; &unknown; &eacute") == "a < b < c &amp; d A &unknown; é"
    assert text("<p>one<p>two</p></p>three<br>four<hr>five") == "one\ntwo\nthree four\nfive"
    assert text("<p>a<b>b</p>c<i>d</b>e") == "ab\ncde"
    assert text("<script>never closed <p>x") == "" and text("<!-- never closed <p>x") == "" and text("<!--> <p>x") == "x"
    assert text("<div title='a > b' class=\"x\">y<p title=don't>z</p></div>") == "y\nz"
    assert text("<p>x</p" ) == "x" and text("<p>x</p><") == "x\n<" and text("<![CDATA[ q ]]>w<?php z ?>") == "w"
    assert text("<form><p>all of the page is a form</p></form>") == "all of the page is a form"
    assert text("<nav>only a menu</nav>") == ""
    assert text("<dl><dt>t<dd>d<dt>u</dl><table><tr><td>1<td>2<tr><th>3</table>") == "t\nd\nu\n1\n2\n3"
    assert text("<article><h1>T</h1><p>x</p></article>\n<article class='related'><p>yyyyyyyyyyyyy</p></article>") == "T\nx"
    assert text("<p>wo<wbr>rd a<span>b</span>c</p>") == "word abc"


def test_long_and_deep_pages_take_linear_time():
    took = []
    for n in (20_000, 40_000):
        began = time.time()
        for made in ("<div>" * n + "x", "<b>" * n + "<p>" * n, "<a href='" * n, "<!-- " * n, "<p x=\"" * n, "<" * n, "</div>" * n, "&amp;" * n, "<li><ul>" * n, "<i><table>" * n):
            pages.read(made)
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 1
    long = pages.read("<article><p>" + "word " * 300_000 + "</p></article>")
    assert len(long.text([long.best()])) == 1_499_999


def test_empty_and_null(spark):
    assert pages.main_text(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None, None, None, None), (1, "not a url", "<p>x</p>", None, None), (1, "not a url", "<p>x</p>", None, None), (2, "//h/", "", None, None), (3, "http://h", None, None, None)]
    got = sorted(((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(0, "", "", 0), (1, "not a url", "x", 1), (1, "not a url", "x", 1), (2, "//h/", "", 0), (3, "http://h", "", 0)]


def test_query_against_plain_rules(spark):
    """The tables' pages have one article each: cut out by pattern."""
    got = {r["page_id"]: r["text"] for r in queries.op12_consensus_paths(spark, SF).collect()}
    rows = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    for i, made in rows:
        inner = re.search(r"<article>(.*?)</article>", made, re.S)[1]
        parts = (" ".join(entities.unescape(re.sub("<br>", " ", b).replace("<b>", "")).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[i] == "\n".join(p for p in parts if p)
    assert len(got) == len(rows)
