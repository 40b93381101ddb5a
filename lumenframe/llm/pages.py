"""Main text of web pages by consensus of each host's pages.

1. Every page's containers (``CONTAINERS``) are scored: the characters of their text outside links and outside
   menus, headers, footers, sidebars, notices, adverts, forms and comments, which are told by tag, role, class and
   id. The best is the largest article or main part if it has at least half of the page's score; else, from the body downwards, the
   child that keeps ``SHARE`` of its parent's score, unless a first heading would be lost.
2. A page casts one vote for its best container's generalised path: tags and classes from the body down,
   digits as ``#``, marks that look generated left out. Votes are counted by host and path in Spark. A path wins
   if it has at least ``WINS`` of its host's votes, so a host has at most 1 / ``WINS`` winners.
3. Every page is read again with its host's winners at hand: its own best container's path if that won, else the winner with the most votes that the
   page has and that holds text, else its own best container. A path with classes may name several sister elements; all are taken.

A page's html is read in two scans and moved in none, unless there are over ``HOSTS`` hosts: then pages of rare hosts are
shuffled to their host's winners and only the commonest hosts' winners are sent to all tasks. Results don't depend on that.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined in page order by line feeds, empty ones are left out; a line break tag is white space. Markup may be unclosed, wrongly nested or cut off.

Defined results: null html is an empty page with an empty text; a null url, or one without a host, has the host ''; a null
page_id stays null; repeated rows stay, and vote each; ties between containers go to the first, between
paths to the smaller key; very long pages are read whole; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import hot_join, prepare

SHARE, MOST, WINS = 0.6, 0.5, 0.05
#: Winners of at most so many hosts (a hundred bytes each) are sent to all tasks.
HOSTS = 100_000

# HTML's elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template nav header footer aside form button select textarea iframe object svg canvas audio video map dialog menu head title".split())
HEAD = frozenset("head title meta link base script style noscript template".split())
CONTAINERS = frozenset("body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset("html p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table caption thead tbody tfoot tr th blockquote pre figure figcaption address hr details summary fieldset nav header footer aside form hgroup".split())
#: A tag that starts ends an open one of these, unless one of the barriers lies between.
ENDS = {
    "li": (("li",), ("ul", "ol", "table")), "dt": (("dt", "dd"), ("dl", "table")), "dd": (("dt", "dd"), ("dl", "table")), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)), "thead": (("thead", "tbody"), ("table",)), "tbody": (("thead", "tbody"), ("table",)), "tfoot": (("tbody",), ("table",)),
}
CELLS = ("td", "th", "table", "caption", "button")
#: Words that mark what isn't the article, as the first or last word of a class or id.
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside rail ad ads advert adverts advertisement advertisements advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login signin search comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations "
    "pagination pager toolbar skip".split()
)
NOT_MARKS = frozenset("no not has with without is".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: A comment, a tag (slash, name, attributes) or other markup. Quotes count after an equals sign only; each part is taken whole, so nothing is read twice.
TOKEN = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>?|[!?/][^>]*+>?)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: Elements whose text is no markup, and what ends it.
RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noframes", "xmp")}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
GENERATED = re.compile(r"(?=.*[0-9])[0-9a-f]{6,}")


def marked(attrs: dict[str, str]) -> bool:
    """Do role, class or id say that an element isn't part of the article?"""
    if attrs.get("role", "").lower() in ROLES:
        return True
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in WORDS.findall(name)]
        if words and words[0] not in NOT_MARKS and (words[0] in MARKS or words[-1] in MARKS):
            return True
    return False


def label(tag: str, classes: str | None) -> str:
    kept = {re.sub(r"[0-9]+", "#", c.lower()) for c in (classes or "").split() if not GENERATED.fullmatch(c.lower().rpartition("-")[2])}
    return ".".join([tag, *sorted(kept)])


class Page:
    """Containers in page order, and the texts with their container and block. What is skipped leaves nothing.
    ``by_class``: go by classes, ids and forms, too."""

    def __init__(self, html: str, by_class: bool = True):
        self.by_class, self.open, self.names, self.dropped, self.links, self.block = by_class, [], Counter(), 0, 0, 0
        self.labels, self.above, self.keys, self.score, self.heads, self.end = ["body"], [-1], [b"body"], [0], [0], [0]
        self.texts: list[tuple[int, int, str]] = []
        self.inside = [0]
        at = 0
        while token := TOKEN.search(html, at):
            if token.start() > at:
                self._text(html[at : token.start()])
            at = token.end()
            if tag := token[2]:
                tag = tag.lower()
                if token[1]:
                    self._end_tag(tag)
                    continue
                self._start_tag(tag, token[3])
                if tag in RAW:  # its text belongs to an element that is skipped
                    stop = RAW[tag].search(html, at)
                    at = stop.start() if stop else len(html)
        if at < len(html):
            self._text(html[at:])
        for i in range(len(self.labels) - 1, -1, -1):
            self.end[i] = max(self.end[i], i + 1)
            if i:
                up = self.above[i]
                self.score[up] += self.score[i]
                self.heads[up] += self.heads[i]
                self.end[up] = max(self.end[up], self.end[i])

    def _pop(self):
        tag, drop = self.open.pop()
        self.names[tag] -= 1
        if drop:
            self.dropped -= 1
        elif not self.dropped:
            self.links -= tag == "a"
            if tag in CONTAINERS and tag != "body":
                self.inside.pop()

    def _end(self, tags, barriers) -> bool:
        """Close the innermost open one of ``tags`` above any barrier."""
        names = self.names
        if names[tags[0]] or len(tags) > 1 and names[tags[1]]:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in tags:
                    while len(self.open) > k:
                        self._pop()
                    return True
                if self.open[k][0] in barriers:
                    return False
        return False

    def _start_tag(self, tag, attributes):
        if tag not in HEAD and self.names["head"] > 0:
            self._end(("head",), ())
        if tag in BLOCKS:
            self.block += 1
            self._end(("p",), CELLS)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "a":
            self._end(("a",), BLOCKS)
        if tag in VOID or tag in ("html", "body"):
            if tag in ("br", "hr", "wbr") and not self.dropped:
                self.texts.append((self.inside[-1], self.block, "" if tag == "wbr" else " "))
            return
        attrs = {}
        for m in ATTRIBUTE.finditer(attributes) if "=" in attributes and not self.dropped else ():
            attrs.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        drop = tag in SKIPPED and (self.by_class or tag != "form") or self.by_class and tag != "main" and bool(attrs) and marked(attrs)
        self.open.append((tag, drop))
        self.names[tag] += 1
        self.dropped += drop
        if self.dropped:
            return
        self.links += tag == "a"
        if tag == "h1":
            self.heads[self.inside[-1]] += 1
        if tag in CONTAINERS:
            up = self.inside[-1]
            own = label(tag, attrs.get("class"))
            for column, value in ((self.labels, own), (self.above, up), (self.keys, hashlib.blake2b(self.keys[up] + b"/" + own.encode(errors="replace"), digest_size=8).digest()), (self.score, 0), (self.heads, 0), (self.end, 0)):
                column.append(value)
            self.inside.append(len(self.labels) - 1)

    def _end_tag(self, tag):
        if tag in BLOCKS:
            self.block += 1
        if tag not in VOID and tag not in ("html", "body"):
            self._end((tag,), ("table",) if tag in ("p", "li") else () if tag in BLOCKS or tag in SKIPPED else BLOCKS)

    def _text(self, data):
        if not self.dropped:
            data = unescape(data) if "&" in data else data
            self.texts.append((self.inside[-1], self.block, data))
            if not self.links:
                self.score[self.inside[-1]] += len(data) - data.count(" ") - data.count("\n")

    def best(self) -> int:
        parts = [i for i in range(1, len(self.labels)) if self.labels[i].split(".")[0] == "article"] or [i for i in range(1, len(self.labels)) if self.labels[i].split(".")[0] == "main"]
        top = max(parts, key=lambda i: (self.score[i], -i), default=0)
        if top and self.score[top] >= MOST * self.score[0]:
            return top
        children: dict[int, int] = {}  # each container's child with the highest score, the first of equal ones
        for i in range(len(self.labels) - 1, 0, -1):
            if self.score[i] >= self.score[children.get(self.above[i], i)]:
                children[self.above[i]] = i
        at = 0
        while (child := children.get(at)) and self.score[child] >= SHARE * self.score[at] and self.score[child] and self.heads[child] >= self.heads[at]:
            at = child
        return at

    def text(self, chosen: list[int]) -> str:
        blocks: dict[int, list[str]] = {}
        for container, block, data in self.texts:
            if any(c <= container < self.end[c] for c in chosen):
                blocks.setdefault(block, []).append(data)
        lines = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n".join(x for x in lines if x)

    def path(self, i: int) -> str:
        out = []
        while i >= 0:
            out.append(self.labels[i])
            i = self.above[i]
        return "/".join(reversed(out))


def read(html: str | None) -> Page:
    page = Page(html or "")
    return page if page.score[0] or not html else Page(html, by_class=False)


def extract(page: Page, winners: list[bytes]) -> tuple[str, int]:
    """The text and the (first) container that it comes from."""
    own = page.best()
    for key in [page.keys[own]] if page.keys[own] in winners else winners:
        same = [i for i, k in enumerate(page.keys) if k == key and page.score[i]]
        if same:
            several = "." in page.labels[same[0]] and page.labels[same[0]].split(".")[0] not in ("article", "main")
            same = same if several else [max(same, key=lambda i: (page.score[i], -i))]
            return page.text(same), same[0]
    return page.text([own]), own


def _votes(batches):
    for batch in batches:
        keys, paths = [], []
        for html in batch.column(1).to_pylist():
            page = read(html)
            best = page.best() if page.score[0] else None
            keys.append(None if best is None else page.keys[best])
            paths.append(None if best is None else page.path(best)[:1000])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(paths, pa.string())], names=["host", "key", "path"])


def _texts(batches):
    for batch in batches:
        texts, paths = [], []
        for html, winners in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            page = read(html)
            text, at = extract(page, winners)
            texts.append(text)
            paths.append(page.path(at)[:1000])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string())], names=["page_id", "url", "text", "n_chars", "path"])


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    return pages.select(host.alias("host"), "page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def votes(pages: DataFrame) -> DataFrame:
    """host, key and path (null: no text), n votes."""
    cast = with_host(pages).select("host", "html").mapInArrow(_votes, "host string, key binary, path string")
    return cast.groupBy("host", "key").agg(F.count("*").alias("n"), F.min("path").alias("path"))


def winners(counted: DataFrame, least: float = WINS) -> DataFrame:
    """host, n (pages), keys of its winning paths, most votes first."""
    totals = counted.groupBy("host").agg(F.sum("n").alias("pages"), F.sum(F.when(F.col("key").isNotNull(), F.col("n"))).alias("cast"))
    won = counted.where("key is not null").join(totals, "host").where(F.col("n") >= F.col("cast") * least)
    ranked = won.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "key"))), lambda s: s["key"]).alias("keys"))  # at most 1 / least a host
    return totals.join(ranked, "host", "left").select("host", F.col("pages").alias("n"), F.coalesce("keys", F.expr("array()").cast("array<binary>")).alias("keys"))


def main_text(pages: DataFrame, least: float = WINS, hosts: int = HOSTS) -> DataFrame:
    """page_id, url, text, n_chars, path (of the container taken) of every page."""
    prepare(pages.sparkSession)
    won = winners(votes(pages).checkpoint(), least).checkpoint()
    known = won.agg(F.count("*"), F.sum("n")).first()
    rows = with_host(pages)
    joined = rows.join(F.broadcast(won), "host") if known[0] <= hosts else hot_join(rows, won, "host", known[1])
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "keys").mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long, path string")
