"""Main text of web pages: site templates found by counting element subtrees per host, on top of landmarks.

A page is read once into blocks of text. Elements that say what they are (menus, headers, footers, asides, forms, adverts,
notices, comments, scripts) are left out with all they hold, articles too. The subtree of every other element is hashed on every page,
inside and outside articles, and Spark counts for each host on how many different pages a hash occurs. Subtrees on many pages
of their host are its template, and their blocks go. Of what is left, the blocks inside article or main elements count alone if they
hold at least half of the text; otherwise the mark is not trusted and all blocks count.

Pages of one title, or without a title of equal text, count once per host, so that copies of a page and edited copies do not make
its text a template. Counting combines map-side by host and hash; results return to the pages by plain joins of written tables.

Markup is scanned from left to right and no part of it twice, however broken. Once a tag's quotes do not close before the page ends,
tags end at the next ``>``; without one, the rest is text. A subtree's hash follows from running sums over the page's tags and texts.

Defined results: null and empty pages have an empty text; a null or odd url belongs to the host with the empty name; repeated
rows give equal results; an empty table gives an empty result; other columns are left out. Whole pages are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsim.session import materialize

MIN_PAGES = 5
SHARE = 0.3
GROUP_CHARS = 1 << 21  # of markup, whose pages are handed on together
MAX_DEPTH = 32  # elements nested deeper are no templates by themselves, but go with the elements around them
READ = "page_id long, url string, host string, blocks array<struct<text:string,around:array<int>,inside:boolean>>, subtrees array<long>, title string"

RAW = frozenset("script style noscript template iframe textarea title svg math".split())
CLOSING = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot select div article section main body nav aside".split())
MAIN = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body"))  # they hold the whole page
LEFT_OUT = frozenset("head nav header footer aside form button select dialog menu object video audio canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Names that leave an element out, unless a name of content stands beside them in the same word.
NAMES = frozenset(
    "promo banner nav navbar navigation menu breadcrumb breadcrumbs aside footer header masthead notice notification popup modal subscribe "
    "share sharing social related widget".split()
)
CONTENT_NAMES = frozenset("article content main body text post entry story".split())
# Names that always do.
FIRM_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sidebar comment comments disqus replies cookie cookies consent gdpr newsletter".split()
)
MODIFIERS = frozenset("has with no without".split())  # they say something about an element that holds or lacks the named one

BASE, MODULUS = 0x1F3D5B79A7C6E5D3, (1 << 61) - 1


def left_out(tag: str, attrs: str) -> bool:
    """Whether an element says that it is no main text."""
    if tag in LEFT_OUT:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id"):
            for one in value.split():
                words = set(re.split(r"[^a-z0-9]+", one))
                if not words & MODIFIERS and (words & FIRM_NAMES or (words & NAMES and not words & CONTENT_NAMES)):
                    return True
    return False


def markup(html: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, content)`` from left to right: a ``text``, an ``open`` or ``close`` tag with its attributes, or a ``raw`` element."""
    at, size, quotes_close = 0, len(html), True
    while at < size:
        low = html.find("<", at)
        if low < 0:
            break
        if low > at:
            yield "text", "", html[at:low]
        at = low
        if html.startswith("<!--", low):
            end = html.find("-->", low + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith("<![CDATA[", low):
            end = html.find("]]>", low)
            if end >= 0:
                yield "cdata", "", html[low + 9 : end]
                at = end + 3
                continue
        named = None
        if not html.startswith(("<!", "<?"), low):
            named = TAG_NAME.match(html, low + 1)
            if not named:
                yield "text", "", "<"
                at = low + 1
                continue
        end = -1
        if named and quotes_close:
            place = named.end()
            while found := QUOTE_OR_END.search(html, place):
                if found[0] == ">":
                    end = found.start()
                    break
                place = html.find(found[0], found.end()) + 1
                if not place:
                    break
            quotes_close = end >= 0
        if end < 0:
            end = html.find(">", low)
        if end < 0:
            yield "text", "", html[low:]
            return
        at = end + 1
        if not named:
            continue
        tag, closing = named[1].lower(), html[low + 1] == "/"
        if tag in RAW and not closing:
            last = CLOSING[tag].search(html, at)
            yield "raw", tag, html[at : last.start() if last else size] if tag == "title" else ""
            at = last.end() if last else size
        else:
            yield "close" if closing else "open", tag, html[named.end() : end]
    if at < size:
        yield "text", "", html[at:]


class Page:
    """``blocks`` of text in page order, ``(text, places in subtrees, inside a main element)``, the hashes ``subtrees`` around them, and the ``title``."""

    def __init__(self, html: str | None):
        self.found: list[tuple[str, list[int], bool]] = []
        self.stack: list[list] = []  # tag, element number or -1, left out, inside main
        self.pieces: list[str] = []
        self.title = ""
        self.sums, self.powers, self.spans = [0], [1], []
        for kind, name, content in markup(html or ""):
            if kind in ("text", "cdata"):
                self.text(content)
            elif kind == "raw":
                self.count(f"<{name}>")
                self.title = self.title or " ".join(unescape(content).split())
            elif kind == "close":
                self.end(name)
            else:
                self.begin(name, content)
        self.flush()
        self.close(0)
        self.number()

    def count(self, token: str) -> None:
        """Goes on with the running sum whose differences are the subtrees' hashes."""
        import xxhash

        value = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        self.sums.append((self.sums[-1] * BASE + value) % MODULUS)
        self.powers.append(self.powers[-1] * BASE % MODULUS)

    def text(self, raw: str) -> None:
        self.pieces.append(unescape(raw))
        if plain := " ".join(raw.split()):
            self.count(plain)

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces.clear()
        if text and not (self.stack and self.stack[-1][2]):
            self.found.append((text, [e[1] for e in self.stack[:MAX_DEPTH] if e[1] >= 0], bool(self.stack) and self.stack[-1][3]))

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            if self.stack[-1][0] not in INLINE:
                self.flush()
            element = self.stack.pop()[1]
            if element >= 0:
                self.spans[element][1] = len(self.sums) - 1

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self.close(depth)
                break
            if self.stack[depth][0] in MAIN and tag not in MAIN and tag not in ("body", "html"):
                break

    def begin(self, tag: str, attrs: str) -> None:
        if tag not in INLINE:
            self.flush()
        if tag in CLOSES_P or tag in SIBLINGS:
            closes = SIBLINGS.get(tag, {"p"})
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth][0] in closes:
                    self.close(depth)
                    break
                if self.stack[depth][0] in HOLDERS:
                    break
        self.count(f"<{tag}>")
        if tag in VOID or attrs.endswith("/"):
            if tag == "br":
                self.pieces.append(" ")
            return
        outer = self.stack[-1] if self.stack else None
        skip = bool(outer and outer[2]) or left_out(tag, attrs)
        element = -1
        if not skip and tag not in WHOLE and len(self.stack) < MAX_DEPTH:
            element = len(self.spans)
            self.spans.append([len(self.sums) - 2, len(self.sums) - 1])
        self.stack.append([tag, element, skip, tag in MAIN or 'role="main"' in attrs or bool(outer and outer[3])])

    def number(self) -> None:
        places: dict[int, int] = {}
        self.blocks = [(t, [places.setdefault(e, len(places)) for e in around], inside) for t, around, inside in self.found]
        self.subtrees = []
        for element in places:
            lo, hi = self.spans[element]
            self.subtrees.append((self.sums[hi] - self.sums[lo] * self.powers[hi - lo]) % MODULUS)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids = batch["page_id"].astype("Int64")
        rows, chars = [], 0
        for page_id, url, host, html in zip(ids, batch["url"], batch["host"], batch["html"]):
            page = Page(html)
            blocks = [{"text": t, "around": a, "inside": i} for t, a, i in page.blocks]
            rows.append((page_id, url, host, blocks, page.subtrees, page.title))
            chars += len(html or "")
            if chars > GROUP_CHARS:
                yield _frame(rows)
                rows, chars = [], 0
        if rows:
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "host", "blocks", "subtrees", "title"]).astype({"page_id": "Int64"})


def read_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, host, blocks, subtrees, title, signature, origin)`` of ``(page_id, url, html)``, written.

    ``signature`` is equal for pages of equal text, ``origin`` for those that count as one.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))
    named = pages.select("page_id", "url", "html", host.alias("host"))
    read = named.mapInPandas(_read, READ)
    read = read.withColumn("signature", F.md5(F.array_join("blocks.text", "\n")))
    return materialize(read.withColumn("origin", F.when(F.col("title") != "", F.md5("title")).otherwise(F.col("signature"))), "pages")


def templates(read: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``(host, subtree)`` of the subtrees on at least ``min_pages`` and ``share`` of the different pages of a host."""
    seen = read.where(F.size("blocks") > 0).select("host", "origin", "subtrees")
    subtrees = seen.select("host", "origin", F.explode("subtrees").alias("subtree")).distinct()
    counts = subtrees.groupBy("host", "subtree").agg(F.count("*").alias("n"))
    sizes = materialize(seen.select("host", "origin").distinct().groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    often = materialize(counts.where(F.col("n") >= min_pages), "subtrees")
    return often.join(sizes, "host").where(F.col("n") >= F.col("pages") * share).select("host", "subtree")


def without_templates(read: DataFrame, known: DataFrame) -> DataFrame:
    """``read`` with the ``kept`` blocks, those in no subtree of the written ``known`` templates of their host."""
    page_subtrees = read.select("host", "signature", F.explode("subtrees").alias("subtree")).distinct()
    gone = page_subtrees.join(known, ["host", "subtree"]).groupBy("host", "signature").agg(F.collect_set("subtree").alias("gone"))
    out = read.join(materialize(gone, "gone"), ["host", "signature"], "left")
    in_template = lambda b: F.exists(b["around"], lambda k: F.array_contains("gone", F.get("subtrees", k)))
    kept = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~in_template(b)))
    return out.withColumn("kept", kept)


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``(page_id, url, html)``."""
    read = read_pages(pages)
    left = without_templates(read, materialize(templates(read, min_pages, share), "templates"))
    inside = F.filter("kept", lambda b: b["inside"])
    chars = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"]))
    trusted = (chars(inside) > 0) & (2 * chars(inside) >= chars(F.col("kept")))
    chosen = F.when(trusted, inside).otherwise(F.col("kept"))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), " ")
    return left.select("page_id", "url", text.alias("text"))


def op6_html(spark, sf_dir: str) -> DataFrame:
    found = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
