"""Main text of web pages by the style trees of their sites.

The pages of a host are merged into one tree of branches: the chains of elements, by tag and
class, that lead to a text. For a branch that ``m`` pages have, every text below it that ``k``
of them share has the entropy log k / log m: 0 for what stands on one page, 1 for what stands
on all. The branch's content importance is 1 less the mean of these; its presentation
importance is the entropy, to base m, of the sequences of children it has in the pages. Both
together tell what a site repeats from what a page says, and branches of little importance are
removed from each page, inside its article as well. A single page has no other to compare, and
menus and adverts may differ from page to page, so elements whose tag or role names them are
worth nothing from the start. Names of classes are a hint: inside an article they halve a
branch's importance, outside of it they rule a branch out while the page has anything else.
Hosts may hold copies of one article, so an article is never left without its text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm.common import stored
from crivo.shared import BroadcastBudget, measured

# Weight of content against presentation in a branch's importance.
CONTENT_WEIGHT = 0.9
LEAST_IMPORTANCE = 0.3
LEAST_PAGES = 3
# Inside an article a branch without a name of noise goes only if so many pages tell of it.
LEAST_ARTICLES = 6
# A name of noise takes so much of a branch's importance inside an article.
NAMED_WEIGHT = 0.5
# Elements nested deeper count to the branch of their ancestor at this depth.
DEPTH = 24

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Fixed lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table caption thead tbody tfoot tr ul".split()
)
CLOSES_P = BLOCKS - {"html", "head", "body", "legend", "li", "dt", "dd", "caption", "thead", "tbody", "tfoot", "tr", "summary"}
SIBLINGS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "p": frozenset(["p"]),
    "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]),
}
HOLDERS = frozenset("ul ol dl table select div section article main body nav aside header footer form td th blockquote".split())

# Names of what is not the article.
NOISE_TAGS = frozenset(
    "head nav footer aside form menu dialog button select svg canvas audio video object embed template map datalist".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
# An article inside an element of these names is still the article.
FRAME_WORDS = frozenset("header masthead topbar banner nav navbar navigation menu sidebar rail widget widgets notice alert search tags toolbar footer".split())
NOISE_WORDS = FRAME_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle adsense sponsor sponsored sponsors promo promoted promotion promotions "
    "cookie cookies consent gdpr privacy popup modal overlay newsletter subscribe subscription signup signin login paywall "
    "menubar submenu breadcrumb breadcrumbs comment comments commentlist discussion disqus respond reply replies share sharing social "
    "related recommended recommendations pagination pager outbrain taboola sidenav aside notification notifications".split()
)
# Classes with these words tell how a page is laid out, not what the element is.
LAYOUT_WORDS = frozenset("with without has no layout".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SHOWN, FRAME, NAMED, NOISE = 0, 1, 2, 3


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\n") else {}


def _worth(tag: str, own: dict[str, str], in_article: bool, is_article: bool) -> int:
    """Is an element part of the page, of its frame, named as noise, or never shown?"""
    if tag in NOISE_TAGS or own.get("role", "").lower() in NOISE_ROLES:
        return NOISE
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", "")):
        return NOISE
    if tag == "header" and not in_article:
        return FRAME
    if tag in ("html", "body") or is_article:
        return SHOWN
    names = own.get("class", "").split() + ([] if tag in HEADINGS else own.get("id", "").split())
    found = [{w.lower() for w in _TOKEN.findall(name)} for name in names]
    words = {w for own_words in found if not own_words & LAYOUT_WORDS for w in own_words}
    if in_article:
        words -= {"header"}
    if words & (NOISE_WORDS - FRAME_WORDS):
        return NAMED
    return FRAME if words & FRAME_WORDS else SHOWN


class _Page:
    """Reads one page: its texts with the elements around them, and its elements' children."""

    def __init__(self, host: str) -> None:
        # Of an open element: tag, branch, worth, depth of its article and of the first named element (0: none), children so far.
        self.open: list[tuple[str, str, int, int, int, list[str]]] = [("", host, SHOWN, 0, 0, [])]
        # Text, branches, never shown?, depth of its article and of the first named element, in a heading?
        self.texts: list[tuple[str, list[str], bool, int, int, bool]] = []
        self.styles: list[tuple[str, str]] = []
        self.held: list[str] = []

    def _end_block(self) -> None:
        if self.held:
            text = " ".join(html.unescape("".join(self.held)).split())
            self.held = []
            if text:
                _, _, worth, article, named, _ = self.open[-1]
                heading = any(o[0] in HEADINGS for o in self.open)
                self.texts.append((text, [o[1] for o in self.open[1:DEPTH + 1]], worth == NOISE, article, named, heading))

    def _close(self) -> None:
        tag, branch, _, _, _, children = self.open.pop()
        if len(self.open) <= DEPTH:
            self.styles.append((branch, " ".join(dict.fromkeys(children))))

    def _close_from(self, at: int) -> None:
        """Close the open elements from ``at`` on; a text inside belongs to the inmost block."""
        if any(o[0] in BLOCKS for o in self.open[at:]):
            self._end_block()
        while len(self.open) > at:
            self._close()

    def start(self, tag: str, raw: str) -> None:
        if tag in CLOSES_P or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, frozenset()) | (frozenset(["p"]) if tag in CLOSES_P else frozenset())
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at][0] in ends:
                    self._close_from(at)
                    break
                if self.open[at][0] in HOLDERS:
                    break
        if tag in BLOCKS:
            self._end_block()
        elif tag in ("br", "td", "th"):
            self.held.append(" ")
        _, branch, worth, article, named, children = self.open[-1]
        own = _attributes(raw)
        name = tag + "".join("." + c for c in sorted(own.get("class", "").split()))
        children.append(name)
        if tag in VOID:
            return
        is_article = tag in ("article", "main") or own.get("role", "").lower() in ("main", "article")
        mine = _worth(tag, own, article > 0, is_article)
        depth = min(len(self.open), DEPTH)
        if is_article and worth == FRAME and mine == SHOWN:
            worth, named = SHOWN, 0
        worth = max(worth, mine)
        if not article and is_article and worth == SHOWN:
            article = depth
        if not named and mine in (FRAME, NAMED):
            named = depth
        inner = f"{branch}>{name}" if len(self.open) <= DEPTH else branch
        self.open.append((tag, inner, worth, article, named, []))

    def end(self, tag: str) -> None:
        if tag == "br":
            self.held.append(" ")
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                self._close_from(at)
                return
            # An end tag inside a table cell or article does not reach out of it.
            if self.open[at][0] in ("article", "main", "body") and tag in ("p", "b", "i", "em", "strong", "span", "a", "li"):
                return

    def read(self, page: str) -> None:
        at = 0
        while True:
            mark = _TAG.search(page, at)
            self.held.append(page[at:mark.start()] if mark else page[at:])
            if mark is None:
                break
            at = mark.end()
            tag = (mark[2] or mark[5] or "").lower()
            if not tag:
                if mark[0].startswith("<![CDATA["):
                    self.held.append(html.escape(mark[0][9:].removesuffix("]]>"), quote=False))
                continue
            raw = (mark[3] if mark[2] else mark[6]) or ""
            if mark[1] or mark[4]:
                self.end(tag)
            elif tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = len(page) if stop is None else page.find(">", stop.start()) + 1 or len(page)
            else:
                self.start(tag, raw)
                if raw.endswith("/") and tag in ("svg", "path", "use"):
                    self.end(tag)
        self._close_from(1)
        self._end_block()


def host_of(url: str | None) -> str:
    """The host of a URL in lower case, without a port; empty if there is none."""
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


BLOCK = "array<struct<text:string,branches:array<long>,article:int,named:int,heading:boolean>>"


def _mark(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shown blocks of every page, and the children of the branches above them."""
    block = pa.list_(pa.struct([("text", pa.string()), ("branches", pa.list_(pa.int64())), ("article", pa.int32()), ("named", pa.int32()), ("heading", pa.bool_())]))
    pair = pa.list_(pa.struct([("branch", pa.int64()), ("feature", pa.int64())]))
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            blocks, styles, sites = [], [], []
            for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist()):
                host = host_of(url)
                sites.append(_mark(host))
                read = _Page(host)
                read.read(page or "")
                shown = [
                    {"text": text, "branches": [_mark(b) for b in branches], "article": article, "named": named, "heading": heading}
                    for text, branches, noise, article, named, heading in read.texts if not noise
                ]
                asked = {b for x in shown for b in x["branches"]}
                blocks.append(shown)
                found = dict.fromkeys((_mark(b), _mark(style)) for b, style in read.styles)
                styles.append([{"branch": b, "feature": f} for b, f in found if b in asked])
            yield pa.RecordBatch.from_arrays(
                [part.column("page"), part.column("id"), part.column("url"), pa.array(sites, pa.int64()), pa.array(blocks, block), pa.array(styles, pair)],
                names=["page", "id", "url", "site", "blocks", "styles"],
            )


def importance(pages: DataFrame) -> DataFrame:
    """``site``, ``branch``, ``m`` and ``importance`` of every branch of the sites' style trees.

    Pages and shared features are counted where they are read, so a host with a third of all
    pages sends one number per branch and feature from each task.
    """
    # A text counts once for each branch and page, by its hash.
    said = F.expr("array_distinct(flatten(transform(blocks, b -> transform(b.branches, x -> struct(x AS branch, xxhash64(b.text) AS feature)))))")
    texts = pages.select(F.explode(said).alias("f")).select("f.*", F.lit(False).alias("presentation"))
    every = texts.union(pages.select(F.explode("styles").alias("f")).select("f.*", F.lit(True).alias("presentation")))
    shared = every.groupBy("branch", "presentation", "feature").agg(F.count("*").alias("k"))
    having = pages.select("site", F.explode(F.array_distinct(F.flatten("blocks.branches"))).alias("branch"))
    pages_of = having.groupBy("branch").agg(F.count("*").alias("m"), F.first("site").alias("site"))
    content, presentation = ~F.col("presentation"), F.col("presentation")
    sums = shared.groupBy("branch").agg(
        F.sum(F.when(content, F.log("k"))).alias("content"), F.count(F.when(content, 1)).alias("texts"),
        F.sum(F.when(presentation, F.col("k"))).alias("styled"),
        F.sum(F.when(presentation, F.col("k") * F.log("k"))).alias("style_logs"),
    )
    m = F.log("m")
    of_content = F.when(F.col("texts") > 0, 1 - F.col("content") / (F.col("texts") * m)).otherwise(0.0)
    # A page can have several styles of one branch, so shares are of all styles seen.
    of_style = F.when(F.col("styled") > 0, (F.log("styled") - F.col("style_logs") / F.col("styled")) / m).otherwise(0.0)
    both = CONTENT_WEIGHT * of_content + (1 - CONTENT_WEIGHT) * F.least(of_style, F.lit(1.0))
    return sums.join(pages_of, "branch").select("site", "branch", "m", F.when(F.col("m") > 1, both).otherwise(1.0).alias("importance"))


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``id``, ``url`` and ``text`` of every row: the blocks that say something, one to a line.

    Branches that the site repeats go. If the articles (or ``main``) hold at least half of what
    is left of a page, only they count. An article keeps its text if nothing but headings would
    be left of it, and a page its blocks if nothing would be. Null and empty pages give an empty
    text, repeated rows stay, and rows without a host in their URL form one site. Every page is
    read once.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("page"), F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{url_column}`").cast("string").alias("url"), F.col(f"`{html_column}`").cast("string").alias("html"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    read = stored(rows.mapInArrow(_parsed, f"page long, id {kind}, url string, site long, blocks {BLOCK}, styles array<struct<branch:long,feature:long>>"), "pages")
    doubtful = importance(read).where((F.col("m") >= LEAST_PAGES) & (F.col("importance") * NAMED_WEIGHT < LEAST_IMPORTANCE))
    doubtful = stored(doubtful, "doubtful")
    pages_read = read.drop("styles").withColumn("own", F.array_distinct(F.flatten("blocks.branches")))
    is_low = F.col("importance") < LEAST_IMPORTANCE
    lists = [
        F.collect_list("branch").alias("doubtful"), F.collect_list(F.when(is_low, F.col("branch"))).alias("low"),
        F.collect_list(F.when(is_low & (F.col("m") >= LEAST_ARTICLES), F.col("branch"))).alias("low_inside"),
    ]
    if BroadcastBudget().take(measured(doubtful)):
        # The sites' lists go to the pages, which stay where they are; a page takes its own branches of them.
        found = pages_read.join(F.broadcast(doubtful.groupBy("site").agg(*lists)), "site", "left")
        for name in ("doubtful", "low", "low_inside"):
            found = found.withColumn(name, F.array_intersect("own", name))
    else:
        asked = pages_read.select("page", F.explode("own").alias("branch"))
        found = pages_read.join(asked.join(doubtful.drop("site"), "branch").groupBy("page").agg(*lists), "page", "left")
    for name in ("doubtful", "low", "low_inside"):
        found = found.withColumn(name, F.coalesce(name, F.array().cast("array<long>")))
    # Inside an article its own branches count, and those of a named element in it with half their importance.
    below = "arrays_overlap(slice(b.branches, greatest(b.{0}, 1), size(b.branches)), {1})"
    inside = f"b.article > 0 AND NOT {below.format('article', 'low_inside')} AND NOT (b.named > 0 AND {below.format('named', 'doubtful')})"
    outside = "(b.article = 0 AND b.named = 0 AND NOT arrays_overlap(b.branches, low))"
    # What an article keeps: its important blocks, else (1) those without a name, else (2) all.
    found = found.withColumn("spared", F.expr(
        f"CASE WHEN exists(blocks, b -> NOT b.heading AND {inside}) THEN 0 WHEN exists(blocks, b -> b.article > 0 AND b.named = 0) THEN 1 ELSE 2 END"))
    inside = f"(b.article > 0 AND (spared = 2 OR spared = 1 AND b.named = 0 OR {inside}))"
    for name, kept in (("inside", inside), ("outside", outside)):
        found = found.withColumn(name, F.expr(f"filter(blocks, b -> {kept})"))
    length = "aggregate({0}, 0L, (n, b) -> n + length(b.text))"
    text = F.expr(
        f"CASE WHEN size(inside) > 0 AND {length.format('inside')} >= {length.format('outside')} THEN inside "
        f"WHEN size(outside) > 0 THEN filter(blocks, b -> {inside} OR {outside}) "
        "WHEN exists(blocks, b -> b.named = 0) THEN filter(blocks, b -> b.named = 0) ELSE blocks END")
    return found.select("id", "url", F.array_join(F.transform(text, lambda b: b["text"]), "\n").alias("text"))
