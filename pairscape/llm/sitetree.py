"""Main text of web pages by site style trees.

Pages of a host are merged into one tree of presentation nodes (tag, class and id
of the elements around a block, digits left out). Over the host's pages a node is
important if its pages differ there:

* content: 1 less the mean, over the node's distinct texts, of log(pages with the
  text) / log(pages); a text on every page adds 0, one that is on a single page 1;
* presentation: the entropy of the sequences of child elements that its parent has
  on the pages, to the base of their number.

The larger of both is the importance; blocks at nodes below ``THRESHOLD`` are
removed on every page of the host. So is a single text at an important node if 1
less log(pages with the text) / log(pages of the host) is below it. Tags and names
come first: code, navigation, forms and elements that a class, id or role names as
an advert, notice, comment and the like have importance 0, but no name counts for
an element that holds an article or main element. Paragraphs of an article or main
element are judged text by text, and all stay if none would be left of a page, as on
copies of one page. Hosts with few pages say nothing about a node; it then stays.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import runs

THRESHOLD, LEAST_PAGES = 0.3, 8
#: The table of unimportant nodes is broadcast up to so many characters; beyond, pages are joined by host.
BROADCAST_CHARS = 4 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:_-]*)(?P<attrs>(?>[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<text>[^<]+|<)", re.S
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECE = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")

# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes object".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table tr select menu article section div body".split())
# Branches that are never main text, and paragraphs that always are inside an article.
_NEVER = frozenset("nav aside footer form button select head dialog menu fieldset input".split())
_MAIN = frozenset(("article", "main"))
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption article main".split())
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion cookie cookies consent gdpr comment comments disqus "
    "reply replies respond sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social newsletter subscribe subscription "
    "signup login popup modal overlay related recommended recommendations trending notice notices alert toolbar pagination pager tags widget widgets copyright disclaimer".split()
)


def _marks(attrs: str) -> tuple[str, frozenset[str]]:
    """The signature of an element's class and id, and the lower-case words of its class, id and role."""
    sign, words = "", set()
    for m in _ATTR.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        words.update(_PIECE.findall(value))
        if m[1].lower() != "role":
            sign += ("." if m[1].lower() == "class" else "#") + ".".join(sorted(_DIGITS.sub("", value).split()))
    return sign, frozenset(words)


class Page:
    """Blocks of a page: (path, 0 if settled as noise, 1 for prose of an article, or None, text), and the child elements of each parent path."""

    def __init__(self, source: str | None):
        self.children: dict[str, list[str]] = {}
        # an element: tag, path, settled as noise by a tag, inside an article or main element, numbers of the noise names around it
        self.stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = [("", "", False, False, ())]
        self.parts: list[str] = []
        self.found: list[tuple[str, bool, tuple[int, ...], bool, str]] = []
        self.names, self.void_names = 0, set()
        self._read(source or "")
        self._flush()
        self.blocks: list[tuple[str, float | None, str]] = [
            (path, 0.0 if by_tag or not self.void_names.issuperset(names) else 1.0 if prose else None, text) for path, by_tag, names, prose, text in self.found
        ]

    def _flush(self) -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()
        self.parts = []
        if text:
            tag, path, by_tag, inside, names = self.stack[-1]
            self.found.append((path, by_tag, names, inside and tag in _PROSE, text))

    def _close(self, tags: tuple[str, ...] | frozenset[str], until: frozenset[str] = frozenset()) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                self._flush()
                del self.stack[i:]
                return
            if self.stack[i][0] in until:
                return

    def _open(self, tag: str, attrs: str) -> None:
        if tag in _CLOSES_P:
            self._close(("p",), _SCOPES)
        if tag in _SIBLINGS:
            if tag == "tr":
                self._close(("td", "th"), _SCOPES)
            self._close(_SIBLINGS[tag], _SCOPES - {"tr"} if tag == "tr" else _SCOPES)
        self._flush()
        sign, words = _marks(attrs) if attrs else ("", frozenset())
        _, path, by_tag, inside, names = self.stack[-1]
        self.children.setdefault(path, []).append(tag + sign)
        if tag in _MAIN:
            self.void_names.update(names)
        in_article = inside or tag in _MAIN
        by_tag = by_tag or tag in _NEVER or (tag == "header" and not in_article)
        if (words & _NOISE or ("header" in words and not in_article)) and tag not in ("html", "body") and tag not in _MAIN:
            self.names += 1
            names = (*names, self.names)
        self.stack.append((tag, f"{path}>{tag}{sign}", by_tag, in_article, names))

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = _TOKEN.match(source, at)
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["text"] is not None:
                    self.parts.append(m["text"])
                continue
            tag = tag.lower()
            if m["end"]:
                if tag == "p" or tag not in _INLINE:
                    self._close((tag,))
                continue
            if tag in _RAW and not m["attrs"].endswith("/"):
                stop = re.compile(rf"</{tag}\s*>|\Z", re.I).search(source, at)
                at = stop.end()
            elif tag in _VOID or tag in _RAW:
                if tag == "br" or tag == "hr":
                    self.parts.append(" ")
                    if tag == "hr":
                        self._flush()
            elif tag not in _INLINE:
                self._open(tag, m["attrs"])


def host_of(url):
    """The host of a URL column in lower case; an empty string where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def text_key(path: str, text: str) -> str:
    """A text at a node; paths have no line feeds."""
    return f"{path}\n{xxhash.xxh3_64_intdigest(text) - 2**63}"


def unimportant_nodes(pages: DataFrame) -> DataFrame:
    """(host, path) of the nodes of each site style tree below the threshold, and of single texts below it as ``text_key``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column("html").to_pylist()
            for a, b in runs(sources):
                cols: list[list] = [[], [], [], []]
                for i in range(a, b):
                    page = Page(sources[i])
                    seen = {(path, 1 if settled is None else 3, xxhash.xxh3_64_intdigest(text) - 2**63) for path, settled, text in page.blocks if settled != 0}
                    paths = {path for path, kind, _ in seen if kind == 1}
                    if seen:
                        seen.add(("", 4, 0))
                    for path in paths:
                        parent = path.rsplit(">", 1)[0]
                        style = xxhash.xxh3_64_intdigest(" ".join(page.children.get(parent, ()))) - 2**63
                        seen = seen | {(path, 0, 0), (path, 2, style)}
                    for path, kind, feature in seen:
                        for c, v in zip(cols, (i, path, kind, feature), strict=True):
                            c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([batch.column("host").take(pa.array(cols[0])), pa.array(cols[1]), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["host", "path", "kind", "feature"])

    found = pages.select("host", "html").mapInArrow(rows, "host string, path string, kind int, feature long")
    counts = stored(found.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("pages")))
    # kind 0 has the number of pages, 1 the texts, 2 the styles of the parent, 3 the texts of an article's prose, 4 the pages of the host
    n, log = F.sum(F.when(F.col("kind") == 0, F.col("pages"))), F.log(F.col("pages").cast("double"))
    nodes = counts.where("kind < 3").groupBy("host", "path").agg(
        n.alias("n"), F.avg(F.when(F.col("kind") == 1, log)).alias("same"), F.sum(F.when(F.col("kind") == 2, F.col("pages") * log)).alias("styles"),
    )
    content = 1 - F.col("same") / F.log("n")
    presentation = 1 - F.col("styles") / (F.col("n") * F.log("n"))
    low = nodes.where(F.col("n") >= LEAST_PAGES).where(F.greatest(content, presentation) < THRESHOLD).select("host", "path")
    sites = counts.where(f"kind = 4 and pages >= {LEAST_PAGES}").select("host", F.col("pages").alias("all"))
    # a text on fewer pages is important on every host that is large enough
    often = counts.where(F.col("kind").isin(1, 3) & (log > (1 - THRESHOLD) * math.log(LEAST_PAGES)))
    texts = often.join(sites, "host").where(1 - log / F.log(F.col("all").cast("double")) < THRESHOLD)
    return low.unionByName(texts.select("host", F.concat_ws("\n", "path", F.col("feature").cast("string")).alias("path")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each row of ``pages`` (page_id, url, html).

    ``text`` is empty where nothing is left, as for null or empty html. Rows without
    a host form a site of their own; repeated rows each have a result.
    """
    pages = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    noise = stored(unimportant_nodes(pages))
    size = noise.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0
    by_host = noise.groupBy("host").agg(F.collect_set("path").alias("noise"))
    joined = pages.join(F.broadcast(by_host) if size <= BROADCAST_CHARS else by_host, "host", "left")

    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, noises in batches:
            out = []
            for source, gone in zip(sources, noises, strict=True):
                gone = set(gone) if gone is not None else ()
                blocks = [x for x in Page(source).blocks if x[1] != 0]
                kept = [(settled == 1 or path not in gone) and text_key(path, text) not in gone for path, settled, text in blocks]
                prose = any(keep and x[1] == 1 for keep, x in zip(kept, blocks, strict=True))
                out.append("\n\n".join(x[2] for keep, x in zip(kept, blocks, strict=True) if keep or (x[1] == 1 and not prose)))
            yield pd.Series(out, dtype=object)

    return joined.select("page_id", "url", F.pandas_udf(extract, "string", F.PandasUDFType.SCALAR_ITER)("html", "noise").alias("text"))
