"""Main text of web pages by the consensus of their host.

Pages of a host share a layout. Each page scores its containers by the text
below them and votes for the path of the best one: tags and classes from the
body down, digits taken out. Spark counts the votes of each host, and every page is
read again from the container that has its host's most voted path.
"""

from __future__ import annotations

import html as html_library
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.llm.tables import whole_text
from tabsieve.plans.held import hold
from tabsieve.plans.lookup import HOT_SHARE, lookup, measured_bytes

#: Winning paths of a host. A page that has none of them is read by its own best.
WINNERS = 8
#: Containers nested deeper than this are part of the one around them.
DEPTH = 64
#: What a container gets of the score of a container inside it, and how much more
#: one counts that is named as content.
DECAY, NAMED = 0.75, 1.25

#: Fixed values of HTML: elements by their role in the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre address figcaption caption tr summary hr".split())
CONTAINERS = frozenset(
    "article aside center details dialog div dl fieldset figure footer form header hgroup main menu nav ol section table tbody td tfoot th thead ul".split()
)
HEAD = frozenset("title meta link style script base noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes, and the elements beyond which it does not look.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: Elements, roles and names that are not part of an article.
MUTED_TAGS = RAW | frozenset("nav footer aside form head noscript template svg math object audio video canvas button select dialog menu".split())
MUTED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
MUTED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "banner popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond "
    "reply replies share sharing social related recommended newsletter subscribe subscription login signup toolbar pagination pager widget".split()
)
CONTENT_NAMES = frozenset("article content main post entry story body text".split())
#: A name after one of these words says what a page has or lacks, not what it is.
ABOUT = frozenset("has with no without".split())

TOKEN = re.compile(
    r"""(?P<skip><!--(?:-?>|.*?(?:--!?>|\Z)))"""
    r"""|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)"""
    r"""|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|(?P<bogus><[!?/][^>]*(?:>|\Z))"""
    r"""|(?P<text>[^<]+|<)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Containers and blocks of a page, in page order.

    ``containers`` are ``(path, place of the parent, factor of the score)``, the first is the
    body; ``blocks`` are ``(place of the container, text, characters outside of links)``.
    """

    def __init__(self, source: str):
        self.containers: list[tuple[str, int, float]] = [("", -1, 1.0)]
        self.blocks: list[tuple[int, str, int]] = []
        # Open elements: tag, place of its container, whether it ends a block, muted (1:
        # all but headings, 2: all), inside of a heading, inside of a link.
        self._open: list[tuple[str, int, bool, int, bool, bool]] = [("", 0, True, 0, False, False)]
        self._count: Counter[str] = Counter()  # open elements by tag
        self._depth = [0]  # of each container
        self._words: list[str] = []
        self._linked = 0
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = TOKEN.match(source, at)
            at = found.end()
            kind = found.lastgroup
            if kind == "text":
                self._text(found.group())
            elif kind == "rest":
                tag = found["tag"].lower()
                self._start(tag, found["rest"])
                if tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
                    at = close.start() if close else size
            elif kind == "end":
                self._end(found["end"].lower())

    def _text(self, text: str) -> None:
        _, _, _, muted, heading, linked = self._open[-1]
        if muted == 2 or (muted and not heading):
            return
        if "&" in text:
            text = html_library.unescape(text)
        self._words.append(text)
        if linked:
            self._linked += len("".join(text.split()))

    def _flush(self) -> None:
        if self._words:
            text = " ".join("".join(self._words).split())
            if text:
                weight = len("".join(text.split())) - self._linked
                self.blocks.append((self._open[-1][1], text, max(0, weight)))
            self._words.clear()
        self._linked = 0

    def _start(self, tag: str, rest: str) -> None:
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            elif tag == "hr":
                self._close("p", ())
                self._flush()
            return
        if tag in ("html", "body"):
            self._close("head", ())
            return
        if tag not in HEAD:
            self._close("head", ())
        block = tag in PARAGRAPHS or tag in CONTAINERS
        if block:
            self._close("p", ())
        for other in CLOSES.get(tag, ()):
            self._close(other, LIMITS[tag])
        _, place, _, muted, heading, linked = self._open[-1]
        label, names, role = self._names(tag, rest) if block or "=" in rest else (tag, (), "")
        muted = max(muted, self._muted(tag, names, role))
        if block:
            self._flush()
            if tag in CONTAINERS and self._depth[place] < DEPTH:
                self._depth.append(self._depth[place] + 1)
                parent = self.containers[place][0]
                named = tag in ("article", "main") or role == "main" or not CONTENT_NAMES.isdisjoint(names)
                self.containers.append((f"{parent}/{label}" if parent else label, place, NAMED if named else 1.0))
                place = len(self.containers) - 1
        self._count[tag] += 1
        self._open.append((tag, place, block, muted, heading or tag in HEADINGS, linked or tag == "a"))

    def _names(self, tag: str, rest: str) -> tuple[str, tuple[str, ...], str]:
        """The label of the path, the words of class and id, and the role."""
        classes, names, role = [], [], ""
        for a in ATTRIBUTE.finditer(rest):
            value = next((v for v in a.groups()[1:] if v is not None), "")
            if a[1].lower() == "role":
                role = value.strip().lower()
                continue
            for word in value.split():
                parts = [p.lower() for p in NAME.findall(word)]
                names += parts if ABOUT.isdisjoint(parts) else []
                if a[1].lower() == "class":
                    classes.append(re.sub(r"[\d/]+", "", word))
        return ".".join([tag, *sorted({c for c in classes if c})]), tuple(names), role

    def _muted(self, tag: str, names: tuple[str, ...], role: str) -> int:
        if tag in MUTED_TAGS or role in MUTED_ROLES or not MUTED_NAMES.isdisjoint(names):
            return 0 if tag in ("article", "main") and tag not in MUTED_TAGS and "comment" not in names and "comments" not in names else 2
        if tag == "header" or "header" in names:
            return 1 if self._count["article"] or self._count["main"] else 2
        return 0

    def _close(self, tag: str, limits: tuple[str, ...]) -> None:
        """Closes the innermost open ``tag``, if it is not behind a limit; a
        paragraph only if nothing but inline elements is open inside it."""
        if not self._count[tag]:
            return
        for i in range(len(self._open) - 1, 0, -1):
            name, _, block, *_ = self._open[i]
            if name == tag:
                self._pop(i)
                return
            if name in limits or (tag == "p" and block):
                return

    def _end(self, tag: str) -> None:
        if not self._count[tag]:
            return
        for i in range(len(self._open) - 1, 0, -1):
            name, _, block, *_ = self._open[i]
            if name == tag:
                self._pop(i)
                return
            # An inline end tag does not reach out of its block, and none out of a cell.
            if name in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or (block and tag not in PARAGRAPHS | CONTAINERS):
                return

    def _pop(self, i: int) -> None:
        if any(e[2] for e in self._open[i:]):
            self._flush()
        for e in self._open[i:]:
            self._count[e[0]] -= 1
        del self._open[i:]

    def best(self) -> str | None:
        """The path of the best container; the first one in page order among equals."""
        scores = [0.0] * len(self.containers)
        for place, _, weight in self.blocks:
            scores[place] += weight
        for place in range(len(scores) - 1, 0, -1):
            scores[self.containers[place][1]] += DECAY * scores[place]
        scores = [s * c[2] for s, c in zip(scores, self.containers, strict=True)]
        top = max(scores)
        return self.containers[scores.index(top)][0] if top > 0 else None

    def text_of(self, path: str) -> list[str]:
        """Blocks inside of the containers with this path."""
        inside = []
        for own, parent, _ in self.containers:
            inside.append(own == path or (parent >= 0 and inside[parent]))
        return [text for place, text, _ in self.blocks if inside[place]]


def main_blocks(source: str, winners: list[str]) -> list[str]:
    """The blocks of the page's main text, by the first of the winning paths that
    it has, else by its own best one."""
    page = Page(source)
    for path in winners:
        found = page.text_of(path)
        if found:
            return found
    own = page.best()
    return page.text_of(own) if own is not None else [text for _, text, _ in page.blocks]


def host_of(url: Column) -> Column:
    """The host in lower case without user and port; NULL where there is none."""
    found = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]+)", 1))
    return F.when(found != "", found)


def winning_paths(hosts: DataFrame) -> DataFrame:
    """``(host, paths, pages)`` from ``(host, html)``: up to WINNERS paths by falling
    votes, equal ones by their text, joined by line feeds, and the voting pages.

    Votes are added up inside the tasks, so a host with a third of all pages costs
    no more than its different paths.
    """

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [Page(h).best() for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    votes = hosts.where("host IS NOT NULL").mapInArrow(vote, "host string, path string")
    counted = votes.where("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("host").orderBy(F.col("votes").desc(), "path")
    ranked = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= WINNERS)
    paths = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda p: p["path"]), "\n")
    return ranked.groupBy("host").agg(paths.alias("paths"), F.sum("votes").alias("pages"))


def main_text(pages: DataFrame, html: str = "html", url: str = "url", text: str = "main_text") -> DataFrame:
    """The columns of ``pages`` except ``html``, and the main text as ``text``.

    A missing page is empty, and an empty page or one without text outside of menus,
    notices and the like gives an empty text. A page without a host, or with none of the host's
    winning paths, is read by its own best container. Every row gives a row, repeated
    ones too. A column that has the name of ``text`` already is replaced.

    Blocks are elements that a browser starts on a new line, and table cells; ``br`` is
    white space. Headings inside of an article's header stay.
    """
    spark = pages.sparkSession
    kept = [f for f in pages.schema.fields if f.name not in (html, text)]
    rows = pages.select(
        F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row"), host_of(F.col(f"`{url}`").cast("string")).alias("host"), whole_text(html).alias("html")
    )
    winners = hold(winning_paths(rows.select("host", "html")), "host-paths")
    total = winners.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    hot = winners.where(F.col("pages") * HOT_SHARE >= total).select("host")
    known = lookup(rows, F.col("host"), winners.select("host", "paths"), "host", measured_bytes(winners.select("host", "paths")), hot)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                texts.append("\n".join(main_blocks(source, [] if paths is None else paths.split("\n"))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    shape = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("text", T.StringType())])
    made = spark.createDataFrame([], shape) if not kept else known.select("row", "html", "paths").mapInArrow(read, shape)
    return made.select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in kept], F.col("text").alias(text))
