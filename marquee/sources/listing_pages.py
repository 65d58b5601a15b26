"""Listing and detail pages of sites: records out of HTML, by a table of selectors or by what repeats.

What a site's pages look like is data, rows of selectors(site, field, path): the
field ``record`` says what one record of a listing is, the others where in it a
field is. A path is steps of ``tag``, ``.class`` and ``[attribute=value]``, each
somewhere below the one before, with ``@attribute`` at the end for an attribute
instead of the text. A field may have several paths; the first that finds
something counts. Where a site has no ``record``, records are the siblings that
repeat: of all runs of siblings with one tag and class, each with a link and
words of its own, the one with most text, which the lists of a menu are not.

HTML is read in one Arrow pass; what the fields say is read by built-in
functions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from datetime import date
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import french, labels, text, times
from . import readers, structured

LEAST_RECORDS, LEAST_TEXT = 3, 20
PAGES = 64  # of a batch, read at once: what Python holds does not grow with the batch
_VOID = {"meta", "link", "img", "br", "input", "hr", "source", "wbr", "area", "base", "col", "embed"}
_CLOSED_BY = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "li", "article", "section", "table"}, "tr": {"tr"}, "td": {"td", "tr"}, "th": {"th", "td", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_CLOSERS = set().union(*_CLOSED_BY.values())
_HOLDS = {"ul", "ol", "table", "dl", "select", "article", "section", "div", "body"}  # an open li ends at the next one, but not across these
_SILENT = {"script", "style", "template", "noscript"}


class Node:
    """A node of a page; ``page`` has all of its page in order, so those under this one are page[at + 1 : end]."""

    __slots__ = ("tag", "attributes", "inside", "page", "at", "end")

    def __init__(self, tag: str, attributes: dict[str, str], page: list[Node]) -> None:
        self.tag, self.attributes, self.page, self.at = tag, attributes, page, len(page)
        self.inside: list = []  # nodes and strings
        self.end = 0
        page.append(self)

    @property
    def nodes(self) -> list[Node]:
        return [x for x in self.inside if isinstance(x, Node)]

    @property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def below(self) -> list[Node]:
        """All nodes under this one, in the order of the page."""
        return self.page[self.at + 1 : self.end]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in _SILENT:
                todo += x.inside[::-1]
        return " ".join(" ".join(out).split())


class _Tree:
    """A tree that forgives: ends nobody opened are ignored, and what may be left open ends where it must."""

    def __init__(self) -> None:
        self.page: list[Node] = []
        self.open = [Node("", {}, self.page)]

    def close(self, at: int) -> None:
        for node in self.open[at:]:
            node.end = len(self.page)
        del self.open[at:]

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in _CLOSERS:
            for at in range(len(self.open) - 1, 0, -1):
                if tag in _CLOSED_BY.get(self.open[at].tag, ()):
                    self.close(at)
                elif self.open[at].tag in _HOLDS:
                    break
        node = Node(tag, attributes, self.page)
        self.open[-1].inside.append(node)
        if tag in _VOID:
            node.end = len(self.page)
        else:
            self.open.append(node)

    def stop(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self.close(at)
                break

    def root(self) -> Node:
        root = self.open[0]
        self.close(0)
        return root


class _Reader(HTMLParser):
    """Any page, event by event."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tree = _Tree()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tree.start(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tree.stop(tag)

    def handle_data(self, data: str) -> None:
        self.tree.open[-1].inside.append(data)


_ATTRIBUTE = r"""[ \t\r\n]+([a-zA-Z_][\w:.-]*)(?:=(?:"([^"&]*)"|'([^'&]*)'|([^\s"'`=<>&]+)))?"""
_ATTRIBUTES = re.compile(_ATTRIBUTE, re.A)
_TOKEN = re.compile(rf"([^<]+)|</([a-zA-Z][a-zA-Z0-9:-]*)[ \t\r\n]*>|<([a-zA-Z][a-zA-Z0-9:-]*)((?:{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)})*)[ \t\r\n]*(/?)>|<!--(?:[^->]|-(?!-))*-->|<![dD][oO][cC][tT][yY][pP][eE] [^<>\"'\[]*>", re.A)
_RAW = {tag: re.compile(rf"([^<]*(?:<(?![/!])[^<]*)*)</{tag}>") for tag in ("script", "style")}  # their text is never read
_ODD = {"title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "svg", "math"}  # what is inside is read in other ways by some versions of the parser


def _plain(page: str) -> Node | None:
    """The tree of a page of nothing but plain tags, texts and comments, as _Reader makes it; None for any other page."""
    tree, at, n = _Tree(), 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:
            return None
        at = m.end()
        text, stop, start, attributes, empty = m.groups()
        if text is not None:
            tree.open[-1].inside.append(unescape(text) if "&" in text else text)
        elif stop is not None:
            tree.stop(stop.lower())
        elif start is not None:
            tag = start.lower()
            if tag in _ODD:
                return None
            tree.start(tag, {k.lower(): x or y or z for k, x, y, z in _ATTRIBUTES.findall(attributes)} if attributes else {})
            if empty and tag in _RAW:
                return None
            if empty and tag not in _VOID:
                tree.stop(tag)
            elif tag in _RAW:
                m = _RAW[tag].match(page, at)
                if m is None:
                    return None
                at = m.end()
                tree.open[-1].inside.append(m[1])
                tree.stop(tag)
    return tree.root()


def tree(page: str) -> Node:
    if (root := _plain(page)) is not None:
        return root
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return reader.tree.root()


_STEP = re.compile(r"\[([\w:-]+)(?:=([^\]]*))?\]|\.([\w-]+)|([\w*-]+)")


@lru_cache(1024)
def _parts(step: str) -> list[tuple]:
    return [(attribute, value.strip("\"'"), class_, tag, bool(value)) for attribute, value, class_, tag in _STEP.findall(step)]


def _fitting(page: list[Node], step: str) -> list[int]:
    """Where the nodes of a step are."""
    places: Iterable[int] = range(len(page))
    for attribute, value, class_, tag, valued in _parts(step):
        if tag and tag != "*":
            places = [i for i in places if page[i].tag == tag]
        if class_:
            places = [i for i in places if class_ in page[i].attributes.get("class", "") and class_ in page[i].classes]
        if attribute:
            places = [i for i in places if attribute in page[i].attributes]
        if valued:
            places = [i for i in places if value == (has := page[i].attributes[attribute]) or value in has.split()]
    return list(places)


@lru_cache(1024)
def _steps(path: str) -> list[str]:
    return path.split()


def found(root: Node, path: str, known: dict[str, list[int]] | None = None) -> list[Node]:
    """The nodes of a path without its ``@attribute``, in the order of the page; known: where the nodes of a step are in this page, as far as it was asked for."""
    known, page, level = {} if known is None else known, root.page, [root]
    for step in _steps(path):
        if (fit := known.get(step)) is None:
            fit = known[step] = _fitting(page, step)
        hits, reach = [], 0
        for x in level:  # in order, so a node inside an earlier one of the level adds nothing
            if x.end > reach:
                hits += fit[bisect_right(fit, max(x.at, reach - 1)) : bisect_left(fit, x.end)]
                reach = x.end
        level = [page[i] for i in hits]
    return level


@lru_cache(1024)
def _halves(path: str) -> tuple[str, str]:
    steps, _, attribute = path.partition("@")
    return steps.strip(), attribute


def value(root: Node, paths: list[str], known: dict[str, list[int]] | None = None) -> str | None:
    """The first text or attribute that is not empty, of the first path that has one."""
    for path in paths:
        steps, attribute = _halves(path)
        for node in found(root, steps, known) if steps else [root]:
            if got := node.attributes.get(attribute, "").strip() if attribute else node.text():
                return got
    return None


def repeated(root: Node) -> list[Node]:
    """The records of a page that says nothing of them: the siblings alike with most text."""
    best: tuple[int, list[Node]] = (0, [])
    for parent in (root, *root.below()):
        alike: dict[tuple, list[Node]] = defaultdict(list)
        for node in parent.nodes:
            alike[node.tag, *node.classes[:1]].append(node)
        for nodes in alike.values():
            if len(nodes) < LEAST_RECORDS:
                continue
            texts = [n.text() for n in nodes if any(x.tag == "a" and "href" in x.attributes for x in (n, *n.below()))]
            if len(texts) * 5 >= len(nodes) * 4 and median(map(len, texts)) >= LEAST_TEXT and (size := sum(map(len, texts))) > best[0]:
                best = (size, nodes)
    return best[1]


def records(page: str, paths: dict[str, list[str]], whole: bool = False) -> list[dict[str, str]]:
    """The fields of each record of a page; ``whole``: the page is one record."""
    root, known = tree(page), {}
    nodes = [root] if whole else found(root, paths["record"][0], known) if "record" in paths else repeated(root)
    out = []
    for node in nodes:
        fields = {name: got for name, some in paths.items() if name != "record" and (got := value(node, some, known)) is not None}
        if fields:
            out.append(fields)
    return out


def read(pages: DataFrame, selectors: DataFrame, whole: bool = False) -> DataFrame:
    """(key, pos, fields) of every record in pages(site, key, value); selectors(site, field, path, rank) are joined to the pages, so a site without any gives nothing.

    A page that is null or no HTML has no records; a record none of whose paths finds anything is left out.
    """
    kind = dict(pages.dtypes)["key"]
    ordered = F.array_sort(F.collect_list(F.struct("field", "rank", "path")))
    by_site = selectors.groupBy("site").agg(ordered.alias("paths"))
    held = pages.join(by_site, "site").select("key", F.col("value").cast("string").alias("value"), "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole_batch.slice(at, PAGES) for whole_batch in batches for at in range(0, whole_batch.num_rows, PAGES)):
            keys, pos, fields = [], [], []
            for i, (page, rows) in enumerate(zip(batch.column("value").to_pylist(), batch.column("paths").to_pylist(), strict=True)):
                paths: dict[str, list[str]] = {}
                for r in rows:
                    paths.setdefault(r["field"], []).append(r["path"])
                got = records(page or "", paths, whole)
                keys += [i] * len(got)
                pos += range(len(got))
                fields += [list(x.items()) for x in got]
            yield pa.record_batch({"key": batch.column("key").take(pa.array(keys, pa.int64())), "pos": pa.array(pos, pa.int32()), "fields": pa.array(fields, pa.map_(pa.string(), pa.string()))})

    return held.mapInArrow(run, f"key {kind}, pos int, fields map<string,string>")


def absolute(url: Column, base: Column) -> Column:
    """A link as a page has it, as an address; mail and script links are null."""
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return (
        F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).when(url.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), url)).when(url.rlike("^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
        .when(url.startswith("/"), F.concat(root, url)).otherwise(F.concat(F.regexp_extract(F.concat(F.regexp_replace(base, "[?#].*$", ""), F.when(base.rlike("^[^:]*://[^/]*$"), "/").otherwise("")), "^(.*/)", 1), url))
    )


def events(rows: DataFrame, base: Column, today: date) -> DataFrame:
    """key, pos, url, title, start_date, end_date, time_known, price_min, price_max, price_status, venue_name, venue_zip, is_cancelled of read(); a record without title or start is none.

    ``start`` and ``end`` are as machines write them, ``when`` as people do; a midnight stands for no time. ``low`` and ``high``
    are amounts, ``price`` a text with some; ``status`` may say that it is cancelled.
    """
    f = lambda name: F.try_element_at("fields", F.lit(name))
    first, last = labels.instant(f("start"), midnight_unknown=True), labels.instant(f("end"), is_end=True, midnight_unknown=True)
    at = lambda day, clock: times.from_paris(F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm")))
    titled = rows.where(F.trim(f("title")) != "").select("key", "pos", "fields", readers.price(F.coalesce(f("price"), F.lit(""))).alias("price"))
    x = text.once(titled, "key", "pos", "fields", "price", first.alias("first"), last.alias("last"), french.dates(f("when"), today).alias("said"), *(structured.cents(f(x)).alias(x) for x in ("low", "high")))
    x = text.once(x, "*", at(F.col("said.start"), F.coalesce("said.time", F.lit("12:00"))).alias("begins"), at(F.col("said.end"), F.lit("23:59")).alias("ends"))
    out = x.select(
        "key", "pos", absolute(f("url"), base).alias("url"), F.trim(f("title")).alias("title"), F.coalesce("first.at", "begins").alias("start_date"), F.coalesce("last.at", F.when(F.col("first.at").isNull(), F.col("ends"))).alias("end_date"),
        F.when(F.col("first.at").isNotNull(), F.col("first.time_known")).otherwise(F.col("said.time").isNotNull()).alias("time_known"), F.coalesce("low", "high", "price.min").alias("min"), F.coalesce("high", "low", "price.max").alias("max"), F.when(F.coalesce("high", "low") == 0, "free").when(F.coalesce("high", "low").isNotNull(), "paid").otherwise(F.col("price.status")).alias("status"), f("venue").alias("venue_name"), text.zip_code(f("zip")).alias("venue_zip"),
        F.coalesce(F.lower(f("status")).contains("cancel"), F.lit(False)).alias("is_cancelled"),
    )
    return out.withColumnsRenamed({"min": "price_min", "max": "price_max", "status": "price_status"}).where("start_date is not null")
