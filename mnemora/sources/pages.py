"""Web pages: canonical addresses, links, readable text, and a bounded crawl frontier."""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qsl, quote, urldefrag, urlencode, urljoin, urlsplit, urlunsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import cut

# Query parameters that only track, and the elements that hold no content.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid")
DROPPED = ("script", "style", "nav", "footer", "header", "noscript")
MIN_TEXT = 80
#: Blank cells that a table's short rows may be filled up with.
FILL = 1_000_000
BLOCKS = ("p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "main", "blockquote", "pre", "td", "th", "title", "body", "html", "a", "b", "span")


def canonical_url(url: Column) -> Column:
    """One spelling per page: lower-case scheme and host, no default port, fragment or tracking parameters, sorted parameters, single slashes."""
    bare = F.substring_index(url, "#", 1)
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*", "")
    path = F.regexp_replace(F.substring_index(rest, "?", 1), "/{2,}", "/")
    query = F.when(F.contains(rest, F.lit("?")), F.substr(rest, F.instr(rest, "?") + 1)).otherwise("")
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    kept = F.array_join(F.array_sort(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def canonical(url: str) -> str:
    """canonical_url on the driver, with parameter values re-quoted."""
    s = urlsplit(urldefrag(url).url)
    host = s.netloc.lower()
    for scheme, port in (("http", ":80"), ("https", ":443")):
        if s.scheme.lower() == scheme:
            host = host.removesuffix(port)
    pairs = sorted((k, v) for k, v in parse_qsl(s.query, keep_blank_values=True) if k.lower() not in TRACKING)
    path = s.path
    while "//" in path:
        path = path.replace("//", "/")
    return urlunsplit((s.scheme.lower(), host, path or "/", urlencode(pairs, quote_via=quote), ""))


class _Reader(HTMLParser):
    """Text by lines, tables as pipe rows, title, first h1 and links of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden, self.in_title, self.in_h1 = 0, False, False
        self.title, self.h1, self.links = "", "", []
        self.tables: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "h1" and not self.hidden:
            self.in_h1 = not self.h1
        elif tag == "a":
            href = dict(attrs).get("href")
            if href:
                self.links.append(href)
        elif tag == "table" and not self.hidden:
            if self.tables:
                self.tables[-1]["leaf"] = False
            self.tables.append({"leaf": True, "rows": [], "loose": [], "at": len(self.parts)})
        elif tag == "tr" and self.tables:
            self.tables[-1]["rows"].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]["rows"]:
                self.tables[-1]["rows"].append([])
            span = dict(attrs).get("colspan") or "1"
            self.tables[-1]["rows"][-1].append([tag, int(span) if span.isdigit() else 1, []])
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "h1":
            self.in_h1 = False
        elif tag == "table" and self.tables:
            done = self.tables.pop()
            if done["leaf"]:
                del self.parts[done["at"] :]
                self.parts.append("\n" + " ".join("".join(done["loose"]).split()) + "\n" + pipe_table(done["rows"]) + "\n")
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            if self.in_h1:
                self.h1 += data
            if self.tables and self.tables[-1]["rows"] and self.tables[-1]["rows"][-1]:
                self.tables[-1]["rows"][-1][-1][2].append(data)
            elif self.tables:  # a caption, or what stands between rows
                self.tables[-1]["loose"].append(data)
            self.parts.append(data)


def pipe_table(rows: list[list[list]]) -> str:
    """Markdown rows with the whole text of every cell; a table of one column is plain lines; blank cells keep their places.

    Short rows are filled up to the widest, unless that took more than FILL blank cells: a reader takes missing ones at a row's end as blank.
    """
    grid = [[c for tag, span, said in row for c in [" ".join("".join(said).split()).replace("|", "\\|")] + [""] * (min(span, 100) - 1)] for row in rows if row]
    if not grid or max(map(len, grid)) < 2:
        return "\n".join(c for row in grid for c in row if c)
    wide = max(map(len, grid))
    full = len(grid) * wide - sum(map(len, grid)) <= FILL
    lines = ["| " + " | ".join(r + [""] * (wide - len(r) if full or not n else 0)) + " |" for n, r in enumerate(grid)]
    return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])


def read_page(html: str | None) -> tuple[str, str, list[str]]:
    """(text, title, hrefs) of a page; what is broken is read as far as it goes."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    said = "\n".join(x for x in (" ".join(line.split()) for line in "".join(reader.parts).split("\n")) if x)
    return said, " ".join(reader.h1.split()) or " ".join(reader.title.split()), reader.links


_PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))])


#: Bytes of pages that are read before their rows go on; a longer page is alone.
READ_AT_ONCE = 4_000_000


def _links(url: str | None, hrefs: list[str]) -> list[str]:
    links = {}
    for x in hrefs:
        try:
            full = urljoin(url or "", entities.unescape(x))
            if full.startswith(("http://", "https://")):
                links[canonical(full)] = None
        except ValueError:
            continue
    return list(links)


@F.pandas_udf(_PAGE)
def parsed(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    rows = []
    for u, h in zip(url, html, strict=True):
        said, title, hrefs = read_page(h)
        rows.append((title or u, said, _links(u, hrefs)))
    return pd.DataFrame(rows, columns=["title", "text", "links"])


def _read(pages: DataFrame, links: bool) -> DataFrame:
    """page_id, uri, and either the links or title and text; each page is read once, and few are in memory at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column(3)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            _, begins, counts = np.unique((np.cumsum(size) - size) // READ_AT_ONCE, return_index=True, return_counts=True)
            for part in (batch.slice(at, n) for at, n in zip(begins, counts, strict=True)):
                each = [(u.as_py(), read_page(h.as_py())) for u, h in zip(part.column(2), part.column(3), strict=True)]
                if links:
                    out = {"links": pa.array([_links(u, hrefs) for u, (_, _, hrefs) in each], pa.list_(pa.string()))}
                else:
                    out = {"title": pa.array([title or u for u, (_, title, _) in each], pa.string()), "text": pa.array([said for _, (said, _, _) in each], pa.string())}
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *out.values()], names=["page_id", "uri", *out])

    given = pages.select("page_id", canonical_url(F.col("url")).alias("uri"), "url", "html")
    made = "links array<string>" if links else "title string, text string"
    return given.mapInArrow(rows, f"page_id {pages.schema['page_id'].dataType.simpleString()}, uri string, {made}")


def documents(pages: DataFrame) -> DataFrame:
    """page_id, uri, title, text of pages with enough text."""
    return _read(pages, links=False).where(F.length("text") >= MIN_TEXT)


def links(pages: DataFrame, hosts: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """page_id, link: distinct targets of each page within the allowed hosts and prefixes."""
    out = _read(pages, links=True).select("page_id", F.explode("links").alias("link"))
    if hosts is not None:
        out = out.where(F.regexp_extract("link", "^[a-z]+://([^/?]*)", 1).isin(*hosts))
    if prefixes is not None:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.startswith("link", F.lit(p))
        out = out.where(hit)
    return out


def default_prefix(url: Column) -> Column:
    """A start address's own folder."""
    return F.when(F.endswith(url, F.lit("/")), url).when(url.rlike("^[a-z]+://[^/]+/"), F.regexp_replace(url, "/[^/]*$", "/")).otherwise(F.concat(url, F.lit("/")))


def crawl(pages: DataFrame, start: list[str], depth: int = 3, budget: int = 1000) -> DataFrame:
    """uri, level: stored pages reached from the start addresses breadth first, each page and each text once, at most `budget`."""
    spark = pages.sparkSession
    known = cut(pages.select(canonical_url(F.col("url")).alias("uri"), F.sha2("html", 256).alias("h"), parsed("url", "html")["links"].alias("links")).dropDuplicates(["uri"]))
    seen = known.where(F.col("uri").isin([canonical(u) for u in start])).select("uri", "h", F.lit(0).alias("level"))
    front = seen
    for n in range(1, depth + 1):
        out = front.join(known, ["uri", "h"]).select(F.explode("links").alias("uri")).distinct().join(known.select("uri", "h"), "uri")
        front = cut(out.join(seen, "uri", "left_anti").join(seen.select("h"), "h", "left_anti").groupBy("h").agg(F.min("uri").alias("uri")).select("uri", "h", F.lit(n).alias("level")))
        seen = seen.union(front)
    return seen.orderBy("level", "uri").limit(budget).select("uri", "level")


def site_map(pages: DataFrame) -> DataFrame:
    """parent, child: distinct prefixes of the addresses' paths."""
    parts = F.split(F.regexp_replace(F.substring_index(canonical_url(F.col("url")), "?", 1), "^[a-z]+://", ""), "/")
    named = pages.select(F.filter(parts, lambda x: x != "").alias("p"))
    pairs = named.where("size(p) > 1").select(F.explode(F.expr("transform(sequence(1, size(p) - 1), i -> struct(array_join(slice(p, 1, i), '/') as parent, array_join(slice(p, 1, i + 1), '/') as child))")).alias("e"))
    return pairs.select("e.parent", "e.child").distinct()
