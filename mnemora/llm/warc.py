"""WARC derivatives: linked metadata and plain-text conversion records (operator 6).

Input are response records (WARC/1.1 bytes); for each, the builder writes one
``metadata`` record (title, charset, links, the source's headers and digests as
warc-fields) and one ``conversion`` record (the page's plain text). Both name the
response in WARC-Refers-To (the metadata record in WARC-Concurrent-To too), keep its
target and date, and carry digests of their own block; identifiers are derived
from the source's, so running twice writes the same records. The records are written
as WARC images, a gzip member each after a warcinfo record, and read back by the
images' index.

HTTP payloads that are chunked, gzip or deflate are decoded first; digests are of the payload
as it was sent.

Scale: one pass, no shuffle; a record is held in memory with its derivatives, an image
until it has ``IMAGE_BYTES``. The page scanner reads every character once, whatever
the markup: a quote or tag that nothing closes costs one look at the rest of the page.

Defined cases: a null page is an empty payload, a null url leaves out the target; a
page of any length is converted whole but for nav, footer and what is not shown (an
unclosed head holds its title, scripts and the like, other unclosed elements nothing); a
tag whose quotes do not close ends at its first >, a < without any > is text; repeated
pages give repeated records; bytes that are no UTF-8 are replaced; a record that is no
valid response, or whose payload is not encoded as its header says, gives one row of
type ``error`` with the reason and no record; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import read_table, stored

VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
#: Source headers that the derivatives' own say; all others are kept in the metadata record.
RESTATED = ("warc-type", "warc-record-id", "warc-date", "warc-target-uri", "content-type", "content-length")
#: A payload may unfold to so many bytes; beyond, its page has an error row.
UNFOLDED_BYTES = 256 << 20
IMAGE_BYTES = 8 << 20
RAW = ("script", "style")
HIDDEN = ("noscript", "template", "svg", "nav", "footer", "head")
BLOCK = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header main aside blockquote pre hr dd dt dl".split())
#: The next <: of a plain tag (no < or >, even quoted), with its name; else alone.
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>"'<]*)(?:[^<>"']|"[^"<>]*"|'[^'<>]*')*>|)""")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)?")
_RAW_END = {x: re.compile(rf"</{x}[\s/>]", re.I) for x in (*RAW, "title")}
_BLANK = re.compile(r"[ \t\r\f\v\xa0]{2,}|[\t\r\f\v\xa0]")
_LINES = re.compile(r" ?\n[ \n]*")
#: Paths that only need their origin.
_ROOTED = re.compile(r"/(?:[^/.?#;\s][^/?#;\s]*(?:/[^/.?#;\s][^/?#;\s]*)*/?)?")
_HREF = re.compile(r"""[\s"'/]href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}".encode() for k, v in headers), b"Content-Length: %d" % len(block), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def read_record(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers in order, and the block; ValueError where the record is broken."""
    head, cut, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not cut or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = []
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("a header without a colon")
        headers.append((name.strip(), value.strip()))
    size = next((v for k, v in headers if k.lower() == "content-length"), "")
    if not size.isdigit() or len(rest) < int(size):
        raise ValueError("a block shorter than its Content-Length")
    return headers, rest[: int(size)]


def response(page_id, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """A response record of a page."""
    payload = (page or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    sum_ = digest(payload)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", identifier("response", str(page_id), url or "", date, sum_)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    return write_record([*headers, ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(http + payload)), ("WARC-Payload-Digest", sum_)], http + payload)


class Page:
    """A page's pieces in order: texts (start, end), tags (start, end, name, whether it closes) and titles, found in one pass."""

    def __init__(self, page: str):
        self.page = page
        self.pieces: list[tuple[int, int, str | None, bool]] = []
        self.quoted = True
        self.last = {q: page.rfind(q) for q in "\"'"}
        self._scan()

    def _tag_end(self, at: int) -> int:
        """Where the tag that begins at `at` has its >, or -1."""
        page, to = self.page, self.page.find(">", at)
        if to < 0 or not self.quoted:
            return to
        first, here = to, at
        while True:
            marks = [m for q in "\"'" if (m := page.find(q, here, to)) >= 0]
            if not marks:
                return to
            mark = min(marks)
            if mark == self.last[page[mark]]:  # it closes nowhere: an ordinary character
                here = mark + 1
                continue
            here = page.find(page[mark], mark + 1) + 1
            if here > to:
                to = page.find(">", here)
                if to < 0:  # from now on a tag ends at its first >
                    self.quoted = False
                    return first

    def _scan(self) -> None:
        page, at, text, unclosed = self.page, 0, 0, set()
        add = self.pieces.append
        while m := _TAG.search(page, at):
            lt = m.start()
            if m[2]:
                end, name, closes = m.end(), m[2].lower(), m[1] == "/"
            elif page.startswith("<!--", lt):
                add((text, lt, None, False))
                end = page.find("-->", lt + 4)
                at = text = len(page) if end < 0 else end + 3
                add((lt, at, "!", False))
                continue
            else:
                follows = page[lt + 1 : lt + 2]
                if not (follows.isascii() and follows.isalpha() or follows in ("/", "!", "?")):
                    at = lt + 1
                    continue
                end = self._tag_end(lt) + 1
                if not end:
                    break
                closes = follows == "/"
                name = (_NAME.match(page, lt + 1)[1] or "").lower() if follows not in ("!", "?") else "!"
            add((text, lt, None, False))
            at = text = end
            add((lt, at, name, closes))
            if name in _RAW_END and not closes and name not in unclosed:
                close = _RAW_END[name].search(page, at)
                if close is None:
                    unclosed.add(name)
                if close or name in RAW:
                    to = close.start() if close else len(page)
                    add((at, to, "=" + name, False))
                    at = text = to
        add((text, len(page), None, False))

    def title(self) -> str:
        a, b = next(((a, b) for a, b, name, _ in self.pieces if name == "=title"), (0, 0))
        return html.unescape(" ".join(self.page[a:b].split()))

    def text(self) -> str:
        """Visible text: blocks on lines of their own, runs of blanks as one, character references resolved."""
        closing: dict[str, list[int]] = {}
        for k, (_, _, name, closes) in enumerate(self.pieces):
            if closes and name in HIDDEN:
                closing.setdefault(name, []).append(k)
        out, k = [], 0
        while k < len(self.pieces):
            a, b, name, closes = self.pieces[k]
            k += 1
            if name is None:
                out.append(self.page[a:b])
            elif name[:1] in ("=", "!") or name in _RAW_END:
                out.append(" ")
            elif name in HIDDEN and not closes:
                ends = closing.get(name, [])
                at = bisect_left(ends, k)
                if at < len(ends):  # hidden up to its end; of an unclosed element only the tag goes
                    k = ends[at] + 1
                    out.append(" ")
            elif name in BLOCK:
                out.append("\n")
            elif closes and name in ("td", "th"):
                out.append("\t")
        return _LINES.sub("\n", _BLANK.sub(" ", html.unescape("".join(out)))).strip()

    def links(self, base: str | None) -> list[str]:
        """Targets of the page's anchors in order, absolute, each once."""
        out = {}
        origin = re.match(r"https?://[^/?#]+", base or "")
        for a, b, name, closes in self.pieces:
            if name != "a" or closes:
                continue
            m = _HREF.search(self.page, a, b)
            target = html.unescape(m[1] or m[2] or m[3] or "").strip() if m else ""
            if target and not target.startswith(("#", "javascript:", "mailto:", "data:")):
                if origin and _ROOTED.fullmatch(target):
                    out[origin[0] + target] = None
                    continue
                try:
                    out[urljoin(base or "", target)] = None
                except ValueError:
                    continue
        return list(out)


def plain_text(page: str) -> str:
    return Page(page).text()


def unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = body[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not size or len(size) > 16 or size.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("a chunked payload with a broken chunk")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if len(body) < line + 2 + n:
            raise ValueError("a chunked payload that ends early")
        out.append(body[line + 2 : line + 2 + n])
        at = line + 4 + n


def decoded(http: bytes, payload: bytes) -> bytes:
    """The payload without its transfer and content encodings."""
    headers = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    if headers.get(b"transfer-encoding", b"").endswith(b"chunked"):
        payload = unchunked(payload)
    for kind in reversed([x.strip() for x in headers.get(b"content-encoding", b"").split(b",")]):
        if kind in (b"", b"identity") or not payload:
            continue
        if kind not in (b"gzip", b"x-gzip", b"deflate"):
            raise ValueError(f"a payload in {kind.decode('latin-1')}")
        last = None
        for bits in (31,) if kind != b"deflate" else (15, -15):
            try:
                payload = unfolded(payload, bits)
                break
            except zlib.error as e:
                last = e
        else:
            raise ValueError(f"a payload that is not the encoding its header says: {last}")
    return payload


def unfolded(payload: bytes, bits: int, most: int = UNFOLDED_BYTES) -> bytes:
    """All members of a compressed payload; one that ends early, or unfolds to more than `most` bytes, is an error."""
    out, left = [], most
    while True:
        member = zlib.decompressobj(bits)
        out.append(member.decompress(payload, left + 1))
        left -= len(out[-1])
        if left < 0:
            raise ValueError(f"a payload that unfolds to more than {most} bytes")
        if not member.eof:
            raise ValueError("a compressed payload that ends early")
        payload = member.unused_data.lstrip(b"\0")  # members may be padded
        if not payload or bits != 31:
            return b"".join(out)


def derive(record: bytes) -> list[tuple]:
    """(type, record id, refers to, target, date, n_links, text, record) of the two derivatives."""
    headers, block = read_record(record)
    by = {k.lower(): v for k, v in headers}
    if by.get("warc-type") != "response":
        raise ValueError("no response")
    http, cut, payload = block.partition(b"\r\n\r\n")
    if not cut:
        raise ValueError("no HTTP header")
    source, target, date = by["warc-record-id"], by.get("warc-target-uri"), by.get("warc-date", DATE)
    kind = re.search(rb"charset\s*=\s*\"?([\w-]+)", http, re.I)
    charset = kind[1].decode() if kind else "utf-8"
    plain = decoded(http, payload)
    try:
        page = Page(plain.decode(charset, "replace"))
    except LookupError:
        page = Page(plain.decode("utf-8", "replace"))
    found, text = page.links(target), page.text()

    def headed(type_: str, mime: str, body: bytes) -> tuple[str, bytes]:
        name = identifier(type_, source)
        head = [("WARC-Type", type_), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Refers-To", source)]
        if type_ == "metadata":  # the standard keeps this one off conversion records
            head.append(("WARC-Concurrent-To", source))
        if target is not None:
            head.append(("WARC-Target-URI", target))
        head += [("Content-Type", mime), ("WARC-Block-Digest", digest(body))]
        if type_ == "conversion":
            head.append(("WARC-Payload-Digest", digest(body)))
        return name, write_record(head, body)

    fields = [("title", page.title()), ("charset", charset), ("payload-digest", digest(payload)), ("http-status", http.split(b"\r\n")[0].decode("latin-1"))]
    fields += [(f"source-{k.lower()}", v) for k, v in headers if k.lower() not in RESTATED]
    fields += [("http-header", line.decode("latin-1")) for line in http.split(b"\r\n")[1:]]
    fields += [("outlink", x) for x in found]
    info = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode()
    out = []
    for type_, mime, body in (("metadata", "application/warc-fields", info), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        name, written = headed(type_, mime, body)
        out.append((type_, name, source, target, date, len(found), written))
    return out


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record: pages as response records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([response(p, u, h, date) for p, u, h in rows], pa.binary())], names=["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """page_id, type, record_id, refers_to, target_uri, date, n_links, error, record: two rows for each response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, ids = [], []
                for k, record in enumerate(part.column(1).to_pylist()):
                    try:
                        made = [(*r[:6], None, r[6]) for r in derive(record or b"")]
                    except (ValueError, KeyError) as e:
                        made = [("error", None, None, None, None, None, str(e), None)]
                    rows += made
                    ids += [k] * len(made)
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids)), *columns], names=["page_id", "type", "record_id", "refers_to", "target_uri", "date", "n_links", "error", "record"])

    kind = records.schema["page_id"].dataType.simpleString()
    return records.select("page_id", "record").mapInArrow(run, f"page_id {kind}, type string, record_id string, refers_to string, target_uri string, date string, n_links long, error string, record binary")


def _index(kind: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([("page_id", kind), ("offset", pa.int64()), ("size", pa.int64()), ("error", pa.string())]))


def info_record() -> bytes:
    """The warcinfo record that begins every image."""
    body = b"software: mnemora\r\nformat: WARC File Format 1.1\r\n"
    return write_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", identifier("warcinfo", DATE)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], body)


def member(record: bytes) -> bytes:
    """A record as a gzip member (no time in its header, so that running twice writes the same bytes)."""
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress(record) + made.flush()


def write_images(records: DataFrame, image_bytes: int = IMAGE_BYTES) -> DataFrame:
    """Derives and writes WARC images (.warc.gz) to the shared folder: image, entries (page_id, offset, size, error) of its derivatives."""

    kind, id_type = records.schema["page_id"].dataType.simpleString(), to_arrow_type(records.schema["page_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = member(info_record())
        held, entries, size = [first], [], len(first)

        def image() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary()), pa.array([entries], _index(id_type))], names=["image", "entries"])

        for batch in batches:
            for k, page_id in enumerate(batch.column(0).to_pylist()):
                try:
                    made = [(member(r[-1]), None) for r in derive(batch.column(1)[k].as_py() or b"")]
                except (ValueError, KeyError) as e:
                    made = [(b"", str(e))]
                for record, error in made:
                    entries.append({"page_id": page_id, "offset": size, "size": len(record), "error": error})
                    held.append(record)
                    size += len(record)
                if size >= image_bytes:
                    yield image()
                    held, entries, size = [first], [], len(first)
        if entries:
            yield image()

    return stored(records.select("page_id", "record").mapInArrow(run, f"image binary, entries array<struct<page_id: {kind}, offset: long, size: long, error: string>>"))


def read_images(images: DataFrame) -> DataFrame:
    """page_id, type, record_id, refers_to, target_uri, date, n_links, error, record of every derivative, by the images' index."""

    id_field = images.schema["entries"].dataType.elementType["page_id"].dataType
    kind, id_type = id_field.simpleString(), to_arrow_type(id_field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image, rows = memoryview(batch.column(0)[k].as_buffer()), []
                for e in batch.column(1)[k].as_py():
                    if e["error"] is not None:
                        rows.append((e["page_id"], "error", None, None, None, None, None, e["error"], None))
                        continue
                    record = zlib.decompress(image[e["offset"] : e["offset"] + e["size"]], 31)
                    headers, block = read_record(record)
                    by = {n.lower(): v for n, v in headers}
                    n_links = block.count(b"\r\noutlink: ") if by["warc-type"] == "metadata" else None
                    rows.append((e["page_id"], by["warc-type"], by["warc-record-id"], by["warc-refers-to"], by.get("warc-target-uri"), by["warc-date"], n_links, None, record))
                for at in range(0, len(rows), 500):
                    kinds = (id_type, pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 500], strict=True), kinds, strict=True)], names=["page_id", "type", "record_id", "refers_to", "target_uri", "date", "n_links", "error", "record"])

    return images.mapInArrow(run, f"page_id {kind}, type string, record_id string, refers_to string, target_uri string, date string, n_links long, error string, record binary")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_images(write_images(responses(read_table(spark, sf_dir, "pages"))))
    return out.select("page_id", "type", "record_id", "refers_to", "target_uri", "n_links", F.length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))
