"""File trees as documents, and the decoding of their bytes."""

from __future__ import annotations

import csv
import io
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from itertools import zip_longest
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pages import read_page
from .pdf import pdf_text

# Folders that are never read, caps, and the extensions of each kind.
SKIP_DIRS = (".git", ".svn", ".hg", "node_modules", "bin", "obj", "dist", "build", "target", ".venv", "venv", "__pycache__", ".idea", ".vs", ".vscode", "packages")
MAX_TEXT, MAX_BINARY = 2_000_000, 30_000_000
CODE = ("py", "pyi", "js", "jsx", "ts", "tsx", "mjs", "cjs", "java", "kt", "kts", "cs", "go", "rb", "rs", "c", "h", "cpp", "sql", "sh", "ps1", "tf", "bicep")
TEXT = ("md", "txt", "rst", "adoc", "csv", "tsv", "json", "yaml", "yml", "xml", "toml", "ini", "cfg", "config", "properties", "log", "html", "htm", "csproj", "nuspec", "gradle", "mod")
BINARY = ("docx", "xlsx", "pptx", "zip", "pdf")
IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "svg", "tiff")
ZIP_MEMBERS, ZIP_BYTES, ZIP_MEMBER_BYTES, SHEET_ROWS = 300, 60_000_000, 20_000_000, 5000


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kind(path: Column) -> Column:
    """code, doc, image or unsupported."""
    e = extension(path)
    return F.when(e.isin(*CODE), "code").when(e.isin(*TEXT, *BINARY), "doc").when(e.isin(*IMAGES), "image").otherwise("unsupported")


class Parts:
    """The members of an archive; of a damaged one, those that its local headers still lead to."""

    def __init__(self, data: bytes):
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
            self._names, self._read = z.namelist(), z.read
        except zipfile.BadZipFile:
            held = salvaged(data)
            if not held:
                raise
            self._names, self._read = list(held), held.__getitem__

    def namelist(self) -> list[str]:
        return self._names

    def read(self, name: str) -> bytes:
        return self._read(name)


def salvaged(data: bytes) -> dict[str, bytes]:
    """Members of an archive without its directory: every local header whose content unfolds, as far as it does."""
    out, at, total = {}, 0, 0
    while (at := data.find(b"PK\x03\x04", at)) >= 0 and len(out) < ZIP_MEMBERS and total < ZIP_BYTES:
        if at + 30 > len(data):
            break
        method, size, name_size, extra = struct.unpack_from("<H", data, at + 8)[0], *struct.unpack_from("<I", data, at + 18), *struct.unpack_from("<HH", data, at + 26)
        name, begin = data[at + 30 : at + 30 + name_size].decode("utf-8", "replace"), at + 30 + name_size + extra
        at += 4
        if method == 8:
            try:
                content = zlib.decompressobj(-15).decompress(data[begin:], ZIP_MEMBER_BYTES)
            except zlib.error:
                continue
        elif method == 0:
            content = data[begin : begin + size]
        else:
            continue
        if not name.endswith("/"):
            out[name] = content
            total += len(content)
    return out


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _xml_lines(data: bytes, paragraph: str, run: str) -> list[str]:
    """The text of each paragraph; one inside another (a text box) is a line of its own, once."""
    out = []

    def own(e) -> str:
        return "".join((x.text or "") if _local(x) == run else "" if _local(x) == paragraph else own(x) for x in e)

    def walk(e) -> None:
        if _local(e) == "AlternateContent":  # the fallback says the same again
            e = next((x for x in e if _local(x) == "Choice"), e)
        if _local(e) == paragraph and (said := own(e)).strip():
            out.append(said)
        for x in e:
            walk(x)

    walk(ElementTree.fromstring(data))
    return out


def _docx(z: Parts) -> str:
    return "\n".join(_xml_lines(z.read("word/document.xml"), "p", "t"))


def _chart_lines(data: bytes) -> list[str]:
    """A chart's title, and each series: its name, categories and values."""
    root, out = ElementTree.fromstring(data), []
    values = lambda e: [v.text or "" for v in e.iter() if _local(v) == "v"]
    title = "".join(t.text or "" for c in root.iter() if _local(c) == "title" for t in c.iter() if _local(t) == "t")
    if title:
        out.append(title)
    for series in (e for e in root.iter() if _local(e) == "ser"):
        part = {_local(e): values(e) for e in series if _local(e) in ("tx", "cat", "val")}
        points = ", ".join(f"{c}: {v}" if c else v for c, v in zip_longest(part.get("cat", []), part.get("val", []), fillvalue=""))
        out.append(": ".join(x for x in (" ".join(part.get("tx", [])), points) if x))
    return [x for x in out if x]


def _pptx(z: Parts) -> str:
    """Slides in order: their shapes, then the charts and diagrams that they show."""

    def number(n: str) -> int:
        return int(re.search(r"(\d+)\.xml$", n)[1])

    names, out = set(z.namelist()), []
    for slide in sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
        lines = _xml_lines(z.read(slide), "p", "t")
        links = slide.replace("slides/", "slides/_rels/") + ".rels"
        targets = re.findall(r'Target="\.\./((?:charts/chart|diagrams/data)\d+\.xml)"', z.read(links).decode("utf-8", "replace")) if links in names else []
        for target in (f"ppt/{t}" for t in targets):
            if target in names:
                lines += _chart_lines(z.read(target)) if "/charts/" in target else _xml_lines(z.read(target), "p", "t")
        out.append("\n".join(lines))
    return "\n\n".join(out)


def _xlsx(z: Parts) -> str:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")))
    lines = []
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        for row in [r for r in ElementTree.fromstring(z.read(name)).iter() if r.tag.endswith("}row")][:SHEET_ROWS]:
            cells = []
            for c in row:
                v = next((x.text or "" for x in c.iter() if x.tag.endswith("}v") or x.tag.endswith("}t")), "")
                cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
            lines.append("\t".join(cells).rstrip())
    return "\n".join(x for x in lines if x)


def _archive(z: zipfile.ZipFile) -> str:
    """Members one after the other, each below its name; archives inside are named, not opened."""
    parts, total = [], 0
    for info in [i for i in z.infolist() if not i.is_dir()][:ZIP_MEMBERS]:
        head = f"--- {info.filename} ---"
        total += info.file_size
        if info.file_size > ZIP_MEMBER_BYTES or total > ZIP_BYTES:
            parts.append(f"{head}\n(too large)")
        elif info.filename.lower().endswith(".zip"):
            parts.append(f"{head}\n(nested archive)")
        else:
            parts.append(f"{head}\n{decode(info.filename, z.read(info)) or '(no text)'}")
    return "\n\n".join(parts)


def decode(path: str, data: bytes | None) -> str | None:
    """Text of a file by its extension; None where there is none to be had."""
    return decoded_or_reason(path, data)[0]


def decoded_or_reason(path: str, data: bytes | None, image_reader: Callable[[str, bytes], str] | None = None) -> tuple[str | None, str | None]:
    """(text, why there is none). image_reader is the seam for a model that reads images; without one they are named as unsupported."""
    if not data:
        return None, "empty"
    e = os.path.splitext(path)[1].lower().lstrip(".")
    if len(data) > (MAX_BINARY if e in (*BINARY, *IMAGES) else MAX_TEXT):
        return None, "too large"
    if e in IMAGES:
        if image_reader is None:
            return None, "images are not supported"
        try:
            said = image_reader(path, data)
        except Exception as error:  # the model's own failure is this file's reason
            return None, f"image: {error}"
        return (said, None) if said else (None, "no text")
    if e == "pdf":
        said = pdf_text(data)
        return said, None if said else "no text"
    if e in ("docx", "pptx", "xlsx", "zip"):
        try:
            if e == "zip":
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    return _archive(z), None
            return {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}[e](Parts(data)), None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError, NotImplementedError):
            return None, "damaged"
    if e not in CODE + TEXT and b"\0" in data[:1024]:
        return None, "binary"
    said = data.decode("utf-8", "replace")
    return (read_page(said)[0] if e in ("html", "htm") else said), None


@F.pandas_udf(T.StringType())
def decoded(path: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([decode(p, c) for p, c in zip(path, content, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("reason", T.StringType())]))
def decoded_with_reason(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decoded_or_reason(p, c) for p, c in zip(path, content, strict=True)], columns=["text", "reason"])


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """uri, title, kind, text, updated_at of the readable files below root; skipped folders, empty and oversized files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.split(F.regexp_replace("path", r"^[a-z]+:/+", ""), "/")
    names = F.slice(below, F.lit(1), F.size(below) - 1)
    kept = files.where((F.col("length") > 0) & (F.col("length") <= F.when(extension(F.col("path")).isin(*BINARY), MAX_BINARY).otherwise(MAX_TEXT)))
    kept = kept.where(~F.exists(names, lambda x: x.isin(*SKIP_DIRS)) & kind(F.col("path")).isin("code", "doc"))
    out = kept.select(F.col("path").alias("uri"), F.element_at(below, -1).alias("title"), kind(F.col("path")).alias("kind"), decoded("path", "content").alias("text"), F.col("modificationTime").alias("updated_at"))
    return out.where("trim(coalesce(text, '')) <> ''")


def outline(files: DataFrame, depth: int = 3, most: int = 200) -> DataFrame:
    """The first `most` paths of at most `depth` parts, sorted."""
    return files.where(F.size(F.split("path", "/")) <= depth).orderBy("path").limit(most)


def tables_to_csv(rows: list[list[str]]) -> str:
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue()
