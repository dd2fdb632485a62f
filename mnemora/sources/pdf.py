"""Text of PDF files: the strings that their pages' content streams show, in the order of the streams.

Streams are plain or Flate-coded. Codes are read through the fonts' ToUnicode tables where those
agree in width, else as Latin text. Encrypted files, and text that is drawn as an image, give none.
"""

from __future__ import annotations

import re
import zlib

#: Content streams that are read, and bytes that one may unfold to.
MAX_PAGES, MAX_STREAM = 2000, 20_000_000
_STREAM = re.compile(rb"<<((?:[^<>]|<(?!<)|>(?!>)|<<(?:[^<>]|<(?!<)|>(?!>))*>>)*)>>\s*stream\r?\n", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in a shown array, in thousandths of the font's size, that stands for a blank.
GAP = -180


def _streams(data: bytes):
    """(dictionary, content) of every stream that can be unfolded."""
    at = 0
    while m := _STREAM.search(data, at):
        end = data.find(b"endstream", m.end())
        if end < 0:
            return
        at, raw = end + 9, data[m.end() : end]
        if b"/FlateDecode" in m[1]:
            try:
                raw = zlib.decompressobj().decompress(raw, MAX_STREAM)
            except zlib.error:
                continue
        elif b"/Filter" in m[1]:
            continue
        yield m[1], raw


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        said = m[1]
        return bytes([int(said, 8) & 255]) if said.isdigit() else b"" if said in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(said, said)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


def _codes(said: bytes) -> dict[bytes, str]:
    """A ToUnicode table's codes."""
    out = {}
    wide = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", said, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(a.decode())] = wide(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", said, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for k in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                out[(int(a, 16) + k).to_bytes(len(a) // 2)] = chr(int(c, 16) + k) if len(c) == 4 else wide(c)
    return out


def pdf_text(data: bytes) -> str | None:
    """The text of a PDF, a line for each line that it begins; None where there is none to be had."""
    if not data.startswith(b"%PDF") or b"/Encrypt" in data:
        return None
    pages, tables = [], {}
    for about, said in _streams(data):
        if b"begincmap" in said:
            tables |= _codes(said)
        elif b"BT" in said and not re.search(rb"/Subtype\s*/Image", about) and len(pages) < MAX_PAGES:
            pages.append(said)
    width = {len(k) for k in tables}
    size = width.pop() if len(width) == 1 else 0

    def shown(raw: bytes) -> str:
        if size and len(raw) % size == 0:
            parts = [raw[k : k + size] for k in range(0, len(raw), size)]
            if all(p in tables for p in parts):
                return "".join(tables[p] for p in parts)
        return raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")

    out = []
    for page in pages:
        line, lines, held, inside = "", [], [], False
        for token in _TOKEN.findall(page):
            if token in (b"BT", b"ET"):
                inside = token == b"BT"
            if token in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"', b"ET") and line:
                moved = token != b"Td" or len(held) < 2 or held[-1] not in (b"0", b"0.0")
                line, lines = ("", [*lines, line]) if moved else (line + " ", lines)
            if inside and token in (b"Tj", b"'", b'"', b"TJ"):
                for x in held:
                    if x[:1] in b"(<":
                        line += shown(_string(x))
                    elif token == b"TJ" and x not in (b"[", b"]") and float(x) < GAP:
                        line += " "
            if token[:1] in b"(<[]-.0123456789":
                held.append(token)
            else:
                held = []
        lines.append(line)
        out.append("\n".join(x.strip() for x in lines if x.strip()))
    text = "\n\n".join(x for x in out if x)
    return text or None
