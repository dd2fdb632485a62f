"""Chunking: code by line blocks, markdown by headings, prose by size.

Line blocks are array functions. Prose chunks follow a recurrence (each begins where
the last one broke), which array functions can't say without quadratic work, so
they are one Arrow-batched UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS = 1600
OVERLAP_CHARS = 200
CODE_LINES = 60
CODE_OVERLAP = 8
_HEADING = re.compile(r"^#{1,4} ", re.M)


def code_chunks(text: Column, size: int = CODE_LINES, overlap: int = CODE_OVERLAP) -> Column:
    """Blocks of `size` lines that share `overlap` lines; the last ends with the text."""
    step = size - overlap

    def blocks(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - overlap - 1, F.lit(0)), F.lit(step))
        return F.filter(F.transform(starts, lambda s: F.trim(F.array_join(F.slice(lines, s + 1, F.lit(size)), "\n"))), lambda b: b != "")

    # As a lambda's variable the lines are split once for a text, not once for each block.
    lines = F.array(F.split(F.trim(text), "\r\n|\n|\r"))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(lines, blocks)))


def plain(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        to = min(at + MAX_CHARS, len(text))
        if to < len(text):
            cut = max(text.rfind("\n\n", at, to), text.rfind(". ", at, to)) - at
            if cut > MAX_CHARS // 2:
                to = at + cut + 1
        if piece := text[at:to].strip():
            out.append(piece)
        if to >= len(text):
            break
        at = max(to - OVERLAP_CHARS, at + 1)
    return out


def markdown(text: str) -> list[str]:
    starts = [0, *(m.start() for m in _HEADING.finditer(text) if m.start())]
    out = []
    for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
        section = text[a:b].strip()
        title = section.split("\n", 1)[0].strip() if _HEADING.match(section) else ""
        for k, part in enumerate(plain(section)):
            out.append(f"{title}\n{part}" if title and k and not part.startswith(title) else part)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def prose_chunks(text: pd.Series) -> pd.Series:
    def of(x: str | None) -> list[str]:
        x = (x or "").strip()
        return markdown(x) if _HEADING.search(x) else plain(x)

    return text.map(of)


def chunks(text: Column, kind: Column) -> Column:
    """Chunks of a document by its kind; code does not leave the JVM."""
    return F.when(kind == "code", code_chunks(text)).otherwise(prose_chunks(F.when(F.coalesce(kind, F.lit("")) != "code", text)))
