"""Answers as files: markdown as HTML, its tables as CSV, reports as JSON."""

from __future__ import annotations

import csv
import html
import io
import re
from itertools import groupby

from pyspark.sql import DataFrame

from ..operators.mining import pipe_tables

_INLINE = (
    (re.compile(r"`([^`]+)`"), r"<code>\1</code>"),
    (re.compile(r"\*\*([^*]+)\*\*"), r"<strong>\1</strong>"),
    (re.compile(r"(?<!\*)\*([^*\s][^*]*)\*"), r"<em>\1</em>"),
    (re.compile(r"\[([^\]]+)\]\((https?://[^)\s]+)\)"), r'<a href="\2">\1</a>'),
)


def _inline(said: str) -> str:
    out = html.escape(said, quote=True)
    for pattern, shown in _INLINE:
        out = pattern.sub(shown, out)
    return out


def tables_csv(markdown: str) -> str:
    """The tables of a markdown text, one after the other, with an empty line between."""
    out = io.StringIO()
    write = csv.writer(out, lineterminator="\n")
    for k, (_, headers, rows) in enumerate(pipe_tables(markdown)):
        if k:
            out.write("\n")
        write.writerows([headers, *rows])
    return out.getvalue()


def to_html(markdown: str, title: str = "") -> str:
    """A page of headings, lists, tables, code and paragraphs."""

    def kind(line: str) -> str:
        return "code" if line[:1] == "\0" else "table" if re.match(r"\|.*\|$", line) else "list" if re.match(r"[-*] ", line) else "head" if re.match(r"#{1,6} ", line) else "text" if line else ""

    # A line of a fenced block is marked, so that nothing in it is read as markup.
    lines, fenced = [], False
    for line in markdown.splitlines():
        if line.startswith("```"):
            fenced = not fenced
        else:
            lines.append("\0" + line if fenced else line.strip())
    body = []
    for what, run in groupby(lines, key=kind):
        run = list(run)
        if what == "code":
            body.append("<pre>" + html.escape("\n".join(x[1:] for x in run)) + "</pre>")
        elif what == "head":
            body += [f"<h{x.index(' ')}>{_inline(x.lstrip('# '))}</h{x.index(' ')}>" for x in run]
        elif what == "list":
            body.append("<ul>" + "".join(f"<li>{_inline(x[2:])}</li>" for x in run) + "</ul>")
        elif what == "table":
            for _, headers, rows in pipe_tables("\n".join(run)):
                cells = lambda row, tag: "<tr>" + "".join(f"<{tag}>{_inline(c)}</{tag}>" for c in row) + "</tr>"
                body.append("<table>" + cells(headers, "th") + "".join(cells(r, "td") for r in rows) + "</table>")
        elif what == "text":
            body.append("<p>" + " ".join(map(_inline, run)) + "</p>")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>' + "\n".join(body) + "</body></html>\n"


def write_report(report: DataFrame, path: str) -> None:
    """A report's rows as JSON lines, in one file."""
    report.coalesce(1).write.mode("overwrite").json(path)
