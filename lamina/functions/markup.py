"""Markdown to sanitised HTML on the standard library; an Arrow UDF for columns.

The Markdown subset: headings, paragraphs, emphasis, code, block quotes, lists,
tables with a delimiter row, rules, images and raw HTML; links become their text.
Sanitising denies by default: only listed tags and attributes pass, URLs must be
data URLs or relative to the page, and the content of scripts and styles is dropped.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import escape_html

# What sanitised HTML may hold.
TAGS = frozenset("p br h1 h2 h3 h4 h5 h6 strong em blockquote pre code ul ol li table thead tbody tr th td img hr figure figcaption sup sub".split())
ATTRIBUTES = {"img": ("src", "alt"), "td": ("rowspan", "colspan"), "th": ("rowspan", "colspan")}
DROPPED = frozenset(("script", "style"))
EMPTY = frozenset(("br", "hr", "img"))
CSS = """
main { margin: 0 auto; max-width: 44em; padding: 1.5em; font-family: Georgia, serif; line-height: 1.6; }
main img { display: block; height: auto; max-width: 100%; }
main table { border-spacing: 0; margin: 1em 0; }
main td, main th { border-bottom: thin solid; padding: 0.2em 0.8em; text-align: left; }
"""
#: A URL with a scheme, or one that names a host.
ABSOLUTE = re.compile(r"\s*(?:[a-z][a-z0-9+.-]*:|[/\\]{2})", re.I)


def source_ok(url: str) -> bool:
    return url.strip().lower().startswith("data:") or not ABSOLUTE.match(re.sub(r"[\t\r\n]", "", url))



class Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.dropped = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.dropped += 1
        elif not self.dropped and tag in TAGS:
            kept = [(k, v or "") for k, v in attrs if k in ATTRIBUTES.get(tag, ()) and (k != "src" or source_ok(v or ""))]
            self.out.append("<" + tag + "".join(f' {k}="{html.escape(v)}"' for k, v in kept) + ">")
            if tag not in EMPTY:
                self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in DROPPED:
            self.dropped -= 1

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif not self.dropped and tag in self.open:
            while True:
                top = self.open.pop()
                self.out.append(f"</{top}>")
                if top == tag:
                    break

    def handle_data(self, data):
        if not self.dropped:
            self.out.append(html.escape(data, quote=False))


def sanitise(text: str | None) -> str:
    c = Cleaner()
    c.feed(text or "")
    c.close()
    return "".join(c.out) + "".join(f"</{t}>" for t in reversed(c.open))


def inline(text: str) -> str:
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\0{len(held) - 1}\0"

    text = re.sub(r"`([^`]+)`", lambda m: hold(f"<code>{html.escape(m[1], quote=False)}</code>"), text)
    text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", lambda m: hold(f'<img src="{html.escape(m[2])}" alt="{html.escape(m[1])}">'), text)
    text = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", text)
    text = re.sub(r"(?<![\w*])[*_]([^*_\n]+)[*_](?![\w*])", r"<em>\1</em>", text)
    return re.sub(r"\0(\d+)\0", lambda m: held[int(m[1])], text)


def markdown_html(text: str | None) -> str:
    out, lines, i = [], (text or "").splitlines(), 0
    while i < len(lines):
        line = lines[i]
        rest = lines[i + 1] if i + 1 < len(lines) else ""
        if not line.strip():
            i += 1
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            i += 1
        elif line.startswith("```"):
            end = next((k for k in range(i + 1, len(lines)) if lines[k].startswith("```")), len(lines))
            out.append("<pre><code>" + html.escape("\n".join(lines[i + 1 : end]), quote=False) + "</code></pre>")
            i = end + 1
        elif re.fullmatch(r"\s*([-*_])(\s*\1){2,}\s*", line):
            out.append("<hr>")
            i += 1
        elif "|" in line and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", rest) and "-" in rest:
            cells = lambda s: [inline(c.strip()) for c in s.strip().strip("|").split("|")]
            out.append("<table><thead><tr>" + "".join(f"<th>{c}</th>" for c in cells(line)) + "</tr></thead><tbody>")
            i += 2
            while i < len(lines) and "|" in lines[i]:
                out.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells(lines[i])) + "</tr>")
                i += 1
            out.append("</tbody></table>")
        elif m := re.match(r"\s*([-*+]|\d+[.)])\s+", line):
            tag = "ol" if m[1][0].isdigit() else "ul"
            out.append(f"<{tag}>")
            while i < len(lines) and (m := re.match(r"\s*([-*+]|\d+[.)])\s+(.*)", lines[i])):
                out.append(f"<li>{inline(m[2])}</li>")
                i += 1
            out.append(f"</{tag}>")
        elif line.startswith(">"):
            start = i
            while i < len(lines) and lines[i].startswith(">"):
                i += 1
            out.append("<blockquote>" + markdown_html("\n".join(x[1:].removeprefix(" ") for x in lines[start:i])) + "</blockquote>")
        elif line.lstrip().startswith("<"):
            start = i
            while i < len(lines) and lines[i].strip():
                i += 1
            out.append("\n".join(lines[start:i]))
        else:
            start = i
            while i < len(lines) and lines[i].strip() and not (i > start and re.match(r"#{1,6}\s|>|```", lines[i])):
                i += 1
            out.append(f"<p>{inline(chr(10).join(lines[start:i]))}</p>")
    return "\n".join(out)


@F.arrow_udf(StringType())
def clean_html(x: pa.Array) -> pa.Array:
    return pa.array([sanitise(t) for t in x.to_pylist()], type=pa.string())


@F.arrow_udf(StringType())
def markdown_to_clean_html(x: pa.Array) -> pa.Array:
    return pa.array([sanitise(markdown_html(t)) for t in x.to_pylist()], type=pa.string())


def html_document(markdown: Column, title: Column, assets: Column | None = None) -> Column:
    """A self-contained page; ``assets`` is an array of structs ``name, url`` put in place of links."""
    if assets is not None:
        markdown = F.reduce(assets, markdown, lambda md, a: F.replace(md, F.concat(F.lit("]("), a["name"], F.lit(")")), F.concat(F.lit("]("), a["url"], F.lit(")"))))
    head = "<!DOCTYPE html>\n<html>\n<head>\n<meta charset='utf-8'>\n<title>"
    return F.concat(F.lit(head), escape_html(title), F.lit(f"</title>\n<style>{CSS}</style>\n</head>\n<body>\n<main>\n"), markdown_to_clean_html(markdown), F.lit("\n</main>\n</body>\n</html>\n"))
