"""Document sources: format detection, Markdown front matter, HTML, Word, slides, PDF layout, URLs.

Files are read with Spark's binaryFile source and converted in an Arrow UDF, one file at a time."""

from __future__ import annotations

import base64
import html
import io
import json
import re
import zipfile
from collections import Counter
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.columns import LEADERS
from graphloom.functions.text import fnv64

EXTENSIONS = ("md", "markdown", "txt", "text", "html", "htm", "pdf", "docx", "pptx", "doc", "ppt")
EXTRACTED = "struct<format: string, title: string, text: string, tags: array<string>, status: string, pages: int, structured: boolean, error: string>"
# Headings that name no document.
GENERIC = (
    "introduction", "sommaire", "table des matières", "table des matieres", "contents", "table of contents", "overview", "summary", "résumé", "resume",
    "préambule", "preambule", "avant-propos", "foreword", "preface", "préface", "contexte", "context", "objet", "purpose", "scope", "périmètre",
    "historique", "historique des versions", "suivi des versions", "version history", "revision history", "document history", "document control",
    "glossaire", "glossary", "abstract")


def detect(name: str, data: bytes) -> str:
    """Format by signature, then extension, then valid UTF-8; else an error."""
    if data[:4] == b"%PDF":
        return "pdf"
    if data[:2] == b"PK":
        try:
            inside = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        except zipfile.BadZipFile:
            inside = set()
        if "word/document.xml" in inside:
            return "docx"
        if "ppt/presentation.xml" in inside:
            return "pptx"
    end = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if data[:4] == b"\xd0\xcf\x11\xe0":
        return "ppt" if end == "ppt" else "doc"
    if end in ("html", "htm"):
        return "html"
    if end in ("md", "markdown"):
        return "markdown"
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        raise ValueError(f"unknown format: {name}") from None
    return "html" if re.match(r"\s*<(!doctype html|html)", text, re.I) else "text"


def front_matter(text: str) -> tuple[dict, str]:
    """({title, status, tags}, body) of a Markdown text that opens with a --- block; it ends at --- or at three dots."""
    m = re.match(r"﻿?---[ \t]*\n(.*?)\n(?:---|\.\.\.)[ \t]*(?:\n|$)", text, re.S)
    if not m:
        return {}, text
    found: dict = {}
    key = None
    for line in m[1].split("\n"):
        item = re.match(r"\s*-\s+(.*)", line)
        pair = re.match(r"(\w+)\s*:\s*(.*)", line)
        if item and key in ("tags", "keywords"):
            found.setdefault("tags", []).append(_bare(item[1]))
        elif pair:
            key, value = pair[1].lower(), pair[2].strip()
            if key in ("title", "titre") and value:
                found["title"] = _bare(value)
            elif key in ("status", "statut") and value:
                found["status"] = _bare(value).upper()
            elif key == "draft" and value.lower() == "true":
                found["status"] = "DRAFT"
            elif key in ("tags", "keywords") and value:
                found["tags"] = [t for t in map(_bare, value.strip("[]").split(",")) if t]
    return found, text[m.end():]


def _bare(value: str) -> str:
    return value.strip().strip("\"'").strip()


def is_generic(title: str) -> bool:
    return re.sub(r"^[\d.\s]+", "", title).strip().lower().rstrip(".:") in GENERIC


def first_heading(text: str) -> str | None:
    """The first top heading, unless it is generic: then the file's name is the better title."""
    m = re.search(r"(?m)^[^\S\n]*# [^\S\n]*(\S.*)$", text)
    title = m[1].strip() if m else ""
    return title if title and not is_generic(title) else None


_SKIP = frozenset("script style head nav aside footer form noscript template iframe svg button select".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_FURNITURE = re.compile(r"(^|[\s_-])(nav|navbar|menu|sidebar|footer|breadcrumbs?|cookies?|banner|advert\w*|ads?|share|social|comments?|related|toc|navbox|catlinks|noprint)($|[\s_-])")


class _Markdown(HTMLParser):
    """Blocks of Markdown from HTML; what is furniture by tag, role, class or id is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.prefix, self.skip, self.depth = "", None, 0
        self.cells: list[str] | None = None
        self.images: list[dict] = []
        self.figure: dict | None = None
        self.in_caption = False

    def flush(self):
        text = " ".join("".join(self.line).split())
        if text:
            if self.in_caption and self.images:
                self.images[-1]["caption"] = text[:200]
            self.blocks.append(self.prefix + text)
        self.line, self.prefix = [], ""

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if self.skip:
            self.depth += tag == self.skip
            return
        hints = " ".join(given.get(k, "") for k in ("role", "id", "class")).lower()
        if tag not in _VOID and (tag in _SKIP or tag not in ("body", "html", "main", "article") and _FURNITURE.search(hints)):
            self.flush()
            self.skip, self.depth = tag, 1
            return
        if tag == "img":
            self.image(given)
        elif tag == "br":
            self.line.append(" ")
        elif tag in ("td", "th"):
            self.line = []
        elif tag == "tr":
            self.flush()
            self.cells = []
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.flush()
            self.prefix = "- "
        elif tag == "figcaption":
            self.flush()
            self.in_caption = True
        elif tag in ("p", "div", "section", "ul", "ol", "table", "pre", "blockquote", "article", "main", "figure", "dl", "dt", "dd", "header"):
            self.flush()

    def image(self, given):
        source = given.get("data-src") or given.get("src", "")
        small = any(re.fullmatch(r"\d+(px)?", given.get(k, "")) and int(given[k].removesuffix("px")) < 48 for k in ("width", "height"))
        if source and not small:
            self.flush()
            self.images.append({"n": len(self.images) + 1, "src": source, "alt": given.get("alt", ""), "caption": ""})
            self.blocks.append(f"<!-- image {len(self.images)} -->")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip:
                self.depth -= 1
                if not self.depth:
                    self.skip = None
            return
        if tag in ("td", "th") and self.cells is not None:
            self.cells.append(" ".join("".join(self.line).split()))
            self.line = []
        elif tag == "tr" and self.cells is not None:
            if any(self.cells):
                self.blocks.append("| " + " | ".join(c.replace("|", "/") for c in self.cells) + " |")
            self.cells, self.line = None, []
        elif tag == "figcaption":
            self.flush()
            self.in_caption = False
        elif tag in ("p", "div", "section", "li", "ul", "ol", "table", "pre", "blockquote", "article", "main", "figure", "header", "dt", "dd") or re.fullmatch("h[1-6]", tag):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.line.append(data)


def _rendered(text: str) -> tuple[str, list[dict]]:
    parser = _Markdown()
    parser.feed(text)
    parser.close()
    parser.flush()
    return "\n\n".join(parser.blocks), parser.images


def html_markdown(page: str) -> tuple[str, list[dict]]:
    """Markdown and images of the main region: <main>, else <article>, if that gives more than 200 bytes; else <body>."""
    for tag in ("main", "article", "body"):
        first = re.search(rf"<{tag}\b[^>]*>", page, re.I)
        if first:
            last = max((m.start() for m in re.finditer(rf"</{tag}\s*>", page, re.I)), default=len(page))
            text, images = _rendered(page[first.end():max(last, first.end())])
            if tag == "body" or len(text.encode()) > 200:
                return text, images
    return _rendered(page)


def html_title(page: str) -> str | None:
    """og:title, else <title>, else the first <h1>; 200 characters at most."""
    for tag in re.findall(r"<meta\b[^>]*>", page, re.I):
        if re.search(r"property\s*=\s*[\"']og:title[\"']", tag, re.I):
            m = re.search(r"content\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag, re.I)
            if m and (m[1] or m[2] or "").strip():
                return " ".join(html.unescape(m[1] or m[2]).split())[:200]
    for tag in ("title", "h1"):
        m = re.search(rf"<{tag}\b[^>]*>(.*?)</{tag}\s*>", page, re.I | re.S)
        text = " ".join(html.unescape(re.sub(r"<[^>]+>", "", m[1])).split()) if m else ""
        if text:
            return text[:200]
    return None


def _tag(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _attr(node, name: str) -> str:
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), "")


def core_title(archive: zipfile.ZipFile) -> str | None:
    if "docProps/core.xml" not in archive.namelist():
        return None
    root = ElementTree.fromstring(archive.read("docProps/core.xml"))
    return next((x.text.strip() for x in root.iter() if _tag(x) == "title" and x.text and x.text.strip()), None)


def docx(data: bytes) -> tuple[str, str | None]:
    """Markdown and title of a Word file: headings by style, lists, tables."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    body = next(x for x in ElementTree.fromstring(archive.read("word/document.xml")).iter() if _tag(x) == "body")
    out: list[str] = []

    def text_of(node) -> str:
        return "".join(x.text or "" if _tag(x) == "t" else "\t" if _tag(x) == "tab" else " " if _tag(x) == "br" else "" for x in node.iter())

    for node in body:
        if _tag(node) == "p":
            text = " ".join(text_of(node).split())
            style = next((_attr(x, "val") for x in node.iter() if _tag(x) == "pStyle"), "")
            level = re.fullmatch(r"(?:Heading|Titre)\s*(\d)", style, re.I)
            if not text:
                continue
            if level:
                text = "#" * min(6, int(level[1])) + " " + text
            elif style.lower() == "title":
                text = "# " + text
            elif style.lower() == "subtitle":
                text = "## " + text
            elif any(_tag(x) == "numPr" for x in node.iter()):
                text = "- " + text
            out.append(text)
        elif _tag(node) == "tbl":
            for row in (x for x in node.iter() if _tag(x) == "tr"):
                cells = [" ".join(text_of(c).split()).replace("|", "/") for c in row if _tag(c) == "tc"]
                out.append("| " + " | ".join(cells) + " |")
    return "\n\n".join(out), core_title(archive)


def pptx(data: bytes) -> tuple[str, str | None, int]:
    """Markdown, title and slide count of a presentation, in presentation order, with notes."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    names = set(archive.namelist())

    def relations(part: str) -> dict[str, str]:
        folder, name = part.rsplit("/", 1)
        path = f"{folder}/_rels/{name}.rels"
        if path not in names:
            return {}
        root = ElementTree.fromstring(archive.read(path))
        return {_attr(x, "Id"): _resolved(folder, _attr(x, "Target")) for x in root}

    def paragraphs(part: str) -> list[str]:
        root = ElementTree.fromstring(archive.read(part))
        texts = ("".join(t.text or "" for t in p.iter() if _tag(t) == "t").strip() for p in root.iter() if _tag(p) == "p")
        return [t for t in texts if t]

    deck = ElementTree.fromstring(archive.read("ppt/presentation.xml"))
    links = relations("ppt/presentation.xml")
    order = [links.get(next((v for k, v in x.attrib.items() if k.endswith("}id")), "")) for x in deck.iter() if _tag(x) == "sldId"]
    slides = [s for s in order if s in names]
    out = []
    for n, slide in enumerate(slides, 1):
        lines = paragraphs(slide)
        out.append(f"## Diapositive {n}" + (f" : {lines[0]}" if lines else ""))
        out += [f"- {x}" for x in lines[1:]]
        notes = next((t for t in relations(slide).values() if "notesSlide" in t and t in names), None)
        if notes and (said := [x for x in paragraphs(notes) if not x.isdigit()]):
            out.append("Notes : " + " ".join(said))
    return "\n\n".join(out), core_title(archive), len(slides)


def _resolved(folder: str, target: str) -> str:
    if target.startswith("/"):
        return target[1:]
    parts = folder.split("/")
    for x in target.split("/"):
        if x == "..":
            parts.pop()
        elif x != ".":
            parts.append(x)
    return "/".join(parts)


def pdf_markdown(xml: str) -> tuple[str, int]:
    """Markdown and page count of pdf_layout()."""
    return pdf_layout(xml)[:2]


def pdf_layout(xml: str, load: Callable[[str], bytes | None] | None = None) -> tuple[str, int, list[dict]]:
    """Markdown, page count and images from a PDF converted to positioned text (page, fontspec, text, image elements).

    Images (n, page, data) of 60 points a side at least are those that `load` finds; a marker stands in their place.
    Page numbers alone in a margin go. Text on one baseline is a line; lines in the margins that many pages repeat go; sizes above the body's
    are headings; monospaced lines are code; words cut at line ends are joined."""
    root = ElementTree.fromstring(xml)
    fonts = {x.get("id"): (float(x.get("size", 0)), (x.get("family") or "").lower()) for x in root.iter("fontspec")}
    pages, images = [], []
    for page in root.iter("page"):
        height, lines = float(page.get("height", 1)), []
        for t in sorted(page.iter("text"), key=lambda t: (float(t.get("top", 0)), float(t.get("left", 0)))):
            text, top = "".join(t.itertext()), float(t.get("top", 0))
            if not text.strip():
                continue
            size, family = fonts.get(t.get("font"), (0.0, ""))
            if lines and abs(lines[-1]["top"] - top) <= 3:
                lines[-1]["runs"].append((float(t.get("left", 0)), text))
            else:
                lines.append({"top": top, "runs": [(float(t.get("left", 0)), text)], "size": size, "mono": any(m in family for m in ("mono", "courier", "consol")),
                              "margin": top < 0.09 * height or top > 0.91 * height})
        for line in lines:
            line["text"] = " ".join(" ".join(x for _, x in sorted(line.pop("runs"))).split())
        number = int(page.get("number", len(pages) + 1))
        for x in page.iter("image") if load else ():
            if min(float(x.get("width", 0)), float(x.get("height", 0))) >= 60 and (data := load(x.get("src", ""))):
                images.append({"n": len(images) + 1, "page": number, "data": data})
                lines.append({"top": float(x.get("top", 0)), "text": "", "size": 0.0, "mono": False, "margin": False, "image": len(images)})
        pages.append((number, sorted(lines, key=lambda x: x["top"])))
    shape = lambda text: re.sub(r"\d+", "#", text)
    seen = Counter(s for _, lines in pages for s in {shape(x["text"]) for x in lines if x["margin"]})
    often = max(len(pages) / 20, 3)
    weight: Counter = Counter()
    for _, lines in pages:
        for x in lines:
            weight[x["size"]] += len(x["text"].encode())
    body = weight.most_common(1)[0][0] if weight else 0.0
    used = Counter(x["size"] for _, lines in pages for x in lines if x["size"] >= body + 2)
    levels = {s: i + 1 for i, s in enumerate(sorted((s for s, n in used.items() if n >= max(len(pages) / 50, 2) or len(pages) < 10), reverse=True)[:4])}
    out: list[str] = []
    for number, lines in pages:
        out.append(f"<!-- page {number} -->")
        code: list[str] = []
        for x in [*lines, None]:
            if x and x["margin"] and (seen[shape(x["text"])] >= often or x["text"].isdecimal()):
                continue
            if x and x["mono"]:
                code.append(x["text"])
                continue
            if code:
                out.append("```\n" + "\n".join(code) + "\n```")
                code = []
            if x is None:
                break
            if "image" in x:
                out.append(f"<!-- image {x['image']} -->")
                continue
            bullet = re.match(r"[•▪●◦‣·–-]\s+(.*)", x["text"])
            if x["size"] in levels:
                out.append("#" * levels[x["size"]] + " " + x["text"])
            elif bullet:
                out.append("- " + bullet[1])
            elif out and re.search(r"\w-$", out[-1]) and x["text"][:1].islower():
                out[-1] = out[-1][:-1] + x["text"]
            else:
                out.append(x["text"])
    return re.sub(LEADERS, " … ", "\n".join(out)), len(pages), images


def pdf_plain(text: str) -> tuple[str, int]:
    """Text and page count of a PDF converted to plain text, pages parted by form feeds; words cut at line ends are joined."""
    pages = text.removesuffix("\f").split("\f")
    return "\n\n".join(re.sub(r"(?<=[^\W\d_])-\n\s*(?=[^\W\d_])(?=(\w))", lambda m: "" if m[1].islower() else m[0], p.strip()) for p in pages), len(pages)


def pdf_text(layout: tuple[str, int] | None, plain: Callable[[], str]) -> tuple[str, int, bool]:
    """(text, pages, structured): the layout's Markdown if it has more than five words a page, else the plain text."""
    if layout and len(layout[0].split()) > 5 * max(layout[1], 1):
        return *layout, True
    return *pdf_plain(plain()), False


def run_tool(command: list[str], data: bytes, then: Callable[[str], object] = lambda folder: None) -> tuple[bytes, object]:
    """An external converter's output over one file, and what `then` makes of its folder; `{in}` and `{out}` name the
    files. The folder lives as long as the call: nothing is left on the machine."""
    import os
    import subprocess
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        source, target = os.path.join(folder, "in"), os.path.join(folder, "out")
        with open(source, "wb") as f:
            f.write(data)
        try:
            done = subprocess.run([x.format(**{"in": source, "out": target}) for x in command], capture_output=True, timeout=300, check=True)
        except FileNotFoundError:
            raise ValueError(f"{command[0]} is not installed; give the text or its layout XML") from None
        except subprocess.SubprocessError as e:
            raise ValueError(f"{command[0]} could not read the file: {e}") from None
        return done.stdout, then(folder)


def folder_file(folder: str) -> Callable[[str], bytes | None]:
    """A loader of files of one folder; names that lead out of it find nothing."""

    def load(name: str) -> bytes | None:
        try:
            with open(inside(folder, name), "rb") as f:
                return f.read()
        except (ValueError, OSError):
            return None

    return load


def pdf(data: bytes, tool=run_tool) -> dict:
    """A PDF by the converters pdfinfo, pdftohtml and pdftotext: text, title, pages, structured, images."""
    info = dict(re.findall(r"(?m)^(Title|Pages):[ \t]*(\S.*?)\s*$", tool(["pdfinfo", "{in}"], data)[0].decode("utf-8", "replace")))
    layout, images = None, []
    try:
        def read(folder: str):
            with open(f"{folder}/out.xml", encoding="utf-8", errors="replace") as f:
                return pdf_layout(f.read(), folder_file(folder))

        text, count, images = tool(["pdftohtml", "-xml", "-q", "-fmt", "png", "{in}", "{out}"], data, then=read)[1]
        layout = text, int(info.get("Pages", count))
    except (ValueError, OSError, ElementTree.ParseError):  # no layout: the plain text is read
        pass
    text, pages, structured = pdf_text(layout, lambda: tool(["pdftotext", "-q", "-enc", "UTF-8", "{in}", "-"], data)[0].decode("utf-8", "replace"))
    return {"text": text, "title": info.get("Title"), "pages": pages, "structured": structured, "images": images if structured else []}


def extract(name: str, data: bytes) -> dict:
    """One file as text with its metadata; title: front matter, document property, first heading, file name."""
    kind = detect(name, data)
    out = {"format": kind, "title": None, "text": "", "tags": [], "status": None, "pages": 0, "structured": True, "error": None}
    if kind in ("markdown", "text"):
        out["text"] = data.decode("utf-8", "replace")
        out["structured"] = kind == "markdown"
        if kind == "markdown":
            found, out["text"] = front_matter(out["text"])
            out |= {k: v for k, v in found.items() if k in ("title", "status", "tags")}
    elif kind == "html":
        page = data.decode("utf-8", "replace")
        out["text"], out["title"] = html_markdown(page)[0], html_title(page)
    elif kind == "docx":
        out["text"], out["title"] = docx(data)
    elif kind == "pptx":
        out["text"], out["title"], out["pages"] = pptx(data)
    elif kind == "pdf":
        out |= {k: v for k, v in pdf(data).items() if k != "images"}
    else:
        out["text"] = run_tool(["catdoc" if kind == "doc" else "catppt", "{in}"], data)[0].decode("utf-8", "replace")
        out["structured"] = False
    if not out["text"].strip():
        raise ValueError(f"no text in {name}")
    stem = " ".join(re.sub(r"\.[^.]*$", "", name.rsplit("/", 1)[-1]).replace("_", " ").split())
    out["title"] = out["title"] or (first_heading(out["text"]) if out["structured"] else None) or stem
    return out


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """document rows of a folder's files: id from the relative path; hidden files and other endings are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace("path", f"^.*?{re.escape(root)}/", "")
    files = files.withColumn("name", relative).where(~F.col("name").rlike(r"(^|/)\.") & F.lower("name").rlike(r"\.(" + "|".join(EXTENSIONS) + ")$"))

    @F.pandas_udf(EXTRACTED)
    def convert(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for name, data in zip(names, contents, strict=True):
            try:
                rows.append(extract(name, data))
            except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as e:
                rows.append({"format": None, "title": None, "text": None, "tags": [], "status": None, "pages": 0, "structured": False, "error": str(e)})
        return pd.DataFrame(rows)

    done = files.withColumn("x", convert("name", "content"))
    doc_id = F.regexp_replace("name", "[^A-Za-z0-9._/-]+", "-")
    return done.select(doc_id.alias("id"), F.col("x.title").alias("title"), F.col("name").alias("source"), F.coalesce("x.status", F.lit("PUBLISHED")).alias("status"),
                       F.col("x.tags").alias("tags"), F.col("modificationTime").alias("updated_at"), F.col("x.text").alias("content"), F.col("x.error").alias("error"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime_s) of a folder, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.where(~F.col("path").rlike(r"/\.[^/]*$")).select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime_s"))


def read_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, title, text) of a table of web pages (key, url, html)."""

    @F.pandas_udf("struct<title: string, text: string>")
    def convert(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{"title": html_title(t or ""), "text": html_markdown(t or "")[0]} for t in texts])

    return pages.withColumn("x", convert("html")).select(key, "url", "x.title", "x.text")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents given as JSON records."""
    return spark.read.schema("id string, title string, source string, status string, tags array<string>, metadata string, content string").json(path)


def from_base64(rows: DataFrame) -> DataFrame:
    """Files (name, data in base64) with their bytes; what is no base64 becomes null."""
    return rows.withColumn("content", F.expr("try_to_binary(data, 'base64')"))


def parse_tags(given) -> F.Column:
    """Tags given as a JSON array or a comma list."""
    as_json = F.from_json(given, "array<string>")
    return F.when(F.trim(given).startswith("["), as_json).otherwise(F.filter(F.transform(F.split(given, ","), lambda t: F.trim(t)), lambda t: t != ""))


def resolve_url(base: str, link: str) -> str | None:
    """An absolute http(s) address for a link on a page; other schemes give none."""
    link = link.strip().split("#", 1)[0]
    scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", link)
    if scheme:
        return link if scheme[1].lower() in ("http", "https") else None
    at = urlsplit(base)
    if not link or at.scheme not in ("http", "https"):
        return None
    if link.startswith("//"):
        return f"{at.scheme}:{link}"
    root = f"{at.scheme}://{at.netloc}"
    path = link if link.startswith("/") else at.path.rsplit("/", 1)[0] + "/" + link
    parts: list[str] = []
    for x in path.split("/"):
        if x == ".." and parts:
            parts.pop()
        elif x not in (".", "..", ""):
            parts.append(x)
    return root + "/" + "/".join(parts) + ("/" if path.endswith("/") and parts else "")


def url_id(url: str) -> str:
    """A stable id for a page's address."""
    at = urlsplit(url)
    bare = (at.netloc + at.path).strip("/") + (f"-{at.query}" if at.query else "")
    return "url/" + re.sub(r"[^A-Za-z0-9._/-]+", "-", bare)


def url_file_name(url: str, content_type: str = "") -> str:
    """A file name whose ending tells the format, from the address and the content type."""
    name = urlsplit(url).path.rstrip("/").rsplit("/", 1)[-1] or "index"
    kind = content_type.split(";")[0].strip().lower()
    end = {"text/html": "html", "application/xhtml+xml": "html", "application/pdf": "pdf", "text/markdown": "md", "text/plain": "txt"}.get(kind)
    if end and not name.lower().endswith("." + end):
        return f"{name}.{end}"
    return name if "." in name else name + ".html"


def fetch(url: str, most_bytes: int = 50 << 20, timeout: float = 30) -> tuple[str, bytes]:
    """(file name, bytes) of a web address; http and https only."""
    import urllib.request

    class Redirects(urllib.request.HTTPRedirectHandler):
        max_redirections = 5

    if urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"not a web address: {url}")
    with urllib.request.build_opener(Redirects).open(urllib.request.Request(url, headers={"User-Agent": "graphloom"}), timeout=timeout) as got:
        data = got.read(most_bytes + 1)
        if len(data) > most_bytes:
            raise ValueError(f"larger than {most_bytes} bytes: {url}")
        return url_file_name(got.url, got.headers.get("Content-Type", "")), data


def page_images(images: list[dict], page_url: str, get: Callable[[str, int, float], tuple[str, bytes]] = fetch, most: int = 80, most_bytes: int = 5 << 20) -> list[dict]:
    """Images of a page with the bytes behind their links; at most `most` are asked for, and those that fail are left out."""
    out, asked = [], 0
    for image in images:
        if m := re.match(r"data:image/[\w.+-]+;base64,", image.get("src") or ""):
            try:
                image = image | {"src": "", "data": base64.b64decode(image["src"][m.end():], validate=True)}
            except ValueError:
                continue
        url = None if image.get("data") else resolve_url(page_url, image.get("src") or "")
        if image.get("data"):
            out.append(image)
        elif url and asked < most:
            asked += 1
            try:
                out.append(image | {"src": url, "data": get(url, most_bytes, 15)[1]})
            except (ValueError, OSError):
                continue
    return out


def diagnosis(name: str, data: bytes, extractor=None, labels: tuple[str, ...] = (), threshold: float = 0.5) -> str:
    """What a file gives: its text as it is read or, with an extractor, the entities found in it, one a line."""
    text = extract(name, data)["text"]
    if extractor is None:
        return text
    found = extractor.extract(text.split("\n\n"), list(labels), threshold)
    best: dict[tuple[str, str], float] = {}
    for surface, label, score in (x for part in found for x in part):
        best[label, surface] = max(score, best.get((label, surface), 0.0))
    return "\n".join(f"{label}\t{surface}\t{score:.2f}" for (label, surface), score in sorted(best.items()))


def stored_name(doc_id: str, ending: str) -> str:
    return f"{fnv64(doc_id.encode())}.{ending}"


def stored_names(doc_id, ending: str) -> F.Column:
    """stored_name() of a column of ids."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: None if i is None else stored_name(i, ending))

    return run(doc_id)


def resolved_links(base, link) -> F.Column:
    """resolve_url() of columns; null where either is null."""

    @F.pandas_udf("string")
    def run(bases: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or x is None else resolve_url(b, x) for b, x in zip(bases, links, strict=True)], dtype=object)

    return run(base, link)


def image_file(data: bytes, ending: str) -> str:
    return f"{fnv64(data)}.{ending}"


def rewritten_links(content: str, names: dict[str, str]) -> str:
    """Image links of a Markdown text with the names under which the files are stored."""
    return re.sub(r"(!\[[^\]]*\]\()([^)\s]+)(\))", lambda m: m[1] + names.get(m[2], m[2]) + m[3], content)


def to_json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def inside(root: str, path: str) -> str:
    """The real path of a watched folder, links followed; an error if it is not below the watch root."""
    import os

    top, found = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([top, found]) != top:
        raise ValueError(f"outside the watch root: {path}")
    return found
