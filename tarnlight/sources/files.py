"""Files of several formats as located blocks: every file is read by Spark and parsed in the task that holds it."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.sources.blocks import ORG_HEADING, TEXT_HEADING, markdown_parts

# The file types that are read unless others are given.
EXTENSIONS = ("txt", "md", "markdown", "html", "htm", "epub", "pdf", "docx", "org")
_HIDDEN = {"style", "script", "head", "noscript", "iframe", "svg"}
_BREAKS = {"p", "div", "br", "li", "tr", "section", "article", "ul", "ol", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Page(HTMLParser):
    """Blocks of a page, a new one at each heading of the first four levels."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, list[str]]] = [("Full Document", [])]
        self.hidden, self.heading = 0, None

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in ("h1", "h2", "h3", "h4"):
            self.heading = ""
        elif tag in _BREAKS:
            self.blocks[-1][1].append("\n")

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("h1", "h2", "h3", "h4") and self.heading is not None:
            title = " ".join(self.heading.split())
            self.heading = None
            if title:
                self.blocks.append((title, [title, "\n"]))
        elif tag in _BREAKS:
            self.blocks[-1][1].append("\n")

    def handle_data(self, data):
        if self.hidden:
            return
        if self.heading is not None:
            self.heading += data
        else:
            self.blocks[-1][1].append(data)


def html_parts(text: str) -> list[tuple[str, str]]:
    page = _Page()
    page.feed(text)
    page.close()
    out = []
    for place, parts in page.blocks:
        body = re.sub(r"[ \t]*\n\s*", "\n", "".join(parts))
        body = re.sub(r"[ \t]+", " ", body).strip()
        if body:
            out.append((place, body))
    return out


def lines_parts(text: str, heading: str, place: str = "Full Document") -> list[tuple[str, str]]:
    """Blocks of a text cut before each heading line, which stays in its block."""
    pattern, blocks = re.compile(heading), [(place, [])]
    for line in text.split("\n"):
        if pattern.match(line):
            blocks.append((line.strip().lstrip("* ").strip(), []))
        blocks[-1][1].append(line)
    return [(p, body) for p, ls in blocks if (body := "\n".join(ls).strip())]


def docx_parts(data: bytes) -> list[tuple[str, str]]:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    blocks: list[tuple[str, list[str]]] = [("Full Document", [])]
    for paragraph in root.iter(f"{space}p"):
        text = "".join(t.text or "" for t in paragraph.iter(f"{space}t")).strip()
        if not text:
            continue
        if len(text) < 80 and (text.isupper() or re.match(r"(?i)(chapter|section|part|book)\b", text)):
            blocks.append((text, []))
        else:
            blocks[-1][1].append(text)
    return [(p, "\n".join(ls)) for p, ls in blocks if ls]


def epub_parts(data: bytes) -> list[tuple[str, str]]:
    """Blocks in reading order; without a package file the pages in order of their names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        pages = sorted(n for n in names if n.lower().endswith((".html", ".xhtml", ".htm")))
        package = next((n for n in names if n.endswith(".opf")), None)
        try:
            box = ElementTree.fromstring(z.read("META-INF/container.xml"))
            package = next((e.get("full-path") for e in box.iter() if e.tag.endswith("rootfile")), package)
        except (KeyError, ElementTree.ParseError):
            pass
        if package in names:
            root = ElementTree.fromstring(z.read(package))
            items = {e.get("id"): e.get("href") for e in root.iter() if e.tag.endswith("}item")}
            base = package.rpartition("/")[0]
            order = [f"{base}/{items[e.get('idref')]}".lstrip("/") for e in root.iter() if e.tag.endswith("}itemref") and e.get("idref") in items]
            pages = [n for n in order if n in names] or pages
        out = []
        for name in pages:
            parts = html_parts(z.read(name).decode("utf-8", "replace"))
            if parts:
                title = next((p for p, _ in parts if p != "Full Document"), name.rpartition("/")[2].rpartition(".")[0].replace("_", " ").title())
                out.append((title, "\n".join(body for _, body in parts)))
    return out


def pdf_parts(data: bytes) -> list[tuple[str, str]]:
    """Pages with text; needs the optional reader."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf") from e
    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
    return [(f"Page {n}", text) for n, text in enumerate(pages, 1) if text.strip()]


def file_parts(path: str, data: bytes) -> list[tuple[str, str]]:
    """Blocks of a file by its extension."""
    kind = path.rpartition(".")[2].lower()
    if kind == "docx":
        return docx_parts(data)
    if kind == "epub":
        return epub_parts(data)
    if kind == "pdf":
        return pdf_parts(data)
    text = data.decode("utf-8", "replace")
    if kind in ("md", "markdown"):
        return markdown_parts(text)
    if kind in ("html", "htm"):
        return html_parts(text)
    if kind == "org":
        return lines_parts(text, ORG_HEADING, "Intro")
    if kind == "txt":
        return lines_parts(text, TEXT_HEADING)
    raise ValueError(f"no reader for .{kind} files")


def scan_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``(path, checksum, content)`` of the files below a folder; hidden files and folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    inside = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return files.where(kind.isin(*extensions) & ~F.substring(inside, len(folder.rstrip("/")) + 1, 10_000).rlike(r"/\.")).select("path", F.sha2("content", 256).alias("checksum"), "content")


def ingest(files: DataFrame, known: DataFrame) -> DataFrame:
    """``(path, checksum, block, location, text)`` of files whose checksum is not known; a file that cannot be read has no rows."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, checksum, data in zip(batch["path"], batch["checksum"], batch["content"]):
                try:
                    rows += [(path, checksum, n, p, t) for n, (p, t) in enumerate(file_parts(path, bytes(data)))]
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(rows, columns=["path", "checksum", "block", "location", "text"])

    fresh = files.join(known.select("checksum"), "checksum", "left_anti").select("path", "checksum", "content").dropDuplicates(["checksum"])
    return fresh.mapInPandas(run, "path string, checksum string, block int, location string, text string")


def append_rows(df: DataFrame, table: str) -> None:
    """Add rows to a stored table; Parquet's commit makes the batch appear as a whole."""
    df.write.mode("append").parquet(table)
