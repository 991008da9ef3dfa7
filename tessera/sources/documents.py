"""Readers of DOCX and PDF files: bytes to blocks of text with their headings.

A DOCX file is read as what it is, XML in a zip file, so no reader has to be installed. Its body becomes a list of (role, level,
text), roles come from paragraph styles, and neighbours of one role are one block. PDF needs one of two optional readers.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from tessera.functions.text import PARSER_NOISE

# Paragraph styles by what they mark, and heading levels of styles without a number.
BOX_TITLE_STYLES = {"Quote", "Intense Quote"}
BOX_TEXT_STYLES = {"Body Text", "Body Text 2", "Body Text 3"}
PROCEDURE_STYLES = {"List Number", "List Number 2", "List Number 3", "List Bullet", "List Bullet 2", "List Bullet 3"}
SCREEN_STYLES = {"HTML Preformatted", "Preformatted Text", "Code"}
SKIP_STYLES = {"toc 1", "toc 2", "toc 3", "toc 4", "TOC Heading", "Header", "Footer", "Balloon Text", "annotation text", "No Spacing", "Inside Address"}
NAMED_LEVELS = {"Title": 1, "Subtitle": 2}
_ROLES = {**dict.fromkeys(BOX_TITLE_STYLES, "box"), **dict.fromkeys(BOX_TEXT_STYLES, "boxed"), **dict.fromkeys(PROCEDURE_STYLES, "procedure"), **dict.fromkeys(SCREEN_STYLES, "screen"), **dict.fromkeys(SKIP_STYLES, "skip"), **dict.fromkeys(NAMED_LEVELS, "heading")}
#: Content type of each role's blocks, and whether they are kept whole, with their white space.
_TYPES = {"text": ("text", False, False), "box": ("definition", True, False), "procedure": ("procedure", False, False), "screen": ("screen_print", True, True), "table": ("table", False, False)}
_NOISE = [re.compile(p) for p in PARSER_NOISE]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def table_markdown(rows: list[list[str]]) -> str:
    """Rows as a pipe table; short rows are padded."""
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([c.strip() for c in r] + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _text(paragraph: ElementTree.Element) -> str:
    """Text of the runs, tabs and line breaks as such."""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in paragraph.iter())


def _cells(row: ElementTree.Element) -> list[str]:
    """A cell that spans columns is one element, so it comes once; a cell that goes on from the row above is empty there."""
    out = []
    for cell in row.findall(f"{_W}tc"):
        merged = cell.find(f"{_W}tcPr/{_W}vMerge")
        goes_on = merged is not None and merged.get(f"{_W}val", "continue") == "continue"
        out.append("" if goes_on else "\n".join(_text(p) for p in cell.iter(f"{_W}p")).strip().replace("\n", " "))
    return out


def docx_parts(content: bytes) -> Iterator[tuple[str, int, str]]:
    """(role, heading level or 0, text) of the body's paragraphs and tables in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                if name is not None:
                    names[style.get(f"{_W}styleId")] = name.get(f"{_W}val")
    for x in body if body is not None else ():
        if x.tag == f"{_W}tbl":
            yield "table", 0, table_markdown([_cells(r) for r in x.findall(f"{_W}tr")])
        elif x.tag == f"{_W}p":
            mark = x.find(f"{_W}pPr/{_W}pStyle")
            key = mark.get(f"{_W}val") if mark is not None else None
            style = names.get(key, key) or "Normal"
            number = re.match(r"heading\s*(\d+)", style, re.I)
            if number:
                yield "heading", int(number[1]), _text(x).strip()
            else:
                role = _ROLES.get(style, "text")
                yield role, NAMED_LEVELS.get(style, 0), _text(x) if role == "screen" else _text(x).strip()


def blocks_of(parts: Iterator[tuple[str, int, str]], stem: str) -> list[dict]:
    """Runs of one role as blocks. A box is a title and the boxed texts after it; boxed text elsewhere is text; tables, screens and
    boxes each begin a run of their own. A heading ends the run and replaces those of its level and below."""
    runs: list[tuple[str, list[str], tuple]] = []
    headings: tuple[tuple[int, str], ...] = ()
    open_run = False
    for role, level, text in parts:
        if not text.strip() or role == "skip":
            continue
        if role == "heading":
            headings = (*(h for h in headings if h[0] < level), (level, text))
            open_run = False
            continue
        last = runs[-1][0] if open_run else None
        if role == "boxed":
            role = "box" if last == "box" else "text"
            alone = False
        else:
            alone = role in ("box", "screen", "table")
        if last == role and not alone:
            runs[-1][1].append(text)
        else:
            runs.append((role, [text], headings))
            open_run = True
    out = []
    for role, lines, path in runs:
        content = "\n".join(lines)
        if any(p.search(content) for p in _NOISE):
            continue
        kind, atomic, whole = _TYPES[role]
        out.append({"content": content, "content_type": kind, "heading_path": [{"level": n, "text": t} for n, t in path], "context_prefix": " > ".join([stem, *(t for _, t in path)]), "atomic": atomic, "preserve_ws": whole})
    return out


def _page_blocks(number: int, text: str, tables: list[list[list]], stem: str) -> list[dict]:
    at = {"heading_path": [{"level": 1, "text": f"Page {number}"}], "context_prefix": f"{stem} > Page {number}", "atomic": False, "preserve_ws": False}
    text = text.strip()
    found = [{"content": text, "content_type": "text", **at}] if text and not any(p.search(text) for p in _NOISE) else []
    return found + [{"content": table_markdown([["" if c is None else str(c) for c in r] for r in rows]), "content_type": "table", **at} for rows in tables if len(rows) > 1]


def _pdf_pages(content: bytes) -> Iterator[tuple[str, list]]:
    """Text and tables of each page, by the first reader that is installed; the second one knows no tables."""
    try:
        import fitz
    except ImportError:
        import pypdf

        for page in pypdf.PdfReader(io.BytesIO(content)).pages:
            yield page.extract_text() or "", []
        return
    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            try:
                tables = [t.extract() or [] for t in page.find_tables()]
            except Exception:  # a page whose tables can't be told keeps its text
                tables = []
            yield page.get_text("text"), tables


def parse_binary(content: bytes, parser: str, stem: str = "") -> list[dict]:
    """Blocks of a document; a failure is a block that says so."""
    try:
        if parser == "pdf":
            return [b for i, (text, tables) in enumerate(_pdf_pages(content)) for b in _page_blocks(i + 1, text, tables, stem)]
        return blocks_of(docx_parts(content), stem)
    except Exception as e:  # a broken file must not end the job
        return [{"content": f"[{parser.upper()} parse error: {e}]", "content_type": "text", "heading_path": [], "context_prefix": stem, "atomic": False, "preserve_ws": False}]


def images_of(content: bytes) -> list[tuple[str, bytes]]:
    """Name and bytes of the images in a DOCX file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(n.rpartition("/")[2], z.read(n)) for n in sorted(z.namelist()) if n.startswith("word/media/")]


def decoded(content: bytes) -> str:
    """Text of bytes whose encoding isn't told: by a byte order mark, as UTF-8, by zeros in every other place as UTF-16, else as
    Windows-1252 with what it lacks replaced."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    try:
        if b"\0" not in content:
            return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")
    for name, zeros in (("utf-16-le", content[1::2]), ("utf-16-be", content[::2])):
        if zeros.count(0) * 2 > len(zeros):
            return content.decode(name, "replace")
    return content.decode("utf-8", "replace")
