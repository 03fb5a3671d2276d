"""Office files as Markdown and structure, from their zipped XML with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _find(e, *names: str):
    return [x for x in e.iter() if _tag(x) in names]


def _text(e) -> str:
    return "".join(t.text or "" for t in _find(e, "t")).strip()


def _table(rows: list[list[str]]) -> list[str]:
    if not rows:
        return []
    bar = lambda cells: "| " + " | ".join(cells) + " |"
    return [bar(rows[0]), bar(["---"] * len(rows[0])), *map(bar, rows[1:])]


def docx_markdown(raw: bytes) -> str:
    """Paragraphs with headings and lists, then tables; empty where it can't be read."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error):
        return ""
    tables = _find(body, "tbl")
    inside = {id(p) for t in tables for p in _find(t, "p")}
    out = []
    for p in _find(body, "p"):
        if id(p) in inside:
            continue
        style = next((v for s in _find(p, "pStyle") for k, v in s.attrib.items() if k.endswith("val")), "").replace(" ", "")
        text = _text(p)
        level = re.fullmatch(r"Heading([123])", style)
        out.append(text and (f"{'#' * int(level[1])} {text}" if level else f"- {text}" if style.startswith("List") else text))
    for t in tables:
        out += _table([[_text(c) for c in _find(r, "tc")] for r in _find(t, "tr")])
    return "\n".join(out)


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n


def workbook(raw: bytes) -> list[tuple[str, dict[int, dict[int, str]], list[tuple[str, str]]]]:
    """Sheets in order: name, cells by row and column, and named tables with their ranges."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        names = set(z.namelist())
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []

        def links(part: str) -> dict[str, str]:
            folder, file = part.rsplit("/", 1)
            rels = f"{folder}/_rels/{file}.rels"
            if rels not in names:
                return {}
            go = lambda t: t.lstrip("/") if t.startswith("/") else "xl/" + re.sub(r"^(\.\./)+", "", t)
            return {e.attrib["Id"]: go(e.attrib["Target"]) for e in ElementTree.fromstring(z.read(rels))}

        to, out = links("xl/workbook.xml"), []
        for s in _find(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
            part = to.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), "")
            cells: dict[int, dict[int, str]] = {}
            for c in _find(ElementTree.fromstring(z.read(part)), "c") if part in names else []:
                value = next((v.text or "" for v in _find(c, "v")), None)
                value = _text(c) if c.attrib.get("t") == "inlineStr" else shared[int(value)] if value and c.attrib.get("t") == "s" else value
                if value not in (None, ""):
                    ref = c.attrib.get("r", "")
                    cells.setdefault(int(re.sub(r"\D", "", ref) or 0), {})[_column(ref)] = value
            own = [ElementTree.fromstring(z.read(t)).attrib for t in links(part).values() if "tables/" in t and t in names] if part in names else []
            out.append((s.attrib.get("name", ""), cells, [(t.get("displayName") or t.get("name", ""), t.get("ref", "")) for t in own]))
        return out
    except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError, zlib.error):
        return []


def xlsx_markdown(raw: bytes) -> str:
    out = []
    for name, cells, _ in workbook(raw):
        if cells:
            wide = max(max(r) for r in cells.values())
            out += [f"## Sheet: {name}", *_table([[cells[r].get(c, "") for c in range(1, wide + 1)] for r in sorted(cells)])]
    return "\n".join(out)


def xlsx_structure(raw: bytes) -> list[dict[str, str | None]]:
    """Sheets, named tables in them, and tables' columns: (sheet, table, column)."""
    out: list[dict[str, str | None]] = []
    for name, cells, tables in workbook(raw):
        out.append({"sheet": name, "tbl": None, "col": None})
        for table, ref in tables:
            out.append({"sheet": name, "tbl": table, "col": None})
            if m := re.match(r"([A-Z]+)(\d+):([A-Z]+)\d+$", ref):
                head = cells.get(int(m[2]), {})
                out += [{"sheet": name, "tbl": table, "col": head[c]} for c in range(_column(m[1]), _column(m[3]) + 1) if head.get(c)]
    return out


def pdf_text(raw: bytes) -> str:
    """Strings that a PDF's text operators show, from plain and deflated streams; empty where there are none."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        for t in re.finditer(rb"BT\b(.*?)\bET\b", data, re.S):
            shown = [re.sub(rb"\\([()\\])", rb"\1", s) for s in re.findall(rb"\(((?:\\.|[^()\\])*)\)", t[1])]
            out.append(b"".join(shown).decode("latin-1"))
    return "\n".join(x for x in out if x.strip())


def as_text(content: Column, path: Column) -> Column:
    """Text of a document's bytes: office files and PDF by their own readers, others as UTF-8."""

    @F.pandas_udf("string")
    def read(raw: pd.Series, name: pd.Series) -> pd.Series:
        of = {"docx": docx_markdown, "xlsx": xlsx_markdown, "pdf": pdf_text}
        return pd.Series([of[n.rsplit(".", 1)[-1].lower()](b) if b is not None else None for b, n in zip(raw, name, strict=True)])

    special = F.lower(path).rlike("\\.(docx|xlsx|pdf)$")
    return F.when(special, read(F.when(special, content), F.when(special, path).otherwise(F.lit("x.pdf")))).otherwise(F.decode(content, "UTF-8"))


def structure(content: Column) -> Column:
    @F.pandas_udf("array<struct<sheet:string,tbl:string,col:string>>")
    def read(raw: pd.Series) -> pd.Series:
        return pd.Series([xlsx_structure(b) if b is not None else [] for b in raw])

    return read(content)
