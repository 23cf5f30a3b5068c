"""Workbooks as cell grids. A spreadsheet is a zip of XML parts, which the standard library reads; so are its images."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schemas import CELLS

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
ART = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _links(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relationship ids of a part, with the parts they lead to."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in book.namelist():
        return {}
    target = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {r.get("Id"): target(r.get("Target")) for r in ET.fromstring(book.read(path))}


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = _links(book, "xl/workbook.xml")
    root = ET.fromstring(book.read("xl/workbook.xml"))
    return [(s.get("name"), links[s.get(f"{REL}id")]) for s in root.iter(f"{MAIN}sheet")]


def read_cells(content: bytes) -> Iterator[tuple[str, int, int, int, str]]:
    """sheet, its place, row, column, text of every cell with a value; rows and columns count from 0."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        for at, (name, part) in enumerate(_sheets(book)):
            for c in ET.fromstring(book.read(part)).iter(f"{MAIN}c"):
                kind, value = c.get("t"), c.find(f"{MAIN}v")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif value is None:
                    continue
                else:
                    text = shared[int(value.text)] if kind == "s" else value.text
                ref = c.get("r")
                yield name, at, int(re.search(r"\d+", ref)[0]) - 1, _column(ref), text


def read_images(content: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """sheet, row, column, bytes of every picture, by the cell that its upper left corner is anchored to."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        for name, part in _sheets(book):
            for drawing in (p for p in _links(book, part).values() if "/drawings/" in p and p.endswith(".xml")):
                pictures = _links(book, drawing)
                for anchor in ET.fromstring(book.read(drawing)):
                    start, blip = anchor.find(f"{DRAWING}from"), anchor.find(f".//{ART}blip")
                    if start is not None and blip is not None and blip.get(f"{REL}embed") in pictures:
                        yield name, int(start.find(f"{DRAWING}row").text), int(start.find(f"{DRAWING}col").text), book.read(pictures[blip.get(f"{REL}embed")])


def cells(spark: SparkSession, path: str) -> DataFrame:
    """The cell grid of all workbooks below path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(book, *c) for c in read_cells(content)], columns=["workbook", "sheet", "sheet_ord", "row0", "col0", "text"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInPandas(run, CELLS)


def images(spark: SparkSession, path: str) -> DataFrame:
    """workbook, sheet, row0, col0, image_ord, content of the pictures of all workbooks below path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(book, s, r, c, i, b) for i, (s, r, c, b) in enumerate(read_images(content))]
                yield pd.DataFrame(rows, columns=["workbook", "sheet", "row0", "col0", "image_ord", "content"])

    schema = "workbook string, sheet string, row0 int, col0 int, image_ord int, content binary"
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInPandas(run, schema)
