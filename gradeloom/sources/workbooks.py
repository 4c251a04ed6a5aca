"""Spreadsheet workbooks as long cells.

Files come through Spark's binaryFile source, so any store works; a task reads one file
at a time. The container's central directory gives sizes and offsets; entries are stored
or deflated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

STORED, DEFLATED = 0, 8
CELLS = "path string, sheet int, name string, r int, c int, value string, kind string"


def central_directory(data: bytes) -> dict[str, tuple[int, int, int]]:
    """name -> (method, packed size, offset of the data); ValueError if it isn't a container."""
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 66_000))
    if end < 0:
        raise ValueError("not a workbook: no central directory")
    count, at = int.from_bytes(data[end + 10 : end + 12], "little"), int.from_bytes(data[end + 16 : end + 20], "little")
    out = {}
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        method, size = int.from_bytes(data[at + 10 : at + 12], "little"), int.from_bytes(data[at + 20 : at + 24], "little")
        lengths = [int.from_bytes(data[at + i : at + i + 2], "little") for i in (28, 30, 32)]
        local = int.from_bytes(data[at + 42 : at + 46], "little")
        name = data[at + 46 : at + 46 + lengths[0]].decode("utf-8")
        # the local header repeats the lengths, and only its own are right for the data
        start = local + 30 + int.from_bytes(data[local + 26 : local + 28], "little") + int.from_bytes(data[local + 28 : local + 30], "little")
        out[name] = (method, size, start)
        at += 46 + sum(lengths)
    return out


def entry(data: bytes, where: tuple[int, int, int]) -> bytes:
    method, size, start = where
    raw = data[start : start + size]
    if method == STORED:
        return raw
    if method == DEFLATED:
        return zlib.decompress(raw, -15)
    raise ValueError(f"compression method {method} is not supported")


def column_index(ref: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def shared_strings(xml: bytes) -> list[str]:
    return [_texts(si) for si in ElementTree.fromstring(xml) if _local(si.tag) == "si"]


def sheet_cells(xml: bytes, strings: list[str]) -> Iterator[tuple[int, int, str | None, str]]:
    """(row, column, text, kind) of the cells that are there; kinds: number, string, boolean, error."""
    row = -1
    for node in ElementTree.fromstring(xml).iter():
        if _local(node.tag) != "row":
            continue
        row = int(node.get("r", row + 2)) - 1
        column = -1
        for c in node:
            if _local(c.tag) != "c":
                continue
            column = column_index(c.get("r")) if c.get("r") else column + 1
            kind = c.get("t", "n")
            value = next((v.text for v in c if _local(v.tag) == "v"), None)
            if kind == "s":
                yield row, column, strings[int(value)] if value is not None else None, "string"
            elif kind == "inlineStr":
                yield row, column, _texts(c), "string"
            elif kind == "str":
                yield row, column, value, "string"
            elif kind == "b":
                yield row, column, {"1": "true", "0": "false"}.get(value or "", None), "boolean"
            elif value is not None:
                yield row, column, value, "error" if kind == "e" else "number"


def sheet_parts(names: list[str]) -> list[str]:
    """Worksheet parts by their number."""
    import re

    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n))]
    return [n for _, n in sorted(found)]


def sheet_names(xml: bytes) -> list[str]:
    return [n.get("name", "") for n in ElementTree.fromstring(xml).iter() if _local(n.tag) == "sheet"]


def workbook_cells(data: bytes, every: bool = False) -> Iterator[tuple]:
    """(sheet, name, row, column, text, kind) of the first worksheet, or of all."""
    parts = central_directory(data)
    strings = shared_strings(entry(data, parts["xl/sharedStrings.xml"])) if "xl/sharedStrings.xml" in parts else []
    names = sheet_names(entry(data, parts["xl/workbook.xml"])) if "xl/workbook.xml" in parts else []
    sheets = sheet_parts(list(parts))
    if not sheets:
        raise ValueError("the workbook has no worksheet")
    for i, part in enumerate(sheets if every else sheets[:1]):
        for cell in sheet_cells(entry(data, parts[part]), strings):
            yield i, names[i] if i < len(names) else None, *cell


def read_workbooks(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    """(path, sheet, name, r, c, value, kind) of the workbooks below a path."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in CELLS.split(", ")]
        for df in parts:
            for name, content in zip(df["path"], df["content"], strict=True):
                yield pd.DataFrame([(name, *x) for x in workbook_cells(bytes(content), every)], columns=cols)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, CELLS)
