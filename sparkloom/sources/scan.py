"""A data source for sheets in folders: root/category/year/file, read by file and range, with bad lines kept.

    spark.dataSource.register(scan.Sheets)
    spark.read.format("sheets").option("path", root).option("required", "ID,Query").load()

Columns: file, category, year, line, cells (map of the header's names), bad (the line as it stands, where it has more cells than the header or is cut off; its cells are
null). The options category and year, lists with commas, reach the listing: files of other folders are never opened. They are options and no pushed filters since
Spark 4.1 keeps what was pushed once for all later queries on the same DataFrame. A file without the required names fails.

Rows end at line ends unless quoted; where `split` (bytes) is set, rows are taken not to hold line ends, and a file goes to as many tasks as it has such ranges: a
range owns the lines that begin in it. Encodings are tried file by file, in order: a file is read as the first one that its first MEGABYTE fits."""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Encodings in the order in which they are tried; the last one fits everything.
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
MEGABYTE = 1 << 20


def system(path: str):
    """(file system, path): any store that pyarrow knows by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{os.path.abspath(path)}")


def encoding_of(head: bytes) -> str:
    for name in ENCODINGS:
        try:
            head.decode(name)
        except UnicodeDecodeError as error:
            if name == "utf-8-sig" and len(head) >= MEGABYTE and error.start >= len(head) - 4:  # a character that the sample cuts
                return name
            continue
        return name
    return ENCODINGS[-1]


@dataclass
class Piece(InputPartition):
    path: str
    category: str | None
    year: str | None
    begin: int
    end: int  # -1: the whole file


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.required = options["path"], [n.strip() for n in options.get("required", "").split(",") if n.strip()]
        self.extensions = tuple(e.strip().lower() for e in options.get("extensions", ".csv").split(","))
        self.split = int(options.get("split", 0))
        self.wanted = {name: {v.strip() for v in options[name].split(",")} for name in ("category", "year") if name in options}

    def partitions(self) -> list[Piece]:
        from pyarrow import fs

        files, root = system(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == fs.FileType.Directory else [files.get_file_info(root)]
        out = []
        for info in sorted(found, key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.path.lower().endswith(self.extensions):
                continue
            under = info.path[len(root) :].strip("/").split("/")
            category, year = (under[0], under[1]) if len(under) == 3 else (under[0], None) if len(under) == 2 else (None, None)
            if any(value not in self.wanted[name] for name, value in (("category", category), ("year", year)) if name in self.wanted):
                continue
            ranges = [(a, a + self.split) for a in range(0, max(1, info.size), self.split)] if self.split else [(0, -1)]
            out += [Piece(info.path, category, year, a, b) for a, b in ranges]
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        files, _ = system(self.path)
        with files.open_input_file(piece.path) as stream:
            head = stream.read(MEGABYTE)
            encoding = encoding_of(head)
            if piece.end < 0:
                stream.seek(0)
                text = io.TextIOWrapper(_Whole(stream), encoding, errors="replace", newline="")
                yield from self._rows(piece, _numbered(text), None)
            else:
                text = head.decode(encoding, "replace")
                header = self._header(piece, csv.reader(io.StringIO(text, newline="")))
                yield from self._rows(piece, _lines(stream, piece, encoding), header)

    def _header(self, piece: Piece, rows: Iterator[list[str]]) -> list[str]:
        names = {n.lower() for n in self.required}
        for row in rows:
            if any(c.strip() for c in row) and names <= {c.strip().lower() for c in row}:
                return [c.strip() for c in row]
        raise ValueError(f"{piece.path}: no header with {', '.join(self.required)}")

    def _rows(self, piece: Piece, lines: Iterator[tuple[int, str]], header: list[str] | None) -> Iterator[tuple]:
        """Rows from lines; a row takes the lines that its quotes hold together."""
        names = {n.lower() for n in self.required}
        waiting, number = "", 0
        for at, line in lines:
            number = number if waiting else at
            waiting += line
            if piece.end < 0 and waiting.count('"') % 2:
                continue
            row = next(csv.reader(io.StringIO(waiting, newline="")), [])
            whole, waiting = waiting.rstrip("\r\n"), ""
            if not any(c.strip() for c in row):
                continue
            if header is None:
                if names <= {c.strip().lower() for c in row}:
                    header = [c.strip() for c in row]
                continue
            if [c.strip() for c in row] == header:
                continue  # the header itself, where a range begins with it
            bad = len(row) > len(header) or whole.count('"') % 2
            yield (piece.path, piece.category, piece.year, number, None if bad else dict(zip(header, row, strict=False)), whole if bad else None)
        if waiting:
            yield (piece.path, piece.category, piece.year, number, None, waiting.rstrip("\r\n"))
        if header is None:
            raise ValueError(f"{piece.path}: no header with {', '.join(self.required)}")


class _Whole(io.RawIOBase):
    """What TextIOWrapper reads of a stream."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.stream.read(len(into))
        into[: len(data)] = data
        return len(data)


def _numbered(text: io.TextIOWrapper) -> Iterator[tuple[int, str]]:
    yield from enumerate(text)


def _lines(stream, piece: Piece, encoding: str) -> Iterator[tuple[int, str]]:
    """Lines that begin in the piece, with the places of their first bytes."""
    at = max(piece.begin - 1, 0)
    stream.seek(at)
    rest, first = b"", piece.begin > 0  # what ends the line before isn't ours
    while True:
        data = stream.read(MEGABYTE)
        parts = (rest + data).split(b"\n")
        rest = parts.pop() if data else b""
        for part in parts:
            if not first and at >= piece.end:
                return
            if not first and (part or data):
                yield at, (part + b"\n").decode(encoding if at == 0 else encoding.removesuffix("-sig"), "replace")
            first, at = False, at + len(part) + 1
        if not data:
            return


class Sheets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return "file string, category string, year string, line long, cells map<string,string>, bad string"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def read_sheets(spark: SparkSession, path: str, required: list[str], category: list[str] | None = None, year: list[str] | None = None, split: int = 0, extensions: tuple[str, ...] = (".csv",)) -> DataFrame:
    """The rows of all sheets under a path, or of those of some categories and years."""
    spark.dataSource.register(Sheets)
    options = {"required": ",".join(required), "extensions": ",".join(extensions)} | ({"split": split} if split else {})
    options |= {name: ",".join(values) for name, values in (("category", category), ("year", year)) if values is not None}
    return spark.read.format("sheets").options(**options).load(path)
