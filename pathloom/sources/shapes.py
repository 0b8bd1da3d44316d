"""Road networks in shape files, as a Python data source: attributes in record order, points of node layers.

``spark.read.format("road_table").option("kind", "edges").load("roads.dbf")`` gives (fid, u, v, length, ord) and kind
``nodes`` gives (osmid, x, y, ord) from a .dbf with its .shp beside it.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {
    "edges": ("fid long, u long, v long, length double, ord long", ("fid", "u", "v"), ("length",)),
    "nodes": ("osmid long, x double, y double, ord long", ("osmid",), ()),
}
POINTS = {1, 11, 21}  # point, with z, with m
ROWS = 100_000


class Table:
    """Header and fields of a dBASE file."""

    def __init__(self, path: str):
        data = Path(path).read_bytes()[:32]
        if len(data) < 32:
            raise ValueError(f"{path}: no header")
        self.path = path
        self.count, self.start, self.width = struct.unpack("<IHH", data[4:12])
        with open(path, "rb") as f:
            head = f.read(self.start)
        if len(head) < self.start:
            raise ValueError(f"{path}: the header is cut off")
        self.fields, at = {}, 1
        for i in range(32, self.start - 1, 32):
            if head[i] == 0x0D:
                break
            name, kind, size, places = head[i : i + 11].split(b"\0")[0].decode("ascii"), chr(head[i + 11]), head[i + 16], head[i + 17]
            if name in self.fields:
                raise ValueError(f"{path}: field {name} twice")
            self.fields[name] = (kind, at, size, places)
            at += size
        if at != self.width:
            raise ValueError(f"{path}: fields of {at} bytes in records of {self.width}")
        rest = Path(path).stat().st_size - self.start - self.count * self.width
        if rest not in (0, 1):
            raise ValueError(f"{path}: {rest} bytes beside the records")

    def records(self, first: int, last: int) -> Iterator[tuple[int, bytes]]:
        with open(self.path, "rb") as f:
            f.seek(self.start + first * self.width)
            for i in range(first, last):
                row = f.read(self.width)
                if len(row) < self.width:
                    raise ValueError(f"record {i}: cut off")
                if row[:1] == b"*":
                    raise ValueError(f"record {i}: deleted")
                yield i, row

    def text(self, row: bytes, name: str, record: int) -> str:
        if name not in self.fields:
            raise ValueError(f"record {record}: no field {name}")
        _, at, size, _ = self.fields[name]
        found = row[at : at + size].decode("ascii").strip()
        if not found:
            raise ValueError(f"record {record}: {name} is missing")
        return found


def unsigned(text: str, name: str, record: int) -> int:
    """A whole number from 0 to 2^64 - 1, written as such or as a float without a fraction."""
    try:
        value = int(text) if text.lstrip("+").isdigit() else float(text)
    except ValueError:
        value = math.nan
    if not math.isfinite(value) or value < 0 or value != int(value) or value >= 2**64:
        raise ValueError(f"record {record}: {name} is {text!r}")
    return int(value)


class Span(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[Span]:
        n = Table(self.path).count
        return [Span(i, min(i + ROWS, n)) for i in range(0, n, ROWS)] or [Span(0, 0)]

    def read(self, part: Span) -> Iterator[tuple]:
        table, (_, whole, real) = Table(self.path), KINDS[self.kind]
        shapes = self._points(part) if self.kind == "nodes" else None
        for i, row in table.records(part.first, part.last):
            values = [unsigned(table.text(row, n, i), n, i) for n in whole]
            for n in real:
                value = float(table.text(row, n, i))
                values.append(value)
            if shapes is not None:
                place = shapes[i]
                if place is None:
                    continue  # not a point
                values += place
            yield (*values, i)

    def _points(self, part: Span) -> dict[int, tuple[float, float] | None]:
        """Places of the records of a span. Records have a length in front, so the file is walked from its start."""
        out, i = {}, 0
        with open(Path(self.path).with_suffix(".shp"), "rb") as f:
            f.seek(100)
            while i < part.last and (head := f.read(8)):
                size = struct.unpack(">i", head[4:])[0] * 2
                body = f.read(size)
                if i >= part.first:
                    kind = struct.unpack("<i", body[:4])[0]
                    out[i] = struct.unpack("<dd", body[4:20]) if kind in POINTS else None
                i += 1
        return out


class RoadTable(DataSource):
    """Format ``road_table``; options ``path`` and ``kind`` (edges or nodes)."""

    @classmethod
    def name(cls) -> str:
        return "road_table"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "edges")][0]

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("kind", "edges"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RoadTable)
