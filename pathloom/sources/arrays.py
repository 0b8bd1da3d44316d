"""Arrays in NumPy's file format as a data source: single files read by row ranges, and committed folders of ragged rows.

    spark.dataSource.register(ArrayFiles)
    spark.read.format("array_files").load("….npy")        # (row, value) or (row, values)
    rows.write.format("array_files").mode("append").save(folder)   # (row long, values array)

A folder holds, for each part, the files of its row numbers, of where each row's values end, and of all values on end. Tasks
write parts of a bounded size under names of their own; the index that the driver writes last, beside its name and then
under it, makes them a table. A folder without an index isn't one. A job removes the files of its own tasks that failed, and
all of them when it is aborted; what a task writes that is killed later still stays and is of no account.
"""

from __future__ import annotations

import io
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

INDEX = "_index.json"
#: Rows of a split that is read, and of a part that is written.
ROWS = 1 << 16
KINDS = {"i": ("long", np.int64), "u": ("long", np.int64), "f": ("double", np.float64)}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Header:
    shape: tuple[int, ...]
    dtype: np.dtype
    start: int


def header(fs: pafs.FileSystem, path: str) -> Header:
    """What a file says of its array; objects, columns first, and other than one or two dimensions of numbers are errors."""
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        head = io.BytesIO(f.read(min(size, 1 << 16)))
    version = np.lib.format.read_magic(head)
    shape, columns_first, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if dtype.kind not in KINDS or len(shape) not in (1, 2) or (columns_first and len(shape) == 2 and min(shape) > 1):
        raise ValueError(f"{path}: no table of numbers: {dtype}, {shape}")
    if size - head.tell() != math.prod(shape) * dtype.itemsize:
        raise ValueError(f"{path}: {size - head.tell()} bytes for {shape} of {dtype}")
    return Header(shape, dtype, head.tell())


def part_of(fs: pafs.FileSystem, path: str, first: int, last: int) -> np.ndarray:
    """Rows ``first`` to ``last``, read by their bytes alone."""
    h = header(fs, path)
    width = math.prod(h.shape[1:]) * h.dtype.itemsize
    with fs.open_input_file(path) as f:
        f.seek(h.start + first * width)
        data = f.read((last - first) * width)
    return np.frombuffer(data, h.dtype).reshape(last - first, *h.shape[1:]).astype(KINDS[h.dtype.kind][1])


@dataclass
class Rows(InputPartition):
    first: int
    last: int


@dataclass
class Part(InputPartition):
    name: str
    rows: int


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_files"

    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    def _index(self) -> dict | None:
        fs, path = opened(self._path())
        kind = fs.get_file_info(path).type
        if kind != pafs.FileType.Directory:
            return None
        if fs.get_file_info(f"{path}/{INDEX}").type != pafs.FileType.File:
            raise FileNotFoundError(f"{path} has no {INDEX}: it was never committed")
        with fs.open_input_stream(f"{path}/{INDEX}") as f:
            return json.loads(f.read())

    def schema(self) -> str:
        if index := self._index():
            return f"row long, values array<{index['kind']}>"
        h = header(*opened(self._path()))
        kind = KINDS[h.dtype.kind][0]
        return f"row long, value {kind}" if len(h.shape) == 1 else f"row long, values array<{kind}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        index = self._index()
        return FolderReader(self._path(), index["parts"]) if index else FileReader(self._path(), int(self.options.get("rows", ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        kinds = {LongType(): "long", DoubleType(): "double"}
        fields = {f.name: f.dataType for f in schema.fields}
        values = fields.get("values")
        if set(fields) != {"row", "values"} or fields["row"] != LongType() or not isinstance(values, ArrayType) or values.elementType not in kinds:
            raise ValueError("array files hold (row long, values array<long> or array<double>)")
        if overwrite:
            raise ValueError("a committed folder isn't overwritten")
        return FolderWriter(self._path(), kinds[values.elementType], int(self.options.get("rows", ROWS)))


class FileReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Rows]:
        n = header(*opened(self.path)).shape[0]
        return [Rows(a, min(a + self.rows, n)) for a in range(0, n, self.rows)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        values = part_of(*opened(self.path), part.first, part.last)
        column = pa.array(values) if values.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.last)), column], names=["row", "value" if values.ndim == 1 else "values"])


class FolderReader(DataSourceReader):
    def __init__(self, path: str, parts: list[dict]):
        self.path, self.parts = path, parts

    def partitions(self) -> list[Part]:
        return [Part(p["name"], p["rows"]) for p in self.parts] or [Part("", 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        fs, path = opened(self.path)
        whole = lambda what: part_of(fs, f"{path}/{part.name}.{what}.npy", 0, header(fs, f"{path}/{part.name}.{what}.npy").shape[0])
        rows, ends, values = whole("rows"), whole("ends"), whole("values")
        if len(rows) != part.rows or len(ends) != part.rows or ends[-1] != len(values):
            raise ValueError(f"{part.name}: not what was committed")
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values))], names=["row", "values"])


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict]


class FolderWriter(DataSourceWriter):
    """Nulls, of rows or within values, are errors; empty rows are kept."""

    def __init__(self, path: str, kind: str, rows: int):
        self.path, self.kind, self.rows, self.job = path, kind, rows, uuid.uuid4().hex
        fs, target = opened(path)
        if fs.get_file_info(f"{target}/{INDEX}").type == pafs.FileType.File:
            raise FileExistsError(f"{path} is committed already")

    def _part(self, fs: pafs.FileSystem, path: str, rows: list[int], values: list[list]) -> dict:
        name = f"part-{self.job}-{uuid.uuid4().hex}"
        flat = [x for own in values for x in own]
        if None in flat or None in rows:
            raise ValueError("array files hold no nulls")
        arrays = {"rows": np.array(rows, np.int64), "ends": np.cumsum([len(v) for v in values]).astype(np.int64), "values": np.array(flat, np.int64 if self.kind == "long" else np.float64)}
        for what, array in arrays.items():
            data = io.BytesIO()
            np.lib.format.write_array(data, array, version=(1, 0), allow_pickle=False)
            with fs.open_output_stream(f"{path}/{name}.{what}.npy") as f:
                f.write(data.getvalue())
        return {"name": name, "rows": len(rows)}

    def write(self, iterator) -> Written:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        parts, rows, values = [], [], []
        for r in iterator:
            if r["values"] is None:
                raise ValueError("array files hold no nulls")
            rows.append(r["row"])
            values.append(r["values"])
            if len(rows) == self.rows:
                parts.append(self._part(fs, path, rows, values))
                rows, values = [], []
        if rows:
            parts.append(self._part(fs, path, rows, values))
        return Written(parts)

    def _clean(self, but: set[str] = frozenset()) -> None:
        """Remove the job's files, those of tasks that failed or were killed too, but for the parts of ``but``."""
        fs, path = opened(self.path)
        for found in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            name = found.base_name.split(".")[0]
            if name.startswith(f"part-{self.job}-") and name not in but:
                fs.delete_file(found.path)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p["name"])
        tmp = f"{path}/_tmp-{uuid.uuid4().hex}"
        with fs.open_output_stream(tmp) as f:
            f.write(json.dumps({"kind": self.kind, "parts": parts}, indent=1).encode())
        fs.move(tmp, f"{path}/{INDEX}")
        self._clean({p["name"] for p in parts})

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()
