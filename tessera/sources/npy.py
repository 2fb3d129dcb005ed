"""A data source over NPY shards: tasks read ranges of rows by the files' headers, so that a shard may be of any size.

    spark.dataSource.register(NpyDataSource)
    spark.read.format("npy").option("path", folder).option("dim", 768).load()

Options: path (a folder or file, local or of a store that pyarrow opens), dim (columns, checked), unit (how far a row's length may
be from 1; "none" for no check), rows (rows a task, about). Equality and IN on `file` are applied before files are opened.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Rows that a task reads, and that it holds at once.
TASK_ROWS, CHUNK = 1 << 20, 8192


@dataclass
class Rows(InputPartition):
    """Rows [start, stop) of a file whose first row lies at `offset`."""

    file: str
    start: int
    stop: int
    offset: int
    dtype: str


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what to put before such a path to name it)."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path, ""
    path = path if "://" in path else "file://" + path.removeprefix("file:")
    found, inner = pafs.FileSystem.from_uri(path)
    return found, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def header(f, name: str, dim: int) -> tuple[int, int, str]:
    """(rows, offset of the first one, dtype) of an open file. Raises unless it holds floats of dim columns, row by row, in full."""
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    if len(shape) != 2 or shape[1] != dim or dtype.kind != "f" or fortran and min(shape) > 1:
        raise ValueError(f"{name}: {dtype} {shape}, floats of {dim} columns expected" + " row by row" * fortran)
    offset = f.tell()
    if f.size() < offset + shape[0] * dim * dtype.itemsize:
        raise ValueError(f"{name}: shorter than its header says")
    return shape[0], offset, dtype.str


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.dim = options["path"], int(options["dim"])
        unit = str(options.get("unit", "1e-5")).lower()
        self.unit, self.rows = None if unit == "none" else float(unit), int(options.get("rows", TASK_ROWS))
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            else:
                yield f

    def files(self) -> list[str]:
        at, inner, before = opened(self.path)
        info = at.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else at.get_file_info(pafs.FileSelector(inner))
        names = [before + x.path for x in found if x.type == pafs.FileType.File and posixpath.basename(x.path).endswith(".npy")]
        return sorted(n for n in names if self.only is None or n in self.only)

    def partitions(self) -> list[Rows]:
        out = []
        for name in self.files():
            at, inner, _ = opened(name)
            with at.open_input_file(inner) as f:
                n, offset, dtype = header(f, name, self.dim)
            out += [Rows(name, s, min(s + self.rows, n), offset, dtype) for s in range(0, n, self.rows)]
        return out or [Rows("", 0, 0, 0, "<f4")]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.start == part.stop:
            return
        at, inner, _ = opened(part.file)
        kind = np.dtype(part.dtype)
        width = self.dim * kind.itemsize
        with at.open_input_file(inner) as f:
            for start in range(part.start, part.stop, CHUNK):
                n = min(CHUNK, part.stop - start)
                f.seek(part.offset + start * width)
                x = np.frombuffer(f.read(n * width), kind).reshape(n, self.dim)
                if not np.isfinite(x).all():
                    raise ValueError(f"{part.file}: not finite")
                if self.unit is not None and np.abs(np.linalg.norm(x.astype(float), axis=1) - 1).max() > self.unit:
                    raise ValueError(f"{part.file}: not of unit length")
                v = pa.ListArray.from_arrays(np.arange(0, x.size + 1, self.dim, dtype=np.int32), x.astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * n, pa.string()), pa.array(np.arange(start, start + n)), v], names=["file", "row", "v"])


class NpyDataSource(DataSource):
    """(file, row, v) of NPY shards; finite floats of `dim` columns."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, row long, v array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)
