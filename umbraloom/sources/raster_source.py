"""TIFF rasters as Spark data sources: headers, and blocks of pixels by band.

    register(spark)
    spark.read.format("raster_headers").load("file:///scenes")
    spark.read.format("raster_blocks").option("bands", "1,3").option("window", "0,0,512,512").load("file:///scenes").where("path like '%a.tif'")

A file is cut into ranges of blocks by its size, which the listing tells, so planning opens no file; a task reads a file's directory and the entries of its
own range. Columns are pruned by the schema that is asked for: without `data` no pixel is read. Conditions on path, band, row_off and col_off are
taken over by the source where the session has spark.sql.python.filterPushdown.enabled; they prune files when partitions are made, and blocks before their bytes are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from umbraloom.sources.tiff_ranges import COMPRESSION, Stored, Tiff

#: Bytes of files that a task reads.
EACH = 64 << 20
HEADERS_SQL = "path string, width int, height int, bands int, crs string, transform array<double>, tags map<string,string>, nodata double, georeferenced boolean, block_height int, block_width int, blocks long, compression int, dtype string, overviews int, bytes_read long"
BLOCKS_SQL = "path string, band int, row_off int, col_off int, height int, width int, data array<double>"
PUSHED = ("path", "band", "row_off", "col_off")


def holds(f: D.Filter, v) -> bool | None:
    """Whether a value meets a condition; None if the condition is of a kind that is not known here."""
    kinds = {
        D.EqualTo: lambda: v == f.value, D.EqualNullSafe: lambda: v == f.value, D.GreaterThan: lambda: v > f.value, D.GreaterThanOrEqual: lambda: v >= f.value, D.LessThan: lambda: v < f.value,
        D.LessThanOrEqual: lambda: v <= f.value, D.In: lambda: v in f.value, D.IsNotNull: lambda: True, D.IsNull: lambda: False, D.StringStartsWith: lambda: v.startswith(f.value),
        D.StringEndsWith: lambda: v.endswith(f.value), D.StringContains: lambda: f.value in v,
    }
    if isinstance(f, D.Not):
        inner = holds(f.child, v)
        return None if inner is None else not inner
    return kinds[type(f)]() if type(f) in kinds else None


def _column(f: D.Filter) -> str | None:
    f = f.child if isinstance(f, D.Not) else f
    name = getattr(f, "attribute", ())
    return name[0] if len(name) == 1 and name[0] in PUSHED and holds(f, "" if name[0] == "path" else 0) is not None else None


class Part(D.InputPartition):
    """(path, i, n): the i-th of n ranges of a file's blocks."""

    def __init__(self, pieces: list[tuple[str, int, int]]) -> None:
        super().__init__(pieces)


class _Reader(D.DataSourceReader):
    def __init__(self, options, schema: StructType) -> None:
        self.root, self.pattern, self.schema = options["path"], options.get("pathGlobFilter", "*.tif*"), schema
        self.each = int(options.get("bytesPerTask", EACH))
        self.bands = [int(b) for b in options["bands"].split(",")] if "bands" in options else None
        self.window = tuple(int(x) for x in options["window"].split(",")) if "window" in options else None  # row, col, height, width
        self.filters: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if _column(f):
                self.filters.append(f)
            else:
                yield f

    def _met(self, column: str, v) -> bool:
        return all(holds(f, v) for f in self.filters if _column(f) == column)

    def _files(self) -> list[tuple[str, int]]:
        """(path, size) of the files that the conditions on path leave; sorted, so that partitions are the same each time."""
        store, at = fs.FileSystem.from_uri(self.root)
        scheme = self.root.split("://")[0] + "://" if "://" in self.root else "file://"
        host = self.root.split("://")[1][: -len(at)] if scheme != "file://" and self.root.rstrip("/").endswith(at) and at else ""
        info = store.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        files = [(scheme + host + i.path, i.size) for i in found if i.type == fs.FileType.File and fnmatch(i.base_name, self.pattern)]
        return sorted((p, n) for p, n in files if self._met("path", p))

    def _pieces(self) -> Iterator[tuple[str, int, int, int]]:
        for p, size in self._files():
            n = max(1, -(-size // self.each))
            for i in range(n):
                yield p, i, n, size // n

    def partitions(self) -> Sequence[D.InputPartition]:
        out, held, size = [], [], 0
        for p, i, n, bytes_ in self._pieces():
            if held and size + bytes_ > self.each:
                out.append(Part(held))
                held, size = [], 0
            held.append((p, i, n))
            size += bytes_ + 4096
        return [*out, Part(held)] if held else out or [Part([])]

    def _batch(self, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        own = to_arrow_schema(self.schema)
        return pa.RecordBatch.from_arrays([pa.array([r[names.index(f.name)] for r in rows], f.type) for f in own], schema=own)


class HeaderReader(_Reader):
    def _pieces(self) -> Iterator[tuple[str, int, int, int]]:
        for p, _ in self._files():
            yield p, 0, 1, self.each // 256  # some files a task

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in HEADERS_SQL.replace(",string", ";string").split(", ")]
        for path, _, _ in partition.value:
            source = Stored(path)
            t = Tiff(source)
            (n, h, w), (bh, bw), (crs, affine) = t.size, t.block_shape, t.georeference
            row = [path, w, h, n, crs, list(affine) if affine else None, t.tags, t.nodata, bool(crs and affine and affine != (1, 0, 0, 0, 1, 0)), bh, bw, t.block_count, t.one(COMPRESSION, 1), t.dtype.newbyteorder("=").name, t.further if "overviews" in self.schema.names else 0]
            source.close()
            yield self._batch([(*row, source.taken)], names)


class BlockReader(_Reader):
    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in BLOCKS_SQL.split(", ")]
        with_data = "data" in self.schema.names
        for path, i, n in partition.value:
            source = Stored(path)
            yield from self._read(Tiff(source), path, i, n, names, with_data)
            source.close()

    def _read(self, t: Tiff, path: str, i: int, n: int, names: list[str], with_data: bool) -> Iterator[pa.RecordBatch]:
        bands, h, w = t.size
        bh, bw = t.block_shape
        chosen = [b for b in self.bands or range(1, bands + 1) if self._met("band", b)]
        if any(not 1 <= b <= bands for b in chosen):
            raise ValueError(f"{path} has bands 1 to {bands}")
        y, x, rows, cols = self.window or (0, 0, h, w)
        low, high = i * t.block_count // n, (i + 1) * t.block_count // n
        for b in t.blocks((y, x, y + rows, x + cols), chosen) if chosen else ():
            r0, c0, r1, c1 = max(y, b.row), max(x, b.col), min(y + rows, b.row + bh, h), min(x + cols, b.col + bw, w)
            if not low <= b.k < high or not self._met("row_off", r0) or not self._met("col_off", c0):
                continue
            a = t.decoded(b) if with_data else None
            out = []
            for band in chosen if b.plane is None else [b.plane + 1]:
                z = None
                if with_data:
                    part = None if a is None else a[r0 - b.row : r1 - b.row, c0 - b.col : c1 - b.col, band - 1 if b.plane is None else 0]
                    z = np.full((r1 - r0) * (c1 - c0), np.nan) if part is None else np.where(t.valid(part), part.astype(float), np.nan).ravel()
                out.append((path, band, r0, c0, r1 - r0, c1 - c0, z))
            yield self._batch(out, names)


class RasterHeaders(D.DataSource):
    """A row for each file. bytes_read is what the header cost."""

    @classmethod
    def name(cls) -> str:
        return "raster_headers"

    def schema(self) -> str:
        return HEADERS_SQL

    def reader(self, schema: StructType) -> D.DataSourceReader:
        return HeaderReader(self.options, schema)


class RasterBlocks(D.DataSource):
    """A row for each band of each strip or tile, cut at the window; NaN where the band is invalid."""

    @classmethod
    def name(cls) -> str:
        return "raster_blocks"

    def schema(self) -> str:
        return BLOCKS_SQL

    def reader(self, schema: StructType) -> D.DataSourceReader:
        return BlockReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets the source take over conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterHeaders)
    spark.dataSource.register(RasterBlocks)


def scan_headers(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    register(spark)
    return spark.read.format("raster_headers").option("pathGlobFilter", pattern).load(path)


def scan_blocks(spark: SparkSession, path: str, pattern: str = "*.tif*", bands: Sequence[int] | None = None, window: tuple[int, int, int, int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Blocks of the bands (from 1) inside a window (row, col, height, width), with the columns that are asked for only."""
    register(spark)
    kinds = dict(x.split() for x in BLOCKS_SQL.split(", "))
    reader = spark.read.format("raster_blocks").option("pathGlobFilter", pattern)
    if bands:
        reader = reader.option("bands", ",".join(map(str, bands)))
    if window:
        reader = reader.option("window", ",".join(map(str, window)))
    if columns:
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)
