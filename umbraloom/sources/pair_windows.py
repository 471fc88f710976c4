"""One window cut out of an image and of its height raster, whatever the sizes of the two: only the blocks of the window are read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.sources.rasters import rgb_bands
from umbraloom.sources.tiff_ranges import Block, Stored, Tiff

#: Bytes of decoded blocks that are kept for each open file, and of tiles that leave a task at once.
KEPT, SENT = 32 << 20, 8 << 20
TILES_SQL = "stem string, row_off int, col_off int, resampled boolean, image array<float>, height_m array<float>, valid array<boolean>"


def nearest_places(off: int, size: int, source: int, target: int) -> np.ndarray:
    """Which of `source` lines each of `size` lines from `off` on of a grid of `target` lines falls on, by its middle."""
    return np.floor((off + np.arange(size) + 0.5) * (source / target)).astype(np.int64)


def cut_pair(image: Tiff, height: Tiff, row: int, col: int, size: int, resample: bool = True, allow_padding: bool = True, nodata: float | None = None, max_height: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(image (3, size, size), heights, validity, whether heights were resampled) of a window of the image's grid.

    Outside the image, pixels are 0 and invalid. Heights of a raster of another size are the nearest ones, or refused. Invalid are heights that are not finite, nodata (the file's or
    the one given), above the limit, or outside either raster; they are 0."""
    (n, h, w), (_, hh, hw) = image.size, height.size
    if not allow_padding and (h < size or w < size):
        raise ValueError(f"the scene has {w} x {h} pixels, fewer than a tile of {size}")
    resampled = (h, w) != (hh, hw)
    if resampled and not resample:
        raise ValueError(f"the image has {w} x {h} pixels but the heights have {hw} x {hh}")
    rgb = rgb_bands(n)
    pixels, _ = image.window(row, col, size, size, sorted(set(rgb)))
    pixels = pixels[[sorted(set(rgb)).index(b) for b in rgb]].astype(np.float32)
    r, c = nearest_places(row, size, hh, h), nearest_places(col, size, hw, w)
    z, _ = height.window(int(r[0]), int(c[0]), int(r[-1] - r[0] + 1), int(c[-1] - c[0] + 1), [1])
    z = z[0][np.ix_(r - r[0], c - c[0])].astype(np.float32)
    in_both = lambda k, at, own, other: (k >= 0) & (k < own) & (at >= 0) & (at < other)
    ok = np.isfinite(z) & in_both(row + np.arange(size), r, h, hh)[:, None] & in_both(col + np.arange(size), c, w, hw)[None]
    for v in (height.nodata, nodata):
        if v is not None and np.isfinite(v):
            ok &= ~np.isclose(z, v)
    if max_height is not None:
        ok &= z <= max_height
    return np.where(np.isfinite(pixels), pixels, 0), np.where(ok, z, 0).astype(np.float32), ok, resampled


def kept(decode: Callable[[Block], np.ndarray | None], most: int = KEPT) -> Callable[[Block], np.ndarray | None]:
    """decode with its last blocks at hand, up to so many bytes: neighbouring windows share blocks."""
    held: dict[Block, np.ndarray | None] = {}
    size = 0

    def decoded(b: Block) -> np.ndarray | None:
        nonlocal size
        if b in held:
            held[b] = a = held.pop(b)
            return a
        a = decode(b)
        size += 0 if a is None else a.nbytes
        while held and size > most:
            old = held.pop(next(iter(held)))
            size -= 0 if old is None else old.nbytes
        held[b] = a
        return a

    return decoded


def pair_tiles(requests: DataFrame, size: int, **rules) -> DataFrame:
    """A tile for each row of requests (stem, image_path, height_path, row_off, col_off). rules: as of cut_pair.

    Requests are grouped by their files, so that a file's directory is read once for a task, and each group is cut where it is read. Their number of tasks is
    fixed: requests have few bytes but much work, so Spark would put all of them into one task. A null place or path is refused; an empty table gives no rows."""
    spark = requests.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    asked = requests.select(F.col("stem").cast("string").alias("stem"), "image_path", "height_path", "row_off", "col_off").repartition(tasks, "image_path", "height_path", "row_off").sortWithinPartitions("image_path", "height_path", "row_off", "col_off")

    def opened(path: str) -> Tiff:
        t = Tiff(Stored(path))
        t.decoded = kept(t.decoded)
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Tiff] = {}
        cut, taken = [], 0
        for batch in batches:
            for stem, image, height, row, col in zip(*(batch.column(c).to_pylist() for c in ("stem", "image_path", "height_path", "row_off", "col_off")), strict=True):
                if image not in open_ or height not in open_:
                    for t in open_.values():
                        t.source.close()
                    open_ = {p: opened(p) for p in (image, height)}
                pixels, z, ok, resampled = cut_pair(open_[image], open_[height], int(row), int(col), size, **rules)
                cut.append((stem, int(row), int(col), resampled, pixels.ravel(), z.ravel(), ok.ravel()))
                taken += pixels.nbytes + z.nbytes + ok.nbytes
                if taken > SENT:
                    yield _tiles(cut)
                    cut, taken = [], 0
        if cut:
            yield _tiles(cut)
        for t in open_.values():
            t.source.close()

    return asked.mapInArrow(run, TILES_SQL)


def _tiles(cut: list[tuple]) -> pa.RecordBatch:
    stem, row, col, resampled, *values = zip(*cut, strict=True)
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(v[0])), pa.array(np.concatenate(v), t)) for v, t in zip(values, (pa.float32(), pa.float32(), pa.bool_()), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(stem, pa.string()), pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(resampled, pa.bool_()), *lists], [c.split()[0] for c in TILES_SQL.split(", ")])
