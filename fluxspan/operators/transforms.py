"""Two-dimensional Fourier transforms of images whose rows are packed arrays.

A row is transformed and cut into blocks of columns; a block of all rows is transformed along its columns.  No task holds more
than a row or a block.  Rows and blocks travel as bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fin

#: Columns of a row that stay together in the transpose, at most.
BLOCK = 64
#: Values of a block of columns, about: tall images have narrow blocks.
BLOCK_VALUES = 1 << 19
#: Rows that are turned into Arrow batches at once, by their values.
BATCH_VALUES = 1 << 16
_PART = pa.schema([("g", pa.string()), ("block", pa.int32()), ("y", pa.int32()), ("part", pa.binary()), ("nx", pa.int32()), ("x0", pa.int32()), ("stamp", pa.binary())])
_HALF = pa.schema([("g", pa.string()), ("block", pa.int32()), ("y", pa.int32()), ("part", pa.binary()), ("x0", pa.int32()), ("nx", pa.int32()), ("ny", pa.int32())])
_NOISE = pa.schema([("g", pa.string()), ("block", pa.int32()), ("y", pa.int32()), ("part", pa.binary()), ("x0", pa.int32()), ("nx", pa.int32()), ("inside", pa.bool_()), ("mask", pa.binary()), ("stamps", pa.list_(pa.binary()))])
_SEEN = pa.schema([("g", pa.string()), ("s", pa.int32()), ("y", pa.int32()), ("mask", pa.binary()), ("v", pa.binary()), ("n", pa.int32()), ("total", pa.float64())])
_VALUES = pa.schema([("g", pa.string()), ("kbin", pa.int32()), ("w", pa.int32()), ("n", pa.int64()), ("v", pa.binary())])


PARTS = "g string, block int, y int, part binary, nx int, x0 int, stamp binary"


def normals(seed: int, name: str, r: int, y: int, n: int) -> np.ndarray:
    """Standard normal noise of one row, from the row's own names: the same whatever the partitioning."""
    key = int.from_bytes(hashlib.blake2b(f"{seed}|{name}|{r}|{y}".encode(), digest_size=16).digest(), "little")
    return np.random.Generator(np.random.Philox(key=key)).standard_normal(n)


def packed(pixels: DataFrame, names: list[str]) -> DataFrame:
    """names, y, mask, v, n, total, last: the finite values of each row of images, a bit for each column, the values as bytes.

    last: the last column of the row, with or without a value.
    """

    def work(batches):
        for b in batches:
            rows, items = b.column("m"), b.column("m").flatten()
            ends = np.append(0, np.cumsum(rows.value_lengths().to_numpy()))
            x, v = items.field("x").to_numpy(), items.field("v").to_numpy(zero_copy_only=False)
            out = []
            for lo, hi in zip(ends, ends[1:], strict=False):
                row = np.full(x[lo:hi].max() + 1, np.nan)
                row[x[lo:hi]] = v[lo:hi]
                there = np.isfinite(row)
                values = row[there]
                out.append((np.packbits(there).tobytes(), values.tobytes(), len(values), float(values.sum()), len(row) - 1))
            each = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*names, "y"]), *(pa.array(c, t) for c, t in zip(each, (pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.int32()), strict=True))], [*names, "y", "mask", "v", "n", "total", "last"])

    types = dict(pixels.dtypes)
    rows = pixels.groupBy(*names, F.col("y").cast("int").alias("y")).agg(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), fin("value").alias("v"))).alias("m"))
    return rows.mapInArrow(work, ", ".join(f"`{n}` {types[n]}" for n in names) + ", y int, mask binary, v binary, n int, total double, last int")


def columns_of(mask: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8)))


def block_width(ny: str) -> Column:
    """Columns in a block of an image of so many rows."""
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_VALUES) / F.col(ny)))).cast("int")


def _parts(g: str, y: int, spectrum: np.ndarray, width: int, stamp: bytes | None) -> list[tuple]:
    return [(g, b, y, spectrum[lo : lo + width].tobytes(), len(spectrum), lo, stamp) for b, lo in enumerate(range(0, len(spectrum), width))]


def _batches(rows: list[tuple], schema: pa.Schema):
    for lo in range(0, len(rows), 512):
        some = rows[lo : lo + 512]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], f.type) for k, f in enumerate(schema)], schema=schema)


def row_spectra(rows: DataFrame) -> DataFrame:
    """g, block, y, part, nx, x0, stamp: the transforms of rows, in blocks of columns.

    rows: g, y, v (doubles as bytes), width (`block_width`).
    """

    def work(batches):
        for b in batches:
            out, held = [], 0
            for g, y, v, width in zip(*[b.column(c).to_pylist() for c in ("g", "y", "v", "width")], strict=True):
                out += _parts(g, y, np.fft.fft(np.frombuffer(v)), width, None)
                held += len(v) // 8
                if held >= BATCH_VALUES:
                    yield from _batches(out, _PART)
                    out, held = [], 0
            yield from _batches(out, _PART)

    return rows.select("g", "y", "v", "width").mapInArrow(work, PARTS)


def _cut(half: np.ndarray, width: int):
    """Blocks of columns of a row's half transform: number, first column, bytes."""
    return ((b, lo, half[lo : lo + width].tobytes()) for b, lo in enumerate(range(0, len(half), width)))


def half_spectra(rows: DataFrame) -> DataFrame:
    """g, block, y, part, x0, nx, ny: `row_spectra` up to the middle column, whose mirror images follow in a real image.

    rows: g, y, mask, v (`packed`), mean (is subtracted), nx, ny, width.  A row that is not there is zero.
    """

    def work(batches):
        for b in batches:
            out, held = [], 0
            for g, y, mask, v, mean, nx, ny, width in zip(*[b.column(c).to_pylist() for c in ("g", "y", "mask", "v", "mean", "nx", "ny", "width")], strict=True):
                row = np.zeros(nx)
                row[columns_of(mask)] = np.frombuffer(v) - mean
                out += [(g, n, y, part, lo, nx, ny) for n, lo, part in _cut(np.fft.rfft(row), width)]
                held += nx
                if held >= BATCH_VALUES:
                    yield from _batches(out, _HALF)
                    out, held = [], 0
            yield from _batches(out, _HALF)

    return rows.select("g", "y", "mask", "v", "mean", "nx", "ny", "width").mapInArrow(work, "g string, block int, y int, part binary, x0 int, nx int, ny int")


def noise_spectra(rows: DataFrame, seed: int) -> DataFrame:
    """Half transforms of the rows of noise that is made here; equal names and r have equal noise.

    rows: g, name, r, y, nx, width, mask (NULL where no pixel of the row is asked for), stamps (with an image's first row).
    """

    def work(batches):
        for b in batches:
            out, held = [], 0
            for g, name, r, y, nx, width, mask, stamps in zip(*[b.column(c).to_pylist() for c in ("g", "name", "r", "y", "nx", "width", "mask", "stamps")], strict=True):
                half = np.fft.rfft(normals(seed, name, r, y, nx))
                out += [(g, n, y, part, lo, nx, mask is not None, None if n else mask, stamps) for n, lo, part in _cut(half, width)]
                held += nx
                if held >= BATCH_VALUES:
                    yield from _batches(out, _NOISE)
                    out, held = [], 0
            yield from _batches(out, _NOISE)

    return rows.select("g", "name", "r", "y", "nx", "width", "mask", "stamps").mapInArrow(work, "g string, block int, y int, part binary, x0 int, nx int, inside boolean, mask binary, stamps array<binary>")


def _bytes(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes, without an object for each."""
    n, size = len(rows), rows.itemsize * rows.shape[1]
    offsets = np.arange(n + 1, dtype=np.int64) * size
    large = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])
    return large.cast(pa.binary())


def _rows_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a block's rows and the rows, as they come."""
    rows = np.concatenate([np.frombuffer(c.buffers()[2], np.uint8)[slice(*np.frombuffer(c.buffers()[1], np.int32)[[c.offset, c.offset + len(c)]])] for c in t.column("part").chunks if len(c)])
    return t.column("y").to_numpy(), rows.view(complex).reshape(t.num_rows, -1)


def _column_block(t: pa.Table, ny: int) -> np.ndarray:
    """The transform of a block's columns; rows that are not there are zero."""
    y, rows = _rows_of(t)
    f = np.zeros((ny, rows.shape[1]), complex)
    f[y] = rows
    return np.fft.fft(f, axis=0)


def power(parts: DataFrame) -> DataFrame:
    """g, ky, kx, power (squared modulus) of each mode, from all rows' `row_spectra`."""

    def work(t: pa.Table) -> pa.Table:
        g, x0 = t.column("g")[0], t.column("x0")[0].as_py()
        f = _column_block(t, t.num_rows)
        ky, kx = np.divmod(np.arange(f.size, dtype=np.int32), np.int32(f.shape[1]))
        return pa.table({"g": pa.repeat(g, f.size), "ky": pa.array(ky, pa.int32()), "kx": pa.array(kx + x0, pa.int32()), "power": (np.abs(f) ** 2).ravel()})

    return parts.groupBy("g", "block").applyInArrow(work, "g string, ky int, kx int, power double")


def _frequencies(k: np.ndarray, n: int) -> np.ndarray:
    return np.where(2 * k < n, k, k - n) / n


def radial_values(parts: DataFrame, edges: int) -> DataFrame:
    """g, kbin, w, n, v: the power of `half_spectra` in half-open bins of |k| up to the largest, k > 0.

    A row has n modes of one block and bin, each of which counts w times, and the finite powers in order, as bytes.
    """

    def work(t: pa.Table) -> pa.Table:
        g, x0, nx, ny = (t.column(c)[0].as_py() for c in ("g", "x0", "nx", "ny"))
        p = np.abs(_column_block(t, ny)) ** 2
        kx = x0 + np.arange(p.shape[1])
        fy, fx = _frequencies(np.arange(ny), ny)[:, None], _frequencies(kx, nx)[None, :]
        k = np.sqrt(fx * fx + fy * fy)
        top = np.sqrt((nx // 2 / nx) * (nx // 2 / nx) + (ny // 2 / ny) * (ny // 2 / ny))
        out = []
        # the first column is its own mirror image, as is the middle one
        for w, columns in ((1, (kx == 0) | (2 * kx == nx)), (2, (kx > 0) & (2 * kx != nx))):
            use = columns & (k > 0) & (k < top)
            kbin, values = np.floor(k[use] / (top / (edges - 1))).astype(np.int32), p[use]
            order = np.argsort(kbin, kind="stable")
            bins, first = np.unique(kbin[order], return_index=True)
            for b, some in zip(bins, np.split(values[order], first[1:]), strict=False):
                out.append((g, int(b), w, len(some), np.sort(some[np.isfinite(some)]).tobytes()))
        return pa.Table.from_batches(_batches(out, _VALUES), _VALUES)

    return parts.groupBy("g", "block").applyInArrow(work, "g string, kbin int, w int, n long, v binary")


def stamp_bytes(dy: list[int], dx: list[int], value: list[float]) -> bytes:
    return np.array([dy, dx, value], float).tobytes()


def stamp_columns(stamp: bytes, ny: int, columns: np.ndarray, nx: int) -> np.ndarray:
    """Columns of the transform of a stamp that is centred on (0, 0) of an ny x nx frame and wraps around its borders."""
    dy, dx, value = np.frombuffer(stamp).reshape(3, -1)
    rows, at = np.unique(dy, return_inverse=True)
    plane = np.zeros((len(rows), len(columns)), complex)
    for lo in range(0, len(value), 4096):
        k = slice(lo, lo + 4096)
        np.add.at(plane, at[k], value[k, None] * np.exp(-2j * np.pi * dx[k, None] * columns[None, :] / nx))
    full = np.zeros((ny, len(columns)), complex)
    np.add.at(full, rows.astype(int) % ny, plane)
    return np.fft.fft(full, axis=0)


def convolved(parts: DataFrame) -> DataFrame:
    """g, s, y, mask, v (doubles as bytes), n, total: the masked pixels of images convolved circularly with their stamps, by number.

    parts: `noise_spectra`.  A block is transformed, multiplied with each stamp's transform and transformed back along its
    columns; the blocks of a row meet and are transformed back along the row.
    """

    def columns(t: pa.Table) -> pa.Table:
        ny, x0, nx = t.num_rows, t.column("x0")[0].as_py(), t.column("nx")[0].as_py()
        f = _column_block(t, ny)
        stamps = t.column("stamps").drop_null()[0].as_py()
        asked = t.select(["g", "block", "y", "nx", "mask"]).filter(t.column("inside"))
        y = asked.column("y").to_numpy()
        each = []
        for s, stamp in enumerate(stamps):
            back = np.fft.ifft(f * stamp_columns(stamp, ny, x0 + np.arange(f.shape[1]), nx), axis=0)[y]
            each.append(asked.append_column("s", pa.array(np.full(len(y), s, np.int32))).append_column("part", _bytes(back)))
        return pa.concat_tables(each).select(["g", "s", "block", "y", "nx", "mask", "part"])

    half = parts.groupBy("g", "block").applyInArrow(columns, "g string, s int, block int, y int, nx int, mask binary, part binary")
    whole = half.groupBy("g", "s", "y", "nx").agg(F.first("mask", ignorenulls=True).alias("mask"), F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))

    def rows(batches):
        for b in batches:
            out = []
            for g, s, y, nx, mask, ps in zip(*[b.column(c).to_pylist() for c in ("g", "s", "y", "nx", "mask", "parts")], strict=True):
                seen = np.fft.irfft(np.concatenate([np.frombuffer(p["part"], complex) for p in ps]), nx)[columns_of(mask)]
                out.append((g, s, y, mask, seen.tobytes(), len(seen), float(seen.sum())))
            yield from _batches(out, _SEEN)

    return whole.mapInArrow(rows, "g string, s int, y int, mask binary, v binary, n int, total double")
