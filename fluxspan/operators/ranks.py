"""Exact quantiles of groups of any size, by distributed rank selection.

A double is read as an integer of the same order.  Values are counted by its leading bits; for each rank that is asked for, the
counts tell the prefix that holds it, and only rows under that prefix are counted by the next bits, until the bits are used up.
Counts are summed before they are shuffled: no task sees the values of a group, only its prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fin
from ..plans.storage import discard, written

#: Bits that are left after each pass; a prefix has at most 2^22 continuations.
SHIFTS = (42, 21, 0)
#: A prefix, a group, or a whole table, with at most so many rows needs no passes between: its values are counted one by one.
FEW = 1_000_000
#: Rows of a table of groups, or of their prefixes, that are broadcast at most; beyond, they meet the other rows in a shuffle
#: (Spark itself would broadcast them up to 10 MB of file, again and again, and each time through the driver).
BROADCAST_ROWS = 20_000

#: Bits of a packed value that its leading bits leave: 64 brackets between a power of two and the next.
PACKED_SHIFT = 46


def ordered_bits(c: Column) -> Column:
    """A long that sorts as the double does."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), c + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _same(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in names])


def small(few: DataFrame, n: int) -> DataFrame:
    """A table of n rows, marked for a join: broadcast, or shuffled if it is not small."""
    return F.broadcast(few) if n <= BROADCAST_ROWS else few.hint("merge")


def _meet(rows: DataFrame, few: DataFrame, names: list[str], n: int) -> DataFrame:
    """Rows that agree with a table of at most n rows in `names`, and its other columns."""
    b = small(few, n)
    rest = [c for c in few.columns if c not in names]
    return rows.alias("a").join(b.alias("b"), _same(names)).select("a.*", *[f"b.`{c}`" for c in rest])


def counted_bits(df: DataFrame, g: list[str], value: str = "_v") -> DataFrame:
    """Adds the integer form `_b` of a column, for `quantiles` to read again and again."""
    return df.withColumn("_b", ordered_bits(F.col(value)))


def quantiles(df: DataFrame, g: list[str], wanted: dict[str, tuple[Column, float]], weight: str | None = None) -> DataFrame:
    """Quantiles of each group, with linear interpolation between neighbouring ranks: g and the names in `wanted`.

    wanted: name -> (column, share).  NULL, NaN and infinite values don't count; a group without any other isn't there.
    weight: a column with the number of times that a row counts.
    """
    lazy, temporary = selected(df, g, wanted, weight)
    out = written(lazy)
    for t in temporary:
        discard(t)
    return out


def selected(df: DataFrame, g: list[str], wanted: dict[str, tuple[Column, float]], weight: str | None = None, bits: str | None = None, most_rows: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """What `quantiles` returns, and the stored tables that it reads.

    bits: `ordered_bits` of the only column, where `df` comes from a stored table that has it, with at most `most_rows` rows in a
    group; otherwise the values are stored first.
    """
    columns: dict[str, int] = {}
    of = {n: columns.setdefault(str(c), len(columns)) for n, (c, _) in wanted.items()}
    exprs = {of[n]: c for n, (c, _) in wanted.items()}
    n_ = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    temporary = []
    if bits:
        c = next(iter(exprs.values()))
        rows = df.select(*g, F.lit(0).alias("_q"), c.alias("_v"), n_.alias("_n"), F.col(bits).alias("_b")).where("_v is not null")
    else:
        each = F.explode(F.array(*[F.struct(F.lit(q).alias("_q"), fin(c).cast("double").alias("_v")) for q, c in exprs.items()])).alias("_e")
        rows = df.select(*g, n_.alias("_n"), each).select(*g, "_n", "_e.*").where("_v is not null")
        rows = written(rows.withColumn("_b", ordered_bits(F.col("_v"))))
        temporary.append(rows)
        most_rows = rows.count()
    asked = F.array(*[F.struct(F.lit(of[n]).alias("_q"), F.lit(n).alias("_name"), F.lit(float(p)).alias("_p"), F.lit(side).alias("_side")) for n, (_, p) in wanted.items() for side in (0, 1)])

    key = [*g, "_q"]
    whole = most_rows is not None and most_rows <= FEW
    # first pass: prefixes, or in a small table whole values, and their place in the order of the group's; the ranks of each
    order = Window.partitionBy(*key).orderBy("_h")
    counts = rows.groupBy(*key, (F.col("_b") if whole else F.shiftright("_b", SHIFTS[0])).alias("_h")).agg(F.sum("_n").alias("_c"), F.min("_v").alias("_v"))
    placed = counts.withColumns({"_end": F.sum("_c").over(order), "_all": F.sum("_c").over(Window.partitionBy(*key))})
    at = F.col("_p") * (F.col("_all") - 1)
    ranks = placed.select("*", F.explode(F.filter(asked, lambda a: a["_q"] == F.col("_q"))).alias("_a")).select(*key, "_h", "_c", "_v", "_end", "_all", "_a._name", "_a._p", "_a._side")
    ranks = ranks.withColumn("_rank", F.when(F.col("_side") == 0, F.floor(at)).otherwise(F.ceil(at)))
    found = ranks.where("_rank >= _end - _c and _rank < _end").withColumn("_rank", F.col("_rank") - F.col("_end") + F.col("_c"))
    found = found.select(*key, "_h", "_c", "_v", "_name", "_side", "_rank", (at - F.floor(at)).alias("_part"))
    most, n = 0, 0
    if not whole:
        found = written(found)
        temporary.append(found)
        most, n = found.agg(F.max("_c"), F.count("*")).first()
    shifts = [] if whole else [SHIFTS[0], 0] if (most or 0) <= FEW else list(SHIFTS)
    for before, shift in zip(shifts, shifts[1:], strict=False):
        # only rows under a prefix that holds a rank are counted by their next bits
        under = _meet(rows.withColumn("_h", F.shiftright("_b", before)), found.select(*key, "_h").distinct(), [*key, "_h"], n)
        next_ = under.groupBy(*key, "_h", F.shiftright("_b", shift).alias("_h2")).agg(F.sum("_n").alias("_c2"), F.min("_v").alias("_v"))
        placed = next_.withColumn("_end", F.sum("_c2").over(Window.partitionBy(*key, "_h").orderBy("_h2")))
        hits = _meet(placed, found.select(*key, "_h", "_name", "_side", "_rank", "_part"), [*key, "_h"], n).where("_rank >= _end - _c2 and _rank < _end")
        found = hits.select(*key, F.col("_h2").alias("_h"), "_name", "_side", (F.col("_rank") - F.col("_end") + F.col("_c2")).alias("_rank"), "_part", "_v")
        if shift:
            found = written(found)
            temporary.append(found)

    def value(n: str) -> Column:
        low, high, part = (F.max(F.when((F.col("_name") == n) & (F.col("_side") == s), F.col(c))) for s, c in ((0, "_v"), (1, "_v"), (0, "_part")))
        return (low * (1 - part) + high * part).alias(n)

    return found.groupBy(*g).agg(*[value(n) for n in wanted]), temporary


def medians(df: DataFrame, g: list[str], wanted: dict[str, Column]) -> DataFrame:
    return quantiles(df, g, {n: (c, 0.5) for n, c in wanted.items()})


def grouped(df: DataFrame, g: list[str], sums: list[Column], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """groupBy(g).agg(sums) with the quantiles as further columns, NULL for a group without values."""
    return beside(df.groupBy(*g).agg(*sums), quantiles(df, g, wanted), g)


def beside(a: DataFrame, b: DataFrame, g: list[str], n: int | None = None) -> DataFrame:
    """Columns of b beside those of a, NULL where a group is missing.  n: groups at most, where that is known."""
    b = b if n is None else small(b, n)
    return a.alias("a").join(b.alias("b"), _same(g), "left").select("a.*", *[f"b.`{c}`" for c in b.columns if c not in g])


def packed_medians(values: DataFrame, g: list[str]) -> DataFrame:
    """g, n and power, the median, of values that come in chunks: n values of a group, each counting w times, v as sorted bytes.

    Values are positive doubles or zero.  Chunks are counted by their values' leading bits, which leaves a bracket for each
    group's middle ranks; in a second pass values outside the bracket are counted together, those inside go to `quantiles`.
    """
    chunks = written(values)
    types = dict(chunks.dtypes)
    names = ", ".join(f"`{c}` {types[c]}" for c in g)

    def cut(batches: Iterator[pa.RecordBatch], inside) -> Iterator[pa.RecordBatch]:
        """Rows of numbers from each chunk: group, number, times."""
        for b in batches:
            each = [inside(np.frombuffer(v), *more) for v, *more in zip(*[b.column(c).to_pylist() for c in b.schema.names if c not in (*g, "w")], strict=True)]
            if not each:
                continue
            size = np.array([len(numbers) for numbers, _ in each])
            at = pa.array(np.repeat(np.arange(len(each)), size))
            numbers, times = (np.concatenate([e[k] for e in each]) for k in (0, 1))
            w = np.repeat(b.column("w").to_numpy(), size)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in g), pa.array(numbers), pa.array((times * w).astype(np.int64))], [*g, "_x", "_c"])

    def leading(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(v.view(np.int64) >> PACKED_SHIFT, return_counts=True)

    def bracket(v: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        bits = v.view(np.int64) >> PACKED_SHIFT
        a, b = np.searchsorted(bits, low), np.searchsorted(bits, high, side="right")
        kept, times = np.unique(v[a:b], return_counts=True)
        below, above = min(1, a), min(1, len(v) - b)
        return np.concatenate([v[:below], kept, v[len(v) - above :]]), np.concatenate([[a] * below, times, [len(v) - b] * above])

    counts = chunks.select(*g, "w", "v").mapInArrow(lambda batches: cut(batches, leading), f"{names}, _x long, _c long")
    counts = counts.groupBy(*g, "_x").agg(F.sum("_c").alias("_c"))
    placed = counts.withColumns({"_end": F.sum("_c").over(Window.partitionBy(*g).orderBy("_x")), "_all": F.sum("_c").over(Window.partitionBy(*g))})
    middle = (F.floor((F.col("_all") - 1) / 2) < F.col("_end")) & (F.ceil((F.col("_all") - 1) / 2) >= F.col("_end") - F.col("_c"))
    bounds = written(placed.where(middle).groupBy(*g).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high")))
    near = _meet(chunks.select(*g, "w", "v"), bounds, g, bounds.count())
    near = near.mapInArrow(lambda batches: cut(batches, bracket), f"{names}, _x double, _c long")
    medians_ = quantiles(near, g, {"power": (F.col("_x"), 0.5)}, weight="_c")
    return beside(chunks.groupBy(*g).agg(F.sum(F.col("n") * F.col("w")).alias("n")), medians_, g)
