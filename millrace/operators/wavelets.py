"""Wavelet peaks of series of any length: convolution in chunks, noise by counts over blocks.

A series is laid out by position. Chunks that share a few points give the transforms and the peaks. Whether a peak stands out
depends on the 10th percentile of the narrowest transform over a twentieth of the series around it. No window is gathered for
that: the blocks of the series that a window touches each tell how many of their values in it lie below the peak's strength, and
the nearest values on both sides, and these add up to the answer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col
from millrace.session import materialize
from millrace.skew import join_back, with_position

#: Positions of a chunk, and how many on each side it shares: half the widest wavelet and a neighbour.
CHUNK, SHARED = 8_192, 16
#: A noise window spans about so many blocks, as long as a block has between the least and the most positions.
BLOCKS, LEAST, MOST = 4, 4_096, 1 << 20
#: Widths of the wavelet; its points per unit of width.
WIDTHS, POINTS = (1, 2, 3), 10


def ricker(points: int, width: float) -> np.ndarray:
    x = (np.arange(points) - (points - 1) / 2) / width
    return 2 / (np.sqrt(3 * width) * np.pi**0.25) * (1 - x**2) * np.exp(-(x**2) / 2)


def transforms(x: np.ndarray, n: int) -> np.ndarray:
    """The transform at each width, at every position of ``x``, a part of a series of ``n``.

    Right where the points that a wavelet covers are all in ``x`` or lie outside the series.
    """
    out = np.empty((len(WIDTHS), len(x)))
    for k, w in enumerate(WIDTHS):
        wave = ricker(min(POINTS * w, n), w)[::-1]
        start = (len(wave) - 1) // 2
        out[k] = np.convolve(x, wave)[start : start + len(x)]
    return out


class RangeCounts:
    """Values of a block, asked for counts and neighbours of a bound inside ranges of positions."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.sorted = np.sort(values)
        self.rank = np.searchsorted(self.sorted, values)  # equal values share a rank

    def __call__(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray, inclusive: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each range ``[a, b)``: how many values are at most (or below) the bound, the greatest of these, the least of the others.

        A range is a few runs of 1, 2, 4, … positions, as in a segment tree; each run is sorted, and all are searched at once.
        """
        n = len(self.values)
        below = np.searchsorted(self.sorted, bound, side="right" if inclusive else "left")  # ranks under this count
        count = np.zeros(len(a), dtype=np.int64)
        down, up = np.full(len(a), -np.inf), np.full(len(a), np.inf)
        whole = np.flatnonzero((a == 0) & (b == n) & (n > 0))
        count[whole] = below[whole]
        down[whole] = np.where(below[whole] > 0, self.sorted[np.maximum(below[whole] - 1, 0)], -np.inf)
        up[whole] = np.where(below[whole] < n, self.sorted[np.minimum(below[whole], n - 1)], np.inf)
        left, right = a.copy(), b.copy()
        right[whole] = left[whole]
        position, level = np.arange(n), 0
        while (left < right).any():
            order = np.lexsort((self.rank, position >> level))
            key = (position[order] >> level) * (n + 1) + self.rank[order]
            for asked, run in ((left < right) & (left & 1 == 1), left), ((left < right) & (right & 1 == 1), right - 1):
                rows = np.flatnonzero(asked)
                if not len(rows):
                    continue
                start = run[rows] << level
                end = np.minimum(start + (1 << level), n)
                place = np.searchsorted(key, run[rows] * (n + 1) + below[rows])
                count[rows] += place - start
                some = place > start
                down[rows[some]] = np.maximum(down[rows[some]], self.values[order[place[some] - 1]])
                some = place < end
                up[rows[some]] = np.minimum(up[rows[some]], self.values[order[place[some]]])
            left, right, level = (left + 1) >> 1, right >> 1, level + 1
        return count, down, up


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Stretches of equal keys of sorted rows, one table each."""
    held, now = [], None
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                if held and rows[start] != now:
                    yield pa.Table.from_batches(held)
                    held = []
                now = rows[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield pa.Table.from_batches(held)


def _peaks(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows(series, n, p, x)``, positions from 0 -> ``(series, n, p, wave, row, strength)``.

    ``wave`` is the narrowest transform; ``row`` the narrowest width at which the place is a peak (null: none), ``strength`` the size of
    the transform there.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.floor(F.col("p") / chunk)
    near = F.array(own, F.when(F.pmod(F.col("p"), F.lit(chunk)) < SHARED, own - 1), F.when(F.pmod(F.col("p"), F.lit(chunk)) >= chunk - SHARED, own + 1))
    last = F.floor((F.col("n") - 1) / chunk)
    dealt = rows.withColumn("chunk", F.explode(F.array_compact(near))).where((F.col("chunk") >= 0) & (F.col("chunk") <= last))
    kind = rows.schema["series"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["series", "chunk"]):
            p, n, c = group.column("p").to_numpy(), group.column("n")[0].as_py(), group.column("chunk")[0].as_py()
            waves = transforms(group.column("x").to_numpy().astype(float), n)
            peak = np.zeros(waves.shape, bool)
            peak[:, 1:-1] = (waves[:, 1:-1] > waves[:, :-2]) & (waves[:, 1:-1] > waves[:, 2:])
            mine = np.flatnonzero(p // chunk == c)
            row = peak.argmax(axis=0)
            found = pa.array(peak.any(axis=0)[mine])
            columns = [group.column(k).combine_chunks().take(pa.array(mine)) for k in ("series", "n", "p")]
            strength = np.abs(waves[row, np.arange(len(p))])[mine]
            columns += [pa.array(waves[0][mine]), pc.if_else(found, pa.array(row[mine].astype(np.int32)), pa.scalar(None, pa.int32())), pc.if_else(found, pa.array(strength), pa.scalar(None, pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["series", "n", "p", "wave", "row", "strength"])

    laid = dealt.repartition(parts, "series", "chunk").sortWithinPartitions("series", "chunk", "p")
    return laid.mapInArrow(run, f"series {kind}, n long, p long, wave double, row int, strength double")


def _answers(waves: DataFrame, least: int) -> DataFrame:
    """For each peak of ``waves`` and each block that its noise window touches: counts and neighbours of its strength and of minus that."""
    parts = int(waves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = waves.schema["series"].dataType.simpleString()
    span = F.ceil(F.col("n") / 20)
    size = F.greatest(F.lit(least), F.least(F.lit(MOST), F.ceil(span / BLOCKS))).cast("long")
    sized = waves.withColumns({"size": size, "half": F.floor(span / 2), "odd": F.pmod(span, F.lit(2))})
    lo, hi = F.greatest(F.col("p") - F.col("half"), F.lit(0)), F.least(F.col("p") + F.col("half") + F.col("odd"), F.col("n"))
    none = F.lit(None)
    values = sized.select("series", F.floor(F.col("p") / F.col("size")).cast("long").alias("block"), F.lit(0).alias("kind"), "p", F.col("wave").alias("x"), none.cast("int").alias("row"), none.cast("long").alias("a"), none.cast("long").alias("b"), none.cast("long").alias("m"))
    asked = sized.where("row is not null").withColumns({"lo": lo.cast("long"), "hi": hi.cast("long")})
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / F.col("size")), F.floor((F.col("hi") - 1) / F.col("size")))))
    base = F.col("block") * F.col("size")
    asked = asked.select(
        "series", F.col("block").cast("long").alias("block"), F.lit(1).alias("kind"), "p", F.col("strength").alias("x"), "row",
        (F.greatest("lo", base) - base).cast("long").alias("a"), (F.least("hi", base + F.col("size")) - base).cast("long").alias("b"), (F.col("hi") - F.col("lo")).cast("long").alias("m"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["series", "block"]):
            kinds = group.column("kind").to_numpy()
            cut = int(np.searchsorted(kinds, 1))
            if cut == len(kinds):
                continue
            counts, asked = RangeCounts(group.column("x").slice(0, cut).to_numpy()), group.slice(cut)
            a, b, s = (asked.column(c).to_numpy() for c in ("a", "b", "x"))
            found = [*counts(a, b, s, True), *counts(a, b, -s, False)]
            columns = [asked.column(c).combine_chunks() for c in ("series", "p", "row", "x", "m")]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(f) for f in found], names=["series", "p", "row", "s", "m", "c1", "down1", "up1", "c2", "down2", "up2"])

    laid = values.unionByName(asked).repartition(parts, "series", "block").sortWithinPartitions("series", "block", "kind", "p")
    return laid.mapInArrow(run, f"series {kind}, p long, row int, s double, m long, c1 long, down1 double, up1 double, c2 long, down2 double, up2 double")


def _between(down: Column, up: Column, share: Column) -> Column:
    """Linear interpolation, from the nearer side."""
    step = up - down
    return F.when(share == 0, down).when(share >= 0.5, up - step * (1 - share)).otherwise(down + step * share)


def wavelet_peaks(
    df: DataFrame, key: str, ts: str, value: str, ties: Sequence[str] = (), widths: Sequence[int] = (2, 3), chunk: int = CHUNK, least_block: int = LEAST, hot_rows: int | None = None
) -> DataFrame:
    """Number of wavelet peaks per series, a column ``number_cwt_peaks_<w>`` per largest width.

    A place counts if the transform peaks there at one of the widths 1 .. w and its size at the narrowest such width
    is not below that of the noise: the 10th percentile of the narrowest transform over a twentieth of the series around the place.
    Missing values are left out; a series without any has no peaks. Series of any length are spread over tasks.
    """
    if not set(widths) <= set(WIDTHS):
        raise ValueError("widths go from 1 to 3")
    if chunk < 2 * SHARED:
        raise ValueError(f"a chunk has at least {2 * SHARED} positions")
    x = col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(col(key).alias("series"), col(ts).alias("t"), *[col(t).alias(f"tie{i}") for i, t in enumerate(ties)], x.alias("x"))
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    placed = with_position(rows, ["series"], "t", [f"tie{i}" for i in range(len(ties))], "p", **options).select("series", (F.col("p") - 1).alias("p"), "x")
    lengths = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    waves = materialize(_peaks(join_back(placed, lengths, ["series"]), chunk))
    answers = _answers(waves, least_block).groupBy("series", "p").agg(
        F.first("row").alias("row"), F.first("s").alias("s"), F.first("m").alias("m"),
        *[f(c).alias(c) for i in (1, 2) for f, c in ((F.sum, f"c{i}"), (F.max, f"down{i}"), (F.min, f"up{i}"))],
    )
    place = (F.col("m") - 1) * F.lit(0.1)
    k, share = F.floor(place), place - F.floor(place)

    def side(i: int, fewer: Column, more: Column, near: Column) -> Column:
        return F.when(F.col(f"c{i}") <= k, fewer).when(F.col(f"c{i}") >= k + 2, more).otherwise(near)

    under = side(1, F.lit(False), F.lit(True), _between(F.col("down1"), F.col("up1"), share) <= F.col("s"))
    over = side(2, F.lit(True), F.lit(False), _between(F.col("down2"), F.col("up2"), share) >= -F.col("s"))
    loud = answers.where(under & over).groupBy("series").agg(*[F.sum((F.col("row") < w).cast("long")).alias(f"number_cwt_peaks_{w}") for w in widths])
    every = df.select(col(key).alias("series")).distinct()
    out = join_back(every, loud, ["series"]).fillna(0, [f"number_cwt_peaks_{w}" for w in widths])
    return out.withColumnRenamed("series", key)
