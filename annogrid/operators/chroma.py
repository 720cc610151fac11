"""Colour-fringe correction on pixel tables: box and guided filters, manifolds of log ratios, safety blending.

Filters work on tables (image_id, row, col, rows, cols, values...): a sliding window along the rows, then along the
columns. An image's border is repeated outwards by rows that are added for the window and dropped after it.
The correction takes sixteen such passes, each with a sort of its own; it works on arrays of whole images instead.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

PLACE = ["image_id", "row", "col", "rows", "cols"]
CHANNELS = ["c0", "c1", "c2"]
#: Pixels of whole images that are corrected together, and those beyond which an image is corrected strip by strip.
PIXELS, LARGE = 1 << 14, 1 << 18


@dataclass(frozen=True)
class ChromaSettings:
    radius: int = 5
    strength: float = 1.0
    guide: int = 0
    mode: str = "standard"
    refine: bool = True
    safety: float = 0.5
    log_threshold: float = 2.0
    eps_ratio: float = 1e-6
    eps_tiny: float = 1e-6
    eps_small: float = 1e-8
    eps_filter: float = 1e-4
    safety_threshold: float = 0.5
    clip_multiple: float = 2.0


def _slide(df: DataFrame, values: list[str], radius: int, along: str, across: str, size: str, kept: list[str]) -> DataFrame:
    n, i = F.col(size), F.col(along)
    # All places j from -radius to size + radius - 1 that an index stands for, the edge counted twice.
    turns = F.sequence(F.lit(-(radius // 2) - 1), F.lit(radius // 2 + 1))
    places = F.flatten(F.transform(turns, lambda t: F.array(i + 2 * n * t, -i - 1 + 2 * n * t)))
    padded = df.withColumn("_at", F.explode(F.filter(places, lambda j: (j >= -radius) & (j < n + radius))))
    window = Window.partitionBy("image_id", across).orderBy("_at").rowsBetween(-radius, radius)
    return padded.select(*PLACE, *kept, "_at", *(F.avg(v).over(window).alias(v) for v in values)).where(F.col("_at") == F.col(along)).drop("_at")


def box_means(df: DataFrame, values: list[str], radius: int, kept: list[str] = ()) -> DataFrame:
    """Means over (2 radius + 1) squared windows of several columns at once; the columns `kept` go along as they are."""
    flat = df.select(*PLACE, *kept, *values)
    return _slide(_slide(flat, values, radius, "col", "row", "cols", kept), values, radius, "row", "col", "rows", kept)


def guided(df: DataFrame, guide: str, sources: list[str], radius: int, eps: float) -> DataFrame:
    """Each source smoothed along the guide's edges; the other columns are kept. All sources share two passes."""
    # The other columns go through the windows: a join of pixels with pixels would move both, or broadcast one.
    own = [c for c in df.columns if c not in PLACE and c not in sources]
    g = F.col(guide)
    wide = df.select(*PLACE, *own, g.alias("_g"), (g * g).alias("_gg"), *(F.col(s).alias(f"_s{k}") for k, s in enumerate(sources)), *((g * F.col(s)).alias(f"_gs{k}") for k, s in enumerate(sources)))
    means = box_means(wide, wide.columns[len(PLACE) + len(own) :], radius, own)
    lines = []
    for k in range(len(sources)):
        a = (F.col(f"_gs{k}") - F.col("_g") * F.col(f"_s{k}")) / (F.col("_gg") - F.col("_g") * F.col("_g") + eps)
        lines += [a.alias(f"_a{k}"), (F.col(f"_s{k}") - a * F.col("_g")).alias(f"_b{k}")]
    smooth = box_means(means.select(*PLACE, *own, *lines), [f"_{x}{k}" for k in range(len(sources)) for x in "ab"], radius, own)
    return smooth.select(*PLACE, *own, *((F.col(f"_a{k}") * g + F.col(f"_b{k}")).alias(s) for k, s in enumerate(sources)))


def _window_sums(x: np.ndarray, radius: int, axis: int, parts: int) -> np.ndarray:
    """Sums over 2 radius + 1 places along an axis, divided by `parts`; the edges are mirrored outwards."""
    n = x.shape[axis]
    places = np.arange(-radius, n + radius) % (2 * n)
    padded = np.take(x, np.where(places < n, places, 2 * n - 1 - places), axis=axis)
    shifted = lambda k: padded[(..., slice(k, k + n)) + (slice(None),) * (-1 - axis)]
    total = shifted(0).copy()
    for k in range(1, 2 * radius + 1):
        total += shifted(k)
    total /= parts
    return total


def _means(x: np.ndarray, radius: int, gaps: np.ndarray | None) -> np.ndarray:
    """Means over squared windows of the last two axes (row, col); neither NaN nor the places `gaps` count."""
    if gaps is not None:
        x = np.where(gaps, np.nan, x)
    size, none = 2 * radius + 1, np.isnan(x)
    if not none.any():
        return _window_sums(_window_sums(x, radius, -1, size), radius, -2, size)
    total, count = (_window_sums(_window_sums(v, radius, -1, 1), radius, -2, 1) for v in (np.where(none, 0.0, x), (~none).astype(float)))
    return total / count


def _smoothed(guide: np.ndarray, sources: np.ndarray, s: ChromaSettings, gaps: np.ndarray | None) -> np.ndarray:
    """What `guided` does, for arrays: each source (source, image, row, col) smoothed along the guide's edges."""
    k = len(sources)
    m = _means(np.concatenate([guide[None], (guide * guide)[None], sources, guide * sources]), s.radius, gaps)
    a = (m[2 + k :] - m[0] * m[2 : 2 + k]) / (m[1] - m[0] * m[0] + s.eps_filter)
    lines = _means(np.concatenate([a, m[2 : 2 + k] - a * m[0]]), s.radius, gaps)
    return lines[:k] * guide + lines[k:]


def log_ratio(target: np.ndarray, guide: np.ndarray, s: ChromaSettings) -> tuple[np.ndarray, np.ndarray]:
    """log2 of target over guide within the threshold, and the weight that larger ratios keep."""
    ratio = np.log2(np.fmax(target, s.eps_ratio)) - np.log2(np.fmax(guide, s.eps_ratio))
    far = np.abs(ratio)
    return np.clip(ratio, -s.log_threshold, s.log_threshold), np.where(far > s.log_threshold, s.log_threshold / far, 1.0)


def corrected_channel(target: np.ndarray, guide: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray, s: ChromaSettings, gaps: np.ndarray | None = None) -> np.ndarray:
    """`target` (image, row, col) corrected by `guide`; low and high: the guide's ends in each image, most: the target's.

    A value that is missing is NaN; fmin and fmax pass over it, as SQL does.
    """
    ratio, weight = log_ratio(target, guide, s)
    share = (guide - low) / (high - low + s.eps_tiny)
    lower, upper = (1.0 - share) * weight, share * weight
    ln, ld, un, ud = _smoothed(guide, np.stack([ratio * weight * lower, lower, ratio * weight * upper, upper]), s, gaps)
    both = np.stack([ln / (ld + s.eps_tiny), un / (ud + s.eps_tiny)])
    if s.refine:
        both = _smoothed(guide, both, s, gaps)
    share = np.fmin(np.fmax(share, 0.0), 1.0)
    correction = (1.0 - share) * both[0] + share * both[1]
    correction = {"brighten": lambda x: np.fmax(x, 0.0), "darken": lambda x: np.fmin(x, 0.0)}.get(s.mode, lambda x: x)(correction) * s.strength
    new = guide * np.exp2(correction)
    if s.safety > 0:
        change = np.abs(new / (guide + s.eps_small) - target / (guide + s.eps_small))
        blend = np.fmin(np.fmax((change - s.safety_threshold) / (s.safety_threshold + s.eps_small), 0.0), 1.0) * s.safety
        new = new * (1 - blend) + target * blend
    return np.fmin(np.fmax(new, 0.0), most * s.clip_multiple)


@np.errstate(all="ignore")
def correct_planes(planes: np.ndarray, gaps: np.ndarray | None, s: ChromaSettings, step: int) -> None:
    """Planes (channel, image, row, col) corrected in place, `step` rows at a time; `gaps`: places without a pixel."""
    end = lambda f, x: f.reduce(x, axis=(1, 2))[:, None, None]
    top = np.fmax.reduce([end(np.fmax, x) for x in planes])
    scale = np.where(top > 1.0, top, 1.0)
    planes /= scale
    # A row of the result depends on those that its windows reach, one after another.
    guide, height, reach = planes[s.guide], planes.shape[2], s.radius * (4 if s.refine else 2)
    low, high = end(np.fmin, guide), end(np.fmax, guide)
    for c in range(len(planes)):
        if c == s.guide:
            continue
        target, above = planes[c], planes[c][:, :0]
        most = end(np.fmax, target)
        for begin in range(0, height, step):
            stop, first = min(begin + step, height), begin - above.shape[1]
            old = np.concatenate([above, target[:, begin : stop + reach]], axis=1)
            rows = slice(first, first + old.shape[1])
            new = corrected_channel(old, guide[:, rows], low, high, most, s, None if gaps is None else gaps[:, rows])
            above = old[:, max(0, stop - first - reach) : stop - first]
            target[:, begin:stop] = new[:, begin - first : stop - first]
    planes *= scale


def _places(batch: pa.RecordBatch | pa.Table, height: np.ndarray | int, width: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    row, col = (batch.column(c).to_numpy() for c in ("row", "col"))
    if not ((row >= 0) & (row < height) & (col >= 0) & (col < width)).all():
        raise ValueError("a pixel lies outside of its image")
    return row.astype(np.int64), col.astype(np.int64)


def _values(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in CHANNELS])


def _rows(ids: pa.Array, row: pa.Array, col: pa.Array, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, row, col, *(pa.array(v, mask=np.isnan(v)) for v in values)], ["image_id", "row", "col", *CHANNELS])


def _small(held: list[pa.RecordBatch], s: ChromaSettings) -> Iterator[pa.RecordBatch]:
    """Whole images; those of one shape are corrected together."""
    table = pa.Table.from_batches(held).combine_chunks()
    if not table.num_rows:
        return
    n, height, width = (table.column(c).to_numpy() for c in ("n", "rows", "cols"))
    (row, col), values, starts, at = _places(table, height, width), _values(table), [], 0
    while at < len(n):
        starts.append(at)
        at += int(n[at])
    image, shapes = np.repeat(np.arange(len(starts)), n[starts]), np.column_stack([height, width])[starts].astype(np.int64)
    for h, w in np.unique(shapes, axis=0):
        those = (shapes == (h, w)).all(axis=1)
        pixels = np.flatnonzero(those[image])
        place = ((np.cumsum(those) - 1)[image[pixels]] * h + row[pixels]) * w + col[pixels]
        planes, gaps = np.full((len(CHANNELS), those.sum() * h * w), np.nan), np.ones(those.sum() * h * w, bool)
        planes[:, place], gaps[place] = values[:, pixels], False
        shape = (those.sum(), h, w)
        correct_planes(planes.reshape(len(CHANNELS), *shape), gaps.reshape(shape) if gaps.any() else None, s, h)
        values[:, pixels] = planes[:, place]
    yield _rows(*(table.column(c).combine_chunks() for c in ("image_id", "row", "col")), values)


class _Large:
    """One image whose planes lie in a file; it is corrected strip by strip."""

    def __init__(self, batch: pa.RecordBatch, at: int):
        self.of, (self.height, self.width) = batch.slice(at, 1), (batch.column(c)[at].as_py() for c in ("rows", "cols"))
        with tempfile.TemporaryFile() as a, tempfile.TemporaryFile() as b:  # they last as long as the arrays
            self.planes = np.memmap(a, float, "w+", shape=(len(CHANNELS), 1, self.height, self.width))
            self.count = np.memmap(b, np.int32, "w+", shape=(1, self.height, self.width))

    def fill(self, batch: pa.RecordBatch) -> None:
        row, col = _places(batch, self.height, self.width)
        self.planes[:, 0, row, col] = _values(batch)
        np.add.at(self.count[0], (row, col), 1)

    def corrected(self, s: ChromaSettings) -> Iterator[pa.RecordBatch]:
        step, gaps = max(1, LARGE // self.width), np.asarray(self.count) == 0
        self.planes[:, gaps] = np.nan
        correct_planes(self.planes, gaps if gaps.any() else None, s, max(step, s.radius * 4))
        for begin in range(0, self.height, step):
            row, col = np.nonzero(self.count[0, begin : begin + step])
            times = self.count[0, row + begin, col]
            row, col = np.repeat(row + begin, times), np.repeat(col, times)
            kinds = (self.of.schema.field(c).type for c in ("row", "col"))
            ids = self.of.column("image_id").take(pa.array(np.zeros(len(row), np.int64)))
            yield _rows(ids, *(pa.array(x).cast(k) for x, k in zip((row, col), kinds, strict=True)), np.asarray(self.planes[:, 0, row, col]))


def correct_batches(batches: Iterable[pa.RecordBatch], s: ChromaSettings) -> Iterator[pa.RecordBatch]:
    """Batches (image_id, row, col, rows, cols, c0, c1, c2, n) in which the n rows of an image follow each other, also across batches."""
    held, rows, left, large = [], 0, 0, None
    for batch in batches:
        n, height, width = (batch.column(c).to_numpy() for c in ("n", "rows", "cols"))
        at = begin = 0
        while at < batch.num_rows:
            if not left:
                left = int(n[at])
                if int(height[at]) * int(width[at]) > LARGE:
                    yield from _small([*held, batch.slice(begin, at - begin)], s)
                    held, rows, large = [], 0, _Large(batch, at)
            step = min(left, batch.num_rows - at)
            at, left = at + step, left - step
            if large is not None:
                large.fill(batch.slice(at - step, step))
                begin = at
                if not left:
                    yield from large.corrected(s)
                    large = None
            elif not left and rows + at - begin >= PIXELS:
                yield from _small([*held, batch.slice(begin, at - begin)], s)
                held, rows, begin = [], 0, at
        if begin < batch.num_rows:  # even an empty slice would keep the batch
            held.append(batch.slice(begin))
            rows += batch.num_rows - begin
    if rows:
        yield from _small(held, s)


def corrected(df: DataFrame, settings: ChromaSettings = ChromaSettings()) -> DataFrame:
    """All channels c0, c1, c2 but the guide corrected; images with values over 1 are scaled by their maximum meanwhile.

    A missing pixel counts in no window; a null channel, as NaN, neither, and a null guide stays null. Pixels of a null
    image_id belong to no image and go, as in a join by it.
    """
    image = Window.partitionBy("image_id")
    # The window lays the pixels of an image together; it moves none that already lie with their image.
    plain = df.where(F.col("image_id").isNotNull()).select(*PLACE, *(F.col(c).cast("double").alias(c) for c in CHANNELS))
    counted = plain.withColumn("n", F.count(F.lit(1)).over(image))
    fields = [counted.schema[c] for c in ("image_id", "row", "col")]
    return counted.mapInArrow(lambda batches: correct_batches(batches, settings), StructType([*fields, *(StructField(c, DoubleType()) for c in CHANNELS)]))


#: fixed values: names of guides and modes
GUIDES = {"green": 0, "red": 1, "blue": 2}
MODES = ("standard", "brighten", "darken")


def correct_chromatic_aberration(df: DataFrame, guide: str = "green", mode: str = "standard", **settings) -> DataFrame:
    """Corrected channels by names of the guide and mode, in any case; an unknown name counts as the default, as does a setting of None."""
    given = {k: v for k, v in settings.items() if v is not None}
    name = mode.lower()
    return corrected(df, ChromaSettings(guide=GUIDES.get(guide.lower(), 0), mode=name if name in MODES else "standard", **given))


def staged(df: DataFrame, stages: list[tuple[int, ChromaSettings]]) -> DataFrame:
    """Several corrections in the order of their priority, then of their place in the list."""
    for _, _, settings in sorted(((p, k, s) for k, (p, s) in enumerate(stages)), key=lambda x: x[:2]):
        done = corrected(df, settings)
        df = done.join(df.select(*PLACE), ["image_id", "row", "col"])
    return df
