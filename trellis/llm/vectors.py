"""Embedding near-dedup by PCA-ordered tiled comparison (operator 2).

Distinct vectors are rotated to principal axes. Axis-parallel splits of the leading
coordinates make tiles, and only tiles whose boxes come within the distance that the
threshold allows are compared. In a pair of tiles the products of the leading dimensions
are summed first; the rest of a product is at most the product of the suffix norms, so a
block stops as soon as no cosine in it can reach the threshold, and what is left is
finished in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths don't link; equal vectors are one class
whose members all link with each other; rows with equal ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

THRESHOLD, TILE, SAMPLE, LEADING, SIDE = 0.95, 4096, 4096, 8, 512


class Tiles:
    """Principal axes and a tree of splits, fitted on a bounded sample; exact for all vectors.

    Any rotation keeps cosines, and a split only says on which side a vector lies.
    """

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, tile: int):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        spread, axes = np.linalg.eigh(unit.T @ unit)
        self.axes = axes[:, np.argsort(-spread)]
        self.threshold, self.reach, self.tile = threshold, np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9, tile
        z = unit @ self.axes[:, : min(LEADING, unit.shape[1])]
        self.splits: list[tuple[int, float, int, int]] = []  # axis, border, children; leaves are -1 - leaf
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        want = max(1, min(-(-rows // tile), len(sample) // 8))
        self.root = self._grow(z, np.full(z.shape[1], -np.inf), np.full(z.shape[1], np.inf), want)

    def _grow(self, z: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: int) -> int:
        if want > 1 and len(z) > 1:
            axis = int(z.std(0).argmax())
            border = float(np.median(z[:, axis]))
            left = z[:, axis] < border
            if left.any() and not left.all():
                node = len(self.splits)
                self.splits.append(())
                up, down = hi.copy(), lo.copy()
                up[axis], down[axis] = border, border
                self.splits[node] = (axis, border, self._grow(z[left], lo, up, want // 2), self._grow(z[~left], down, hi, want - want // 2))
                return node
        self.boxes.append((lo, hi))
        return -len(self.boxes)

    def leaf(self, z: np.ndarray) -> np.ndarray:
        out, stack = np.empty(len(z), np.int64), [(self.root, np.arange(len(z)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            axis, border, a, b = self.splits[node]
            left = z[rows, axis] < border
            stack += [(a, rows[left]), (b, rows[~left])]
        return out

    def near(self) -> list[list[int]]:
        """For each leaf the leaves whose boxes come within reach, itself included."""
        lo, hi = (np.array([b[k] for b in self.boxes]) for k in (0, 1))
        out = []
        for k in range(len(lo)):
            gap = np.maximum(0, np.maximum(lo - hi[k], lo[k] - hi))
            out.append(np.flatnonzero((np.where(np.isfinite(gap), gap, 0) ** 2).sum(1) <= self.reach**2).tolist())
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _leaves(tiles: Tiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(2))
                z = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ tiles.axes[:, : min(LEADING, x.shape[1])]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tiles.leaf(z).astype(np.int32))], [*b.schema.names, "leaf"])

    return run


def compare(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of x and y with a cosine of at least threshold; same: x is y, and only pairs i < j."""
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    dims = [d for d in (LEADING, 2 * LEADING, 4 * LEADING) if d < x.shape[1]]
    zx, zy = x @ axes, y @ axes
    rest = lambda z, d: np.sqrt(np.maximum(0, 1 - (z[:, :d] ** 2).sum(1))) + 1e-7
    sx, sy = [rest(zx, d) for d in dims], [rest(zy, d) for d in dims]
    ox, oy = np.argsort(zx[:, 0]), np.argsort(zy[:, 0])
    for a in range(0, len(x), SIDE):
        i = ox[a : a + SIDE]
        for b in range(a if same else 0, len(y), SIDE):
            j = oy[b : b + SIDE]
            partial, done, r, c = None, 0, None, None
            for k, d in enumerate(dims):
                step = zx[i, done:d] @ zy[j, done:d].T
                partial, done = step if partial is None else partial + step, d
                alive = partial + sx[k][i][:, None] * sy[k][j][None, :] >= threshold
                n = int(alive.sum())
                if not n:
                    break
                if n * 20 < alive.size:
                    r, c = np.nonzero(alive)
                    break
            else:
                n = 1
            if not n:
                continue
            if r is None:
                r, c = np.nonzero(x[i] @ y[j].T >= threshold)
                r, c = i[r], j[c]
            else:
                r, c = i[r], j[c]
                hit = np.einsum("ij,ij->i", x[r], y[c]) >= threshold
                r, c = r[hit], c[hit]
            if same:
                r, c = (r, c) if a != b else (r[r < c], c[r < c])
            if r.size:
                yield r, c


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not (label[label] == label).all():
            label[:] = label[label]


def _units(tiles: Tiles):
    """Rows sorted by unit and tile -> (class, links, root): links counted here, and a forest."""

    def one(cid: np.ndarray, n: np.ndarray, tile: np.ndarray, x: np.ndarray, same: bool) -> pa.RecordBatch | None:
        cut = len(tile) if same else int(np.searchsorted(tile, tile[0], side="right"))
        if not same and cut == len(tile):
            return None
        first, off = (x, 0) if same else (x[:cut], cut)
        second = x if same else x[cut:]
        count, label = np.zeros(len(x), np.int64), np.arange(len(x))
        for r, c in compare(first, second, tiles.axes, tiles.threshold, same):
            c = c + off
            count += np.bincount(r, n[c], len(x)).astype(np.int64) + np.bincount(c, n[r], len(x)).astype(np.int64)
            _join(label, r, c)
        hit = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(count[hit]), pa.array(cid[label[hit]])], ["cid", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                unit, same = t.column(0).to_numpy(), t.column(1).to_numpy()
                out = one(t.column(3).to_numpy(), t.column(4).to_numpy(), t.column(2).to_numpy(), _matrix(t.column(5).chunk(0)), bool(same[0]))
                if unit.size and out is not None:
                    yield out
            held.clear()

        now = None
        for b in batches:
            unit = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for p, q in zip(edges, edges[1:], strict=False):
                if q > p:
                    if now is not None and unit[p] != now:
                        yield from flush()
                    now = unit[p]
                    held.append(b.slice(p, q - p))
        yield from flush()

    return run


def _of_length(classes: DataFrame, rows: int, threshold: float, tile: int, sample: int) -> DataFrame:
    """(cid, links, root) of classes (cid, n, embedding) of one length."""
    few = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("embedding").toPandas()
    tiles = Tiles(np.array(few["embedding"].tolist(), np.float64), rows, threshold, tile)
    near = tiles.near()
    leaved = Scratch(classes.select("cid", "n", "embedding").mapInArrow(_leaves(tiles), f"cid long, n long, embedding {dict(classes.dtypes)['embedding']}, leaf int"), "vectors-leaves").read()
    count = {r.leaf: r["count"] for r in leaved.groupBy("leaf").count().collect()}
    parts = {k: max(1, -(-v // tile)) for k, v in count.items()}
    # the leaves in reach, with their numbers of parts: at most sample / 8 rows of as many
    reach = classes.sparkSession.createDataFrame([(k, parts[k], [(o, parts[o]) for o in near[k] if o in parts]) for k in parts], "leaf int, parts int, near array<struct<leaf:int,parts:int>>")
    own = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    spread = leaved.join(F.broadcast(reach), "leaf").withColumn("part", own).withColumn("o", F.explode("near")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("o.parts") - 1)))
    mine, theirs = F.struct("leaf", "part"), F.struct(F.col("o.leaf").alias("leaf"), F.col("other").alias("part"))
    units = spread.select(F.xxhash64(F.least(mine, theirs), F.greatest(mine, theirs)).alias("unit"), (mine == theirs).alias("same"), F.xxhash64(mine).alias("tile"), "cid", "n", "embedding")
    return units.repartition("unit").sortWithinPartitions("unit", "tile").mapInArrow(_units(tiles), "cid long, links long, root long")


def _finite_scale(df: DataFrame, vector_col: str) -> Column:
    """Vectors of 32-bit floats as they are; others in double precision over their largest component, so that squares neither overflow nor vanish."""
    if dict(df.dtypes)[vector_col] == "array<float>":
        return F.col(vector_col)
    v = F.col(vector_col).cast("array<double>")
    largest = F.array_max(F.transform(v, F.abs))
    return F.when((largest > 0) & (largest < float("inf")), F.transform(v, lambda x: x / largest)).otherwise(v)


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component), one row a row of df.

    sample bounds what fits the axes and the splits; it doesn't change the result.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("long").alias("id"), _finite_scale(df, vector_col).alias("embedding"))
    wide = F.expr("transform(embedding, v -> double(v))")
    bad = F.expr("embedding is null or size(embedding) = 0 or exists(embedding, v -> v is null or isnan(v) or abs(v) = double('infinity'))")
    norm = F.aggregate(wide, F.lit(0.0), lambda s, v: s + v * v)
    good = F.when(bad, F.lit(False)).otherwise(norm > 0)
    valid, rest = base.filter(good), base.filter(~good)
    classes = Scratch(valid.groupBy("embedding").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()), "vectors-classes").read()
    found = None
    for r in classes.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect():
        part = _of_length(classes.filter(F.size("embedding") == r.d), r["count"], threshold, tile, sample)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "cid long, links long, root long")
    found = Scratch(found, "vectors-links").read()
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    of = classes.join(links, "cid", "left").join(comp, F.col("cid") == F.col("node"), "left").select("cid", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("set"))
    of = Scratch(of, "vectors-sets").read()
    named = of.join(of.groupBy("set").agg(F.min("least").alias("component")), "set").select(F.col("embedding").alias("__e"), "n_links", "component")
    out = valid.join(named, F.col("embedding") == F.col("__e")).select("id", F.col("n_links").cast("long"), "component")
    return out.unionByName(rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
