"""Exact cosine near-duplicates of embeddings by PCA-ordered tiled comparison.

Vectors are turned into principal axes, the widest first: dot products stay, and
their leading part comes early. Each label's distinct vectors are sorted along
the first axes and cut into tiles. Tiles meet by the cells that they cover, and
are compared only where their extents leave room for a pair, and a pair only as long as what it has so far,
plus the product of the norms of the two rests, can still reach the threshold.
Pairs that remain are decided by the double-precision cosine of the vectors
themselves. A comparison of two tiles returns sums and a spanning forest, never
the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .scratch import stored

TILE = 512
#: Axes on which a tile's extent is kept.
AXES = 8
SLACK = 1e-9
_TILES = "tile long, label string, dim int, n int, nodes binary, weights binary, vectors binary, low array<double>, high array<double>"


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector's bytes as doubles; null where it is null, empty, zero or not finite."""
    for batch in batches:
        vectors = []
        for v in batch.column(2):
            x = np.array([np.nan if c is None else c for c in v.as_py()], float) if v.is_valid else np.zeros(0)
            norm = np.sqrt(x @ x) if len(x) and np.isfinite(x).all() else 0.0
            vectors.append((x + 0.0).tobytes() if np.isfinite(norm) and norm > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], names=["vec_id", "label", "v"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of unit vectors' components, by dimension and place in the matrix."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        by: dict[int, list[bytes]] = {}
        for v in batch.column(0).to_pylist():
            by.setdefault(len(v) // 8, []).append(v)
        for d, vs in by.items():
            x = np.frombuffer(b"".join(vs)).reshape(-1, d)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(np.arange(d * d), pa.int32()), pa.array(m.ravel())], names=["dim", "i", "s"])


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension: an orthogonal matrix whose columns are the principal axes, widest first."""
    rows = vectors.select("v").mapInArrow(_moments, "dim int, i int, s double").groupBy("dim", "i").agg(F.sum("s").alias("s")).collect()
    sums: dict[int, np.ndarray] = {}
    for dim, i, s in rows:
        sums.setdefault(dim, np.zeros(dim * dim))[i] = s
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() for d, m in sums.items()}


def _turned(raw: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return (raw / np.sqrt((raw * raw).sum(1, keepdims=True))) @ turn


def _cut(turns, size: int):
    """Over rows sorted by label and place: tiles of up to size vectors of one label and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            nonlocal made
            dim = held[0][1]
            raw = np.frombuffer(b"".join(h[4] for h in held)).reshape(-1, dim)
            x = _turned(raw, turns.value[dim])[:, :AXES]
            row = [base + made, held[0][0], dim, len(held), np.array([h[2] for h in held], np.int64).tobytes(), np.array([h[3] for h in held], np.int64).tobytes(), raw.tobytes(), x.min(0).tolist(), x.max(0).tolist()]
            made += 1
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["tile", "label", "dim", "n", "nodes", "weights", "vectors", "low", "high"])

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (len(held) == size or held[0][:2] != r[:2]):
                    yield out()
                    held = []
                held.append(r)
        if held:
            yield out()

    return run


def compare(a: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows of a and b with cosine >= threshold."""
    x, y = _turned(a, turn), _turned(b, turn)
    d = x.shape[1]
    steps = sorted({min(d, s) for s in (8, 16, 32)} | {d})
    rest = lambda z, k: np.sqrt(np.maximum(0.0, (z[:, k:] ** 2).sum(1)))
    first = steps[0]
    so_far = x[:, :first] @ y[:, :first].T
    i, j = np.nonzero(so_far + np.outer(rest(x, first), rest(y, first)) >= threshold - SLACK)
    s = so_far[i, j]
    for k, to in zip(steps, steps[1:], strict=False):
        if not len(i):
            break
        # few pairs go on one by one; many as a block
        if len(i) * 8 < x.shape[0] * y.shape[0]:
            s = s + np.einsum("ij,ij->i", x[i, k:to], y[j, k:to])
        else:
            so_far = so_far + x[:, k:to] @ y[:, k:to].T
            s = so_far[i, j]
        keep = s + rest(x, to)[i] * rest(y, to)[j] >= threshold - SLACK
        i, j, s = i[keep], j[keep], s[keep]
        if len(i) * 8 >= x.shape[0] * y.shape[0] and to < d:
            so_far = x[:, :to] @ y[:, :to].T
    sure = np.zeros(len(i), bool)
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        sure[at : at + len(p)] = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q]) >= threshold
    return i[sure], j[sure]


def _compared(turns, threshold: float):
    """For each pair of tiles: what each vector gains in links, and a forest of the links (gain 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, same, na, wa, va, nb, wb, vb = (batch.column(k)[row].as_py() for k in range(8))
                na, nb, wa, wb = (np.frombuffer(z, np.int64) for z in (na, nb, wa, wb))
                i, j = compare(np.frombuffer(va).reshape(-1, dim), np.frombuffer(vb).reshape(-1, dim), turns.value[dim], threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                gain: dict[int, int] = {}
                up: dict[int, int] = {}
                ga, gb = np.bincount(i, wb[j], len(na)), np.bincount(j, wa[i], len(nb))
                for nodes, g in ((na, ga), (nb, gb)):
                    for k in np.flatnonzero(g):
                        gain[int(nodes[k])] = gain.get(int(nodes[k]), 0) + int(g[k])

                def root(z: int, up: dict[int, int] = up) -> int:
                    while (p := up.get(z, z)) != z:
                        up[z] = up.get(p, p)
                        z = p
                    return z

                for p, q in zip(na[i].tolist(), nb[j].tolist(), strict=True):
                    p, q = root(p), root(q)
                    if p != q:
                        up[max(p, q)] = min(p, q)
                nodes = list(gain)
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([gain[k] for k in nodes], pa.int64()), pa.array([root(k) for k in nodes], pa.int64())], names=["node", "gain", "to"])

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of embeddings.

    Only vectors of one label and one dimension are compared; equal vectors are compared
    once and count as often as they stand there. Vectors that are null, empty, zero or
    hold null or non-finite components, and those without a label, have no links and are
    their own component. Rows that repeat an id are vectors of their own. A row with a
    null id counts as a partner but names no component, and is not kept. Ties at the
    threshold are links. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    given = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding"))
    rows = stored(given.mapInArrow(_clean, "vec_id long, label string, v binary").withColumn("node", F.when(F.col("label").isNotNull() & F.col("v").isNotNull(), F.xxhash64("label", "v"))), "vectors")
    distinct = rows.where("node is not null").groupBy("label", "node", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    distinct = stored(distinct, "distinct")
    turns = spark.sparkContext.broadcast(axes(distinct))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = batch.column(3).to_pylist()
            lead = [tuple((_turned(np.frombuffer(v)[None, :], turns.value[len(v) // 8])[0, :2]).tolist()) if len(v) > 8 else (1.0, 0.0) for v in vs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) // 8 for v in vs], pa.int32()), batch.column(1), batch.column(2), batch.column(3), pa.array([round(a * 8) for a, _ in lead], pa.int32()), pa.array([b for _, b in lead], pa.float64())], names=["label", "dim", "node", "weight", "v", "p0", "p1"])

    order = ["label", "dim", "p0", "p1", "node"]
    sorted_ = distinct.select("label", "node", "weight", "v").mapInArrow(placed, "label string, dim int, node long, weight long, v binary, p0 int, p1 double")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = sorted_.repartitionByRange(n, *order).sortWithinPartitions(*order).select("label", "dim", "node", "weight", "v").mapInArrow(_cut(turns, tile), _TILES)
    tiles = stored(cut, "tiles")
    meta = tiles.select("tile", "label", "dim", "low", "high")
    reach = 2 - 2 * threshold + SLACK  # squared distance of two unit vectors at the threshold
    gap = F.expr("aggregate(zip_with(zip_with(low, high2, (a, b) -> a - b), zip_with(low2, high, (a, b) -> a - b), (p, q) -> greatest(p, q, 0D)), 0D, (s, g) -> s + g * g)")
    # tiles meet in the cells that they cover on the first two axes, one of them widened by the reach; a pair counts in the first cell that both have
    far = math.sqrt(reach)
    cell = max(far, 1 / 16)
    place = lambda c, i, by: F.floor((F.coalesce(F.get(c, F.lit(i)), F.lit(0.0)) + by) / cell)
    laid = lambda by: meta.select("*", *[place(c, i, s * by).alias(f"{c[0]}{i}") for i in (0, 1) for c, s in (("low", -1), ("high", 1))]).withColumn("c0", F.explode(F.sequence("l0", "h0"))).withColumn("c1", F.explode(F.sequence("l1", "h1")))
    one = laid(0.0).select("label", "dim", "c0", "c1", "tile", "low", "high", "l0", "l1")
    other = laid(far).select("label", "dim", "c0", "c1", F.col("tile").alias("tile2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("l0").alias("m0"), F.col("l1").alias("m1"))
    met = one.join(other, ["label", "dim", "c0", "c1"]).where("tile <= tile2 and c0 = greatest(l0, m0) and c1 = greatest(l1, m1)")
    pairs = met.where(gap <= reach).select("tile", "tile2")
    # dealt by tile, whatever the label, so that a label with most vectors is spread over all tasks
    left = tiles.select("tile", "dim", "nodes", "weights", "vectors")
    right = tiles.select(F.col("tile").alias("tile2"), F.col("nodes").alias("nodes2"), F.col("weights").alias("weights2"), F.col("vectors").alias("vectors2"))
    work = pairs.join(left, "tile").join(right, "tile2")
    found = work.select("dim", (F.col("tile") == F.col("tile2")).alias("same"), "nodes", "weights", "vectors", "nodes2", "weights2", "vectors2").mapInArrow(_compared(turns, threshold), "node long, gain long, to long")
    found = stored(found, "links")
    gains = found.groupBy("node").agg(F.sum("gain").alias("gain"))
    roots = connected(found.where("node <> to").select("node", "to"))
    member = distinct.select("node", "low", "weight").join(gains, "node", "left").join(roots, "node", "left").select("node", "low", (F.coalesce("gain", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = member.join(least, "root").select("node", "n_links", "component_id")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
