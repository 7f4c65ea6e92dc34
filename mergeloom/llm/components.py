"""Connected components by alternating large-star and small-star steps.

No node's edges are ever gathered in one place: each step is a minimum per
node, which is summed before the shuffle, and an equi-join that adaptive
execution splits where a hub is hot. Edges of one partition are first reduced
to a spanning forest, so that the steps start from few edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, new_path, stored

EDGE = "a long, b long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: a star of each component that its edges form (greater id first)."""
    for batch in batches:
        up: dict[int, int] = {}

        def root(x: int, up: dict[int, int] = up) -> int:
            top = x
            while (p := up.get(top, top)) != top:
                top = p
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
        nodes = sorted(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, root) for every node of edges (its first two columns, longs) but the roots.

    root is the smallest node that can be reached. Edges with a null end and
    loops say nothing and are left out. An empty input gives an empty table.
    """
    spark = edges.sparkSession
    x, y = edges.columns[:2]
    first = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where(f"`{x}` is not null and `{y}` is not null and a <> b")
    path = new_path(spark, "edges")
    now = stored(first.mapInArrow(_forest, EDGE).where("a <> b"), "edges", path)
    sign = _signature(now)
    for _ in range(max_steps):
        if not sign[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.a", "e.b").where("a <> b").distinct()
        old, path = path, new_path(spark, "edges")
        now = stored(small, "edges", path)
        forget(spark, old)
        new = _signature(now)
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
