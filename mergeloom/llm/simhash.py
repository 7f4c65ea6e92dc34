"""SimHash near-duplicates found by covering locality-sensitive hashing.

Each bit position gets a non-zero code of radius + 1 bits. For each non-zero v
of that many bits, one table masks the fingerprint to the positions whose code
has an odd inner product with v. The codes of at most `radius` differing
positions cannot span the whole space, so some v is orthogonal to all of them,
and in its table none of those positions is kept: the two fingerprints collide
there. So every pair within the radius is found, not only most of them.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .scratch import stored

BITS = 64
FLUSH = 1 << 17


def covering_masks(radius: int = 2, bits: int = BITS, seed: int = 20) -> list[int]:
    """2^(radius+1) - 1 masks: any two values that differ in at most radius bits agree under one of them."""
    dims = radius + 1
    codes = [1 + (i % (2**dims - 1)) for i in range(bits)]
    random.Random(seed).shuffle(codes)
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() & 1) for v in range(1, 2**dims)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes | None, width: int, seed: int) -> list[int]:
    """XXH64 of each shingle of words; of all words where there are fewer; [] without words."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    return [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=True)]


def fold(hashes: list[int], counts: list[int]) -> np.ndarray:
    """A fingerprint for each run of counts hashes: bit set where over half of the run have it."""
    out = np.zeros(len(counts), np.uint64)
    n = np.asarray(counts, np.int64)
    if hashes:
        bits = np.unpackbits(np.asarray(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = (np.cumsum(n) - n)[n > 0]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[n > 0] = np.packbits(2 * ones > n[n > 0, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for each row; a null, empty or wordless text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, hashes, counts, held = [], [], [], 0
            for t in batch.column(1):
                got = shingle_hashes(t.as_py(), width, seed)
                if len(got) > FLUSH:  # a very long text by itself, a piece at a time
                    parts.append(fold(hashes, counts))
                    hashes, counts, held = [], [], 0
                    ones = np.zeros(BITS, np.int64)
                    for i in range(0, len(got), FLUSH):
                        ones += np.unpackbits(np.asarray(got[i : i + FLUSH], np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                    parts.append(np.packbits(2 * ones > len(got)).view(">u8").astype(np.uint64))
                    continue
                hashes += got
                counts.append(len(got))
                held += len(got)
                if held > FLUSH:
                    parts.append(fold(hashes, counts))
                    hashes, counts, held = [], [], 0
            parts.append(fold(hashes, counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_col, "UTF-8").alias("text")).mapInArrow(run, "id long, fp long")


def links(fps: DataFrame, radius: int = 2, small: int = 48) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints (distinct longs, column fp) within radius 2.

    Buckets of up to `small` fingerprints are compared pair by pair. A larger
    bucket is never compared within itself: each member names the 64 values one
    bit away and itself. Two members name a common value just when they differ
    in at most two bits, so a star over the members that name a value holds
    true links only and loses none.
    """
    if radius != 2:
        raise ValueError("large buckets are resolved for radius 2")
    masks = [_signed(m) for m in covering_masks(radius)]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("v"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks)])).alias("t"))
    keyed = keyed.select("fp", "t.v", "t.k")
    sizes = keyed.groupBy("v", "k").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["v", "k"])
    groups = keyed.where(F.col("n") <= small).groupBy("v", "k").agg(F.sort_array(F.collect_list("fp")).alias("g"))
    pairs = groups.select(F.explode(F.expr("flatten(transform(g, (x, i) -> transform(filter(slice(g, i + 2, size(g)), y -> bit_count(x ^ y) <= 2), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    flips = [0, *(_signed(1 << i) for i in range(BITS))]
    balls = keyed.where(F.col("n") > small).select("fp").distinct().select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x).cast("long")) for x in flips])).alias("c"))
    centre = balls.groupBy("c").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("c", "b")
    stars = balls.join(centre, "c").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def components(fps: DataFrame) -> DataFrame:
    """(fp, root): each distinct fingerprint of fps with the one that stands for its component."""
    distinct = stored(fps.select("fp").distinct(), "distinct")
    roots = connected(links(distinct))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    Repeated ids are rows of their own. A row with a null id has a fingerprint and
    joins groups, but never names one: a group of such rows alone has component
    null. No rows give no rows. Other columns of docs are ignored.
    """
    fps = stored(fingerprints(docs, width, seed, id_col, text_col), "fp")
    distinct = stored(fps.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    roots = connected(links(distinct.select("fp")))
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id")
    out = fps.join(named, "fp", "left")
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
