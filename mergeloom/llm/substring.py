"""Exact removal of repeated passages with a log-structured fingerprint index.

A window is `width` consecutive words. A window's fingerprint is the least
hash among its runs of `gram` words, so equal windows have equal fingerprints
and neighbouring windows mostly share theirs: a document of n words has about
n / 22 different ones. The index keeps each fingerprint and its number of
documents in sorted immutable runs, dealt into buckets by fingerprint. A new
batch becomes a run, which is merge-joined with the older ones bucket by bucket,
without a shuffle or a sort; two runs of one level are compacted into one of the
next.

A fingerprint that several documents have only marks candidates. The windows
under it are compared by a second 64-bit hash of all their words, and each
stretch found so is verified by the words themselves: by a 128-bit digest of the
bytes in both documents. The owner of a window is the smallest document in which
it starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import forget, forget_since, mark, new_path, stored

WIDTH, GRAM = 50, 8
#: Windows that a task holds before it compares them.
HELD = 1 << 21
#: A fingerprint of so many documents is hot: its windows are dealt out by their hashes, over a key for each SHARE documents.
SALTED, SHARE = 1024, 16

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


class Hasher:
    """Hashes of all runs of k words of a text, by prefix sums modulo 2^64."""

    def __init__(self) -> None:
        self.room = 0
        self.grow(4096)

    def grow(self, n: int) -> None:
        if n <= self.room:
            return
        self.room = 1 << (n - 1).bit_length()
        self.powers = []
        for base in _BASES:
            inverse = pow(base, -1, 1 << 64)
            up = np.full(self.room, base, np.uint64)
            down = np.full(self.room, inverse, np.uint64)
            up[0] = down[0] = 1
            self.powers.append((np.multiply.accumulate(up), np.multiply.accumulate(down)))

    def words(self, text: bytes | None) -> list[bytes]:
        return (text or b"").split()

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def runs(self, codes: np.ndarray, k: int, which: int) -> np.ndarray:
        n = len(codes)
        self.grow(n)
        up, down = self.powers[which]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * up[:n], out=sums[1:])
        return mixed((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Least of each k consecutive values, by doubling."""
    step = 1
    out = x
    while 2 * step <= k:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = k - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(hasher: Hasher, codes: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The fingerprint of each window; empty where the text has fewer words than one."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    return sliding_min(hasher.runs(codes, gram, 0), width - gram + 1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, a key that tells rows of one id with different texts apart, and the text's bytes."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("rk"), F.encode(text_col, "UTF-8").alias("text"))


def fingerprints(texts: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(fp, id, rk): the distinct window fingerprints of each row (id, rk, text) that has an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            fps, sizes = [], []
            for t in batch.column(2):
                got = anchors(hasher, hasher.codes(hasher.words(t.as_py())), width, gram)
                got = np.unique(got[np.flatnonzero(np.diff(got, prepend=got[:1] ^ np.uint64(1)))])
                fps.append(got)
                sizes.append(len(got))
            flat = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            for at in range(0, len(flat), 1 << 20):
                own = pa.array(rows[at : at + (1 << 20)])
                yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + (1 << 20)].view(np.int64)), batch.column(0).take(own), batch.column(1).take(own)], names=["fp", "id", "rk"])

    return texts.where("id is not null").select("id", "rk", "text").mapInArrow(run, _PRINTS)


def bucketed(df: DataFrame, tag: str, keys: list[str], n: int, dealt: bool = False) -> tuple[str, DataFrame]:
    """Writes df dealt by keys into n buckets, each sorted; returns its path and what was written.

    dealt: each task's rows belong to one bucket already.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    rows = df if dealt else df.repartition(n, *keys)
    rows.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return path, spark.table(name)


def reopened(spark: SparkSession, path: str, columns: str, keys: list[str], n: int) -> DataFrame:
    """A table that bucketed() wrote in another session."""
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    by = ", ".join(keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


@contextmanager
def _merging(spark: SparkSession) -> Iterator[None]:
    """Buckets of one file each are read in their order, so that joins of runs need no sort."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_RUN, _TEXTS, _PRINTS = "fp BIGINT, n BIGINT", "id BIGINT, rk BIGINT, text BINARY", "fp long, id long, rk long"


class FingerprintIndex:
    """Runs of (fp, n), n: how many documents have a fingerprint, with the documents that were added.

    manifest() is all that another session needs to open the index and add to it.
    """

    def __init__(self, spark: SparkSession, width: int = WIDTH, gram: int = GRAM, manifest: dict | None = None) -> None:
        m = manifest or {"buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "width": width, "gram": gram, "runs": [], "texts": [], "prints": []}
        self.spark, self.buckets, self.width, self.gram = spark, m["buckets"], m["width"], m["gram"]
        self.runs = [(level, path, reopened(spark, path, _RUN, ["fp"], self.buckets)) for level, path in m["runs"]]
        self.texts = [(path, reopened(spark, path, _TEXTS, ["id", "rk"], self.buckets)) for path in m["texts"]]
        self.prints = [(path, spark.read.schema(_PRINTS).parquet(path)) for path in m["prints"]]
        self.compacted = 0

    def manifest(self) -> dict:
        return {"buckets": self.buckets, "width": self.width, "gram": self.gram, "runs": [[level, path] for level, path, _ in self.runs], "texts": [p for p, _ in self.texts], "prints": [p for p, _ in self.prints]}

    def append(self, batch: DataFrame) -> DataFrame:
        """Adds (fp, id, rk) as a run; returns (fp, n): its fingerprints that several documents have by now."""
        path, run = bucketed(batch.groupBy("fp").agg(F.count("*").alias("n")), "run", ["fp"], self.buckets)
        with _merging(self.spark):
            parts = [run.where("n > 1")]
            for _, _, old in self.runs:
                parts.append(run.join(old.withColumnRenamed("n", "m").hint("merge"), "fp").select("fp", (F.col("n") + F.col("m")).alias("n")))
            shared = parts[0]
            for p in parts[1:]:
                shared = shared.union(p)
            # written before compaction may delete the runs that it reads
            shared = stored(shared, "shared")
            self.runs.append((0, path, run))
            self.compact()
        return shared

    def compact(self) -> None:
        """Merges the two latest runs as long as they are of one level."""
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            (level, p1, a), (_, p2, b) = self.runs[-2:]
            both = a.join(b.withColumnRenamed("n", "m").hint("merge"), "fp", "full").select("fp", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
            path, run = bucketed(both, "run", ["fp"], self.buckets, dealt=True)
            for old in (p1, p2):
                _drop(self.spark, old)
            self.runs[-2:] = [(level + 1, path, run)]
            self.compacted += 1

    def add(self, docs: DataFrame, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """(rows of docs, their covered spans with the digests of what covers them).

        Documents enter the index in `batches` batches of ascending id, the last of which
        sees all. Documents of earlier calls own windows, but never lose any.
        """
        point = mark()
        path, texts = bucketed(_keyed(docs, id_col, text_col), "texts", ["id", "rk"], self.buckets)
        made = new_path(self.spark, "prints")
        prints = stored(fingerprints(texts, self.width, self.gram), "prints", made)
        self.texts.append((path, texts))
        self.prints.append((made, prints))
        cuts = prints.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
        bounds = sorted(set(cuts or []))
        shared = None
        for i in range(len(bounds) + 1):
            part = prints
            if i:
                part = part.where(F.col("id") > bounds[i - 1])
            if i < len(bounds):
                part = part.where(F.col("id") <= bounds[i])
            known = self.append(part)
            shared = known if shared is None else shared.union(known)
        shared = stored(shared.groupBy("fp").agg(F.max("n").alias("n")), "shared")
        covered_path, proof_path = new_path(self.spark, "covered"), new_path(self.spark, "proof")
        covered = stored(self._covered(shared), "covered", covered_path)
        wanted = covered.select(F.col("oid").alias("id"), F.col("ork").alias("rk"), "oa", (F.col("b") - F.col("a")).alias("len")).distinct()
        wanted = wanted.groupBy("id", "rk").agg(F.collect_list(F.struct("oa", "len")).alias("asked"))
        proof = None
        for _, t in self.texts:
            part = t.join(wanted, ["id", "rk"]).select("id", "rk", "text", "asked").mapInArrow(_digests, "oid long, ork long, oa int, len int, digest binary")
            proof = part if proof is None else proof.union(part)
        # rows that repeat id and text give equal digests
        proof = stored(proof.groupBy("oid", "ork", "oa", "len").agg(F.min("digest").alias("digest")), "proof", proof_path)
        forget_since(self.spark, point, keep=(path, made, covered_path, proof_path, *(p for _, p, _ in self.runs)))
        own = covered.join(texts.select("id", "rk").distinct(), ["id", "rk"], "left_semi") if len(self.texts) > 1 else covered
        spans = own.withColumn("len", F.col("b") - F.col("a")).join(proof, ["oid", "ork", "oa", "len"], "left").select("id", "rk", "a", "b", "digest")
        return texts, spans

    def _covered(self, shared: DataFrame) -> DataFrame:
        """(id, rk, a, b, oid, ork, oa): stretches [a, b) of words whose windows also start, from word oa on, in the smaller document oid."""
        prints = _united([p for _, p in self.prints])
        salts = F.when(F.col("n") < SALTED, 1).otherwise(F.ceil(F.col("n") / SHARE)).cast("int").alias("salts")
        wanted = prints.join(shared.select("fp", salts), "fp").groupBy("id", "rk").agg(F.collect_list(F.struct("fp", "salts")).alias("fps"))
        rows = _united([t.join(wanted, ["id", "rk"]).select("id", "rk", "text", "fps").mapInArrow(_emit(self.width, self.gram), _OUT) for _, t in self.texts])
        rows = stored(rows, "windows")
        names = ["id", "rk", "a", "b", "oid", "ork", "oa"]
        open_ = rows.where("wins is not null").select(*_OPEN).repartition("fp", "salt").sortWithinPartitions("fp", "salt")
        return rows.where("wins is null").select(*names).union(open_.mapInArrow(_judge(self.width), "id long, rk long, a int, b int, oid long, ork long, oa int"))

    def forget(self) -> None:
        """Deletes runs and fingerprints; results that add() has returned stay readable."""
        for _, path, _ in self.runs:
            _drop(self.spark, path)
        for path, _ in self.prints:
            forget(self.spark, path)
        self.runs, self.prints = [], []


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _drop(spark: SparkSession, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[-1].replace('-', '_')}")
    forget(spark, path)


_OPEN = ["fp", "salt", "id", "rk", "start", "places", "wins"]
_OUT = "fp long, salt int, id long, rk long, start int, places binary, wins binary, a int, b int, oid long, ork long, oa int"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _batch(columns: dict) -> pa.RecordBatch:
    """A batch of _OUT; columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def matched(ids: np.ndarray, rks: np.ndarray, row: np.ndarray, places: np.ndarray, wins: np.ndarray, width: int) -> tuple[np.ndarray, dict]:
    """Which windows an earlier document of these has, and the stretches of words that they cover.

    ids and rks belong to rows; row, places and wins to the windows, which are in order
    within a row. Of equal windows, the first in the least document owns the others.
    """
    order = np.lexsort((ids[row], wins))
    w = wins[order]
    new = np.ones(len(order), bool)
    new[1:] = w[1:] != w[:-1]
    owner = np.empty(len(order), np.int64)
    owner[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = ids[row] > ids[row[owner]]
    # a stretch goes on while both documents go on by one word
    on = np.zeros(len(order), bool)
    if len(order):
        on[1:] = gone[1:] & gone[:-1] & (row[1:] == row[:-1]) & (places[1:] == places[:-1] + 1) & (row[owner[1:]] == row[owner[:-1]]) & (places[owner[1:]] == places[owner[:-1]] + 1)
    at = np.flatnonzero(gone & ~on)
    to = np.flatnonzero(gone & ~np.append(on[1:], False))
    own, by = row[at], owner[at]
    return gone, {"id": ids[own], "rk": rks[own], "a": places[at].astype(np.int32), "b": (places[to] + width).astype(np.int32), "oid": ids[row[by]], "ork": rks[row[by]], "oa": places[by].astype(np.int32)}


def _left(fp: np.ndarray, salts: np.ndarray, ids: np.ndarray, rks: np.ndarray, row: np.ndarray, places: np.ndarray, wins: np.ndarray, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the windows in keep: a stretch each, or for salted fingerprints those of a stretch with one salt."""
    plain = keep & (salts[row] == 1)
    opens, closes = plain.copy(), plain.copy()
    opens[1:] &= ~(plain[:-1] & (row[1:] == row[:-1]))
    closes[:-1] &= ~(plain[1:] & (row[1:] == row[:-1]))
    at, to = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if len(at):
        own, data = row[at], np.ascontiguousarray(wins).tobytes()
        blobs = [data[8 * x : 8 * y] for x, y in zip(at.tolist(), to.tolist(), strict=True)]
        yield _batch({"fp": fp[own], "salt": np.zeros(len(own), np.int32), "id": ids[own], "rk": rks[own], "start": places[at].astype(np.int32), "wins": blobs})
    some = np.flatnonzero(keep & (salts[row] > 1))
    if len(some):
        salt = ((wins[some] >> np.uint64(32)) % salts[row[some]].astype(np.uint64)).astype(np.int32)
        order = np.lexsort((some, salt, row[some]))
        some, salt = some[order], salt[order]
        new = np.ones(len(some), bool)
        new[1:] = (salt[1:] != salt[:-1]) | (row[some[1:]] != row[some[:-1]])
        at = np.flatnonzero(new)
        to = np.append(at[1:], len(some))
        own = row[some[at]]
        where, data = places[some].astype(np.int32).tobytes(), wins[some].tobytes()
        spans = list(zip(at.tolist(), to.tolist(), strict=True))
        yield _batch({"fp": fp[own], "salt": salt[at], "id": ids[own], "rk": rks[own], "start": np.zeros(len(own), np.int32), "places": [where[4 * x : 4 * y] for x, y in spans], "wins": [data[8 * x : 8 * y] for x, y in spans]})


def _emit(width: int, gram: int):
    """Windows under wanted fingerprints, compared with each other within the task.

    Each stretch of windows with one fingerprint is a row, so a passage of very many
    documents leaves a task once, besides the stretches that it covers. What is left of
    a fingerprint of very many documents is dealt into several keys by window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[tuple] = []
        count = 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                fp, salts, ids, rks, starts, sizes, wins = (np.concatenate(x) for x in zip(*held, strict=True))
                row = np.repeat(np.arange(len(sizes)), sizes)
                places = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row] + starts[row]
                gone, spans = matched(ids, rks, row, places, wins, width)
                if len(spans["id"]):
                    yield _batch(spans)
                yield from _left(fp, salts, ids, rks, row, places, wins, ~gone)

        for batch in batches:
            ids, rks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                codes = hasher.codes(hasher.words(batch.column(2)[i].as_py()))
                marks = anchors(hasher, codes, width, gram)
                asked = batch.column(3)[i].values
                wanted = np.asarray(asked.field("fp"), np.int64).view(np.uint64)
                order = np.argsort(wanted)
                wanted, salts = wanted[order], np.asarray(asked.field("salts"), np.int64)[order]
                cuts = np.flatnonzero(np.diff(marks, prepend=marks[:1] ^ np.uint64(1)))
                sizes = np.diff(np.append(cuts, len(marks)))
                own = marks[cuts]
                place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                pick = wanted[place] == own
                if not pick.any():
                    continue
                whole = hasher.runs(codes, width, 1)
                n = int(pick.sum())
                held.append((own[pick].view(np.int64), salts[place[pick]], np.full(n, ids[i]), np.full(n, rks[i]), cuts[pick], sizes[pick], whole[np.repeat(pick, sizes)]))
                count += int(sizes[pick].sum())
                if count > HELD:
                    yield from out()
                    held.clear()
                    count = 0
        yield from out()

    return run


def _judge(width: int):
    """Over rows sorted by fp and salt: stretches of words covered by windows that an earlier document has."""

    def decided(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(tables)
        blobs, where = t.column("wins").to_pylist(), t.column("places").to_pylist()
        sizes = np.fromiter((len(b) // 8 for b in blobs), np.int64, len(blobs))
        row = np.repeat(np.arange(len(sizes)), sizes)
        places = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row] + t.column("start").to_numpy()[row].astype(np.int64)
        salted = np.fromiter((w is not None for w in where), bool, len(where))
        if salted.any():
            places[salted[row]] = np.frombuffer(b"".join(w for w in where if w is not None), np.int32)
        _, spans = matched(t.column("id").to_numpy(), t.column("rk").to_numpy(), row, places, np.frombuffer(b"".join(blobs), np.uint64), width)
        if len(spans["id"]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans.values()], names=list(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = int(np.flatnonzero((fp == fp[-1]) & (salt == salt[-1]))[0])  # where the last key's rows begin
            if cut:
                held.append(batch.slice(0, cut))
                yield from decided(held)
                held = []
            elif held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (int(fp[0]), int(salt[0])):
                yield from decided(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from decided(held)

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch asked of a document: the digest of its words."""
    for batch in batches:
        rows: list[int] = []
        starts, sizes, digests = [], [], []
        for i in range(batch.num_rows):
            words = (batch.column(2)[i].as_py() or b"").split()
            asked = batch.column(3)[i].values
            for a, n in zip(asked.field("oa").to_pylist(), asked.field("len").to_pylist(), strict=True):
                rows.append(i)
                starts.append(a)
                sizes.append(n)
                digests.append(_digest(words[a : a + n]))
        own = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], names=["oid", "ork", "oa", "len", "digest"])


class Unequal(RuntimeError):
    """Two stretches whose hashes agree have different words."""


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept_text, digests = [], [], [], []
        for i in range(batch.num_rows):
            words = (batch.column(2)[i].as_py() or b"").split()
            spans = batch.column(3)[i].values
            if spans is not None and len(spans):
                level = np.zeros(len(words) + 1, np.int64)
                for a, b, digest in zip(spans.field("a").to_pylist(), spans.field("b").to_pylist(), spans.field("digest").to_pylist(), strict=True):
                    if digest != _digest(words[a:b]):
                        raise Unequal(f"words {a} to {b} of document {batch.column(0)[i].as_py()}; another seed of the hashes is needed")
                    level[a] += 1
                    level[b] -= 1
                keep = np.flatnonzero(np.cumsum(level[:-1]) == 0)
                kept = [words[j] for j in keep]
            else:
                kept = words
            text = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            kept_text.append(text if len(kept) < len(words) else None)
            digests.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary()), pa.array(digests, pa.string())], names=["id", "rk", "n_words", "n_removed", "kept", "kept_sha256"])


def added(index: FingerprintIndex, docs: DataFrame, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds docs to an index and returns them as deduplicated() does, also against the documents of earlier calls.

    The result of several calls with ascending ids is that of one call with all documents.
    """
    texts, spans = index.add(docs, batches, id_col, text_col)
    per = spans.groupBy("id", "rk").agg(F.collect_set(F.struct("a", "b", "digest")).alias("spans"))
    return texts.join(per, ["id", "rk"], "left").select("id", "rk", "text", "spans").mapInArrow(_finish, "id long, rk long, n_words long, n_removed long, kept binary, kept_sha256 string")


def deduplicated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rk, n_words, n_removed, kept, kept_sha256), a row for each row of docs.

    kept: UTF-8 bytes of the kept words joined by one space; null where nothing was
    removed. Null and empty texts, and texts below `width` words, lose nothing.
    Rows with a null id lose nothing and own nothing. Rows that repeat an id never
    remove each other's windows. Very long texts are read whole; a task holds the
    hashes of one text and of HELD windows. No rows give no rows.
    """
    index = FingerprintIndex(docs.sparkSession, width, gram)
    out = added(index, docs, batches, id_col, text_col)
    index.forget()
    return out
