"""Language-model scores by prediction by partial matching over bytes.

The trie holds contexts of up to DEPTH - 1 bytes. A byte not seen in a context
escapes to the next shorter one, with PPM method C's estimate, and the bytes
seen in the longer context are excluded there. The trie is trained beforehand,
on all training documents, so every probability is a function of the last DEPTH
bytes, and is worked out once for each distinct run of bytes.

The trie keeps every node and is never in one place. Levels 0 to BELOW - 1 are
broadcast: the alphabet bounds them, to 2^24 nodes of three bytes, whatever the
size of the corpus. All longer contexts with the same last BELOW bytes and their
nodes need only each other and those levels, so they are dealt out by these bytes.
Each partition of documents asks for its distinct grams once, in blobs, and gets
their probabilities back.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

DEPTH = 6
#: Levels that are broadcast, and the bytes at the end of a context that deal out the others.
BELOW = 3
#: Bytes of text that a partition of documents has at most, about.
PART = 1 << 24
#: Bytes that UTF-8 never has: before a text, and after it. 256 byte values and the end can be predicted.
START, STOP = b"\xfe", b"\xff"
SYMBOLS = 257
#: Bytes of text handled at once.
CHUNK = 1 << 20


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The DEPTH bytes that end at each byte or end to predict, as one number; how many each text has."""
    pad = START * (DEPTH - 1)
    flat = np.frombuffer(b"".join(x for t in texts for x in (pad, t, STOP)) + b"\0" * 8, np.uint8)
    n = len(flat) - 8
    every = np.ndarray((n,), ">u8", flat.data, 0, (1,)).astype(np.uint64) >> np.uint64(64 - 8 * DEPTH)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    keep = np.ones(n, bool)
    ends = np.cumsum(sizes + DEPTH - 1)
    for k in range(1, DEPTH):
        keep[ends - k] = False
    return every[keep], sizes


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n): the last BELOW bytes of the grams of a partition's texts, each once."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        texts = [(t.as_py() or b"").lower() for t in batch.column(0)]
        for some in chunks(texts):
            low = (grams(some)[0] & np.uint64((1 << 8 * BELOW) - 1)).astype(np.uint32)
            k, c = np.unique(low, return_counts=True)
            keys, counts = _summed(np.concatenate([keys, k.astype(np.uint64)]), np.concatenate([counts, c]))
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["g", "n"])


def _ask(buckets: int):
    """(bucket, chunk, data): the distinct grams of a partition and their counts in training texts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, pending, size = None, [], 0
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            bucket = _bucket(keys, buckets)
            order = np.lexsort((_turned(keys), bucket))
            k, c, bucket = keys[order], counts[order], bucket[order]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*first[1:].tolist(), len(k)]
            for at in range(0, len(first), 1000):
                data = [_packed(k[i:j], c[i:j]) for i, j in zip(first[at : at + 1000].tolist(), ends[at : at + 1000], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first[at : at + 1000]], pa.int32()), pa.array([chunk] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "chunk", "data"])

        for batch in batches:
            if batch.num_rows and chunk is None:
                chunk = batch.column(0)[0].as_py()
            texts = [(t or b"").lower() for t in batch.column(1).to_pylist()]
            held = batch.column(2).to_pylist()
            for side in (False, True):
                for some in chunks([t for t, h in zip(texts, held, strict=True) if h is side]):
                    k, c = np.unique(grams(some)[0], return_counts=True)
                    pending.append((k, np.zeros(len(k), np.int64) if side else c))
                    size += len(k)
                    if size > max(1 << 19, len(keys)):
                        keys, counts = _summed(*map(np.concatenate, zip((keys, counts), *pending, strict=True)))
                        pending, size = [], 0
                        if len(keys) > 1 << 21:
                            yield from out()
                            keys, counts = keys[:0], counts[:0]
        if pending:
            keys, counts = _summed(*map(np.concatenate, zip((keys, counts), *pending, strict=True)))
        if len(keys):
            yield from out()

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where a gram belongs, by the last BELOW bytes of its context."""
    end = (keys >> np.uint64(8)) & np.uint64((1 << 8 * BELOW) - 1)
    return ((end * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _turned(keys: np.ndarray) -> np.ndarray:
    """Grams with the last BELOW bytes of the context in front, so that the order is that of the context's end."""
    end = (keys >> np.uint64(8)) & np.uint64((1 << 8 * BELOW) - 1)
    return (end << np.uint64(24)) | ((keys >> np.uint64(32)) << np.uint64(8)) | (keys & np.uint64(255))


def _packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Grams in the order of _turned and 8 bytes for each: differences by byte, then the values, compressed."""
    steps = np.diff(_turned(keys), prepend=np.uint64(0))
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes() + values.tobytes(), 6)


def _unpacked(data: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 16
    q = np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    keys = (((q >> np.uint64(8)) & np.uint64(0xFFFF)) << np.uint64(32)) | ((q >> np.uint64(24)) << np.uint64(8)) | (q & np.uint64(255))
    return keys, np.frombuffer(raw, kind, n, 8 * n)


def _answer(low):
    """(chunk, data): the grams of each blob with the log10 of their probabilities. A partition has whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, keys, counts = [], [], []
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, c = _unpacked(data, np.int64)
                asked.append((chunk, len(k)))
                keys.append(k)
                counts.append(c)
        if not asked:
            return
        every = np.concatenate(keys)
        g, back = np.unique(every, return_inverse=True)
        n = np.zeros(len(g), np.int64)
        np.add.at(n, back, np.concatenate(counts))
        values = Trie.build([*low.value, *levels(g[n > 0], n[n > 0], range(BELOW, DEPTH))]).log10(g)[back]
        at = 0
        for start in range(0, len(asked), 1000):
            some, rows = asked[start : start + 1000], []
            for _, size in some:
                rows.append(_packed(every[at : at + size], values[at : at + size]))
                at += size
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], pa.int32()), pa.array(rows, pa.binary())], names=["chunk", "data"])

    return run


def levels(g: np.ndarray, n: np.ndarray, orders: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """The nodes of these orders and their counts, from distinct grams with counts."""
    return [_summed(g & np.uint64((1 << 8 * (k + 1)) - 1), n) for k in orders]


@dataclass
class Trie:
    """For each order: contexts (sorted) with what their escapes and denominators are, and nodes with counts."""

    nodes: list[np.ndarray] = field(default_factory=list)  # context and byte
    log_n: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    log_total: list[np.ndarray] = field(default_factory=list)  # of the context itself
    log_escape: list[np.ndarray] = field(default_factory=list)  # from the context itself
    log_below: list[np.ndarray] = field(default_factory=list)  # denominator of the next shorter one, without this one's bytes
    path: list[np.ndarray] = field(default_factory=list)  # escapes of all shorter ones, each without the bytes of the next longer
    floor: float = -math.log10(SYMBOLS)
    table: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def build(cls, levels: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
        """levels[k]: nodes of contexts of k bytes (last k + 1 bytes of a gram) and their counts, sorted by node."""
        t = cls()
        last = None
        for k, (nodes, counts) in enumerate(levels):
            context, first, size = np.unique(nodes >> np.uint64(8), return_index=True, return_counts=True)
            n = counts.astype(float)
            kept = np.add.reduceat(n, first) if len(first) else n
            lost = np.zeros(len(context))
            if k:  # a context's own count: that of the node which it is one level up
                up, n_up = levels[k - 1]
                i, there = _find(up, context)
                lost = np.maximum(0.0, np.where(there, n_up[i] if len(up) else 0, 0) - kept)
            escapes = size + lost
            t.nodes.append(nodes)
            t.log_n.append(np.log10(n))
            t.contexts.append(context)
            t.log_total.append(np.log10(kept + escapes))
            t.log_escape.append(np.log10(escapes / (kept + escapes)))
            if not k:
                t.log_below.append(np.zeros(len(context)))
                t.path.append(np.zeros(len(context)))
                if len(size):
                    t.floor = -math.log10(max(1, SYMBOLS - int(size[0])))
            else:
                mask = np.uint64((1 << 8 * k) - 1)
                shorter, _ = _find(last["context"], context & (mask >> np.uint64(8)))
                i, there = _find(last["nodes"], nodes & mask)
                excluded = np.add.reduceat(np.where(there, last["n"][i], 0.0), first) if len(first) else n
                seen = np.add.reduceat(there.astype(float), first) if len(first) else n
                left = np.maximum(0.0, last["kept"][shorter] - excluded)
                more = np.maximum(0.0, last["size"][shorter] - seen) + last["lost"][shorter]
                dead = left <= 0  # all that the shorter one knows is excluded: it is passed for nothing
                more = np.where(more <= 0, 1.0, more)
                t.log_below.append(np.log10(np.where(dead, 1.0, left + more)))
                own = np.where(dead, 0.0, np.log10(more / (left + more)))
                t.path.append(own + t.path[k - 1][shorter])
            last = {"context": context, "nodes": nodes, "n": n, "kept": kept, "size": size.astype(float), "lost": lost}
        if levels and len(levels[-1][0]):
            k = len(levels) - 1
            i, _ = _find(t.contexts[k], t.nodes[k] >> np.uint64(8))
            t.table = _hashed(t.nodes[k], (t.log_n[k] - t.log_total[k][i]).astype(np.float64))
        return t

    def slow(self, g: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte, by walking down from its longest context."""
        out = np.full(len(g), np.nan)
        top = np.full(len(g), -1)
        at: list[np.ndarray] = []
        for k in range(len(self.nodes)):
            i, there = _find(self.contexts[k], (g >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1))
            at.append(i)
            top[there] = k
        for k in range(len(self.nodes) - 1, -1, -1):
            j, there = _find(self.nodes[k], g & np.uint64((1 << 8 * (k + 1)) - 1))
            there &= np.isnan(out) & (top >= k)
            for m in range(k, len(self.nodes)):
                here = np.flatnonzero(there & (top == m))
                if not len(here):
                    continue
                n = self.log_n[k][j[here]]
                if m == k:
                    out[here] = n - self.log_total[k][at[k][here]]
                else:
                    longer = at[k + 1][here]
                    out[here] = self.log_escape[m][at[m][here]] + self.path[m][at[m][here]] - self.path[k + 1][longer] + n - self.log_below[k + 1][longer]
        for m in range(len(self.nodes)):
            here = np.flatnonzero(np.isnan(out) & (top == m))
            if len(here):
                out[here] = self.log_escape[m][at[m][here]] + self.path[m][at[m][here]] + self.floor
        out[np.isnan(out)] = -math.log10(SYMBOLS)
        return out

    def log10(self, g: np.ndarray) -> np.ndarray:
        if self.table is None:
            return self.slow(g)
        keys, values = self.table
        mask = len(keys) - 1
        shift = np.uint64(64 - mask.bit_length())
        i = ((g * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        out = values[i]
        rest = np.flatnonzero(keys[i] != g)
        i = i[rest]
        missed = []
        while len(rest):
            free = keys[i] == _FREE
            missed.append(rest[free])
            rest, i = rest[~free], (i[~free] + 1) & mask
            hit = keys[i] == g[rest]
            out[rest[hit]] = values[i[hit]]
            rest, i = rest[~hit], i[~hit]
        if missed and len(m := np.concatenate(missed)):
            some, back = np.unique(g[m], return_inverse=True)
            out[m] = self.slow(some)[back]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        parts = []
        for some in chunks(texts):
            g, sizes = grams(some)
            parts.append(np.add.reduceat(self.log10(g), np.cumsum(sizes) - sizes))
        return np.concatenate(parts) if parts else np.zeros(0)


_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _find(within: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(within):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(within, keys), len(within) - 1)
    return i, within[i] == keys


def _hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open-addressing table at most a quarter full."""
    bits = max(4, (4 * len(keys) - 1).bit_length())
    mask = (1 << bits) - 1
    slot, held = np.full(1 << bits, _FREE, np.uint64), np.zeros(1 << bits)
    i = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    rest = np.arange(len(keys))
    while len(rest):
        free = slot[i] == _FREE
        place, who = np.unique(i[free], return_index=True)
        own = rest[free][who]
        slot[place], held[place] = keys[own], values[own]
        again = np.ones(len(rest), bool)
        again[np.flatnonzero(free)[who]] = False
        rest, i = rest[again], i[again]
        i = np.where(slot[i] == _FREE, i, (i + 1) & mask)
    return slot, held


class Asked(Trie):
    """Only the probabilities that a partition asked for."""

    def slow(self, g: np.ndarray) -> np.ndarray:
        raise LookupError(f"{len(g)} grams were not asked for")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, h, n): each word of the partition with its count in training texts; chunk leads back to the partition."""
    chunk, seen = None, Counter()

    def out() -> pa.RecordBatch:
        h = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk), pa.int32()), pa.array(h), pa.array(np.fromiter(seen.values(), np.int64, len(h)))], names=["chunk", "h", "n"])

    for batch in batches:
        for c, text, held in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            chunk = c.as_py() if chunk is None else chunk
            words = (text.as_py() or b"").lower().split()
            if held.as_py():
                for w in words:
                    if w not in seen:
                        seen[w] = 0
            else:
                seen.update(words)
            if len(seen) > 400_000:
                yield out()
                seen.clear()
    if seen:
        yield out()


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, counts, owned = [], [], 0
    ready = model = None
    keys, values = [np.zeros(0, np.uint64)], [np.zeros(0)]
    known: dict[bytes, int] = {}
    for batch in batches:
        kind = batch.column(0).to_numpy()
        n_terms = int((kind == 0).sum())  # terms come first
        if n_terms:
            hashes.append(batch.column(2).slice(0, n_terms).to_numpy(zero_copy_only=False).astype(np.int64))
            counts.append(batch.column(3).slice(0, n_terms).to_numpy(zero_copy_only=False).astype(np.int64))
            owned += sum(batch.column(4).slice(0, n_terms).to_pylist())
        n_grams = int((kind == 1).sum())  # then grams
        for data in batch.column(7).slice(n_terms, n_grams).to_pylist():
            k, v = _unpacked(data, np.float64)
            keys.append(k)
            values.append(v)
        docs = batch.slice(n_terms + n_grams)
        if not docs.num_rows:
            continue
        if ready is None:
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            order = np.argsort(h)
            ready = (h[order], (np.concatenate(counts) if counts else h)[order])
            every, first = np.unique(np.concatenate(keys), return_index=True)
            model = Asked(table=_hashed(every, np.concatenate(values)[first]))
            hashes = counts = keys = values = None
        texts = [(t or b"").lower() for t in docs.column(7).to_pylist()]
        n_tokens, n_known, sums = [], [], []
        for t in texts:
            words = t.split()
            new = list({w for w in words if w not in known})
            if new:
                if len(known) + len(new) > 500_000:
                    known.clear()
                    new = list(set(words))
                h = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new)).view(np.int64)
                i, there = _find(ready[0], h)
                known.update(zip(new, np.where(there, ready[1][i] if len(ready[1]) else 0, 0).tolist(), strict=True))
            c = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            n_tokens.append(len(words) + 1)
            n_known.append(int((c > 0).sum()))
            sums.append(float(np.log10(c + 0.5).sum()))
        n = docs.num_rows
        yield pa.RecordBatch.from_arrays([docs.column(5), docs.column(6), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(model.scores(texts)), pa.array([owned] + [0] * (n - 1), pa.int64())], names=["doc_id", "held_out", "n_tokens", "n_known", "word_sum", "score", "owned"])
        owned = 0


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Null and empty texts have one token, the end. A row with a null id is a training
    row; repeated rows count as often as they stand there. Without training rows the
    model is uniform over bytes and the base knows no word. No rows give no rows.

    The base joins words with their counts over the whole corpus: each partition of
    documents asks for its distinct words once, by a 64-bit hash, and gets their counts
    back. Grams and their probabilities go the same way. None of them is gathered in one
    place.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    trained = own.where("not held_out").select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    low = trained.mapInArrow(count_low, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    low = _summed(low.column("g").to_numpy().astype(np.uint64), low.column("n").to_numpy())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(int(low[1].sum()) / PART))
    low = spark.sparkContext.broadcast(levels(*low, range(BELOW)))
    dealt = own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(16 * n)).cast("int").alias("chunk"), F.encode("text", "UTF-8").alias("text"), "held_out", "doc_id")
    parts = dealt.select("chunk", "text", "held_out").repartition(n, "chunk")
    terms = parts.mapInArrow(_vocabulary, "chunk int, h long, n long")
    counted = terms.groupBy("h").agg(F.sum("n").alias("c"), F.collect_set("chunk").alias("chunks"))
    back = counted.select("h", "c", F.posexplode("chunks").alias("p", "chunk"))
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in "h long, c long, own boolean, doc_id long, held_out boolean, text binary".split(", "))}
    back = back.select(F.lit(0).alias("kind"), "chunk", "h", "c", ((F.col("p") == 0) & (F.col("c") > 0)).alias("own"), none["doc_id"], none["held_out"], none["text"])
    blobs = parts.mapInArrow(_ask(4 * n), "bucket int, chunk int, data binary").repartition(n, "bucket").select("chunk", "data")
    known = blobs.mapInArrow(_answer(low), "chunk int, data binary")
    known = known.select(F.lit(1).alias("kind"), "chunk", none["h"], none["c"], none["own"], none["doc_id"], none["held_out"], F.col("data").alias("text"))
    asked = dealt.select(F.lit(2).alias("kind"), "chunk", none["h"], none["c"], none["own"], "doc_id", "held_out", "text")
    both = back.union(known).union(asked).repartition(n, "chunk").sortWithinPartitions("kind")
    rows = both.mapInArrow(_score, "doc_id long, held_out boolean, n_tokens long, n_known long, word_sum double, score double, owned long")
    rows = stored(rows, "scores")
    tokens, ends, words = rows.agg(F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("held_out"), 1)), F.lit(0)), F.coalesce(F.sum("owned"), F.lit(0))).first()
    under = math.log10(tokens + 0.5 * (words + (ends > 0) + 1)) if tokens else math.log10(0.5)
    base = F.col("word_sum") + math.log10(ends + 0.5) - F.col("n_tokens") * F.lit(under)
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
