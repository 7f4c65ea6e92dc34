"""Packing of token sequences into windows by best-fit decreasing.

Documents are tokenised and cut where they fill whole windows. What is left of
each has one of at most `window` lengths, so the decisions need only the number
of pieces of each length: best fit, longest first, runs on the driver over those
counts, and places runs of equal pieces in runs of equal windows. A segment tree
over remaining capacities finds the tightest open windows. Executors then look
up each piece's place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

WINDOW, END = 4096, 2
#: Words whose ids a worker keeps; when full, it starts anew.
CACHE = 800_000
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class OpenWindows:
    """Runs of open windows by remaining capacity, with a segment tree over the capacities that have any."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.any = np.zeros(2 * self.size, bool)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, capacity: int, there: bool) -> None:
        i = capacity + self.size
        self.any[i] = there
        while i > 1:
            i >>= 1
            there = bool(self.any[2 * i] or self.any[2 * i + 1])
            if self.any[i] == there:
                break
            self.any[i] = there

    def put(self, capacity: int, first: int, n: int) -> None:
        if n and capacity:
            self.runs.setdefault(capacity, []).append((first, n))
            if not self.any[capacity + self.size]:
                self._mark(capacity, True)

    def take(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        if not self.runs[capacity]:
            self._mark(capacity, False)
        return run

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least length that an open window has."""
        i = length + self.size
        if self.any[i]:
            return length
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first window, pieces a window, offset), by length and rank.

    Pieces of that length from that rank on, up to the next row's, go into windows from
    that one on. The result is that of best fit decreasing piece by piece.
    """
    tree, placed, used = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            capacity = tree.tightest(length)
            if capacity is None:  # open as many as the rest needs
                capacity, per = window, window // length
                first, m = used, -(-(n - rank) // per)
                used += m
            else:
                first, m = tree.take(capacity)
                per = capacity // length
            full = min(m, (n - rank) // per)
            rest = min(n - rank - full * per, per - 1) if full < m else 0
            if full:
                placed.append((length, rank, first, per, window - capacity))
                tree.put(capacity - per * length, first, full)
                rank += full * per
            if rest:
                placed.append((length, rank, first + full, rest, window - capacity))
                tree.put(capacity - rest * length, first + full, 1)
                rank += rest
            left = full + bool(rest)
            tree.put(capacity, first + left, m - left)
    return placed


#: Words that need no Unicode normalisation: ASCII and the letters of Latin-1, whose lower case is one letter.
_PLAIN = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: The tokenizer's own split of a lower-case plain word.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def piece_encoder(tokenizer_path: str):
    """A function from a piece's bytes to its ids, or None where the tokenizer isn't of the one kind that this knows.

    That kind is byte-level BPE with a mark at word ends, whose merges are numbered in
    order. The mark becomes a byte that UTF-8 never has; joining it to the last byte is
    the first merge of all, and the other merges follow by rank, so another BPE
    implementation gives the same ids in a tenth of the time.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    model, steps = spec["model"], spec.get("pre_tokenizer") or {}
    split = [x.get("pattern", {}).get("Regex") for x in steps.get("pretokenizers", [])]
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or split[:1] != [_SPLIT] or kinds != ["NFC", "Replace", "Lowercase"]:
        return None
    vocabulary = model["vocab"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    if any(vocabulary[a + b] != 512 + i for i, (a, b) in enumerate(pairs)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {}
    for token, i in vocabulary.items():
        if token not in special:
            stem = token.removesuffix("</w>")
            ranks[bytes(byte[c] for c in stem) + b"\xff" * (stem != token)] = i
    import tiktoken

    return tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


#: Plain words of all kinds, by which piece_encoder is compared with the tokenizer in each task.
PROBE = "the Quick brown-fox jumped over 1234 lazy dogs' I'm they'll x=y+z; http://example.org/a_b?c=1 na\xefve CAF\xc9 \xfcber antidisestablishmentarianism zzyzx q aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa ~~~ ... #$%&@ f(x) 3.14e-10 \x7f\x01".split()


def _by_pieces(encode_piece, word: str) -> list[int]:
    s = word.lower()
    ids: list[int] = []
    for piece in (s,) if s.isascii() and s.isalpha() else _PIECES.findall(s):
        ids += encode_piece(piece.encode() + b"\xff")
    return ids


def word_ids(tokenizer_path: str):
    """A function from a text's bytes to the little-endian 32-bit ids of its words.

    The tokenizer never joins across white space, so each word is encoded by itself and
    kept. Plain words go piece by piece through piece_encoder, as long as that agrees with
    the tokenizer on PROBE, the rest through the tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    encode_piece = piece_encoder(tokenizer_path)
    if encode_piece is not None and any(_by_pieces(encode_piece, w) != tokenizer.encode(w, add_special_tokens=False).ids for w in PROBE):
        encode_piece = None  # either library does otherwise by now: the tokenizer has the word
    known: dict[bytes, bytes] = {}

    def learn(words: list[bytes]) -> None:
        rest = []
        for w in words:
            s = w.decode()
            if encode_piece is None or b"<|" in w or not _PLAIN.fullmatch(s):
                rest.append(w)
                continue
            ids = _by_pieces(encode_piece, s)
            known[w] = array("I", ids).tobytes() if _LITTLE else np.asarray(ids, "<u4").tobytes()
        for w, e in zip(rest, tokenizer.encode_batch([w.decode() for w in rest], add_special_tokens=False), strict=True):
            known[w] = np.asarray(e.ids, "<u4").tobytes()

    def encode(text: bytes) -> bytes:
        words = text.split()
        new = {w for w in words if w not in known}
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = set(words)
            learn(list(new))
        return b"".join([known[w] for w in words])

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids cut into full windows and a rest."""
    tail = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path)
        for batch in batches:
            row, starts, lengths, crcs, totals = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = encode(t.as_py() or b"") + tail
                n = len(ids) // 4
                for a in range(0, n, window):
                    row.append(i)
                    starts.append(a)
                    lengths.append(min(window, n - a))
                    crcs.append(zlib.crc32(ids[4 * a : 4 * (a + window)]))
                    totals.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_col, "UTF-8").alias("text")).mapInArrow(run, PIECE)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted rows: the partition, and a piece's rank in it among those of its length."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        length = batch.column(batch.schema.get_field_index("length")).to_numpy()
        new = np.flatnonzero(np.diff(length, prepend=length[0] - 1))
        first = np.repeat(new, np.diff(np.append(new, len(length))))
        local = np.arange(len(length)) - first
        if length[0] == last:
            local[: new[1] if len(new) > 1 else len(length)] += seen
        last, seen = length[-1], int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part), pa.int32()), pa.array(local, pa.int64())], names=[*batch.schema.names, "part", "local"])


def packed(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with sequence_id and offset, a row for each piece of each row of docs.

    Null and empty texts are one piece of the end id. Rows with null ids and repeated
    rows are packed like others. Sequence ids count from 0; offsets have no gaps. The
    driver gets one row for each length and for each pair of partition and length that
    occurs; the ranges make those at most `window` rows more than there are partitions.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, window, end, id_col, text_col), "pieces")
    order = ["length", "doc_id", "start", "ids_crc32", "doc_tokens"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = cut.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_ranked, PIECE + ", part int, local long")
    ranked = stored(ranked, "ranked")
    shares = sorted(tuple(r) for r in ranked.groupBy("length", "part").agg(F.count("*")).collect())
    counts: dict[int, int] = {}
    bases: dict[tuple[int, int], int] = {}
    for length, part, k in shares:
        bases[length, part] = counts.get(length, 0)
        counts[length] = bases[length, part] + k
    places = sorted(best_fit(counts, window))
    table = spark.sparkContext.broadcast((bases, np.array(places, np.int64).reshape(-1, 5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, places = table.value
        keys = places[:, 0] << 44 | places[:, 1]
        for batch in batches:
            length, part, local = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 5, 6))
            pair, at = np.unique(length << 32 | part, return_inverse=True)
            rank = local + np.array([bases[int(x) >> 32, int(x) & 0xFFFFFFFF] for x in pair], np.int64)[at]
            p = places[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(length) else places[:0]
            i = rank - p[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(p[:, 2] + i // p[:, 3]), pa.array(p[:, 4] + i % p[:, 3] * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECE + ", sequence_id long, offset long")
