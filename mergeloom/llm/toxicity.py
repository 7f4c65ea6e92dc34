"""Toxicity by a gap-weighted subsequence kernel, Nyström landmarks and a linear SVM.

Two strings are similar by the subsequences of three letters that they share,
each weighted down with every letter it spans, so an insult with inserted or
missing characters stays near the insult. A sentence's kernel with a landmark is
the largest over its words (and over letters spelled out one by one). Landmarks
come from labelled documents: words of many toxic documents, near copies counted
once, and hardly of others, and the harmless words nearest to them.
The SVM is trained on sentences: all of a harmless document, and of a toxic
document those that look toxic, at least one, chosen anew in each round. A logistic
curve over a document's two most toxic sentences gives its score.

The classifier learns from at most `max_docs` toxic and twice as many other labelled
documents, with at most `max_bytes` of text, taken in the order of a hash of their
id; both bounds are parameters. The largest value over a sentence's words is a feature
made of kernel values, not a kernel between sentences itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER, DECAY = 3, 0.6
#: Kernel values below this count as 0, and so do those of words with under SHARED of a landmark's letter pairs.
LEAST, SHARED, REACH = 0.25, 0.6, 2
#: Letters of a word compared at once; longer words are cut into overlapping stretches.
LONGEST = 24
#: Words whose kernel values a worker keeps; when full, it starts anew.
CACHE = 400_000
#: Bytes of text that the training sample has at most, a third of them for toxic documents.
MAX_BYTES = 48 << 20
#: Digits and signs that stand for letters.
LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Codes of the places before and after a word; letters outside a-z share the codes above.
FIRST, LAST = 27, 28
_CODE = np.zeros(256, np.uint8)
for _i in range(26):
    _CODE[97 + _i] = _CODE[65 + _i] = _i + 1
for _a, _b in LOOKS.items():
    _CODE[ord(_a)] = ord(_b) - 96
_EDGE = bytes(c for c in range(128) if not chr(c).isalnum())


def letters(word: bytes) -> bytes:
    """Codes of the word's letters in lower case; signs are left out. Empty for a word without letters."""
    word = word.strip(_EDGE)
    if word.isalpha() and word.isascii():
        return _CODE[np.frombuffer(word, np.uint8)].tobytes()
    return bytes(_CODE[ord(c)] if ord(c) < 128 else 29 + ord(c) % 227 for c in word.decode("utf-8", "replace").lower() if (_CODE[ord(c)] if ord(c) < 128 else c.isalpha()))


def bounded(codes: bytes) -> bytes:
    """A word with its ends as letters, so that a stem differs from what it begins."""
    return bytes((FIRST,)) + codes + bytes((LAST,)) if codes else codes


def _padded(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(length, b"\0") for w in words), np.uint8).reshape(len(words), length)


def kernel(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The gap-weighted count of common subsequences of ORDER letters of a[i] and b[i]."""
    out = np.zeros(len(a))
    for at in range(0, len(a), 20_000):
        x, y = a[at : at + 20_000], b[at : at + 20_000]
        la, lb = max(map(len, x), default=0), max(map(len, y), default=0)
        xs, ys = _padded(x, la).T, _padded(y, lb).T
        n = len(x)
        # before[j]: K' of the order below for the first i letters of x and the first j of y
        before = np.ones((la + 1, lb + 1, n))
        total = np.zeros(n)
        for k in range(1, ORDER + 1):
            now = np.zeros((la + 1, lb + 1, n)) if k < ORDER else None
            for i in range(1, la + 1):
                run = np.zeros(n)
                for j in range(1, lb + 1):
                    same = (xs[i - 1] == ys[j - 1]) & (xs[i - 1] > 0)
                    hit = np.where(same, before[i - 1, j - 1] * (DECAY * DECAY), 0.0)
                    if k == ORDER:
                        total += hit
                    else:
                        run = DECAY * run + hit
                        now[i, j] = DECAY * now[i - 1, j] + run
            before = now
        out[at : at + n] = total
    return out


def _pairs(words: list[bytes], reach: int) -> np.ndarray:
    """A 256-bit set for each word: its ordered pairs of letters at most reach apart."""
    out = np.zeros((len(words), 4), np.uint64)
    full = [i for i, w in enumerate(words) if len(w) > 1]
    if not full:
        return out
    flat = np.frombuffer(b"".join(words[i] for i in full), np.uint8).astype(np.int64)
    sizes = np.array([len(words[i]) for i in full], np.int64)
    starts, word = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(full)), sizes)
    sets = np.zeros((len(full), 4), np.uint64)
    for d in range(1, reach + 1):
        inside = np.zeros(len(flat), bool)
        inside[: len(flat) - d] = word[d:] == word[:-d]
        code = np.zeros(len(flat), np.int64)
        code[: len(flat) - d] = (flat[:-d] * 256 + flat[d:]) * 40503 >> 4 & 255
        bit = np.where(inside, np.uint64(1) << (code & 63).astype(np.uint64), np.uint64(0))
        for lane in range(4):
            sets[:, lane] |= np.bitwise_or.reduceat(np.where(code >> 6 == lane, bit, np.uint64(0)), starts)
    out[full] = sets
    return out


class Landmarks:
    """Normalised kernel values of words with a list of landmarks.

    A word's value is 0 unless it has most neighbouring letter pairs of the landmark in
    order, at most REACH apart.
    """

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.pairs = _pairs(words, 1)
        self.need = np.ceil(SHARED * np.bitwise_count(self.pairs).sum(1)).astype(int)
        self.own = np.sqrt(np.maximum(kernel(words, words), 1e-300))

    def values(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        parts, row = [], []
        for i, w in enumerate(words):
            for a in range(0, max(1, len(w) - LONGEST // 2), LONGEST // 2):
                parts.append(w[a : a + LONGEST])
                row.append(i)
        if not parts or not self.words:
            return out
        sets = _pairs(parts, REACH)
        near = [np.flatnonzero(np.bitwise_count(sets & own).sum(1) >= need) for own, need in zip(self.pairs, self.need, strict=True)]
        p, z = np.concatenate(near), np.repeat(np.arange(len(near)), [len(k) for k in near])
        if not len(p):
            return out
        need = np.unique(p)
        own = np.zeros(len(parts))
        some = [parts[i] for i in need]
        own[need] = np.sqrt(np.maximum(kernel(some, some), 1e-300))
        got = kernel([parts[i] for i in p], [self.words[j] for j in z]) / (own[p] * self.own[z])
        got[got < LEAST] = 0
        np.maximum.at(out, (np.asarray(row)[p], z), got)
        return out


@dataclass
class Model:
    landmarks: list[bytes]
    alpha: np.ndarray
    bias: float
    curve: np.ndarray

    def probability(self, bags: list[np.ndarray]) -> np.ndarray:
        seen = np.array([evidence(b, self.alpha, self.bias) for b in bags]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(seen @ self.curve, -30, 30)))


class Reader:
    """Turns texts into the kernel vectors of the sentences that have any; words are kept between texts."""

    def __init__(self, landmarks: list[bytes]) -> None:
        self.marks = Landmarks(landmarks)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        # kinds of word: 1 ends a sentence, 2 is a single letter; vectors: 0 is the zero vector
        self.kind: list[int] = []
        self.vector: list[int] = []
        self.table = [np.zeros(len(self.marks.words), np.float32)]

    def _learn(self, new: list[bytes]) -> None:
        codes = [letters(w) for w in new]
        values = self.marks.values([bounded(c) for c in codes])
        some = values.any(axis=1)
        for w, c, v, there in zip(new, codes, values, some, strict=True):
            self.known[w] = len(self.kind)
            self.kind.append((w.rstrip(b"\"')*]%&$#|")[-1:] in (b".", b"!", b"?")) | 2 * (len(c) == 1))
            self.vector.append(len(self.table) if there else 0)
            if there:
                self.table.append(v)

    def batch(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """For each text: the vectors of its sentences that have a non-zero one."""
        words = [t.split() for t in texts]
        new = list({w for ws in words for w in ws if w not in self.known})
        if new:
            if len(self.known) + len(new) > CACHE:
                self.forget()
                new = list({w for ws in words for w in ws})
            self._learn(new)
        kind, vector, table = np.array(self.kind, np.uint8), np.array(self.vector, np.int32), np.array(self.table)
        zero = np.zeros((0, table.shape[1]), np.float32)
        for ws in words:
            ids = np.fromiter(map(self.known.__getitem__, ws), np.int32, len(ws))
            if not len(ids):
                yield zero
                continue
            v = vector[ids]
            at = np.flatnonzero(v)
            rows = table[v[at]]
            single = np.flatnonzero(kind[ids] & 2)
            if len(single) > 2:
                runs = np.split(single, np.flatnonzero(np.diff(single) > 1) + 1)
                spelled = [r for r in runs if len(r) > 2]
                if spelled:
                    more = self.marks.values([bounded(b"".join(letters(ws[i]) for i in r)) for r in spelled])
                    at, rows = np.concatenate([at, [r[0] for r in spelled]]), np.concatenate([rows, more])
            if not len(at):
                yield zero
                continue
            ends = np.flatnonzero(kind[ids] & 1)
            sentence, back = np.unique(np.searchsorted(ends, at), return_inverse=True)
            out = np.zeros((len(sentence), rows.shape[1]), np.float32)
            np.maximum.at(out, back, rows)
            yield out


def _families(texts: list[bytes]) -> list[int]:
    """A number for each text; near copies, which share two of their twelve least shingle hashes, have the same."""
    up = list(range(len(texts)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first: dict[tuple[int, int], int] = {}
    for i, t in enumerate(texts):
        ws = t.split()
        least = sorted({zlib.crc32(b" ".join(ws[k : k + 4])) for k in range(max(1, len(ws) - 3))})[:12]
        for k, a in enumerate(least):
            for b in least[k + 1 :]:
                j = first.setdefault((a, b), i)
                if root(j) != root(i):
                    up[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def _pick(texts: list[bytes], toxic: np.ndarray, most: int = 200) -> tuple[list[bytes], list[bytes]]:
    """Positive landmarks, and harmless words to choose the others from. Near copies count once."""
    family = _families(texts)
    counts: list[dict[bytes, set]] = [{}, {}]
    for text, y, f in zip(texts, toxic, family, strict=True):
        for w in set(map(letters, set(text.split()))):
            counts[y].setdefault(w, set()).add(f)
    n1 = max(1, len({f for f, y in zip(family, toxic, strict=True) if y}))
    n0 = max(1, len({f for f, y in zip(family, toxic, strict=True) if not y}))
    ranked = []
    for w, fs in counts[1].items():
        k1, k0 = len(fs), len(counts[0].get(w, ()))
        lift = (k1 / n1) / ((k0 + 0.5) / n0)
        if 4 <= len(w) <= LONGEST - 2 and k1 >= max(4, 0.004 * n1) and lift >= 8:
            ranked.append((-k1, w))
    good = [bounded(w) for _, w in sorted(ranked)[:most]]
    chosen = set(good)
    harmless = [bounded(w) for w, fs in sorted(counts[0].items(), key=lambda x: (-len(x[1]), x[0])) if bounded(w) not in chosen and len(w) >= 4][:20_000]
    return good, harmless


def spread(words: list[bytes], most: float = 0.72) -> list[bytes]:
    """Those of words, in order, that are not nearer than most to an earlier one."""
    near = Landmarks(words).values(words)
    chosen: list[int] = []
    for i in range(len(words)):
        if not chosen or near[i, chosen].max() <= most:
            chosen.append(i)
    return [words[i] for i in chosen]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss by Newton steps over the examples inside the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep = np.eye(z.shape[1]) * ridge * weight.sum()
    keep[-1, -1] *= 1e-3
    for _ in range(steps):
        inside = y * (z @ w) < 1
        zi, wi = z[inside], weight[inside]
        new = np.linalg.solve(keep + (zi * wi[:, None]).T @ zi, (zi * wi[:, None]).T @ y[inside])
        done = np.abs(new - w).max() < 1e-9
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def train(texts: list[bytes], toxic: list[int], prior: float | None = None, most: int = 48, others: int = 48, rounds: int = 3) -> Model:
    """Fits the model; prior: the share of toxic documents where the sample doesn't have it."""
    y = np.asarray(toxic, np.int64)
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    prior = n1 / (n1 + n0) if prior is None else prior
    good, harmless = _pick(texts, y)
    base = float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    if not good:
        return Model([], np.zeros(0), -1.0, np.array([0.0, 0.0, base]))
    good = spread(good)[:most]
    near = Landmarks(good).values(harmless)
    # the harmless words nearest to each
    nearest = [int(i) for j in np.argsort(-near, axis=0, kind="stable")[:2] for i in j if near[i].max() > 0.4] if len(harmless) else []
    hard = spread([harmless[i] for i in dict.fromkeys(nearest)])[:others]
    marks = good + hard
    k = Landmarks(marks).values(marks).astype(float)
    k = (k + k.T) / 2
    value, vector = np.linalg.eigh(k)
    root = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T  # K^(-1/2), small values raised
    reader = Reader(marks)
    bags = [b for a in range(0, len(texts), 500) for b in reader.batch(texts[a : a + 500])]
    w, bias = None, 0.0
    for _ in range(rounds):
        rows, ys, weights = [np.zeros((1, len(marks)))], [-1.0], [float(n0)]  # a sentence without any likeness is harmless
        for bag, t in zip(bags, y, strict=True):
            if not len(bag):
                continue
            if t:  # the sentences that look toxic so far, and the one that does most
                look = bag[:, : len(good)].max(1) - 0.8
                look = look if w is None else np.maximum(look, bag @ (root @ w) + bias)
                look[np.argmax(look)] = 1.0
                own = bag[look > 0]
                rows.append(own)
                ys += [1.0] * len(own)
                weights += [n0 / n1 / len(own)] * len(own)
            else:
                rows.append(bag)
                ys += [-1.0] * len(bag)
                weights += [1.0] * len(bag)
        w, bias = _svm(np.concatenate(rows) @ root, np.array(ys), np.array(weights))
    alpha = root @ w
    seen = np.array([evidence(b, alpha, bias) for b in bags])
    share = np.where(y == 1, prior / n1, (1 - prior) / n0)
    # a toxic document's worst sentence is also a text of its own, with a quarter of its weight
    alone = seen[y == 1].copy()
    alone[:, 1] = bias
    seen, share, y = np.concatenate([seen, alone]), np.concatenate([share, 0.25 * share[y == 1]]), np.concatenate([y, np.ones(len(alone), np.int64)])
    return Model(marks, alpha, bias, _logistic(seen, y, share))


def evidence(bag: np.ndarray, alpha: np.ndarray, bias: float) -> tuple[float, float, float]:
    """The margins of a text's two most toxic sentences, and 1; a sentence without any likeness has the margin bias."""
    top = np.sort(np.append(bag @ alpha + bias, [bias, bias]))
    return float(top[-1]), float(top[-2]), 1.0


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - 1e-4 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 1000, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trains on labelled documents: those of docs that labels has, at most max_docs toxic ones and twice as many others.

    Of rows that repeat an id the least text counts, and any toxic label. Documents go on
    being taken, in the order of a hash of their id, while their texts have under max_bytes;
    equal hashes go by id.
    """
    known = labels.where(f"`{id_col}` is not null and toxic is not null").groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    total = {int(r[0] > 0): r[1] for r in known.groupBy(F.col("toxic") > 0).agg(F.count("*")).collect()}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("text"))
    texts, toxic = [], []
    for y, n in ((1, max_docs), (0, 2 * max_docs)):
        ids = known.where((F.col("toxic") > 0) == bool(y)).orderBy(F.xxhash64("id"), "id").limit(n).select("id")
        own = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"))  # n rows at most
        so_far = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
        own = own.withColumn("so_far", so_far).where(F.col("so_far") <= (max_bytes // 3 if y else max_bytes - max_bytes // 3))
        got = sorted((r.id, bytes(r.text)) for r in own.select("id", "text").collect())
        texts += [t for _, t in got]
        toxic += [y] * len(got)
    n = sum(total.values())
    return train(texts, toxic, total.get(1, 0) / n if n else 0.0)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rk, score) for each row of docs.

    score is the probability of label 1 from the text alone. Null, empty and wordless
    texts have the score of a text without any likeness to an insult. Rows with null or
    repeated ids are scored like others, and equal texts alike; very long texts are read
    whole. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.landmarks)
        for batch in batches:
            out = []
            for a in range(0, batch.num_rows, 500):
                texts = [t or b"" for t in batch.column(2).slice(a, 500).to_pylist()]
                out += model.probability(list(reader.batch(texts))).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["doc_id", "rk", "score"])

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("rk"), F.encode(text_col, "UTF-8").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, rk long, score double")


def kept(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below threshold, with all their columns; no row moves."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.landmarks)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [(t or "").encode() for t in part.column(at).to_pylist()]
                scores = model.probability(list(reader.batch(texts)))
                yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
