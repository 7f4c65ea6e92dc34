"""SimHash groups, embedding links and repeated passages against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash

from mergeloom.llm import embeddings, simhash, substring
from mergeloom.llm.components import connected


def groups(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 260)] + [(r.randrange(100), r.randrange(100)) for _ in range(70)] + [(500, k) for k in range(600, 800)]
    got = {x.node: x.root for x in connected(spark.createDataFrame([*edges, (None, 3), (4, 4)], "a long, b long").repartition(7)).collect()}
    want = {k: v for k, v in groups({x for e in edges for x in e}, [e for e in edges if e[0] != e[1]]).items() if k != v}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_masks_cover():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def fingerprint(text):
    ws = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[k : k + 3]), 42) for k in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    r = random.Random(2)
    base = [" ".join(r.choice(["aa", "Bb", "cc", "dÉ"]) + str(r.randrange(50)) for _ in range(r.choice([1, 2, 3, 40, 200]))) for _ in range(30)]
    near = [" ".join(t.split()[:-1] + ["zz"]) for t in base if len(t) > 500]
    texts = base + near + base[:5] + ["", None, " \t", "x\x0by\x1cz", "w " * 5000]
    rows = [(i, t, "c") for i, t in enumerate(texts)]
    out = {x.doc_id: x for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()}
    fp = {i: fingerprint(t) for i, t, _ in rows}
    want = groups(fp, [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {i: x.fingerprint for i, x in out.items()} == {i: f"{f:016x}" for i, f in fp.items()}
    assert {i: x.component_id for i, x in out.items()} == want
    odd = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "q r s t")], "doc_id long, text string")
    assert sorted((x.doc_id or -1, x.component_id) for x in simhash.near_duplicates(odd).collect()) == [(-1, 5), (3, 3), (5, 5), (5, 5)]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("small", [2, 48])
def test_links_lose_none(spark, small):
    """Also where most buckets are too large to be compared pair by pair."""
    r = random.Random(3)
    centre = r.getrandbits(63)
    fps = {centre ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 3))) for _ in range(250)} | {r.getrandbits(63) for _ in range(50)}
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), small=small).collect()
    assert all((x.a ^ x.b).bit_count() <= 2 for x in got)
    true = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2]
    assert groups(fps, [(x.a, x.b) for x in got]) == groups(fps, true)


def brute_passages(rows, width):
    own = {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        ws = (t or "").encode().split()
        for k in range(len(ws) - width + 1):
            own.setdefault(tuple(ws[k : k + width]), i)
    out = []
    for i, t in rows:
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for k in range(len(ws) - width + 1):
            if i is not None and own[tuple(ws[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = [w for w, g in zip(ws, gone, strict=True) if not g]
        out.append((i, len(ws), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "gram", "batches"), [(50, 8, 2), (6, 3, 3), (5, 5, 1)])
def test_passages(spark, width, gram, batches):
    r = random.Random(width)
    vocab = [f"w{i}" for i in range(9 if width < 9 else 400)]
    shared = [[r.choice(vocab) for _ in range(r.randint(width - 2, 3 * width))] for _ in range(4)]
    rows = []
    for i in range(60):
        ws = []
        for _ in range(r.randint(0, 4)):
            ws += r.choice(shared) if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randint(0, 2 * width))]
        rows.append((i * 3, " ".join(ws)))
    rows += [(7, None), (8, ""), (9, "same " * 200), (10, "same " * 70), (11, rows[5][1]), (11, rows[6][1]), (None, rows[5][1]), (12, "a\x0bb c")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id int").repartition(5)
    got = sorted(((x.id, x.n_words, x.n_removed, x.kept_sha256) for x in substring.deduplicated(df, width, gram, batches).collect()), key=str)
    assert got == brute_passages(rows, width)
    assert substring.deduplicated(df.limit(0), width, gram, batches).count() == 0


def passages(r, n, width, vocab, first=0, step=3):
    shared = [[r.choice(vocab) for _ in range(r.randint(width - 2, 3 * width))] for _ in range(4)]
    rows = []
    for i in range(n):
        ws = []
        for _ in range(r.randint(0, 4)):
            ws += r.choice(shared) if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randint(0, 2 * width))]
        rows.append((first + i * step, " ".join(ws)))
    return rows


def outcome(df):
    return sorted(((x.id, x.n_words, x.n_removed, x.kept_sha256) for x in df.collect()), key=str)


@pytest.mark.parametrize("salted", [1, 1024])
def test_hot_fingerprints_are_dealt_by_window(spark, monkeypatch, salted):
    """Many documents with one passage in changing surroundings; tasks that hold few windows at once."""
    monkeypatch.setattr(substring, "SALTED", salted)
    monkeypatch.setattr(substring, "SHARE", 4)
    monkeypatch.setattr(substring, "HELD", 200)
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    hot = [r.choice(vocab) for _ in range(14)]
    rows = [(i, " ".join([r.choice(vocab) for _ in range(r.randint(0, 9))] + hot[r.randint(0, 3) :] + [r.choice(vocab[:3]) for _ in range(r.randint(0, 9))])) for i in range(150)]
    rows.append((151, " ".join(hot * 3000)))  # a very long text
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert outcome(substring.deduplicated(df, 8, 3)) == brute_passages(rows, 8)


def test_index_is_incremental(spark):
    """Two calls, the second on an index opened from its manifest, give what one call gives."""
    r = random.Random(21)
    vocab = [f"w{i}" for i in range(60)]
    rows = passages(r, 60, 7, vocab)
    rows += [(1000, rows[3][1]), (1000, rows[3][1]), (1001, None)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string").repartition(3)
    index = substring.FingerprintIndex(spark, 7, 3)
    first = outcome(substring.added(index, frame(rows[:30]), 3))
    later = substring.FingerprintIndex(spark, manifest=index.manifest())
    second = outcome(substring.added(later, frame(rows[30:]), 2))
    assert sorted(first + second, key=str) == brute_passages(rows, 7)
    assert any(x[2] for x in second)


def test_runs_are_merged_in_place(spark):
    """Runs are joined without a shuffle or a sort, and two of one level become one of the next."""
    fps = lambda *x: spark.createDataFrame(x, "fp long, id long, rk long")
    index = substring.FingerprintIndex(spark)
    assert index.append(fps((1, 1, 0), (2, 1, 0))).collect() == []
    assert [tuple(x) for x in index.append(fps((2, 5, 0), (3, 5, 0), (3, 6, 0))).where("fp = 2").collect()] == [(2, 2)]
    assert index.compacted == 1 and [x[0] for x in index.runs] == [1]
    index.append(fps((1, 7, 0)))
    assert [x[0] for x in index.runs] == [1, 0]
    (_, _, a), (_, _, b) = index.runs
    with substring._merging(spark):
        plan = a.join(b.withColumnRenamed("n", "m").hint("merge"), "fp")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    index.append(fps((1, 8, 0)))
    assert [x[0] for x in index.runs] == [2] and index.compacted == 3
    assert {(x.fp, x.n) for x in index.runs[0][2].collect()} == {(1, 3), (2, 2), (3, 2)}


def test_unequal_words_are_noticed(spark, monkeypatch):
    """If all words had the same hash, stretches would be found that the words don't bear out."""
    monkeypatch.setattr(substring.xxhash, "xxh64_intdigest", lambda w: 7)
    df = spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j")], "doc_id long, text string")
    keyed = substring._keyed(df, "doc_id", "text").withColumn("spans", substring.F.expr("array(named_struct('a', 0, 'b', 5, 'digest', X'00'))"))
    batch = keyed.select("id", "rk", "text", "spans").toArrow().to_batches()
    with pytest.raises(substring.Unequal):
        list(substring._finish(iter(batch)))


def brute_links(rows, threshold):
    def ok(x):
        return x[1] is not None and x[2] is not None and all(c is not None and np.isfinite(c) for c in x[2]) and any(x[2])

    n, links = [0] * len(rows), []
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = rows[a], rows[b]
        if ok(x) and ok(y) and x[1] == y[1] and len(x[2]) == len(y[2]):
            p, q = np.array(x[2], float), np.array(y[2], float)
            if p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= threshold:
                n[a] += 1
                n[b] += 1
                links.append((a, b))
    g = groups(range(len(rows)), links)
    low = {}
    for k, v in g.items():
        low[v] = min(low.get(v, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], n[k], low[g[k]], rows[k][0] == low[g[k]]) for k in range(len(rows)))


@pytest.mark.parametrize("tile", [4, 512])
def test_embeddings(spark, tile):
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 12))
    rows = []
    for i in range(120):
        v = centres[r.integers(6)] + r.normal(size=12) * r.choice([0.02, 0.12, 0.5])
        rows.append((i, int(r.integers(3)), v.astype(np.float32).tolist()))
    rows += [(200 + k, 1, rows[0][2]) for k in range(5)] + [(300, None, rows[0][2]), (301, 1, None), (302, 1, [0.0] * 12), (303, 1, [None] + [1.0] * 11), (304, 1, [float("nan")] * 12), (305, 1, []), (306, 1, [1.0]), (307, 1, [2.0]), (308, 1, [-1.0])]
    df = spark.createDataFrame([(i, v, lab, "x") for i, lab, v in rows], "vec_id long, embedding array<float>, label int, node string").repartition(3)
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicates(df, tile=tile).collect())
    assert got == brute_links(rows, 0.98)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [2.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((x.vec_id or -1, x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicates(odd).collect()) == [(-1, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True)]


def test_early_stop_is_exact():
    r = np.random.default_rng(5)
    a = r.normal(size=(80, 40)) * np.linspace(3, 0.1, 40)
    b = np.vstack([a[:40] + 0.01 * r.normal(size=(40, 40)), r.normal(size=(40, 40))])
    turn = np.linalg.qr(r.normal(size=(40, 40)))[0]
    i, j = embeddings.compare(a, b, turn, 0.9)
    u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(u @ v.T >= 0.9)), strict=True))


def test_pipeline_keeps_other_texts_of_an_id(spark):
    import corpus_pipeline

    r = random.Random(12)
    text = lambda: " ".join(f"w{r.randint(0, 9999)}" for _ in range(200))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (5, b), (5, c), (5, c), (7, c), (1, d), (2, d), (9, a), (None, a)]
    out = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    key = lambda x: (x[0] or 0, x[1])
    assert sorted((tuple(x) for x in out.collect()), key=key) == sorted([(1, a), (5, b), (5, c), (1, d), (None, a)], key=key)
