"""Each stage of the pipeline on rows of all kinds, and the whole of it on small tables."""

import random

import pytest

import corpus_pipeline as cp

#: Columns named like those that the stages make themselves.
DOC = "doc_id long, text string, n_chars long, _id long, _key string, key int, root string, own int, _rk long, rk string, _kept string, left string, id int, fp long, node string"
EXTRA = (-1, "k", 3, "r", 4, 5, "x", "kept", "l", 6, 7, "n")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None else len(t), *EXTRA) for i, t in rows], DOC)


def shown(df):
    out = df.collect()
    assert df.columns == [c.split()[0] for c in DOC.split(", ")]
    assert all(tuple(r)[3:] == EXTRA for r in out)
    return sorted(((r.doc_id, r.text) for r in out), key=str)


def words(r, n):
    return [f"w{r.randint(0, 9999)}" for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """labels and benchmark beside documents: toxic ones say blargh."""
    d = tmp_path_factory.mktemp("sf")
    r = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        y = int(r.random() < 0.3)
        ws = words(r, 40)
        for _ in range(2 * y):
            ws.insert(r.randrange(len(ws)), r.choice(["blargh", "zwockel"]))
        rows.append((i, " ".join(ws) + "."))
        labels.append((i, 1, y))
    item = " ".join(f"q{k}" for k in range(20))
    rows += [(300, None), (301, ""), (302, "x " * 30_000), (303, "pre " + item + " post"), (304, rows[0][1]), (None, "no id at all")]
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, dict((i, y) for i, _, y in labels)


def test_toxicity_stage(spark, tables):
    d, rows, toxic = tables
    table = spark.read.parquet(f"{d}/documents.parquet")
    out = shown(cp.toxicity_filter(spark, table, d))
    ids = {i for i, _ in out}
    clean = {i for i, _ in rows if not toxic.get(i)}
    assert len(clean - ids) <= 2 and len(ids - clean) <= 4 and {None, 300, 301, 302} <= ids
    twice = shown(cp.toxicity_filter(spark, table.union(table), d))
    assert twice == sorted([x for x in out for _ in (0, 1)], key=str)
    assert shown(cp.toxicity_filter(spark, table.limit(0), d)) == []


def test_simhash_stage(spark):
    r = random.Random(12)
    a, b, c, d = (" ".join(words(r, 200)) for _ in range(4))
    rows = [(1, a), (5, b), (5, c), (5, c), (7, c), (1, d), (2, d), (9, a), (None, a), (20, None), (21, ""), (22, " "), (23, "same " * 20_000)]
    out = shown(cp.simhash_dedup(spark, docs(spark, rows), ""))
    assert out == sorted([(1, a), (5, b), (5, c), (1, d), (None, a), (20, None), (23, "same " * 20_000)], key=str)
    assert shown(cp.simhash_dedup(spark, docs(spark, []), "")) == []


def brute_kept(rows, width=50):
    own = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        ws = (t or "").split()
        for k in range(len(ws) - width + 1):
            own.setdefault(tuple(ws[k : k + width]), i)
    out = []
    for i, t in rows:
        ws = (t or "").split()
        gone = set()
        for k in range(len(ws) - width + 1):
            if i is not None and own[tuple(ws[k : k + width])] < i:
                gone.update(range(k, k + width))
        left = " ".join(w for k, w in enumerate(ws) if k not in gone)
        if not gone or left:
            out.append((i, left if gone else t))
    return sorted(out, key=str)


def test_substring_stage(spark):
    r = random.Random(3)
    a, b, c = words(r, 60), words(r, 90), words(r, 40)
    rows = [(1, " ".join(a + c)), (2, " ".join(c + a)), (3, " ".join(a)), (3, " ".join(a)), (3, " ".join(b)), (4, None), (5, ""), (None, " ".join(a)), (6, " ".join(c)), (7, " ".join(b[:70] + c)), (8, "z  " * 60), (9, "z " * 9000)]
    out = cp.substring_dedup(spark, docs(spark, rows), "")
    assert shown(out) == brute_kept(rows)
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in out.collect())
    assert shown(cp.substring_dedup(spark, docs(spark, []), "")) == []


def test_decontamination_stage(spark, tables):
    d, rows, _ = tables
    item = next(t for i, t in rows if i == 303)
    more = [(1, item), (1, item), (1, "clean"), (2, None), (3, ""), (None, item), (None, "clean"), (4, "y " * 20_000)]
    out = shown(cp.benchmark_decontamination(spark, docs(spark, more), d))
    assert out == sorted([x for x in more if x[1] != item], key=str)
    assert shown(cp.benchmark_decontamination(spark, docs(spark, []), d)) == []


def test_packing_stage(spark):
    out = cp.pack(spark, docs(spark, [(1, None), (2, "a b"), (2, "a b"), (None, "")]), "").collect()
    assert sorted((str(x.doc_id), x.length) for x in out) == [("1", 1), ("2", 3), ("2", 3), ("None", 1)]


def test_run(spark, tables):
    d, rows, toxic = tables
    out = cp.run(spark, d).collect()
    ids = {x.doc_id for x in out}
    assert 303 not in ids and 304 not in ids - {0} and {300, 302, None} <= ids and 301 not in ids
    clean = [i for i, _ in rows if i is not None and i < 300 and not toxic[i]]
    assert len(set(clean) - ids) <= 2
    places = {}
    for x in out:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert cp.queries() == {"pipeline": cp.run} and cp.oracle_sql() == {}


def test_names_that_are_free(spark):
    assert cp.free(docs(spark, []), "key", "Key", "fresh") == ["key_", "Key__", "fresh"]
