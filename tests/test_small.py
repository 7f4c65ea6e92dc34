"""Settings, stats, listings and names."""

import pytest
from pyspark.sql import functions as F

from mergeloom.functions import paths
from mergeloom.operators import graph, records, snapshots, trees
from mergeloom.sources.settings import BadSettings, Settings


def test_settings(spark):
    s = Settings.parse('{"recordPaths":["items/**"],"recordPolicy":{"fields":{"tags":"set"},"fallback":"sequence"}}')
    assert s.policy.fields == {"tags": "set"} and s.policy.fallback == "sequence"
    assert Settings.parse(s.text()) == s and Settings.parse(None) == Settings()
    for bad in ("[]", "x", '{"recordPaths":"a"}', '{"recordPaths":[1]}', '{"recordPolicy":[]}', '{"recordPolicy":{"fields":{"a":"odd"}}}', '{"recordPolicy":{"fallback":null}}'):
        with pytest.raises(BadSettings):
            Settings.parse(bad)
    assert [r.x for r in spark.createDataFrame([("items/a",), ("src/a",)], "p string").select(s.is_record(F.col("p")).alias("x")).collect()] == [True, False]


def test_stats(spark):
    t = 10_000_000_000
    rows = [((1, 1, 1, 1, 1, t), (1, 1, 1, 1, 1, 2 * t)), ((1, t, 1, 1, 1, t), (1, t, 1, 1, 1, 2 * t)), ((1, 1, 1, 1, 1, t), (2, 1, 1, 1, 1, 2 * t)), ((1, 1, 1, 1, 1, t), (1, 1, 1, 1, 1, t)), (None, (1, 1, 1, 1, 1, t))]
    kind = "struct<size:bigint,mtime_ns:bigint,ctime_ns:bigint,dev:bigint,ino:bigint,observed_ns:bigint>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    assert [r.x for r in df.select(snapshots.content_unchanged(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, False, False]


def test_listing(spark):
    e = spark.createDataFrame([("b", "a", 0), ("c", "a", 0)], "child string, parent string, ordinal int")
    refs = spark.createDataFrame([("o/m", "c"), ("o/n", "b")], "name string, target string")
    got = {r.name: (r.ahead, r.behind) for r in graph.remote_listing(e, refs, "b").collect()}
    assert got == {"o/m": (1, 1), "o/n": (0, 0)}
    assert [r.ahead for r in graph.remote_listing(e, refs, None).collect()] == [None, None]
    p = spark.createDataFrame([(0, "b", "a"), (1, "a", "b"), (2, "b", "c")], "pair int, left string, right string")
    assert {r.pair: r.kind for r in graph.merge_kind(e, p).collect()} == {0: "up_to_date", 1: "fast_forward", 2: "merge"}


def test_names(spark):
    rows = [("t/tasks/a.b.toon", "a.b", "a.b"), ("t/history/a.jsonl", "a", None), ("t/settings.json", "settings", None), ("t/history/x.toon", "x", None), ("t/tasks/.toon", None, None), ("u/tasks/a", "a", None)]
    got = spark.createDataFrame([r[:1] for r in rows], "p string").select("p", paths.base_id(F.col("p")).alias("b"), paths.document_id(F.col("p"), "t").alias("d"), paths.below(F.col("p"), "t").alias("i")).collect()
    assert [(r.p, r.b, r.d) for r in got] == rows and [r.i for r in got] == [True] * 5 + [False]
    names = ["refs/heads/a", "a//b", "a/../b", "a.lock", "a b", "x/y.lock/z", "a~1"]
    assert [r.x for r in spark.createDataFrame([(n,) for n in names], "n string").select(paths.ref_name_ok(F.col("n")).alias("x")).collect()] == [True] + [False] * 6


def test_virtual_base_and_lines(spark):
    snap = lambda *r: spark.createDataFrame([(p, i, "m", None, None) for p, i in r], "path string, id string, mode string, file_id string, copied_from string")
    out = trees.virtual_base([snap(("a", "1"), ("b", "2")), snap(("a", "3"), ("b", "1"))], snap(("a", "1"), ("b", "1")))
    assert {r.path: r.id for r in out.collect()} == {"a": "3", "b": "2"}
    f = spark.createDataFrame([("r", "b", "1"), ("r", "a", '"x"')], "record_id string, field string, value string")
    assert records.shown(f).first().text == '"a": "x"\n"b": 1\n'
