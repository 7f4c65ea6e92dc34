"""Indexes, HEAD, refs, remotes, bundles and names."""

import pytest
from pyspark.sql import functions as F

from mergeloom.functions import identity, paths
from mergeloom.operators import exchange, ledger, lineage, snapshots
from mergeloom.sources import index, refs
from mergeloom.sources import text as sources

A, B, FID = "a" * 64, "b" * 64, "c" * 32
STAT = "struct<size:bigint,mtime_ns:bigint,ctime_ns:bigint,dev:bigint,ino:bigint,observed_ns:bigint>"


def entries(spark, *rows):
    return spark.createDataFrame(rows, f"path string, id string, mode string, file_id string, copied_from string, stat {STAT}")


def test_index_round_trip(spark, tmp_path):
    rows = [("z", A, "100644", None, None, None), ('d/"q"\tä', B, "100755", FID, "d" * 32, (5, -1, 2, 3, 4, 6)), ("b", B, "100644", FID, None, (0, 0, 0, 0, 0, 0))]
    df = entries(spark, *rows)
    lines = [r.line for r in index.encoded(df).orderBy("path").collect()]
    assert lines[0] == "index 3" and lines[1].startswith('["100644",') and '"-1"' in lines[2]
    (tmp_path / "index").write_text("\n".join(lines), encoding="utf-8")
    got = index.read(spark, str(tmp_path / "index"))
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    (tmp_path / "two").write_text(f'index 2\n["100644","{A}","p",null]\n')
    assert [(r.path, r.id, r.file_id) for r in index.read(spark, str(tmp_path / "two")).collect()] == [("p", A, None)]
    (tmp_path / "plain").write_text(f"100755 {A} a b\n")
    assert [(r.path, r.mode) for r in index.read(spark, str(tmp_path / "plain")).collect()] == [("a b", "100755")]
    (tmp_path / "new").write_text("index 9\n")
    with pytest.raises(index.BadIndex):
        index.read(spark, str(tmp_path / "new"))


BAD = [
    f'["100644","{A}","p",null,null]',
    f'["100644","{A}","p",null,null,null,null]',
    f'["644","{A}","p",null,null,null]',
    f'["100644","x","p",null,null,null]',
    f'["100644","{A}","../p",null,null,null]',
    f'["100644","{A}","p",null,"{FID}",null]',
    f'["100644","{A}","p","{FID}","{FID}",null]',
    f'["100644","{A}","p",null,null,["1","2","3"]]',
    f'["100644","{A}","p",null,null,["-1","2","3","4","5","6"]]',
    "nonsense",
    f'["100644","{A}","twice",null,null,null]\n["100644","{A}","twice",null,null,null]',
]


@pytest.mark.parametrize("line", BAD, ids=range(len(BAD)))
def test_bad_index(spark, line):
    df = spark.createDataFrame([(x,) for x in line.split("\n")], "line string")
    with pytest.raises(Exception, match="index"):
        index.decoded(df, "index 3").collect()


def test_head(spark):
    table = spark.createDataFrame([("refs/heads/m", A), ("refs/tags/t", B)], "name string, target string")
    head = refs.read_head("ref: refs/heads/m\n", table)
    assert head == refs.Head("refs/heads/m", A) and refs.head_text(head) == "ref: refs/heads/m"
    assert refs.read_head("ref: refs/heads/none", table).target is None and refs.read_head(B, table) == refs.Head(None, B)
    for bad in (None, "", "ref: a..b/../c", "xyz"):
        with pytest.raises(refs.BadHead):
            refs.read_head(bad, table)
    now, moved = refs.advanced(head, table, B)
    assert now.target == B and {tuple(r) for r in moved.collect()} == {("refs/heads/m", B), ("refs/tags/t", B)}
    assert refs.advanced(refs.Head(None, A), table, B)[0] == refs.Head(None, B)
    assert [r.name for r in refs.with_prefix(table, "refs/tags/").collect()] == ["refs/tags/t"]


def test_remotes(spark):
    r = refs.Remotes.parse(None).add(spark, "origin", "/x").add(spark, "b", "/y")
    assert refs.Remotes.parse(r.text()) == refs.Remotes({"origin": "/x", "b": "/y"}) and r.require("b") == "/y"
    assert r.remove("b").urls == {"origin": "/x"}
    for name in ("", ".", "..", "a/b", "a\\b", "a b", "a~", "origin"):
        with pytest.raises(refs.BadRemote):
            r.add(spark, name, "/z")
    for bad in ("[]", "x", '{"a":1}'):
        with pytest.raises(refs.BadRemote):
            refs.Remotes.parse(bad)
    with pytest.raises(refs.BadRemote):
        r.remove("none")


def test_paths(spark):
    cases = {"a/b": "a/b", "./a//b/": "a/b", "a/../b": "b", "..": None, "a/../..": None, "": None, ".": None, "/a": None, "a/../../b/c": None}
    got = {r.p: r.n for r in spark.createDataFrame([(p,) for p in cases], "p string").select("p", paths.normal_path(F.col("p")).alias("n")).collect()}
    assert got == cases
    names = {"refs/heads/a/b": "refs/remotes/o/a/b", "refs/tags/v": "refs/tags/v", "refs/notes/n": None}
    got = {r.p: r.n for r in spark.createDataFrame([(p,) for p in names], "p string").select("p", paths.local_name(F.lit("o"), F.col("p")).alias("n")).collect()}
    assert got == names
    dirs = spark.createDataFrame([("a",), ("a/b",), ("a/c",), ("x",), ("x/node_modules",), ("y",), ("y/z",)], "path string")
    left = spark.createDataFrame([("a/b/f",), ("top",)], "path string")
    assert {r.folder for r in snapshots.emptied_folders(dirs, left).collect()} == {"a/c", "y", "y/z"}


def test_bundle_file(spark, tmp_path):
    o = spark.createDataFrame([("blob", bytearray(b"{x")), ("record", bytearray(b'{"a":1}'))], "type string, payload binary").withColumn("id", identity.object_id(F.col("type"), F.col("payload")))
    lines = [r.line for r in exchange.bundle_lines(o, {"refs/heads/é": A}, [B]).orderBy("part", "id").collect()]
    (tmp_path / "b").write_text("\n".join(lines) + "\n", encoding="utf-8")
    header, objects = sources.read_bundle(spark, str(tmp_path / "b"))
    assert header == {"refs": {"refs/heads/é": A}, "prerequisites": [B]}
    assert {(r.id, r.type) for r in objects.collect()} == {(r.id, r.type) for r in o.collect()}
    (tmp_path / "c").write_text("\n".join(lines[1:]))
    with pytest.raises(exchange.BadBundle):
        sources.read_bundle(spark, str(tmp_path / "c"))
    (tmp_path / "d").write_text("\n".join([*lines[:2], f"blob {A} eA=="]))
    with pytest.raises(Exception, match="other content"):
        sources.read_bundle(spark, str(tmp_path / "d"))[1].collect()


def test_verdict_and_files(spark):
    checks = spark.createDataFrame([(f"c{i}", i % 2 == 0) for i in range(14)], "name string, passed boolean")
    row = ledger.verdict(checks).first()
    assert (row.ok, list(row.failed), row.n_failed) == (False, ["c1", "c11", "c13", "c3", "c5"], 7)
    assert ledger.verdict(checks.where("passed")).first().ok is True and ledger.verdict(checks.limit(0)).first().ok is True
    commits = spark.createDataFrame([("k", ["i"])], "id string, items array<string>")
    links = spark.createDataFrame([("i", "p"), ("j", "q")], "item string, path string")
    latest = spark.createDataFrame([("p", "F"), ("q", "G"), ("r", "H")], "path string, file_id string")
    traces = spark.createDataFrame([("k", "H"), ("k", "H")], "commit string, file_id string")
    assert {tuple(r) for r in lineage.files_of_item(commits, links, latest, traces).collect()} == {("i", "F", "p"), ("j", "G", "q"), ("i", "H", "r")}


def test_change_ids(spark):
    sig = F.struct(F.lit("n").alias("name"), F.lit("e").alias("email"), F.lit(1).cast("bigint").alias("ts_ms"), F.lit(0).alias("tz_min"))
    none = F.array().cast("array<string>")
    args = [F.lit(A), none, F.array(F.lit(B)), sig, sig, F.lit("m")]
    row = spark.range(1).select(identity.identity_without_change(*args).alias("c"), identity.commit_id(args[0], F.lit(None).cast("string"), *args[1:]).alias("i"), identity.commit_id(args[0], F.lit(A), *args[1:]).alias("o")).first()
    assert row.c == row.i != row.o
