"""Graphs, trees, lineage, exchange, logs and rewriting on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from mergeloom.functions import identity, paths
from mergeloom.operators import exchange, graph, ledger, lineage, oplog, rewrite, snapshots, trees
from mergeloom.sources import text as sources


def dag(spark, parents):
    rows = [(c, p, i) for c, ps in parents.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "child string, parent string, ordinal int")


def pairs(spark, *rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "pair int, left string, right string")


def test_bases_and_divergence(spark):
    e = dag(spark, {"a1": ["root"], "b1": ["root"], "m1": ["a1", "b1"], "m2": ["b1", "a1"], "x": ["y"]})
    p = pairs(spark, ("m1", "m2"), ("a1", "b1"), ("m1", "x"), ("m1", "b1"))
    bases = {(r.pair, r.node) for r in graph.merge_bases(e, p).collect()}
    assert bases == {(0, "a1"), (0, "b1"), (1, "root"), (3, "b1")}
    div = {r.pair: (r.ahead, r.behind) for r in graph.ahead_behind(e, p).collect()}
    assert div == {0: (1, 1), 1: (1, 1), 2: (4, 2), 3: (2, 0)}
    anc = {r.pair: r.is_ancestor for r in graph.is_ancestor(e, pairs(spark, ("root", "m1"), ("m1", "m1"), ("m1", "root"))).collect()}
    assert anc == {0: True, 1: True, 2: False}


def test_bases_random(spark):
    r = random.Random(5)
    for _ in range(3):
        n = 9
        par = {str(i): sorted({str(r.randrange(i)) for _ in range(r.randint(1, 2))}) for i in range(1, n)}
        up = {"0": {"0"}}
        for i in range(1, n):
            up[str(i)] = {str(i)}.union(*(up[p] for p in par[str(i)]))
        todo = [(str(r.randrange(n)), str(r.randrange(n))) for _ in range(8)]
        want = set()
        for k, (a, b) in enumerate(todo):
            common = up[a] & up[b]
            want |= {(k, c) for c in common if not any(c in up[d] for d in common if d != c)}
        assert {(x.pair, x.node) for x in graph.merge_bases(dag(spark, par), pairs(spark, *todo)).collect()} == want


def test_orders(spark):
    e = dag(spark, {"C": ["B"], "D": ["B", "C"]})
    nodes = spark.createDataFrame([("B",), ("C",), ("D",)], "node string")
    assert {r.node: r.level for r in graph.levels(e, nodes).collect()} == {"B": 0, "C": 1, "D": 2}
    assert [r.node for r in graph.newest_first(e, nodes).orderBy("seq").collect()] == ["D", "C", "B"]
    start = spark.createDataFrame([(0, "D")], "root int, node string")
    assert [r.node for r in graph.first_parent_log(e, start, 5).orderBy("seq").collect()] == ["D", "B"]


def test_tree_roundtrip(spark):
    files = [("r", "a.txt", "1" * 64, "100644", None, None), ("r", "d/x", "2" * 64, "100755", "f" * 32, None), ("r", "d/e/y", "3" * 64, "100644", None, None)]
    df = spark.createDataFrame(files, "root string, path string, id string, mode string, file_id string, copied_from string")
    built = {r.dir: r.tree_id for r in trees.build(df).collect()}
    assert set(built) == {"", "d", "d/e"}
    low = identity.tree_bytes([{"name": "y", "mode": "100644", "id": "3" * 64}], "tree 2")
    import hashlib

    assert built["d/e"] == hashlib.sha256(f"tree {len(low)}\0".encode() + low).hexdigest()
    entries = [{"name": "é", "mode": "100644", "id": "1" * 64, "file_id": "a" * 32, "copied_from": "b" * 32}, {"name": "z", "mode": "40000", "id": "2" * 64, "file_id": None, "copied_from": None}]
    assert identity.tree_entries(identity.tree_bytes(entries, "tree 2"), "tree 2") == sorted(entries, key=lambda e: e["name"].encode())
    for bad in ([{"name": "a/b", "mode": "100644", "id": "1" * 64}], [{"name": "a", "mode": "100644", "id": "1" * 64}] * 2, [{"name": "a", "mode": "40000", "id": "1" * 64, "file_id": "a" * 32}]):
        with pytest.raises(identity.BadTree):
            identity.tree_bytes(bad, "tree 2")


def snapshot(spark, *rows):
    return spark.createDataFrame([(p, i, m, f, None) for p, i, m, f in rows], "path string, id string, mode string, file_id string, copied_from string")


def test_merge_trees(spark):
    b = snapshot(spark, ("same", "1", "m", "f1"), ("gone", "1", "m", None), ("del", "1", "m", None), ("text", "1", "m", None), ("mode", "1", "m", None))
    o = snapshot(spark, ("same", "1", "m", "f1"), ("del", "2", "m", None), ("text", "2", "m", None), ("mode", "1", "x", None), ("two", "9", "m", "f1"), ("agree", "5", "m", "fb"))
    t = snapshot(spark, ("same", "1", "m", "f1"), ("gone", "1", "m", None), ("text", "3", "m", None), ("mode", "2", "m", None), ("agree", "5", "m", "fa"))
    got = {r.path: (r.action, r.id, list(r.reasons)) for r in trees.merge(b, o, t).collect()}
    assert got["same"][0] == "ours" and got["gone"][:2] == ("removed", None)
    assert got["del"] == ("conflict", "2", ["content"]) and got["text"][0] == "content" and got["mode"] == ("conflict", "1", ["mode"])
    assert got["agree"][0] == "agree" and got["agree"][2] == ["identity"] and got["two"][2] == ["identity"]
    ids = {r.path: r.file_id for r in trees.merge(b, o, t).collect()}
    assert ids["agree"] == "fa" and ids["same"] == "f1" and ids["two"] != "f1"


def test_reasons_stand_in_the_order_of_the_sql(spark):
    """A mode that conflicts comes before an identity that is taken, as content does."""
    b = snapshot(spark, ("a", "1", "m", "f1"), ("b", "1", "m", "f2"), ("c", "1", "m", "f3"))
    o = snapshot(spark, ("a", "1", "m", "f1"), ("b", "2", "x", "f1"), ("c", "2", "m", "f1"))
    t = snapshot(spark, ("a", "1", "m", "f1"), ("b", "3", "m", "f2"))
    got = {r.path: (r.action, r.reasons) for r in trees.merge(b, o, t).collect()}
    assert got == {"a": ("ours", []), "b": ("conflict", ["mode", "identity"]), "c": ("conflict", ["content", "identity"])}


def test_lineage(spark):
    rows = [("c1", "a", "1", "F"), ("c2", "a", "2", "F"), ("c3", "b", "2", "F"), ("c4", "c", "3", "F")]
    snaps = spark.createDataFrame([(c, p, i, "m", f, None) for c, p, i, f in rows], "commit string, path string, id string, mode string, file_id string, copied_from string")
    par = spark.createDataFrame([("c1", None), ("c2", "c1"), ("c3", "c2"), ("c4", "c3"), ("c5", "c4")], "commit string, parent string")
    got = {r.commit: r.kind for r in lineage.trace(snaps, par).collect()}
    assert got == {"c1": "added", "c2": "modified", "c3": "moved", "c4": "moved", "c5": "deleted"}


def test_ledger(spark):
    rows = [("a", 1, "created", "p1", "s1"), ("a", 2, "modified", "p2", "s2"), ("b", 1, "modified", "q", "s1"), ("b", 3, "deleted", "q", "s3"), ("b", 4, "created", "q", "s4")]
    out = {r.id: (r.kind, r.path, list(r.commits)) for r in ledger.items_in_range(spark.createDataFrame(rows, "id string, seq int, kind string, path string, sha string")).collect()}
    assert out == {"a": ("created", "p1", ["s2", "s1"]), "b": ("deleted", "q", ["s4", "s3", "s1"])}
    who = spark.createDataFrame([("commit", "author A <a@x> 1 0\ncommitter B <b@x> 1 0\n\nauthor <no@x>"), ("commit", "author C <c@x> 1 0\n\n")], "type string, text string")
    assert {(r.email, r.bad) for r in ledger.identities(who).collect()} == {("a@x", False), ("b@x", False), ("c@x", True)}


def test_bundles(spark):
    o = spark.createDataFrame([("blob", bytearray(b"x\0y" * 50)), ("blob", bytearray(b""))], "type string, payload binary").withColumn("id", identity.object_id(F.col("type"), F.col("payload")))
    parsed = exchange.bundle_lines(o, {"refs/heads/m": "0" * 64}, []).where("part = 2").select(exchange.parsed_line(F.col("line")).alias("p")).select("p.*")
    assert parsed.where("problem is not null").count() == 0
    assert {(r.id, bytes(r.payload)) for r in parsed.collect()} == {(r.id, bytes(r.payload)) for r in o.collect()}
    assert exchange.new_objects(o, o.select("id")).count() == 0
    bad = o.withColumn("payload", F.lit(b"other"))
    assert {r.outcome for r in exchange.verify(bad, o.select("id")).collect()} == {"corrupt"}
    with pytest.raises(Exception, match="content"):
        exchange.new_objects(bad, o.select("id").limit(0)).collect()
    for head in ('{"refs":null}', '{"refs":[]}', "nonsense", '{"refs":{"a":"b"}}'):
        with pytest.raises(exchange.BadBundle):
            exchange.parse_header(exchange.FORMAT, head)


def test_oplog(spark):
    lines = spark.createDataFrame([('{"sequence":1,"command":"a","at":"t","summary":"s","refs":[{"ref":"x","before":null,"after":"1"}]}',), ("torn",), ("",)], "line string")
    log = oplog.parse(lines)
    assert oplog.next_sequence(log) == 2 and log.count() == 1
    twice = oplog.reversal(oplog.reversal(log))
    assert [r.asDict(True)["refs"] for r in twice.collect()] == [r.asDict(True)["refs"] for r in log.select("refs").collect()]
    refs = spark.createDataFrame([("m", "1")], "name string, target string")
    up = spark.createDataFrame([("m", "2", "3"), ("n", None, "3"), ("n", None, "4")], "ref string, expected string, after string")
    assert {(r.ref, r.problem) for r in oplog.cas_problems(up, refs).collect()} == {("m", "ref_changed"), ("n", "duplicate_ref_update")}


def commits(spark, *rows):
    sig = "named_struct('name', 'n', 'email', 'e', 'ts_ms', 1L, 'tz_min', 0)"
    df = spark.createDataFrame(rows, "tree string, parents array<string>, message string, items array<string>")
    return rewrite.with_ids(df.selectExpr("tree", "CAST(NULL AS STRING) AS change_id", "items", "parents", f"{sig} AS author", f"{sig} AS committer", "message"))


def chain(spark):
    out = commits(spark, ("t0", [], "m0", ["b"]))
    for i in (1, 2):
        last = out.where(f"message = 'm{i - 1}'").first().id
        out = out.union(commits(spark, (f"t{i}", [last], f"m{i}", ["a"])))
    return graph.cut(out)


def test_rewrites(spark):
    c = chain(spark)
    ids = {r.message: r.id for r in c.collect()}
    done = {r.old: r for r in rewrite.describe(c, ids["m1"], "other").collect()}
    assert set(done) == {ids["m1"], ids["m2"]} and done[ids["m1"]].change_id == ids["m1"]
    assert list(done[ids["m2"]].parents) == [done[ids["m1"]].id]
    sq = {r.old: r for r in rewrite.squash(c, ids["m1"]).collect()}
    assert sq[ids["m0"]].message == "m0\n\nm1" and list(sq[ids["m0"]]["items"]) == ["a", "b"] and sq[ids["m0"]].tree == "t1"
    assert list(sq[ids["m2"]].parents) == [sq[ids["m0"]].id]
    with pytest.raises(ValueError, match="root"):
        rewrite.squash(c, ids["m0"])
    text = c.select("id", identity.commit_text(*[F.col(x) for x in rewrite.FIELDS]).alias("t")).select("id", identity.parsed_commit(F.col("t")).alias("p"))
    assert {(r.id, r.p.tree, tuple(r.p.parents), r.p.message) for r in text.collect()} == {(r.id, r.tree, tuple(r.parents), r.message) for r in c.collect()}


def test_picks(spark):
    base, next_ = snapshot(spark, ("a", "1", "m", None), ("b", "1", "m", None)), snapshot(spark, ("a", "2", "m", None), ("b", "1", "m", None))
    target = snapshot(spark, ("a", "1", "m", None), ("c", "7", "m", None))
    got = {r.path: r.id for r in rewrite.cherry_pick(target, next_, base).collect() if r.id}
    assert got == {"a": "2", "c": "7"}
    back = {r.path: r.id for r in rewrite.revert(next_, next_, base).collect() if r.id}
    assert back == {"a": "1", "b": "1"}
    on = {r.path: r.id for r in rewrite.rebase([(base, next_)], target).collect()}
    assert on == got


def test_globs(spark):
    cases = [("a/b/c.txt", "a/**/c.txt", True), ("a/c.txt", "a/**/c.txt", True), ("x/barfoo", "**/foo", True), ("a/b", "*", False), ("ab", "a?", True), ("a+b", "a+b", True), ("aab", "a+b", False)]
    for path, glob, want in cases:
        assert spark.range(1).select(paths.matches_glob(F.lit(path), glob).alias("x")).first().x is want, (path, glob)
    rules = paths.IgnoreRules.parse("# c\n*.log\n!keep.log\nbuild/\n")
    got = {p: spark.range(1).select(paths.ignored(F.lit(p), rules).alias("x")).first().x for p in ("a.log", "d/a.log", "keep.log", "build/x", ".git/x", "x/.git", "src/a")}
    assert got == {"a.log": True, "d/a.log": True, "keep.log": False, "build/x": True, ".git/x": True, "x/.git": False, "src/a": False}


def test_log_records(spark):
    text = "\x01s1\x00A\x00a@x\x00d\x00subj\x00\nM\x00f1\x00R100\x00old\x00new\x00\x01short\x00x"
    rows = sources.path_changes(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(r.sha, r.status, r.path) for r in rows] == [("s1", "M", "f1"), ("s1", "R100", "new")]


def test_status_moves(spark):
    old = spark.createDataFrame([("a", "1", "m", "F", 1, 5), ("b", "2", "m", "G", 1, 6)], "path string, id string, mode string, file_id string, dev int, ino int")
    new = spark.createDataFrame([("c", "9", "m", 1, 5), ("d", "2", "m", 1, 99)], "path string, id string, mode string, dev int, ino int")
    got = {r.path: (r.source, r.kind) for r in snapshots.moves_and_copies(old, new, old.where("path = 'b'")).collect()}
    assert got == {"c": ("a", "move"), "d": ("b", "copy")}


def test_files(spark, tmp_path):
    import zlib

    frame = b"blob 3\0abc"
    import hashlib

    oid = hashlib.sha256(frame).hexdigest()
    (tmp_path / oid[:2]).mkdir()
    (tmp_path / oid[:2] / oid[2:]).write_bytes(zlib.compress(frame))
    got = sources.read_loose_objects(spark, str(tmp_path)).collect()
    assert [(r.id, r.type, bytes(r.payload), r.size) for r in got] == [(oid, "blob", b"abc", 3)]


def test_history_has_all_events(spark, tmp_path):
    from mergeloom.plans import history_queries as q
    from mergeloom.plans.versions import dag as history

    rows = [(u, 1000 * u + k, f"2024-01-01 00:{k // 60:02}:{k % 60:02}") for u, n in ((1, 75), (2, 41), (3, 3), (5, 1), (7, 38)) for k in range(n)]
    spark.createDataFrame(rows, "user_id long, event_id long, t string").selectExpr("user_id", "event_id", "CAST(t AS TIMESTAMP) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    nodes, edges, tips = history(spark, str(tmp_path))
    assert nodes.count() == len(rows) and nodes.agg({"level": "max"}).first()[0] == 37
    up = {}
    for e in edges.collect():
        up.setdefault(e.child, set()).add(e.parent)
    want = {(f"{u}:{k // 2}:{k % 2}", f"{u}:{k // 2 - 1}:{j}") for u, i, _ in rows for k in (i - 1000 * u,) for j in (0, 1) if k >= 2 and (j == k % 2 or k // 2 % 3 == 0)}
    assert {(c, p) for c, ps in up.items() for p in ps} == want

    def reach(node):
        seen, todo = set(), [node]
        while todo:
            if (n := todo.pop()) not in seen:
                seen.add(n)
                todo += up.get(n, ())
        return seen

    ends = {1: ("1:37:0", "1:36:1"), 2: ("2:20:0", "2:19:1"), 3: ("3:1:0", "3:0:1"), 7: ("7:18:0", "7:18:1")}
    assert {t.pair: (t.left, t.right) for t in tips.collect()} == ends
    sides = {u: (reach(a), reach(b)) for u, (a, b) in ends.items()}
    assert {tuple(r) for r in q.dag_reachable(spark, str(tmp_path)).collect()} == {(u, len(a), min(a)) for u, (a, b) in sides.items()}
    assert {tuple(r) for r in q.ahead_behind(spark, str(tmp_path)).collect()} == {(u, len(a - b), len(b - a)) for u, (a, b) in sides.items()}
    assert {r.name: r["class"] for r in q.push_classify(spark, str(tmp_path)).collect()} == {1: "no_op", 2: "fast_forward", 3: "non_fast_forward", 7: "non_fast_forward"}
