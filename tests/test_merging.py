"""Whole merges and the commits that come of them."""

import json

import pytest
from pyspark.sql import functions as F

from mergeloom.functions import identity
from mergeloom.operators import merging, records, rewrite

SNAP = "path string, id string, mode string, file_id string, copied_from string"


class Repo:
    """Contents go in by path; ids come out."""

    def __init__(self, spark):
        self.spark, self.objects, self.trees, self.commits = spark, {}, {}, []
        self.who = merging.signature("w", "w@x", 5)

    def put(self, content):
        kind, raw = ("record", json.dumps(content, separators=(",", ":"), sort_keys=True).encode()) if isinstance(content, dict) else ("blob", content if isinstance(content, bytes) else content.encode())
        import hashlib

        oid = hashlib.sha256(f"{kind} {len(raw)}\0".encode() + raw).hexdigest()
        self.objects[oid] = (kind, raw)
        return oid

    def snap(self, files):
        return self.spark.createDataFrame([(p, self.put(c), "100644", None, None) for p, c in files.items()], SNAP)

    def commit(self, files, *parents, message="m", items=()):
        s = self.snap(files)
        tree = merging.tree_of(s)
        self.trees[tree] = [tuple(r) for r in s.collect()]
        row = merging.new_commit(self.store(), tree, list(parents), self.who, self.who, message, list(items)).first()
        self.commits.append(row)
        return row.id

    def store(self):
        from mergeloom.schema import COMMITS

        names = [c.split(":")[0] for c in ("id", "tree", "change_id", "items", "parents", "author", "committer", "message")]
        commits = self.spark.createDataFrame([tuple(c[n] for n in names) for c in self.commits], COMMITS)
        snaps = self.spark.createDataFrame([(t, *f) for t, fs in self.trees.items() for f in fs], "tree string, " + SNAP)
        return merging.Store(commits, snaps, self.object_table())

    def object_table(self):
        return self.spark.createDataFrame([(i, k, bytearray(p)) for i, (k, p) in self.objects.items()], "id string, type string, payload binary")

    def text(self, merged, path):
        row = {r.path: r for r in merged.files.collect()}[path]
        made = {r.id: bytes(r.payload) for r in merged.objects.collect()}
        return row, made.get(row.id, self.objects.get(row.id, (None, None))[1])


@pytest.fixture
def repo(spark):
    return Repo(spark)


def test_contents(repo):
    base = {"rec": {"a": 1, "b": [1]}, "text": "1\n2\n3\n", "fight": "x\n", "raw": b"\xff\xfe", "clash": {"a": 1}, "kind": "t"}
    ours = {"rec": {"a": 2, "b": [1, 2]}, "text": "one\n2\n3\n", "fight": "mine\n", "raw": b"\xff\x00", "clash": {"a": 2}, "kind": "u", "both": "same\n", "new": "o\n", "fresh": {"k": 1}}
    theirs = {"rec": {"a": 1, "b": [1, 3], "c": None}, "text": "1\n2\nthree\n", "fight": "yours\n", "raw": b"\xff\x01", "clash": {"a": 3}, "kind": "v", "both": "same\n", "new": "t\n", "fresh": {"l": 2}}
    snaps = [repo.snap(x) for x in (base, ours, theirs)]
    got = merging.merge_snapshots(*snaps, repo.object_table())
    row, raw = repo.text(got, "rec")
    assert (row.action, row.reasons, json.loads(raw)) == ("merged", [], {"a": 2, "b": [1, 2, 3], "c": None})
    row, raw = repo.text(got, "text")
    assert (row.action, raw) == ("merged", b"one\n2\nthree\n")
    row, raw = repo.text(got, "fight")
    assert (row.action, row.reasons) == ("conflict", ["content"]) and raw.startswith(b"<<<<<<< ours\nmine\n|||||||")
    row, raw = repo.text(got, "raw")
    assert (row.action, row.reasons, raw) == ("conflict", ["content"], b"\xff\x00")
    row, raw = repo.text(got, "clash")
    assert (row.action, row.reasons, row.fields, json.loads(raw)) == ("conflict", ["record"], ["a"], {"a": 2})
    assert repo.text(got, "both")[0].action == "agree"
    row, raw = repo.text(got, "new")
    assert (row.action, row.reasons) == ("conflict", ["content"]) and b"||||||| base\n=======" in raw
    assert json.loads(repo.text(got, "fresh")[1]) == {"k": 1, "l": 2}
    assert {r.path for r in got.conflicts().collect()} == {"fight", "raw", "clash", "new", "kind"}
    checked = got.objects.withColumn("ok", F.col("id") == identity.object_id(F.col("type"), F.col("payload")))
    assert checked.where("not ok").count() == 0
    later = merging.merge_snapshots(*snaps, repo.object_table(), records.Policy({"a": "set"}))
    assert json.loads(repo.text(later, "clash")[1]) == {"a": [2, 3]}


def test_errors(repo, spark):
    base, ours, theirs = (repo.snap({"p": c}) for c in ("a\n", {"x": 1}, {"x": 2}))
    with pytest.raises(Exception, match="another type"):
        merging.merge_snapshots(base, ours, theirs, repo.object_table()).files.collect()
    with pytest.raises(Exception, match="no object"):
        merging.merge_snapshots(base, repo.snap({"p": "b\n"}), repo.snap({"p": "c\n"}), repo.object_table().limit(0)).files.collect()


def test_merge_commits(repo):
    root = repo.commit({"f": "1\n2\n3\n", "d/g": "g\n"})
    a = repo.commit({"f": "one\n2\n3\n", "d/g": "g\n"}, root)
    b = repo.commit({"f": "1\n2\nthree\n", "d/g": "g\n", "new": "n\n"}, root)
    other = repo.commit({"z": "z\n"})
    s = repo.store()
    got = merging.merge(s, a, b, repo.who, "both")
    assert (got.kind, got.bases) == ("merged", [root]) and got.merged.conflicts().count() == 0
    row = got.commits.first()
    want = merging.tree_of(repo.snap({"f": "one\n2\nthree\n", "d/g": "g\n", "new": "n\n"}))
    assert (row.tree, list(row.parents), got.head) == (want, [a, b], row.id)
    again = rewrite.with_ids(got.commits.drop("id")).first()
    assert again.id == row.id and row.change_id != row.id
    assert (merging.merge(s, a, root, repo.who, "").kind, merging.merge(s, root, a, repo.who, "").head) == ("up_to_date", a)
    with pytest.raises(ValueError, match="in common"):
        merging.merge(s, a, other, repo.who, "")


def test_criss_cross(repo):
    """With two bases, what both of them have doesn't come back."""
    root = repo.commit({"f": "1\n2\n3\n"})
    a = repo.commit({"f": "A\n2\n3\n"}, root)
    b = repo.commit({"f": "1\n2\nB\n"}, root)
    m1 = repo.commit({"f": "A\n2\nB\n"}, a, b)
    m2 = repo.commit({"f": "A\n2\nB\n"}, b, a, message="m2")
    left = repo.commit({"f": "A\nleft\nB\n"}, m1)
    right = repo.commit({"f": "A\n2\nB\nmore\n"}, m2)
    got = merging.merge(repo.store(), left, right, repo.who, "x")
    assert sorted(got.bases) == sorted([a, b])
    assert repo.text(got.merged, "f")[1] in (b"A\nleft\nB\nmore\n",)


def test_pick_and_revert(repo):
    root = repo.commit({"f": "1\n2\n3\n"})
    c = repo.commit({"f": "1\n2\nthree\n", "n": "n\n"}, root, message="change", items=["i"])
    head = repo.commit({"f": "one\n2\n3\n"}, root)
    s = repo.store()
    got = merging.cherry_pick(s, c, head, merging.signature("p", "p@x", 9))
    row = got.commits.first()
    assert row.tree == merging.tree_of(repo.snap({"f": "one\n2\nthree\n", "n": "n\n"}))
    assert (row.message, list(row["items"]), list(row.parents), row.author.name, row.committer.name) == ("change", ["i"], [head], "w", "p")
    back = merging.revert(s, c, c, "undo", repo.who).commits.first()
    assert back.tree == s.commit(root).tree and list(back.parents) == [c]
    fight = repo.commit({"f": "1\n2\ndrei\n"}, root)
    with pytest.raises(merging.Conflict, match="f"):
        merging.cherry_pick(repo.store(), c, fight, repo.who)


def test_rebase(repo):
    root = repo.commit({"f": "1\n2\n3\n"})
    onto = repo.commit({"f": "one\n2\n3\n", "o": "o\n"}, root)
    c1 = repo.commit({"f": "1\n2\n3\n", "a": "a\n"}, root, message="c1")
    c2 = repo.commit({"f": "1\n2\nthree\n", "a": "a\n"}, c1, message="c2")
    beyond = repo.commit({"f": "1\n2\nthree\n", "a": "b\n"}, c2, message="c3")
    done, snaps, made = merging.rebase(repo.store(), c2, onto, merging.signature("r", "r@x", 7))
    rows = {r.old: r for r in done.collect()}
    assert set(rows) == {c1, c2, beyond}
    assert list(rows[c1].parents) == [onto] and list(rows[c2].parents) == [rows[c1].id] and list(rows[beyond].parents) == [rows[c2].id]
    assert rows[c2].tree == merging.tree_of(repo.snap({"f": "one\n2\nthree\n", "a": "a\n", "o": "o\n"}))
    assert rows[beyond].tree == repo.store().commit(beyond).tree and rows[c1].change_id == repo.store().commit(c1).change_id
    assert {rows[x].committer.name for x in rows} == {"r"} and {r.tree for r in snaps.collect()} == {rows[c1].tree, rows[c2].tree} and made.count() == 1
    refs = repo.spark.createDataFrame([("refs/heads/x", c2), ("refs/heads/y", onto)], "name string, target string")
    moves = {(r.name, r.before, r.after) for r in rewrite.ref_moves(refs, done, detached=c1).collect()}
    assert moves == {("refs/heads/x", c2, rows[c2].id), ("HEAD", c1, rows[c1].id)}
    nothing, _, _ = merging.rebase(repo.store(), root, onto)
    assert nothing.collect() == []


def test_split(repo):
    root = repo.commit({"keep": "k\n"})
    c = repo.commit({"keep": "k\n", "src/a": "a\n", "doc/b": "b\n"}, root, message="two things")
    later = repo.commit({"keep": "k\n", "src/a": "a2\n", "doc/b": "b\n"}, c)
    first, rest, middle = merging.split(repo.store(), c, ["src/**"])
    one, rows = first.first(), {r.old: r for r in rest.collect()}
    assert {r.path for r in middle.collect()} == {"keep", "src/a"} and list(one.parents) == [root]
    assert list(rows[c].parents) == [one.id] and rows[c].tree == repo.store().commit(c).tree and rows[c].change_id != one.change_id
    assert list(rows[later].parents) == [rows[c].id]
    with pytest.raises(ValueError, match="empty"):
        merging.split(repo.store(), c, ["nowhere/**"])


def test_diff_and_show(repo):
    root = repo.commit({"t": "a\nb\n", "r": {"b": 1, "a": "x"}, "gone": "g\n", "same": "s\n"})
    c = repo.commit({"t": "a\nB\n", "r": {"b": 2, "a": "x"}, "same": "s\n"}, root)
    got = {r.path: r.text for r in merging.show(repo.store(), c).collect()}
    assert got == {
        "t": "--- a/t\n+++ b/t\n@@ -1,2 +1,2 @@\n a\n-b\n+B\n",
        "r": '--- a/r\n+++ b/r\n@@ -1,2 +1,2 @@\n "a": "x"\n-"b": 1\n+"b": 2\n',
        "gone": "--- a/gone\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-g\n",
    }
    assert set(r.path for r in merging.show(repo.store(), root).collect()) == {"t", "r", "gone", "same"}
    left, right = (repo.snap({"x": "1\n"}).withColumn("mode", F.lit(m)) for m in ("100644", "100755"))
    assert merging.diff(left, right, repo.object_table()).first().text == "old mode 100644\nnew mode 100755\n"
