"""Whole merges: the contents of paths that both sides changed, and the commits that come of merged snapshots.

A Store is three tables: commits (schema.COMMITS), snapshots (tree and a snapshot's
columns, for each tree that a commit names) and objects. Operations on it return an
Outcome with the rows that they would add; nothing is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import fields, quoted
from ..functions.identity import identity_without_change, object_id
from . import graph, records, rewrite, snapshots, textdiff, trees
from .graph import cut

FILE = ["path", *trees.ENTRY]


class Conflict(ValueError):
    """A merge that had to be clean isn't; paths: those that conflict."""

    def __init__(self, paths: list[str]) -> None:
        super().__init__(f"{len(paths)} path(s) conflict: {', '.join(paths[:5])}")
        self.paths = paths


@dataclass
class Merged:
    """files: path, action, a snapshot's columns, reasons, fields (of a record that conflict); objects: what the merge made."""

    files: DataFrame
    objects: DataFrame

    def snapshot(self) -> DataFrame:
        return self.files.where("id is not null").select(*FILE)

    def conflicts(self) -> DataFrame:
        return self.files.where("size(reasons) > 0").select("path", "reasons", "fields")


def merge_contents(todo: DataFrame, objects: DataFrame, policy: records.Policy | None = None, labels: tuple[str, str, str] = ("ours", "base", "theirs")) -> DataFrame:
    """(path, id, type, payload, why, fields) for todo (path, base_id, our_id, their_id).

    Two records are merged field by field, all else line by line; a missing base is empty.
    why is null for a clean merge, record or content otherwise. Bytes that are no UTF-8
    are a conflict without an id. An object that isn't there, or a base of another type, raises.
    """
    each = todo.select("path", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("id")) for s, c in zip("bot", ("base_id", "our_id", "their_id"), strict=True)])).alias("x")).select("path", "x.side", "x.id").where("id is not null")
    found = each.join(objects.select("id", "type", "payload"), "id", "left")
    found = found.withColumn("type", F.coalesce("type", F.raise_error(F.concat(F.lit("no object "), "id")).cast("string")))
    of = lambda s: F.first(F.when(F.col("side") == s, F.struct("type", "payload")), ignorenulls=True).alias(s)
    three = cut(found.groupBy("path").agg(*map(of, "bot")).withColumn("record", (F.col("o.type") == "record") & (F.col("t.type") == "record")))
    kind = F.when(F.col("record"), "record").otherwise("blob")
    wrong = F.col("b").isNotNull() & (F.col("b.type") != kind)
    three = three.withColumn("b", F.when(wrong, F.raise_error(F.lit("the base has another type")).cast(three.schema["b"].dataType)).otherwise(F.col("b")))

    own = three.where("record")
    split = lambda s: own.where(F.col(s).isNotNull()).select(F.col("path").alias("record_id"), F.explode(fields(F.decode(f"{s}.payload", "UTF-8"))).alias("field", "value"))
    docs = records.merged_records(records.merge_fields(*map(split, "bot"), policy))
    docs = own.select("path").join(docs.withColumnRenamed("record_id", "path"), "path", "left")
    text = F.coalesce("document", F.lit("{}"))
    none = F.array().cast("array<string>")
    rows = docs.select("path", object_id(F.lit("record"), text).alias("id"), F.lit("record").alias("type"), text.cast("binary").alias("payload"), F.when(~F.coalesce("clean", F.lit(True)), "record").alias("why"), F.coalesce("conflicts", none).alias("fields"))

    raw = lambda s: F.col(f"{s}.payload").cast("string")
    sound = F.is_valid_utf8(F.coalesce(raw("b"), F.lit(""))) & F.is_valid_utf8(raw("o")) & F.is_valid_utf8(raw("t"))
    blobs = three.where("not record").select("path", sound.alias("sound"), *[raw(s).alias(s) for s in "bot"])
    merged = blobs.where("sound").select("path", textdiff.merge3_with(labels)("b", "o", "t").alias("m"))
    texts = merged.select("path", object_id(F.lit("blob"), F.col("m.text")).alias("id"), F.lit("blob").alias("type"), F.col("m.text").cast("binary").alias("payload"), F.when(~F.col("m.clean"), "content").alias("why"), none.alias("fields"))
    nil = lambda t: F.lit(None).cast(t)
    odd = blobs.where("not sound").select("path", nil("string").alias("id"), nil("string").alias("type"), nil("binary").alias("payload"), F.lit("content").alias("why"), none.alias("fields"))
    return rows.union(texts).union(odd)


def merge_snapshots(base: DataFrame, ours: DataFrame, theirs: DataFrame, objects: DataFrame, policy: records.Policy | None = None, labels: tuple[str, str, str] = ("ours", "base", "theirs")) -> Merged:
    """A three-way merge of snapshots down to contents.

    action is that of trees.merge, but merged or conflict where both sides changed a
    file's content. A conflict keeps ours, or the text with both sides marked.
    """
    rows = cut(trees.merge_open(base, ours, theirs))
    todo = rows.where("action = 'content'").select("path", "base_id", F.col("id").alias("our_id"), "their_id")
    made = cut(merge_contents(todo, objects, policy, labels))
    new = made.select("path", F.col("id").alias("new_id"), "why", "fields")
    both = rows.join(new, "path", "left")
    action = F.when(F.col("action") != "content", F.col("action")).when(F.col("why").isNull(), "merged").otherwise("conflict")
    none = F.array().cast("array<string>")
    reasons = F.array_sort(F.array_union("reasons", F.when(F.col("why").isNotNull(), F.array("why")).otherwise(none)))
    files = both.select("path", action.alias("action"), F.coalesce("new_id", "id").alias("id"), "mode", "file_id", "copied_from", reasons.alias("reasons"), F.coalesce("fields", none).alias("fields"))
    return Merged(files, made.where("id is not null").select("id", "type", "payload").dropDuplicates(["id"]))


@dataclass
class Store:
    commits: DataFrame
    snapshots: DataFrame
    objects: DataFrame

    def commit(self, id_: str):
        row = self.commits.where(F.col("id") == id_).first()
        if row is None:
            raise KeyError(f"no commit {id_}")
        return row

    def files(self, tree: str | None) -> DataFrame:
        """The snapshot of a tree; null is the empty one."""
        return self.snapshots.where(F.col("tree") == F.lit(tree)).select(*FILE)

    def first_parent_tree(self, id_: str) -> str | None:
        """The tree of a commit's first parent; null for a root."""
        parents = self.commit(id_).parents
        return self.commit(parents[0]).tree if parents else None


@dataclass
class Outcome:
    """kind: up_to_date, fast_forward, merged, or the command; head: the commit that HEAD names then."""

    kind: str
    head: str
    bases: list[str]
    merged: Merged | None = None
    commits: DataFrame | None = None
    tree: str | None = None


def tree_of(files: DataFrame) -> str:
    """The id of a snapshot's top directory."""
    row = trees.build(files.withColumn("root", F.lit("r"))).where("dir = ''").first()
    return row.tree_id if row else trees.empty_tree(files.sparkSession)


def new_commit(store: Store, tree: str, parents: list[str], author: Column, committer: Column, message: str, items: list[str] | None = None) -> DataFrame:
    """One commit of schema.COMMITS with a change id of its own."""
    spark = store.commits.sparkSession
    row = spark.range(1).select(F.lit(tree).alias("tree"), F.lit(items or []).cast("array<string>").alias("items"), F.lit(parents).cast("array<string>").alias("parents"), author.alias("author"), committer.alias("committer"), F.lit(message).alias("message"))
    row = row.withColumn("change_id", identity_without_change(*[F.col(c) for c in ("tree", "items", "parents", "author", "committer", "message")]))
    return cut(rewrite.with_ids(row).select("id", *rewrite.FIELDS))


def signature(name: str, email: str, ts_ms: int, tz_min: int = 0) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(email).alias("email"), F.lit(ts_ms).cast("bigint").alias("ts_ms"), F.lit(tz_min).cast("int").alias("tz_min"))


def _as_column(s) -> Column:
    return signature(s.name, s.email, s.ts_ms, s.tz_min)


def _pair(store: Store, left: str, right: str) -> DataFrame:
    return store.commits.sparkSession.createDataFrame([(0, left, right)], "pair int, left string, right string")


def bases_of(store: Store, history: graph.History, left: str, right: str) -> list[str]:
    return sorted(r.node for r in graph.merge_bases(history, _pair(store, left, right)).collect())  # a few at most


def virtual_base(store: Store, history: graph.History, bases: list[str]) -> DataFrame:
    """One snapshot for several merge bases: folded one by one against a base of their own; a conflict keeps the side so far."""
    now = store.files(store.commit(bases[0]).tree)
    objects = store.objects
    for other in bases[1:]:
        nested = bases_of(store, history, bases[0], other)
        root = store.files(store.commit(nested[0]).tree if nested else None)
        step = merge_snapshots(root, now, store.files(store.commit(other).tree), objects)
        now, objects = cut(step.snapshot()), objects.select("id", "type", "payload").union(step.objects)
    return now


def merge(store: Store, ours: str, theirs: str, author: Column, message: str, committer: Column | None = None, policy: records.Policy | None = None) -> Outcome:
    """Brings theirs into ours. Conflicts are part of the outcome; histories without a common commit raise."""
    history = graph.History(graph.edges(store.commits))
    kind = graph.merge_kind(history, _pair(store, ours, theirs)).first().kind
    if kind == "up_to_date":
        return Outcome(kind, ours, [theirs])
    if kind == "fast_forward":
        return Outcome(kind, theirs, [ours], tree=store.commit(theirs).tree)
    bases = bases_of(store, history, ours, theirs)
    if not bases:
        raise ValueError("the two have no commit in common")
    base = store.files(store.commit(bases[0]).tree) if len(bases) == 1 else virtual_base(store, history, bases)
    got = merge_snapshots(base, store.files(store.commit(ours).tree), store.files(store.commit(theirs).tree), store.objects, policy)
    tree = tree_of(got.snapshot())
    made = new_commit(store, tree, [ours, theirs], author, author if committer is None else committer, message)
    return Outcome("merged", made.first().id, bases, got, made, tree)


def _clean(got: Merged) -> Merged:
    bad = sorted(r.path for r in got.conflicts().select("path").collect())  # an error message
    if bad:
        raise Conflict(bad)
    return got


def cherry_pick(store: Store, revision: str, head: str, committer: Column, policy: records.Policy | None = None) -> Outcome:
    """What revision changed, as a new commit on head; a conflict raises."""
    c = store.commit(revision)
    got = _clean(merge_snapshots(store.files(store.first_parent_tree(revision)), store.files(store.commit(head).tree), store.files(c.tree), store.objects, policy))
    tree = tree_of(got.snapshot())
    made = new_commit(store, tree, [head], _as_column(c.author), committer, c.message, list(c["items"] or []))
    return Outcome("cherry_pick", made.first().id, [], got, made, tree)


def revert(store: Store, revision: str, head: str, message: str, committer: Column, policy: records.Policy | None = None) -> Outcome:
    """head without what revision changed, as a new commit; a conflict raises."""
    c = store.commit(revision)
    got = _clean(merge_snapshots(store.files(c.tree), store.files(store.commit(head).tree), store.files(store.first_parent_tree(revision)), store.objects, policy))
    tree = tree_of(got.snapshot())
    made = new_commit(store, tree, [head], committer, committer, message, list(c["items"] or []))
    return Outcome("revert", made.first().id, [], got, made, tree)


def rebase(store: Store, source: str, onto: str, committer: Column | None = None, policy: records.Policy | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(replayed commits, their snapshots, new objects): source's side of the divergence on onto, and what descends from it.

    Each commit is merged with its first parent as base and that parent's new version, or
    onto, as ours; parents outside the range become onto, once. A conflict raises. A step
    needs the one before, so commits are a loop; paths are not.
    """
    spark = store.commits.sparkSession
    history = graph.History(graph.edges(store.commits))
    span = graph.commits_between(history, _pair(store, onto, source)).select("node")
    level = graph.levels(history.edges, span)
    todo = [r.node for r in level.orderBy("level", "node").collect()]  # the commits that the loop goes through
    inside, new_tree = set(todo), {}
    now: dict[str, DataFrame] = {}
    objects, made, snaps, edits = store.objects.select("id", "type", "payload"), None, None, []
    for id_ in todo:
        c = store.commit(id_)
        parents = list(dict.fromkeys(p if p in inside else onto for p in c.parents)) or [onto]
        ours = now[parents[0]] if parents[0] in inside else store.files(store.commit(onto).tree)
        got = _clean(merge_snapshots(store.files(store.first_parent_tree(id_)), ours, store.files(c.tree), objects, policy))
        files = cut(got.snapshot())
        now[id_], new_tree[id_] = files, tree_of(files)
        objects = cut(objects.union(got.objects).dropDuplicates(["id"]))
        made = got.objects if made is None else made.union(got.objects)
        part = files.select(F.lit(new_tree[id_]).alias("tree"), *FILE)
        snaps = part if snaps is None else snaps.union(part)
        edits.append((id_, new_tree[id_], parents))
    table = spark.createDataFrame(edits, "old string, tree string, parents array<string>")
    kept = store.commits.select(F.col("id").alias("old"), "change_id", "items", "author", "committer", "message")
    who = F.col("committer") if committer is None else committer
    edited = table.join(kept, "old").select("old", "tree", F.coalesce("change_id", "old").alias("change_id"), "items", "parents", "author", who.alias("committer"), "message")
    none = store.snapshots.select("tree", *FILE).limit(0), store.objects.select("id", "type", "payload").limit(0)
    return rewrite.replay(store.commits, edited, committer), none[0] if snaps is None else snaps.distinct(), none[1] if made is None else made.distinct()


def split(store: Store, revision: str, patterns: list[str], committer: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first commit, replay of the second and what descends from it, the first commit's snapshot with its tree).

    The first commit has the changed paths that match, and keeps the change id; the second
    has the rest, and a change id of its own. A part without paths raises.
    """
    c = store.commit(revision)
    before, after = store.files(store.first_parent_tree(revision)), store.files(c.tree)
    middle = cut(rewrite.middle_snapshot(before, after, rewrite.split_paths(before, after, patterns)))
    one = store.commits.where(F.col("id") == revision)
    if committer is not None:
        one = one.withColumn("committer", committer)
    tree = tree_of(middle)
    first = cut(rewrite.with_ids(one.select(F.lit(tree).alias("tree"), F.coalesce("change_id", "id").alias("change_id"), "items", "parents", "author", "committer", "message")).select("id", *rewrite.FIELDS))
    second = one.withColumn("parents", F.array(F.lit(first.first().id)))
    change = identity_without_change(*[F.col(x) for x in ("tree", "items", "parents", "author", "committer", "message")])
    second = second.select(F.col("id").alias("old"), "tree", change.alias("change_id"), "items", "parents", "author", "committer", "message")
    return first, rewrite.replay(store.commits, second, committer), middle.select(F.lit(tree).alias("tree"), *FILE)


def shown_text(type_: Column, payload: Column) -> Column:
    """An object as the text of a diff: a record with a field a line, all else as it stands; empty for null."""
    entries = F.array_sort(F.map_entries(fields(F.decode(payload, "UTF-8"))))
    record = F.concat(F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), e["value"])), "\n"), F.lit("\n"))
    return F.when(payload.isNull(), F.lit("")).when(type_ == "record", record).otherwise(payload.cast("string"))


def diff(left: DataFrame, right: DataFrame, objects: DataFrame) -> DataFrame:
    """(path, text) for each path of two snapshots that differs in content or mode; ordered by path, texts make up the whole diff."""
    rows = snapshots.diff(left, right, ["path"], ["id", "mode"])
    o = objects.select("id", "type", "payload")
    side = lambda s: o.select(F.col("id").alias(f"{s}_id"), shown_text(F.col("type"), F.col("payload")).alias(f"{s}_text"))
    rows = rows.select("path", F.col("l.id").alias("l_id"), F.col("r.id").alias("r_id"), F.col("l.mode").alias("l_mode"), F.col("r.mode").alias("r_mode"))
    both = rows.join(side("l"), "l_id", "left").join(side("r"), "r_id", "left")
    name = lambda s, p: F.when(F.col(f"{s}_id").isNull(), "/dev/null").otherwise(F.concat(F.lit(p), "path"))
    body = textdiff.labelled_udf(F.coalesce("l_text", F.lit("")), F.coalesce("r_text", F.lit("")), name("l", "a/"), name("r", "b/"))
    modes = F.when(F.col("l_mode") != F.col("r_mode"), F.concat(F.lit("old mode "), "l_mode", F.lit("\nnew mode "), "r_mode", F.lit("\n"))).otherwise("")
    return both.select("path", F.concat(modes, F.when(F.col("l_id").eqNullSafe(F.col("r_id")), "").otherwise(body)).alias("text"))


def show(store: Store, revision: str) -> DataFrame:
    """The diff of a commit against its first parent."""
    return diff(store.files(store.first_parent_tree(revision)), store.files(store.commit(revision).tree), store.objects)
