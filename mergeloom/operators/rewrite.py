"""Rewriting of history: replay of descendants, and plans for describe, squash, split, rebase, cherry-pick and revert.

Commits are rows of schema.COMMITS. A plan is a table (old, new) with the new commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import commit_id
from ..functions.paths import matches_any
from . import trees
from .graph import cut, descendants, edges, levels
from .snapshots import diff

FIELDS = ["tree", "change_id", "items", "parents", "author", "committer", "message"]


def with_ids(commits: DataFrame) -> DataFrame:
    """commits with id computed from their content."""
    return commits.withColumn("id", commit_id(*[F.col(c) for c in FIELDS]))


def affected(commits: DataFrame, edited: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """(id): edited commits (id) and all that descend from them."""
    down = descendants(edges(commits), edited.select(F.lit(0).alias("root"), F.col("id").alias("node")))
    return down.select(F.col("node").alias("id"))


def replay(commits: DataFrame, edited: DataFrame, committer: Column | None = None) -> DataFrame:
    """(old, commits...): edited is (old, and a commit's fields); every descendant follows with its new parents.

    A descendant keeps its change: one without a change id gets its old id as such. Its
    committer is `committer`, if given. A dropped commit has no row of fields (tree null):
    its children take its first parent, as it is by then. Parents come before children by
    levels, one join and one hash a level.
    """
    every = affected(commits, edited.select(F.col("old").alias("id")))
    level = levels(edges(commits), every.select(F.col("id").alias("node")))
    deepest = level.agg(F.max("level")).first()[0]
    own = {"change_id": F.coalesce("change_id", "id"), "committer": F.col("committer") if committer is None else committer}
    originals = commits.select(F.col("id").alias("old"), *[own.get(c, F.col(c)).alias(c) for c in FIELDS])
    new = edited.select(F.col("old"), *[F.col(c).alias("n_" + c) for c in FIELDS], F.lit(True).alias("edited"))
    work = cut(originals.join(level.withColumnRenamed("node", "old"), "old").join(new, "old", "left"))
    done = None
    for i in range(deepest + 1 if deepest is not None else 0):
        rows = work.where(F.col("level") == i)
        fields = [F.when(F.col("edited"), F.col("n_" + c)).otherwise(F.col(c)).alias(c) for c in FIELDS]
        dropped = F.coalesce(F.col("edited") & F.col("n_tree").isNull(), F.lit(False))
        rows = rows.select("old", dropped.alias("dropped"), F.col("parents").alias("was"), *fields).withColumn("parents", F.coalesce("parents", "was"))
        if done is not None:
            known = done.select(F.col("old").alias("p"), F.col("id").alias("q"))
            each = rows.select("old", F.posexplode_outer("parents").alias("k", "p")).join(known, "p", "left")
            moved = each.groupBy("old").agg(F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("k", F.coalesce("q", "p").alias("q"))))).alias("x"))
            rows = rows.join(moved, "old").withColumn("parents", F.array_distinct(F.transform("x", lambda s: s["q"]))).drop("x")
        made = with_ids(rows.where("not dropped"))
        gone = rows.where("dropped").withColumn("id", F.get("parents", F.lit(0)))
        now = cut(made.select("old", "id", "dropped", *FIELDS).union(gone.select("old", "id", "dropped", *FIELDS)))
        done = now if done is None else cut(done.union(now))
    return done if done is not None else work.select("old", F.lit("").alias("id"), F.lit(False).alias("dropped"), *FIELDS).where("false")


def ref_moves(refs: DataFrame, replayed: DataFrame, detached: str | None = None) -> DataFrame:
    """(name, before, after) for refs whose target was rewritten, and for a HEAD that names a commit itself."""
    if detached is not None:
        refs = refs.select("name", "target").union(refs.sparkSession.createDataFrame([("HEAD", detached)], "name string, target string"))
    m = replayed.select(F.col("old").alias("target"), F.col("id").alias("after"))
    return refs.join(m, "target").where("target <> after").select("name", F.col("target").alias("before"), "after")


def describe(commits: DataFrame, target: str | DataFrame, message: str | None = None, committer: Column | None = None) -> DataFrame:
    """Plan: target with another message, its change id kept. A table (id, message) describes many commits."""
    given = commits.sparkSession.createDataFrame([(target, message)], "id string, message string") if isinstance(target, str) else target
    one = commits.drop("message").join(given.select("id", "message"), "id")
    who = F.col("committer") if committer is None else committer
    return replay(commits, one.select(F.col("id").alias("old"), "tree", F.coalesce("change_id", "id").alias("change_id"), "items", "parents", "author", who.alias("committer"), "message"), committer)


def squash(commits: DataFrame, child: str | DataFrame, committer: Column | None = None) -> DataFrame:
    """Plan: child goes into its first parent, which keeps its identity; messages are joined by a blank line, items united.

    A table (id) squashes many commits, none of them the parent of another.
    """
    c = commits.where(F.col("id") == child) if isinstance(child, str) else commits.join(child.select("id"), "id", "left_semi")
    pair = c.select(F.col("tree").alias("c_tree"), F.col("items").alias("c_items"), F.col("message").alias("c_message"), F.get("parents", F.lit(0)).alias("id"))
    if not pair.where("id is null").isEmpty() or pair.isEmpty():
        raise ValueError("a root can't be squashed into a parent")
    none = F.array().cast("array<string>")
    kept = commits.join(pair, "id").select(F.col("id").alias("old"), F.col("c_tree").alias("tree"), F.coalesce("change_id", "id").alias("change_id"), F.array_sort(F.array_union(F.coalesce("items", none), F.coalesce("c_items", none))).alias("items"), "parents", "author", (F.col("committer") if committer is None else committer).alias("committer"), F.concat(F.regexp_replace("message", r"\n+\z", ""), F.lit("\n\n"), "c_message").alias("message"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in commits.select(*FIELDS).dtypes if n != "parents"]
    drop = c.select(F.col("id").alias("old"), *nothing, "parents").select("old", *FIELDS)
    return replay(commits, kept.union(drop), committer)


def split_paths(before: DataFrame, after: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, kind, part): a commit's changed paths, part 1 where a pattern matches, else 2. Raises where a part is empty."""
    out = diff(before, after, ["path"], ["id", "mode"]).select("path", "kind", F.when(matches_any(F.col("path"), patterns), 1).otherwise(2).alias("part"))
    if out.select("part").distinct().count() < 2:
        raise ValueError("one side of the split would be empty")
    return out


def middle_snapshot(before: DataFrame, after: DataFrame, split: DataFrame) -> DataFrame:
    """The snapshot between the two commits of a split: before, with the changes of part 1."""
    first = split.where("part = 1").select("path")
    return before.join(first, "path", "left_anti").unionByName(after.join(first, "path", "left_semi"))


def cherry_pick(target: DataFrame, picked: DataFrame, picked_parent: DataFrame) -> DataFrame:
    """Merge of snapshots that brings what picked changed to target, contents left open."""
    return trees.merge(picked_parent, target, picked)


def revert(target: DataFrame, reverted: DataFrame, reverted_parent: DataFrame) -> DataFrame:
    """Merge of snapshots that takes what reverted changed out of target, contents left open."""
    return trees.merge(reverted, target, reverted_parent)


def rebase(steps: list[tuple[DataFrame, DataFrame]], onto: DataFrame) -> DataFrame:
    """The snapshot after replaying steps (parent, commit), oldest first, on onto; a conflict, or a content to be merged, raises.

    Each step needs the one before, so this is a loop over commits, not over paths.
    """
    now = onto
    for parent, commit in steps:
        merged = cut(trees.merge(parent, now, commit))
        if not merged.where("size(reasons) > 0 or action in ('conflict', 'content')").isEmpty():
            raise ValueError("a step conflicts")
        now = merged.where("id is not null").select("path", "id", "mode", "file_id", "copied_from")
    return now
