"""Lineage of logical files through a history of snapshots, and the items that touch them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_file_id(snapshots: DataFrame, order: DataFrame) -> DataFrame:
    """(path, file_id): the identity that a path had last; order: commit, seq (0 is the newest)."""
    rows = snapshots.where("file_id is not null").join(order, "commit")
    return rows.groupBy("path").agg(F.min_by("file_id", "seq").alias("file_id"))


def states(snapshots: DataFrame) -> DataFrame:
    """(commit, file_id, paths, id, mode, copied_from): what a commit has of a file; the first path's entry stands for it."""
    entry = F.struct("path", "id", "mode", "copied_from")
    rows = snapshots.where("file_id is not null").groupBy("commit", "file_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    first = F.element_at("e", 1)
    return rows.select("commit", "file_id", F.transform("e", lambda x: x["path"]).alias("paths"), first["id"].alias("id"), first["mode"].alias("mode"), first["copied_from"].alias("copied_from"))


def trace(snapshots: DataFrame, parents: DataFrame) -> DataFrame:
    """(commit, file_id, kind, paths, copied_from): changes of each file against the first parent.

    parents: commit, parent (null for a root). A merge repeats what its second parent
    changed. kind: added, deleted, moved or modified.
    """
    own = states(snapshots)
    now = own.select("commit", "file_id", F.struct("paths", "id", "mode", "copied_from").alias("now"))
    before = own.withColumnRenamed("commit", "parent").join(parents.where("parent is not null"), "parent").select("commit", "file_id", F.struct("paths", "id", "mode").alias("was"))
    both = now.join(before, ["commit", "file_id"], "full")
    same_paths = F.col("now.paths") == F.col("was.paths")
    same = same_paths & (F.col("now.id") == F.col("was.id")) & (F.col("now.mode") == F.col("was.mode"))
    kind = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "added").when(~same_paths, "moved").when(~same, "modified")
    return both.withColumn("kind", kind).where("kind is not null").select("commit", "file_id", "kind", F.coalesce("now.paths", "was.paths").alias("paths"), "now.copied_from")


def items_touching(commits: DataFrame, links: DataFrame, latest: DataFrame, traces: DataFrame, span: DataFrame) -> DataFrame:
    """(item): items that a span of commits names, or whose linked paths' files it changed.

    commits: id, items; links: item, path; latest: path, file_id; span: commit.
    """
    named = commits.withColumnRenamed("id", "commit").join(span, "commit", "left_semi").select(F.explode("items").alias("item"))
    changed = traces.join(span, "commit", "left_semi").select("file_id").distinct()
    linked = links.join(latest, "path").join(changed, "file_id", "left_semi").select("item")
    return named.union(linked).distinct()


def files_of_item(commits: DataFrame, links: DataFrame, latest: DataFrame, traces: DataFrame) -> DataFrame:
    """(item, file_id, path): files that an item is linked with, or that commits naming it changed; path: its linked or latest one.

    latest: path, file_id, the newest identity of each path.
    """
    linked = links.join(latest, "path").select("item", "file_id", "path")
    named = commits.select(F.col("id").alias("commit"), F.explode("items").alias("item")).join(traces.select("commit", "file_id").distinct(), "commit").select("item", "file_id").distinct()
    known = named.join(latest, "file_id", "left").select("item", "file_id", "path")
    return linked.union(known).distinct()


def changes_of_item(commits: DataFrame, links: DataFrame, latest: DataFrame, traces: DataFrame) -> DataFrame:
    """(item, change_id): changes that name an item or changed one of its linked files."""
    change = commits.select(F.col("id").alias("commit"), F.coalesce("change_id", "id").alias("change_id"), "items")
    named = change.select(F.explode("items").alias("item"), "change_id")
    linked = links.join(latest, "path").join(traces.select("file_id", "commit").distinct(), "file_id").join(change, "commit").select("item", "change_id")
    return named.union(linked).distinct()
