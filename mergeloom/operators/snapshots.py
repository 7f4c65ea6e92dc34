"""Comparison of keyed snapshots: two-way, three sections of a status, classes, moves and copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import prunable


def beside(left: DataFrame, right: DataFrame, key: list[str], values: list[str], names: tuple[str, str] = ("l", "r"), how: str = "full") -> DataFrame:
    """key, and the values of both sides as structs; a side without the key is null."""
    a = left.select(*key, F.struct(*values).alias(names[0]))
    b = right.select(*key, F.struct(*values).alias(names[1]))
    return a.join(b, key, how)


def three_beside(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """key, and the values of three sides as structs b, o and t.

    One shuffle and one sort of the sides' union; keys are unique on a side, so nothing is
    to be gained by summing before the shuffle. A key that a side has twice raises.
    """
    sides = [d.select(*key, *[(F.struct(*values) if s == n else F.lit(None)).alias(n) for n in "bot"]) for s, d in zip("bot", (base, ours, theirs), strict=True)]
    every = sides[0].unionByName(sides[1]).unionByName(sides[2]).repartition(*key)
    both = every.groupBy(*key).agg(*[F.first(n, ignorenulls=True).alias(n) for n in "bot"], F.greatest(*[F.count(n) for n in "bot"]).alias("most"))
    one = lambda n: F.when(F.col("most") <= 1, F.col(n)).otherwise(F.raise_error(F.lit("a side has a key twice"))).alias(n)
    return both.select(*key, one("b"), "o", "t")


def kind_of(before: Column, after: Column, same: Column) -> Column:
    """added, deleted, modified, or null where nothing changed."""
    return F.when(before.isNull() & after.isNotNull(), "added").when(before.isNotNull() & after.isNull(), "deleted").when(~same, "modified")


def diff(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, kind, l, r) where the snapshots differ; nulls are values like others."""
    both = beside(left, right, key, values).withColumn("kind", kind_of(F.col("l"), F.col("r"), F.col("l").eqNullSafe(F.col("r"))))
    return both.where("kind is not null")


def compare(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, class): same, differing, missing (left only) or extra (right only)."""
    both = beside(left, right, key, values)
    cls = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(F.col("l").eqNullSafe(F.col("r")), "same").otherwise("differing")
    return both.select(*key, cls.alias("class"))


def status(head: DataFrame, index: DataFrame, working: DataFrame) -> DataFrame:
    """(section, path, kind): staged is head to index, unstaged index to working tree, untracked not in the index.

    All have path, id and mode; file identities play no part here.
    """
    staged = diff(head, index, ["path"], ["id", "mode"]).select(F.lit("staged").alias("section"), "path", "kind")
    left = beside(index, working, ["path"], ["id", "mode"], how="left")
    unstaged = left.withColumn("kind", kind_of(F.col("l"), F.col("r"), F.col("l").eqNullSafe(F.col("r")))).where("kind is not null").select(F.lit("unstaged").alias("section"), "path", "kind")
    untracked = working.join(index.select("path"), "path", "left_anti").select(F.lit("untracked").alias("section"), "path", F.lit("added").alias("kind"))
    return staged.union(unstaged).union(untracked)


def overwrite_risks(dirty: DataFrame, untracked: DataFrame, current: DataFrame, target: DataFrame) -> DataFrame:
    """(path, reason): what a switch from current to target would lose."""
    moved = diff(current, target, ["path"], ["id"]).select("path")
    changed = dirty.join(moved, "path", "left_semi").select("path", F.lit("dirty").alias("reason"))
    covered = untracked.join(target.select("path"), "path", "left_semi").select("path", F.lit("untracked").alias("reason"))
    return changed.union(covered)


def materialise_plan(index: DataFrame, target: DataFrame) -> DataFrame:
    """(path, action): write what target has, delete what only the index owns."""
    write = target.select("path", F.lit("write").alias("action"))
    return write.union(index.join(target.select("path"), "path", "left_anti").select("path", F.lit("delete").alias("action")))


def emptied_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """(folder): folders (path) below which no file (path) is left, and none that is never entered."""
    part = F.split("path", "/")
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(part)), lambda n: F.array_join(F.slice(part, F.lit(1), n - 1), "/"))).alias("folder"))
    last = F.element_at(part, -1)
    own = F.transform(F.sequence(F.lit(1), F.size(part)), lambda n: F.array_join(F.slice(part, F.lit(1), n), "/"))
    fixed = folders.where(prunable(last)).select(F.explode(own).alias("folder"))
    held = above.union(fixed).where("folder <> ''").distinct()
    return folders.select(F.col("path").alias("folder")).distinct().join(held, "folder", "left_anti")


def moves_and_copies(old: DataFrame, new: DataFrame, still_there: DataFrame) -> DataFrame:
    """(path, source, kind, file_id, copied_from) for new paths that come from exactly one old entry.

    By the file's place on disk (dev, ino) if one old entry has it, else by content and
    mode if one old entry has those. A source that is gone has moved and keeps its
    identity; one that is still there was copied. Counting the old entries of a key
    before the join keeps every match to one row.
    """

    def single(keys: list[str]) -> DataFrame:
        one = old.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys)
        return one.agg(F.count("*").alias("n"), F.min(F.struct("path", "file_id")).alias("s")).where("n = 1").drop("n")

    by_place, by_content = single(["dev", "ino"]).withColumnRenamed("s", "s1"), single(["id", "mode"]).withColumnRenamed("s", "s2")
    found = new.join(by_place, ["dev", "ino"], "left").join(by_content, ["id", "mode"], "left").withColumn("s", F.coalesce("s1", "s2")).where("s is not null")
    here = still_there.select(F.col("path").alias("source"), F.lit(True).alias("here"))
    out = found.select("path", F.col("s.path").alias("source"), F.col("s.file_id").alias("origin")).join(here, "source", "left")
    moved = F.col("here").isNull()
    return out.select("path", "source", F.when(moved, "move").otherwise("copy").alias("kind"), F.when(moved, F.col("origin")).alias("file_id"), F.when(~moved, F.col("origin")).alias("copied_from"))


#: Nanoseconds after a change during which an equal stat proves nothing.
SETTLED_NS = 2_000_000_000


def settled(stat: Column) -> Column:
    """An observation made long enough after the file's last change to be trusted."""
    return stat["observed_ns"] - F.greatest(stat["ctime_ns"], stat["mtime_ns"]) >= SETTLED_NS


def content_unchanged(known: Column, now: Column) -> Column:
    """Two stats show the same file, both conditions on age hold, and its content needn't be read; false without a known one."""
    same = [known[c] == now[c] for c in ("size", "mtime_ns", "ctime_ns", "dev", "ino")]
    every = settled(known) & (now["observed_ns"] - known["observed_ns"] >= SETTLED_NS)
    for s in same:
        every = every & s
    return F.coalesce(every, F.lit(False))
