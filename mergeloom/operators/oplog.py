"""The operation log, and compare-and-swap of refs as validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import stripped
from ..schema import OPLOG


def parse(lines: DataFrame) -> DataFrame:
    """Receipts of a JSON-lines log (line); blank and unreadable lines are skipped."""
    got = lines.where(stripped(F.col("line")) != "").select(F.from_json("line", OPLOG).alias("r"))
    return got.select("r.*").where("sequence is not null and command is not null")


def latest(log: DataFrame, n: int) -> DataFrame:
    """The newest n receipts, newest first."""
    return log.orderBy(F.desc("sequence")).limit(n)


def next_sequence(log: DataFrame) -> int:
    return (log.agg(F.max("sequence")).first()[0] or 0) + 1


def reversal(log: DataFrame) -> DataFrame:
    """Each receipt's refs with before and after exchanged, in reverse order."""
    turned = F.transform(F.reverse("refs"), lambda r: F.struct(r["ref"].alias("ref"), r["after"].alias("before"), r["before"].alias("after")))
    return log.select("sequence", "command", turned.alias("refs"))


def cas_problems(proposed: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, problem): updates (ref, expected, after) that can't be made; none means that all can be.

    ref_changed: the ref isn't where the update expects it; duplicate_ref_update: named twice.
    """
    now = refs.select(F.col("name").alias("ref"), "target")
    moved = proposed.join(now, "ref", "left").where(~F.col("expected").eqNullSafe(F.col("target"))).select("ref", F.lit("ref_changed").alias("problem"))
    twice = proposed.groupBy("ref").agg(F.count("*").alias("n")).where("n > 1").select("ref", F.lit("duplicate_ref_update").alias("problem"))
    return moved.union(twice).distinct()


def applied(refs: DataFrame, proposed: DataFrame) -> DataFrame:
    """refs after the updates; a null after deletes."""
    new = proposed.select(F.col("ref").alias("name"), F.col("after").alias("target"))
    return refs.join(new.select("name"), "name", "left_anti").union(new.where("target is not null"))


def resolve(names: DataFrame, refs: DataFrame, commits: DataFrame) -> DataFrame:
    """(name, id): a commit id, a full ref, a branch, a tag or a remote branch, the first that is there."""
    forms = ["{}", "refs/heads/{}", "refs/tags/{}", "refs/remotes/{}"]
    tries = names.select("name", F.posexplode(F.array(*[F.concat(F.lit(f.split("{")[0]), F.col("name")) for f in forms])).alias("rank", "ref"))
    hits = tries.join(refs.select(F.col("name").alias("ref"), "target"), "ref").select("name", F.col("rank") + 1, "target")
    ids = names.join(commits.select(F.col("id").alias("name")), "name", "left_semi").select("name", F.lit(0), F.col("name").alias("target"))
    return ids.union(hits.toDF("name", "rank", "target")).toDF("name", "rank", "target").groupBy("name").agg(F.min_by("target", "rank").alias("id"))
