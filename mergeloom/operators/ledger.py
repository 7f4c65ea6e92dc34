"""Ledgers of changes, merge previews and the audit of identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import stripped


def change_kind(status: Column) -> Column:
    """created for added, renamed and copied paths, deleted, else modified."""
    s = F.substring(stripped(status), 1, 1)
    return F.when(s.isin("A", "R", "C"), "created").when(s == "D", "deleted").otherwise("modified")


def items_in_range(changes: DataFrame) -> DataFrame:
    """(id, kind, path, commits): changes (id, seq, kind, path, sha), oldest first by seq.

    The first change gives kind and path; any deletion after it makes the item deleted
    for good. commits are newest first. Only per-item minima and the list itself are kept.
    """
    g = changes.groupBy("id").agg(F.min_by("kind", "seq").alias("first"), F.min_by("path", "seq").alias("path"), F.max(F.col("kind") == "deleted").alias("gone"), F.sort_array(F.collect_list(F.struct("seq", "sha")), asc=False).alias("c"))
    return g.select("id", F.when(F.col("gone"), "deleted").otherwise(F.col("first")).alias("kind"), "path", F.transform("c", lambda x: x["sha"]).alias("commits"))


def ledger_totals(items: DataFrame) -> DataFrame:
    return items.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("created", "modified", "deleted")])


def candidates(fields: DataFrame) -> DataFrame:
    """(path, conflicts, ours_present, theirs_present): records of merged fields (records.merge_fields) that both sides changed."""
    changed = lambda side: F.max(~F.col(side).eqNullSafe(F.col("base")))
    g = fields.groupBy(F.col("record_id").alias("path")).agg(F.count_if("conflict").alias("conflicts"), (F.count("ours") > 0).alias("ours_present"), (F.count("theirs") > 0).alias("theirs_present"), changed("ours").alias("oc"), changed("theirs").alias("tc"))
    return g.where("oc and tc").drop("oc", "tc")


def preview(paths: DataFrame) -> DataFrame:
    """(path, resolution): what a merge would do with paths that both sides changed.

    paths: path, driver (null where none is set), ours_present, theirs_present,
    conflicts (number of fields), unions (number of fields), stream (null or strategy).
    """
    r = F.when(F.col("driver").isNull(), "unprotected").when(~F.col("ours_present") | ~F.col("theirs_present"), "delete_modify").when(F.col("stream").isNotNull(), F.when(F.col("stream") == "union_reanchor", "union").otherwise("clean")).when(F.col("conflicts") > 0, "conflict").when(F.col("unions") > 0, "union").otherwise("clean")
    return paths.select("path", r.alias("resolution"))


def preview_totals(previews: DataFrame, strict: bool = False) -> DataFrame:
    """Counts by resolution, and how many block the merge."""
    kinds = ("clean", "union", "conflict", "delete_modify", "unprotected")
    blocking = ("conflict", "delete_modify", *(["unprotected"] if strict else []))
    return previews.agg(*[F.count_if(F.col("resolution") == k).alias(k) for k in kinds], F.count_if(F.col("resolution").isin(*blocking)).alias("blocking"))


def identities(objects: DataFrame) -> DataFrame:
    """(email, bad): addresses in the headers of commits and tags (type, text), each once; bad: objects without exactly the roles they need."""
    head = F.split(F.substring_index("text", "\n\n", 1), "\n")
    role = lambda r: F.filter(head, lambda x: x.startswith(r + " "))
    sound = F.when(F.col("type") == "tag", F.size(role("tagger")) == 1).otherwise((F.size(role("author")) == 1) & (F.size(role("committer")) == 1))
    lines = F.concat(role("author"), role("committer"), role("tagger"))
    each = objects.select(F.explode_outer(lines).alias("line"), sound.alias("sound"))
    return each.select(F.regexp_extract("line", "<([^<>]*)>", 1).alias("email"), (~F.col("sound")).alias("bad")).groupBy("email").agg(F.max("bad").alias("bad"))


def not_allowed(found: DataFrame, allowed: DataFrame, key: str = "email") -> DataFrame:
    return found.select(key).distinct().join(allowed.select(key), key, "left_anti")


def verdict(checks: DataFrame, most: int = 5) -> DataFrame:
    """One row: ok, and the names of the first failed checks (name, passed), in order, most of them."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    return checks.agg(F.coalesce(F.min("passed"), F.lit(True)).alias("ok"), F.slice(failed, 1, most).alias("failed"), F.count_if(~F.col("passed")).alias("n_failed"))


def fence_coverage(expected: DataFrame, committed: DataFrame) -> DataFrame:
    """(pattern, problem): expected patterns that aren't committed, committed ones that aren't expected."""
    lost = expected.join(committed, "pattern", "left_anti").select("pattern", F.lit("missing").alias("problem"))
    return lost.union(committed.join(expected, "pattern", "left_anti").select("pattern", F.lit("stale").alias("problem")))
