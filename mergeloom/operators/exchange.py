"""Exchange of histories: what to send, bundles as text, verified import and planning of refs."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import is_object_id, object_id
from ..schema import KINDS
from .graph import closure, only_left, reachable

FORMAT = "bundle 1"


def verified(objects: DataFrame) -> DataFrame:
    """objects (id, type, payload) with sound: the id is the hash of the framed payload."""
    return objects.withColumn("sound", F.col("type").isin(*KINDS) & F.col("id").eqNullSafe(object_id(F.col("type"), F.col("payload"))))


def verify(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, outcome) for wanted (id): verified, corrupt or missing."""
    found = wanted.select("id").distinct().join(verified(objects).select("id", "sound"), "id", "left")
    return found.select("id", F.when(F.col("sound").isNull(), "missing").when(F.col("sound"), "verified").otherwise("corrupt").alias("outcome"))


def new_objects(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """The incoming objects that the store lacks, each once; those whose id is not their hash raise."""
    checked = verified(incoming)
    safe = F.when(F.col("sound"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("content doesn't have the id "), F.coalesce("id", F.lit("null")))).cast("string"))
    return checked.withColumn("id", safe).drop("sound").join(store.select("id"), "id", "left_anti").dropDuplicates(["id"])


def export_set(edges: DataFrame, contains: DataFrame, heads: DataFrame, since: DataFrame) -> DataFrame:
    """(id): commits that heads (id) reach and since (id) doesn't, with all that they contain."""
    of = lambda pair, c: pair.select(F.lit(0).alias("root"), F.lit(c).alias("side"), F.col("id").alias("node"))
    both = of(heads, "l").union(of(since, "r")).select(F.struct("root", "side").alias("root"), "node")
    commits = only_left(edges, both).select(F.lit(0).alias("root"), "node")
    return closure(contains, commits).select(F.col("node").alias("id")).distinct()


def import_report(incoming: DataFrame, store: DataFrame, prerequisites: DataFrame) -> DataFrame:
    """(id, outcome): added or skipped for incoming objects, missing for prerequisites that neither side has."""
    have = store.select("id", F.lit(True).alias("have"))
    lines = incoming.select("id").distinct().join(have, "id", "left").select("id", F.when(F.col("have"), "skipped").otherwise("added").alias("outcome"))
    lost = prerequisites.select("id").distinct().join(store.select("id"), "id", "left_anti").join(incoming.select("id"), "id", "left_anti")
    return lines.union(lost.select("id", F.lit("missing").alias("outcome")))


def bundle_lines(objects: DataFrame, refs: dict[str, str], prerequisites: list[str]) -> DataFrame:
    """(part, id, line) of a bundle: marker, header and a line for each object; ordered by part, then id.

    Objects aren't listed in the header: their own lines name them, so no row grows with them.
    """
    spark = objects.sparkSession
    compact = {"separators": (",", ":"), "ensure_ascii": False}
    text = f'{{"refs":{json.dumps(refs, **compact)},"prerequisites":{json.dumps(sorted(prerequisites), **compact)}}}'
    head = spark.createDataFrame([(0, "", FORMAT), (1, "", text)], "part int, id string, line string")
    body = objects.select(F.lit(2).alias("part"), "id", F.concat_ws(" ", "type", "id", F.replace(F.replace(F.base64(F.col("payload").cast("binary")), F.lit("\r")), F.lit("\n"))).alias("line"))
    return head.union(body)


def parsed_line(line: Column) -> Column:
    """struct(id, type, payload, problem) of an object line; problem is null for a sound one."""
    part = F.split(line, " ")
    kind, oid, raw = F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.try_to_binary(F.get(part, F.lit(2)), F.lit("base64"))
    problem = F.when(F.size(part) != 3, "not three fields").when(~kind.isin(*KINDS), "unknown type").when(~is_object_id(oid), "no object id").when(~object_id(kind, raw).eqNullSafe(oid), "other content")
    return F.struct(oid.alias("id"), kind.alias("type"), raw.alias("payload"), problem.alias("problem"))


class BadBundle(ValueError):
    """Text that is no bundle."""


def parse_header(marker: str, header: str) -> dict:
    """A bundle's refs and prerequisites, checked as untrusted input."""
    if marker != FORMAT:
        raise BadBundle("no bundle")
    try:
        got = json.loads(header)
    except ValueError as e:
        raise BadBundle("the header is no JSON") from e
    good = lambda x: isinstance(x, str) and len(x) == 64 and set(x) <= set("0123456789abcdef")
    if not isinstance(got, dict) or not isinstance(got.get("refs"), dict):
        raise BadBundle("the header has no refs")
    if not all(map(good, got["refs"].values())):
        raise BadBundle("a ref's target is no object id")
    before = got.get("prerequisites", [])
    if not isinstance(before, list) or not all(map(good, before)):
        raise BadBundle("a prerequisite is no object id")
    return {"refs": got["refs"], "prerequisites": before}


def encoded_line(kind: str, oid: str, payload: bytes) -> str:
    return f"{kind} {oid} {base64.b64encode(payload).decode()}"


def plan_fetch(remote: DataFrame, local: DataFrame) -> DataFrame:
    """(name, target, expected, decision) for a remote's refs (name, target): equal, new, update or conflict (a tag never moves)."""
    both = remote.join(local.select("name", F.col("target").alias("expected")), "name", "left")
    tag = F.col("name").startswith("refs/tags/")
    d = F.when(F.col("expected").isNull(), "new").when(F.col("expected") == F.col("target"), "equal").when(tag, "conflict").otherwise("update")
    return both.select("name", "target", "expected", d.alias("decision"))


def classify_push(updates: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, class) of updates (name, before, after): create, no_op, fast_forward or non_fast_forward."""
    up = reachable(edges, updates.where("before is not null and before <> after").select(F.col("name").alias("root"), F.col("after").alias("node")))
    hit = up.select(F.col("root").alias("name"), F.col("node").alias("before"), F.lit(True).alias("hit"))
    both = updates.join(hit, ["name", "before"], "left")
    cls = F.when(F.col("before").isNull(), "create").when(F.col("before") == F.col("after"), "no_op").when(F.col("hit"), "fast_forward").otherwise("non_fast_forward")
    return both.select("name", cls.alias("class"))


def common_haves(haves: DataFrame, store: DataFrame) -> DataFrame:
    """(id): what a receiver has of a store, from which an export can start."""
    return haves.select("id").distinct().join(store.select("id"), "id", "left_semi")
