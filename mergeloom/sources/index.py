"""The index of a working tree as text: a header line, then a JSON tuple a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import quoted
from ..functions.identity import is_file_id, is_object_id
from ..functions.paths import canonical_path

#: The header of files that this writes: a name and the version of the format.
HEADER = "index 3"
STAT = ("size", "mtime_ns", "ctime_ns", "dev", "ino", "observed_ns")
_SIGNED = ("mtime_ns", "ctime_ns")
_STAT_TYPE = f"struct<{','.join(f'{c}:bigint' for c in STAT)}>"


class BadIndex(ValueError):
    """Text that is no index, or of a version that isn't known."""


def _sound_ids(file_id: Column, origin: Column) -> Column:
    some = lambda c: c.isNull() | is_file_id(c)
    return some(file_id) & some(origin) & (origin.isNull() | (file_id.isNotNull() & (origin != file_id)))


def checked(entries: DataFrame) -> DataFrame:
    """entries (path, id, mode, file_id, copied_from, stat), each path once; anything else raises when it is read."""
    ok = F.col("mode").isin("100644", "100755") & is_object_id(F.col("id")) & F.coalesce(canonical_path(F.col("path")), F.lit(False)) & _sound_ids(F.col("file_id"), F.col("copied_from"))
    twice = entries.groupBy("path").agg(F.count("*").alias("n"))
    both = entries.join(twice, "path")
    fail = lambda why: F.raise_error(F.concat(F.lit(why + " "), F.coalesce("path", F.lit("null")))).cast("string")
    path = F.when(~F.coalesce(ok, F.lit(False)), fail("bad index entry")).when(F.col("n") > 1, fail("path twice in the index:")).otherwise(F.col("path"))
    return both.select(path.alias("path"), "id", "mode", "file_id", "copied_from", "stat")


def encoded(entries: DataFrame, header: str = HEADER) -> DataFrame:
    """(path, line): the lines of an index, to be ordered by path; the header has the empty path."""
    text = lambda c: F.coalesce(quoted(F.col(c)), F.lit("null"))
    stat = F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit('"'), F.col(f"stat.{c}").cast("string"), F.lit('"')) for c in STAT]), F.lit("]"))
    cells = [text(c) for c in ("mode", "id", "path", "file_id", "copied_from")]
    line = F.concat(F.lit("["), F.concat_ws(",", *cells, F.when(F.col("stat").isNull(), "null").otherwise(stat)), F.lit("]"))
    rows = checked(entries).select("path", line.alias("line"))
    return entries.sparkSession.range(1).select(F.lit("").alias("path"), F.lit(header).alias("line")).union(rows)


def decoded(lines: DataFrame, header: str) -> DataFrame:
    """Entries of an index's lines (line) without its header line.

    A header that ends with 3 means tuples of six, one with 2 tuples of four without
    identities; without a version, lines are mode, id and path. Bad lines raise when they
    are read.
    """
    rows = lines.where(F.col("line") != "").where(F.col("line") != F.lit(header))
    none = F.lit(None).cast("string")
    fail = F.raise_error(F.concat(F.lit("bad index line "), "line")).cast("string")
    if not header.endswith((" 2", " 3")):
        m = lambda i: F.regexp_extract("line", r"^(100644|100755) ([0-9a-f]{64}) (.+)\z", i)
        path = F.when(m(3) == "", fail).otherwise(m(3))
        return checked(rows.select(path.alias("path"), m(2).alias("id"), m(1).alias("mode"), none.alias("file_id"), none.alias("copied_from"), F.lit(None).cast(_STAT_TYPE).alias("stat")))
    wide = 6 if header.endswith(" 3") else 4
    v = F.try_parse_json("line")
    cell = lambda i: F.expr(f"try_variant_get(v, '$[{i}]', 'string')")
    at = dict(zip(("mode", "id", "path", "file_id", "copied_from"), range(5), strict=True))
    got = rows.select("line", v.alias("v"))
    # a tuple of another length has no last place, or one behind it
    sized = got.withColumn("size", F.size(F.expr("try_variant_get(v, '$', 'array<variant>')")))
    raw = F.expr(f"try_variant_get(v, '$[{wide - 1}]', 'array<string>')")
    pattern = lambda c: r"^-?\d+\z" if c in _SIGNED else r"^\d+\z"
    there = F.expr(f"NOT is_variant_null(variant_get(v, '$[{wide - 1}]', 'variant'))")
    numbers = F.size("raw") == len(STAT)
    for i, c in enumerate(STAT):
        numbers = numbers & F.coalesce(F.get("raw", F.lit(i)).rlike(pattern(c)), F.lit(False))
    known = sized.withColumn("raw", raw).withColumn("has", F.coalesce(there, F.lit(False)))
    fits = (F.col("size") == wide) & (~F.col("has") | F.coalesce(numbers, F.lit(False)))
    path = F.when(~F.coalesce(fits, F.lit(False)), fail).otherwise(cell(2))
    stat = F.when(F.col("has"), F.struct(*[F.get("raw", F.lit(i)).cast("bigint").alias(c) for i, c in enumerate(STAT)]))
    ids = [cell(at[c]) if wide == 6 else none for c in ("file_id", "copied_from")]
    return checked(known.select(path.alias("path"), cell(1).alias("id"), cell(0).alias("mode"), ids[0].alias("file_id"), ids[1].alias("copied_from"), stat.alias("stat")))


def read(spark: SparkSession, path: str, header: str = HEADER) -> DataFrame:
    """Entries of an index file; the first line of its first split is the header of any known version, if it has one."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    name = header.rsplit(" ", 1)[0]
    heads = [r.line for r in lines.where(F.col("line").startswith(name + " ")).limit(2).collect()]
    if heads and heads[0] not in (header, f"{name} 2"):
        raise BadIndex(f"version {heads[0].rsplit(' ', 1)[-1]} of the index isn't known")
    return decoded(lines, heads[0] if heads else "")
