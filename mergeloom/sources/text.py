"""Tables from text formats: logs of path changes, attribute triples, indexes, bundles, JSON lines and loose objects."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import unframed
from ..operators.exchange import FORMAT, parse_header, parsed_line
from ..operators.oplog import parse


def nul_list(text: Column) -> Column:
    """Parts of a NUL-delimited list, without empty ones."""
    return F.filter(F.split(text, "\u0000"), lambda x: x != "")


def attribute_triples(text: Column) -> Column:
    """(path, attribute, value) of a NUL-delimited list of triples; a torn last one is left out."""
    parts = F.split(text, "\u0000")
    return F.transform(F.sequence(F.lit(1), F.floor(F.size(parts) / 3).cast("int")), lambda i: F.struct(F.get(parts, 3 * i - 3).alias("path"), F.get(parts, 3 * i - 2).alias("attribute"), F.get(parts, 3 * i - 1).alias("value")))


@F.pandas_udf(T.ArrayType(T.StructType().add("status", "string").add("path", "string")))
def _changes(fields: pd.Series) -> pd.Series:
    """Status and path of each change; renames and copies have two paths, of which the second counts."""

    def one(parts) -> list[dict]:
        out, i = [], 0
        parts = list(parts) if parts is not None else []
        while i < len(parts):
            status = parts[i].strip()
            if not status:
                i += 1
                continue
            wide = 2 if status[0] in "RC" else 1
            if i + wide < len(parts) and parts[i + wide]:
                out.append({"status": status, "path": parts[i + wide]})
            i += wide + 1
        return out

    return fields.map(one)


def log_records(text: Column) -> Column:
    """Records (sha, author, email, date, subject, rest) of a log whose records begin with \\x01 and whose fields end with NUL; shorter ones are left out."""
    fields = F.transform(F.filter(F.split(text, "\u0001"), lambda r: r != ""), lambda r: F.split(r, "\u0000"))
    full = F.filter(fields, lambda f: F.size(f) >= 5)
    return F.transform(full, lambda f: F.struct(*[f[i].alias(n) for i, n in enumerate(("sha", "author", "email", "date", "subject"))], F.slice(f, 6, F.size(f)).alias("rest")))


def path_changes(logs: DataFrame) -> DataFrame:
    """(sha, author, email, date, subject, seq, status, path) of logs (text)."""
    rec = logs.select(F.explode(log_records(F.col("text"))).alias("r")).select("r.*")
    return rec.withColumn("c", _changes("rest")).select("sha", "author", "email", "date", "subject", F.posexplode("c").alias("seq", "c")).select("sha", "author", "email", "date", "subject", "seq", "c.status", "c.path")


def read_oplog(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path).withColumnRenamed("value", "line"))


def read_bundle(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, objects) of a bundle file; a bad line raises when it is read.

    Marker and header are known by how they begin, as splits of a file have no order.
    """
    lines = spark.read.text(path).where("value <> ''")
    marks = lines.where(F.col("value") == FORMAT).limit(2).collect()
    heads = [r.value for r in lines.where(F.col("value").startswith("{")).limit(2).collect()]
    header = parse_header(FORMAT if len(marks) == 1 else "", heads[0] if len(heads) == 1 else "")
    rows = lines.where(~F.col("value").startswith("{") & (F.col("value") != FORMAT)).select(parsed_line(F.col("value")).alias("p"))
    safe = F.when(F.col("p.problem").isNull(), F.col("p.id")).otherwise(F.raise_error(F.col("p.problem")).cast("string"))
    return header, rows.select(safe.alias("id"), "p.type", "p.payload")


@F.pandas_udf(T.BinaryType())
def _inflated(raw: pd.Series) -> pd.Series:
    def one(b: bytes) -> bytes | None:
        try:
            return zlib.decompress(b)
        except zlib.error:
            return None

    return raw.map(one, na_action="ignore")


def read_loose_objects(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, payload, size) of a folder of deflated frames, two hex digits a folder; unreadable frames have null type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    oid = F.regexp_replace(F.regexp_extract("path", r"([0-9a-f]{2}/[0-9a-f]{62})$", 1), "/", "")
    got = files.select(oid.alias("id"), unframed(_inflated("content")).alias("f"))
    return got.select("id", F.col("f.kind").alias("type"), "f.payload", F.octet_length("f.payload").cast("bigint").alias("size"))


def working_tree(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """(path, size, content) of a folder; without content only names and sizes are read."""
    root = path.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.replace(".", r"\."), "")
    return files.select(rel.alias("path"), F.col("length").alias("size"), *(["content"] if content else []))


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    """(name, target) of a folder of ref files; locks and files that hold no id are left out."""
    files = working_tree(spark, path).select("path", F.trim(F.decode("content", "UTF-8")).alias("target"))
    return files.where(~F.col("path").endswith(".lock") & F.col("target").rlike(r"^[0-9a-f]{64}\s*\z")).select(F.concat(F.lit("refs/"), "path").alias("name"), F.trim("target").alias("target"))


def read_remotes(text: Column) -> Column:
    """name to url of a remotes file's JSON."""
    return F.from_json(text, "map<string,string>")
