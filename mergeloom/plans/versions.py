"""Versions of the test tables that queries compare: three of orders, a history of events, and files.

Each comes as DataFrames and as the same SQL, so that a query and its oracle start alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: key, status and price in cents of three versions of orders.
ORDERS_SQL = """
base AS (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders WHERE o_orderkey % 13 <> 0),
ours AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders WHERE (o_orderkey % 13 <> 0 OR o_orderkey % 26 = 0) AND o_orderkey % 11 <> 0),
theirs AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 14 = 0 THEN 'Y' WHEN o_orderkey % 21 = 0 THEN 'X' ELSE o_orderstatus END AS s, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 0 END AS p FROM orders WHERE (o_orderkey % 13 <> 0 OR o_orderkey % 39 = 0) AND o_orderkey % 17 <> 0)
"""


def orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k, s, p) of base, ours and theirs."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_orderstatus AS s", "CAST(round(o_totalprice * 100) AS BIGINT) AS p")
    base = o.where("k % 13 <> 0")
    ours = o.where("(k % 13 <> 0 OR k % 26 = 0) AND k % 11 <> 0").withColumn("s", F.expr("CASE WHEN k % 7 = 0 THEN 'X' ELSE s END"))
    theirs = o.where("(k % 13 <> 0 OR k % 39 = 0) AND k % 17 <> 0").withColumn("s", F.expr("CASE WHEN k % 14 = 0 THEN 'Y' WHEN k % 21 = 0 THEN 'X' ELSE s END")).withColumn("p", F.expr("p + CASE WHEN k % 5 = 0 THEN 100 ELSE 0 END"))
    return base, ours, theirs


def as_fields(version: DataFrame) -> DataFrame:
    """Records with the fields status and price, as canonical values."""
    return version.select(F.col("k").cast("string").alias("record_id"), F.explode(F.array(F.struct(F.lit("price").alias("field"), F.col("p").cast("string").alias("value")), F.struct(F.lit("status").alias("field"), F.concat(F.lit('"'), "s", F.lit('"')).alias("value")))).alias("f")).select("record_id", "f.field", "f.value")


def _fields_sql(name: str) -> str:
    return f"f_{name} AS (SELECT CAST(k AS VARCHAR) AS record_id, 'price' AS field, CAST(p AS VARCHAR) AS value FROM {name} UNION ALL SELECT CAST(k AS VARCHAR), 'status', '\"' || s || '\"' FROM {name})"


MERGED_SQL = (
    "WITH "
    + ORDERS_SQL
    + ", "
    + ", ".join(map(_fields_sql, ("base", "ours", "theirs")))
    + """,
j AS (SELECT record_id, field, b.value AS base, o.value AS ours, t.value AS theirs FROM f_base b FULL JOIN f_ours o USING (record_id, field) FULL JOIN f_theirs t USING (record_id, field)),
m AS (SELECT *, CASE WHEN ours IS NOT DISTINCT FROM base THEN theirs ELSE ours END AS resolved,
  ours IS DISTINCT FROM base AND theirs IS DISTINCT FROM base AND ours IS DISTINCT FROM theirs AS conflict FROM j),
merged AS (SELECT *, resolved IS DISTINCT FROM base AS changed FROM m)
"""
)

#: The history: two lanes a user; every third level has the other lane's node before as second parent.
DAG_SQL = """
ranked AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
nodes AS (SELECT user_id, k % 2 AS lane, k // 2 AS level, user_id || ':' || (k // 2) || ':' || (k % 2) AS id FROM ranked),
edges AS (
  SELECT c.id AS child, p.id AS parent, 0 AS ordinal FROM nodes c JOIN nodes p ON c.user_id = p.user_id AND c.lane = p.lane AND c.level = p.level + 1
  UNION ALL
  SELECT c.id, p.id, 1 FROM nodes c JOIN nodes p ON c.user_id = p.user_id AND c.lane = 1 - p.lane AND c.level = p.level + 1 WHERE c.level % 3 = 0),
ends AS (SELECT user_id, lane, arg_max(id, level) AS id FROM nodes GROUP BY user_id, lane),
tips AS (SELECT l.user_id AS pair, l.id AS "left", r.id AS "right" FROM ends l JOIN ends r ON l.user_id = r.user_id AND l.lane = 0 AND r.lane = 1)
"""
_UP = """
reach(pair, side, node) AS (
  SELECT pair, 'l', "left" FROM tips UNION SELECT pair, 'r', "right" FROM tips
  UNION SELECT r.pair, r.side, e.parent FROM reach r JOIN edges e ON e.child = r.node),
sides AS (SELECT pair, node, bool_or(side = 'l') AS l, bool_or(side = 'r') AS r FROM reach GROUP BY pair, node)
"""
UP_SQL = f"WITH RECURSIVE {DAG_SQL.strip()}, {_UP.strip()}"


def dag(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, tips) of all events: tips pairs the last nodes of each user's two lanes."""
    e = table(spark, sf_dir, "events")
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    n = e.select("user_id", k.alias("k")).selectExpr("user_id", "k % 2 AS lane", "CAST(k div 2 AS INT) AS level", "concat(user_id, ':', k div 2, ':', k % 2) AS id")
    parent = n.selectExpr("user_id", "lane AS plane", "level + 1 AS level", "id AS parent")
    both = n.join(parent, ["user_id", "level"]).where("lane = plane OR level % 3 = 0")
    edges = both.selectExpr("id AS child", "parent", "IF(lane = plane, 0, 1) AS ordinal")
    last = n.groupBy("user_id", "lane").agg(F.max_by("id", "level").alias("id"))
    tips = last.where("lane = 0").selectExpr("user_id AS pair", "id AS left").join(last.where("lane = 1").selectExpr("user_id AS pair", "id AS right"), "pair")
    return n, edges, tips


#: Documents as files of two snapshots and a working tree: path by source, content hash, mode and identity.
FILES_SQL = """
f AS (SELECT doc_id AS k, source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS h, substr(sha256('f' || doc_id), 1, 32) AS fid FROM documents),
fb AS (SELECT path, h AS id, '100644' AS mode, fid AS file_id, CAST(NULL AS VARCHAR) AS copied_from FROM f WHERE k % 13 <> 0),
fo AS (SELECT path, CASE WHEN k % 7 = 0 THEN sha256(h || 'o') ELSE h END AS id, CASE WHEN k % 10 = 0 THEN '100755' ELSE '100644' END AS mode, CASE WHEN k % 23 = 0 THEN substr(sha256('o' || k), 1, 32) WHEN k % 29 = 1 THEN substr(sha256('shared'), 1, 32) ELSE fid END AS file_id, CAST(NULL AS VARCHAR) AS copied_from FROM f WHERE (k % 13 <> 0 OR k % 26 = 0) AND k % 11 <> 0),
ft AS (SELECT path, CASE WHEN k % 14 = 0 THEN sha256(h || 't') WHEN k % 21 = 0 THEN sha256(h || 'o') ELSE h END AS id, '100644' AS mode, CASE WHEN k % 46 = 0 THEN substr(sha256('t' || k), 1, 32) ELSE fid END AS file_id, CAST(NULL AS VARCHAR) AS copied_from FROM f WHERE (k % 13 <> 0 OR k % 39 = 0) AND k % 17 <> 0)
"""


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, id, mode, file_id, copied_from) of base, ours and theirs."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS k", "concat(source, '/', lang, '/', doc_id, '.txt') AS path", "sha2(text, 256) AS h", "substring(sha2(concat('f', doc_id), 256), 1, 32) AS fid")
    none = "CAST(NULL AS STRING) AS copied_from"
    base = d.where("k % 13 <> 0").selectExpr("path", "h AS id", "'100644' AS mode", "fid AS file_id", none)
    ours = d.where("(k % 13 <> 0 OR k % 26 = 0) AND k % 11 <> 0").selectExpr("path", "CASE WHEN k % 7 = 0 THEN sha2(concat(h, 'o'), 256) ELSE h END AS id", "CASE WHEN k % 10 = 0 THEN '100755' ELSE '100644' END AS mode", "CASE WHEN k % 23 = 0 THEN substring(sha2(concat('o', k), 256), 1, 32) WHEN k % 29 = 1 THEN substring(sha2('shared', 256), 1, 32) ELSE fid END AS file_id", none)
    theirs = d.where("(k % 13 <> 0 OR k % 39 = 0) AND k % 17 <> 0").selectExpr("path", "CASE WHEN k % 14 = 0 THEN sha2(concat(h, 't'), 256) WHEN k % 21 = 0 THEN sha2(concat(h, 'o'), 256) ELSE h END AS id", "'100644' AS mode", "CASE WHEN k % 46 = 0 THEN substring(sha2(concat('t', k), 256), 1, 32) ELSE fid END AS file_id", none)
    return base, ours, theirs
