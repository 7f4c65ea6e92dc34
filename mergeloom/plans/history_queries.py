"""Queries over the history graph, lineage, ledgers, exchange and rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..operators import exchange, graph, ledger, lineage, oplog, rewrite
from .versions import DAG_SQL, FILES_SQL, UP_SQL, dag, files, table

Q: dict = {}
SQL: dict[str, str] = {}


def dag_reachable(spark, d):
    _, edges, tips = dag(spark, d)
    start = tips.select(F.col("pair").alias("root"), F.col("left").alias("node"))
    return graph.reachable(edges, start).groupBy(F.col("root").alias("pair")).agg(F.count("*").alias("n"), F.min("node").alias("least"))


SQL["dag_reachable"] = UP_SQL + " SELECT pair, count(*) AS n, min(node) AS least FROM sides WHERE l GROUP BY pair"


def ahead_behind(spark, d):
    _, edges, tips = dag(spark, d)
    return graph.ahead_behind(edges, tips)


SQL["ahead_behind"] = UP_SQL + " SELECT pair, count(*) FILTER (l AND NOT r) AS ahead, count(*) FILTER (r AND NOT l) AS behind FROM sides GROUP BY pair"


def merge_bases(spark, d):
    _, edges, tips = dag(spark, d)
    return graph.merge_bases(edges, tips)


SQL["merge_bases"] = UP_SQL + ", c AS (SELECT pair, node FROM sides WHERE l AND r) SELECT pair, node FROM c WHERE (pair, node) NOT IN (SELECT c.pair, e.parent FROM c JOIN edges e ON e.child = c.node)"


def range_commits(spark, d):
    _, edges, tips = dag(spark, d)
    return graph.commits_between(edges, tips)


SQL["range_commits"] = UP_SQL + " SELECT pair, node FROM sides WHERE r AND NOT l"


def ancestor_check(spark, d):
    nodes, edges, tips = dag(spark, d)
    low = nodes.where("level = 4 and lane = 1").selectExpr("user_id AS pair", "id AS left")
    return graph.is_ancestor(edges, low.join(tips.select("pair", F.col("left").alias("right")), "pair"))


SQL["ancestor_check"] = UP_SQL + " SELECT n.user_id AS pair, coalesce(s.l, false) AS is_ancestor FROM nodes n JOIN tips t ON t.pair = n.user_id LEFT JOIN sides s ON s.pair = n.user_id AND s.node = n.id WHERE n.level = 4 AND n.lane = 1"


def first_parent_log(spark, d):
    _, edges, tips = dag(spark, d)
    return graph.first_parent_log(edges, tips.select(F.col("pair").alias("root"), F.col("right").alias("node")), 6)


SQL["first_parent_log"] = f"WITH RECURSIVE {DAG_SQL.strip()}, c(root, seq, node) AS (SELECT pair, 0, \"right\" FROM tips UNION ALL SELECT root, seq + 1, parent FROM c JOIN edges ON child = node AND ordinal = 0 WHERE seq < 5) SELECT root, seq, node FROM c"


def topo_level(spark, d):
    nodes, edges, _ = dag(spark, d)
    return graph.levels(edges, nodes.select(F.col("id").alias("node")))


SQL["topo_level"] = f"WITH RECURSIVE {DAG_SQL.strip()}, r(node, level) AS (SELECT id, 0 FROM nodes UNION SELECT child, r.level + 1 FROM r JOIN edges ON parent = node) SELECT node, max(level) AS level FROM r GROUP BY node"


def newest_first(spark, d):
    nodes, edges, _ = dag(spark, d)
    order = graph.newest_first(edges, nodes.select(F.col("id").alias("node")))
    return order.select("node", "seq")


SQL["newest_first"] = f"""WITH RECURSIVE {DAG_SQL.strip()},
t AS (SELECT user_id AS u, coalesce(max(level) FILTER (lane = 0), -1) AS a, coalesce(max(level) FILTER (lane = 1), -1) AS b FROM nodes GROUP BY user_id),
s(u, i, a, b, id, top) AS (SELECT u, -1, a, b, '', '' FROM t UNION ALL
  SELECT u, i + 1, CASE WHEN first THEN a - 1 ELSE a END, CASE WHEN first THEN b ELSE b - 1 END, CASE WHEN first THEN id0 ELSE id1 END, greatest(top, CASE WHEN first THEN id0 ELSE id1 END)
  FROM (SELECT *, r0 AND (NOT r1 OR id0 < id1) AS first FROM (SELECT *, u || ':' || a || ':0' AS id0, u || ':' || b || ':1' AS id1, a >= 0 AND ((a + 1) % 3 <> 0 OR b <= a) AS r0, b >= 0 AND ((b + 1) % 3 <> 0 OR a <= b) AS r1 FROM s WHERE a >= 0 OR b >= 0)))
SELECT id AS node, CAST(row_number() OVER (ORDER BY top, i) - 1 AS INTEGER) AS seq FROM s WHERE i >= 0"""


def closure_missing(spark, d):
    r, n, c, o, l = (table(spark, d, t) for t in ("region", "nation", "customer", "orders", "lineitem"))
    contains = n.selectExpr("concat('r', n_regionkey) AS parent", "concat('n', n_nationkey) AS child").union(c.selectExpr("concat('n', c_nationkey)", "concat('c', c_custkey)")).union(o.selectExpr("concat('c', o_custkey)", "concat('o', o_orderkey)")).union(l.selectExpr("concat('o', l_orderkey)", "concat('l', l_orderkey, ':', l_linenumber)"))
    roots = r.selectExpr("0 AS root", "concat('r', r_regionkey) AS node")
    every = graph.closure(contains, roots)
    have = contains.selectExpr("child AS id").union(roots.selectExpr("node AS id")).where("right(id, 1) <> '7'").distinct()
    return graph.missing(every, have)


SQL["closure_missing"] = """WITH c AS (SELECT c_custkey, n_nationkey, n_regionkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey),
o AS (SELECT o_orderkey FROM orders JOIN c ON o_custkey = c_custkey)
SELECT node FROM (SELECT 'r' || r_regionkey AS node FROM region UNION SELECT 'n' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'c' || c_custkey FROM c UNION SELECT 'o' || o_orderkey FROM o
UNION SELECT 'l' || l_orderkey || ':' || l_linenumber FROM lineitem JOIN o ON l_orderkey = o_orderkey) WHERE right(node, 1) = '7'"""


def bundle_export_set(spark, d):
    nodes, edges, tips = dag(spark, d)
    contains = nodes.selectExpr("id AS parent", "concat('t', user_id, ':', level div 2) AS child")
    return exchange.export_set(edges, contains, tips.selectExpr("right AS id"), nodes.where("level = 8 and lane = 0").select("id"))


SQL["bundle_export_set"] = f"""WITH RECURSIVE {DAG_SQL.strip()}, a(node) AS (SELECT "right" FROM tips UNION SELECT parent FROM a JOIN edges ON child = node), s(node) AS (SELECT id FROM nodes WHERE level = 8 AND lane = 0 UNION SELECT parent FROM s JOIN edges ON child = node),
c AS (SELECT node FROM a WHERE node NOT IN (SELECT node FROM s)) SELECT node AS id FROM c UNION SELECT 't' || user_id || ':' || (level // 2) FROM nodes WHERE id IN (SELECT node FROM c)"""


def bundle_import(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", identity.object_id(F.lit("blob"), F.col("text")).alias("id"))
    return exchange.import_report(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0").select("id").distinct(), docs.where("doc_id % 7 = 1")).groupBy("outcome").agg(F.count("*").alias("n"))


SQL["bundle_import"] = """WITH d AS (SELECT doc_id, text AS id FROM documents WHERE text IS NOT NULL), s AS (SELECT DISTINCT id FROM d WHERE doc_id % 3 = 0), i AS (SELECT DISTINCT id FROM d WHERE doc_id % 2 = 0)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN id IN (SELECT id FROM s) THEN 'skipped' ELSE 'added' END AS outcome FROM i UNION ALL SELECT 'missing' FROM (SELECT DISTINCT id FROM d WHERE doc_id % 7 = 1 AND id NOT IN (SELECT id FROM s) AND id NOT IN (SELECT id FROM i))) GROUP BY outcome"""


def bundle_roundtrip(spark, d):
    docs = table(spark, d, "benchmark").select(identity.object_id(F.lit("blob"), F.col("text")).alias("id"), F.lit("blob").alias("type"), F.col("text").cast("binary").alias("payload")).dropDuplicates(["id"])
    lines = exchange.bundle_lines(docs, {}, []).where("part = 2")
    return lines.select(exchange.parsed_line(F.col("line")).alias("p")).select("p.id", "p.problem", F.decode("p.payload", "UTF-8").alias("text"))


SQL["bundle_roundtrip"] = "SELECT DISTINCT sha256('blob ' || octet_length(encode(text)) || chr(0) || text) AS id, CAST(NULL AS VARCHAR) AS problem, text FROM benchmark"


def fetch_plan(spark, d):
    c = table(spark, d, "customer")
    ref = "concat(CASE WHEN c_custkey % 4 = 0 THEN 'refs/tags/' ELSE 'refs/heads/' END, c_custkey) AS name"
    remote = c.where("c_custkey % 5 <> 0").selectExpr(ref, "CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '2') ELSE c_name END AS target")
    return exchange.plan_fetch(remote, c.where("c_custkey % 7 <> 0").selectExpr(ref, "c_name AS target"))


SQL["fetch_plan"] = """WITH c AS (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN 'refs/tags/' ELSE 'refs/heads/' END || c_custkey AS name FROM customer)
SELECT name, CASE WHEN c_custkey % 3 = 0 THEN c_name || '2' ELSE c_name END AS target, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS expected,
CASE WHEN c_custkey % 7 = 0 THEN 'new' WHEN c_custkey % 3 <> 0 THEN 'equal' WHEN c_custkey % 4 = 0 THEN 'conflict' ELSE 'update' END AS decision FROM c WHERE c_custkey % 5 <> 0"""


def push_classify(spark, d):
    _, edges, tips = dag(spark, d)
    up = edges.where("ordinal = 0").selectExpr("child AS after", "parent AS p")
    u = tips.selectExpr("pair AS name", "left AS after", "right AS other").join(up, "after", "left")
    u = u.select("name", F.when(F.col("name") % 4 == 0, F.lit(None)).when(F.col("name") % 4 == 1, F.col("after")).when(F.col("name") % 4 == 2, F.col("p")).otherwise(F.col("other")).alias("before"), "after")
    return exchange.classify_push(u, edges)


SQL["push_classify"] = UP_SQL + """ SELECT t.pair AS name, CASE t.pair % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'no_op' WHEN 2 THEN 'fast_forward' ELSE CASE WHEN coalesce(s.l, false) THEN 'fast_forward' ELSE 'non_fast_forward' END END AS class
FROM tips t JOIN edges e ON e.child = t."left" AND e.ordinal = 0 LEFT JOIN sides s ON s.pair = t.pair AND s.node = t."right\""""


def _conversation_snapshots(spark, d):
    """Turns as commits: each has its own text and the one of the turn before, as files of their roles that move every four turns."""
    c = table(spark, d, "conversations").where("conv_id is not null and turn is not null")
    file_id = F.concat("conv_id", F.lit("/"), "role")
    own = c.select("conv_id", "turn", F.concat(file_id, F.lit("/"), F.floor(F.col("turn") / 4)).alias("path"), F.sha2("text", 256).alias("id"), F.lit("100644").alias("mode"), file_id.alias("file_id"), F.lit(None).cast("string").alias("copied_from"))
    heads = c.select("conv_id", "turn").distinct()
    kept = own.withColumn("turn", F.col("turn") + 1).join(heads, ["conv_id", "turn"], "left_semi")
    commit = F.concat("conv_id", F.lit(":"), "turn").alias("commit")
    turn = own.union(kept.select(own.columns)).select(commit, "path", "id", "mode", "file_id", "copied_from")
    parents = heads.select(commit, F.when(F.col("turn") > 0, F.concat("conv_id", F.lit(":"), F.col("turn") - 1)).alias("parent"))
    return turn, parents


def trace_entity(spark, d):
    snaps, parents = _conversation_snapshots(spark, d)
    out = lineage.trace(snaps, parents)
    return out.select("commit", "file_id", "kind", F.array_join("paths", ",").alias("paths"))


SQL["trace_entity"] = """WITH o AS (SELECT conv_id, turn, conv_id || '/' || role || '/' || (turn // 4) AS path, sha256(text) AS id, conv_id || '/' || role AS file_id FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
h AS (SELECT DISTINCT conv_id, turn FROM o),
s AS (SELECT * FROM o UNION ALL SELECT o.conv_id, o.turn + 1, path, id, file_id FROM o JOIN h ON h.conv_id = o.conv_id AND h.turn = o.turn + 1),
g AS (SELECT conv_id, turn, file_id, list_sort(list({p: path, i: id})) AS e FROM s GROUP BY ALL),
t AS (SELECT conv_id, turn, file_id, list_transform(e, lambda x: x.p) AS paths, e[1].i AS id FROM g),
b AS (SELECT h.conv_id, h.turn, file_id, paths, id FROM h JOIN t ON t.conv_id = h.conv_id AND t.turn = h.turn - 1 WHERE h.turn > 0)
SELECT conv_id || ':' || turn AS commit, file_id, CASE WHEN t.paths IS NULL THEN 'deleted' WHEN b.paths IS NULL THEN 'added' WHEN t.paths <> b.paths THEN 'moved' ELSE 'modified' END AS kind, array_to_string(coalesce(t.paths, b.paths), ',') AS paths
FROM t FULL JOIN b USING (conv_id, turn, file_id) WHERE t.paths IS DISTINCT FROM b.paths OR t.id IS DISTINCT FROM b.id"""


def resolve_latest(spark, d):
    c = table(spark, d, "conversations").where("conv_id is not null and turn is not null")
    commit = F.concat("conv_id", F.lit(":"), "turn").alias("commit")
    snaps = c.select(F.concat("conv_id", F.lit("/"), "role").alias("path"), commit, commit.alias("file_id"))
    return lineage.resolve_file_id(snaps, c.select(commit, (-F.col("turn")).alias("seq")).distinct())


SQL["resolve_latest"] = "SELECT conv_id || '/' || role AS path, arg_max(conv_id || ':' || turn, turn) AS file_id FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, role"


def _ledger(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "error", "D").otherwise("M")
    return e.select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("seq"), ledger.change_kind(status).alias("kind"), F.concat(F.lit("p"), F.col("event_id") % 10).alias("path"), F.col("event_id").cast("string").alias("sha"))


def ledger_items(spark, d):
    out = ledger.items_in_range(_ledger(spark, d))
    return out.select("id", "kind", "path", F.size("commits").cast("bigint").alias("n"), F.element_at("commits", 1).alias("newest"))


_LEDGER = "WITH e AS (SELECT user_id AS id, ts, event_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind FROM events), g AS (SELECT id, CASE WHEN bool_or(kind = 'deleted') THEN 'deleted' ELSE arg_min(kind, (ts, event_id)) END AS kind, 'p' || arg_min(event_id % 10, (ts, event_id)) AS path, count(*) AS n, CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS newest FROM e GROUP BY id) "
SQL["ledger_items"] = _LEDGER + "SELECT id, kind, path, n, newest FROM g"


def ledger_totals(spark, d):
    return ledger.ledger_totals(ledger.items_in_range(_ledger(spark, d)))


SQL["ledger_totals"] = _LEDGER + "SELECT count(*) FILTER (kind = 'created') AS created, count(*) FILTER (kind = 'modified') AS modified, count(*) FILTER (kind = 'deleted') AS deleted FROM g"


def items_join(spark, d):
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    commits = e.selectExpr("CAST(event_id AS STRING) AS id", "CAST(NULL AS STRING) AS change_id", "IF(event_id % 50 = 0, array(concat('i', user_id)), CAST(array() AS array<string>)) AS items")
    links = o.selectExpr("concat('i', o_custkey) AS item", "concat('f', o_orderkey % 97) AS path")
    latest = spark.range(97).selectExpr("concat('f', id) AS path", "concat('F', id) AS file_id")
    traces = e.where("event_id % 3 = 0").selectExpr("CAST(event_id AS STRING) AS commit", "concat('F', event_id % 97) AS file_id")
    span = e.where("event_id % 20 = 0").selectExpr("CAST(event_id AS STRING) AS commit")
    return lineage.items_touching(commits, links.distinct(), latest, traces, span)


SQL["items_join"] = "SELECT 'i' || user_id AS item FROM events WHERE event_id % 100 = 0 UNION SELECT 'i' || o_custkey FROM orders WHERE o_orderkey % 97 IN (SELECT event_id % 97 FROM events WHERE event_id % 60 = 0)"


def ref_cas(spark, d):
    c = table(spark, d, "customer")
    refs = c.selectExpr("concat('refs/heads/', c_custkey) AS name", "c_name AS target")
    up = c.where("c_custkey % 2 = 0").selectExpr("concat('refs/heads/', c_custkey) AS ref", "IF(c_custkey % 6 = 0, 'old', c_name) AS expected", "'new' AS after")
    return oplog.cas_problems(up.union(up.where(F.col("ref").endswith("8"))), refs)


SQL["ref_cas"] = "SELECT 'refs/heads/' || c_custkey AS ref, 'ref_changed' AS problem FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT 'refs/heads/' || c_custkey, 'duplicate_ref_update' FROM customer WHERE c_custkey % 10 = 8"


def ref_resolve(spark, d):
    c = table(spark, d, "customer")
    kinds = F.array(*[F.when(F.col("c_custkey") % m != 0, F.concat(F.lit(p), "c_custkey")) for m, p in ((2, "refs/heads/"), (3, "refs/tags/"), (5, "refs/remotes/"))])
    refs = c.select(F.explode(F.array_compact(kinds)).alias("name")).withColumn("target", F.col("name"))
    return oplog.resolve(c.select(F.col("c_custkey").cast("string").alias("name")), refs, c.where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("id")))


SQL["ref_resolve"] = "SELECT * FROM (SELECT CAST(c_custkey AS VARCHAR) AS name, CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 2 <> 0 THEN 'refs/heads/' || c_custkey WHEN c_custkey % 3 <> 0 THEN 'refs/tags/' || c_custkey WHEN c_custkey % 5 <> 0 THEN 'refs/remotes/' || c_custkey END AS id FROM customer) WHERE id IS NOT NULL"


def _receipts(spark, d):
    e = table(spark, d, "events")
    line = F.to_json(F.struct((F.col("event_id") + 1).alias("sequence"), F.col("event_type").alias("command"), F.lit("t").alias("at"), F.lit("s").alias("summary"), F.array(F.struct(F.lit("a").alias("ref"), F.col("user_id").cast("string").alias("before"), F.col("event_id").cast("string").alias("after")), F.struct(F.lit("b").alias("ref"), F.lit("x").alias("before"), F.lit("y").alias("after"))).alias("refs")))
    return oplog.parse(e.select(F.when(F.col("event_id") % 17 == 0, "{torn").otherwise(line).alias("line")))


def oplog_latest(spark, d):
    return oplog.latest(_receipts(spark, d), 20).select("sequence", "command")


SQL["oplog_latest"] = "SELECT event_id + 1 AS sequence, event_type AS command FROM events WHERE event_id % 17 <> 0 ORDER BY event_id DESC LIMIT 20"


def oplog_reverse(spark, d):
    return oplog.reversal(_receipts(spark, d)).select("sequence", F.array_join(F.transform("refs", lambda r: F.concat_ws(">", r["ref"], r["before"], r["after"])), ",").alias("refs"))


SQL["oplog_reverse"] = "SELECT event_id + 1 AS sequence, 'b>y>x,a>' || event_id || '>' || user_id AS refs FROM events WHERE event_id % 17 <> 0"


def split_partition(spark, d):
    base, ours, _ = files(spark, d)
    return rewrite.split_paths(base, ours, ["src1/**", "**/de/*"])


SQL["split_partition"] = f"WITH {FILES_SQL} SELECT path, CASE WHEN b.id IS NULL THEN 'added' WHEN o.id IS NULL THEN 'deleted' ELSE 'modified' END AS kind, CASE WHEN starts_with(path, 'src1/') OR contains(path, '/de/') THEN 1 ELSE 2 END AS part FROM fb b FULL JOIN fo o USING (path) WHERE b.id IS DISTINCT FROM o.id OR b.mode IS DISTINCT FROM o.mode"


def replay_set(spark, d):
    nodes, edges, _ = dag(spark, d)
    commits = nodes.select("id").join(edges.groupBy("child").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "parent"))), lambda x: x["parent"]).alias("parents")), F.col("id") == F.col("child"), "left").select("id", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))
    return rewrite.affected(commits, nodes.where("level = 10 and lane = 1 and user_id % 3 = 0").select("id"))


SQL["replay_set"] = f"WITH RECURSIVE {DAG_SQL.strip()}, a(node) AS (SELECT id FROM nodes WHERE level = 10 AND lane = 1 AND user_id % 3 = 0 UNION SELECT child FROM a JOIN edges ON parent = node) SELECT node AS id FROM a"


def _chain(spark, d):
    """Four commits a customer, each with its hash as id."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    sig = F.struct(F.lit("n").alias("name"), F.lit("e@x").alias("email"), F.lit(1000).cast("bigint").alias("ts_ms"), F.lit(0).alias("tz_min"))
    none = F.array().cast("array<string>")
    out, last = None, None
    for i in range(4):
        base = c.withColumn("parents", none) if last is None else last.select("k", F.array("id").alias("parents"))
        rows = base.select("k", F.sha2(F.concat(F.lit(f"t{i}:"), F.col("k").cast("string")), 256).alias("tree"), F.lit(None).cast("string").alias("change_id"), none.alias("items"), "parents", sig.alias("author"), sig.alias("committer"), F.concat(F.lit(f"m{i} "), F.col("k").cast("string")).alias("message"))
        last = graph.cut(rewrite.with_ids(rows))
        out = last.withColumn("i", F.lit(i)) if out is None else out.union(last.withColumn("i", F.lit(i)))
    return out


def _replayed(every, done):
    return every.select("k", "i", F.col("id").alias("old")).join(done.where("not dropped").select("old", "id"), "old").select("k", "i", "id")


def replay_chain(spark, d):
    every = _chain(spark, d)
    edited = every.where("i = 1").select(F.col("id").alias("old"), "tree", F.col("id").alias("change_id"), "items", "parents", "author", "committer", F.concat(F.lit("new "), F.col("message")).alias("message"))
    return _replayed(every, rewrite.replay(every.drop("k", "i"), edited))


def describe_chain(spark, d):
    """The first commit of each chain gets another message."""
    every = _chain(spark, d)
    return _replayed(every, rewrite.describe(every.drop("k", "i"), every.where("i = 0").select("id", F.concat(F.lit("other "), "message").alias("message"))))


def squash_chain(spark, d):
    """The third commit of each chain goes into the second."""
    every = _chain(spark, d)
    return _replayed(every, rewrite.squash(every.drop("k", "i"), every.where("i = 2").select("id")))


def _commit_sql(tree: str, change: str, parent: str, message: str) -> str:
    text = f"'tree ' || {tree} || chr(10) || {change} || {parent} || 'author n <e@x> 1000 0' || chr(10) || 'committer n <e@x> 1000 0' || chr(10) || chr(10) || {message}"
    return f"sha256('commit ' || octet_length(encode({text})) || chr(0) || {text})"


def _t(i: int) -> str:
    return f"sha256('t{i}:' || k)"


def _p(c: str) -> str:
    return f"'parent ' || {c} || chr(10)"


def _c(c: str) -> str:
    return f"'change ' || {c} || chr(10)"


_CHAIN_SQL = f"""WITH o0 AS (SELECT c_custkey AS k FROM customer), o1 AS (SELECT k, {_commit_sql(_t(0), "''", "''", "'m0 ' || k")} AS a FROM o0), o2 AS (SELECT *, {_commit_sql(_t(1), "''", _p("a"), "'m1 ' || k")} AS b FROM o1),
o3 AS (SELECT *, {_commit_sql(_t(2), "''", _p("b"), "'m2 ' || k")} AS c FROM o2), o4 AS (SELECT *, {_commit_sql(_t(3), "''", _p("c"), "'m3 ' || k")} AS d FROM o3)"""
SQL["replay_chain"] = f"""{_CHAIN_SQL}, n1 AS (SELECT *, {_commit_sql(_t(1), _c("b"), _p("a"), "'new m1 ' || k")} AS x FROM o4), n2 AS (SELECT *, {_commit_sql(_t(2), _c("c"), _p("x"), "'m2 ' || k")} AS y FROM n1), n3 AS (SELECT *, {_commit_sql(_t(3), _c("d"), _p("y"), "'m3 ' || k")} AS z FROM n2)
SELECT k, 1 AS i, x AS id FROM n3 UNION ALL SELECT k, 2, y FROM n3 UNION ALL SELECT k, 3, z FROM n3"""
SQL["describe_chain"] = f"""{_CHAIN_SQL}, n0 AS (SELECT *, {_commit_sql(_t(0), _c("a"), "''", "'other m0 ' || k")} AS w FROM o4), n1 AS (SELECT *, {_commit_sql(_t(1), _c("b"), _p("w"), "'m1 ' || k")} AS x FROM n0),
n2 AS (SELECT *, {_commit_sql(_t(2), _c("c"), _p("x"), "'m2 ' || k")} AS y FROM n1), n3 AS (SELECT *, {_commit_sql(_t(3), _c("d"), _p("y"), "'m3 ' || k")} AS z FROM n2)
SELECT k, 0 AS i, w AS id FROM n3 UNION ALL SELECT k, 1, x FROM n3 UNION ALL SELECT k, 2, y FROM n3 UNION ALL SELECT k, 3, z FROM n3"""
SQL["squash_chain"] = f"""{_CHAIN_SQL}, n1 AS (SELECT *, {_commit_sql(_t(2), _c("b"), _p("a"), "'m1 ' || k || chr(10) || chr(10) || 'm2 ' || k")} AS x FROM o4), n3 AS (SELECT *, {_commit_sql(_t(3), _c("d"), _p("x"), "'m3 ' || k")} AS z FROM n1)
SELECT k, 1 AS i, x AS id FROM n3 UNION ALL SELECT k, 3, z FROM n3"""

for _f in (dag_reachable, ahead_behind, merge_bases, range_commits, ancestor_check, first_parent_log, topo_level, newest_first, closure_missing, bundle_export_set, bundle_import, bundle_roundtrip, fetch_plan, push_classify, trace_entity, resolve_latest, ledger_items, ledger_totals, items_join, ref_cas, ref_resolve, oplog_latest, oplog_reverse, split_partition, replay_set, replay_chain, describe_chain, squash_chain):
    Q[_f.__name__] = _f
