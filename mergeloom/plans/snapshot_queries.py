"""Queries over snapshots, objects, paths and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, paths
from ..operators import exchange, ledger, snapshots, trees
from .versions import FILES_SQL, ORDERS_SQL, files, orders, table

Q: dict = {}
SQL: dict[str, str] = {}

_ID = "sha256(CAST('blob ' || octet_length(encode(text)) || chr(0) || text AS VARCHAR))"


def object_ids(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", identity.object_id(F.lit("blob"), F.col("text")).alias("object_id"), F.octet_length("text").cast("bigint").alias("size"))


SQL["object_ids"] = f"SELECT doc_id, {_ID} AS object_id, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL"


def object_dedup(spark, d):
    rows = table(spark, d, "documents").select("text").union(table(spark, d, "benchmark").select("text")).where("text is not null")
    incoming = rows.select(identity.object_id(F.lit("blob"), F.col("text")).alias("id"), F.lit("blob").alias("type"), F.col("text").cast("binary").alias("payload"))
    store = incoming.where(F.substring("id", 1, 1) == "0")
    new = exchange.new_objects(incoming, store)
    return new.select("id", F.octet_length("payload").cast("bigint").alias("size"))


SQL["object_dedup"] = f"WITH r AS (SELECT {_ID} AS id, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) WHERE text IS NOT NULL) SELECT DISTINCT id, size FROM r WHERE substr(id, 1, 1) <> '0'"


def verify_objects(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    wanted = docs.select("doc_id", identity.object_id(F.lit("blob"), F.col("text")).alias("id"))
    stored = docs.where("doc_id % 5 <> 0").select(identity.object_id(F.lit("blob"), F.col("text")).alias("id"), F.lit("blob").alias("type"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("payload"), "doc_id")
    one = stored.groupBy("id").agg(F.min_by(F.struct("type", "payload"), "doc_id").alias("o")).select("id", "o.type", "o.payload")
    return exchange.verify(one, wanted.select("id")).groupBy("outcome").agg(F.count("*").alias("n"))


SQL["verify_objects"] = f"""WITH w AS (SELECT doc_id, {_ID} AS id FROM documents WHERE text IS NOT NULL),
s AS (SELECT id, arg_min(CASE WHEN doc_id % 7 = 0 THEN 'corrupt' ELSE 'verified' END, doc_id) AS outcome FROM w WHERE doc_id % 5 <> 0 GROUP BY id)
SELECT coalesce(outcome, 'missing') AS outcome, count(*) AS n FROM (SELECT DISTINCT id FROM w) LEFT JOIN s USING (id) GROUP BY 1"""


def snapshot_diff(spark, d):
    base, ours, _ = orders(spark, d)
    return snapshots.diff(base, ours, ["k"], ["s", "p"]).select("k", "kind", F.col("l.s").alias("before"), F.col("r.s").alias("after"))


SQL["snapshot_diff"] = f"""WITH {ORDERS_SQL}
SELECT k, CASE WHEN b.s IS NULL THEN 'added' WHEN o.s IS NULL THEN 'deleted' ELSE 'modified' END AS kind, b.s AS before, o.s AS after
FROM base b FULL JOIN ours o USING (k) WHERE b.s IS DISTINCT FROM o.s OR b.p IS DISTINCT FROM o.p"""


def tree_compare(spark, d):
    base, _, theirs = orders(spark, d)
    return snapshots.compare(base, theirs, ["k"], ["s", "p"])


SQL["tree_compare"] = f"""WITH {ORDERS_SQL}
SELECT k, CASE WHEN t.s IS NULL THEN 'missing' WHEN b.s IS NULL THEN 'extra' WHEN b.s = t.s AND b.p = t.p THEN 'same' ELSE 'differing' END AS class
FROM base b FULL JOIN theirs t USING (k)"""


def status_three_way(spark, d):
    return snapshots.status(*files(spark, d))


SQL["status_three_way"] = f"""WITH {FILES_SQL}
SELECT 'staged' AS section, path, CASE WHEN b.id IS NULL THEN 'added' WHEN o.id IS NULL THEN 'deleted' ELSE 'modified' END AS kind FROM fb b FULL JOIN fo o USING (path) WHERE b.id IS DISTINCT FROM o.id OR b.mode IS DISTINCT FROM o.mode
UNION ALL SELECT 'unstaged', path, CASE WHEN t.id IS NULL THEN 'deleted' ELSE 'modified' END FROM fo o LEFT JOIN ft t USING (path) WHERE t.id IS DISTINCT FROM o.id OR t.mode IS DISTINCT FROM o.mode
UNION ALL SELECT 'untracked', path, 'added' FROM ft WHERE path NOT IN (SELECT path FROM fo)"""


def overwrite_guard(spark, d):
    base, ours, theirs = files(spark, d)
    dirty = ours.where(F.substring("id", 1, 1) == "a").select("path")
    untracked = theirs.join(ours, "path", "left_anti").select("path")
    return snapshots.overwrite_risks(dirty, untracked, base, theirs)


SQL["overwrite_guard"] = f"""WITH {FILES_SQL}
SELECT path, 'dirty' AS reason FROM fo WHERE substr(id, 1, 1) = 'a' AND path IN (SELECT path FROM fb FULL JOIN ft USING (path) WHERE fb.id IS DISTINCT FROM ft.id)
UNION ALL SELECT path, 'untracked' FROM ft WHERE path NOT IN (SELECT path FROM fo)"""


def materialise_plan(spark, d):
    base, ours, _ = files(spark, d)
    return snapshots.materialise_plan(base, ours)


SQL["materialise_plan"] = f"WITH {FILES_SQL} SELECT path, 'write' AS action FROM fo UNION ALL SELECT path, 'delete' FROM fb WHERE path NOT IN (SELECT path FROM fo)"


def move_copy_detect(spark, d):
    base, _, _ = files(spark, d)
    seq = F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("bigint")
    old = base.withColumn("k", seq).where("k % 2 = 0").select("path", "id", "mode", "file_id", F.lit(1).alias("dev"), "k").withColumn("ino", F.when(F.col("k") % 6 == 0, F.col("k"))).drop("k")
    new = base.withColumn("k", seq).where("k % 2 = 1").select("path", "id", "mode", F.lit(1).alias("dev"), F.when(F.col("k") % 3 == 0, F.col("k") - 3).otherwise(-1).alias("ino"))
    there = old.where(F.substring("path", -5, 1).isin("0", "4"))
    return snapshots.moves_and_copies(old, new, there)


SQL["move_copy_detect"] = f"""WITH {FILES_SQL},
k AS (SELECT *, CAST(regexp_extract(path, '/(\\d+)\\.txt$', 1) AS BIGINT) AS k FROM fb),
old AS (SELECT *, CASE WHEN k % 6 = 0 THEN k END AS ino FROM k WHERE k % 2 = 0),
new AS (SELECT *, CASE WHEN k % 3 = 0 THEN k - 3 ELSE -1 END AS ino FROM k WHERE k % 2 = 1),
p AS (SELECT ino, min(path) AS path, min(file_id) AS file_id FROM old WHERE ino IS NOT NULL GROUP BY ino HAVING count(*) = 1),
c AS (SELECT id, mode, min(path) AS path, min(file_id) AS file_id FROM old GROUP BY id, mode HAVING count(*) = 1),
j AS (SELECT n.path, coalesce(p.path, c.path) AS source, CASE WHEN p.path IS NOT NULL THEN p.file_id ELSE c.file_id END AS origin FROM new n LEFT JOIN p USING (ino) LEFT JOIN c ON n.id = c.id AND n.mode = c.mode),
r AS (SELECT *, substr(source, length(source) - 4, 1) IN ('0', '4') AS there FROM j WHERE source IS NOT NULL)
SELECT path, source, CASE WHEN there THEN 'copy' ELSE 'move' END AS kind, CASE WHEN NOT there THEN origin END AS file_id, CASE WHEN there THEN origin END AS copied_from FROM r"""


def merge_tree_paths(spark, d):
    out = trees.merge(*files(spark, d))
    return out.select("path", "action", "id", "mode", "file_id", "copied_from", F.array_join("reasons", ",").alias("reasons"))


_MERGE_SQL = f"""WITH {FILES_SQL},
j AS (SELECT path, b.id AS bi, b.mode AS bm, b.file_id AS bf, o.id AS oi, o.mode AS om, o.file_id AS of_, t.id AS ti, t.mode AS tm, t.file_id AS tf FROM fb b FULL JOIN fo o USING (path) FULL JOIN ft t USING (path)),
c AS (SELECT *, (oi IS DISTINCT FROM bi OR om IS DISTINCT FROM bm OR of_ IS DISTINCT FROM bf) AS oc, (ti IS DISTINCT FROM bi OR tm IS DISTINCT FROM bm OR tf IS DISTINCT FROM bf) AS tc FROM j),
a AS (SELECT *, CASE WHEN NOT tc THEN 'ours' WHEN NOT oc THEN 'theirs' WHEN oi IS NULL AND ti IS NULL THEN 'removed' WHEN oi IS NULL OR ti IS NULL THEN 'conflict' WHEN oi = ti AND om = tm THEN 'agree' WHEN om <> tm THEN 'conflict' ELSE 'content' END AS act FROM c),
r AS (SELECT path, act, CASE WHEN act = 'theirs' THEN ti ELSE oi END AS id, CASE WHEN act = 'theirs' THEN tm ELSE om END AS mode,
  CASE WHEN act IN ('agree', 'content') THEN CASE WHEN of_ <> tf THEN least(of_, tf) ELSE coalesce(of_, tf) END WHEN act = 'theirs' THEN tf ELSE of_ END AS file_id,
  act IN ('agree', 'content') AND coalesce(of_ <> tf, false) AS clash, CASE WHEN act = 'conflict' THEN CASE WHEN oi IS NULL OR ti IS NULL THEN 'content' ELSE 'mode' END END AS why FROM a),
n AS (SELECT *, id IS NOT NULL AND file_id IS NOT NULL AND row_number() OVER (PARTITION BY file_id, id IS NULL ORDER BY path) > 1 AS again FROM r)
"""
SQL["merge_tree_paths"] = _MERGE_SQL + "SELECT path, CASE WHEN id IS NULL AND act <> 'conflict' THEN 'removed' ELSE act END AS action, id, mode, CASE WHEN again THEN substr(sha256('" + trees.FORKED + "' || chr(0) || file_id || chr(0) || path), 1, 32) ELSE file_id END AS file_id, CASE WHEN again THEN file_id END AS copied_from, concat_ws(',', why, CASE WHEN clash OR again THEN 'identity' END) AS reasons FROM n"


def identity_dupes(spark, d):
    _, ours, _ = files(spark, d)
    return trees.ranked_identities(ours).where("rank > 1")


SQL["identity_dupes"] = f"WITH {FILES_SQL} SELECT path, file_id, rank FROM (SELECT path, file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY path) AS INTEGER) AS rank FROM fo) WHERE rank > 1"


def glob_filter(spark, d):
    path = F.regexp_replace("url", r"^https?://", "")
    pages = table(spark, d, "pages").select("page_id", path.alias("path"))
    globs = ["*.example.com/en/**", "**/fr/?*", "m.*/**/8??"]
    return pages.select("page_id", "path", *[paths.matches_glob(F.col("path"), g).alias(f"g{i}") for i, g in enumerate(globs)], paths.canonical_path(F.col("path")).alias("canonical"))


SQL["glob_filter"] = r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)
SELECT page_id, path, regexp_full_match(path, '[^/]*\.example\.com/en/.*') AS g0, regexp_full_match(path, '.*fr/[^/][^/]*') AS g1, regexp_full_match(path, 'm\.[^/]*/.*8[^/][^/]') AS g2,
len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) = 0 AS canonical FROM p"""


def ignore_filter(spark, d):
    rules = paths.IgnoreRules.parse("# built things\n*1.txt\nsrc3/\n!src3/en/*\nde/*\n")
    f, _, _ = files(spark, d)
    more = F.when(F.substring("id", 1, 1) == "0", F.concat(F.lit("node_modules/"), "path")).otherwise(F.col("path"))
    return f.select(more.alias("path")).select("path", paths.ignored(F.col("path"), rules).alias("ignored"))


SQL["ignore_filter"] = f"""WITH {FILES_SQL}, p AS (SELECT CASE WHEN substr(id, 1, 1) = '0' THEN 'node_modules/' || path ELSE path END AS path FROM fb)
SELECT path, starts_with(path, 'node_modules/') OR ((regexp_full_match(path, '.*[^/]*1\\.txt') OR regexp_full_match(path, 'src3/.*') OR regexp_full_match(path, 'de/[^/]*')) AND NOT regexp_full_match(path, 'src3/en/[^/]*')) AS ignored FROM p"""

#: Order lines as files: customer and order are directories.
_LINES_SQL = "l AS (SELECT 'c' || o_custkey || '/o' || o_orderkey || '/' || l_linenumber AS path, sha256(l_partkey || ':' || l_suppkey) AS id, o_custkey, o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _lines(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).selectExpr("o_custkey", "o_orderkey", "l_linenumber", "sha2(concat(l_partkey, ':', l_suppkey), 256) AS id")


def path_flatten(spark, d):
    lines = _lines(spark, d)
    none = "CAST(NULL AS STRING) AS file_id", "CAST(NULL AS STRING) AS copied_from"
    top = lines.selectExpr("'top' AS tree_id", "concat('c', o_custkey) AS name", "'40000' AS mode", "concat('C', o_custkey) AS id", *none).distinct()
    mid = lines.selectExpr("concat('C', o_custkey) AS tree_id", "concat('o', o_orderkey) AS name", "'40000' AS mode", "concat('O', o_orderkey) AS id", *none).distinct()
    low = lines.selectExpr("concat('O', o_orderkey) AS tree_id", "CAST(l_linenumber AS STRING) AS name", "'100644' AS mode", "id", *none)
    roots = spark.createDataFrame([("r", "top")], "root string, tree_id string")
    return trees.flatten(top.union(mid).union(low), roots).select("path", "id")


SQL["path_flatten"] = f"WITH {_LINES_SQL} SELECT path, id FROM l"


def tree_build(spark, d):
    lines = _lines(spark, d).groupBy("o_custkey", "o_orderkey", "l_linenumber").agg(F.min("id").alias("id"))
    none = F.lit(None).cast("string")
    f = lines.select(F.lit("r").alias("root"), F.expr("concat('c', o_custkey, '/o', o_orderkey, '/', l_linenumber)").alias("path"), "id", F.lit("100644").alias("mode"), none.alias("file_id"), none.alias("copied_from"))
    return trees.build(f).select("dir", "tree_id")


_NUL = "chr(0)"
_HASH = "sha256('tree ' || octet_length(encode(p)) || chr(0) || p)"
SQL["tree_build"] = f"""WITH {_LINES_SQL}, f AS (SELECT o_custkey, o_orderkey, l_linenumber, min(id) AS id FROM l GROUP BY ALL),
o AS (SELECT o_custkey, o_orderkey, string_agg('100644 ' || l_linenumber || {_NUL} || id, '' ORDER BY encode(CAST(l_linenumber AS VARCHAR))) AS p FROM f GROUP BY 1, 2),
oi AS (SELECT *, {_HASH} AS id FROM o),
c AS (SELECT o_custkey, string_agg('40000 o' || o_orderkey || {_NUL} || id, '' ORDER BY encode('o' || o_orderkey)) AS p FROM oi GROUP BY 1),
ci AS (SELECT *, {_HASH} AS id FROM c),
t AS (SELECT string_agg('40000 c' || o_custkey || {_NUL} || id, '' ORDER BY encode('c' || o_custkey)) AS p FROM ci)
SELECT '' AS dir, {_HASH} AS tree_id FROM t WHERE p IS NOT NULL
UNION ALL SELECT 'c' || o_custkey, id FROM ci UNION ALL SELECT 'c' || o_custkey || '/o' || o_orderkey, id FROM oi"""


def word_novelty(spark, d):
    b = table(spark, d, "documents")
    name = F.substring_index("text", " ", 3)
    return b.select("doc_id", paths.adds_information(F.col("text"), name).alias("informative"), F.size(paths.telling_words(F.col("text"))).cast("bigint").alias("words"))


_FILLER = ", ".join(f"'{w}'" for w in paths.FILLER)
_WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN (" + _FILLER + "))"
SQL["word_novelty"] = f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS t, {_WORDS.format("array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ')")} AS n FROM documents)
SELECT doc_id, len(t) >= 4 AND len(list_distinct(list_filter(t, lambda x: NOT list_contains(n, x)))) >= 2 AS informative, CAST(len(t) AS BIGINT) AS words FROM w"""


def identity_audit(spark, d):
    """Addresses of commits and tags made of events that aren't those of known customers; bad: an object lacks a role."""
    e = table(spark, d, "events")
    mail = lambda x: F.concat(F.lit("u"), x.cast("string"), F.lit("@x.org"))
    who = lambda role, m: F.concat(F.lit(role + " n <"), m, F.lit("> 1 0\n"))
    tag = F.concat(F.lit("object 1\n"), who("tagger", mail(F.col("user_id") + 1)))
    commit = F.concat(F.lit("tree 1\n"), who("author", mail(F.col("user_id"))), F.when(F.col("event_id") % 7 != 0, who("committer", mail(F.col("user_id") * 2))).otherwise(""))
    objects = e.select(F.when(F.col("event_id") % 5 == 0, "tag").otherwise("commit").alias("type"), F.concat(F.when(F.col("event_id") % 5 == 0, tag).otherwise(commit), F.lit("\nauthor n <none@x.org>\n\n")).alias("text"))
    found = ledger.identities(objects)
    allowed = table(spark, d, "customer").where("c_custkey % 3 = 0").select(mail(F.col("c_custkey")).alias("email"))
    return found.join(ledger.not_allowed(found, allowed), "email")


SQL["identity_audit"] = """WITH e AS (SELECT user_id AS u, event_id % 5 = 0 AS tag, event_id % 7 <> 0 AS two FROM events),
r AS (SELECT u + 1 AS u, false AS bad FROM e WHERE tag UNION ALL SELECT u, NOT two FROM e WHERE NOT tag UNION ALL SELECT u * 2, false FROM e WHERE NOT tag AND two)
SELECT 'u' || u || '@x.org' AS email, bool_or(bad) AS bad FROM r WHERE u NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY u"""


def fence_coverage(spark, d):
    c = table(spark, d, "customer")
    expected = c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("c"), "c_custkey", F.lit("/**")).alias("pattern"))
    committed = c.where("c_custkey % 4 <> 0").select(F.concat(F.lit("c"), "c_custkey", F.lit("/**")).alias("pattern"))
    return ledger.fence_coverage(expected, committed)


SQL["fence_coverage"] = "SELECT 'c' || c_custkey || '/**' AS pattern, CASE WHEN c_custkey % 3 <> 0 THEN 'missing' ELSE 'stale' END AS problem FROM customer WHERE (c_custkey % 3 <> 0) <> (c_custkey % 4 <> 0)"

for _f in (object_ids, object_dedup, verify_objects, snapshot_diff, tree_compare, status_three_way, overwrite_guard, materialise_plan, move_copy_detect, merge_tree_paths, identity_dupes, glob_filter, ignore_filter, path_flatten, tree_build, word_novelty, identity_audit, fence_coverage):
    Q[_f.__name__] = _f
