"""Queries over records, logs and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..functions.canonical import canon_json
from ..operators import ledger, merging, records, textdiff
from .versions import MERGED_SQL, as_fields, orders, table

Q: dict = {}
SQL: dict[str, str] = {}


def _merged(spark, d):
    return records.merge_fields(*[as_fields(v) for v in orders(spark, d)])


def merge_fields_scalar(spark, d):
    return _merged(spark, d)


SQL["merge_fields_scalar"] = MERGED_SQL + "SELECT record_id, field, base, ours, theirs, resolved, conflict, changed FROM merged"


def merge_conflicts(spark, d):
    return _merged(spark, d).where("conflict").select("record_id", "field", "ours", "theirs")


SQL["merge_conflicts"] = MERGED_SQL + "SELECT record_id, field, ours, theirs FROM merged WHERE conflict"


def merge_totals(spark, d):
    return records.totals(_merged(spark, d))


SQL["merge_totals"] = MERGED_SQL + "SELECT count(*) AS fields, count(*) FILTER (conflict) AS conflicts, count(*) FILTER (changed) AS changed, count(*) FILTER (changed AND resolved IS NULL) AS removed FROM merged"


def merge_record_deletes(spark, d):
    m = _merged(spark, d)
    return m.where("base is not null and resolved is null").select("record_id", "field", "base")


SQL["merge_record_deletes"] = MERGED_SQL + "SELECT record_id, field, base FROM merged WHERE base IS NOT NULL AND resolved IS NULL"


def merged_documents(spark, d):
    # a name that needs escapes, and looks like the end of a name
    named = _merged(spark, d).withColumn("field", F.replace("field", F.lit("status"), F.lit('sta"]:t\\us')))
    out = records.merged_records(named)
    return out.select("record_id", "document", F.array_join("conflicts", ",").alias("conflicts"), F.array_join("changed_fields", ",").alias("changed_fields"), "clean")


SQL["merged_documents"] = (
    MERGED_SQL
    + """, named AS (SELECT * REPLACE (replace(field, 'status', 'sta"]:t' || chr(92) || 'us') AS field), replace(field, 'status', 'sta' || chr(92) || '"]:t' || chr(92) || chr(92) || 'us') AS shown FROM merged)
SELECT record_id, '{' || coalesce(string_agg('"' || shown || '":' || resolved, ',' ORDER BY field) FILTER (resolved IS NOT NULL), '') || '}' AS document,
coalesce(string_agg(field, ',' ORDER BY field) FILTER (conflict), '') AS conflicts, coalesce(string_agg(field, ',' ORDER BY field) FILTER (changed), '') AS changed_fields, NOT bool_or(conflict) AS clean FROM named GROUP BY record_id"""
)


def _parts(spark, d):
    """Parts of each order as canonical arrays: base has the first lines, ours and theirs drop and add some."""
    li = table(spark, d, "lineitem")
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.expr(c), F.struct("l_linenumber", "l_partkey")))), lambda x: x["l_partkey"].cast("string"))
    text = lambda a: F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))
    return li.groupBy("l_orderkey").agg(text(pick("l_linenumber <= 3")).alias("b"), text(pick("l_linenumber <> 2 AND l_linenumber <= 5")).alias("o"), text(pick("l_linenumber <> 1 AND l_linenumber <> 4")).alias("t"))


def _merge_arrays(spark, d, strategy):
    p = _parts(spark, d)
    got = p.withColumn("d", records.decide(F.col("b"), F.col("o"), F.col("t"), F.lit(strategy)))
    return got.select("l_orderkey", "d.resolved", "d.conflict")


def _arrays_sql(order: str) -> str:
    return f"""WITH p AS (SELECT l_orderkey, coalesce(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber <= 3), []) AS b,
coalesce(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber <> 2 AND l_linenumber <= 5), []) AS o, coalesce(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber <> 1 AND l_linenumber <> 4), []) AS t FROM lineitem GROUP BY 1),
c AS (SELECT *, list_concat(list_filter(b, lambda x: list_contains(o, x) AND list_contains(t, x)), list_concat(list_filter(o, lambda x: NOT list_contains(b, x)), list_filter(t, lambda x: NOT list_contains(b, x)))) AS u FROM p),
e AS (SELECT l_orderkey, b, o, t, list_filter(u, lambda x, i: list_position(u, x) = i) AS u FROM c),
r AS (SELECT l_orderkey, CASE WHEN o = b THEN t WHEN t = b THEN o WHEN o = t THEN o ELSE {order} END AS a FROM e)
SELECT l_orderkey, '[' || array_to_string(a, ',') || ']' AS resolved, false AS conflict FROM r"""


def merge_set(spark, d):
    return _merge_arrays(spark, d, "set")


SQL["merge_set"] = _arrays_sql("list_sort(u)")


def merge_sequence(spark, d):
    return _merge_arrays(spark, d, "sequence")


SQL["merge_sequence"] = _arrays_sql("u")


def merge_timestamp(spark, d):
    o = table(spark, d, "orders")
    iso = lambda e: f"""concat('"', date_format({e}, "yyyy-MM-dd'T'HH:mm:ss"), 'Z"')"""
    v = o.selectExpr("o_orderkey", f"{iso('o_orderdate')} AS b", f"CASE WHEN o_orderkey % 3 = 0 THEN {iso('o_orderdate + make_interval(0, 0, 0, o_orderkey % 40)')} WHEN o_orderkey % 10 = 1 THEN '1' ELSE {iso('o_orderdate')} END AS o", f"CASE WHEN o_orderkey % 2 = 0 THEN {iso('o_orderdate + make_interval(0, 0, 0, o_orderkey % 30)')} WHEN o_orderkey % 5 = 1 THEN '2' ELSE {iso('o_orderdate')} END AS t")
    got = v.withColumn("d", records.decide(F.col("b"), F.col("o"), F.col("t"), F.lit("timestamp")))
    return got.select("o_orderkey", "d.resolved", "d.conflict")


_ISO = "'\"' || strftime({}, '%Y-%m-%dT%H:%M:%S') || 'Z\"'"
SQL["merge_timestamp"] = f"""WITH v AS (SELECT o_orderkey, {_ISO.format("o_orderdate")} AS b,
CASE WHEN o_orderkey % 3 = 0 THEN {_ISO.format("o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER))")} WHEN o_orderkey % 10 = 1 THEN '1' ELSE {_ISO.format("o_orderdate")} END AS o,
CASE WHEN o_orderkey % 2 = 0 THEN {_ISO.format("o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER))")} WHEN o_orderkey % 5 = 1 THEN '2' ELSE {_ISO.format("o_orderdate")} END AS t FROM orders),
f AS (SELECT *, o <> b AND t <> b AND o <> t AS both_, o IN ('1', '2') OR t IN ('1', '2') AS bad FROM v)
SELECT o_orderkey, CASE WHEN NOT both_ THEN CASE WHEN o = b THEN t ELSE o END WHEN bad THEN o ELSE greatest(o, t) END AS resolved, both_ AND bad AS conflict FROM f"""


def merge_log(spark, d):
    e = table(spark, d, "events").withColumn("line", F.expr("""CASE WHEN event_id % 3 = 0 THEN concat('{"at":"', date_format(ts, 'yyyy-MM-dd'), '","k":', event_id % 5, '}') WHEN event_id % 11 = 0 THEN ' \\t\\r' WHEN event_id % 13 = 0 THEN concat('\\t', event_type, '\\r') WHEN event_id % 17 = 0 THEN event_type ELSE concat('note ', event_type) END"""))
    side = lambda c: e.where(c).selectExpr("user_id", "event_id AS pos", "line")
    return records.merge_log(side("event_id % 4 < 2"), side("event_id % 4 < 3"), side("event_id % 4 <> 2"), ["user_id"])


SQL["merge_log"] = """WITH e AS (SELECT user_id, event_id, trim(CASE WHEN event_id % 3 = 0 THEN '{"at":"' || strftime(ts, '%Y-%m-%d') || '","k":' || (event_id % 5) || '}' WHEN event_id % 11 = 0 THEN ' ' || chr(9) || chr(13) WHEN event_id % 13 = 0 THEN chr(9) || event_type || chr(13) WHEN event_id % 17 = 0 THEN event_type ELSE 'note ' || event_type END, ' ' || chr(9) || chr(13)) AS line FROM events),
a AS (SELECT user_id, side, event_id AS pos, line FROM e, (VALUES (0), (1), (2)) s(side) WHERE line <> '' AND ((side = 0 AND event_id % 4 < 2) OR (side = 1 AND event_id % 4 < 3) OR (side = 2 AND event_id % 4 <> 2))),
m AS (SELECT user_id, line, max(n) AS most FROM (SELECT user_id, line, side, count(*) AS n FROM a GROUP BY ALL) GROUP BY ALL),
k AS (SELECT * FROM (SELECT a.*, most, row_number() OVER (PARTITION BY user_id, line ORDER BY side, pos) AS rn FROM a JOIN m USING (user_id, line)) WHERE rn <= most),
t AS (SELECT *, coalesce(last_value(CASE WHEN starts_with(line, '{') THEN line ->> '$.at' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY side, pos ROWS UNBOUNDED PRECEDING), '') AS at_ FROM k)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY at_, side, pos) AS INTEGER) AS seq, line FROM t"""


def canonical_records(spark, d):
    p = table(spark, d, "part")
    raw = p.selectExpr("p_partkey", """concat('{"size": ', p_size, '.0, "name":"', p_name, '", "brand" : "', p_brand, '", "nested":{"b":[1, 2.50],"a":null}}') AS raw""")
    return raw.select("p_partkey", canon_json("raw").alias("record"))


SQL["canonical_records"] = """SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '","nested":{"a":null,"b":[1,2.5]},"size":' || p_size || '}' AS record FROM part"""


def merge_preview(spark, d):
    k = F.col("path").cast("bigint")
    both = ledger.candidates(_merged(spark, d)).select("path", F.when(k % 19 != 0, "item").alias("driver"), "ours_present", "theirs_present", "conflicts", F.when(k % 23 == 0, 1).otherwise(0).alias("unions"), F.when(k % 29 == 0, "union_reanchor").when(k % 31 == 0, "ours").alias("stream"))
    return ledger.preview_totals(ledger.preview(both), strict=True)


SQL["merge_preview"] = (
    MERGED_SQL
    + """, g AS (SELECT CAST(record_id AS BIGINT) AS k, count(*) FILTER (conflict) AS conflicts, count(ours) AS o, count(theirs) AS t FROM merged GROUP BY record_id
  HAVING bool_or(ours IS DISTINCT FROM base) AND bool_or(theirs IS DISTINCT FROM base)),
r AS (SELECT CASE WHEN k % 19 = 0 THEN 'unprotected' WHEN o = 0 OR t = 0 THEN 'delete_modify' WHEN k % 29 = 0 THEN 'union' WHEN k % 31 = 0 THEN 'clean' WHEN conflicts > 0 THEN 'conflict' WHEN k % 23 = 0 THEN 'union' ELSE 'clean' END AS r FROM g)
SELECT count(*) FILTER (r = 'clean') AS clean, count(*) FILTER (r = 'union') AS "union", count(*) FILTER (r = 'conflict') AS conflict, count(*) FILTER (r = 'delete_modify') AS delete_modify, count(*) FILTER (r = 'unprotected') AS unprotected, count(*) FILTER (r IN ('conflict', 'delete_modify', 'unprotected')) AS blocking FROM r"""
)


def _edited(spark, d):
    """Texts cut into lines of words, and two edited versions of each."""
    b = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "([a-z]+) ", "$1\n").alias("base"))
    return b.select("doc_id", "base", F.regexp_replace("base", "the", "THE").alias("ours"), F.concat(F.regexp_replace("base", "(?m)^of$", "OF\nMORE"), F.lit("\n")).alias("theirs"))


def line_diff(spark, d):
    e = _edited(spark, d).withColumn("x", textdiff.diff_udf("base", "theirs"))
    return e.select("doc_id", "x.distance", F.size("x.edits").alias("edits"), (F.array_join(textdiff.applied(F.col("x.edits")), "\n") == F.substring("theirs", F.lit(1), F.length("theirs") - 1)).alias("replayed"))


def unified_diff(spark, d):
    return _edited(spark, d).select("doc_id", textdiff.unified_udf("base", "ours").alias("diff"))


def diff3_merge(spark, d):
    m = _edited(spark, d).withColumn("m", textdiff.merge3_udf("base", "ours", "theirs"))
    return m.select("doc_id", "m.clean", "m.text", F.size("m.conflicts").alias("conflicts"))


#: Lines of base (i from 1): hit holds "the", so ours changes it; of is a line of its own, which theirs makes two of. No line of base is like a new one.
_EDITED_SQL = """b AS (SELECT doc_id, regexp_replace(text, '([a-z]+) ', '\\1' || chr(10), 'g') AS base FROM documents),
p AS (SELECT doc_id, base, string_split(coalesce(base, ''), chr(10)) AS parts FROM b),
w AS (SELECT doc_id, base, CASE WHEN parts[len(parts)] = '' THEN list_slice(parts, 1, len(parts) - 1) ELSE parts END AS parts FROM p),
l AS (SELECT doc_id, i, parts[i] AS x, contains(parts[i], 'the') AS hit, parts[i] = 'of' AS of_ FROM w, unnest(range(1, len(parts) + 1)) u(i))"""
SQL["line_diff"] = f"""WITH {_EDITED_SQL}, n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (of_) AS k FROM l GROUP BY doc_id)
SELECT w.doc_id, CAST(CASE WHEN base IS NULL THEN 0 ELSE 3 * coalesce(k, 0) + CASE WHEN base = '' OR ends_with(base, chr(10)) THEN 1 ELSE 0 END END AS INTEGER) AS distance,
CAST(CASE WHEN base IS NULL THEN 0 ELSE coalesce(n, 0) + 2 * coalesce(k, 0) + CASE WHEN base = '' OR ends_with(base, chr(10)) THEN 1 ELSE 0 END END AS INTEGER) AS edits, CASE WHEN base IS NOT NULL THEN true END AS replayed FROM w LEFT JOIN n USING (doc_id)"""
SQL["unified_diff"] = f"""WITH {_EDITED_SQL}, c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l WHERE hit),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i - before > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c),
h AS (SELECT doc_id, g, greatest(1, min(i) - 3) AS a, max(i) + 3 AS z FROM g GROUP BY doc_id, g),
e AS (SELECT l.doc_id, h.g, l.i, l.x, l.hit, sum(CASE WHEN l.hit THEN 0 ELSE 1 END) OVER (PARTITION BY l.doc_id, h.g ORDER BY l.i) AS kept FROM h JOIN l ON l.doc_id = h.doc_id AND l.i BETWEEN h.a AND h.z),
o AS (SELECT doc_id, g, i, kept, CASE WHEN hit THEN 0 ELSE -1 END AS part, CASE WHEN hit THEN '-' ELSE ' ' END || x AS x FROM e UNION ALL SELECT doc_id, g, i, kept, 1, '+' || replace(x, 'the', 'THE') FROM e WHERE hit),
t AS (SELECT doc_id, g, '@@ -' || min(i) || ',' || count(DISTINCT i) || ' +' || min(i) || ',' || count(DISTINCT i) || ' @@' || chr(10) || string_agg(x || chr(10), '' ORDER BY kept, part, i) AS x FROM o GROUP BY doc_id, g),
u AS (SELECT doc_id, '--- a' || chr(10) || '+++ b' || chr(10) || string_agg(x, '' ORDER BY g) AS diff FROM t GROUP BY doc_id)
SELECT w.doc_id, coalesce(diff, '') AS diff FROM w LEFT JOIN u USING (doc_id)"""
SQL["diff3_merge"] = f"""WITH {_EDITED_SQL}, s AS (SELECT *, sum(CASE WHEN hit OR of_ THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l),
k AS (SELECT doc_id, r, 1 AS part, string_agg(x || chr(10), '' ORDER BY i) AS old, string_agg(CASE WHEN hit THEN replace(x, 'the', 'THE') ELSE x END || chr(10), '' ORDER BY i) AS o, string_agg(CASE WHEN of_ THEN 'OF' || chr(10) || 'MORE' ELSE x END || chr(10), '' ORDER BY i) AS t, bool_or(hit) AS oc, bool_or(of_) AS tc FROM s WHERE hit OR of_ GROUP BY doc_id, r),
m AS (SELECT doc_id, r, 1 AS part, CASE WHEN oc AND tc THEN '<<<<<<< ours' || chr(10) || o || '||||||| base' || chr(10) || old || '=======' || chr(10) || t || '>>>>>>> theirs' || chr(10) WHEN oc THEN o ELSE t END AS x, oc AND tc AS clash FROM k
  UNION ALL SELECT doc_id, r, 0, x || chr(10), false FROM s WHERE NOT hit AND NOT of_),
d AS (SELECT doc_id, string_agg(x, '' ORDER BY r, part) AS x, count(*) FILTER (clash) AS n FROM m GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) = 0 AS clean, CASE WHEN base IS NULL THEN '' ELSE coalesce(x, '') || CASE WHEN base = '' OR ends_with(base, chr(10)) THEN chr(10) ELSE '' END END AS text, CAST(coalesce(n, 0) AS INTEGER) AS conflicts FROM w LEFT JOIN d USING (doc_id)"""

#: Texts and records of three versions: ours changes the first line (or lang), theirs the last (or n), or both the same place.
CONTENTS_SQL = """
d AS (SELECT doc_id AS k, source || '/' || lang || '/' || doc_id AS path, replace(coalesce(text, ''), chr(10), ' ') AS line, lang, n_chars AS n FROM documents),
c AS (SELECT k, path, CASE WHEN k % 5 = 0 THEN 'record' ELSE 'blob' END AS type,
  CASE WHEN k % 5 = 0 THEN '{"lang":"' || lang || '","n":' || n || '}' ELSE 'first' || chr(10) || line || chr(10) || 'last' || chr(10) END AS b,
  CASE WHEN k % 5 = 0 THEN '{"lang":"ours","n":' || n || '}' ELSE 'ours' || chr(10) || line || chr(10) || 'last' || chr(10) END AS o,
  CASE WHEN k % 5 = 0 THEN CASE WHEN k % 10 = 0 THEN '{"lang":"theirs","n":' || n || '}' ELSE '{"lang":"' || lang || '","n":' || (n + 1) || '}' END
    ELSE CASE WHEN k % 7 = 0 THEN 'theirs' ELSE 'first' END || chr(10) || line || chr(10) || CASE WHEN k % 7 <> 0 AND k % 4 <> 0 THEN 'theirs' ELSE 'last' END || chr(10) END AS t,
  CASE WHEN k % 5 = 0 THEN CASE WHEN k % 10 = 0 THEN '{"lang":"ours","n":' || n || '}' ELSE '{"lang":"ours","n":' || (n + 1) || '}' END
    WHEN k % 7 = 0 THEN concat_ws(chr(10), '<<<<<<< ours', 'ours', '||||||| base', 'first', '=======', 'theirs', '>>>>>>> theirs', line, 'last', '')
    WHEN k % 4 = 0 THEN 'ours' || chr(10) || line || chr(10) || 'last' || chr(10) ELSE 'ours' || chr(10) || line || chr(10) || 'theirs' || chr(10) END AS m,
  CASE WHEN k % 5 = 0 THEN k % 10 = 0 ELSE k % 7 = 0 END AS clash FROM d)
"""


def _contents(spark, d):
    """(base, ours, theirs, objects); theirs lacks each 11th path, and gives each 23rd another identity."""
    t = table(spark, d, "documents").selectExpr("doc_id AS k", "concat(source, '/', lang, '/', doc_id) AS path", "replace(coalesce(text, ''), '\\n', ' ') AS line", "lang", "n_chars AS n")
    record = lambda lang, n: F.concat(F.lit('{"lang":"'), lang, F.lit('","n":'), n.cast("string"), F.lit("}"))
    text = lambda first, last: F.concat(first, F.lit("\n"), "line", F.lit("\n"), last, F.lit("\n"))
    k, lang, n, first, last = F.col("k"), F.col("lang"), F.col("n"), F.lit("first"), F.lit("last")
    rec = k % 5 == 0
    theirs = F.when(k % 10 == 0, record(F.lit("theirs"), n)).otherwise(record(lang, n + 1))
    theirs = F.when(rec, theirs).otherwise(text(F.when(k % 7 == 0, "theirs").otherwise(first), F.when((k % 7 != 0) & (k % 4 != 0), "theirs").otherwise(last)))
    v = t.select("k", "path", F.when(rec, "record").otherwise("blob").alias("type"), F.when(rec, record(lang, n)).otherwise(text(first, last)).alias("b"), F.when(rec, record(F.lit("ours"), n)).otherwise(text(F.lit("ours"), last)).alias("o"), theirs.alias("t"))
    fid = F.substring(F.sha2(F.concat(F.lit("f"), k.cast("string")), 256), 1, 32)
    other = F.substring(F.sha2(F.concat(F.lit("t"), k.cast("string")), 256), 1, 32)
    snap = lambda side, f: v.select("path", identity.object_id(F.col("type"), F.col(side)).alias("id"), F.lit("100644").alias("mode"), f.alias("file_id"), F.lit(None).cast("string").alias("copied_from"), "k")
    objects = v.select("type", F.explode(F.array("b", "o", "t")).alias("x")).select(identity.object_id(F.col("type"), F.col("x")).alias("id"), "type", F.col("x").cast("binary").alias("payload")).dropDuplicates(["id"])
    return snap("b", fid).drop("k"), snap("o", fid).drop("k"), snap("t", F.when(k % 23 == 0, other).otherwise(fid)).where("k % 11 <> 0").drop("k"), objects


def _files_out(merged):
    return merged.files.select("path", "action", "id", "mode", "file_id", "copied_from", F.array_join("reasons", ",").alias("reasons"), F.array_join("fields", ",").alias("fields"))


def merge_snapshot(spark, d):
    return _files_out(merging.merge_snapshots(*_contents(spark, d)))


def _oid(kind: str, text: str) -> str:
    return f"sha256({kind} || ' ' || octet_length(encode({text})) || chr(0) || {text})"


_FID, _TID = "substr(sha256('f' || k), 1, 32)", "substr(sha256('t' || k), 1, 32)"
SQL["merge_snapshot"] = f"""WITH {CONTENTS_SQL},
s AS (SELECT *, k % 11 = 0 AS gone, o <> b AS oc, t <> b OR k % 23 = 0 AS tc FROM c),
a AS (SELECT *, CASE WHEN gone THEN CASE WHEN oc THEN 'conflict' ELSE 'removed' END WHEN NOT tc THEN 'ours' WHEN NOT oc THEN 'theirs' WHEN o = t THEN 'agree' WHEN clash THEN 'conflict' ELSE 'merged' END AS action, NOT gone AND oc AND tc AND k % 23 = 0 AS id_clash FROM s)
SELECT path, action, CASE WHEN action = 'removed' THEN NULL WHEN action = 'theirs' THEN {_oid("type", "t")} WHEN action IN ('ours', 'agree') OR gone THEN {_oid("type", "o")} ELSE {_oid("type", "m")} END AS id, CASE WHEN action <> 'removed' THEN '100644' END AS mode,
CASE WHEN action = 'removed' THEN NULL WHEN id_clash THEN least({_FID}, {_TID}) WHEN action = 'theirs' AND k % 23 = 0 THEN {_TID} ELSE {_FID} END AS file_id, CAST(NULL AS VARCHAR) AS copied_from,
concat_ws(',', CASE WHEN action = 'conflict' AND (gone OR type = 'blob') THEN 'content' END, CASE WHEN id_clash THEN 'identity' END, CASE WHEN action = 'conflict' AND NOT gone AND type = 'record' THEN 'record' END) AS reasons,
CASE WHEN action = 'conflict' AND NOT gone AND type = 'record' THEN 'lang' ELSE '' END AS fields FROM a"""


def cherry_pick(spark, d):
    """What ours changed, brought to theirs."""
    base, ours, theirs, objects = _contents(spark, d)
    return _files_out(merging.merge_snapshots(base, theirs, ours, objects))


_FLIP = "concat_ws(chr(10), '<<<<<<< ours', 'theirs', '||||||| base', 'first', '=======', 'ours', '>>>>>>> theirs', line, 'last', '')"
SQL["cherry_pick"] = f"""WITH {CONTENTS_SQL},
s AS (SELECT c.*, d.line, c.k % 11 = 0 AS gone, o <> b AS oc, t <> b OR c.k % 23 = 0 AS tc FROM c JOIN d ON d.k = c.k),
p AS (SELECT *, CASE WHEN k % 10 = 0 THEN t WHEN type = 'blob' AND k % 7 = 0 THEN {_FLIP} ELSE m END AS x FROM s),
a AS (SELECT *, CASE WHEN gone THEN CASE WHEN oc THEN 'conflict' ELSE 'removed' END WHEN NOT oc THEN 'ours' WHEN NOT tc THEN 'theirs' WHEN o = t THEN 'agree' WHEN clash THEN 'conflict' ELSE 'merged' END AS action, NOT gone AND oc AND tc AND k % 23 = 0 AS id_clash FROM p)
SELECT path, action, CASE WHEN gone THEN NULL WHEN action = 'theirs' THEN {_oid("type", "o")} WHEN action IN ('ours', 'agree') THEN {_oid("type", "t")} ELSE {_oid("type", "x")} END AS id, CASE WHEN NOT gone THEN '100644' END AS mode,
CASE WHEN gone THEN NULL WHEN id_clash THEN least({_FID}, {_TID}) WHEN action = 'ours' AND k % 23 = 0 THEN {_TID} ELSE {_FID} END AS file_id, CAST(NULL AS VARCHAR) AS copied_from,
concat_ws(',', CASE WHEN action = 'conflict' AND (gone OR type = 'blob') THEN 'content' END, CASE WHEN id_clash THEN 'identity' END, CASE WHEN action = 'conflict' AND NOT gone AND type = 'record' THEN 'record' END) AS reasons,
CASE WHEN action = 'conflict' AND NOT gone AND type = 'record' THEN 'lang' ELSE '' END AS fields FROM a"""


def snapshot_text_diff(spark, d):
    """Unified diffs of all texts and records that differ between base and theirs."""
    base, _, theirs, objects = _contents(spark, d)
    return merging.diff(base, theirs, objects)


SQL["snapshot_text_diff"] = f"""WITH {CONTENTS_SQL}, l AS (SELECT c.*, d.lang, d.n, d.line FROM c JOIN d ON d.k = c.k),
x AS (SELECT *, CASE WHEN type = 'record' THEN '"lang": "' || lang || '"' || chr(10) || '"n": ' || n ELSE 'first' || chr(10) || line || chr(10) || 'last' END AS before FROM l WHERE k % 11 = 0 OR t <> b)
SELECT path, CASE WHEN k % 11 = 0 THEN '--- a/' || path || chr(10) || '+++ /dev/null' || chr(10) || '@@ -1,' || (CASE WHEN type = 'record' THEN 2 ELSE 3 END) || ' +0,0 @@' || chr(10) || '-' || replace(before, chr(10), chr(10) || '-') || chr(10)
WHEN type = 'record' THEN '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || CASE WHEN k % 10 = 0 THEN '-"lang": "' || lang || '"' || chr(10) || '+"lang": "theirs"' || chr(10) || ' "n": ' || n ELSE ' "lang": "' || lang || '"' || chr(10) || '-"n": ' || n || chr(10) || '+"n": ' || (n + 1) END || chr(10)
ELSE '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,3 +1,3 @@' || chr(10) || CASE WHEN k % 7 = 0 THEN '-first' || chr(10) || '+theirs' || chr(10) || ' ' || line || chr(10) || ' last' ELSE ' first' || chr(10) || ' ' || line || chr(10) || '-last' || chr(10) || '+theirs' END || chr(10) END AS text FROM x"""

for _f in (merge_fields_scalar, merge_conflicts, merge_totals, merge_record_deletes, merged_documents, merge_set, merge_sequence, merge_timestamp, merge_log, canonical_records, merge_preview, line_diff, unified_diff, diff3_merge, merge_snapshot, cherry_pick, snapshot_text_diff):
    Q[_f.__name__] = _f
