"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Cheap ones of each family; the driver compares all of them.
NAMES = "object_ids merge_snapshot cherry_pick snapshot_text_diff identity_audit resolve_latest newest_first line_diff unified_diff diff3_merge describe_chain squash_chain snapshot_diff status_three_way move_copy_detect merge_tree_paths glob_filter ignore_filter merge_fields_scalar merged_documents merge_set merge_sequence merge_timestamp merge_log canonical_records merge_preview bundle_import fetch_plan trace_entity ledger_items items_join ref_cas oplog_reverse split_partition".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def by_text(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    got = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    want = [[r[names.index(c)] for c in columns] for r in got.fetchall()]
    assert by_text(df.select(*columns).collect()) == by_text(want)


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["record_id", "field", "base", "ours", "theirs", "resolved", "conflict", "changed"]


@pytest.mark.parametrize("name", ["ref_resolve", "replay_chain", "tree_build", "word_novelty", "closure_missing"])
def test_whole_tables(spark, duck, name):
    """These have SQL over whole tables: no subset of ids stands in it."""
    import re

    import __spark_entry__ as entry

    assert not re.search(r"custkey <= \d|% 10 = 1|FROM benchmark|regionkey = 1", entry.oracle_sql()[name])
    test_query(spark, duck, name)


def test_texts_and_closures_are_whole(spark, duck):
    import __spark_entry__ as entry

    q = entry.queries()
    n = duck.execute("select count(*) from documents").fetchone()[0]
    for name in ("word_novelty", "line_diff", "unified_diff", "diff3_merge"):
        assert q[name](spark, SF).count() == n
    longest = duck.execute("select doc_id, text from documents order by length(text) desc limit 1").fetchone()
    x = {r.doc_id: r for r in q["line_diff"](spark, SF).collect()}
    assert x[longest[0]].edits > 1000 and all(r.replayed for r in x.values() if r.replayed is not None)
    nodes = "select 'r' || r_regionkey from region union select 'n' || n_nationkey from nation join region on r_regionkey = n_regionkey"
    nodes += " union select 'c' || c_custkey from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey"
    whole = "orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey"
    nodes += f" union select 'o' || o_orderkey from {whole} union select 'l' || l_orderkey || ':' || l_linenumber from lineitem join ({whole}) on o_orderkey = l_orderkey"
    want = duck.execute(f"select x from ({nodes}) t(x) where right(x, 1) = '7'").fetchall()
    assert sorted(r.node for r in q["closure_missing"](spark, SF).collect()) == sorted(r[0] for r in want)
