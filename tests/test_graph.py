"""Questions on random histories against walks in plain Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from mergeloom.operators import graph


def history(r, n, roots=2, most=3):
    """Parents of n commits; the later ones mostly go on with recent ones."""
    par = {}
    for i in range(n):
        if i < roots or r.random() < 0.03:
            continue
        low = 0 if r.random() < 0.3 else max(0, i - 4)
        ps = list(dict.fromkeys(r.randrange(low, i) for _ in range(r.choice((1, 1, 1, 2, most)))))
        par[i] = ps
    name = {i: f"n{(i * 7919) % 1009:04}" for i in range(n)}
    return {name[i]: [name[p] for p in ps] for i, ps in par.items()}, [name[i] for i in range(n)]


def frame(spark, par):
    return spark.createDataFrame([(c, p, i) for c, ps in par.items() for i, p in enumerate(ps)], "child string, parent string, ordinal int")


def up(par, n):
    seen, todo = set(), [n]
    while todo:
        if (x := todo.pop()) not in seen:
            seen.add(x)
            todo += par.get(x, ())
    return seen


def test_against_walks(spark):
    r = random.Random(1)
    par, nodes = history(r, 70)
    h = graph.History(frame(spark, par))
    todo = [(r.choice(nodes), r.choice(nodes)) for _ in range(25)] + [("alone", "alone"), ("alone", nodes[-1])]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(todo)], "pair int, left string, right string")
    sides = [(up(par, a), up(par, b)) for a, b in todo]
    assert {tuple(x) for x in graph.ahead_behind(h, pairs).collect()} == {(i, len(a - b), len(b - a)) for i, (a, b) in enumerate(sides)}
    assert {tuple(x) for x in graph.commits_between(h, pairs).collect()} == {(i, x) for i, (a, b) in enumerate(sides) for x in b - a}
    want = {(i, c) for i, (a, b) in enumerate(sides) for c in a & b if not any(c in up(par, d) for d in a & b if d != c)}
    assert {tuple(x) for x in graph.merge_bases(h, pairs).collect()} == want
    assert {tuple(x) for x in graph.is_ancestor(h, pairs).collect()} == {(i, todo[i][0] in b) for i, (_, b) in enumerate(sides)}
    start = pairs.selectExpr("pair AS root", "left AS node")
    got = graph.reachable(h, start).collect()
    assert len(got) == len({tuple(x) for x in got}) and {tuple(x) for x in got} == {(i, x) for i, (a, _) in enumerate(sides) for x in a}
    logs = {}
    for x in graph.first_parent_log(h, start, 9).collect():
        logs.setdefault(x.root, []).append((x.seq, x.node))
    for i, (a, _) in enumerate(todo):
        chain = [a]
        while par.get(chain[-1]) and len(chain) < 9:
            chain.append(par[chain[-1]][0])
        assert sorted(logs[i]) == list(enumerate(chain))
    down = {x: {y for y in nodes if x in up(par, y)} for x in nodes[:5]}
    got = graph.descendants(frame(spark, par), spark.createDataFrame([(x, x) for x in nodes[:5]], "root string, node string")).collect()
    assert {x: {y.node for y in got if y.root == x} for x in nodes[:5]} == down


def test_orders_against_plain_ones(spark, monkeypatch):
    """With blocks so small that chains are longer."""
    monkeypatch.setattr(graph, "BLOCK", 2)
    r = random.Random(4)
    par, nodes = history(r, 60, roots=5)
    some = [n for n in nodes if r.random() < 0.9]
    inner = {c: [p for p in ps if p in some] for c, ps in par.items() if c in some}
    level = {}
    for n in nodes:
        if n in some:
            level[n] = max((level[p] + 1 for p in inner.get(n, ())), default=0)
    given = spark.createDataFrame([(n,) for n in some], "node string")
    assert {x.node: x.level for x in graph.levels(frame(spark, par), given).collect()} == level
    waiting = dict.fromkeys(some, 0)
    for ps in inner.values():
        for p in ps:
            waiting[p] += 1
    ready, order = [n for n, w in waiting.items() if not w], []
    heapq.heapify(ready)
    while ready:
        order.append(heapq.heappop(ready))
        for p in inner.get(order[-1], ()):
            waiting[p] -= 1
            if not waiting[p]:
                heapq.heappush(ready, p)
    assert [x.node for x in graph.newest_first(frame(spark, par), given).orderBy("seq").collect()] == order
    label = {x.node: x.component for x in graph.components(frame(spark, inner)).collect()}
    for c, ps in inner.items():
        assert all(label[c] == label[p] for p in ps)
    near = {}
    for c, ps in inner.items():
        for p in ps:
            near.setdefault(c, set()).add(p)
            near.setdefault(p, set()).add(c)
    assert len(set(label.values())) == len({min(up({k: list(v) for k, v in near.items()}, n)) for n in label})


def test_steps_grow_with_the_logarithm(spark, monkeypatch):
    """A chain of 3000 commits takes a dozen rounds, not 3000."""
    e = spark.range(2999).selectExpr("CAST(id + 1 AS STRING) AS child", "CAST(id AS STRING) AS parent", "0 AS ordinal")
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, real=graph.cut: written.append(1) or real(df))
    got = graph.ahead_behind(e, spark.createDataFrame([(0, "2999", "10")], "pair int, left string, right string")).collect()
    assert [tuple(x) for x in got] == [(0, 2989, 0)] and len(written) < 25


def test_circles_raise(spark):
    e = frame(spark, {"a": ["b"], "b": ["c"], "c": ["a"]})
    with pytest.raises(RuntimeError, match="circle"):
        graph.reachable(e, spark.createDataFrame([(0, "a")], "root int, node string")).collect()


def test_empty(spark):
    e = frame(spark, {"a": ["b"]}).limit(0)
    start = spark.createDataFrame([(0, "x")], "root int, node string")
    assert [tuple(x) for x in graph.reachable(e, start).collect()] == [(0, "x")]
    assert graph.reachable(e, start.limit(0)).collect() == []
    one = start.select("node")
    assert [tuple(x) for x in graph.levels(e, one).collect()] == [("x", 0)] and [tuple(x) for x in graph.newest_first(e, one).collect()] == [("x", 0)]
    assert graph.newest_first(e, one.limit(0)).collect() == []


def test_numbers_are_in_order(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("x"))
    assert [r.x for r in graph.numbered(df.repartition(7), ["x"], "n").orderBy("n").collect()] == list(range(100))
