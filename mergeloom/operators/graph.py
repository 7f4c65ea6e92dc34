"""Reachability and order on a history graph held as edges (child, parent, ordinal).

A history is cut into chains, along which each node is the first parent of the next.
Pointer doubling finds them in steps that grow with the logarithm of the longest.
What a node reaches of a chain is all below some place, so a reached set is a place
a chain, not a row a node, and is found in as many steps as a path changes chains.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..shared import stored

#: Places of a chain that a running maximum takes in one group.
BLOCK = 1 << 16


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that loops don't lengthen its lineage."""
    return stored(df, "graph")


def _measured(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """cut(df), and metrics taken while it was written, so that they cost no job of their own."""
    seen = Observation()
    out = cut(df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in metrics.items()]))
    return out, seen.get


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(df) and its number of rows."""
    out, seen = _measured(df, n=F.count(F.lit(1)))
    return out, seen["n"]


def edges(commits: DataFrame) -> DataFrame:
    """Edges of commits (id, parents)."""
    return commits.select(F.col("id").alias("child"), F.posexplode("parents").alias("ordinal", "parent")).select("child", "parent", "ordinal")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _first_parents(edges_: DataFrame) -> DataFrame:
    """(node, up): the parent with the least ordinal; without ordinals, the least parent."""
    first = F.min_by("parent", "ordinal") if "ordinal" in edges_.columns else F.min("parent")
    return edges_.groupBy(F.col("child").alias("node")).agg(first.alias("up"))


def chains(edges_: DataFrame) -> DataFrame:
    """(node, chain, pos): each node's chain, named by its lowest node, and its place above that.

    Of the nodes with one first parent, the least goes on with its chain; the others
    start chains of their own. A node's place is looked up by doubling: those still
    under way all look at different nodes, so no key is hot.
    """
    link = cut(_first_parents(edges_).groupBy("up").agg(F.min("node").alias("node")))
    active = link.select("node", F.col("up").alias("to"), F.lit(1).cast("bigint").alias("hops"))
    done: list[DataFrame] = []
    left = -1
    while True:
        here = active.select(F.col("node").alias("at"), F.col("to").alias("next"), F.col("hops").alias("more"), F.lit(False).alias("ended"))
        ended = [d.select(F.col("node").alias("at"), F.col("to").alias("next"), F.col("hops").alias("more"), F.lit(True).alias("ended")) for d in done]
        j = active.join(_union([here, *ended]), F.col("to") == F.col("at"), "left")
        j = j.select("node", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("ended", F.lit(True)).alias("ended"))
        j, seen = _measured(j, active=F.count_if(~F.col("ended")))
        done.append(j.where("ended").drop("ended"))
        active = j.where("not ended").drop("ended")
        if not seen["active"]:
            break
        if seen["active"] == left:  # on paths, each round ends for some
            raise RuntimeError("the history has a circle")
        left = seen["active"]
    inner = _union(done).select("node", F.col("to").alias("chain"), F.col("hops").alias("pos"))
    ends = edges_.select(F.explode(F.array("child", "parent")).alias("node")).distinct().join(link, "node", "left_anti")
    return inner.union(ends.select("node", F.col("node").alias("chain"), F.lit(0).cast("bigint").alias("pos")))


@dataclass
class History:
    """Edges with their chains, so that several questions share them. Functions here take it in place of edges."""

    edges: DataFrame

    @cached_property
    def links(self) -> DataFrame:
        """The edges, read from what they were computed from once."""
        return cut(self.edges.select([c for c in ("child", "parent", "ordinal") if c in self.edges.columns]))

    @cached_property
    def chains(self) -> DataFrame:
        return cut(chains(self.links))

    @cached_property
    def cross(self) -> DataFrame:
        """(c1, p1, c2, p2): edges from a place of one chain down to a place of another."""
        ch = self.chains
        low = ch.select(F.col("node").alias("parent"), F.col("chain").alias("c2"), F.col("pos").alias("p2"))
        high = ch.select(F.col("node").alias("child"), F.col("chain").alias("c1"), F.col("pos").alias("p1"))
        both = self.links.select("child", "parent").join(high, "child").join(low, "parent").where("c1 <> c2")
        return cut(both.groupBy("c1", "p1", "c2").agg(F.max("p2").alias("p2")))

    def placed(self, nodes: DataFrame) -> DataFrame:
        """nodes (with a column node) with chain and pos; a node without edges is a chain."""
        both = nodes.join(self.chains, "node", "left")
        return both.withColumn("chain", F.coalesce("chain", "node")).withColumn("pos", F.coalesce("pos", F.lit(0).cast("bigint")))

    def nodes(self, spans: DataFrame) -> DataFrame:
        """spans (chain, lo, hi, ...) with each node that lies above lo, up to hi."""
        ch = self.chains.select("node", "chain", "pos")
        known = spans.join(ch, "chain").where("pos > lo and pos <= hi")
        alone = spans.where("hi = 0 and lo < 0").join(ch.where("pos = 0").select("chain"), "chain", "left_anti")
        rest = [c for c in spans.columns if c not in ("chain", "lo", "hi")]
        return known.select(*rest, "node").union(alone.select(*rest, F.col("chain").alias("node")))


def _history(edges_: DataFrame | History) -> History:
    return edges_ if isinstance(edges_, History) else History(edges_)


def reached(history: History, start: DataFrame, most_steps: int = 10_000) -> DataFrame:
    """(root, chain, pos): the highest place of each chain that start's rows (root, node) reach.

    Each step follows the edges between chains from places that are new; a step that
    raises no place is the last.
    """
    first = history.placed(start.select("root", "node")).groupBy("root", "chain").agg(F.max("pos").alias("pos"))
    frontier = cut(first.withColumn("was", F.lit(-1).cast("bigint")))
    parts = [frontier.drop("was")]
    for _ in range(most_steps):
        down = frontier.join(history.cross, F.col("chain") == F.col("c1")).where("p1 <= pos and p1 > was")
        new = down.groupBy("root", F.col("c2").alias("chain")).agg(F.max("p2").alias("pos"))
        known = _union(parts).groupBy("root", "chain").agg(F.max("pos").alias("was"))
        raised = new.join(known, ["root", "chain"], "left").where("was is null or pos > was")
        frontier, n = counted(raised.select("root", "chain", "pos", F.coalesce("was", F.lit(-1).cast("bigint")).alias("was")))
        if not n:
            return _union(parts).groupBy("root", "chain").agg(F.max("pos").alias("pos"))
        parts.append(frontier.drop("was"))
    raise RuntimeError("paths change chains more often than most_steps")


def reachable(edges_: DataFrame | History, start: DataFrame) -> DataFrame:
    """(root, node): all that start's rows (root, node) reach through parents, themselves included."""
    h = _history(edges_)
    return h.nodes(reached(h, start).select("root", "chain", F.lit(-1).cast("bigint").alias("lo"), F.col("pos").alias("hi")))


def descendants(edges_: DataFrame, start: DataFrame) -> DataFrame:
    """(root, node): all that reach start's nodes."""
    return reachable(edges_.select(F.col("parent").alias("child"), F.col("child").alias("parent")).distinct(), start)


def _two(pairs: DataFrame) -> DataFrame:
    """Start rows for pairs (pair, left, right): root is struct(pair, side)."""
    return pairs.select("pair", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("node")), F.struct(F.lit("r").alias("side"), F.col("right").alias("node")))).alias("x")).select(F.struct("pair", "x.side").alias("root"), "x.node")


def _beside(far: DataFrame, key: str) -> DataFrame:
    """(key, chain, l, r): how far up the chain either side of reached() rows comes; -1 for not at all."""
    both = far.select(f"root.{key}", "root.side", "chain", "pos")
    top = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("pos"))), F.lit(-1).cast("bigint"))
    return both.groupBy(key, "chain").agg(top("l").alias("l"), top("r").alias("r"))


def _sides(history: History, pairs: DataFrame) -> DataFrame:
    """(pair, chain, l, r) of pairs (pair, left, right)."""
    return _beside(reached(history, _two(pairs)), "pair")


def only_left(edges_: DataFrame | History, start: DataFrame) -> DataFrame:
    """(root, node): what start's rows (root: struct(root, side), node) reach with side l, and not with side r. Both walk together."""
    h = _history(edges_)
    return h.nodes(_beside(reached(h, start), "root").where("l > r").select("root", "chain", F.col("r").alias("lo"), F.col("l").alias("hi")))


def ahead_behind(edges_: DataFrame | History, pairs: DataFrame) -> DataFrame:
    """(pair, ahead, behind): how many commits only left, and only right, reaches. No commit is listed."""
    more = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0)))
    return _sides(_history(edges_), pairs).groupBy("pair").agg(more("l", "r").alias("ahead"), more("r", "l").alias("behind"))


def merge_bases(edges_: DataFrame | History, pairs: DataFrame) -> DataFrame:
    """(pair, node): common ancestors that no other common ancestor reaches; none, one or many.

    Only the highest common node of a chain can be one, and only if no common node of
    another chain has it as a parent.
    """
    h = _history(edges_)
    common = cut(_sides(h, pairs).select("pair", "chain", F.least("l", "r").alias("pos")).where("pos >= 0"))
    above = common.select("pair", F.col("chain").alias("c1"), F.col("pos").alias("top"))
    edge = h.cross.select("c1", "p1", F.col("c2").alias("chain"), F.col("p2").alias("pos"))
    under = common.join(edge, ["chain", "pos"]).join(above, ["pair", "c1"]).where("p1 <= top").select("pair", "chain").distinct()
    bases = common.join(under, ["pair", "chain"], "left_anti")
    return h.nodes(bases.select("pair", "chain", (F.col("pos") - 1).alias("lo"), F.col("pos").alias("hi")))


def is_ancestor(edges_: DataFrame | History, pairs: DataFrame) -> DataFrame:
    """(pair, is_ancestor): left is right, or an ancestor of it."""
    h = _history(edges_)
    far = reached(h, pairs.select(F.struct("pair").alias("root"), F.col("right").alias("node"))).select("root.pair", "chain", F.col("pos").alias("top"))
    left = h.placed(pairs.select("pair", F.col("left").alias("node")))
    return left.join(far, ["pair", "chain"], "left").select("pair", F.coalesce(F.col("pos") <= F.col("top"), F.lit(False)).alias("is_ancestor"))


def commits_between(edges_: DataFrame | History, pairs: DataFrame) -> DataFrame:
    """(pair, node): what right reaches and left doesn't."""
    h = _history(edges_)
    return h.nodes(_sides(h, pairs).where("r > l").select("pair", "chain", F.col("l").alias("lo"), F.col("r").alias("hi")))


def first_parent_log(edges_: DataFrame | History, start: DataFrame, limit: int = 50) -> DataFrame:
    """(root, seq, node): the chain of first parents, newest first, up to limit for each root.

    A step goes down a whole chain; places are looked up for the rows of the result only.
    """
    h = _history(edges_)
    onward = _first_parents(h.links).join(h.chains.where("pos = 0").select("node", "chain"), "node").select("chain", F.col("up").alias("node"))
    onward = cut(h.placed(onward.withColumnRenamed("chain", "below")).select("below", F.col("chain").alias("next"), F.col("pos").alias("at")))
    now = cut(h.placed(start.select("root", "node")).select("root", F.lit(0).cast("bigint").alias("seq"), "chain", "pos"))
    parts = [now]
    for _ in range(limit):
        now, n = counted(now.where(F.col("seq") + F.col("pos") + 1 < limit).join(onward, F.col("chain") == F.col("below")).select("root", (F.col("seq") + F.col("pos") + 1).alias("seq"), F.col("next").alias("chain"), F.col("at").alias("pos")))
        if not n:
            break
        parts.append(now)
    each = _union(parts).select("root", "seq", "chain", "pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("pos", F.lit(limit - 1) - F.col("seq")))).alias("k"))
    spans = each.select("root", (F.col("seq") + F.col("k")).cast("int").alias("seq"), "chain", (F.col("pos") - F.col("k") - 1).alias("lo"), (F.col("pos") - F.col("k")).alias("hi"), (F.col("pos") - F.col("k")).alias("p"))
    found = spans.join(h.chains.select(F.col("chain"), F.col("pos").alias("p"), "node"), ["chain", "p"], "left")
    return found.select("root", "seq", F.coalesce("node", "chain").alias("node"))


def _running_max(points: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (chain, pos, ...) with v: the greatest v of points (chain, pos, v) of the chain up to pos, at least 0.

    Maxima of blocks come first, so that a long chain isn't one group of rows.
    """
    block = F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block")
    own = points.groupBy("chain", block).agg(F.max("v").alias("m"))
    wanted = queries.select("chain", block).distinct().withColumn("m", F.lit(None).cast("bigint"))
    before = Window.partitionBy("chain").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.union(wanted).groupBy("chain", "block").agg(F.max("m").alias("m")).select("chain", "block", F.max("m").over(before).alias("carry"))
    rest = [c for c in queries.columns if c not in ("chain", "pos")]
    asked = queries.select("chain", "pos", F.lit(None).cast("bigint").alias("v"), F.lit(1).alias("late"), F.struct(*rest).alias("rest") if rest else F.lit(None).alias("rest"))
    given = points.select("chain", "pos", F.col("v").cast("bigint").alias("v"), F.lit(0).alias("late"), F.lit(None).cast(asked.schema["rest"].dataType).alias("rest"))
    inside = Window.partitionBy("chain", "block").orderBy("pos", "late").rowsBetween(Window.unboundedPreceding, 0)
    every = given.union(asked).withColumn("block", block).withColumn("own", F.max("v").over(inside)).where("late = 1")
    every = every.join(carried, ["chain", "block"], "left")
    return every.select("chain", "pos", *[F.col(f"rest.{c}").alias(c) for c in rest], F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("carry", F.lit(0)), F.lit(0)).cast("bigint").alias("v"))


def levels(edges_: DataFrame, nodes: DataFrame, most_steps: int = 10_000) -> DataFrame:
    """(node, level): the longest path to a root; parents always have a lower level than children.

    Along a chain, levels go up by one but where an edge from another chain lifts them, so
    only these lifts are worked out, in as many steps as a longest path changes chains.
    """
    inner = edges_.join(nodes.select(F.col("node").alias("child")), "child", "left_semi").join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")
    h = History(inner.distinct())
    lift = lambda low: low.select(F.col("c1").alias("chain"), F.col("p1").alias("pos"), (F.col("p2") + F.col("v") + 1 - F.col("p1")).alias("v")).where("v > 0").groupBy("chain", "pos").agg(F.max("v").alias("v"))
    targets = h.cross.select(F.col("c2").alias("chain"), F.col("p2").alias("pos"), "c1", "p1")
    measured = lambda low: _measured(lift(low), n=F.count(F.lit(1)), v=F.sum("v"))
    points, now = measured(h.cross.withColumn("v", F.lit(0).cast("bigint")))
    last = None
    for _ in range(most_steps):
        if now == last or not now["n"]:
            break
        last = now
        points, now = measured(_running_max(points, targets).withColumnRenamed("pos", "p2"))
    else:
        raise RuntimeError("paths change chains more often than most_steps, or the history has a circle")
    out = _running_max(points, h.chains.select("chain", "pos", "node")).select("node", (F.col("pos") + F.col("v")).cast("int").alias("level"))
    return out.union(nodes.select("node").distinct().join(h.chains, "node", "left_anti").select("node", F.lit(0).alias("level")))


def components(edges_: DataFrame | History, most_steps: int = 200) -> DataFrame:
    """(node, component): nodes of one component are joined by edges in any direction; component is one of its chains.

    Each step hooks a component's label to the least one beside it, then shortens the way
    to the label; work is on chains, whose number falls from step to step.
    """
    h = _history(edges_)
    label = cut(h.chains.select("chain", F.col("chain").alias("label")).distinct())
    pairs, n = counted(h.cross.select(F.col("c1").alias("a"), F.col("c2").alias("b")).distinct())
    for _ in range(most_steps):
        if not n:
            return h.chains.join(label, "chain").select("node", F.col("label").alias("component"))
        both = pairs.union(pairs.select("b", "a"))
        up = cut(both.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("to")).where("to < label"))
        for _ in range(2):
            over = up.select(F.col("label").alias("to"), F.col("to").alias("over"))
            up = cut(up.join(over, "to", "left").select("label", F.coalesce("over", "to").alias("to")))
        label = cut(label.join(up, "label", "left").select("chain", F.coalesce("to", "label").alias("label")))
        a, b = (up.select(F.col("label").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        pairs, n = counted(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    raise RuntimeError("components did not settle")


def _ready_order(kind: str):
    """For the nodes and edges of one component: its order, and for each place the greatest id up to there."""

    def run(key: tuple, nodes: pd.DataFrame, edges_: pd.DataFrame) -> pd.DataFrame:
        import heapq

        waiting = dict.fromkeys(nodes["node"].tolist(), 0)
        up: dict = {}
        for c, p in zip(edges_["child"].tolist(), edges_["parent"].tolist(), strict=True):
            up.setdefault(c, []).append(p)
            waiting[p] += 1
        ready = [n for n, w in waiting.items() if not w]
        heapq.heapify(ready)
        order, tops = [], []
        while ready:
            n = heapq.heappop(ready)
            order.append(n)
            tops.append(n if not tops or n > tops[-1] else tops[-1])
            for p in up.get(n, ()):
                waiting[p] -= 1
                if not waiting[p]:
                    heapq.heappush(ready, p)
        return pd.DataFrame({"node": order, "top": tops, "at": range(len(order))})

    return run


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in the order, from 0: ranges are sorted apart, and counts of ranges come before a place in one."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("local", F.monotonically_increasing_id())
    # the upper bits are the partition, the lower 33 the row in it
    local = cut(dealt.withColumn("part", F.shiftright("local", 33).cast("int")).withColumn("local", F.col("local").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted(tuple(r) for r in local.groupBy("part").count().collect())  # a row a partition
    first, total = {}, 0
    for part, size in sizes:
        first[part], total = total, total + size
    before = rows.sparkSession.createDataFrame(list(first.items()) or [(0, 0)], "part int, first bigint")
    return local.join(F.broadcast(before), "part").withColumn(name, F.col("first") + F.col("local")).drop("part", "first", "local")


def newest_first(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, seq): children before parents, the least ready id first.

    The order within a component is that of a priority queue, which is sequential: one
    task works it out. Taking the least ready id of all components at a time is the same
    as sorting by the greatest id that the own component had before, so components are
    put together by a parallel sort.
    """
    inner = edges_.join(nodes.select(F.col("node").alias("child")), "child", "left_semi").join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")
    inner = cut(inner.select("child", "parent").distinct())
    own = components(inner)
    every = cut(nodes.select("node").distinct().join(own, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    kind = dict(nodes.dtypes)["node"]
    links = cut(inner.join(every.withColumnRenamed("node", "child"), "child"))
    order = every.groupBy("component").cogroup(links.groupBy("component")).applyInPandas(_ready_order(kind), f"node {kind}, top {kind}, at bigint")
    return numbered(order, ["top", "at"], "seq").select("node", F.col("seq").cast("int").alias("seq"))


def closure(contains: DataFrame, start: DataFrame) -> DataFrame:
    """(root, node): all that start's nodes contain (contains: parent, child), themselves included."""
    return reachable(contains.select(F.col("parent").alias("child"), F.col("child").alias("parent")), start)


def missing(closure_: DataFrame, objects: DataFrame) -> DataFrame:
    """Nodes of a closure that objects (id) lacks."""
    return closure_.select("node").distinct().join(objects.select(F.col("id").alias("node")), "node", "left_anti")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge_kind(edges_: DataFrame | History, pairs: DataFrame) -> DataFrame:
    """(pair, kind) of bringing right into left: up_to_date, fast_forward or merge."""
    h = _history(edges_)
    far = cut(_sides(h, pairs))
    side = lambda node, other: h.placed(pairs.select("pair", F.col(node).alias("node"))).join(far, ["pair", "chain"], "left").select("pair", F.coalesce(F.col("pos") <= F.col(other), F.lit(False)).alias(node))
    both = side("right", "l").join(side("left", "r"), "pair")
    return both.select("pair", F.when(F.col("right"), "up_to_date").when(F.col("left"), "fast_forward").otherwise("merge").alias("kind"))


def remote_listing(edges_: DataFrame | History, refs: DataFrame, head: str | None) -> DataFrame:
    """(name, target, ahead, behind) of remote refs against head; both counts are null while there is no head."""
    if head is None:
        none = F.lit(None).cast("bigint")
        return refs.select("name", "target", none.alias("ahead"), none.alias("behind"))
    each = ahead_behind(edges_, refs.select(F.col("name").alias("pair"), F.lit(head).alias("left"), F.col("target").alias("right")))
    return refs.join(each.withColumnRenamed("pair", "name"), "name").select("name", "target", "ahead", "behind")
