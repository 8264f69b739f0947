"""Closure of a hierarchy by its strongly connected components.

Equivalent nodes are found first and stand for each other as one. What is left has no cycle; it is closed by path
doubling, and classes of equivalent nodes are put back last. A cycle of n nodes so costs n rows until pairs are
asked for, and whether two nodes are equivalent is read from their class, not from the closure.

Cycles are found on a core of the edges that shrinks in every round:

* nodes with edges in both directions between them are merged, by connected components;
* edges at a node without way in or without way out are on no cycle and go;
* a node with one way in, u, and one way out, w, is passed over by an edge from u to w. It is equivalent to them if
  they turn out equivalent to each other. Of neighbouring ones a hash picks which go in a round, so a ring or
  chain of n nodes is gone after about log n rounds.

If none of these changes anything, every node left is on several paths; the core is then closed itself, and nodes that
reach each other are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import Workspace
from ..settings import Settings
from .closure import transitive_closure
from .components import connected_components
from .joins import hot_values, skew_join

#: Between the columns that edges agree on and the node; no term has it.
_MARK = "\u0001"


@dataclass
class Hierarchy:
    """``members`` (by, node, rep) of the classes of two or more equivalent nodes, and ``above`` (by, src, dst), the
    closure of the acyclic hierarchy of classes, each named by its smallest node."""
    by: list[str]
    members: DataFrame
    above: DataFrame
    settings: Settings

    def pairs(self) -> DataFrame:
        """(by, src, dst), src != dst: every pair of the closure, those of equivalent nodes included."""
        down = self._in_place_of(self._in_place_of(self.above, "src"), "dst")
        return down.unionByName(self.equivalents())

    def equivalents(self) -> DataFrame:
        """(by, src, dst), src != dst: all ordered pairs of equivalent nodes. Quadratic in the largest class."""
        left = self.members.withColumnRenamed("node", "src")
        right = self.members.withColumnRenamed("node", "dst")
        hot = hot_values(self.members, "rep", self.settings)
        both = skew_join(left, right, [*self.by, "rep"], "rep", hot, hot, self.settings.salts)
        return both.where("src <> dst").select(*self.by, "src", "dst")

    def _in_place_of(self, pairs: DataFrame, end: str) -> DataFrame:
        """Each pair for every node of the class that stands at this end."""
        classes = self.members.withColumnRenamed("rep", end)
        return pairs.join(classes, [*self.by, end], "left").select(
            *self.by, *(F.coalesce("node", c).alias(c) if c == end else F.col(c) for c in ("src", "dst")))


def close_hierarchy(ws: Workspace, edges: DataFrame, by: list[str] | None = None,
                    settings: Settings = Settings()) -> Hierarchy:
    """The closure of ``edges`` (by, src, dst); paths are of edges that agree on the ``by`` columns."""
    by = list(by or [])
    if by:
        tagged = edges.select(*(F.concat_ws(_MARK, *by, end).alias(end) for end in ("src", "dst")))
    else:
        tagged = edges.select("src", "dst")
    tagged = ws.save(tagged.where("src <> dst").distinct(), ws.unique("edges"))
    merged = _equivalent(ws, tagged, settings)
    above = transitive_closure(ws, tagged if merged is None else _relabelled(tagged, merged), settings=settings)
    if merged is None:
        merged = ws.spark.createDataFrame([], "node string, rep string")
    return Hierarchy(by, _untagged(merged, by, "node", "rep"), _untagged(above, by, "src", "dst"), settings)


def _untagged(df: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    if not by:
        return df.select(first, second)

    def part(column, n):
        return F.split(F.col(column), _MARK, len(by) + 1)[n]

    return df.select(*(part(first, n).alias(c) for n, c in enumerate(by)), part(first, len(by)).alias(first),
                     part(second, len(by)).alias(second))


def _relabelled(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Distinct edges between the classes of ``merged`` (node, rep), without those inside a class."""
    for end in ("src", "dst"):
        other = "dst" if end == "src" else "src"
        edges = edges.join(merged.withColumnRenamed("node", end), end, "left").select(
            F.coalesce("rep", end).alias(end), other)
    return edges.where("src <> dst").distinct().select("src", "dst")


def _equivalent(ws: Workspace, edges: DataFrame, settings: Settings) -> DataFrame | None:
    """(node, rep) for the classes of two or more nodes that reach each other, rep the smallest; None if none do."""
    steps: list[tuple[str, DataFrame]] = []
    core, rows = edges, edges.count()
    seed = 0
    while rows:
        before = rows
        two_way = ws.save(core.join(core.toDF("dst", "src"), ["src", "dst"], "left_semi").where("src < dst"), ws.unique("two-way"))
        if not two_way.isEmpty():
            same = _classes_of(ws, two_way, settings)
            steps.append(("same", same))
            core = ws.save(_relabelled(core, same), ws.unique("core"))
        nodes = ws.save(_degrees(core), ws.unique("nodes"))
        core = ws.save(_open(core, nodes), ws.unique("core"))
        rows = core.count()
        if not rows:
            break
        seed += 1
        passed = ws.save(_passable(core, seed), ws.unique("passed"))
        if not passed.isEmpty():
            steps.append(("passed", passed))
            core = ws.save(_passed_over(core, passed), ws.unique("core"))
            rows = core.count()
        if rows == before:
            closed = transitive_closure(ws, core, settings=settings)
            mutual = closed.join(closed.toDF("dst", "src"), ["src", "dst"], "left_semi").where("src < dst")
            mutual = ws.save(mutual, ws.unique("mutual"))
            if not mutual.isEmpty():
                steps.append(("same", _classes_of(ws, mutual, settings)))
            break
    return _resolved(ws, steps)


def _classes_of(ws: Workspace, pairs: DataFrame, settings: Settings) -> DataFrame:
    """(node, rep) of the components of undirected ``pairs`` (src, dst).

    Most classes are small: the smallest node within two steps is tried first, and is right where both ends of every
    pair then agree.
    """
    near = pairs.selectExpr("inline(array(struct(src as node, dst as other), struct(dst as node, src as other), "
                            "struct(src as node, src as other), struct(dst as node, dst as other)))")
    first = near.groupBy("node").agg(F.min("other").alias("least"))
    second = near.join(first.toDF("other", "least"), "other").groupBy("node").agg(F.min("least").alias("rep"))
    tried = ws.save(second, ws.unique("same"))
    left, right = tried.toDF("src", "a"), tried.toDF("dst", "b")
    if pairs.join(left, "src").join(right, "dst").where("a <> b").isEmpty():
        return tried
    return ws.save(connected_components(ws, pairs, settings), ws.unique("same"))


def _degrees(core: DataFrame) -> DataFrame:
    """(node, ways_in, ways_out) of every node."""
    ends = core.selectExpr("inline(array(struct(src as node, 0 as i, 1 as o), struct(dst as node, 1 as i, 0 as o)))")
    return ends.groupBy("node").agg(F.sum("i").alias("ways_in"), F.sum("o").alias("ways_out"))


def _open(core: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that do not begin at a node without way in or end at one without way out."""
    starts = nodes.where("ways_in = 0").select(F.col("node").alias("src"))
    ends = nodes.where("ways_out = 0").select(F.col("node").alias("dst"))
    return core.join(starts, "src", "left_anti").join(ends, "dst", "left_anti").select("src", "dst")


def _passable(core: DataFrame, seed: int) -> DataFrame:
    """(node, u, w) of nodes between one u and one w, no two of them neighbours; a hash decides between these."""
    ends = core.selectExpr("inline(array(struct(src as node, null as u, dst as w), struct(dst as node, src as u, null as w)))")
    one = ends.groupBy("node").agg(F.count("u").alias("i"), F.count("w").alias("o"), F.min("u").alias("u"),
                                   F.min("w").alias("w")).where("i = 1 and o = 1 and u <> w").select("node", "u", "w")
    rank = one.select("node", F.xxhash64(F.lit(seed), "node").alias("rank"))
    near = one.join(rank, "node")
    for end in ("u", "w"):
        near = near.join(rank.toDF(end, f"rank_{end}"), end, "left")
    lowest = [F.col(f"rank_{e}").isNull() | (F.struct("rank", "node") < F.struct(F.col(f"rank_{e}"), F.col(e))) for e in ("u", "w")]
    return near.where(lowest[0] & lowest[1]).select("node", "u", "w")


def _passed_over(core: DataFrame, passed: DataFrame) -> DataFrame:
    left = core.join(passed.select(F.col("node").alias("src")), "src", "left_anti")
    left = left.join(passed.select(F.col("node").alias("dst")), "dst", "left_anti")
    return left.select("src", "dst").union(passed.select("u", "w")).distinct()


def _resolved(ws: Workspace, steps: list[tuple[str, DataFrame]]) -> DataFrame | None:
    """The classes of all nodes, from the steps backwards: later steps say what the nodes of earlier ones became."""
    if not any(kind == "same" for kind, _ in steps):
        return None
    if len(steps) == 1:
        return steps[0][1]
    known: DataFrame | None = None  # (node, rep) in the names after the steps that are still to come
    for number, (kind, step) in enumerate(reversed(steps)):
        if kind == "same":
            if known is not None:
                later = known.toDF("rep", "last")
                moved = step.join(later, "rep", "left").select("node", F.coalesce("last", "rep").alias("rep"))
                step = moved.unionByName(known.join(step.select("node"), "node", "left_anti"))
            known = step
        elif known is not None:
            ends = step
            for end in ("u", "w"):
                ends = ends.join(known.toDF(end, f"rep_{end}"), end, "left")
            joined = ends.where("rep_u = rep_w").select("node", F.col("rep_u").alias("rep"))
            known = known.unionByName(joined)
        if known is not None:
            known = ws.save(known, ws.unique("classes"))
    # The class is named by its smallest node, also where passed nodes came into it.
    smallest = known.groupBy("rep").agg(F.min("node").alias("first"))
    named = known.join(smallest, "rep").select("node", F.least("first", "rep").alias("rep"))
    return ws.save(named, ws.unique("classes"))
