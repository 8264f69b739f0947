"""Closure by strongly connected components, against plain Python."""

import random

import pytest

import naive
from conftest import rows
from triplewright import Settings, Workspace
from triplewright.operators import hierarchy
from triplewright.operators.hierarchy import close_hierarchy
from triplewright.plans.workspace import Rounds

HOT = Settings(hot_share=0.1, salts=4, pairs_per_task=0, cell_rows=100, broadcast_rows=0)


def close(spark, pairs, settings=Settings()):
    return close_hierarchy(Workspace(spark), spark.createDataFrame(sorted(pairs), "src string, dst string"), settings=settings)


def ring(name, n):
    return {(f"{name}{i:04}", f"{name}{(i + 1) % n:04}") for i in range(n)}


def graphs():
    r = random.Random(4)
    found = {
        "a tree with equivalent leaves": {(f"n{i}", f"n{i // 2}") for i in range(1, 40)} | {("n30", "e"), ("e", "n30")},
        "rings on a chain": ring("a", 9) | ring("b", 5) | {("a0003", "m"), ("m", "b0002"), ("x", "a0000"), ("b0004", "y")},
        "two rings with a common node": ring("a", 12) | {("a0000", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "a0000")},
        "a ring with chords": ring("a", 30) | {(f"a{r.randrange(30):04}", f"a{r.randrange(30):04}") for _ in range(25)},
        "a long chain": {(f"{i:03}", f"{i + 1:03}") for i in range(70)},
        "a diamond": {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "d")},
        "everything to everything": {(f"k{i}", f"k{j}") for i in range(7) for j in range(7)} | {("k1", "out")},
    }
    for n in range(5):
        found[f"random {n}"] = {(f"n{r.randrange(30):02}", f"n{r.randrange(30):02}") for _ in range(22 + 6 * n)}
    return found


GRAPHS = graphs()


@pytest.mark.parametrize("settings", [Settings(), HOT], ids=["plain", "hot"])
def test_all_graphs_at_once(spark, settings):
    """By graph, so that equal names in different graphs do not meet."""
    edges = [(name, a, b) for name, pairs in GRAPHS.items() for a, b in sorted(pairs)]
    closed = close_hierarchy(Workspace(spark), spark.createDataFrame(edges, "g string, src string, dst string"), ["g"], settings)
    expected = {name: naive.transitive(pairs) for name, pairs in GRAPHS.items()}
    assert rows(closed.pairs()) == sorted((name, a, b) for name, pairs in expected.items() for a, b in pairs)
    equal = {(name, a, b) for name, pairs in expected.items() for a, b in pairs if (b, a) in pairs}
    assert rows(closed.equivalents()) == sorted(equal)
    members = rows(closed.members)
    assert {(g, n) for g, n, _ in members} == {(g, a) for g, a, _ in equal} and len(members) == len(set(members))
    for g, node, rep in members:
        assert rep == min([node, *(b for name, a, b in equal if (name, a) == (g, node))])
    above = {(g, a, b) for g, a, b in rows(closed.above)}
    assert not {(g, b, a) for g, a, b in above} & above


@pytest.mark.parametrize("name", ["two rings with a common node", "a ring with chords", "a long chain", "random 3"])
def test_one_graph(spark, name):
    assert rows(close(spark, GRAPHS[name]).pairs()) == sorted(naive.transitive(GRAPHS[name]))


def test_no_edges(spark):
    closed = close_hierarchy(Workspace(spark), spark.createDataFrame([("a", "a")], "src string, dst string"))
    assert closed.pairs().collect() == [] and closed.equivalents().collect() == []


def test_a_ring_costs_rows_until_it_is_asked_for(spark, monkeypatch):
    """2,000 equivalent classes below one another: no table on the way has more than a few rows for each."""
    made, save, append = [], Workspace.save, Rounds.append

    def counted(self, df, name, **more):
        out = save(self, df, name, **more)
        made.append(out.count())
        return out

    monkeypatch.setattr(Workspace, "save", counted)
    monkeypatch.setattr(Rounds, "append", lambda self, df: made.append(append(self, df)) or made[-1])
    closed = close(spark, ring("c", 2000) | {("below", "c0007"), ("c1500", "above")})
    assert closed.members.count() == 2000 and closed.members.where("rep <> 'c0000'").isEmpty()
    assert rows(closed.above) == [("below", "above"), ("below", "c0000"), ("c0000", "above")]
    assert max(made) <= 2 * 2002
    pairs = closed.pairs()
    assert pairs.where("src = 'below'").count() == 2001 and pairs.where("dst = 'c0042'").count() == 2000


def test_passed_nodes_are_no_neighbours(spark):
    core = spark.createDataFrame(sorted(ring("a", 60)), "src string, dst string")
    passed = {r.node: (r.u, r.w) for r in hierarchy._passable(core, 1).collect()}
    assert 10 < len(passed) <= 30
    assert not {x for ends in passed.values() for x in ends} & set(passed)
