"""Closure, components, joins and set operators against plain Python on small inputs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import naive
from conftest import key_of, rows
from triplewright import Settings, Workspace
from triplewright.operators import sets
from triplewright.operators.closure import transitive_closure
from triplewright.operators.components import connected_components, expand_pairs
from triplewright.operators.joins import Counts, grid, hot_values, may_match, skew_join
from triplewright.operators.sameas import functional_links, pair_counts

HOT = Settings(hot_share=0.1, salts=4, pairs_per_task=0, cell_rows=100, pair_block=5)


def edges_of(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src string, dst string")


def random_pairs(seed, nodes, n):
    rng = random.Random(seed)
    return {(f"n{rng.randrange(nodes):02}", f"n{rng.randrange(nodes):02}") for _ in range(n)}


@pytest.mark.parametrize("settings", [Settings(), HOT], ids=["plain", "hot"])
def test_closure(spark, settings):
    pairs = random_pairs(1, 40, 45) | {("hub", f"n{i:02}") for i in range(20)} | {("x", "x"), ("y", "y")}
    closed = transitive_closure(Workspace(spark), edges_of(spark, pairs), settings=settings)
    assert rows(closed) == sorted(naive.transitive(pairs))


def test_closure_of_a_chain_and_of_itself(spark):
    chain = {(f"{i:03}", f"{i + 1:03}") for i in range(40)}
    ws = Workspace(spark)
    closed = transitive_closure(ws, edges_of(spark, chain))
    assert closed.count() == 40 * 41 // 2
    assert rows(transitive_closure(ws, closed)) == rows(closed)


def test_closure_by_property(spark):
    triples = [("p", "a", "b"), ("p", "b", "c"), ("q", "b", "d"), ("q", "d", "e")]
    closed = transitive_closure(Workspace(spark), spark.createDataFrame(triples, "p string, src string, dst string"), ["p"])
    assert rows(closed) == sorted(triples + [("p", "a", "c"), ("q", "b", "e")])


def components_of(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    rep = {}
    for start in sorted(near):
        if start in rep:
            continue
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in rep:
                rep[node] = start
                todo.extend(near[node])
    return sorted(rep.items())


@pytest.mark.parametrize("settings", [Settings(), HOT], ids=["plain", "hot"])
def test_components(spark, settings):
    pairs = random_pairs(2, 60, 40)
    pairs |= {("z_hub", f"m{i}") for i in range(30)} | {(f"c{i:02}", f"c{i + 1:02}") for i in range(25)} | {("x", "x")}
    found = connected_components(Workspace(spark), edges_of(spark, pairs), settings)
    assert rows(found) == components_of(pairs)


def test_components_of_nothing(spark):
    assert rows(connected_components(Workspace(spark), edges_of(spark, {("x", "x")}))) == []


@pytest.mark.parametrize("settings", [Settings(), HOT], ids=["plain", "hot"])
def test_pairs_and_their_count(spark, settings):
    members = [(f"n{i}", "a") for i in range(12)] + [("k", "k"), ("l", "k")]
    df = spark.createDataFrame(members, "node string, rep string")
    expected = sorted((x, y) for x, a in members for y, b in members if a == b and x != y)
    assert rows(expand_pairs(df, settings)) == expected
    stated = spark.createDataFrame([("k", "l"), ("k", "l"), ("k", "k")], "x string, y string")
    counts = pair_counts(df, stated).first()
    assert (counts.classes, counts.members, counts.largest, counts.pairs) == (2, 14, 12, len(expected))
    assert counts.new_pairs == len(expected) - 1


def test_pairs_of_a_large_class_in_blocks(spark):
    """No cell of the join has more than about the pairs of two blocks, whatever the size of the class."""
    members = spark.range(3000).selectExpr("'n' || id as node", "if(id < 2900, 'a', 'r' || id div 2) as rep")
    found = expand_pairs(members, Settings(pair_block=100))
    assert found.count() == 2900 * 2899 + 100
    assert found.distinct().count() == 2900 * 2899 + 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "i#" in plan and "j#" in plan


def test_hot_values(spark):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, 'hot', 'k' || id) as k")
    assert hot_values(df, "k", HOT) == {"hot": 4}
    assert hot_values(df.union(df), "k", HOT) == {"hot": 7}  # cells grow with the rows of the key
    assert hot_values(df, "k", Settings()) == {}


def test_skew_join_is_the_join_and_spreads_hot_keys(spark):
    left = spark.range(600).selectExpr("if(id % 3 = 0, 'hot', 'k' || id % 50) as k", "id as a")
    right = spark.range(90).selectExpr("if(id % 3 = 0, 'hot', 'k' || id) as k", "id as b")
    plain = rows(left.join(right, "k"))
    for hot_left, hot_right in ((["hot"], []), ([], {"hot": 3}), ({"hot": 2}, ["hot"])):
        assert rows(skew_join(left, right, ["k"], "k", hot_left, hot_right, 5)) == plain
    spread = skew_join(left.hint("shuffle_merge"), right, ["k"], "k", ["hot"], ["hot"], 5)
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    assert "_i" in plan and "_j" in plan


def test_functional_links_of_a_hot_group(spark):
    facts = spark.range(300).selectExpr("if(id % 3 = 0, 's', 's' || id) as s", "'f' as p", "'o' || id as o")
    groups = defaultdict(set)
    for s, _, o in facts.collect():
        groups[s].add(o)
    expected = sorted((o, min(g)) for g in groups.values() for o in g if o != min(g))
    assert rows(functional_links(facts, HOT)) == expected


def test_set_operators(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "v string")
    right = spark.createDataFrame([("c",), ("c",), ("d",)], "v string")
    assert rows(sets.difference(left, right)) == [("a",), ("b",)]
    assert rows(sets.unseen(left, right)) == [("a",), ("b",)]
    assert rows(sets.union_all([left, right])) == sorted(rows(left) + rows(right))


@pytest.mark.parametrize("settings", [Settings(), HOT], ids=["plain", "hot"])
def test_group_values_is_whole(spark, settings):
    pairs = [("big", f"v{i:04}") for i in range(2000)] + [("small", "b"), ("small", "a"), ("small", "a")]
    grouped = sets.group_values(spark.createDataFrame(pairs, "k string, v string"), "k", "v", 100, settings).collect()
    assert [r.vals for r in grouped if r.k == "small"] == [["a", "b"]]
    big = [r for r in grouped if r.k == "big"]
    assert sorted(x for r in big for x in r.vals) == sorted({v for k, v in pairs if k == "big"})
    assert len(big) == 20 and max(r.n for r in big) < 200


def test_a_hub_of_one_property_is_hot(spark):
    """The share counts among the rows that the rule reads, not among all facts."""
    from triplewright.plans import materialize as m
    from triplewright.plans.axioms import select_axioms
    from triplewright.plans.heat import Heat
    from triplewright.plans.rulebook import compile_rules
    from triplewright.plans.store import FactStore
    from triplewright import vocab as v

    few = spark.range(100).selectExpr("'<s' || id || '>' as s", "'<t>' as p", "'<hub>' as o").unionByName(
        spark.range(50).selectExpr("'<hub>' as s", "'<t>' as p", "'<z' || id || '>' as o"))
    many = spark.range(15_000).selectExpr("'<x' || id || '>' as s", "'<q>' as p", "'<y' || id || '>' as o")
    stated = spark.createDataFrame([("<t>", v.TYPE, v.TRANSITIVE), ("<q>", v.INVERSE_OF, "<r>")], few.schema)
    df, ws, settings = few.union(many).union(stated), Workspace(spark), Settings(pairs_per_task=1000)
    book = compile_rules(ws, ws.save(select_axioms(df), "axioms"), settings)
    facts, heat = FactStore(ws, settings, df.count()), Heat(ws, settings)
    facts.start(m._relevant(df, book))
    heat.add(facts, book)
    left, right = heat.of("transitive")
    key = key_of(spark, "<hub>")
    # 100 x 50 pairs, 1,000 to a cell; the value is on no other rows that the rule reads.
    assert list(left) == [key] and left[key] * right.get(key, 1) >= 5


def test_grid():
    settings = Settings(pairs_per_task=1000, cell_rows=100)
    left, right = Counts({"both": 200, "left": 5000, "few": 10, "none": 9}, 0), Counts({"both": 50, "left": 1, "few": 10, "x": 7}, 0)
    i, j = grid(left, right, settings)
    assert set(i) == {"both", "left"} and set(j) == {"both"}
    assert i["left"] == 50  # cells of 100 rows
    assert 10 <= i["both"] * j["both"] <= 20 and i["both"] > j["both"]
    # A value that is not listed may have as many rows as the last listed one.
    assert grid(Counts({"a": 5000}, 5000), Counts({"b": 5000}, 5000), settings)[0].keys() == {"a", "b"}
    assert grid(Counts({"a": 900}, 0), Counts({"a": 1}, 0), settings) == ({}, {})


def test_skew_join_on_two_columns(spark):
    """Only the rows of the hot pair of subject and property are spread and copied."""
    left = spark.range(400).selectExpr("if(id % 4 = 0, 'x', 's' || id % 20) as s", "if(id % 8 = 0, 'p', 'q') as p", "id as o")
    right = spark.range(60).selectExpr("if(id % 2 = 0, 'x', 's' || id % 20) as s", "if(id % 4 = 0, 'p', 'q') as p", "id as c")
    plain = rows(left.join(right, ["s", "p"]))
    key = key_of(spark, "x", "p")
    spread = skew_join(left, right, ["s", "p"], ["s", "p"], {key: 3}, {key: 2})
    assert rows(spread) == plain
    made = []
    for side, name in ((left, "_j"), (right, "_i")):
        made.append(spread._jdf.queryExecution().optimizedPlan().toString().count(name))
    assert all(made)


def test_closure_finds_a_pair_of_a_chain_about_once(spark, monkeypatch):
    from triplewright.operators import closure

    made = []
    compose = closure.compose

    def counted(*args):
        out = compose(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(closure, "compose", counted)
    edges = spark.range(200).selectExpr("'n' || id as src", "'n' || (id + 1) as dst")
    assert transitive_closure(Workspace(spark), edges).count() == 20_100
    assert sum(made) <= 3 * 20_100


def test_may_match_keeps_all_rows_that_match_and_few_others(spark):
    left = spark.range(20_000).selectExpr("if(id % 1000 = 1, null, id) as k", "string(id % 7) as t", "id as row").repartition(5)
    right = left.where("k % 50 = 0").select("k", "t")
    found = may_match(left, right, ["k", "t"], right.count())
    assert found.columns == left.columns
    ids = {r.row for r in found.collect()}
    assert ids >= set(range(0, 20_000, 50)) and len(ids) < 400 + 2 * 20_000 / 16
    assert may_match(left, right.limit(0), ["k", "t"], 0).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
